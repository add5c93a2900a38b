"""Chat formatting with minimum-cost role repair.

Turns run through an automaton of legal roles. A turn may keep its role, take
another, be merged into the turn before, or be preceded by empty turns; dynamic
programming finds the cheapest way to a legal end. Ties go to the lowest state,
then to the first option listed, so a result doesn't depend on how rows are
dealt.

A turn's effect is a matrix over (min, +), and matrices compose: a conversation
may reach over any number of blocks of sorted rows. Only blocks' outermost
conversations need more than their own block, so the driver handles two small
matrices per block, never a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import table

#: States by the role of the last turn; 0 stands for no turn yet.
STATES = ("", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (3,)
INF = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Option:
    cost: int
    inserts: tuple[int, ...]
    merge: bool
    relabel: bool


@cache
def _paths(state: int) -> dict[int, tuple[int, ...]]:
    """Shortest empty turns that lead from a state to each state (itself: none)."""
    out, front = {state: ()}, [state]
    while front:
        s = front.pop(0)
        for q in NEXT[s]:
            if q not in out:
                out[q] = (*out[s], q)
                front.append(q)
    return out


@cache
def options(costs: Costs) -> dict[tuple[int, int, int], Option]:
    """(state, input role or 0 for an unknown one, new state) to the cheapest option."""
    out = {}
    for s in range(4):
        for r in range(4):
            for q in (1, 2, 3):
                relabel = costs.relabel * (q != r)
                found = [Option(relabel + costs.insert * len(via), via, False, q != r) for mid, via in _paths(s).items() if q in NEXT[mid]]
                if s == q:
                    found.append(Option(costs.merge + relabel, (), True, q != r))
                if found:
                    out[s, r, q] = min(found, key=lambda o: o.cost)
    return out


@cache
def closing(costs: Costs) -> dict[int, tuple[int, tuple[int, ...]]]:
    """State at the end to (cost, empty turns) of the cheapest legal end."""
    out = {}
    for s in range(4):
        via = min((p for q, p in _paths(s).items() if q in FINAL), key=len)
        out[s] = (costs.insert * len(via), via)
    return out


def role_state(role: str | None) -> int:
    """1 to 3 for a known role in any case and with blanks around; 0 for others and null."""
    name = (role or "").strip().lower()
    return STATES.index(name) if name in STATES[1:] else 0


def forward(start: tuple[int, ...], role: int, costs: Costs) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Costs of each state after a turn, and the state each came from (-1: unreachable)."""
    table_ = options(costs)
    out, back = [INF] * 4, [-1] * 4
    for s in range(4):
        if start[s] < INF:
            for q in (1, 2, 3):
                o = table_.get((s, role, q))
                if o and start[s] + o.cost < out[q]:
                    out[q], back[q] = start[s] + o.cost, s
    return tuple(out), tuple(back)


def matrix(roles: list[int], costs: Costs) -> list[list[int]]:
    """The (min, +) product of the turns' matrices."""
    rows = []
    for s in range(4):
        v: tuple[int, ...] = tuple(0 if x == s else INF for x in range(4))
        for r in roles:
            v, _ = forward(v, r, costs)
        rows.append(list(v))
    return rows


def apply(v: tuple[int, ...], m: list[list[int]]) -> tuple[int, ...]:
    return tuple(min(INF, *(v[s] + m[s][q] for s in range(4))) for q in range(4))


def best_end(v: tuple[int, ...], costs: Costs) -> int:
    end = closing(costs)
    return min(range(4), key=lambda s: (v[s] + end[s][0], s))


def trace(start: tuple[int, ...], roles: list[int], last: int | None, costs: Costs) -> list[int]:
    """The states of the cheapest way, from before the first turn to after the last one; ``last`` is the state to end in, None: the best legal end."""
    v, backs = start, []
    for r in roles:
        v, back = forward(v, r, costs)
        backs.append(back)
    states = [best_end(v, costs) if last is None else last]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return states[::-1]


BEGIN = (0, INF, INF, INF)


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    joint: str = "\n\n"
    #: What must not occur in a text, and what is put for it.
    marker: str = "<|im_"
    escaped: str = "<| im_"

    def empty(self, state: int) -> str:
        return self.start.format(role=STATES[state]) + self.end


#: A part of a conversation in a block: (block, conversation).
Part = tuple[int, "int | None"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, list[tuple]]]:
    """Runs of rows of one block and conversation. Rows of a block's part are held together: a block is a partition of bounded size."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if (row[0], row[1]) != key:
                if rows:
                    yield key, rows
                key, rows = (row[0], row[1]), []
            rows.append(row)
    if rows:
        yield key, rows


def _matrices(costs: Costs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first and the last part of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for (block, conv), rows in _parts(batches):
            item = (conv, len(rows), matrix([role_state(r[3]) for r in rows], costs))
            found[block] = [found[block][0], item] if block in found else [item]
        flat = [(b, i, conv, n, sum(m, [])) for b, items in found.items() for i, (conv, n, m) in enumerate(items)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["block", "at", "conv_id", "n", "m"])

    return run


def _entries(costs: Costs, starts: dict[Part, tuple[int, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the parts in ``starts``: the state before the first turn for each state after the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = []
        for part, rows in _parts(batches):
            if part in starts:
                roles = [role_state(r[3]) for r in rows]
                flat.append((*part, [trace(starts[part], roles, q, costs)[0] if q else -1 for q in range(4)]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["block", "conv_id", "entry"])

    return run


OUT = "conv_id long, turn long, ordinal long, role string, new_role string, action string, inserted string, appended string, rendered string"


def _rendered(costs: Costs, t: Template, known: dict[Part, tuple[tuple[int, ...], int | None, bool, bool, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``known``: for parts of conversations over several blocks, costs before, state after, whether first, whether last, turns before."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, end = options(costs), closing(costs)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * len(names)
            rb = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)], names=names)
            out.clear()
            return rb

        for part, rows in _parts(batches):
            start, last, is_first, is_last, before = known.get(part, (BEGIN, None, True, True, 0))
            roles = [role_state(r[3]) for r in rows]
            states = trace(start, roles, last, costs)
            for i, row in enumerate(rows):
                o = table_[states[i], roles[i], states[i + 1]]
                head = i == 0 and is_first
                text = (row[4] or "").replace(t.marker, t.escaped)
                if o.merge:
                    s = t.joint + text
                else:
                    s = "" if head else t.end
                    s += "".join(t.empty(q) for q in o.inserts) + t.start.format(role=STATES[states[i + 1]]) + text
                more: tuple[int, ...] = ()
                if is_last and i == len(rows) - 1:
                    more = end[states[i + 1]][1]
                    s += t.end + "".join(t.empty(q) for q in more)
                action = "_".join(["merge"] * o.merge + ["relabel"] * o.relabel) or "keep"
                out.append((row[1], row[2], before + i, row[3], STATES[states[i + 1]], action, ",".join(STATES[q] for q in o.inserts), ",".join(STATES[q] for q in more), s))
                if len(out) >= 4096:
                    yield batch()
        yield batch()

    return run


def repair(turns: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """One row per row of ``turns(conv_id, turn, role, text)``; the ``rendered`` pieces of a conversation, in the order of ``ordinal`` from 0, make its text (see ``whole_texts``).

    ``action`` is keep, relabel, merge or merge_relabel; ``inserted`` and
    ``appended`` name empty turns before a turn and after the last one. Null
    texts are empty; null or unknown roles are relabelled; rows of a null
    conv_id are one conversation; null turns come first; ties are ordered by
    role and a hash of the text, and equal rows stand one after the other. A
    block is a range of the sorted rows, dealt by the number of shuffle
    partitions: that number must grow with the table. An empty table gives no
    rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    # The order is total, so a range may end inside a conversation, and one that holds most rows is in many blocks.
    order = ["conv_id", "turn", "role", "tie"]
    rows = table(rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "turns")
    dealt = rows.repartition("block").sortWithinPartitions("block", *order).select("block", "conv_id", "turn", "role", "text")
    ends = sorted(dealt.mapInArrow(_matrices(costs), "block int, at int, conv_id long, n long, m array<long>").collect(), key=lambda r: (r.block, r.at))  # two rows a block
    chains: list[list] = []
    for r in ends:
        if chains and chains[-1][-1].conv_id == r.conv_id and chains[-1][-1].block != r.block:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    known: dict[Part, tuple[tuple[int, ...], int | None, bool, bool, int]] = {}
    if chains:
        starts: dict[Part, tuple[int, ...]] = {}
        before: dict[Part, int] = {}
        final: list[tuple[int, ...]] = []
        for chain in chains:
            v: tuple[int, ...] = BEGIN
            turns_so_far = 0
            for r in chain:
                starts[r.block, r.conv_id], before[r.block, r.conv_id] = v, turns_so_far
                turns_so_far += r.n
                v = apply(v, [r.m[4 * s : 4 * s + 4] for s in range(4)])
            final.append(v)
        entry = {(r.block, r.conv_id): r.entry for r in dealt.mapInArrow(_entries(costs, starts), "block int, conv_id long, entry array<long>").collect()}
        for chain, v in zip(chains, final):
            last = best_end(v, costs)
            for r in reversed(chain):
                part = (r.block, r.conv_id)
                known[part] = (starts[part], last, r is chain[0], r is chain[-1], before[part])
                last = entry[part][last]
    return dealt.mapInArrow(_rendered(costs, template, known), OUT)


def whole_texts(repaired: DataFrame, turns: int = 10_000) -> DataFrame:
    """conv_id, part, text: the rendered conversations, ``turns`` turns to a part, so that one of any length is never a single cell.

    The parts of a conversation in order, from 0, are its text; all but very long ones have one.
    """
    part = F.floor(F.col("ordinal") / turns).cast("long")
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "rendered")))
    return repaired.groupBy("conv_id", part.alias("part")).agg(pieces.alias("p")).select("conv_id", "part", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"))
