"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash is taken at every byte. The least hash in the first
``reach`` bytes of a string of ``length`` bytes is its trigger; equal strings
have equal triggers, wherever they stand. All string starts that share a
trigger make one phrase: the bytes from the first start to the end of the last
string. The distinct phrases are the dictionary, and a document is parsed into
a sequence of them.

* A phrase that occurs again makes all its starts repeated. Where a text repeats
  a few bytes over and over, its equal neighbouring phrases are one row of the
  parse, with their number.
* A phrase whose bytes just after the trigger occur nowhere else has none.
* The remaining phrases are grouped by those bytes. In each group a suffix
  array of the dictionary's phrases, ordered to ``length`` bytes, shows which
  starts have an equal. A group too large for one task is resolved by digests
  of its strings instead.

The same parse finds repeated strings of a second, smaller length, which are
told but not removed: triggers and starts are then those of the short strings,
phrases still reach to the end of the last long one (or of the text), and the
suffix array stops at the short length on its way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.chunks import cut_spans, gear_hashes, identified
from canopy.llm.common import bounded_broadcast, kept, slices, table

#: Documents whose ids may be broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Parse:
    #: Bytes of a string.
    length: int = 400
    #: The trigger is among so many first bytes; what is left of the string after it is at least ``after``.
    reach: int = 300
    #: Phrases of one group that one task may hold.
    group_rows: int = 20_000
    #: Bytes of the strings that are told but stay, under ``length``; 0 for none.
    short: int = 0

    @property
    def least(self) -> int:
        return self.short or self.length

    @property
    def after(self) -> int:
        return self.least - self.reach


#: What the query uses: 256 bytes are about 40 words.
PASSAGES = Parse(400, 216, short=256)


#: Bytes under the rolling hash.
ROLL = 32


def triggers(data: np.ndarray, p: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each phrase of a text; none if it is shorter than a string."""
    n = len(data) - p.least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    roll = min(ROLL, p.after)
    # A hash of the roll bytes from i on, then the least (hash, place) of each window of reach places, by doubling.
    h = (gear_hashes(data) << np.uint32(ROLL - roll))[roll - 1 :][: n + p.reach - 1]
    low = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < p.reach:
        step = min(width, p.reach - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.concatenate(([0], new))
    return lo, np.concatenate((new - 1, [n - 1])), at[lo]


def _parsed(p: Parse) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("phrases", dict)  # nothing; what another operator kept goes
        for b in slices(batches):
            ids, ties, los, spans, marks, ends, reps, near, e = [], [], [], [], [], [], [], [], []
            for key, tie, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode() if text else b""
                lo, hi, at = triggers(np.frombuffer(data, np.uint8), p)
                if not len(lo):
                    continue
                digests = [xxhash.xxh3_128_digest(data[x : y + p.length]) for x, y in zip(lo.tolist(), hi.tolist())]
                first = [0, *(i for i in range(1, len(digests)) if digests[i] != digests[i - 1])]
                last = [*(i - 1 for i in first[1:]), len(digests) - 1]
                ids += [key] * len(first)
                ties += [tie] * len(first)
                los.append(lo[first])
                spans.append(hi[first] - lo[first])
                marks.append(at[first] - lo[first])
                ends.append(np.minimum(hi[last] + p.length, len(data)) - lo[first])
                reps.append(np.array(last) - first + 1)
                near += [xxhash.xxh3_64_intdigest(data[m : m + p.after]) for m in at[first].tolist()]
                e += [digests[i] for i in first]
            d = np.frombuffer(b"".join(e), "<i8").reshape(-1, 2)
            cat = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(near, np.uint64).view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), *(pa.array(cat(x)) for x in (los, spans, marks, ends, reps))],
                names=["near", "e1", "e2", "key", "tie", "at", "more", "mark", "size", "reps"],
            )

    return run


#: ``at`` is the first start, ``more`` the starts after it in one phrase, ``mark`` the trigger's place in it, ``size`` the bytes to the end of the run of ``reps`` equal phrases.
PARSE_SCHEMA = "near long, e1 long, e2 long, key long, tie long, at int, more int, mark int, size int, reps int"


def repeated_starts(phrases: list[bytes], group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each phrase, whether each of its strings of ``length`` bytes occurs at another place in the phrases of its group."""
    return repeated_starts_of(phrases, group, [length], [len(x) for x in phrases])[0]


def repeated_starts_of(phrases: list[bytes], group: np.ndarray, lengths: list[int], starts_of: list[int], marks: list[int] | None = None) -> list[list[np.ndarray]]:
    """``repeated_starts`` for each of ascending ``lengths``; only so many first places of a phrase as ``starts_of`` says are starts.

    A suffix array over all phrases by prefix doubling: suffixes are ranked by
    their group and first 5, 10, 20, ... bytes (or 6, or up to 8, as fit beside
    the group), at last by each of ``lengths``. Those without an equal leave the
    order with a rank of their own. Where ``marks`` tells the trigger's place in
    each phrase, strings can be equal only if they stand alike to it, and
    suffixes are ranked by that too.
    """
    sizes = np.array([len(x) for x in phrases], np.int64)
    data = np.frombuffer(b"".join(phrases), np.uint8)
    n = len(data)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    live = place < np.repeat(np.array(starts_of, np.int64), sizes)
    own = np.arange(n) + n

    def ordered(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``at`` that have an equal, and all ranks."""
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        many = ~new | np.concatenate((~new[1:], [False]))[: len(keys)]
        rank = own.copy()
        at = at[order[many]]
        rank[at] = np.cumsum(new)[many]
        at.sort()
        return at, rank

    side = np.repeat(group.astype(np.int64), sizes)
    if marks is not None and n:
        apart = place - np.repeat(np.array(marks, np.int64), sizes)
        apart -= apart.min()
        side = side * (apart.max() + 1) + apart
    depth = min(8, lengths[0], (64 - int(side.max(initial=0)).bit_length()) // 8)
    first = side.astype(np.uint64)
    for j in range(depth):  # bytes beyond a phrase's end don't matter: such suffixes take no part
        first <<= np.uint64(8)
        first[: n - j] |= data[j:]
    at = np.flatnonzero(left >= depth)
    at, rank = ordered(at, first[at])
    out = []
    for length in lengths:
        while depth < length:
            step = min(depth, length - depth)
            at = at[left[at] >= depth + step]
            at, rank = ordered(at, rank[at] * 2 * n + rank[at + step])
            depth += step
        again = np.zeros(n, bool)
        asked = at[live[at]]
        again[asked] = np.bincount(rank[asked], minlength=1)[rank[asked]] > 1
        out.append([again[s : s + max(0, k - length + 1)] for s, k in zip(starts.tolist(), sizes.tolist())])
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


SPANS = pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("cut", pa.bool_())])


def _resolved(p: Parse, most: int = 60_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by ``near``: whole groups, as many as a processor's cache holds, go through one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            number: dict[int, int] = {}
            group = np.array([number.setdefault(r[0], len(number)) for r in held])
            out: list[tuple] = []
            lengths = sorted({p.least, p.length})
            for length, found in zip(lengths, repeated_starts_of([r[7] for r in held], group, lengths, [r[4] + 1 for r in held], [r[5] for r in held])):
                for (_, key, tie, at, _, _, n, _), flags in zip(held, found):
                    if n == 1:  # the others are known to be repeated
                        out += [(key, tie, at + a, k + length - 1, length == p.length) for a, k in _runs(flags)]
            return pa.RecordBatch.from_pylist([dict(zip(SPANS.names, r)) for r in out], schema=SPANS)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("near", "key", "tie", "at", "more", "mark", "n", "phrase"))):
                if size > most and held[-1][0] != row[0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield flush()

    return run


def _cut_phrases(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their classes to the classes with their bytes."""
    for b in slices(batches):
        rows = []
        for key, tie, text, classes in zip(*(b.column(c).to_pylist() for c in ("key", "tie", "text", "classes"))):
            data = text.encode()
            rows += [{"near": c["near"], "key": key, "tie": tie, "at": c["at"], "more": c["more"], "mark": c["mark"], "n": c["n"], "phrase": data[c["at"] : c["at"] + c["more"] + length]} for c in classes]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("near", pa.int64()), *list(SPANS)[:3], ("more", pa.int32()), ("mark", pa.int32()), ("n", pa.int64()), ("phrase", pa.binary())]))


def _digests(p: Parse, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a phrase, of either length, with its digest."""
    for b in batches:
        for key, tie, at, more, n, phrase in zip(*(b.column(c).to_pylist() for c in ("key", "tie", "at", "more", "n", "phrase"))):
            for length in {p.least, p.length}:
                k = max(0, min(more, len(phrase) - length) + 1)
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(phrase[i : i + length]) for i in range(k)]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([key] * k, pa.int64()), pa.array([tie] * k, pa.int64()), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array([length] * k, pa.int32()), pa.array([n] * k, pa.int64())],
                    names=["s1", "s2", "key", "tie", "at", "size", "n"],
                )


def repeated_spans(rows: DataFrame, p: Parse = Parse()) -> DataFrame:
    """(key, tie, at, size, cut) of byte spans in ``rows`` of ``identified`` that repeated strings cover, ``cut`` where long ones do; spans may overlap."""
    parsed = table(rows.where(F.octet_length("text") >= p.least).select("key", "tie", "text").mapInArrow(_parsed(p), PARSE_SCHEMA), "parse")
    # Counts are made before the shuffle too: a phrase of a third of all texts arrives as a row per task.
    # Written, so that the join is of plain shuffles, whose hot keys AQE splits.
    near = table(parsed.groupBy("near").agg(F.sum("reps").alias("rows"), (F.min("e1") != F.max("e1")).alias("mixed")).where("rows > 1").select("near", "mixed"), "near")
    hits = table(parsed.join(near, "near"), "hits")
    # All strings of a repeated phrase are repeated; only at a text's end may it be too short for a long one.
    whole = lambda df: df.select("key", "tie", "at", "size", (F.col("size") >= p.length).alias("cut"))
    spans = whole(hits.where("NOT mixed"))

    mixed = hits.where("mixed")
    classes = table(mixed.groupBy("near", "e1", "e2").agg(F.sum("reps").alias("n"), F.min(F.struct("key", "tie", "at", "more", "mark")).alias("one")), "classes")
    repeated = classes.where("n > 1").select("near", "e1", "e2")
    spans = spans.unionByName(whole(mixed.join(repeated, ["near", "e1", "e2"], "left_semi")))

    # Equal rows hold a class twice at one place: then n > 1, and all is said.
    groups = classes.groupBy("near").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("near", "k")
    asked = classes.join(groups, "near").select("one.key", "one.tie", F.struct("near", F.col("one.at").alias("at"), F.col("one.more").alias("more"), F.col("one.mark").alias("mark"), "n").alias("c"), "k")
    by_text = asked.groupBy("key", "tie").agg(F.collect_list("c").alias("classes"))  # as bounded as the text
    by_text = table(by_text, "asked")
    # Only ids are broadcast, and only up to a number of them; what is asked of each text meets it in a shuffle.
    texts = rows.select("key", "tie", "text").join(bounded_broadcast(by_text.select("key", "tie"), BROADCAST_IDS), ["key", "tie"], "left_semi")
    texts = texts.join(by_text, ["key", "tie"])
    cut = table(texts.mapInArrow(lambda it: _cut_phrases(p.length, it), "near long, key long, tie long, at int, more int, mark int, n long, phrase binary"), "dictionary")
    small, large = groups.where(F.col("k") <= p.group_rows), groups.where(F.col("k") > p.group_rows)
    ordered = cut.join(small.select("near"), "near").repartition("near").sortWithinPartitions("near")
    spans = spans.unionByName(ordered.mapInArrow(_resolved(p), "key long, tie long, at int, size int, cut boolean"))

    strings = cut.join(large.select("near"), "near").mapInArrow(lambda it: _digests(p, it), "s1 long, s2 long, key long, tie long, at int, size int, n long")
    counts = strings.groupBy("s1", "s2").agg(F.count("*").alias("m")).where("m > 1").select("s1", "s2")
    alone = strings.where("n = 1").join(counts, ["s1", "s2"], "left_semi").select("key", "tie", "at", "size", (F.col("size") == p.length).alias("cut"))
    return spans.unionByName(alone)


def remove_repeats(docs: DataFrame, p: Parse = Parse(), with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text if asked for, and n_repeated if ``p.short`` is set.

    ``n_repeated`` is the number of bytes that strings of ``p.short`` bytes which
    also start elsewhere cover, those removed included. All occurrences go, the first too. Null texts are empty; texts shorter than
    a string lose nothing. Rows with null or equal ids are told apart by a
    64-bit hash of their text; rows equal in both are occurrences of each other.
    """
    rows = identified(docs)
    spans = repeated_spans(rows, p)
    return cut_spans(rows, spans if p.short else spans.drop("cut"), 1, with_text)
