"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. A document's word shingles are hashed to 64 bits; each document gets a
   digest of its set and the band keys of its MinHash signature. Documents with
   equal sets form a class, and only its least document goes on.
2. Documents that share a band key are candidates; the components of that
   relation are the groups within which links are sought.
3. A group is dealt into blocks. In each block, candidate pairs compare their
   signatures batch by batch and are dropped once the posterior probability of
   a similarity at or above the threshold falls below ``miss``; survivors are
   verified on full shingle sets. Pairs already connected by verified links
   need no look: they change no component.
4. Groups of several blocks: what the first pass links is one class; documents
   outside their group's largest class are then held, block by block, against
   all documents of the group. So a group of very many near copies costs little
   more than its size, and no link between classes is lost. Where more blocks
   are outside than a document has bands, the same candidates are met within
   the buckets of single bands instead, so that a chain of loosely alike
   documents, however long, costs its buckets and not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import ascii_lower, bounded_broadcast, components, kept, slices, table, words_of

#: Documents whose ids may be broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Near:
    #: Words of a shingle, and the least similarity of a link as a fraction.
    words: int = 4
    num: int = 80
    den: int = 100
    #: 44 bands of 7 rows miss a pair of similarity 0.8 with probability 3e-5, one of 0.85 with 3e-8.
    rows: int = 7
    bands: int = 44
    #: Hashes compared at once, and the posterior probability of a link below which a candidate is dropped.
    batch: int = 44
    miss: float = 1e-7
    #: Documents of a block, and bytes of their sets.
    block: int = 256
    block_bytes: int = 32_000_000

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


@cache
def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, k, np.uint64) | np.uint64(1), r.integers(0, 2**63, k, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that scatters them."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: Words whose hashes a worker remembers, in about 200 bytes each.
CACHE_WORDS = 200_000


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; a bounded cache keeps frequent ones."""
    import xxhash

    known: dict[str, int] = kept("words", dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    out = [known.get(w) for w in words]
    for i, h in enumerate(out):
        if h is None:
            out[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i].encode())
    return np.array(out, np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``size``-word shingles; of the whole sequence if it has fewer words; none without words."""
    lists = [words_of(ascii_lower(t)) if t else [] for t in texts]
    flat = _word_hashes([w for ws in lists for w in ws])
    if not len(flat):
        return [np.zeros(0, np.uint64) for _ in texts]
    # The hash of a shingle is a polynomial in its words' hashes, mixed; a short sequence has its length mixed in.
    mult = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(len(flat), np.uint64)
    for j in range(size):
        part = flat[j:]
        run = run * mult
        run[: len(part)] += part
    run = _mix(run)
    out, at = [], 0
    for ws in lists:
        n = len(ws)
        if n >= size:
            out.append(np.unique(run[at : at + n - size + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in flat[at : at + n]:
                    h = h * mult + w
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash signatures, a row of ``k`` 32-bit values per (non-empty) set."""
    a, b = _multipliers(k)
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), k), np.uint32)
    if not len(sets):
        return out
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(sets)
    # A few thousand hashes at a time stay in the processor's cache.
    at, piece = 0, 8192
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + piece)))
        lo, hi = int(starts[at]), int(starts[end - 1] + sizes[end - 1])
        x, off = flat[lo:hi], starts[at:end] - lo
        for j in range(k):
            out[at:end, j] = np.minimum.reduceat(((x * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), off)
        at = end
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per document and band."""
    m, k = sig.shape
    bands = sig.reshape(m, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), (m, k // rows)).copy()
    for j in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j]
    return _mix(key)


@cache
def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(hashes compared, fewest matches with which a pair stays) after each batch.

    With a uniform prior the posterior probability that the similarity is at
    least t, given m matches in n, is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


# ---------------------------------------------------------------- step 1


def _sketched(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), near.words)
            sizes = [len(s) for s in sets]
            full = [s for s in sets if len(s)]
            keys = band_keys(signatures(full, near.hashes), near.rows).view(np.int64)
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            ends = np.cumsum([0] + [near.bands * (n > 0) for n in sizes]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), bands], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


# ---------------------------------------------------------------- step 3


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(b.column(b.schema.get_field_index("text")).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "grp", "bytes", "shingles"])

    return run


def links(ids: list[int], sets: list[np.ndarray], label: list[int], asks: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Verified links among a task's documents that join different labels, as a forest.

    Only pairs with at least one asking document are looked at. ``label`` is
    each document's class so far.
    """
    n = len(ids)
    sig = signatures(sets, near.hashes)
    keys = band_keys(sig, near.rows)
    sizes = np.array([len(s) for s in sets])
    # Banded candidates: a task has a few hundred documents, so all their keys are compared at once, some rows at a time.
    rows = []
    step = max(1, 4_000_000 // max(1, n * near.bands))
    for lo in range(0, n, step):
        same = (keys[lo : lo + step, None, :] == keys[None, :, :]).any(2)
        i, j = np.nonzero(same)
        i += lo
        keep = (i < j) & (asks[i] | asks[j])
        rows.append(np.stack([i[keep], j[keep]]))
    i, j = np.concatenate(rows, axis=1)
    # Sets whose sizes differ too much can't be similar enough.
    ok = near.den * np.minimum(sizes[i], sizes[j]) >= near.num * np.maximum(sizes[i], sizes[j])
    i, j = i[ok], j[ok]
    seen = np.zeros(len(i), np.int64)
    done = 0
    for n_hashes, least in least_matches(near.hashes, near.batch, near.num / near.den, near.miss):
        seen += (sig[i, done:n_hashes] == sig[j, done:n_hashes]).sum(1)
        stay = seen >= least
        i, j, seen, done = i[stay], j[stay], seen[stay], n_hashes
    parent = {x: x for x in label}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-seen, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        a, b = find(label[x]), find(label[y])
        if a == b:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if near.den * both >= near.num * (len(sets[x]) + len(sets[y]) - both):
            parent[max(a, b)] = min(a, b)
            out.append((ids[x], ids[y]))
    return out


def _linked(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by task (grp, qb, bb): the links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(held) > 1:
                sets = [np.frombuffer(r[2], np.uint64) for r in held]
                out.extend(links([r[1] for r in held], sets, [r[3] for r in held], np.array([r[4] for r in held]), near))
            held.clear()

        for b in batches:
            for row in zip(zip(*(b.column(c).to_pylist() for c in ("grp", "qb", "bb"))), *(b.column(c).to_pylist() for c in ("doc_id", "shingles", "label", "asks"))):
                if held and held[0][0] != row[0]:
                    flush()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    return run


def _tasks(df: DataFrame, near: Near) -> DataFrame:
    dealt = df.select("grp", "qb", "bb", "doc_id", "shingles", "label", "asks").repartition("grp", "qb", "bb").sortWithinPartitions("grp", "qb", "bb", "doc_id")
    return dealt.mapInArrow(_linked(near), "u long, v long")


def _blocks(docs: Column, size: Column, near: Near) -> Column:
    """Blocks for so many documents with so many bytes of sets."""
    return F.greatest(F.ceil(docs / near.block), F.ceil(size / near.block_bytes)).cast("int")


def _plan(named: DataFrame, near: Near) -> DataFrame:
    """For each group of ``named(grp, doc_id, bytes, label)`` with several labels: its largest class, its blocks and those of the documents outside."""
    per = named.groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = per.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "label", "bytes")).alias("top"))
    outside = _blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"), near)
    return whole.where("n > top.n").select("grp", F.col("top.label").alias("main"), _blocks(F.col("n"), F.col("bytes"), near).alias("blocks"), outside.alias("ask_blocks"))


def _meetings(named: DataFrame, plan: DataFrame) -> DataFrame:
    """The tasks in which documents outside their group's largest class meet all of the group: grp, qb, bb, doc_id, label, asks."""
    rows = named.join(bounded_broadcast(plan, BROADCAST_IDS), "grp").withColumn("asks", F.col("label") != F.col("main"))
    # Salted anew, so that a block's documents meet others than in the first pass.
    turn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("ask_blocks")).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    asking = rows.where("asks").select("grp", turn.alias("qb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bb"), "doc_id", "label", "asks")
    asked = rows.select("grp", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("qb"), block.alias("bb"), "doc_id", "label", "asks", turn.alias("turn"))
    # A document that asks in a block is in that task already.
    asked = asked.where("NOT (asks AND qb = turn)").withColumn("asks", F.lit(False))
    return asking.unionByName(asked.drop("turn"))


def find_links(texts: DataFrame, bands: DataFrame, near: Near) -> DataFrame:
    """Verified links (u, v) that give the components of ``texts(doc_id, grp, text)`` within each group; ``bands(doc_id, bands)`` has the band keys."""
    sets = table(texts.select("doc_id", "grp", "text").mapInArrow(_sets(near.words), "doc_id long, grp long, bytes long, shingles binary"), "sets")
    sizes = table(sets.groupBy("grp").agg(_blocks(F.count("*"), F.sum("bytes"), near).alias("blocks")).where("blocks > 1"), "sizes")
    large = bounded_broadcast(sizes, BROADCAST_IDS)
    own = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    alone = sets.join(large, "grp", "left").select("grp", F.lit(-1).alias("qb"), own.alias("bb"), "doc_id", "shingles", F.col("doc_id").alias("label"), F.lit(True).alias("asks"))
    first = table(_tasks(alone, near), "links")
    if sizes.isEmpty():
        return first

    # Who meets whom is planned on ids; their sets come last.
    held = sets.join(large, "grp")
    named = held.groupBy("grp", "doc_id").agg(F.sum("bytes").alias("bytes"))
    named = named.join(components(first).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    named = table(named, "named")
    plan = table(_plan(named, near), "plan")
    meet = _meetings(named, plan.where(F.col("ask_blocks") <= near.bands))
    loose = plan.where(F.col("ask_blocks") > near.bands).select("grp")
    if not loose.isEmpty():
        buckets = named.join(bounded_broadcast(loose, BROADCAST_IDS), "grp", "left_semi").drop("grp").join(bands, "doc_id")
        buckets = table(buckets.select("doc_id", "bytes", "label", F.explode("bands").alias("grp")).distinct(), "buckets")
        meet = meet.unionByName(_meetings(buckets, table(_plan(buckets, near), "plan")))
    return first.unionByName(table(_tasks(meet.join(held.select("doc_id", "shingles"), "doc_id"), near), "links"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingle, link with nothing and stay.
    Rows of one id are one document with the links of all its texts. A row with
    a null id is linked with nothing, has a null component and stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = table(rows.mapInArrow(_sketched(near), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal bands, so any row of the class gives them.
    classes = table(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u < top").select("band", "u")
    banded = buckets.join(shared, "band").where("u < rep").select("u", F.col("rep").alias("v"))
    groups = table(components(banded).select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "groups")
    texts = rows.join(bounded_broadcast(groups, BROADCAST_IDS), "doc_id").select("doc_id", "grp", "text")
    found = find_links(texts, classes.select(F.col("rep").alias("doc_id"), "bands"), near)
    # Classes tie their members to the representative, which verified links tie to others.
    member = some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    by_rep = components(found)
    rep_of = some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep")
    several = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    if not several.isEmpty():  # ids with several texts tie classes together
        extra = rep_of.join(several.select("doc_id"), "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        by_rep = components(found.unionByName(member).unionByName(extra))
        named = by_rep.select(F.col("node").alias("doc_id"), "component")
    else:
        named = rep_of.join(by_rep.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles").join(named.distinct(), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, near: Near = Near(words=5)) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near duplicates the least id.

    Rows without id or without words stay; rows of one id stay or go together;
    an empty table gives an empty one.
    """
    gone = near_duplicates(docs, near).where("NOT kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
