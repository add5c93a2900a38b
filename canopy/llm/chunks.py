"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 32 bytes cuts each text where some of its
bits are zero, so an insertion moves the cuts near it only. Chunks are told
apart by a 128-bit digest; of equal chunks the first in (doc_id, place) order
stays and the others go, if they form a run of some length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import kept, slices, table


@dataclass(frozen=True)
class Cuts:
    #: Only whole chunks inside a repeat match, so they are small beside a passage of 50 words (about 300 bytes).
    min_bytes: int = 16
    max_bytes: int = 128
    #: A cut falls on one place in 2**mask_bits beyond the minimum.
    mask_bits: int = 4
    #: Adjacent repeated chunks go only if together they hold so many bytes: over half of such a passage, more than a common line.
    min_run: int = 176


def _gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, key=b"gear").digest(), "little") for b in range(256)], np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 32, by doubling; places before the start count as nothing."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        up = h.copy()
        up[step:] += h[:-step] << np.uint32(step)
        h = up
    return h


def cut_points(data: bytes, cuts: Cuts) -> list[int]:
    """Ends of the chunks of one text, ascending, the last one its length. An empty text has none."""
    n = len(data)
    if n == 0:
        return []
    # The middle bits depend on about as many bytes as their number.
    mask = np.uint32(((1 << cuts.mask_bits) - 1) << (24 - cuts.mask_bits))
    marks = (np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) & mask == 0) + 1).tolist()
    ends, at, i, m = [], 0, 0, len(marks)
    while n - at > cuts.min_bytes:
        while i < m and marks[i] < at + cuts.min_bytes:
            i += 1
        at = min(marks[i] if i < m else n, at + cuts.max_bytes, n)
        ends.append(at)
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def _chunked(cuts: Cuts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("chunks", dict)  # nothing; what another operator kept goes
        for b in slices(batches):
            ids, ties, at, size, digests = [], [], [], [], []
            for doc_id, tie, text in zip(*(c.to_pylist() for c in b.columns)):
                data = text.encode() if text else b""
                start = 0
                for end in cut_points(data, cuts):
                    ids.append(doc_id)
                    ties.append(tie)
                    at.append(start)
                    size.append(end - start)
                    digests.append(xxhash.xxh3_128_digest(data[start:end]))
                    start = end
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32())],
                names=["d1", "d2", "key", "tie", "at", "size"],
            )

    return run


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells a row apart: ``key``, the id (the largest long for null), and ``tie``, a 64-bit hash of the text."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("key"),
        F.xxhash64(docs["text"].cast("string")).alias("tie"),
    )


def united(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """[start, end] of the runs that spans of (start, size) cover; those that touch are one."""
    out: list[list[int]] = []
    for a, s in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], a + s)
        else:
            out.append([a, a + s])
    return out


def cleaned(batches: Iterator[pa.RecordBatch], min_run: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Cut the spans (arrays ``at`` and ``size``; they may touch or overlap) out of each text's bytes; united spans under ``min_run`` bytes stay.

    With an array ``cut``, spans where it is false stay too, and ``n_repeated`` is the number of bytes in any span.
    """
    longs = ("n_bytes", "n_removed", "n_spans", "n_repeated")
    for b in slices(batches):
        told = "cut" in b.schema.names
        out: dict[str, list] = {k: [] for k in (*longs[:3], "kept_sha256", *["kept_text"] * with_text, *["n_repeated"] * told)}
        cuts = b.column("cut").to_pylist() if told else [None] * b.num_rows
        for text, at, size, cut in zip(*(b.column(n).to_pylist() for n in ("text", "at", "size")), cuts):
            data = text.encode() if text else b""
            if told:
                out["n_repeated"].append(sum(e - a for a, e in united(zip(at or [], size or []))))
            spans = [x for x in united((a, s) for a, s, c in zip(at or [], size or [], cut or [True] * len(at or [])) if c) if x[1] - x[0] >= min_run]
            kept, last = [], 0
            for a, e in spans:
                kept.append(data[last:a])
                last = e
            kept.append(data[last:])
            rest = b"".join(kept)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(rest))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if with_text:
                # A cut may fall inside a character; its stray bytes are not text.
                out["kept_text"].append(rest.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.int64() if k in longs else pa.string()) for k, v in out.items())], names=["doc_id", *out])


def cut_spans(rows: DataFrame, spans: DataFrame, min_run: int = 1, with_text: bool = False) -> DataFrame:
    """``rows`` of ``identified`` without the bytes in ``spans(key, tie, at, size)``; one row per row. With a boolean ``cut`` as in ``cleaned``."""
    # A text has no more spans than bytes, so a list per text is as bounded as the text is.
    told = "cut" in spans.columns
    lists = ["at", "size", *["cut"] * told]
    per = spans.groupBy("key", "tie").agg(*(F.collect_list(c).alias(c) for c in lists))
    joined = rows.join(per, ["key", "tie"], "left").select("doc_id", "text", *lists)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + ", n_repeated long" * told
    return joined.mapInArrow(lambda it: cleaned(it, min_run, with_text), schema)


def dedup(docs: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Of equal chunks the first by (doc_id, hash of the text, place) stays. Null
    and empty texts have no chunk and nothing removed. Null ids come last. Rows
    equal in id and text are one occurrence and get one result.
    """
    rows = identified(docs)
    found = table(rows.select("key", "tie", "text").mapInArrow(_chunked(cuts), "d1 long, d2 long, key long, tie long, at int, size int"), "chunks")
    # Chunks are many and few occur again: half a digest and a count find them, and only they go on with all columns.
    again = table(found.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "again")
    found = table(found.join(again, "d1", "left_semi"), "repeated")  # the table of all chunks isn't read again
    # The minimum is taken before the shuffle too, so a chunk of a third of all texts arrives as a row per task.
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("key", "tie", "at")).alias("first"), F.count("*").alias("n"))
    # Only chunks that occur again; written, so that the join is of plain shuffles, whose hot keys AQE splits.
    first = table(first.where("n > 1").drop("n"), "first")
    later = found.join(first, ["d1", "d2"]).where(F.struct("key", "tie", "at") > F.col("first"))
    spans = later.select("key", "tie", "at", "size").distinct()
    return cut_spans(rows, spans, cuts.min_run, with_text=True)
