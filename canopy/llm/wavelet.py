"""Token ids in wavelet matrices, one compressed file per shard.

A file holds the ids of consecutive documents as bit planes, from the highest
bit down. Below each plane the ids are stably parted by their bit, so that rank
and select on the planes give an id at a place, the number of times an id
occurs before a place, and the place of its k-th occurrence, without decoding
the rest. Planes are framed in blocks and the file has a directory of them with
the set bits before each, so a reader inflates only the blocks that it touches.

Layout (little-endian): ``WMX2``, u32 header length, header (JSON: counts, the
zeros of each plane, and offset and size of the parts), then as zstd frames the
document ids (i64), null flags (u8), document lengths (u32), and the directory
(per plane and block: u64 offset, u32 size, u64 set bits before); then a frame
per plane and block: u16 set bits before each 512 bits of the block, and its
packed bits.
"""

from __future__ import annotations

import array
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import kept, new_dir, slices, table

MAGIC = b"WMX2"
#: A shard file is closed at so many ids; a longer document makes a larger file of its own.
SHARD_TOKENS = 2_000_000
#: Bits of a plane's block, and of an entry of the rank directory in it.
BLOCK = 1 << 16
STEP = 512
#: Inflated blocks that a reader holds.
HELD_BLOCKS = 256
#: Runs whose ids a worker remembers, in about 30 bytes each.
CACHE_RUNS = 600_000
#: Characters of the texts that are encoded at once.
ENCODE_CHARS = 4_000_000
END_ID = 1


def _steps(bits: np.ndarray) -> np.ndarray:
    """Set bits in each ``STEP`` bits of packed bits."""
    full = np.zeros(-(-len(bits) // (STEP // 8)) * (STEP // 8), np.uint8)
    full[: len(bits)] = bits
    return np.bitwise_count(full.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.int64)


class WaveletMatrix:
    """Rank, select and access over ``n`` ids; ``block(level, b)`` gives a block's step ranks and packed bits, ``before[level]`` the set bits before each block and in all."""

    def __init__(self, n: int, zeros: list[int], before: list[np.ndarray], block: Callable[[int, int], tuple[np.ndarray, np.ndarray]]):
        self.n, self.zeros, self.before, self.block, self.bits = n, zeros, before, block, len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, before, blocks = [], [], []
        for b in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            # Places, then take: several times as fast as a boolean index.
            low, high = np.flatnonzero(~one), np.flatnonzero(one)
            zeros.append(len(low))
            seq = np.concatenate((seq.take(low), seq.take(high)))
            sums = np.concatenate(([0], np.cumsum(_steps(packed))))
            per = BLOCK // STEP
            edge = np.arange(0, len(sums) - 1, per)
            before.append(np.append(sums[edge], sums[-1]))
            blocks.append([((sums[a : min(a + per, len(sums) - 1)] - sums[a]).astype(np.uint16), packed[a * STEP // 8 : (a + per) * STEP // 8]) for a in edge.tolist()])
        return cls(len(ids), zeros, before, lambda level, b: blocks[level][b])

    def blocks(self) -> int:
        """Blocks of each plane."""
        return -(-self.n // BLOCK)

    def _plane(self, level: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(self.block(level, b)[1] for b in range(self.blocks()))])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(seq)
            z = self.zeros[level]
            up[np.flatnonzero(~one)] = seq[:z]
            up[np.flatnonzero(one)] = seq[z:] | dtype(1 << (self.bits - 1 - level))
            seq = up
        return seq

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of a plane."""
        out = np.empty(len(at), np.int64)
        which = at // BLOCK
        for b in np.unique(which).tolist():
            here = np.flatnonzero(which == b)
            if b * BLOCK == self.n or b >= self.blocks():
                out[here] = self.before[level][-1]
                continue
            steps, bits = self.block(level, b)
            inside = at[here] - b * BLOCK
            step = inside // STEP
            head = self.before[level][b] + np.append(steps, 0)[step].astype(np.int64)
            # The step's bytes, with the bits from the place on cleared.
            full = np.zeros((len(steps) + 1) * STEP // 8, np.uint8)
            full[: len(bits)] = bits
            rows = full.reshape(-1, STEP // 8)[step]
            left = np.clip((inside - step * STEP)[:, None] - 8 * np.arange(STEP // 8), 0, 8)
            out[here] = head + np.where(step < len(steps), np.bitwise_count(rows & ((1 << left) - 1).astype(np.uint8)).sum(1, dtype=np.int64), self.before[level][b + 1] - head)
        return out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bits = self.block(level, i // BLOCK)[1]
            bit = int(bits[(i % BLOCK) >> 3] >> (i & 7)) & 1
            ones = int(self._ones(level, np.array([i]))[0])
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _ranges(self, token: int, places: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self._ones(level, places)
            places = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else places - ones
        return places

    def counts(self, token: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences of an id in each [lo, hi)."""
        if not 0 <= token < 1 << self.bits or not len(lo):
            return np.zeros(len(lo), np.int64)
        at = self._ranges(token, np.concatenate((lo, hi)).astype(np.int64))
        return at[len(lo) :] - at[: len(lo)]

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        return int(self.counts(token, np.array([lo]), np.array([self.n if hi is None else hi]))[0])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        a, b = self._ranges(token, np.array([0, self.n])).tolist() if 0 <= token < 1 << self.bits else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self._place(level, i - self.zeros[level] if one else i, one)
        return i

    def _place(self, level: int, k: int, one: int) -> int:
        """Place of the k-th bit of that kind in a plane: by the directory to the block, by its ranks to the step, then among the step's bits."""
        before = self.before[level][:-1]
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        b = int(np.searchsorted(before, k, "right")) - 1
        k -= int(before[b])
        steps, bits = self.block(level, b)
        ranks = steps.astype(np.int64)
        if not one:
            ranks = np.arange(len(ranks)) * STEP - ranks
        s = int(np.searchsorted(ranks, k, "right")) - 1
        k -= int(ranks[s])
        part = np.unpackbits(bits[s * STEP // 8 : (s + 1) * STEP // 8], bitorder="little")
        return b * BLOCK + s * STEP + int(np.flatnonzero(part == one)[k])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


class Shard:
    """A wavelet matrix with the ids and lengths of its documents."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: list[int | None], lengths: np.ndarray):
        self.matrix, self.doc_ids, self.lengths = matrix, doc_ids, lengths

    def to_bytes(self) -> bytes:
        m = self.matrix
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        docs = [pack(x) for x in (ids.tobytes(), nulls.tobytes(), self.lengths.astype("<u4").tobytes())]
        frames = [pack(steps.astype("<u2").tobytes() + bits.tobytes()) for level in range(m.bits) for steps, bits in (m.block(level, b) for b in range(m.blocks()))]
        sizes = np.array([len(x) for x in frames], "<u4")
        # Offsets count from the end of the directory.
        ends = np.cumsum(sizes.astype("<u8"), dtype="<u8")
        before = np.concatenate([np.zeros(0), *(m.before[level][:-1] for level in range(m.bits))]).astype("<u8")
        directory = pack((ends - sizes).astype("<u8").tobytes() + sizes.tobytes() + before.tobytes())
        head = json.dumps({"n": m.n, "docs": len(ids), "zeros": m.zeros, "parts": [len(x) for x in (*docs, directory)]}).encode()
        return b"".join((MAGIC, struct.pack("<I", len(head)), head, *docs, directory, *frames))

    @classmethod
    def open(cls, read: Callable[[int, int], bytes], held: int = HELD_BLOCKS) -> Shard:
        """A shard over ``read(offset, size)``: header and directory are read at once, blocks when they are asked for."""
        magic, n = struct.unpack("<4sI", read(0, 8))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        head = json.loads(read(8, n))
        at, parts = 8 + n, []
        unpack = zstandard.ZstdDecompressor().decompress
        for size in head["parts"]:
            parts.append(unpack(read(at, size)))
            at += size
        ids, nulls = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8)
        bits, blocks = len(head["zeros"]), -(-head["n"] // BLOCK)
        k = bits * blocks
        offsets, sizes = np.frombuffer(parts[3], "<u8", k), np.frombuffer(parts[3], "<u4", k, 8 * k)
        ranks = np.frombuffer(parts[3], "<u8", k, 12 * k).astype(np.int64).reshape(bits, blocks)
        before = [np.append(ranks[level], head["n"] - head["zeros"][level]) for level in range(bits)]
        cache: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def block(level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            i = level * blocks + b
            if i not in cache:
                data = unpack(read(at + int(offsets[i]), int(sizes[i])))
                steps = -(-min(BLOCK, head["n"] - b * BLOCK) // STEP)
                cache[i] = np.frombuffer(data, "<u2", steps), np.frombuffer(data, np.uint8, offset=2 * steps)
                if len(cache) > held:
                    cache.popitem(last=False)
            return cache[i]

        matrix = WaveletMatrix(head["n"], head["zeros"], before, block)
        return cls(matrix, [None if z else int(i) for i, z in zip(ids, nulls)], np.frombuffer(parts[2], "<u4").astype(np.int64))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        return cls.open(lambda at, size: data[at : at + size])


# ---------------------------------------------------------------- encoding

#: Texts of these characters only are cut into pieces that the tokenizer treats apart; all others go to it whole.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xff]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A mark after a word and before white space is a piece of its own.
_LAST_MARK = f"([{_LETTERS}])([.,;:!?)])([ \n]|$)"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS} \n]+")


def splits_by_piece(tokenizer_path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space and cuts text as ``_PIECES`` does, so that pieces may be encoded apart."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    cut = steps[0].get("pattern") == {"Regex": rule} and steps[0].get("invert") is True
    plain_bytes = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
    return kinds == ["NFC", "Replace", "Lowercase"] and cut and plain_bytes and not spec.get("post_processor")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """Whole texts to ids (u4 bytes) through the tokenizers library; runs seen before come from a bounded cache."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.by_piece = splits_by_piece(tokenizer_path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.names, self.sizes, self.values = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")
        if self.by_piece:
            self.merge = self.tokenizer.model.tokenize
            self.letters = byte_letters()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a lower-cased piece: of the tokenizer's steps, only the merges are left to do."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _learned(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without white space."""
        parts = [(r,) if r.isalpha() else tuple(_PIECES.findall(r)) for r in runs]
        ids = {p: self._piece(p) for p in {p for ps in parts for p in ps}}
        return [ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for ps in parts]

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        """Each distinct run of the texts is looked up once; a gather puts their ids in order. All but the unseen runs stay in Arrow and numpy."""
        low = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.large_string()), _LAST_MARK, "\\1 \\2\\3")
        runs = pc.ascii_split_whitespace(low)
        coded = runs.flatten().dictionary_encode()
        names = coded.dictionary
        found = pc.index_in(names, value_set=self.names)
        new = names.filter(found.is_null())
        learned = self._learned(new.to_pylist())
        more = np.array([len(x) for x in learned], np.int64) // 4
        values = np.concatenate((self.values, np.frombuffer(b"".join(learned), "<u4")))
        sizes = np.concatenate((self.sizes, more))
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.sizes) + np.arange(len(more))
        starts = np.cumsum(sizes) - sizes
        if len(self.sizes) < CACHE_RUNS:
            self.names, self.sizes, self.values = pa.concat_arrays([self.names, new]), sizes, values
        which = place[coded.indices.to_numpy(zero_copy_only=False)]
        n = sizes[which]
        ends = np.cumsum(n)
        flat = values[np.repeat(starts[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))))].tolist()
        return [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_piece and "<|" not in t and _PLAIN.fullmatch(t)]
        other = sorted({*range(len(texts))} - {*plain})
        for places, f in ((plain, self._by_runs), (other, self._encode)):
            if places:
                for i, ids in zip(places, f([texts[i] for i in places])):
                    out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    return kept(f"tokens {path}", lambda: Encoder(path))


def _put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a repeated or killed attempt never leaves half a file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def open_shard(uri: str) -> Shard:
    """A shard file, read from where it is: blocks are fetched when rank, select or access touch them."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)
    return Shard.open(lambda at, size: f.read_at(size, at))


def _get(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def _writer(folder: str, tokenizer_path: str, end_id: int, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        bits = max(1, int(max(enc.vocabulary - 1, end_id)).bit_length())
        tail = array.array("I", [end_id]).tobytes()
        ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        total = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, held, total, seq
            tokens = np.frombuffer(b"".join(held), "<u4")
            name = f"part-{part:06d}-{seq:05d}.wm"
            _put(folder, name, Shard(WaveletMatrix.build(tokens, bits), ids, np.array(lengths, np.int64)).to_bytes())
            row = {"part": [part], "seq": [seq], "path": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [total]}
            ids, lengths, held, total, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=_MANIFEST)

        for b in slices(batches, chars=ENCODE_CHARS):
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                ids.append(doc_id)
                lengths.append(len(data) // 4 + 1)
                held += (data, tail)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    return write


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text)`` and write the shard files; return their manifest.

    Files follow ascending doc_id (null first, equal ids by a hash of the
    text). A null or empty text holds the end id only. An empty table writes no
    file. The manifest has part, seq, path, n_docs, n_tokens and start, the
    number of ids in all files before.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    # The text's hash makes the order total and lets a range end between rows of one id.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = table(rows.mapInArrow(_writer(folder, tokenizer_path, end_id, shard_tokens), "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))  # a row per partition
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("before")


def _read(end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = _get(path)
            shard = Shard.open(lambda at, size, data=data: data[at : at + size], held=1 << 30)
            ids = shard.matrix.decode().astype("<u4")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            marks = shard.matrix.counts(end_id, starts, ends)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array(marks)],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids"],
            )


def read_digests(manifest: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Read every shard file back: doc_id, start, n_tokens, ids_crc32 and n_end_ids per document, a task per few files.

    ``n_end_ids`` is how often the end id occurs in the document, its own end
    included, counted by rank. A document without text has one id. Rows of the
    written table come back one for one, equal ones too; no file gives no row.
    """
    files = manifest.select("path", "start")
    n = max(1, min(files.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(lambda it: _read(end_id, it), "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")
