"""Each operator against a brute-force version on a small fixture with nulls,
empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from canopy.llm import chat, chunks, decontaminate, ledger, mixing, neardup, phrases, repeats, sharding, wavelet
from canopy.llm.common import components
from canopy.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, tie int, at int, n long, start long, h long, w long, label long"


def prose(r, n, stems=("an", "the", "ti", "on", "re", "ou", "ha", "éa", "nd", "ing")):
    return " ".join("".join(r.choice(stems) for _ in range(r.randrange(1, 5))) for _ in range(n))


def fixture_rows():
    r = random.Random(5)
    base = prose(r, 150)
    passage = prose(r, 90)
    texts = [None, "", "   \n\t", "one", "two words", base, base, base + " x", prose(r, 40) + " " + passage, passage + " " + prose(r, 30), passage, "ab" * 900, "ab" * 600, "\U0001f600 " * 300, "Ça ς Σ İstanbul 's <|endoftext|> x́ 1²³"]
    for i in range(12):
        w = base.split()
        for _ in range(i // 3):
            w[r.randrange(len(w))] = f"w{r.randrange(99)}"
        texts.append(" ".join(w))
    line = prose(r, 9)
    texts.append("\n".join([line] * 6 + [prose(r, 60)]))
    texts.append("\n".join([line, prose(r, 100), line]))
    texts.append(prose(r, 4000))
    texts += [prose(r, r.randrange(5, 120)) for _ in range(30)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, texts[8], "fr", "s1", 1), (None, None, None, None, None), (3, "another text of the same id", "en", "s2", 1)]
    return [(*x, 1, 2, 3, 4, 5, 6, 7, 8, 9) for x in rows]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# ---------------------------------------------------------------- 1


def test_wavelet_rank_select_access():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (700, 9), (5000, 49408)):
        ids = r.integers(0, top, n)
        shard = wavelet.Shard.from_bytes(wavelet.Shard(wavelet.WaveletMatrix.build(ids, 16), [7], np.array([n])).to_bytes())
        m = shard.matrix
        assert (m.decode() == ids).all()
        for i in range(0, n, max(1, n // 50)):
            assert m.access(i) == ids[i]
        for t in {*ids[:5].tolist(), 3, 70000}:
            places = np.flatnonzero(ids == t)
            assert m.count(t) == len(places)
            assert m.count(t, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            for k in range(0, len(places), max(1, len(places) // 7)):
                assert m.select(t, k) == places[k]
    with pytest.raises(IndexError):
        m.select(70000, 0)
    assert m.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()


def test_tokens_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = wavelet.read_digests(wavelet.write_shards(docs, path, shard_tokens=3000)).collect()
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 1] for x in {r[1] for r in ROWS}}
    want = [(r[0], len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in ROWS]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [key((r.doc_id,)) for r in sorted(got, key=lambda r: r.start)] == sorted(key((r[0],)) for r in ROWS)
    assert wavelet.read_digests(wavelet.write_shards(empty, path)).count() == 0


# ---------------------------------------------------------------- 2


def test_slots(spark, docs, empty, tmp_path):
    got = sharding.place(docs, 5, 64).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS]
    same([(r.doc_id, r.size, r.text_crc32) for r in got], want)
    by, load = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.slot)
        load[r.vslot, r.shard] += r.size
        assert 0 <= r.shard < 5 and r.law == "bytes" and r.grown_shard is None and r.first_shard == r.vslot % 5
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    assert len({v for v, _ in load}) == len(load)  # a virtual slot is in one shard
    per = Counter()
    for (_, s), b in load.items():
        per[s] += b
    # No slot of the heaviest shard could move to the lightest and leave both nearer the mean.
    hi, lo = max(per, key=per.get), min(per, key=per.get)
    assert per[hi] - per[lo] <= max(0.002 * sum(per.values()), min(b for (_, s), b in load.items() if s == hi))
    assert sharding.place(empty, 4).count() == 0
    # A stored map that somebody edited places the rows.
    path = f"file://{tmp_path}/edited"
    sharding.store_map(sharding.initial_map(spark, 3, 64), path)
    sharding.store_map(spark.createDataFrame([(v, 1, 2) for v in range(64)], "vslot int, shard int, version int"), path)
    assert {r.shard for r in sharding.place(docs, 3, 64, path).collect()} == {1}
    assert sharding.latest_version(spark, path) == 2


def test_slots_of_many_rows_without_id(spark):
    rows = [(None, f"text {i}") for i in range(4000)] + [(None, "the same")] * 3000
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256).collect()
    by, size = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(got) == 7000
    # Equal rows are one record; the others are spread evenly beside it.
    rest = sorted(size.values())[:-1]
    assert rest[-1] <= 1.1 * rest[0]


def test_slot_map_grows_evenly_and_rebalances(spark, docs, tmp_path):
    m = sharding.initial_map(spark, 16, 4096)
    counts = Counter(r.shard for r in sharding.grow(m).collect())
    assert set(counts) == set(range(17)) and max(counts.values()) - min(counts.values()) <= 20
    again = sharding.grow(sharding.grow(m))
    assert {r.version for r in again.collect()} == {3}
    loads = spark.createDataFrame([(v, 1, 1000 if v % 16 == 3 else 10) for v in range(4096)], "vslot int, n_rows long, n_bytes long")
    moved = sharding.rebalance(m, loads).collect()
    size = Counter()
    for r in moved:
        size[r.shard] += 1000 if r.vslot % 16 == 3 else 10
    assert max(size.values()) <= 1.02 * sum(size.values()) / 16 + 1000 and len(moved) == 4096
    path = f"file://{tmp_path}/m"
    sharding.store_map(m, path)
    with pytest.raises(Exception, match="exists"):
        sharding.store_map(m, path)
    assert sharding.load_map(spark, path, 1).count() == 4096


# ---------------------------------------------------------------- 3, 8


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("p", [phrases.Parse(), phrases.Parse(60, 40), phrases.Parse(60, 40, group_rows=1), phrases.Parse(400, 300, group_rows=1)])
def test_prefix_free_parse(docs, empty, p):
    got = phrases.remove_repeats(docs, p).collect()
    want = [(r[0], *x) for r, x in zip(ROWS, brute_repeats([r[1] for r in ROWS], p.length))]
    same(got, want)
    assert phrases.remove_repeats(empty, p).count() == 0


def brute_passages(texts, short):
    return [x[1] for x in brute_repeats(texts, short)]


@pytest.mark.parametrize("p", [phrases.PASSAGES, phrases.Parse(60, 24, short=40), phrases.Parse(60, 24, group_rows=1, short=40), phrases.Parse(400, 216, group_rows=1, short=256)])
def test_short_passages_are_told_and_stay(docs, p):
    texts = [r[1] for r in ROWS]
    want = [(r[0], *x, n) for r, x, n in zip(ROWS, brute_repeats(texts, p.length), brute_passages(texts, p.short))]
    same(phrases.remove_repeats(docs, p).collect(), want)


def test_passages_of_over_50_words_are_told(spark):
    """Passages under 400 bytes, anywhere in a text and at its end, in texts that share nothing else."""
    r = random.Random(21)
    rows = []
    for i in range(24):
        passage = prose(r, 80).encode()[: 256 + 12 * (i % 13)].decode(errors="ignore")
        for j in range(2):
            rows.append((2 * i + j, prose(r, r.randrange(0, 90)) + " " + passage + ("" if i % 3 == j else " " + prose(r, r.randrange(1, 90)))))
    rows += [(100 + i, prose(r, 200)) for i in range(10)] + [(200, passage), (201, ("xyz" * 90)[:256]), (202, ("xyz" * 90)[:258])]
    texts = [t for _, t in rows]
    want = [(i, *x, n) for (i, _), x, n in zip(rows, brute_repeats(texts, 400), brute_passages(texts, 256))]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), phrases.PASSAGES).collect()
    same(got, want)
    assert all(x.n_repeated >= 255 for x in got if x.doc_id < 48) and not any(x.n_repeated for x in got if 100 <= x.doc_id < 200)
    assert sum(x.n_removed == 0 < x.n_repeated for x in got) > 30


def test_texts_of_one_id_are_told_apart(spark):
    from pyspark.sql import functions as F

    r = random.Random(12)
    alone, copied = prose(r, 200), prose(r, 200)
    # Two texts whose hashes agree in their low 23 bits.
    ends = spark.range(20000).select(F.concat(F.lit(alone + " "), F.col("id").cast("string")).alias("a"), F.concat(F.lit(copied + " "), F.col("id").cast("string")).alias("b"))
    low = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23)).alias("low")
    pair = ends.select("a", low("a")).join(ends.select("b", low("b")), "low").orderBy("low").first()
    rows = [(None, pair.a), (None, pair.b), (1, pair.b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = phrases.Parse()
    same(phrases.remove_repeats(df, p).collect(), [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], p.length))])
    assert {(x.doc_id, x.n_bytes): x.n_removed for x in chunks.dedup(df).collect()} == {(None, len(pair.a.encode())): 0, (None, len(pair.b.encode())): len(pair.b.encode()), (1, len(pair.b.encode())): 0}


def test_repeated_starts_by_suffix_array():
    r = random.Random(2)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(30)]
    group = np.array([i % 3 for i in range(30)])
    for length in (3, 8, 13, 20):
        seen = Counter((i % 3, p[k : k + length]) for i, p in enumerate(parts) for k in range(len(p) - length + 1))
        for i, flags in enumerate(phrases.repeated_starts(parts, group, length)):
            assert flags.tolist() == [seen[i % 3, parts[i][k : k + length]] > 1 for k in range(max(0, len(parts[i]) - length + 1))]


def brute_chunks(rows, cuts):
    def ends(data):
        h, out, at = 0, [], 0
        mask = ((1 << cuts.mask_bits) - 1) << (24 - cuts.mask_bits)
        for i, b in enumerate(data):
            h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
            if len(data) - at <= cuts.min_bytes:
                break
            if i + 1 - at >= cuts.min_bytes and (h & mask == 0 or i + 1 - at == cuts.max_bytes):
                out.append(i + 1)
                at = i + 1
        if data and (not out or out[-1] != len(data)):
            out.append(len(data))
        return out

    texts = [(r[1] or "").encode() for r in rows]
    for d in texts:
        assert chunks.cut_points(d, cuts) == ends(d)
    # Rows equal in id and text are one occurrence.
    seen, gone = set(), {}
    for i, t in sorted({(2**63 - 1 if r[0] is None else r[0], t) for r, t in zip(rows, texts)}, key=lambda x: (x[0], signed_hash(x[1]))):
        cuts_ = ends(t)
        flags = bytearray(len(t))
        for a, b in zip([0, *cuts_], cuts_):
            if t[a:b] in seen:
                flags[a:b] = b"\1" * (b - a)
            seen.add(t[a:b])
        runs = [m.span() for m in re.finditer(b"\1+", bytes(flags)) if len(m[0]) >= cuts.min_run]
        gone[i, t] = runs
    out = []
    for r, t in zip(rows, texts):
        runs = gone[2**63 - 1 if r[0] is None else r[0], t]
        kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(t)]))
        out.append((r[0], len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def signed_hash(text):
    return HASHES[text]


HASHES: dict[bytes, int] = {}


@pytest.mark.parametrize("cuts", [chunks.Cuts(), chunks.Cuts(16, 128, 4, 40)])
def test_chunks(docs, empty, cuts):
    from pyspark.sql import functions as F

    HASHES.update({(r.text or "").encode(): r.h for r in docs.where("text is not null").select("text", F.xxhash64("text").alias("h")).collect()})
    HASHES.setdefault(b"", 0)
    got = chunks.dedup(docs, cuts).collect()
    same([x[:5] for x in got], brute_chunks(ROWS, cuts))
    for r in got:
        assert r.n_bytes - r.n_removed >= len(r.kept_text.encode())
        if r.n_removed == 0:
            assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
    assert chunks.dedup(empty, cuts).count() == 0


def test_chunks_resist_shifts():
    r = random.Random(3)
    data = prose(r, 3000).encode()
    cuts = chunks.Cuts()

    def pieces(d):
        ends = chunks.cut_points(d, cuts)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    a, b = pieces(data), pieces(data[:5000] + b"inserted words " + data[5000:])
    assert len(a & b) > 0.97 * len(a)


def test_chunks_find_short_passages(spark):
    r = random.Random(13)
    rows, share = [(10_000 + i, prose(r, 160)) for i in range(100)], []
    for i in range(150):
        passage = prose(r, 50 + i % 11)
        rows += [(2 * i + k, f"{prose(r, 80)} {passage} {prose(r, 80)}") for k in (0, 1)]
        share.append(len(passage.encode()))
    got = {x.doc_id: x.n_removed for x in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[2 * i] for i in range(150)) and not any(got[10_000 + i] for i in range(100))
    found = [got[2 * i + 1] / n for i, n in enumerate(share)]
    assert sum(x == 0 for x in found) <= 8 and sum(found) > 0.65 * 150


# ---------------------------------------------------------------- 4


def brute_cost(roles, costs):
    """The cheapest legal sequence by trying, for each turn, every role, a merge, and up to two empty turns before it; nothing is taken from the module but the three costs."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {1: "s", 2: "u", 3: "a"}

    def inserted(state, most=3):
        todo, out = [(state, 0)], {}
        while todo:
            s, n = todo.pop(0)
            if s not in out:
                out[s] = n
                if n < most:
                    todo += [(q, n + 1) for q in after[s]]
        return out

    best = {"": 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for q in "sua":
                change = costs.relabel * (q != names.get(r))
                if s == q:
                    new[q] = min(new.get(q, 1 << 30), c + costs.merge + change)
                for mid, n in inserted(s).items():
                    if q in after[mid]:
                        new[q] = min(new.get(q, 1 << 30), c + change + costs.insert * n)
        best = new
    return min(c + costs.insert * inserted(s)["a"] for s, c in best.items())


TEXT = r"(?:(?!<\|im_)[^\0])*"
LEGAL = re.compile(rf"(?:<\|im_start\|>system\n{TEXT}<\|im_end\|>\n)?(?:<\|im_start\|>user\n{TEXT}<\|im_end\|>\n<\|im_start\|>assistant\n{TEXT}<\|im_end\|>\n)+")


def test_role_repair(spark):
    r = random.Random(4)
    rows = [(c, i, r.choice(["user", "assistant", "system", "User ", "tool", None]), f"t{c}.{i}") for c in range(60) for i in range(r.randrange(1, 9))]
    rows += [(99, i, r.choice(["user", "assistant", "system", "tool"]), f"x{i}") for i in range(700)]  # over several blocks
    rows += [(100, 0, "user", None), (None, 0, "assistant", ""), (None, None, "user", "<x"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    rows = [(*x, 1, 2) for x in rows]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int, tie int")
    costs = chat.Costs()
    outs = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        outs.append(chat.repair(turns, costs).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same(*outs)
    by = defaultdict(list)
    for x in outs[1]:
        by[x.conv_id].append(x)
    assert len(outs[1]) == len(rows)
    whole = {x.conv_id: x.text for x in chat.whole_texts(chat.repair(turns, costs)).collect()}
    parted = defaultdict(str)
    for x in sorted(chat.whole_texts(chat.repair(turns, costs), 3).collect(), key=lambda x: x.part):
        parted[x.conv_id] += x.text
    assert parted == whole
    for c, xs in by.items():
        xs.sort(key=lambda x: x.ordinal)
        assert [x.ordinal for x in xs] == list(range(len(xs)))
        assert [(x.turn is not None, x.turn or 0, x.role is not None, x.role or "") for x in xs] == sorted((x.turn is not None, x.turn or 0, x.role is not None, x.role or "") for x in xs)
        assert whole[c] == "".join(x.rendered for x in xs) and LEGAL.fullmatch(whole[c]), c
        spent = sum(costs.merge * ("merge" in x.action) + costs.relabel * ("relabel" in x.action) + costs.insert * len([v for v in (x.inserted + "," + x.appended).split(",") if v]) for x in xs)
        assert spent == brute_cost([chat.role_state(x.role) for x in xs], costs)
    assert chat.repair(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def brute_longest(ws):
    best = [0] * len(ws)
    for i in range(len(ws)):
        for j in range(len(ws)):
            k = 0
            while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats():
    r = random.Random(6)
    texts = [[r.choice("abc") for _ in range(r.randrange(0, 50))] for _ in range(40)] + [["a"] * 33]
    keys = np.array([ord(w) for t in texts for w in t])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert repeats.longest_repeats(keys, text).tolist() == [x for t in texts for x in brute_longest(t)]


def test_quality(docs, empty):
    def verdict(t):
        ws = WORD.findall(t or "")
        longest = brute_longest(ws) if len(ws) < 500 else [0] * len(ws)

        def cover(m):
            return len({j for i, k in enumerate(longest) if k >= m for j in range(i, i + k)})

        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        base = len(ws) < 10 or 100 * cover(5) > 20 * len(ws)
        kept = not base and 100 * cover(8) <= 20 * len(ws) and max(longest) <= 60
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), cover(5), base, kept, cover(8), max(longest, default=0)

    got = [r for r in repeats.quality(docs).collect() if r.n_words < 500]
    same(got, [(r[0], *verdict(r[1])) for r in ROWS if len(WORD.findall(r[1] or "")) < 500])
    good = repeats.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in repeats.quality(docs).collect())
    assert repeats.quality(empty).count() == 0


# ---------------------------------------------------------------- 6


def test_ledger(spark, docs, empty, tmp_path):
    import public_tokenizers as P

    counts = ledger.count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN, "v1").cache()
    enc = ledger._encoding(vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {(r.doc_id, r.n_tokens) for r in counts.collect()} == {(r[0], len(enc.encode_ordinary(r[1] or ""))) for r in ROWS}
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")

    def total(df):
        t = defaultdict(lambda: [0, 0])
        for r in df.collect():
            t[r.source, r.lang, r.tokenizer][0] += 1
            t[r.source, r.lang, r.tokenizer][1] += r.n_tokens
        return [(*k, *v) for k, v in t.items()]

    assert book.totals().count() == 0
    assert book.commit(1, ledger.inserts(counts)) and not book.commit(1, ledger.inserts(counts))
    same(book.totals().collect(), total(counts))
    revised = counts.where("doc_id IS NULL OR doc_id % 5 <> 0").selectExpr("doc_id", "source", "lang", "CASE WHEN doc_id < 9 THEN n_tokens + 3 ELSE n_tokens END n_tokens", "CASE WHEN doc_id < 20 THEN 'v2' ELSE tokenizer END tokenizer")
    assert book.commit(2, ledger.changes(counts, revised))
    same(book.totals().collect(), total(revised))
    book.compact()
    same(book.totals().collect(), total(revised))
    assert not book.commit(2, ledger.inserts(counts))
    assert book.commit(3, ledger.deletes(revised))
    assert book.totals().count() == 0
    assert book.commit(4, ledger.inserts(ledger.count_tokens(empty, vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN, "v1")))


def test_ledger_refuses_a_late_batch(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/late")
    signed = spark.createDataFrame([("s", "en", "v1", 1, 7)], ledger.DELTA)
    assert book.commit(4, signed)
    book.compact()
    assert not book.commit(4, signed)
    with pytest.raises(ValueError):
        book.commit(3, signed)
    assert book.commit(5, signed)
    assert [r.n_tokens for r in book.totals().collect()] == [14]


# ---------------------------------------------------------------- 7


def brute_components(rows, size, num=80, den=100):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        ws = WORD.findall((r[1] or "").translate(low))
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and den * len(a & b) >= num * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return [(r[0], len(s), r[0] if r[0] is None or not s else find(r[0]), r[0] is None or not s or find(r[0]) == r[0]) for r, s in zip(rows, sets)]


@pytest.mark.parametrize("near", [neardup.Near(), neardup.Near(words=5), neardup.Near(block=4)])
def test_near_duplicates(docs, empty, near):
    same(neardup.near_duplicates(docs, near).collect(), brute_components(ROWS, near.words))
    assert neardup.near_duplicates(empty, near).count() == 0
    kept = neardup.keep_first(docs, near)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("near", [neardup.Near(block=32), neardup.Near(block=5), neardup.Near(block_bytes=9000)])
def test_near_duplicates_of_a_large_group(spark, near):
    r = random.Random(8)
    base = prose(r, 80).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(neardup.near_duplicates(df, near).collect(), brute_components(rows, 4))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)] + [(3000, 3001 + i) for i in range(300)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(6))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for x in list(parent)}
    assert got.count() == len(parent)


def test_thresholds_keep_true_pairs():
    for n, least in neardup.least_matches(308, 44, 0.8, 1e-7):
        assert 0 < least < 0.8 * n


# ---------------------------------------------------------------- 9


def brute_leaks(rows, items, m):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: WORD.findall((t or "").translate(low))
    gram = lambda ws, k: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    its = [(i, ws, min(m.words, len(ws))) for i, t in items if (ws := words(t))]
    df = Counter(g for _, ws, k in its for g in set(gram(ws, k)))
    w = lambda g: 1000 // max(1, df[g])
    out = set()
    for r in rows:
        ws = words(r[1])
        for i, iw, k in its:
            a, best = Counter(gram(iw, k)), 0
            for s in range(max(1, len(ws) - len(iw) + 1)):
                b = Counter(gram(ws[s : s + len(iw)], k))
                both = sum((w(g) * min(c, b[g])) for g, c in a.items())
                shared, own, held, weight = (a & b).total(), a.total(), b.total(), sum(w(g) * c for g, c in a.items())
                best = max(best, shared / (own + held - shared), both * own / (weight * (own + held - shared)))
            if 100 * best >= m.percent - 1e-9:
                out.add((r[0], i))
    return out


def test_decontamination(spark, docs, empty):
    r = random.Random(10)
    items = [(i, prose(r, n)) for i, n in enumerate((20, 31, 50, 16, 3, 1, 24))] + [(7, None), (8, " \n"), (2, "a second text of one id that is here too")]
    items.append((9, items[0][1] + " " + prose(r, 60)))
    rows = [x[:2] for x in ROWS]
    for i, t in items[:7]:
        ws = t.split()
        rows.append((200 + i, prose(r, 30) + " " + t + " " + prose(r, 25)))
        rows.append((300 + i, t.upper() if i % 2 else t))
        near = list(ws)
        near[-1] = "zz"
        rows.append((400 + i, prose(r, 12) + " " + " ".join(near) + " " + prose(r, 9)))
        rows.append((500 + i, prose(r, 12) + " " + " ".join(ws[: len(ws) // 2]) + " " + prose(r, 9)))
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, item_id long, similarity int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, h int")
    m = decontaminate.Match()
    got = decontaminate.leaks(df, bench, m)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == brute_leaks(rows, items, m)
    bad = {d for d, _ in brute_leaks(rows, items, m)}
    assert {x.doc_id for x in decontaminate.keep_clean(df, bench, m).collect()} == {x[0] for x in rows} - bad
    assert decontaminate.leaks(empty, bench, m).count() == 0
    assert decontaminate.leaks(df, bench.limit(0), m).count() == 0


def test_decontamination_of_items_that_share_text(spark):
    r = random.Random(14)
    twice, passage = prose(r, 60), prose(r, 200)
    items = [(1, twice), (2, twice)] + [(10 + i, passage + " " + prose(r, 15)) for i in range(10)]
    rows = []
    for i, t in items:
        ws = t.split()
        for at in (30,) if i < 10 else (60, 130):
            ws[at] = "edited"
        rows.append((100 + i, prose(r, 20) + " " + " ".join(ws) + " " + prose(r, 20)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(101, 1), (101, 2), (102, 1), (102, 2), *((100 + i, i) for i in range(10, 20))}
    assert want <= set(got)
    # 51 of 61 shingles; 201 of 221, more by weight, as the edits are in what the items share.
    assert got[101, 2] == pytest.approx(51 / 61) and 201 / 221 < got[110, 10] < 1
    assert set(got) == brute_leaks(rows, items, decontaminate.Match())


# ---------------------------------------------------------------- 10


def test_mix(spark, docs, empty):
    from fractions import Fraction

    size = [len(WORD.findall(r[1] or "")) for r in ROWS]
    per = Counter()
    for r, s in zip(ROWS, size):
        per[r[3]] += s
    names = sorted((x for x in per if x is not None)) + [None] * (None in per)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(per.values()), set()
    while True:
        rest = total - sum(3 * per[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and Fraction(weight[s] * rest, free) > 3 * per[s]}
        if not over:
            break
        stopped |= over
    target = {s: 3.0 * per[s] if s in stopped else float(Fraction(weight[s] * rest, free)) for s in names}
    got = mixing.planned(docs).collect()
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-12) and r.source_size == per[r.source]
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3 and r.taken == r.size * r.copies
    same([(r.doc_id, r.size) for r in got], [(r[0], s) for r, s in zip(ROWS, size)])
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0
    many = spark.range(20000).selectExpr("id doc_id", "'a b c' text", "CASE WHEN id < 15000 THEN 'a' ELSE 'b' END source")
    no_ids = spark.range(20000).selectExpr("CAST(NULL AS long) doc_id", "concat('a b c', id) text", "CASE WHEN id < 15000 THEN 'a' ELSE 'b' END source")
    for df in (many, no_ids):
        for r in mixing.planned(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
            assert abs(r["sum(taken)"] - r["max(target)"]) < 0.03 * r["max(target)"]


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 77, 78, 79, 80, i) for i in range(50)], "doc_id long, text string, source string, named int, total int, target int, copy int, `a.b` long")
    out = mixing.mix(df)
    assert out.columns == df.columns and {(r.named, r.total, r.target, r.copy) for r in out.collect()} == {(77, 78, 79, 80)}


# ---------------------------------------------------------------- all


def test_a_text_beyond_a_batch(spark):
    """One text over the batch bound beside small ones, an exact copy of it, and its ends alone."""
    from tokenizers import Tokenizer

    r = random.Random(21)
    long = " ".join(prose(r, 500) for _ in range(900))
    assert len(long) > 2_000_000
    rows = [(1, long, "s"), (2, long, "s"), (3, long[:900], "s"), (4, prose(r, 80), "t"), (5, long[-900:], "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {x.doc_id: x for x in wavelet.read_digests(wavelet.write_shards(df, vocabulary("word_bpe_49k.json"))).collect()}
    for i, text, _ in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].n_end_ids) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(1))
    assert sum(x.size for x in sharding.place(df, 2).collect()) == sum(len(x[1].encode()) + 1 for x in rows)
    assert {x.doc_id: x.n_bytes - x.n_removed for x in phrases.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: len(rows[3][1].encode()), 5: 0}
    assert {x.doc_id: x.n_words for x in repeats.quality(df).collect()} == {i: len(WORD.findall(x)) for i, x, _ in rows}
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {x.doc_id: (x.n_removed, x.n_bytes) for x in chunks.dedup(df).collect()}
    assert cut[1][0] == 0 and cut[2][0] == cut[2][1] and cut[4][0] == 0 and cut[5][0] > 500
    bench = spark.createDataFrame([(7, " ".join(long.split()[-60:-20]))], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()} == {(1, 7), (2, 7), (5, 7)}
    assert {x.doc_id: x.size for x in mixing.planned(df).collect()} == {i: len(WORD.findall(x)) for i, x, _ in rows}
    turns = spark.createDataFrame([(1, 0, "user", long)], "conv_id long, turn long, role string, text string")
    assert chat.whole_texts(chat.repair(turns)).first().text == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_shards_are_read_in_place(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    files = wavelet.write_shards(docs, path, shard_tokens=100_000).orderBy("start").collect()
    by_id = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ROWS}
    ids = []
    for f in files:
        shard = wavelet.open_shard(f.path)
        mine = [shard.matrix.access(i) for i in range(0, shard.matrix.n, 17)]
        at = np.cumsum(shard.lengths) - shard.lengths
        for d, a, n in zip(shard.doc_ids, at.tolist(), shard.lengths.tolist()):
            if d not in (None, 3):
                assert [shard.matrix.access(a + k) for k in (0, n - 1)] == [by_id[d][0], 1] and n == len(by_id[d])
        ids += mine
    assert len(ids) > 100


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage on what its predecessor kept, held against the brute-force versions."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "near dedup", "benchmark decontamination", "mixing", "token output"]
    rows = docs
    quality = {(r.doc_id, r.kept) for r in repeats.quality(docs).collect()}
    kept = cp.quality_rules(spark, rows, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in quality if k}
    after = cp.near_dedup(spark, kept, sf)
    held = [tuple(r) for r in kept.collect()]
    want = {i for i, _, _, k in brute_components(held, 5) if k}
    assert {r.doc_id for r in after.collect()} == want
    assert {r.doc_id for r in cp.benchmark_decontamination(spark, after, sf).collect()} == want  # the fixture holds no item
    mixed = cp.source_mixing(spark, after, sf)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.planned(after).collect())
    assert cp.token_output(spark, mixed, sf).count() == mixed.count()
    assert cp.near_dedup(spark, cp.quality_rules(spark, docs.limit(0), sf), sf).count() == 0


def test_sql_of_the_queries(spark):
    import duckdb

    from canopy.llm import queries as q

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        got = q.queries()[name](spark, sf)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(want.columns)
        same(got.select(*cols).collect(), want.select(*[f'"{c}"' for c in cols]).fetchall())
