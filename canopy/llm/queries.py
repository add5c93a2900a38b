"""The registered queries of the corpus operators, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import new_dir, shared_dir, small_batches, table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.wavelet import read_digests, write_shards

    return read_digests(write_shards(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.sharding import place

    return place(read(spark, sf_dir, "documents"), 16)


def op3_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.phrases import PASSAGES, remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), PASSAGES)


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.chat import repair

    return repair(read(spark, sf_dir, "conversations"))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.repeats import quality

    return quality(read(spark, sf_dir, "documents"))


def op6_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: every document counted; all but the English ones counted anew with a multilingual vocabulary; those without tokens taken out."""
    import public_tokenizers

    from canopy.llm.ledger import Ledger, changes, count_tokens, deletes, inserts

    docs = read(spark, sf_dir, "documents")
    first = table(count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k"), "counts")
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    second = table(count_tokens(docs.where(foreign), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_multi_50k"), "counts")
    now = first.where(~foreign).unionByName(second)
    ledger = Ledger(spark, new_dir(spark, "ledger"))
    for _ in range(2):  # a replayed batch changes nothing and isn't computed
        ledger.commit(0, inserts(first))
        ledger.commit(1, changes(first.where(foreign), second))
        ledger.commit(2, deletes(now.where("n_tokens = 0")))
    ledger.compact()
    return ledger.totals()


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.chunks import dedup

    return dedup(read(spark, sf_dir, "documents"))


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tie")


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from canopy.llm.mixing import planned

    return planned(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_wavelet_tokens,
            op2_virtual_slots,
            op3_prefix_free_parse,
            op4_role_repair,
            op5_suffix_repetition,
            op6_token_ledger,
            op7_bayes_minhash,
            op8_gear_chunks,
            op9_simhash_decontamination,
            op10_weighted_mix,
        )
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i,
        string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g5,
        string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g8,
        max(i) OVER (PARTITION BY r) AS n
      FROM w),
f AS (SELECT r, i,
        i + 4 <= n AND count(*) OVER (PARTITION BY r, g5, i + 4 <= n) > 1 AS f5,
        i + 7 <= n AND count(*) OVER (PARTITION BY r, g8, i + 7 <= n) > 1 AS f8
      FROM g),
c AS (SELECT r,
        max(f5) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
        max(f8) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
      FROM f),
s AS (SELECT r, sum(c5::INT)::BIGINT AS n5, sum(c8::INT)::BIGINT AS n8 FROM c GROUP BY r),
-- each round keeps the starts whose next longer substring occurs again in the text
p(len, r, i, c) AS (
  SELECT 1::BIGINT, r, i, c FROM (SELECT r, i, dense_rank() OVER (ORDER BY r, w) AS c, count(*) OVER (PARTITION BY r, w) AS k FROM w) WHERE k > 1
  UNION ALL
  SELECT len + 1, r, i, c FROM (
    SELECT p.len, p.r, p.i, dense_rank() OVER (ORDER BY p.r, p.c, w.w) AS c, count(*) OVER (PARTITION BY p.r, p.c, w.w) AS k
    FROM p JOIN w ON w.r = p.r AND w.i = p.i + p.len) WHERE k > 1),
longest AS (SELECT r, max(len) AS longest FROM p GROUP BY r),
l AS (SELECT r, sum(n - 1)::BIGINT AS dup FROM
        (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
x AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words,
        coalesce(n8, 0)::BIGINT AS n_covered, coalesce(longest, 0)::BIGINT AS longest_repeat
      FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN longest USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
"""

ORACLES = {
    "op5_suffix_repetition": OP5
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND 100 * n_covered <= 20 * n_words AND longest_repeat <= 60 AS kept, n_covered, longest_repeat FROM b""",
    "op7_bayes_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.low AS component_id, d.doc_id = m.low AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id""",
    "op10_weighted_mix": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS own FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS z, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS w FROM d GROUP BY source),
-- each round stops the sources whose share of the rest is above three times their size
k(round, source, z, w, stopped, more) AS (
  SELECT 0, source, z, w, false, true FROM p
  UNION ALL
  SELECT round + 1, source, z, w, stopped OR over, bool_or(over AND NOT stopped) OVER () FROM (
    SELECT *, w::HUGEINT * (sum(z) OVER () - sum(CASE WHEN stopped THEN 3 * z ELSE 0 END) OVER ()) > 3 * z::HUGEINT * (sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ()) AS over FROM k WHERE more)),
f AS (SELECT source, z, w, stopped FROM k WHERE round = (SELECT max(round) FROM k)),
t AS (SELECT source, z, CASE WHEN stopped THEN (3 * z)::DOUBLE ELSE (w * (sum(z) OVER () - sum(CASE WHEN stopped THEN 3 * z ELSE 0 END) OVER ()))::DOUBLE / (sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
r AS (SELECT doc_id, size, z, target, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0:' || own), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
