"""Named queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelens.llm.op01_toxicity import fit_toxicity, score_toxicity
from choicelens.llm.op02_repetition import repetition_rules
from choicelens.llm.op03_simhash import near_duplicates
from choicelens.llm.op04_quality import fit_quality, score_quality
from choicelens.llm.op05_token_files import token_files
from choicelens.llm.op06_shards import shuffle_into_shards
from choicelens.llm.op07_mixing import mix, positions
from choicelens.llm.op08_packing import pack_documents
from choicelens.llm.op09_topk import topk_inner_product
from choicelens.llm.op10_substrings import remove_repeats
from choicelens.llm.op11_divergence import source_divergence
from choicelens.llm.op12_alignment import MEASURES, align_tokenizers
from choicelens.llm.op13_lines import drop_repeated_lines

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the same result in DuckDB SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_noisy_channel_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document after deobfuscation."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op2_suffix_repetition")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rule and repetition verdict of every document."""
    return repetition_rules(table(spark, sf_dir, "documents"))


@query("op3_ball_hashing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_additive_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the additive model."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op5_ranked_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    back = token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, drops_space=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_hypergeometric_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shuffle_into_shards(docs, 8, ["doc_id"])
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


@query("op7_poisson_mixing", """
WITH d AS (
  SELECT doc_id, text, source, coalesce('=' || source, 'null') AS s FROM documents),
sums AS (
  SELECT s, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS DOUBLE) AS size FROM d GROUP BY s),
w AS (SELECT s, size, pow(size, 0.5) AS weight FROM sums),
r AS (
  SELECT s, weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size AS mean FROM w),
p AS (SELECT s, mean, greatest(1, CAST(ceil(mean / 8.0) AS INTEGER)) AS parts FROM r),
parted AS (
  SELECT d.*, p.mean / p.parts AS m, CAST(unnest(range(p.parts)) AS INTEGER) AS part FROM d JOIN p USING (s)),
drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(part AS VARCHAR)), 1, 12)
                 AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM parted),
cdf AS (
  SELECT s, m, k, sum(exp(-m) * pow(m, k) / gamma(k + 1)) OVER (PARTITION BY s ORDER BY k) AS c
  FROM (SELECT s, mean / parts AS m FROM p), (SELECT CAST(unnest(range(65)) AS DOUBLE) AS k)),
counted AS (
  SELECT x.doc_id, x.source, x.text, x.part, (SELECT count(*) FROM cdf WHERE cdf.s = x.s AND cdf.c <= x.u) AS n FROM drawn x),
copies AS (
  SELECT doc_id, source, text, part, CAST(unnest(range(n)) AS INTEGER) AS copy FROM counted),
keyed AS (
  SELECT *, md5('17s|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(part AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS key
  FROM copies)
SELECT doc_id, source, part, copy, row_number() OVER (ORDER BY key) - 1 AS position, md5(coalesce(text, '')) AS text_md5
FROM keyed
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of the documents at square-root source weights, in shuffled order."""
    copies = positions(mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), alpha=0.5, seed=17))
    return copies.select("doc_id", "source", "part", "copy", F.col("position").cast("long"),
                         F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@query("op8_configuration_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op9_columnar_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of every vector whose id is divisible by 50."""
    return topk_inner_product(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op10_previous_factors", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k
      FROM (SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 49))) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
hit AS (SELECT doc_id, i FROM w JOIN m USING (k) WHERE first < doc_id),
turn AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM turn),
span AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, span),
gap AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT g.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
               string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
        FROM gap g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier ones."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op11_source_divergence", r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row FROM d),
t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM numbered),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
size AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (
  SELECT g.lang, g.source, CAST(coalesce(sum(n.n), 0) AS HUGEINT) AS total
  FROM g LEFT JOIN n ON g.lang = n.lang AND g.source = n.source GROUP BY g.lang, g.source),
rates AS (
  SELECT total.lang, total.source, v.term, coalesce(n.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (total.total + 2 * size.v) AS p
  FROM total JOIN v ON total.lang = v.lang JOIN size ON size.lang = total.lang
  LEFT JOIN n ON n.lang = total.lang AND n.source = total.source AND n.term = v.term),
n_lang AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
q_lang AS (
  SELECT n_lang.lang, n_lang.term, 1 + (1000000000::HUGEINT * (n_lang.n + 2)) // (s.total + 2 * size.v) AS q
  FROM n_lang JOIN size ON n_lang.lang = size.lang
  JOIN (SELECT lang, CAST(sum(n) AS HUGEINT) AS total FROM n GROUP BY lang) s ON s.lang = n_lang.lang),
term AS (
  SELECT r.lang, r.source, 'term' AS part, r.term AS item, CAST(((r.p - q.q) * (r.p - q.q)) // (r.p + q.q) AS BIGINT) AS value
  FROM rates r JOIN q_lang q ON r.lang = q.lang AND r.term = q.term WHERE r.n > 0 AND r.p > q.q),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and each group's ten most typical terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_tokenizers(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", *MEASURES, "groups_sha256")


@query("op13_line_filters", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
