"""Registered queries of the operators, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    language, licenses, line_dedup, packing, pieces, quality_model, quality_rules, runs, simhash, top_k, toxicity,
    url_filter, whitening,
)
from .common import table
from .quality_rules import bound, words_of

#: (verdict, host, path), the production rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.search(table(spark, folder, "embeddings"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(table(spark, folder, "documents"), keep_ids=False))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES)


def op8_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, removed="removed_lines").drop("source")


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = pieces.decode(pieces.encode(docs))
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )


def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"].cast("bigint"))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def _made_periodic(text, doc_id):
    """The text of every tenth id with a repeated tail, as the contract plants it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(
            F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " "))

    return F.when(h % 10 == 0, bound(words_of(text), planted)).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents' words after the contract's change, the greatest one, and digests of all."""
    changed = docs.select("doc_id", _made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    greatest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ends = F.when(F.size("runs") > 0, F.lit("\n")).otherwise("")
    found = runs.detect(changed).withColumn("best", greatest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), ends), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=32, scale=64.0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_language, op3_simhash, op4_quality_rules, op5_packing, op6_toxicity, op7_url_filter,
        op8_quality_model, op9_line_dedup, op10_pieces, op11_licenses, op12_runs, op13_whitening,
    )
}



def _license_sql() -> str:
    """All entries at all places, without an index."""
    entries = [*licenses.PHRASES, *licenses.NOTICES]
    notices = ", ".join(f"({n}, '{e.label}', {e.base}, {len(e.words)})" for n, e in enumerate(entries))
    words = ", ".join(f"({n}, {at}, '{w}')" for n, e in enumerate(entries) for at, w in enumerate(e.words))
    keys = ", ".join(f"({n}, {at}, '{w}')" for n, e in enumerate(entries) for at, w in e.key_words())
    return rf"""WITH e(entry, label, base, size) AS (VALUES {notices}),
w(entry, spot, word) AS (VALUES {words}),
k(entry, spot, word) AS (VALUES {keys}),
n AS (SELECT entry, count(*) AS keys FROM k GROUP BY 1),
d AS (
 SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
h AS (
 SELECT p.rid, k.entry, p.place - k.spot AS start FROM p JOIN k ON p.word = k.word JOIN n ON n.entry = k.entry
 GROUP BY ALL HAVING count(*) = any_value(n.keys)),
s AS (
 SELECT h.rid, h.entry, h.start, count(p.word) / any_value(e.size) AS share FROM h JOIN e ON e.entry = h.entry
 JOIN w ON w.entry = h.entry LEFT JOIN p ON p.rid = h.rid AND p.place = h.start + w.spot AND p.word = w.word GROUP BY 1, 2, 3),
g AS (
 SELECT s.rid, count(*) FILTER (e.base) AS n_base, min(s.start) FILTER (e.base) AS first_word,
  max(s.start) FILTER (e.base) AS last_word, string_agg(DISTINCT e.label, ',' ORDER BY e.label) FILTER (e.base) AS base_labels,
  string_agg(DISTINCT e.label, ',' ORDER BY e.label) FILTER (e.base OR s.share >= {licenses.MIN_SHARE}) AS labels,
  max(s.share) FILTER (NOT e.base) AS score FROM s JOIN e ON e.entry = s.entry GROUP BY 1)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word,
 coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0.0E0) AS score
FROM d LEFT JOIN g ON g.rid = d.rid"""


SQL = {
    "op1_top_k": """WITH v AS (
 SELECT CAST(vec_id AS BIGINT) AS vec_id,
  min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS vec
 FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 GROUP BY 1),
e AS (SELECT vec_id, unnest(vec) AS x, unnest(range(len(vec))) AS at FROM v),
s AS (
 SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
 FROM e q JOIN e c ON q.at = c.at AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op7_url_filter": """WITH p AS (
 SELECT page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
 ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
 SELECT p.page_id, p.host, p.path, r.h || r.p AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h) DESC NULLS LAST, length(r.p) DESC) AS n
 FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
    "op9_line_dedup": r"""WITH l AS (
 SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
b AS (
 SELECT line, min(struct_pack(d := doc_id, p := place)) AS first FROM l
 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT l.*, b.line IS NOT NULL AND struct_pack(d := doc_id, p := place) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT d.doc_id,
 CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE NOT k.gone), '') END AS text,
 CAST(count(*) FILTER (WHERE k.gone) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text""",
    "op11_licenses": _license_sql(),
}
