"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontam, extraction, langid, lm, packing, quality, sharding, simhash, topk, toxicity, urlfilter
from .common import table

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

TOKENIZERS = "/opt/tokenizers"


def tokenizer_files(folder: str = TOKENIZERS) -> tuple[str, str]:
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("matches")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("text")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *tokenizer_files())[0]


QUERIES = {
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op3_decontam": op3_decontam,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_urlfilter": op6_urlfilter,
    "op7_extraction": op7_extraction,
    "op8_sharding": op8_sharding,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
    "op11_conversations": op11_conversations,
    "op12_quality": op12_quality,
    "op13_alignment": op13_alignment,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL = {
    "op1_topk": """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_decontam": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item,
  regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT b, item, oi, least(len(w), 13) AS n, array_to_string(w[oi:oi + 12], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(oi) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, o, n, array_to_string(w[o:o + n - 1], ' ') AS win
  FROM d, n, unnest(range(1, len(w) - n + 2)) AS t(o) WHERE len(w) >= n),
hit AS (SELECT r, o, iw.n, item, b, oi FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(o, o + n)) AS t(p) GROUP BY r),
runs AS (SELECT r, n, o - row_number() OVER (PARTITION BY r, b, o - oi ORDER BY o) AS run, b, o - oi AS apart FROM hit),
far AS (SELECT r, max(m) AS longest FROM (SELECT r, n + count(*) - 1 AS m FROM runs GROUP BY r, n, b, apart, run) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN far USING (r)
""".replace("{UPPER}", urlfilter.UPPER).replace("{LOWER}", urlfilter.LOWER),
    "op6_urlfilter": f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
u AS (SELECT row_number() OVER () AS id, page_id, url,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
    '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hit AS (SELECT id, rhost || rpath AS rule, rverdict,
  row_number() OVER (PARTITION BY id ORDER BY length(rhost || rpath) DESC, rverdict DESC) AS n
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, url, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM hit WHERE n = 1) USING (id)
""",
    "op12_quality": quality.oracle_sql(),
    "op11_conversations": conversations.oracle_sql(),
}
