"""The library's inputs, bound to the given tables: a typed usage log, its dimensions and its rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 6)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def usage_log(events: DataFrame) -> DataFrame:
    """A typed request log from ``events``: who called what, when, at what cost. Missing keys become ''."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.coalesce(as_text("user_id"), F.lit(""))
    text = lambda prefix, n: F.concat(F.lit(prefix), (n).cast("string"))
    return events.select(
        as_text("event_id").alias("request_id"),
        F.col("ts").alias("start_time"),
        F.to_date("ts").alias("usage_date"),
        user.alias("user"),
        text("key-", F.col("user_id") % 20).alias("api_key"),
        F.when(F.col("user_id") % 11 != 0, text("team-", F.col("user_id") % 7)).alias("team_id"),
        F.when(k % 13 == 0, "").otherwise(text("model-", k % 6)).alias("model"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, user).otherwise(text("eu-", k % 9)).alias("end_user"),
        F.when(k % 17 == 0, "").otherwise(F.col("event_type")).alias("call_type"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.col("value").cast(MONEY).alias("spend"),
        (k * 10).cast("long").alias("prompt_tokens"),
        (k * 3).cast("long").alias("completion_tokens"),
        F.when(k % 5 == 0, "True").otherwise("False").alias("cache_hit"),
        F.when(k % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("event_type", text("k", k % 3)))
        .alias("request_tags"),
        F.array(text("tool-", k % 5), text("tool-", k % 3), text("tool-", k % 5)).alias("tools"),
        F.when(F.col("event_type") == "error", 500).when(k % 10 == 9, 302).otherwise(200).alias("status_code"),
        F.when(F.col("event_type") == "view", "ui").otherwise("llm").alias("category"),
        text("/v1/", F.col("event_type")).alias("route"),
        (k / 10.0).alias("seconds"),
        k.alias("k"),
    )


#: The same log in SQL; every query that reads it puts this first.
LOG_SQL = """
log AS (SELECT CAST(event_id AS VARCHAR) AS request_id, ts AS start_time, CAST(ts AS DATE) AS usage_date,
  coalesce(CAST(user_id AS VARCHAR), '') AS "user", 'key-' || (user_id % 20) AS api_key,
  CASE WHEN user_id % 11 <> 0 THEN 'team-' || (user_id % 7) END AS team_id,
  CASE WHEN k % 13 = 0 THEN '' ELSE 'model-' || (k % 6) END AS model,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(CAST(user_id AS VARCHAR), '') ELSE 'eu-' || (k % 9) END AS end_user,
  CASE WHEN k % 17 = 0 THEN '' ELSE event_type END AS call_type,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
  CAST(value AS DECIMAL(18,6)) AS spend, CAST(k * 10 AS BIGINT) AS prompt_tokens, CAST(k * 3 AS BIGINT) AS completion_tokens,
  CASE WHEN k % 5 = 0 THEN 'True' ELSE 'False' END AS cache_hit,
  CASE WHEN k % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [event_type, 'k' || (k % 3)] END AS request_tags,
  ['tool-' || (k % 5), 'tool-' || (k % 3), 'tool-' || (k % 5)] AS tools,
  CASE WHEN event_type = 'error' THEN 500 WHEN k % 10 = 9 THEN 302 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'view' THEN 'ui' ELSE 'llm' END AS category, '/v1/' || event_type AS route,
  k / 10.0 AS seconds, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def keys(customer: DataFrame) -> DataFrame:
    """API keys: token, alias, team, organization (often null), budget."""
    c = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("key-"), as_text(c)).alias("token"),
        F.when(c % 5 != 0, F.col("c_name")).alias("key_alias"),
        F.concat(F.lit("team-"), as_text("c_nationkey")).alias("team_id"),
        F.when(c % 3 == 0, F.concat(F.lit("org-"), as_text(c % 4))).alias("organization_id"),
        F.col("c_acctbal").cast(MONEY).alias("max_budget"),
    )


KEYS_SQL = """
keys AS (SELECT 'key-' || c_custkey AS token, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS key_alias,
  'team-' || c_nationkey AS team_id, CASE WHEN c_custkey % 3 = 0 THEN 'org-' || (c_custkey % 4) END AS organization_id,
  CAST(c_acctbal AS DECIMAL(18,6)) AS max_budget FROM customer)"""


def teams(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    return nation.select(
        F.concat(F.lit("team-"), as_text(n)).alias("team_id"),
        F.when(n % 4 != 0, F.col("n_name")).alias("team_alias"),
        F.when(n % 6 != 0, F.concat(F.lit("org-"), as_text("n_regionkey"))).alias("organization_id"),
        (n * 1000).cast("long").alias("tpm_limit"),
        (n * 10).cast("long").alias("rpm_limit"),
    )


TEAMS_SQL = """
teams AS (SELECT 'team-' || n_nationkey AS team_id, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS team_alias,
  CASE WHEN n_nationkey % 6 <> 0 THEN 'org-' || n_regionkey END AS organization_id,
  CAST(n_nationkey * 1000 AS BIGINT) AS tpm_limit, CAST(n_nationkey * 10 AS BIGINT) AS rpm_limit FROM nation)"""


def orgs(region: DataFrame) -> DataFrame:
    return region.select(F.concat(F.lit("org-"), as_text("r_regionkey")).alias("organization_id"), F.col("r_name").alias("organization_alias"))


ORGS_SQL = "orgs AS (SELECT 'org-' || r_regionkey AS organization_id, r_name AS organization_alias FROM region)"


def users(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    mail = F.when(c % 9 != 0, F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")))
    return customer.select(as_text(c).alias("user_id"), mail.alias("user_email"))


USERS_SQL = """
users AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id,
  CASE WHEN c_custkey % 9 <> 0 THEN lower(replace(c_name, '#', '')) || '@example.com' END AS user_email FROM customer)"""


def rollup(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Usage that is already summed: a row for each order line, with brand as model and supplier as provider."""
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(part, lineitem.l_partkey == part.p_partkey)
    quantity = F.col("l_quantity").cast("long")
    return joined.select(
        F.to_date("l_shipdate").alias("usage_date"),
        F.concat(F.lit("key-"), as_text("o_custkey")).alias("api_key"),
        as_text("o_custkey").alias("user_id"),
        F.col("p_brand").alias("model"),
        F.concat(F.lit("provider_"), as_text(F.col("l_suppkey") % 5)).alias("provider"),
        F.concat(F.lit("/v1/"), F.lower("l_returnflag")).alias("endpoint"),
        F.col("l_extendedprice").cast(MONEY).alias("spend"),
        (quantity * 10).alias("prompt_tokens"),
        (quantity * 4).alias("completion_tokens"),
        (quantity * (F.col("l_linenumber") % 4)).cast("long").alias("cache_read_tokens"),
        (quantity * (F.col("l_linenumber") % 3)).cast("long").alias("cache_creation_tokens"),
        quantity.alias("api_requests"),
        F.when(F.col("l_linestatus") == "O", quantity).otherwise(0).cast("long").alias("successful_requests"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(quantity).cast("long").alias("failed_requests"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
    )


def rollup_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(*(read(spark, sf_dir, t) for t in ("lineitem", "orders", "part")))


ROLLUP_SQL = """
rollup_ AS (SELECT CAST(l_shipdate AS DATE) AS usage_date, 'key-' || o_custkey AS api_key, CAST(o_custkey AS VARCHAR) AS user_id,
  p_brand AS model, 'provider_' || (l_suppkey % 5) AS provider, '/v1/' || lower(l_returnflag) AS endpoint,
  CAST(l_extendedprice AS DECIMAL(18,6)) AS spend, q * 10 AS prompt_tokens, q * 4 AS completion_tokens,
  q * (l_linenumber % 4) AS cache_read_tokens, q * (l_linenumber % 3) AS cache_creation_tokens, q AS api_requests,
  CASE WHEN l_linestatus = 'O' THEN q ELSE 0 END AS successful_requests,
  CASE WHEN l_linestatus = 'O' THEN 0 ELSE q END AS failed_requests, l_orderkey AS order_key, l_linenumber AS line
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_log(read(spark, sf_dir, "events"))


def dims_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keys, teams, organizations and users."""
    customer = read(spark, sf_dir, "customer")
    return keys(customer), teams(read(spark, sf_dir, "nation")), orgs(read(spark, sf_dir, "region")), users(customer)


DIMS_SQL = ",".join((KEYS_SQL, TEAMS_SQL, ORGS_SQL, USERS_SQL))
