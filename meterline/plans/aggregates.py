"""Aggregates over the usage log and rollup: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..sources import bindings as b
from .common import DIMS, LOG, ROLLUP, m, n, rnd, t, with_

AS_OF = "2024-01-31"
RECENT = f"usage_date >= DATE '{AS_OF}' - 30"

_ops: dict = {}
_sql: dict = {}


def query(name: str, sql: str):
    def add(f):
        _ops[name], _sql[name] = f, sql
        return f

    return add


_log = b.log_of


@query("ag1_spend_by_day", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, {m('sum(spend)')} AS spend FROM log WHERE {RECENT} GROUP BY 1")
def _(spark, d):
    return ag.spend_by_day(_log(spark, d), AS_OF)


@query("ag2_top_keys", with_(LOG, DIMS) + f"SELECT api_key, key_alias, {m('spend')} AS spend FROM (SELECT api_key, sum(spend) AS spend FROM log WHERE {RECENT} GROUP BY 1) LEFT JOIN keys ON api_key = token")
def _(spark, d):
    return ag.top_keys(_log(spark, d), b.dims_of(spark, d)[0], AS_OF)


@query("ag3_top_models", with_(LOG) + f"SELECT model, {m('sum(spend)')} AS spend FROM log WHERE {RECENT} AND model <> '' GROUP BY 1")
def _(spark, d):
    return ag.top_models(_log(spark, d), AS_OF)


@query("ag4_spend_by_day_key", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, api_key, {m('sum(spend)')} AS spend FROM log WHERE {RECENT} GROUP BY 1, 2")
def _(spark, d):
    return ag.spend_by_day_key(_log(spark, d), AS_OF)


@query("ag5_spend_by_day_user_key", with_(LOG) + f"""SELECT {t('usage_date')} AS usage_date, "user", api_key, {m('sum(spend)')} AS spend FROM log WHERE {RECENT} GROUP BY 1, 2, 3""")
def _(spark, d):
    return ag.spend_by_day_user_key(_log(spark, d), AS_OF)


@query("ag6_daily_tag_spend", with_(LOG) + f"SELECT tag, {t('usage_date')} AS usage_date, count(*) AS log_count, {m('sum(spend)')} AS spend FROM (SELECT unnest(request_tags) AS tag, usage_date, spend FROM log) GROUP BY 1, 2")
def _(spark, d):
    return ag.daily_tag_spend(_log(spark, d))


@query("ag7_top_end_users", with_(LOG) + f"""SELECT end_user, count(*) AS requests, {m('sum(spend)')} AS spend FROM log WHERE end_user <> '' AND end_user <> "user" GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 100""")
def _(spark, d):
    return ag.top_end_users(_log(spark, d))


_CACHE = f"""SELECT CASE WHEN call_type = '' THEN 'Unknown' ELSE call_type END AS call_type,
 {n("count(*) - count(*) FILTER (cache_hit = 'True') - count(*) FILTER (status = 'failure')")} AS api_requests,
 count(*) FILTER (cache_hit = 'True') AS cache_hits, count(*) FILTER (status = 'failure') AS failed_requests,
 {n("coalesce(sum(completion_tokens) FILTER (cache_hit = 'True'), 0)")} AS cached_completion_tokens,
 {n("coalesce(sum(completion_tokens) FILTER (cache_hit <> 'True'), 0)")} AS generated_completion_tokens
 FROM log GROUP BY 1"""


@query("ag8_cache_activity", with_(LOG) + _CACHE)
def cache_activity(spark, d):
    return ag.cache_activity(_log(spark, d))


@query("ag9_cache_totals", with_(LOG, f"c AS ({_CACHE})") + f"""SELECT {", ".join(f"{n(f'coalesce(sum({c}), 0)')} AS {c}" for c in
 ("api_requests", "cache_hits", "failed_requests", "cached_completion_tokens", "generated_completion_tokens"))},
 CASE WHEN sum(api_requests + cache_hits) > 0 THEN {rnd("sum(cache_hits) * 100.0 / sum(api_requests + cache_hits)")} ELSE 0.0 END AS hit_ratio FROM c""")
def _(spark, d):
    return ag.cache_totals(ag.cache_activity(_log(spark, d)))


@query("ag10_filter_options", with_(LOG, DIMS) + """SELECT DISTINCT 'key_alias' AS kind, coalesce(key_alias, 'Unnamed Key') AS value
 FROM keys WHERE token IN (SELECT api_key FROM log) UNION ALL SELECT DISTINCT 'model', model FROM log WHERE model <> ''""")
def _(spark, d):
    return ag.filter_options(_log(spark, d), b.dims_of(spark, d)[0])


_OK = "status_code >= 200 AND status_code < 300"


@query("ag11_gateway_activity", with_(LOG) + f"""SELECT {t('usage_date')} AS usage_date, category, route, count(*) FILTER ({_OK}) AS successes,
 count(*) FILTER (NOT ({_OK})) AS failures, {n('grouping(usage_date, category, route)')} AS level
 FROM log GROUP BY GROUPING SETS ((usage_date), (category, route), ())""")
def _(spark, d):
    return ag.gateway_activity(_log(spark, d))


@query("ag12_count_requests", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, category, route, count(*) FILTER ({_OK}) AS successful_requests, count(*) FILTER (NOT ({_OK})) AS failed_requests FROM log GROUP BY usage_date, category, route")
def _(spark, d):
    return ag.count_requests(_log(spark, d))


#: Each kind of entity's id in SQL; ``_deltas`` has the same in DataFrame terms.
ENTITY = {
    "user": "user_id",
    "team": "'team-' || (order_key % 7)",
    "org": "CASE WHEN order_key % 3 <> 0 THEN 'org-' || (order_key % 5) END",
    "end_user": "CASE order_key % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'eu-' || (order_key % 9) END",
    "agent": "'agent-' || (line % 3)",
    "tag": "'tag-' || (line % 5)",
}


def _deltas(spark, d):
    """The rollup with the ids of each kind of entity and a model group that only the first rows have."""
    key, line, text = F.col("order_key"), F.col("line"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return b.rollup_of(spark, d).withColumns(
        {
            "user": F.col("user_id"),
            "team": text("team-", key % 7),
            "org": F.when(key % 3 != 0, text("org-", key % 5)),
            "end_user": F.when(key % 4 == 0, None).when(key % 4 == 1, "").otherwise(text("eu-", key % 9)),
            "agent": text("agent-", line % 3),
            "tag": text("tag-", line % 5),
            "model_group": text("group-", key % 3),
            "mcp_namespaced_tool_name": F.when(line % 3 != 0, text("tool-", line % 2)),
            "compression_saved_tokens": F.when(line % 2 == 0, F.col("api_requests") * 3),
            "compression_savings_spend": (F.when(line % 2 == 0, F.col("api_requests") * 3) * F.lit("0.000001").cast(b.MONEY)).cast(b.MONEY),
            "prompt_caching_savings_spend": (F.col("cache_read_tokens") * F.lit("0.000002").cast(b.MONEY)).cast(b.MONEY),
            "autorouter_savings_spend": F.when(line % 4 == 0, F.col("spend")),
        }
    )


_SUMS = ", ".join(f"{n(f'sum({c})')} AS {c}" for c in ag.COUNTERS)


def _rollup_query(entity: str, expression: str) -> None:
    sql = with_(ROLLUP) + f"""SELECT {t('usage_date')} AS usage_date, coalesce({expression}, '') AS "{entity}", api_key, model, provider, CASE WHEN line % 3 <> 0 THEN 'tool-' || (line % 2) ELSE '' END AS mcp_namespaced_tool_name, endpoint, {_SUMS},
 {n('sum(CASE WHEN line % 2 = 0 THEN api_requests * 3 ELSE 0 END)')} AS compression_saved_tokens, {m('sum(spend)')} AS spend,
 {m('sum(CASE WHEN line % 2 = 0 THEN api_requests * 3 ELSE 0 END) * 0.000001')} AS compression_savings_spend, {m('sum(cache_read_tokens) * 0.000002')} AS prompt_caching_savings_spend,
 {m('sum(CASE WHEN line % 4 = 0 THEN spend ELSE 0 END)')} AS autorouter_savings_spend,
 arg_min('group-' || (order_key % 3), (order_key, line)) AS model_group FROM rollup_ GROUP BY 1, 2, 3, 4, 5, 6, 7"""

    @query(f"ag13_daily_rollup_{entity}", sql)
    def _(spark, d):
        return ag.daily_rollup(_deltas(spark, d), entity)


for _entity, _expression in ENTITY.items():
    _rollup_query(_entity, _expression)


@query("ag14_fold_deltas", with_(LOG) + f"SELECT api_key, model, {n('sum(CASE WHEN k % 3 <> 0 THEN prompt_tokens ELSE 0 END)')} AS prompt_tokens, {m('sum(spend)')} AS spend FROM log GROUP BY 1, 2")
def _(spark, d):
    log = _log(spark, d).withColumn("prompt_tokens", F.when(F.col("k") % 3 != 0, F.col("prompt_tokens")))
    return ag.fold_deltas(log, ["api_key", "model"], ["prompt_tokens", "spend"])


@query("ag15_entity_spend", with_(LOG) + f"""SELECT entity_type, entity_id, {m('sum(amount)')} AS amount FROM (
 SELECT 'user' AS entity_type, "user" AS entity_id, spend AS amount FROM log UNION ALL SELECT 'key', api_key, spend FROM log
 UNION ALL SELECT 'team', team_id, spend FROM log) GROUP BY 1, 2""")
def _(spark, d):
    kinds = {"user": "user", "key": "api_key", "team": "team_id", "planet": "model"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("entity_id")) for k, c in kinds.items()]))
    return ag.entity_spend(_log(spark, d).select(pairs.alias("e"), F.col("spend").alias("amount")).select("e.*", "amount"))


@query("ag16_tool_spend", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, tool, count(*) AS requests, {m('sum(spend)')} AS spend, {n('sum(tokens)')} AS tokens FROM (SELECT usage_date, spend, prompt_tokens + completion_tokens AS tokens, unnest(list_distinct(tools)) AS tool FROM log) GROUP BY usage_date, tool")
def _(spark, d):
    return ag.tool_spend(_log(spark, d))


def _checks(spark, d):
    k = F.col("k")
    return _log(spark, d).select(
        "request_id", "usage_date", "team_id", "api_key", "user", "model",
        F.concat(F.lit("guard-"), (k % 3).cast("string")).alias("guardrail"),
        F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "flagged").otherwise("passed").alias("action"),
        F.when(k % 4 != 0, k / 100.0).alias("score"), (k * 2.0).alias("latency_ms"),
        F.create_map(F.lit("calls"), F.lit(1).cast("long"), F.lit("chars"), F.col("prompt_tokens")).alias("units"),
        F.when(k % 2 == 0, "eu").otherwise("us").alias("region"), F.when(k % 6 == 0, "post_call").otherwise("pre_call").alias("mode"),
        (k % 9 == 0).cast("int").alias("sensitive"),
    )


_GUARD = "'guard-' || (k % 3)"
_ACTION = "CASE k % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'flagged' ELSE 'passed' END"


@query("ag17_guardrail_daily", with_(LOG, f"c AS (SELECT *, {_GUARD} AS guardrail, {_ACTION} AS action, CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) / 100 END AS score, k * 2.0 AS latency_ms FROM log)") + f"""SELECT guardrail, {t('usage_date')} AS usage_date,
 count(*) AS evaluated, count(*) FILTER (action = 'passed') AS passed, count(*) FILTER (action = 'blocked') AS blocked, count(*) FILTER (action = 'flagged') AS flagged,
 {rnd('sum(score) / count(score)')} AS avg_score, {rnd('sum(CAST(latency_ms AS DOUBLE)) / count(*)')} AS avg_latency_ms FROM c GROUP BY guardrail, usage_date""")
def _(spark, d):
    return ag.guardrail_daily(_checks(spark, d))


@query("ag18_guardrail_units", with_(LOG) + f"""SELECT {_GUARD} AS guardrail, {t('usage_date')} AS usage_date, team_id, api_key, unit, {n("sum(CASE unit WHEN 'calls' THEN 1 ELSE prompt_tokens END)")} AS units
 FROM log, (VALUES ('calls'), ('chars')) AS u(unit) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    return ag.guardrail_units(_checks(spark, d))


@query("ag19_guardrail_cost", with_(LOG, f"u AS (SELECT {_GUARD} AS guardrail, unit, CASE WHEN k % 2 = 0 THEN 'eu' ELSE 'us' END AS region, sum(CASE unit WHEN 'chars' THEN prompt_tokens ELSE 1 END) AS units FROM log, (VALUES ('calls'), ('chars'), ('odd')) AS x(unit) GROUP BY 1, 2, 3)") + f"""SELECT guardrail,
 {rnd("sum(units * CASE unit WHEN 'calls' THEN (CASE region WHEN 'eu' THEN 0.02 ELSE 0.01 END) WHEN 'chars' THEN (CASE region WHEN 'eu' THEN 0 ELSE 0.0001 END) ELSE 0 END)")} AS cost FROM u GROUP BY 1""")
def _(spark, d):
    units = _checks(spark, d).select("guardrail", "region", F.explode("units").alias("unit", "n"))
    odd = _checks(spark, d).select("guardrail", "region", F.lit("odd").alias("unit"), F.lit(1).cast("long").alias("n"))
    units = units.union(odd).groupBy("guardrail", "unit", "region").agg(F.sum("n").alias("units"))
    prices = spark.createDataFrame([("calls", "eu", 0.02), ("calls", None, 0.01), ("chars", "eu", -1.0), ("chars", None, 0.0001)], "unit string, region string, price double")
    return ag.guardrail_cost(units, prices)


@query("ag20_compression_saved", with_(LOG) + f"""SELECT request_id, {n('''CASE WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 2 THEN 0 ELSE k END
 + CASE k % 3 WHEN 0 THEN k + 2 WHEN 1 THEN 5 ELSE 0 END''')} AS tokens_saved FROM log""")
def _(spark, d):
    k = F.col("k").cast("string")
    own = F.when(F.col("k") % 4 == 1, "true").when(F.col("k") % 4 == 2, "-3").otherwise(k)
    guard = F.when(F.col("k") % 3 == 0, F.concat(F.lit('[{"tokens_saved": '), k, F.lit('}, {"tokens_saved": 2}, {"tokens_saved": false}, 7]')))
    guard = guard.when(F.col("k") % 3 == 1, '{"tokens_saved": 5}').otherwise('"none"')
    text = F.concat(F.lit('{"compression_savings": {"tokens_saved": '), own, F.lit('}, "guardrail_information": '), guard, F.lit("}"))
    return ag.compression_saved(_log(spark, d).select("request_id", text.alias("metadata")))


@query("ag21_provider_spend", with_(ROLLUP) + f"SELECT provider, {m('sum(spend)')} AS spend, {n('sum(api_requests)')} AS requests, {n('sum(successful_requests)')} AS successful FROM rollup_ GROUP BY 1 HAVING sum(spend) > 0")
def _(spark, d):
    return ag.provider_spend(b.rollup_of(spark, d))


def _top_query(dim: str) -> None:
    @query(f"ag22_top_{dim}", with_(ROLLUP) + f"SELECT {dim}, {m('sum(spend)')} AS spend, {n('sum(api_requests)')} AS requests FROM rollup_ GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 5")
    def _(spark, d):
        return ag.top_entities(b.rollup_of(spark, d), dim)


for _dim in ("model", "api_key", "endpoint"):
    _top_query(_dim)


@query("ag23_top_keys_with_tags", with_(ROLLUP, "d AS (SELECT api_key, usage_date, sum(spend) AS spend, string_agg(DISTINCT 'tag-' || (line % 5), ',' ORDER BY 'tag-' || (line % 5)) AS tags FROM rollup_ GROUP BY 1, 2)") + f"SELECT api_key, {m('sum(spend)')} AS spend, arg_min(tags, usage_date) AS tags FROM d GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 5")
def _(spark, d):
    return ag.top_keys_with_tags(_deltas(spark, d))


@query("ag24_endpoint_usage", with_(ROLLUP) + f"SELECT endpoint, {_SUMS}, {m('sum(spend)')} AS spend, {n('sum(prompt_tokens + completion_tokens)')} AS total_tokens FROM rollup_ GROUP BY 1")
def _(spark, d):
    return ag.endpoint_usage(b.rollup_of(spark, d))


@query("ag25_cache_leakage", with_(ROLLUP, "s AS (SELECT model, sum(prompt_tokens) AS p, sum(cache_read_tokens) AS c, sum(cache_creation_tokens) AS w FROM rollup_ GROUP BY 1)", f"r AS (SELECT {m('sum(c) * 0.000002')} / sum(c + w) AS net FROM s)") + f"SELECT model, {n('p - c - w')} AS uncached, {rnd('c / p')} AS hit_ratio, {rnd('(p - c - w) * net')} AS savings FROM s, r WHERE p - c - w > 0 ORDER BY savings DESC, model LIMIT 10")
def _(spark, d):
    rate = F.lit("0.000002").cast("decimal(7,6)")
    rows = b.rollup_of(spark, d).withColumn("caching_savings", F.col("cache_read_tokens") * rate)
    return ag.cache_leakage(rows, "model")


@query("ag26_squash_alerts", with_(LOG) + "SELECT route AS url, status AS type, count(*) AS n, arg_min('request ' || request_id, CAST(request_id AS BIGINT)) AS message FROM log GROUP BY 1, 2")
def _(spark, d):
    alerts = _log(spark, d).select(F.col("route").alias("url"), F.col("status").alias("type"), F.concat(F.lit("request "), "request_id").alias("message"), F.col("request_id").cast("long").alias("seq"))
    return ag.squash_alerts(alerts)


@query("ag27_compliance", with_(LOG, f"c AS (SELECT *, {_ACTION} AS action FROM log)", """x AS (SELECT request_id, true AS guardrail_applied, k % 6 <> 0 AS screened_before_call,
 "user" <> '' AND model <> '' AS audit_complete, k % 9 <> 0 OR action = 'blocked' AS sensitive_data_protected FROM c)""") + "SELECT *, guardrail_applied AND screened_before_call AND audit_complete AND sensitive_data_protected AS compliant FROM x")
def _(spark, d):
    return ag.compliance(_checks(spark, d))


@query("ag28_deprecations", f"""WITH p AS (SELECT DISTINCT p_brand AS model, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS i FROM part),
x AS (SELECT 'maker/' || model AS name, CASE WHEN i % 5 = 0 THEN DATE '2024-02-10' WHEN i % 5 = 1 THEN DATE '2024-01-01' WHEN i % 5 = 2 THEN DATE '2024-06-01' WHEN i % 5 = 3 THEN DATE '2024-03-01' END AS date FROM p)
SELECT name, {t('date')} AS date, CASE WHEN date - DATE '{AS_OF}' <= 0 THEN 'deprecated' WHEN date - DATE '{AS_OF}' <= 30 THEN 'imminent' ELSE 'upcoming' END AS state FROM x WHERE date IS NOT NULL""")
def _(spark, d):
    i = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    parts = b.read(spark, d, "part").select(F.col("p_brand").alias("bare"), i.alias("i"))
    models = parts.select(
        F.concat(F.lit("maker/"), "bare").alias("model"),
        F.when(F.col("i") % 5 == 1, "base-old").alias("base_model"),
        F.when(F.col("i") % 5 == 0, "2024-02-10").alias("override"),
    )
    own = parts.where("i % 5 = 2").select("bare", F.lit("2024-06-01").cast("date"))
    full = parts.where("i % 5 = 3").select(F.concat(F.lit("maker/"), "bare"), F.lit("2024-03-01").cast("date"))
    base = spark.range(1).select(F.lit("base-old"), F.lit("2024-01-01").cast("date"))
    return ag.deprecations(models, own.union(full).union(base).toDF("name", "date").distinct(), AS_OF)


@query("ag29_shadow_eval", with_(LOG) + f"""SELECT 'job-' || (k % 4) AS job, 'tier-' || (k % 3) AS tier, CASE WHEN k % 5 < 2 THEN 'win' ELSE 'loss' END AS outcome,
 count(*) AS n, {rnd('avg(CAST(k AS DOUBLE) / 100)')} AS mean_confidence, {m('sum(spend)')} AS judge_cost FROM log GROUP BY 1, 2, 3""")
def _(spark, d):
    k = F.col("k")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return ag.shadow_eval(_log(spark, d).select(text("job-", k % 4).alias("job"), text("tier-", k % 3).alias("tier"), F.when(k % 5 < 2, "win").otherwise("loss").alias("outcome"), (k / 100.0).alias("confidence"), F.col("spend").alias("judge_cost")))


@query("ag30_savings_baseline", f"""WITH p AS (SELECT p_brand AS model, avg(p_retailprice) / 1e6 AS r FROM part GROUP BY 1), c AS (SELECT model, {rnd('r * 0.1 * 19000 + r * 1.25 * 1000 + r * 4 * 1000')} AS cost FROM p)
SELECT arg_max(model, (cost, model)) AS model, max(cost) AS cost FROM c WHERE cost > 0""")
def _(spark, d):
    r = F.col("r")
    prices = b.read(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg((F.avg("p_retailprice") / 1e6).alias("r"))
    return ag.savings_baseline(prices.select("model", r.alias("input"), (r * 0.1).alias("cache_read"), (r * 1.25).alias("cache_write"), (r * 4).alias("output")))


@query("ag31_export_summary", with_(LOG) + f"SELECT count(*) AS n_rows, {m('sum(spend)')} AS spend, {n('sum(prompt_tokens + completion_tokens)')} AS tokens, {n('count(DISTINCT team_id) + max(CASE WHEN team_id IS NULL THEN 1 ELSE 0 END)')} AS teams, {n('count(DISTINCT model)')} AS models FROM log")
def _(spark, d):
    return ag.export_summary(_log(spark, d))


@query("ag32_model_latency", with_(LOG) + f"""SELECT model, strftime(date_trunc('hour', start_time), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS requests, {m('sum(spend)')} AS spend, {rnd('sum(prompt_tokens + completion_tokens) / 60')} AS tokens_per_minute,
 {rnd('quantile_cont(CAST(seconds AS DOUBLE), 0.95)')} AS p95_seconds FROM log WHERE model <> '' GROUP BY 1, 2""")
def _(spark, d):
    return ag.model_latency(_log(spark, d))


@query("ag33_pii_outcomes", with_(LOG, "e AS (SELECT category AS surface, CASE WHEN k % 2 = 0 THEN 'in' ELSE 'out' END AS direction, ['applied', 'blocked', 'failed', 'unscanned', 'applied'][k % 5 + 1] AS outcome, k AS tokenized, k % 7 AS masked FROM log)") + f"""SELECT surface, direction, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("applied", "blocked", "failed", "unscanned"))},
 {n('sum(tokenized)')} AS tokenized, {n('sum(masked)')} AS masked FROM e GROUP BY 1, 2""")
def _(spark, d):
    k = F.col("k")
    kinds = F.array(*[F.lit(o) for o in ("applied", "blocked", "failed", "unscanned", "applied")])
    return ag.pii_outcomes(_log(spark, d).select(F.col("category").alias("surface"), F.when(k % 2 == 0, "in").otherwise("out").alias("direction"), F.element_at(kinds, k % 5 + 1).alias("outcome"), k.alias("tokenized"), (k % 7).alias("masked")))


QUERIES, ORACLE_SQL = _ops, _sql
