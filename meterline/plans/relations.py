"""Filters, joins, windows, rankings and sets: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import relations as r
from ..sources import bindings as b
from .common import DIMS, LOG, ROLLUP, m, n, rnd, t, with_

_ops: dict = {}
_sql: dict = {}


def query(name: str, sql: str):
    def add(f):
        _ops[name], _sql[name] = f, sql
        return f

    return add


_log = b.log_of
_text = lambda p, c: F.concat(F.lit(p), c.cast("string"))


@query("flt1_in_window", with_(LOG) + "SELECT request_id FROM log WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-09'")
def _(spark, d):
    return r.in_window(_log(spark, d), "2024-01-05", "2024-01-08").select("request_id")


@query("flt2_optional_in", with_(LOG) + "SELECT request_id FROM log WHERE api_key IN ('key-1', 'key-2')")
def _(spark, d):
    return r.optional_in(r.optional_in(_log(spark, d), "api_key", ["key-1", "key-2"]), "model", []).select("request_id")


@query("flt3_list_page", with_(LOG, DIMS) + f"SELECT token, key_alias, {m('max_budget')} AS max_budget, {n('(SELECT count(*) FROM keys WHERE key_alias IS NOT NULL AND max_budget >= 0 AND contains(key_alias, chr(35) || chr(48)))')} AS total FROM keys WHERE key_alias IS NOT NULL AND max_budget >= 0 AND contains(key_alias, '#0') ORDER BY max_budget DESC NULLS LAST, token LIMIT 25 OFFSET 25")
def _(spark, d):
    where = [("key_alias", "is_null", False), ("max_budget", "gte", 0), ("key_alias", "contains", "#0")]
    page, total = r.list_page(b.dims_of(spark, d)[0], where, "max_budget", "token", 2, 25, descending=True)
    return page.select("token", "key_alias", "max_budget").crossJoin(F.broadcast(total))  # one row


@query("flt4_audit_search", with_(LOG) + """SELECT request_id FROM log WHERE status = 'success' AND start_time >= TIMESTAMP '2024-01-10' AND (model LIKE '%el-3%' OR api_key LIKE '%el-3%')""")
def _(spark, d):
    audit = _log(spark, d).select("request_id", "status", F.col("start_time").alias("changed_at"), F.to_json(F.struct("model")).alias("before"), F.to_json(F.struct(F.col("api_key").alias("model"))).alias("after"))
    return r.audit_search(audit, {"status": "success"}, "2024-01-10", "$.model", "el-3").select("request_id")


@query("flt5_blocked_users", with_(LOG, DIMS) + """SELECT request_id, false AS blocked FROM log WHERE "user" NOT IN (SELECT user_id FROM users WHERE user_email IS NULL)
 UNION ALL SELECT request_id, true FROM log WHERE "user" IN (SELECT user_id FROM users WHERE user_email IS NULL)""")
def _(spark, d):
    blocked = b.dims_of(spark, d)[3].where("user_email is null").select(F.col("user_id").alias("user"))
    log = _log(spark, d)
    kept = r.blocked_users(log, blocked).select("request_id", F.lit(False).alias("blocked"))
    return kept.union(r.blocked_users(log, blocked, keep=True).select("request_id", F.lit(True).alias("blocked")))


WORDS = ["idiot", "scum", "Clown", "trash"]


@query("flt6_banned_keywords", "SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END, CASE WHEN contains(lower(text), 'scum') THEN 'scum' END, CASE WHEN contains(lower(text), 'trash') THEN 'trash' END) AS hits FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'scum') OR contains(lower(text), 'trash')")
def _(spark, d):
    return r.banned_keywords(b.read(spark, d, "documents"), WORDS).select("doc_id", F.array_join("hits", ",").alias("hits"))


POLICIES = [("all", "*", "*", "*", []), ("team-3 only", "team-3", "*", "model-?", []), ("keys 1", "*", "key-1*", "*", ["err*", "k2"]), ("dotted", "team.*", "*", "*", [])]
_P = "(VALUES ('all', '%', '%', '%', CAST([] AS VARCHAR[])), ('keys 1', '%', 'key-1%', '%', ['err%', 'k2'])) AS p(policy, pt, pk, pm, ptags)"


@query("flt6_banned_keywords_many", "WITH w AS (SELECT DISTINCT lower(regexp_extract(text, '^[a-zA-Z]+')) AS word FROM conversations WHERE length(regexp_extract(text, '^[a-zA-Z]+')) >= 4) SELECT doc_id, string_agg(word, ',' ORDER BY word) AS hits FROM documents JOIN w ON contains(lower(text), word) GROUP BY doc_id, text")
def _(spark, d):
    """The words with which conversations begin as keywords."""
    first = F.lower(F.regexp_extract("text", "^[a-zA-Z]+", 0))
    words = b.read(spark, d, "conversations").select(first.alias("word")).where("length(word) >= 4")
    return r.banned_keywords(b.read(spark, d, "documents"), words).select("doc_id", F.array_join("hits", ",").alias("hits"))


@query("flt7_policy_match", with_(LOG) + f"""SELECT request_id AS context_id, policy FROM log, {_P} WHERE (CASE WHEN team_id IS NULL THEN pt = '%' ELSE team_id LIKE pt END) AND api_key LIKE pk AND model LIKE pm
 AND (len(ptags) = 0 OR len(list_filter(request_tags, lambda x: x LIKE 'err%' OR x = 'k2')) > 0)""")
def _(spark, d):
    contexts = _log(spark, d).select(F.col("request_id").alias("context_id"), F.col("team_id").alias("team"), F.col("api_key").alias("key"), "model", F.col("request_tags").alias("tags"))
    policies = spark.createDataFrame(POLICIES, "policy string, p_team string, p_key string, p_model string, p_tags array<string>")
    return r.policy_match(contexts, policies)


@query("flt8_policy_condition", with_(LOG) + "SELECT request_id, 'list' AS kind FROM log WHERE model IN ('model-1', 'model-2') UNION ALL SELECT request_id, 'regex' FROM log WHERE regexp_full_match(model, 'model-[345]') UNION ALL SELECT request_id, 'equal' FROM log WHERE model = 'model-5'")
def _(spark, d):
    log = _log(spark, d)
    found = [("list", ["model-1", "model-2"]), ("regex", "model-[345]"), ("equal", "model-5"), ("invalid", "model-(")]
    parts = [r.policy_condition(log, "model", c).select("request_id", F.lit(k).alias("kind")) for k, c in found]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("jn1_keys_with_team_limits", with_(DIMS) + f"SELECT token, key_alias, k.team_id, team_alias, tpm_limit, rpm_limit FROM keys k LEFT JOIN teams USING (team_id)")
def _(spark, d):
    keys, teams, _orgs, _users = b.dims_of(spark, d)
    return r.keys_with_team_limits(keys, teams).select("token", "key_alias", "team_id", "team_alias", "tpm_limit", "rpm_limit")


_ENRICHED = """FROM rollup_ u LEFT JOIN keys k ON u.api_key = k.token LEFT JOIN teams t ON k.team_id = t.team_id LEFT JOIN users s ON u.user_id = s.user_id"""


@query("jn2_usage_enriched", with_(ROLLUP, DIMS) + f"SELECT order_key, {n('line')} AS line, key_alias, team_alias, user_email, organization_alias {_ENRICHED} LEFT JOIN orgs o ON o.organization_id = coalesce(k.organization_id, t.organization_id)")
def _(spark, d):
    keys, teams, orgs, users = b.dims_of(spark, d)
    found = r.usage_enriched(b.rollup_of(spark, d), keys, teams, users, orgs)
    return found.select("order_key", "line", "key_alias", "team_alias", "user_email", "organization_alias")


@query("jn3_usage_enriched_basic", with_(ROLLUP, DIMS) + f"SELECT order_key, {n('line')} AS line, key_alias, team_alias, user_email {_ENRICHED} WHERE usage_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def _(spark, d):
    keys, teams, _orgs, users = b.dims_of(spark, d)
    found = r.usage_enriched_basic(b.rollup_of(spark, d), keys, teams, users, "1997-01-01", "1997-12-31")
    return found.select("order_key", "line", "key_alias", "team_alias", "user_email")


@query("jn4_backfill_tool_spend", with_(LOG, "x AS (SELECT request_id, unnest(list_distinct(tools)) AS tool FROM log)") + f"""SELECT {t('usage_date')} AS usage_date, tool, count(*) AS requests, {m('sum(spend)')} AS spend FROM x JOIN log USING (request_id)
 WHERE usage_date < DATE '2024-01-20' AND NOT (tool = 'tool-1' AND usage_date < DATE '2024-01-05') GROUP BY usage_date, tool""")
def _(spark, d):
    log = _log(spark, d)
    index = log.select("request_id", F.explode(F.array_distinct("tools")).alias("tool"))
    existing = log.where("usage_date < date'2024-01-05'").select("usage_date", F.lit("tool-1").alias("tool")).distinct()
    return r.backfill_tool_spend(index, log, existing, "2024-01-20")


@query("jn5_fill_missing_team", with_(LOG, DIMS) + "SELECT request_id, coalesce(l.team_id, k.team_id) AS team_id FROM log l LEFT JOIN keys k ON api_key = token")
def _(spark, d):
    return r.fill_missing_team(_log(spark, d), b.dims_of(spark, d)[0]).select("request_id", "team_id")


TIERS = [(f"model-{i}", lo, hi, rate * (i + 1)) for i in range(5) for lo, hi, rate in ((0, 200, 0.001), (200, 500, 0.002), (500, 800, 0.004))]
_TIERS = ", ".join(f"('{a}', {lo}, {hi}, CAST({x!r} AS DOUBLE))" for a, lo, hi, x in TIERS)


@query("jn6_tier_price", with_(LOG, f"tiers(model, lo, hi, rate) AS (VALUES {_TIERS})", "x AS (SELECT request_id, model, prompt_tokens AS tokens FROM log)") + f"""SELECT request_id, CASE WHEN tokens > 0 THEN coalesce(t.rate, l.rate) END AS rate, {rnd('CASE WHEN tokens > 0 THEN coalesce(t.rate, l.rate) * tokens END')} AS cost
 FROM x LEFT JOIN tiers t ON x.model = t.model AND tokens > lo AND tokens <= hi LEFT JOIN (SELECT model, arg_max(rate, hi) AS rate FROM tiers GROUP BY 1) l ON x.model = l.model""")
def _(spark, d):
    tiers = spark.createDataFrame(TIERS, "model string, range_start long, range_end long, rate double")
    usage = _log(spark, d).select("request_id", "model", F.col("prompt_tokens").alias("tokens"))
    return r.tier_price(usage, tiers).select("request_id", "rate", "cost")


def _results(spark, d):
    conv = b.read(spark, d, "conversations")
    return conv.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("idx"), "text")


@query("jn7_rerank_pick", f"SELECT conv_id AS query_id, {n('turn * 7 % 5')} AS place, turn AS idx, length(text) AS chars, {m('1.0 / (1 + turn)')} AS relevance FROM conversations")
def _(spark, d):
    results = _results(spark, d)
    ranks = results.select("query_id", "idx", (F.col("idx") * 7 % 5).alias("place"), (1.0 / (1 + F.col("idx"))).alias("relevance"))
    out_of_range = ranks.select("query_id", (F.col("idx") + 1000).alias("idx"), "place", "relevance")
    return r.rerank_pick(results, ranks.union(out_of_range)).select("query_id", "place", "idx", F.length("text").cast("long").alias("chars"), "relevance")


@query("jn8_resolve_tool_results", f"""WITH a AS (SELECT conv_id, turn, unnest(['c1', 'c' || (turn % 3)]) AS call_id, unnest(['find', 'tool-' || turn]) AS name FROM conversations WHERE role = 'assistant'),
 x AS (SELECT conv_id, turn, 'c' || (turn % 4) AS call_id FROM conversations WHERE role = 'user')
SELECT x.conv_id, x.turn, x.call_id, (SELECT max(name) FROM a WHERE a.conv_id = x.conv_id AND a.call_id = x.call_id AND a.turn < x.turn AND a.turn = (SELECT max(turn) FROM a b WHERE b.conv_id = x.conv_id AND b.call_id = x.call_id AND b.turn < x.turn)) AS name FROM x""")
def _(spark, d):
    conv, turn = b.read(spark, d, "conversations"), F.col("turn")
    call = lambda i, name: F.struct(i.alias("id"), name.alias("name"))
    last = _text("c", turn % 3)
    calls = F.array(call(F.lit("c1"), F.when(last == "c1", F.greatest(F.lit("find"), _text("tool-", turn))).otherwise("find")), call(last, F.when(last == "c1", F.greatest(F.lit("find"), _text("tool-", turn))).otherwise(_text("tool-", turn))))
    said = conv.where("role = 'assistant'").select("conv_id", "turn", "role", calls.alias("tool_calls"), F.lit(None).cast("string").alias("call_id"))
    tool = conv.where("role = 'user'").select("conv_id", "turn", F.lit("tool").alias("role"), F.lit(None).cast(said.schema["tool_calls"].dataType).alias("tool_calls"), _text("c", turn % 4).alias("call_id"))
    return r.resolve_tool_results(said.union(tool))


@query("jn9_reconcile_membership", """WITH h AS (SELECT DISTINCT 'team-' || (c_custkey % 40) AS team_id, 'g' || (c_custkey % 7) AS g FROM customer), w AS (SELECT DISTINCT 'team-' || (c_custkey % 50) AS team_id, 'g' || (c_nationkey % 6) AS g FROM customer),
 x AS (SELECT coalesce(h.team_id, w.team_id) AS team_id, h.g AS a, w.g AS b FROM h FULL JOIN w ON h.team_id = w.team_id AND h.g = w.g)
SELECT team_id, coalesce(string_agg(b, ',' ORDER BY b), '') AS groups, coalesce(string_agg(b, ',' ORDER BY b) FILTER (a IS NULL), '') AS attached, coalesce(string_agg(a, ',' ORDER BY a) FILTER (b IS NULL), '') AS detached FROM x GROUP BY 1""")
def _(spark, d):
    c = b.read(spark, d, "customer")
    key = F.col("c_custkey")
    have = c.select(_text("team-", key % 40).alias("team_id"), _text("g", key % 7).alias("g")).groupBy("team_id").agg(F.collect_set("g").alias("groups"))
    want = c.select(_text("team-", key % 50).alias("team_id"), _text("g", F.col("c_nationkey") % 6).alias("group_id"))
    found = r.reconcile_membership(have, want)
    return found.select("team_id", *[F.array_join(x, ",").alias(x) for x in ("groups", "attached", "detached")])


@query("jn10_team_emails", with_(DIMS) + "SELECT 'team-' || (CAST(user_id AS BIGINT) % 25) AS team_id, user_id, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'admin' ELSE 'member' END AS role, user_email FROM users WHERE user_email IS NOT NULL")
def _(spark, d):
    users = b.dims_of(spark, d)[3]
    i = F.col("user_id").cast("long")
    member = F.struct("user_id", F.when(i % 2 == 0, "admin").otherwise("member").alias("role"))
    teams = users.groupBy(_text("team-", i % 25).alias("team_id")).agg(F.to_json(F.collect_list(member)).alias("members"))
    return r.team_emails(teams, users)


PATTERNS = [("model-*", "pool/*"), ("model-1*", "first/*-x"), ("model-3", "three"), ("m*", "any/*"), ("model-*2", "two/*")]


@query("jn11_map_models", with_(LOG) + """SELECT request_id, model, CASE WHEN model = '' THEN NULL WHEN model = 'model-1' THEN 'model-1*' WHEN model = 'model-2' THEN 'model-*2' ELSE 'model-*' END AS pattern,
 CASE WHEN model = '' THEN NULL WHEN model = 'model-1' THEN 'first/-x' WHEN model = 'model-2' THEN 'two/' ELSE 'pool/' || substr(model, 7) END AS deployment FROM log""")
def _(spark, d):
    patterns = spark.createDataFrame(PATTERNS, "pattern string, deployment string")
    return r.map_models(_log(spark, d), patterns).select("request_id", "model", "pattern", "deployment")


@query("jn11_map_models_many", "WITH p AS (SELECT DISTINCT p_name || '*' AS pattern, p_brand AS deployment FROM part), b AS (SELECT pattern, max(deployment) AS deployment FROM p GROUP BY 1), m AS (SELECT DISTINCT p_name || ' ' || p_type AS model FROM part) SELECT model, max_by(pattern, (length(pattern), pattern)) AS pattern, max_by(deployment, (length(pattern), pattern)) AS deployment FROM m JOIN b ON starts_with(model, left(pattern, length(pattern) - 1)) GROUP BY model")
def _(spark, d):
    """As many patterns as parts have names, each model the name and type of a part."""
    parts = b.read(spark, d, "part")
    patterns = parts.groupBy(F.concat("p_name", F.lit("*")).alias("pattern")).agg(F.max("p_brand").alias("deployment"))
    models = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("model")).distinct()
    return r.map_models(models, patterns).select("model", "pattern", "deployment")


@query("flt7_policy_match_many", with_(LOG, "p AS (SELECT 'c' || c_custkey AS policy, CASE WHEN c_custkey % 2 = 0 THEN 'key-' || (c_custkey % 50) ELSE 'key-' || (c_custkey % 7) || '%' END AS pk, CASE c_custkey % 3 WHEN 0 THEN 'model-' || (c_custkey % 9) ELSE '%' END AS pm, CASE WHEN c_custkey % 5 = 0 THEN ['view', 'k' || (c_custkey % 4)] ELSE CAST([] AS VARCHAR[]) END AS tags FROM customer)") + """SELECT policy, count(*) AS requests FROM log JOIN p ON api_key LIKE pk AND model LIKE pm AND (len(tags) = 0 OR list_has_any(request_tags, tags)) GROUP BY policy""")
def _(spark, d):
    """A policy for each customer."""
    c = F.col("c_custkey")
    policies = b.read(spark, d, "customer").select(
        F.concat(F.lit("c"), c.cast("string")).alias("policy"), F.lit("*").alias("p_team"),
        F.when(c % 2 == 0, F.concat(F.lit("key-"), (c % 50).cast("string"))).otherwise(F.concat(F.lit("key-"), (c % 7).cast("string"), F.lit("*"))).alias("p_key"),
        F.when(c % 3 == 0, F.concat(F.lit("model-"), (c % 9).cast("string"))).otherwise("*").alias("p_model"),
        F.when(c % 5 == 0, F.array(F.lit("view"), F.concat(F.lit("k"), (c % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("p_tags"),
    )
    contexts = _log(spark, d).select(F.col("request_id").alias("context_id"), F.col("team_id").alias("team"), F.col("api_key").alias("key"), "model", F.col("request_tags").alias("tags"))
    return r.policy_counts(contexts, policies).withColumnRenamed("contexts", "requests")


def _daily(spark, d):
    rows = _log(spark, d).groupBy("usage_date").agg(F.sum("prompt_tokens").alias("cached"), F.sum("completion_tokens").alias("compressed"), F.sum("k").alias("routed"))
    return rows


@query("wn1_cumulative_savings", with_(LOG, "d AS (SELECT usage_date, sum(prompt_tokens) AS cached, sum(completion_tokens) AS compressed, sum(k) AS routed FROM log WHERE usage_date >= DATE '2024-01-10' GROUP BY 1 UNION ALL SELECT DATE '2024-01-09', 0, 0, 0)") + f"SELECT {t('usage_date')} AS usage_date, {', '.join(n(f'sum({c}) OVER (ORDER BY usage_date)') + ' AS ' + c for c in ('cached', 'compressed', 'routed'))} FROM d")
def _(spark, d):
    return r.cumulative_savings(_daily(spark, d), ["cached", "compressed", "routed"], "2024-01-10")


@query("wn2_protected_turns", "SELECT conv_id, turn, role, role = 'system' OR (role IN ('user', 'assistant') AND turn = max(turn) OVER (PARTITION BY conv_id, role)) AS protected FROM conversations")
def _(spark, d):
    return r.protected_turns(b.read(spark, d, "conversations")).select("conv_id", "turn", "role", "protected")


_NAMES = """n AS (SELECT conv_id, turn, left(role, 1) || CASE turn % 4 WHEN 2 THEN '_2' WHEN 3 THEN '_2_2' ELSE '' END AS name FROM conversations),
g AS (SELECT conv_id, list(turn ORDER BY turn, name) AS turns, list_reduce(list_concat([{'name': '', 'used': CAST([] AS VARCHAR[])}], list({'name': name, 'used': CAST([] AS VARCHAR[])} ORDER BY turn, name)),
  lambda a, x: {'name': '', 'used': list_append(a.used, CASE WHEN list_contains(a.used, x.name) THEN x.name || '_' || list_filter(range(2, len(a.used) + 3), lambda c: NOT list_contains(a.used, x.name || '_' || c))[1] ELSE x.name END)}).used AS used
  FROM n GROUP BY conv_id)"""


@query("wn3_dedupe_names", with_(_NAMES) + "SELECT conv_id, unnest(turns) AS turn, unnest(used) AS unique_name FROM g")
def _(spark, d):
    """Names that collide with the suffixes given to others: u, u, u_2, a_2_2, …"""
    turn = F.col("turn") % 4
    name = F.concat(F.left("role", F.lit(1)), F.when(turn == 2, "_2").when(turn == 3, "_2_2").otherwise(""))
    return r.dedupe_names(b.read(spark, d, "conversations").withColumn("name", name), "conv_id", "name", "turn").select("conv_id", "turn", "unique_name")


@query("wn5_in_flight", with_(LOG, """e AS (SELECT model AS deployment, start_time AS tm, 1 AS d FROM log UNION ALL SELECT model, start_time + to_seconds(k * 60), -1 FROM log)""", "g AS (SELECT deployment, tm, d, sum(d) AS change FROM e GROUP BY 1, 2, 3)") + f"SELECT deployment, {n('epoch_us(tm)')} AS at_us, {n('change')} AS change, {n('sum(change) OVER (PARTITION BY deployment ORDER BY tm, d ROWS UNBOUNDED PRECEDING)')} AS in_flight FROM g")
def _(spark, d):
    log = _log(spark, d).select(F.col("model").alias("deployment"), "start_time", (F.col("start_time") + F.make_dt_interval(secs=F.col("k") * 60)).alias("end_time"))
    return r.in_flight(log).select("deployment", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "change", "in_flight")


@query("wn6_counter_delta", with_(LOG, "s AS (SELECT api_key AS series, usage_date, sum(k) % 500 AS value FROM log GROUP BY 1, 2)", "x AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY usage_date) AS p FROM s)") + f"SELECT series, {t('usage_date')} AS usage_date, {n('value')} AS value, {n('CASE WHEN value < p THEN value ELSE value - p END')} AS increase FROM x")
def _(spark, d):
    samples = _log(spark, d).groupBy(F.col("api_key").alias("series"), "usage_date").agg((F.sum("k") % 500).alias("value"))
    return r.counter_delta(samples)


def _repeated_sql(role: str, threshold: float, name: str) -> str:
    return f"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations WHERE role = '{role}'),
 p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, coalesce(CASE WHEN len(list_distinct(list_concat(w, b))) > 0 THEN len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) ELSE 0 END, 0) >= {threshold} AND b IS NOT NULL AS {name} FROM p"""


@query("wn7_misalignment", _repeated_sql("user", 0.45, "misaligned"))
def _(spark, d):
    return r.misalignment(b.read(spark, d, "conversations"))


@query("wn8_stagnation", _repeated_sql("assistant", 0.5, "stagnant"))
def _(spark, d):
    return r.stagnation(b.read(spark, d, "conversations"))


@query("wn9_tool_loops", with_(LOG, """c AS (SELECT "user" AS session_id, CAST(request_id AS BIGINT) AS seq, 'tool-' || (k % 2) AS tool FROM log)""", "i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - row_number() OVER (PARTITION BY session_id, tool ORDER BY seq) AS island FROM c)") + "SELECT session_id, tool, min(seq) AS first_seq, count(*) AS calls FROM i GROUP BY session_id, tool, island HAVING count(*) >= 3")
def _(spark, d):
    return r.tool_loops(_log(spark, d).select(F.col("user").alias("session_id"), F.col("request_id").cast("long").alias("seq"), _text("tool-", F.col("k") % 2).alias("tool")))


@query("wn10_satisfaction_credit", "SELECT conv_id, min(turn) AS credited_turn FROM conversations WHERE role = 'user' AND turn >= 3 AND regexp_matches(lower(text), 'that|der|que|los') GROUP BY 1")
def _(spark, d):
    return r.satisfaction_credit(b.read(spark, d, "conversations"), "that|der|que|los")


_TOOLS = "x AS (SELECT usage_date, unnest(list_distinct(tools)) AS tool, spend FROM log)"


@query("tk1_top_tools", with_(LOG, _TOOLS) + f"SELECT tool, {m('sum(spend)')} AS spend FROM x GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 3")
def _(spark, d):
    return r.top_tools(ag.tool_spend(_log(spark, d)), 3)


@query("tk2_tool_series", with_(LOG, _TOOLS) + f"""SELECT {t('usage_date')} AS usage_date, {m("coalesce(sum(spend) FILTER (tool = 'tool-3'), 0)")} AS "tool-3", {m("coalesce(sum(spend) FILTER (tool = 'tool-4'), 0)")} AS "tool-4" FROM x WHERE tool IN ('tool-3', 'tool-4') GROUP BY usage_date""")
def _(spark, d):
    return r.tool_series(ag.tool_spend(_log(spark, d)), ["tool-3", "tool-4"])


@query("tk3_top_routes", with_(LOG) + "SELECT CASE WHEN category = 'llm' THEN route ELSE category || ': ' || route END AS route, count(*) AS requests FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return r.top_routes(ag.count_requests(_log(spark, d)))


@query("tk4_top_scored", with_(LOG, 's AS (SELECT api_key AS query_id, CAST(request_id AS BIGINT) AS id, k AS score FROM log)') + f"SELECT query_id, id, {n('score')} AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) WHERE place <= 4")
def _(spark, d):
    return r.top_scored(_log(spark, d).select(F.col("api_key").alias("query_id"), F.col("request_id").cast("long").alias("id"), F.col("k").alias("score")), 4)


@query("set1_entity_scope", with_(LOG) + "SELECT request_id, CASE WHEN len(request_tags) = 0 THEN 'click,error,k1' ELSE array_to_string(list_filter(['click', 'error', 'k1'], lambda x: list_contains(request_tags, x)), ',') END AS scope FROM log")
def _(spark, d):
    asked = _log(spark, d).select("request_id", F.col("request_tags").alias("entities"))
    return r.entity_scope(asked, ["click", "error", "k1"]).select("request_id", F.array_join("scope", ",").alias("scope"))


@query("set2_canonical_spans", with_(LOG, """s AS (SELECT user AS doc_id, k % 10 AS "start", k % 10 + 5 AS "end", call_type AS cls, ['annotation', 'rule', 'model'][CAST(request_id AS BIGINT) % 3 + 1] AS origin FROM (SELECT *, "user" AS user FROM log))""") + f"""SELECT doc_id, {n('"start"')} AS "start", {n('"end"')} AS "end", cls, arg_max(origin, CASE origin WHEN 'annotation' THEN 3 WHEN 'rule' THEN 2 ELSE 1 END) AS origin FROM s GROUP BY 1, 2, 3, 4""".replace("GROUP BY 1, 2, 3, 4", 'GROUP BY doc_id, "start", "end", cls'))
def _(spark, d):
    k, kinds = F.col("k"), F.array(*[F.lit(o) for o in ("annotation", "rule", "model")])
    spans = _log(spark, d).select(F.col("user").alias("doc_id"), (k % 10).alias("start"), (k % 10 + 5).alias("end"), F.col("call_type").alias("cls"), F.element_at(kinds, (F.col("request_id").cast("long") % 3 + 1).cast("int")).alias("origin"))
    return r.canonical_spans(spans)


@query("set3_membership_changes", """WITH h AS (SELECT DISTINCT 'team-' || (c_custkey % 40) AS team_id, 'g' || (c_custkey % 7) AS group_id FROM customer), w AS (SELECT DISTINCT 'team-' || (c_custkey % 50) AS team_id, 'g' || (c_nationkey % 6) AS group_id FROM customer)
SELECT *, 'attach' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'detach' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""")
def _(spark, d):
    c, key = b.read(spark, d, "customer"), F.col("c_custkey")
    have = c.select(_text("team-", key % 40).alias("team_id"), _text("g", key % 7).alias("group_id")).distinct()
    want = c.select(_text("team-", key % 50).alias("team_id"), _text("g", F.col("c_nationkey") % 6).alias("group_id")).distinct()
    return r.membership_changes(have, want)


QUERIES, ORACLE_SQL = _ops, _sql
