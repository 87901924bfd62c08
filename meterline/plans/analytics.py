"""Text screening, retrieval, and conversation and model analytics: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extensions
from ..operators import models as md
from ..operators import text as tx
from ..sources import bindings as b
from ..sources import policies
from .common import LOG, m, n, rnd, with_

_ops: dict = {}
_sql: dict = {}


def query(name: str, sql: str = ""):
    def add(f):
        _ops[name], _sql[name] = f, sql
        return f

    return add


_log = b.log_of
_text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
_docs = lambda spark, d: b.read(spark, d, "documents")
_conv = lambda spark, d: b.read(spark, d, "conversations")

_SENT = r"""s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[.!?\n]+'), lambda x: trim(x) <> '') AS l FROM documents),
 st AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS sentence FROM s)"""


@query("tx1_screen_keywords", "SELECT doc_id, keyword, severity FROM documents, (VALUES ('idiot', 'high'), ('scum', 'medium'), ('pathetic', 'low')) AS k(keyword, severity) WHERE contains(lower(text), keyword)")
def _(spark, d):
    return tx.screen_keywords(_docs(spark, d), policies.sample_rules(spark), "insults")


_COND = "(contains(s, 'the') OR contains(s, 'this')) AND (contains(s, 'worthless') OR contains(s, 'stupid'))"


@query("tx2_screen_conditional", f"WITH {_SENT} SELECT doc_id, {n('sentence')} AS sentence, CASE WHEN contains(s, 'the') THEN 'the' ELSE 'this' END AS identifier, CASE WHEN contains(s, 'stupid') THEN 'stupid' ELSE 'worthless' END AS action FROM st WHERE {_COND}")
def _(spark, d):
    return tx.screen_conditional(_docs(spark, d), policies.sample_rules(spark), "insults").select("doc_id", "sentence", "identifier", "action")


@query("tx3_screen_phrases", f"WITH {_SENT} SELECT doc_id, {n('sentence')} AS sentence FROM st WHERE regexp_matches(s, '(?:(the|and) [a-z]+ing)')")
def _(spark, d):
    return tx.screen_phrases(_docs(spark, d), policies.sample_rules(spark), "insults").select("doc_id", "sentence")


@query("tx4_apply_exceptions", f"WITH {_SENT} SELECT doc_id, {n('sentence')} AS sentence FROM st WHERE {_COND} AND NOT contains(s, 'not')")
def _(spark, d):
    rules = policies.sample_rules(spark)
    return tx.apply_exceptions(tx.screen_conditional(_docs(spark, d), rules, "insults"), rules, "insults").select("doc_id", "sentence")


@query("tx5_competitor_intent", f"""WITH x AS (SELECT doc_id, lower(text) AS l FROM documents), y AS (SELECT *, (contains(l, 'thing')::INT + contains(l, 'tion')::INT + contains(l, 'erer')::INT) / 3 AS share FROM x)
SELECT doc_id, CASE WHEN NOT contains(l, 'that') THEN 'none' WHEN contains(l, 'idiot') THEN 'competitor' WHEN contains(l, 'shsh') THEN 'operational' WHEN share >= 0.6 THEN 'competitor' ELSE 'unclear' END AS intent, {rnd('share')} AS signal_share FROM y""")
def _(spark, d):
    return tx.competitor_intent(_docs(spark, d), ["that"], ["idiot"], ["shsh"], ["thing", "tion", "erer"])


@query("tx6_competitor_terms", "SELECT DISTINCT term FROM (SELECT lower(p_brand) AS term FROM part UNION ALL SELECT lower(split_part(p_name, ' ', 1)) FROM part) WHERE term <> 'brand#2'")
def _(spark, d):
    part = b.read(spark, d, "part")
    brands = part.select(F.concat(F.lit(" "), "p_brand", F.lit(" , "), F.split("p_name", " ")[0], F.lit(",")).alias("terms"))
    own = spark.createDataFrame([("Brand#2",)], "term string")
    return tx.competitor_terms(brands, own)


@query("tx7_confusion", f"""WITH x AS (SELECT toxic = 1 AS t, contains(lower(text), 'idiot') OR contains(lower(text), 'scum') AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM x)
SELECT *, {rnd('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {rnd('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {rnd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM c""")
def _(spark, d):
    low = F.lower("text")
    scored = b.read(spark, d, "labels").join(_docs(spark, d), "doc_id")
    return tx.confusion(scored.select(F.col("toxic").alias("truth"), (low.contains("idiot") | low.contains("scum")).cast("int").alias("predicted")))


@query("tx8_semantic_match", f"""WITH u AS (SELECT 'route-' || label AS route, arg_max(embedding, vec_id) AS u, CASE WHEN label % 2 = 0 THEN 0.35 END AS th FROM embeddings GROUP BY label),
 s AS (SELECT vec_id, route, th, round(list_dot_product(e.embedding::DOUBLE[], u::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(u::DOUBLE[], u::DOUBLE[]))), 9) AS score FROM embeddings e, u),
 x AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, route DESC, th DESC NULLS LAST) AS n FROM s)
SELECT vec_id, route, round(score, 6) AS score FROM x WHERE n = 1 AND score >= coalesce(th, 0.3)""")
def _(spark, d):
    vectors = b.read(spark, d, "embeddings")
    # A route for each label, its utterance the label's latest vector.
    latest = vectors.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("utterance"))
    routes = latest.select(_text("route-", F.col("label")).alias("route"), "utterance", F.when(F.col("label") % 2 == 0, 0.35).alias("route_threshold"))
    return tx.semantic_match(vectors, routes, 0.3).select("vec_id", "route", F.round("score", 6).alias("score"))


@query("tx9_cosine", f"""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine FROM p""")
def _(spark, d):
    v = b.read(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("tx10_bm25", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), l AS (SELECT *, len(w) AS len FROM t), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
 q(term, times) AS (VALUES ('that', 1), ('thing', 2), ('xyzzy', 1)),
 c AS (SELECT doc_id, len, term, times, len(list_filter(w, lambda x: x = term)) AS e, len(list_filter(w, lambda x: starts_with(x, term))) AS p FROM l, q),
 f AS (SELECT term, count(*) FILTER (e > 0) AS df FROM c GROUP BY 1),
 g AS (SELECT *, CASE WHEN e = 0 AND length(term) >= 4 THEN p ELSE e END AS tf FROM c)
SELECT doc_id, {rnd('sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)))')} AS score FROM g JOIN f USING (term), a GROUP BY 1 HAVING score > 0""")
def _(spark, d):
    return tx.bm25(_docs(spark, d), "that thing THING xyzzy")


@query("tx11_split_text")
def _(spark, d):
    return tx.split_text(_docs(spark, d), 1000, 100)


@query("tx12_head_tail", "SELECT doc_id, sha256(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 150) || chr(10) || '...' || chr(10) || right(text, 150) END) AS cut FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(tx.head_tail(F.col("text"), 300), 256).alias("cut"))


@query("udtf_split_text")
def _(spark, d):
    extensions.register_splitters(spark)
    _docs(spark, d).createOrReplaceTempView("texts_to_split")
    return spark.sql("SELECT doc_id, chunk, c.text FROM texts_to_split t, LATERAL split_text(t.text, 1000, 100) c")


@query("udf_guardrail", "SELECT doc_id, NOT contains(lower(text), 'idiot') AS passes FROM documents")
def _(spark, d):
    extensions.register_guardrail(spark, "polite", lambda t: "idiot" not in t.lower())
    return _docs(spark, d).select("doc_id", F.expr("polite(text)").alias("passes"))


@query("udf_detector", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{16}')) AS numbers FROM documents")
def _(spark, d):
    extensions.register_detector(spark, "long_numbers", [("NUMBER", "[0-9]{16}", None)])
    return _docs(spark, d).select("doc_id", F.size(F.expr("long_numbers(text)")).cast("long").alias("numbers"))


# Models

_CELLS = """c AS (SELECT 'router-' || (CAST("user" AS BIGINT) % 4) AS router, call_type AS request_type, model, k % 5 AS da, k % 3 AS db, CAST(request_id AS BIGINT) AS seq FROM log)"""


def _deltas(spark, d):
    return _log(spark, d).select(_text("router-", F.col("user").cast("long") % 4).alias("router"), F.col("call_type").alias("request_type"), "model", (F.col("k") % 5).cast("double").alias("delta_alpha"), (F.col("k") % 3).cast("double").alias("delta_beta"), F.col("request_id").cast("long").alias("seq"))


@query("md1_cold_start", f"SELECT p_partkey, {rnd('least(0.95, m) * 10')} AS alpha, {rnd('(1 - least(0.95, m)) * 10')} AS beta FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 ELSE 0.7 END + CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0 END AS m FROM part)")
def _(spark, d):
    models = b.read(spark, d, "part").select(F.col("p_partkey").alias("model"), F.lit("code").alias("request_type"), (F.col("p_size") % 3 + 1).alias("quality_tier"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("code"))).otherwise(F.array(F.lit("math"))).alias("strengths"))
    return md.cold_start(models).select(F.col("model").alias("p_partkey"), "alpha", "beta")


@query("md2_fold_bandit", with_(LOG, _CELLS) + f"SELECT router, request_type, model, {m('sum(da)')} AS alpha, {m('sum(db)')} AS beta FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    return md.fold_bandit(_deltas(spark, d))


@query("md3_apply_capped")
def _(spark, d):
    return md.apply_capped(_deltas(spark, d))


@query("md4_posterior", with_(LOG, _CELLS) + f"SELECT router, request_type, model, {rnd('CASE WHEN sum(da + db) > 0 THEN sum(da) / sum(da + db) ELSE 0.5 END')} AS mean, {n('greatest(0, sum(da + db) - 10)')} AS samples FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    return md.posterior(md.fold_bandit(_deltas(spark, d)))


@query("md5_thompson_rank")
def _(spark, d):
    cells = md.fold_bandit(_deltas(spark, d)).select(*md.CELL, (F.col("alpha") + 1).alias("alpha"), (F.col("beta") + 1).alias("beta"), F.length("model").cast("double").alias("cost"))
    return md.thompson_rank(cells, 7)


@query("md6_signal_delta", f"""WITH lng AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4),
 w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations WHERE role IN ('user', 'assistant')), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM w),
 f AS (SELECT conv_id, count(*) FILTER (b IS NOT NULL AND len(list_intersect(w, b)) / greatest(1, len(list_distinct(list_concat(w, b)))) >= CASE role WHEN 'user' THEN 0.45 ELSE 0.5 END AND len(list_concat(w, b)) > 0) AS c FROM p GROUP BY 1),
 h AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND turn >= 3 AND regexp_matches(lower(text), 'that|der')),
 l AS (SELECT conv_id, count(*) AS c FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), 'idiot|thsh') GROUP BY 1),
 t0 AS (SELECT conv_id, turn AS seq, 'tool' || (turn // 4) AS tool FROM conversations), t AS (SELECT conv_id, count(*) AS c FROM (SELECT conv_id, tool FROM t0 GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
 x AS (SELECT conv_id, count(*) AS c FROM conversations WHERE role = 'assistant' AND length(text) < 200 GROUP BY 1)
SELECT conv_id, CASE WHEN h.conv_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS delta_alpha, {m('coalesce(f.c, 0) + coalesce(l.c, 0) + coalesce(x.c, 0) + 0.5 * coalesce(t.c, 0)')} AS delta_beta
FROM lng LEFT JOIN f USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN t USING (conv_id) LEFT JOIN x USING (conv_id)""")
def _(spark, d):
    conv = _conv(spark, d)
    calls = conv.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), _text("tool", F.floor(F.col("turn") / 4)).alias("tool"))
    failures = conv.where((F.col("role") == "assistant") & (F.length("text") < 200)).select("conv_id")
    return md.signal_delta(conv, calls, failures, "that|der", "idiot|thsh")


@query("md7_session_snapshot", with_(LOG) + f"""SELECT "user" AS session_id, call_type AS router, model, arg_max(k, (start_time, CAST(request_id AS BIGINT))) AS state, {n('epoch_us(max(start_time))')} AS at_us FROM log GROUP BY 1, 2, 3""".replace("arg_max(k, (start_time, CAST(request_id AS BIGINT)))", n("arg_max(k, (start_time, CAST(request_id AS BIGINT)))")))
def _(spark, d):
    turns = _log(spark, d).select(F.col("user").alias("session_id"), F.col("call_type").alias("router"), "model", F.col("k").alias("state"), F.col("start_time").alias("at"), F.col("request_id").cast("long").alias("seq"))
    return md.session_snapshot(turns).select("session_id", "router", "model", "state", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


@query("md8_router_sessions", with_(LOG, """x AS (SELECT "user" AS session_id, *, lag(model) OVER (PARTITION BY "user" ORDER BY CAST(request_id AS BIGINT)) AS before, row_number() OVER (PARTITION BY "user", model ORDER BY CAST(request_id AS BIGINT)) > 1 AS seen FROM log)""", "y AS (SELECT *, CASE WHEN model = before THEN 'same' WHEN seen THEN 'return' ELSE 'first' END AS kind, cache_hit = 'True' AS hit FROM x)") + f"""SELECT session_id, count(*) AS turns, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND kind = 'same') AS same_hits, count(*) FILTER (hit AND kind = 'first') AS first_hits, count(*) FILTER (hit AND kind = 'return') AS return_hits,
 {n('sum(prompt_tokens)')} AS tokens, {m('sum(spend)')} AS spend FROM y GROUP BY 1""")
def _(spark, d):
    turns = _log(spark, d).select(F.col("user").alias("session_id"), F.col("request_id").cast("long").alias("seq"), "model", "cache_hit", F.col("prompt_tokens").alias("tokens"), "spend")
    return md.router_sessions(turns)


def _load(spark, d):
    return md.load_by_minute(_log(spark, d).select(F.col("model").alias("deployment"), "start_time", F.col("prompt_tokens").alias("tokens")))


@query("md9_load_by_minute", with_(LOG) + f"SELECT model AS deployment, strftime(date_trunc('minute', start_time), '%Y-%m-%d %H:%M:%S') AS minute, {n('sum(prompt_tokens)')} AS tpm, count(*) AS rpm FROM log GROUP BY 1, 2")
def _(spark, d):
    return _load(spark, d)


@query("md10_least_used", with_(LOG, "l AS (SELECT model AS deployment, sum(prompt_tokens) AS tpm, count(*) AS rpm FROM log WHERE start_time >= TIMESTAMP '2024-01-03 10:00' AND start_time < TIMESTAMP '2024-01-03 12:00' GROUP BY 1)",
 "p AS (SELECT DISTINCT 'group-' || (i % 2) AS grp, 'model-' || i AS deployment, 20000 - 1000 * i AS tl, 30 + i AS rl FROM range(8) AS t(i))") + """SELECT grp AS "group", arg_min(deployment, (coalesce(tpm, 0), deployment)) AS deployment FROM p LEFT JOIN l USING (deployment) WHERE coalesce(tpm, 0) + 500 <= tl AND coalesce(rpm, 0) + 1 < rl GROUP BY 1""")
def _(spark, d):
    log = _log(spark, d).where("start_time >= timestamp'2024-01-03 10:00:00' and start_time < timestamp'2024-01-03 12:00:00'")
    load = log.groupBy(F.col("model").alias("deployment")).agg(F.sum("prompt_tokens").alias("tpm"), F.count("*").alias("rpm"))
    i = F.col("id")
    limits = spark.range(8).select(_text("group-", i % 2).alias("group"), _text("model-", i).alias("deployment"), (20000 - 1000 * i).alias("tpm_limit"), (30 + i).alias("rpm_limit"))
    return md.least_used(load, limits, 500)


@query("md11_unhealthy", with_(LOG) + "SELECT request_id FROM log WHERE status = 'failure' AND epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(start_time)) <= 36000")
def _(spark, d):
    states = _log(spark, d).select("request_id", (F.col("status") == "success").alias("healthy"), F.col("start_time").alias("checked_at"))
    return md.unhealthy(states, "2024-01-30 12:00:00", 36_000).select("request_id")


@query("md12_cooldowns", with_(LOG, "x AS (SELECT api_key AS deployment, floor(epoch(start_time)) + CASE WHEN k % 2 = 0 THEN k * 600 ELSE 60 END AS until FROM log WHERE status = 'failure' AND start_time < TIMESTAMP '2024-01-15')") + f"SELECT deployment, {n('max(until) - epoch(TIMESTAMP $$2024-01-15 00:00:00$$)')} AS seconds_left FROM x GROUP BY 1 HAVING max(until) > epoch(TIMESTAMP '2024-01-15 00:00:00')")
def _(spark, d):
    failures = _log(spark, d).where("status = 'failure' and start_time < timestamp'2024-01-15'").select(F.col("api_key").alias("deployment"), F.col("start_time").alias("failed_at"), F.when(F.col("k") % 2 == 0, F.col("k") * 600).alias("cooldown_s"))
    return md.cooldowns(failures, "2024-01-15 00:00:00")


@query("md13_user_costs", with_(LOG, 'x AS (SELECT "user", model, sum(spend) AS c FROM log GROUP BY 1, 2)') + f"""SELECT "user", {m('sum(c)')} AS cost, count(*) AS models, {m('max(c)')} AS dearest FROM x GROUP BY 1""")
def _(spark, d):
    found = md.user_costs(_log(spark, d))
    return found.select("user", "cost", F.size("model_cost").cast("long").alias("models"), F.array_max(F.map_values("model_cost")).alias("dearest"))


@query("md14_router_benchmark", with_(LOG, "x AS (SELECT CASE WHEN k < 20 THEN 0 WHEN k < 60 THEN 1 WHEN k < 90 THEN 2 END AS bucket, k % 7 = 0 AS expired FROM log)", "g AS (SELECT bucket, count(*) AS n, count(*) FILTER (expired) AS e FROM x WHERE bucket IS NOT NULL GROUP BY 1)") + f"SELECT {n('bucket')} AS bucket, {n('round(n * 100.0::DOUBLE / sum(n) OVER ())')} AS percent, {rnd('sum(e) OVER () * 100.0::DOUBLE / sum(n) OVER ()', 4)} AS expired_percent FROM g")
def _(spark, d):
    turns = _log(spark, d).select(F.when(F.col("k") < 90, md.bucket(F.col("k"), [20, 60, 90])).alias("bucket"), (F.col("k") % 7 == 0).alias("expired"))
    return md.router_benchmark(turns)


QUERIES, ORACLE_SQL = _ops, _sql
