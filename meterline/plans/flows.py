"""Sources, sinks and streams: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import new_path, staged
from ..sources import bindings as b
from ..sources import files, policies
from ..streaming import jobs
from .common import LOG, m, n, t, with_

_ops: dict = {}
_sql: dict = {}


def query(name: str, sql: str = ""):
    def add(f):
        _ops[name], _sql[name] = f, sql
        return f

    return add


_log = b.log_of
_stream = lambda spark, d: b.usage_log(jobs.read_events(spark, d)).withColumn("start_time", F.col("start_time").cast("timestamp"))
_seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
_SECONDS = "CAST(floor(epoch(start_time)) AS BIGINT)"


@query("src1_usage_log", with_(LOG) + f"""SELECT request_id, {t('usage_date')} AS usage_date, "user", api_key, team_id, model, end_user, call_type, status, {m('spend')} AS spend, prompt_tokens, completion_tokens, cache_hit FROM log""")
def _(spark, d):
    return _log(spark, d).select("request_id", "usage_date", "user", "api_key", "team_id", "model", "end_user", "call_type", "status", "spend", "prompt_tokens", "completion_tokens", "cache_hit")


def _requests(spark, d):
    """The conversations as requests, with more fields than the library knows."""
    content = F.array(F.struct(F.lit("text").alias("type"), "text"))
    message = F.struct("role", content.alias("content"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("name"))
    tools = F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("look_up").alias("name")).alias("function")))
    body = F.struct(F.lit("old").alias("model"), F.lit(0.5).alias("temperature"), tools.alias("tools"), F.array(message).alias("messages"))
    return b.read(spark, d, "conversations").select(F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("custom_id"), F.struct("turn").alias("metadata"), F.lit("/v1/chat").alias("url"), body.alias("body"))).alias("value"))


def _batch_file(spark, d):
    """The conversations as batch files, objects spread over lines."""
    path = new_path(spark, "batch-files")
    _requests(spark, d).select(F.regexp_replace("value", '"body":', '"body":\n  ')).write.text(path)
    return path


def _custom_and_chars(found):
    return found.where("error is null").select(F.get_json_object("request", "$.custom_id").alias("custom_id"), F.length(F.get_json_object("request", "$.body.messages[0].content[0].text")).cast("long").alias("chars"))


@query("src2_read_batch_jsonl", "SELECT concat_ws('-', conv_id, turn) AS custom_id, length(text) AS chars FROM conversations")
def _(spark, d):
    return _custom_and_chars(files.read_batch_jsonl(spark, _batch_file(spark, d)))


@query("src2_read_batch_lines", "SELECT concat_ws('-', conv_id, turn) AS custom_id, length(text) AS chars FROM conversations")
def _(spark, d):
    path = new_path(spark, "batch-lines")
    _requests(spark, d).write.text(path)
    return _custom_and_chars(files.read_batch_lines(spark, path))


@query("src3_rewrite_batch_model", """SELECT CAST(json_object('custom_id', concat_ws('-', conv_id, turn), 'metadata', json_object('turn', turn), 'url', '/v1/chat',
 'body', json_object('model', 'new', 'temperature', 0.5::DOUBLE, 'tools', json_array(json_object('type', 'function', 'function', json_object('name', 'look_up'))),
 'messages', json_array(json_object('role', role, 'content', json_array(json_object('type', 'text', 'text', text)), 'name', 'conv' || conv_id)))) AS VARCHAR) AS request FROM conversations""")
def _(spark, d):
    return files.rewrite_batch_model(files.read_batch_jsonl(spark, _batch_file(spark, d)), "new").select("request")


@query("src4_html_chunks")
def _(spark, d):
    return files.html_chunks(b.read(spark, d, "pages"))


@query("src5_load_policy_table", "SELECT p_brand AS category, 'block' AS kind, lower(p_name) AS value, count(*) AS n FROM part GROUP BY 1, 2, 3")
def _(spark, d):
    """Category files made of the part table: a category for each brand."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.lower("p_name"))), lambda x: F.concat(F.lit('  - "'), x, F.lit('"'))), "\n")
    text = F.concat(F.lit('category_name: "'), "p_brand", F.lit('"\ndefault_action: "BLOCK"  # say no\n\nadditional_block_words:\n'), "lines")
    made = b.read(spark, d, "part").groupBy("p_brand").agg(lines.alias("lines")).select("p_brand", text.alias("value"))
    path = new_path(spark, "policies")
    made.write.option("lineSep", "\n").partitionBy("p_brand").text(path)
    rules = policies.load_policy_table(spark, path, "*.txt")
    return rules.groupBy("category", "kind", "value").agg(F.count("*").alias("n"))


@query("snk1_write_csv_export", with_(LOG) + f"SELECT request_id, {m('spend')} AS spend FROM log")
def _(spark, d):
    path = new_path(spark, "csv-export")
    files.write_csv_export(_log(spark, d).select("request_id", "spend"), path)
    return spark.read.schema("request_id string, spend double").option("header", True).csv(path)


@query("snk2_write_parquet_export", with_(LOG) + f"SELECT request_id, {m('spend')} AS spend FROM log")
def _(spark, d):
    path = new_path(spark, "parquet-export")
    files.write_parquet_export(_log(spark, d).select("request_id", "spend"), path)
    return spark.read.parquet(path)


@query("snk3_export_window", with_(LOG) + "SELECT request_id, 'usage_20240105_20240107' AS name FROM log WHERE start_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
def _(spark, d):
    path = files.window_path(new_path(spark, "windows"), "2024-01-05", "2024-01-07")
    files.write_parquet_export(files.export_window(_log(spark, d).withColumn("start_time", F.col("start_time").cast("timestamp")), "2024-01-05", "2024-01-07", "start_time").select("request_id"), path)
    return spark.read.parquet(path).withColumn("name", F.lit(path.rsplit("/", 1)[-1]))


@query("snk4_expire_partitions", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, count(*) AS n FROM log WHERE usage_date >= DATE '2024-01-20' GROUP BY usage_date")
def _(spark, d):
    path = new_path(spark, "days")
    files.write_partitioned(_log(spark, d).select("request_id", "usage_date"), path)
    files.expire_partitions(spark, path, "2024-01-20")
    return spark.read.parquet(path).groupBy("usage_date").agg(F.count("*").alias("n"))


@query("snk5_upsert_rollup", with_(LOG) + f"SELECT api_key, model, {n('sum(prompt_tokens)')} AS prompt_tokens, {m('sum(spend)')} AS spend, coalesce(max(request_id) FILTER (usage_date > DATE '2024-01-15' AND k % 50 <> 0), max(request_id) FILTER (usage_date <= DATE '2024-01-15')) AS request_id FROM log GROUP BY 1, 2")
def _(spark, d):
    keys, counters = ["api_key", "model"], ["prompt_tokens", "spend"]
    sums = lambda df, request: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], F.max(request).alias("request_id"))
    log, request = _log(spark, d), F.col("request_id")
    old = sums(log.where("usage_date <= date'2024-01-15'"), request)
    new = sums(log.where("usage_date > date'2024-01-15'"), F.when(F.col("k") % 50 != 0, request))
    return files.upsert_rollup(old, new, keys, counters)


@query("snk5_upsert_into", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, model, {n('sum(prompt_tokens)')} AS prompt_tokens, {m('sum(spend)')} AS spend FROM log GROUP BY 1, 2")
def _(spark, d):
    """The rollup by day as a table that three runs add to, one of them repeated."""
    path, log = new_path(spark, "upserted"), _log(spark, d).withColumn("request_id", F.lit(None).cast("string"))
    for i, part in enumerate(("usage_date <= date'2024-01-10'", "usage_date > date'2024-01-10' and k < 50", "usage_date > date'2024-01-10' and k >= 50", "false")):
        for _again in range(2 if i == 1 else 1):
            files.upsert_into(log.where(part), path, ["usage_date", "model"], ["prompt_tokens", "spend"], "usage_date", f"run-{i}")
    return spark.read.parquet(path).select("usage_date", "model", "prompt_tokens", "spend")


@query("pi22_erase_in_place", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, count(*) AS n FROM log WHERE \"user\" NOT IN ('7', '11') GROUP BY 1")
def _(spark, d):
    """The users that are to be forgotten erased from a table by day; days without them aren't touched."""
    path = new_path(spark, "erasable")
    files.write_partitioned(_log(spark, d).select("request_id", "user", "usage_date"), path)
    gone = spark.createDataFrame([("7",), ("11",)], "user string")
    files.erase_from(spark, path, "usage_date", "user", gone, "erase-1")
    return spark.read.parquet(path).groupBy("usage_date").agg(F.count("*").alias("n"))


# Streams


@query("st1_stream_rollup", with_(LOG) + f"SELECT {t('usage_date')} AS usage_date, api_key, {n('sum(prompt_tokens)')} AS prompt_tokens, {m('sum(spend)')} AS spend FROM log GROUP BY usage_date, api_key")
def _(spark, d):
    path, keys, counters = new_path(spark, "rollup"), ["usage_date", "api_key"], ["prompt_tokens", "spend"]
    jobs.rollup_into(_stream(spark, d), path, keys, counters, new_path(spark, "rollup-checkpoint")).awaitTermination()
    return jobs.rollup_at(spark, path, keys, counters)


@query("st2_stream_load", with_(LOG) + f"SELECT model AS deployment, strftime(date_trunc('minute', start_time), '%Y-%m-%d %H:%M:%S') AS start, {n('sum(prompt_tokens)')} AS tpm, count(*) AS rpm FROM log GROUP BY 1, 2")
def _(spark, d):
    log = _stream(spark, d).select(F.col("model").alias("deployment"), "start_time", F.col("prompt_tokens").alias("tokens"))
    return jobs.drain_closed(log, jobs.stream_load, "start_time", "load")


@query("st2_stream_load_sliding", with_(LOG, "w AS (SELECT model, prompt_tokens, date_trunc('hour', start_time) - to_hours(i) AS s FROM log, range(2) AS r(i))") + f"SELECT model AS deployment, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, {n('sum(prompt_tokens)')} AS tpm, count(*) AS rpm FROM w GROUP BY 1, 2")
def _(spark, d):
    log = _stream(spark, d).select(F.col("model").alias("deployment"), "start_time", F.col("prompt_tokens").alias("tokens"))
    return jobs.drain_closed(log, lambda x: jobs.stream_load(x, "2 hours", "1 hour"), "start_time", "sliding")


def _folded(who: str, where: str, start: str, step: str, made: str) -> str:
    """SQL that folds the rows of each ``who`` in order: ``step`` gives the state after row x from a, ``made`` what is put out with it."""
    return with_(LOG, f"""e AS (SELECT {who} AS session_id, {_SECONDS} AS sec, CAST(request_id AS BIGINT) AS seq FROM log WHERE {where})""",
     f"""g AS (SELECT session_id, list_reduce(list_concat([{{'sec': 0::BIGINT, 'seq': 0::BIGINT, 's': {start}, 'made': CAST([] AS STRUCT(seq BIGINT, v BIGINT)[])}}],
      list({{'sec': sec, 'seq': seq, 's': {start}, 'made': CAST([] AS STRUCT(seq BIGINT, v BIGINT)[])}} ORDER BY sec, seq)),
      lambda a, x: {{'sec': x.sec, 'seq': x.seq, 's': {step}, 'made': {made}}}).made AS made FROM e GROUP BY 1)""", "m AS (SELECT session_id, unnest(made) AS u FROM g)")


_OPEN = "a.s.n > 0 AND x.sec < a.s.first + 86400"


@query("st3_session_limit", _folded('"user"', "true", "{'first': 0::BIGINT, 'n': 0::BIGINT}",
 f"CASE WHEN {_OPEN} THEN {{'first': a.s.first, 'n': a.s.n + 1}} ELSE {{'first': x.sec, 'n': 1}} END",
 f"list_append(a.made, {{'seq': x.seq, 'v': CASE WHEN {_OPEN} THEN a.s.n + 1 ELSE 1 END}})") + 'SELECT session_id, u.seq AS seq, u.v AS n, u.v > 5 AS "over" FROM m')
def _(spark, d):
    events = _stream(spark, d).select(F.col("user").alias("session_id"), _seconds("start_time").alias("at"), F.col("request_id").cast("long").alias("seq"))
    return jobs.drain(jobs.session_limit(events, 5, 86_400), name="limit")


def _turns(log):
    return log.select(F.col("api_key").alias("tenant"), F.col("user").alias("session_id"), _seconds("start_time").alias("at"), F.col("request_id").cast("long").alias("seq"), F.when(F.col("k") % 10 == 0, F.concat(F.lit("r"), F.col("k").cast("string"))).alias("override"))


_STICKY = with_(LOG, f"""e AS (SELECT api_key AS tenant, "user" AS session_id, {_SECONDS} AS sec, CAST(request_id AS BIGINT) AS seq, CASE WHEN k % 10 = 0 THEN 'r' || k END AS o FROM log)""",
 "w AS (SELECT *, last_value(o IGNORE NULLS) OVER x AS lo, last_value(CASE WHEN o IS NOT NULL THEN sec END IGNORE NULLS) OVER x AS ls FROM e WINDOW x AS (PARTITION BY tenant, session_id ORDER BY sec, seq ROWS UNBOUNDED PRECEDING))") + "SELECT tenant, session_id, seq, CASE WHEN sec < ls + 90000 THEN lo END AS route FROM w"


@query("st4_sticky_route", _STICKY)
def _(spark, d):
    return jobs.sticky_route_batch(_turns(_log(spark, d)), 90_000)


@query("st4_sticky_route_stream", _STICKY)
def _(spark, d):
    return jobs.drain(jobs.sticky_route(_turns(_stream(spark, d)), 90_000), name="sticky")


@query("st5_hanging_requests", with_(LOG) + "SELECT request_id FROM log WHERE status = 'failure' AND epoch(TIMESTAMP '2024-01-30') - floor(epoch(start_time)) > 7200")
def _(spark, d):
    log = _log(spark, d)
    return jobs.hanging_requests(log, log.where("status = 'success'"), "2024-01-30", 7_200).select("request_id")


@query("st5_hanging_stream")
def _(spark, d):
    ended = _stream(spark, d).where("status = 'success'").withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 1 MINUTE"))
    return jobs.drain(jobs.stream_hanging(_stream(spark, d).select("request_id", "start_time"), ended, 5), name="hanging")


_NOW = f"CASE WHEN {_OPEN} THEN a.s.n + 1 ELSE 1 END"
_RESTS = f"({_NOW}) > 2 AND x.sec >= a.s.until"


@query("st6_stream_cooldown", _folded("api_key", "status = 'failure'", "{'first': 0::BIGINT, 'n': 0::BIGINT, 'until': 0::BIGINT}",
 f"{{'first': CASE WHEN {_OPEN} THEN a.s.first ELSE x.sec END, 'n': {_NOW}, 'until': CASE WHEN {_RESTS} THEN x.sec + 3600 ELSE a.s.until END}}",
 f"CASE WHEN {_RESTS} THEN list_append(a.made, {{'seq': x.seq, 'v': x.sec + 3600}}) ELSE a.made END") + "SELECT session_id, u.seq AS seq, u.v AS until FROM m")
def _(spark, d):
    failed = _stream(spark, d).where("status = 'failure'").select(F.col("api_key").alias("session_id"), _seconds("start_time").alias("at"), F.col("request_id").cast("long").alias("seq"))
    return jobs.drain(jobs.stream_cooldown(failed, 2, 86_400, 3_600), name="cooldown")


@query("st7_stream_sessions", with_(LOG, """g AS (SELECT *, CASE WHEN start_time < lag(start_time) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY "user" ORDER BY start_time))""", """s AS (SELECT *, sum(new) OVER (PARTITION BY "user" ORDER BY start_time, request_id ROWS UNBOUNDED PRECEDING) AS s FROM g)""") + f"""SELECT "user", {n('epoch_us(min(start_time))')} AS start_us, count(*) AS turns, {n('sum(prompt_tokens)')} AS tokens, {m('sum(spend)')} AS spend FROM s GROUP BY "user", s""")
def _(spark, d):
    log = _stream(spark, d).select("user", "start_time", F.col("prompt_tokens").alias("tokens"), "spend")
    return jobs.drain_closed(log, jobs.stream_sessions, "start_time", "sessions").select("user", F.unix_micros("start").alias("start_us"), "turns", "tokens", "spend")


@query("st8_stream_dedupe", with_(LOG) + "SELECT request_id FROM log")
def _(spark, d):
    log = _stream(spark, d).select("request_id", "start_time")
    twice = log.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.drain(jobs.stream_dedupe(twice), name="dedupe").select("request_id")


@query("st9_stream_detect")
def _(spark, d):
    path = f"{d}/documents.parquet"
    texts = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    found = jobs.drain(jobs.stream_detect(texts), name="detect")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query("st10_stream_decode", with_(LOG) + """SELECT "user" AS session_id, string_agg('a ' || call_type || ' b ', '' ORDER BY CAST(request_id AS BIGINT)) AS text FROM log GROUP BY 1""")
def _(spark, d):
    token = F.concat(F.lit("<CALL_"), "request_id", F.lit(">"))
    whole = F.concat(F.lit("a "), token, F.lit(" b "))
    cut = (F.col("k") % 9 + 1).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("p"), F.substring(whole, F.lit(1), cut).alias("text")), F.struct(F.lit(1).alias("p"), F.substring(whole, cut + 1, F.length(whole)).alias("text")))
    stream = _stream(spark, d).select("user", "request_id", F.col("call_type"), F.create_map(token, "call_type").alias("vault"), F.explode(parts).alias("x"))
    seq = F.col("request_id").cast("long") * 2 + F.col("x.p")
    fragments = stream.select(F.col("user").alias("session_id"), seq.alias("at"), seq.alias("seq"), "x.text", "vault", F.lit(False).alias("last"))
    out = staged(jobs.drain(jobs.stream_decode(fragments), name="decode"), "decoded")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return out.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


QUERIES, ORACLE_SQL = _ops, _sql
