"""Personal data and secrets: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pii, shapes, vault
from ..operators import relations as r
from ..shared import new_path
from ..sources import bindings as b
from .common import LOG, n, rnd, with_

_ops: dict = {}
_sql: dict = {}


def query(name: str, sql: str = ""):
    def add(f):
        _ops[name], _sql[name] = f, sql
        return f

    return add


_log = b.log_of
_docs = lambda spark, d: b.read(spark, d, "documents")
_text = lambda p, c: F.concat(F.lit(p), c.cast("string"))


def _flat(rows):
    """A row for each span, with its text."""
    s = rows.select("doc_id", "text", F.explode("spans").alias("s"))
    return s.select("doc_id", "s.*", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"))


@query("pi1_detect_rules")
def _(spark, d):
    return _flat(pii.detect_rules(_docs(spark, d)))


@query("pi1_email_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS emails FROM documents WHERE regexp_matches(text, '[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')")
def _(spark, d):
    mails = _flat(pii.detect_rules(_docs(spark, d))).where("entity_type = 'EMAIL'")
    return mails.groupBy("doc_id").agg(F.count("*").alias("emails"))


_H = "sha256(CAST(doc_id AS VARCHAR))"
_UUID = "left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query("pi2_detect_secrets", f"""WITH x AS (SELECT doc_id, length(text) AS n, {_H} AS h FROM documents) SELECT doc_id, 'npm' AS entity_type, n + 1 AS start, n + 41 AS "end", 1.0::DOUBLE AS score, 'secrets' AS detector, 'npm_' || left(h, 36) AS value FROM x
 UNION ALL SELECT doc_id, 'gitlab', n + 42, n + 68, 1.0::DOUBLE, 'secrets', 'glpat-' || left(h, 20) FROM x UNION ALL SELECT doc_id, 'heroku', n + 83, n + 119, 1.0::DOUBLE, 'secrets', {_UUID} FROM x""")
def _(spark, d):
    """The documents with three secrets, made of a hash, after each."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    uuid = F.concat_ws("-", F.left(h, F.lit(8)), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    text = F.concat("text", F.lit(" npm_"), F.left(h, F.lit(36)), F.lit(" glpat-"), F.left(h, F.lit(20)), F.lit(' heroku_key = "'), uuid, F.lit('"'))
    return _flat(pii.detect_secrets(_docs(spark, d).select("doc_id", text.alias("text"))))


@query("pi3_detect_regional", """WITH x AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS k FROM customer) SELECT c_custkey AS doc_id, 'SG_NRIC' AS entity_type, 'S' || k || 'D' AS value FROM x UNION ALL SELECT c_custkey, 'US_SSN', substr(k, 5, 3) || '-45-' || right(k, 4) FROM x""")
def _(spark, d):
    k = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    text = F.concat(F.lit("S"), k, F.lit("D of "), "c_name", F.lit(", ssn "), F.substring(k, 5, 3), F.lit("-45-"), F.right(k, F.lit(4)))
    return _flat(pii.detect_regional(b.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))).select("doc_id", "entity_type", "value")


@query("pi4_detect_gazetteer", r"""WITH names AS (SELECT DISTINCT regexp_extract(text, '^[\p{L}\p{N}_]+') AS name FROM conversations WHERE length(regexp_extract(text, '^[\p{L}\p{N}_]+')) >= 4),
 w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS name FROM documents) SELECT doc_id, name AS value, count(*) AS n FROM w JOIN names USING (name) GROUP BY ALL""")
def _(spark, d):
    """The words with which conversations begin as names."""
    first = F.regexp_extract("text", r"^[\p{L}\p{N}_]+", 0)
    names = b.read(spark, d, "conversations").select(first.alias("name"), F.lit("PERSON").alias("entity_type")).where("length(name) >= 4")
    found = _flat(pii.detect_gazetteer(_docs(spark, d), names)).where("entity_type = 'PERSON'")
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("pi5_map_labels", with_(LOG) + "SELECT request_id, CASE k % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'ORGANIZATION' WHEN 3 THEN 'EMAIL' END AS entity_type FROM log WHERE k % 5 < 4")
def _(spark, d):
    k = F.col("k") % 5
    label = F.when(k == 0, "B-PER").when(k == 1, "i_gpe").when(k == 2, "ORG").when(k == 3, "E-MAIL").otherwise("B-MISC")
    return pii.map_labels(_log(spark, d).select("request_id", F.when(k == 3, "E-MAIL").otherwise(label).alias("label"))).select("request_id", "entity_type")


@query("pi6_entity_scope", with_(LOG) + "SELECT request_id, CASE WHEN len(request_tags) = 0 THEN 'purchase,view' ELSE array_to_string(list_filter(['purchase', 'view'], lambda x: list_contains(request_tags, x)), ',') END AS scope FROM log")
def _(spark, d):
    asked = _log(spark, d).select("request_id", F.col("request_tags").alias("entities"))
    return r.entity_scope(asked, ["purchase", "view"]).select("request_id", F.array_join("scope", ",").alias("scope"))


def _log_spans(spark, d):
    """Spans whose number, score and place come from the log, over a text of 26 letters."""
    k, score = F.col("k"), F.col("k") / 100.0
    span = lambda name, start, length, by: F.struct(F.lit(name).alias("entity_type"), start.cast("int").alias("start"), (start + length).cast("int").alias("end"), score.alias("score"), F.lit(by).alias("detector"))
    spans = F.when(k % 4 == 0, F.array().cast(f"array<{pii.SPAN}>")).otherwise(F.array(span("A", k % 10, F.lit(5), "rules"), span("B", k % 7 + 8, F.lit(6), "model")))
    return _log(spark, d).select(F.col("request_id").alias("doc_id"), F.lit("ab cd efg hij  klmno p qrst uv").alias("text"), spans.alias("spans"), "k")


_STAGES = "k % 3 = 0 OR CASE WHEN k % 3 = 1 THEN k ELSE greatest(k, k * 7 % 100) END < 50"


def _staged_spans(spark, d):
    """Up to two spans of different scores over a text of 26 letters, and a model that fails where k ends in 0 or 5."""
    k = F.col("k")
    span = lambda name, start, score: F.struct(F.lit(name).alias("entity_type"), F.lit(start).alias("start"), F.lit(start + 3).alias("end"), (score / 100.0).alias("score"), F.lit("rules").alias("detector"))
    spans = F.slice(F.array(span("A", 0, k), span("B", 5, k * 7 % 100)), F.lit(1), k % 3)
    text = F.concat(F.lit("abcdefghijklmnopqrstuvwxyz"), k.cast("string"))

    def model(rows):
        def find(text):
            if text[-1] in "05":
                raise RuntimeError("down")
            return [("M", 10, 12, 0.9)]

        return pii.detect_each(rows, find, "model")

    return _log(spark, d).select(F.col("request_id").alias("doc_id"), text.alias("text"), spans.cast(f"array<{pii.SPAN}>").alias("spans")), model


def _cascaded(spark, d, fail_closed):
    rows, model = _staged_spans(spark, d)
    found = pii.cascade(rows, "low_confidence", model, fail_closed=fail_closed)
    return found.select("doc_id", F.coalesce(F.size("spans"), F.lit(-1)).alias("n_spans"), "model_ran", "error")


@query("pi7_cascade", with_(LOG) + f"SELECT request_id AS doc_id, {n(f'CASE WHEN ({_STAGES}) AND k % 5 = 0 THEN -1 ELSE k % 3 + CASE WHEN {_STAGES} THEN 1 ELSE 0 END END')} AS n_spans, ({_STAGES}) AND k % 5 <> 0 AS model_ran, CASE WHEN ({_STAGES}) AND k % 5 = 0 THEN 'RuntimeError: down' END AS error FROM log")
def _(spark, d):
    return _cascaded(spark, d, True)


@query("pi7_cascade_open", with_(LOG) + f"SELECT request_id AS doc_id, {n(f'k % 3 + CASE WHEN ({_STAGES}) AND k % 5 <> 0 THEN 1 ELSE 0 END')} AS n_spans, ({_STAGES}) AND k % 5 <> 0 AS model_ran, CAST(NULL AS VARCHAR) AS error FROM log")
def _(spark, d):
    return _cascaded(spark, d, False)


@query("pi8_windows_cover", "SELECT doc_id, 0::BIGINT AS first, CAST(length(text) AS BIGINT) AS last, true AS in_size FROM documents WHERE text <> ''")
def _(spark, d):
    """That the windows of a text reach from its beginning to its end without a gap, none over its size."""
    found = pii.windows(_docs(spark, d), 2000, 200)
    joins = F.collect_list(F.struct("window", "start", "end"))
    spans = found.groupBy("doc_id").agg(F.array_sort(joins).alias("w"), F.max(F.col("end") - F.col("start")).alias("longest"))
    apart = F.exists(F.transform("w", lambda x, i: (i > 0) & (x["start"] > F.element_at("w", F.greatest(i, F.lit(1)))["end"])), lambda gap: gap)
    return spans.select("doc_id", F.col("w")[0]["start"].alias("first"), F.array_max(F.transform("w", lambda x: x["end"])).alias("last"), ((F.col("longest") <= 2000) & ~apart).alias("in_size"))


@query("pi8_windows")
def _(spark, d):
    return pii.windows(_docs(spark, d), 2000, 200)


@query("pi9_shift_spans", with_(LOG, 'x AS (SELECT request_id AS doc_id, k * 3 AS ws, k * 3 + 20 AS we, 250 AS tl, k % 12 AS s, k % 12 + 9 AS e FROM log)') + f"""SELECT doc_id, {n('s + ws')} AS "start", {n('e + ws')} AS "end" FROM x WHERE NOT (s = 0 AND ws > 0) AND NOT (e = we - ws AND we < tl)""")
def _(spark, d):
    k = F.col("k")
    spans = _log(spark, d).select(F.col("request_id").alias("doc_id"), (k * 3).alias("w_start"), (k * 3 + 20).alias("w_end"), F.lit(250).alias("text_length"), (k % 12).alias("start"), (k % 12 + 9).alias("end"))
    return pii.shift_spans(spans).select("doc_id", "start", "end")


@query("pi10_trim_spans", """WITH x AS (SELECT doc_id, ' ' || text || '  ' AS own FROM documents) SELECT doc_id, """ + n("1 + length(own) - length(regexp_replace(own, '^\\s+', '')) - 1") + """ AS "start", """ + n("length(own) - (length(own) - length(regexp_replace(own, '\\s+$', '')))") + """ AS "end" FROM x WHERE trim(own) <> ''""")
def _(spark, d):
    span = F.struct(F.lit("A").alias("entity_type"), F.lit(0).alias("start"), (F.length("text") + 3).alias("end"), F.lit(1.0).alias("score"), F.lit("rules").alias("detector"))
    blank = F.struct(F.lit("B").alias("entity_type"), (F.length("text") + 1).alias("start"), (F.length("text") + 3).alias("end"), F.lit(1.0).alias("score"), F.lit("rules").alias("detector"))
    rows = _docs(spark, d).select("doc_id", F.array(span, blank).alias("spans"), F.concat(F.lit(" "), "text", F.lit("  ")).alias("text"))
    trimmed = rows.select("doc_id", F.explode(pii.trim_spans(F.col("spans"), F.col("text"))).alias("s"))
    return trimmed.select("doc_id", "s.start", "s.end")


@query("pi11_resolve_overlaps")
def _(spark, d):
    return _flat(_log_spans(spark, d).withColumn("spans", pii.resolve_overlaps(F.col("spans"))))


@query("pi12_coalesce_adjacent")
def _(spark, d):
    return _flat(_log_spans(spark, d).withColumn("spans", pii.coalesce_adjacent(pii.resolve_overlaps(F.col("spans")), F.col("text"))))


@query("pi13_merge_spans")
def _(spark, d):
    return _flat(pii.merge_spans(pii.detect(_docs(spark, d), [*shapes.RULES, *shapes.REGIONAL], "rules")))


@query("pi14_union_spans")
def _(spark, d):
    return _flat(_log_spans(spark, d).withColumn("spans", pii.union_spans(F.col("spans"))))


@query("pi15_value_registry", with_(LOG) + f"""SELECT sha256(lower(call_type)) AS value_id, lower(call_type) AS value, arg_max('c' || (k % 3), (CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END, 'c' || (k % 3))) AS cls, count(*) AS mentions FROM log GROUP BY 1, 2""")
def _(spark, d):
    k = F.col("k") % 3
    values = _log(spark, d).select(F.concat(F.lit(" "), F.upper("call_type")).alias("text"), _text("c", k).alias("cls"), F.when(k == 0, "annotation").when(k == 1, "rule").otherwise("model").alias("origin"))
    return pii.value_registry(values)


def _requests(spark, d):
    """Merged rule spans of the documents, ten of which make a request."""
    found = pii.merge_spans(pii.detect_rules(_docs(spark, d)))
    return found.select(F.floor(F.col("doc_id") / 10).alias("request_id"), F.col("doc_id").alias("text_no"), "text", "spans")


@query("pi16_encode")
def _(spark, d):
    return pii.encode(_requests(spark, d), {"IP": "MASK"})[0]


@query("wn4_token_ordinals", with_(LOG, """f AS (SELECT "user" AS request_id, call_type AS entity_type, model AS value, min(CAST(request_id AS BIGINT)) AS pos FROM log GROUP BY 1, 2, 3)""") + "SELECT request_id, entity_type, value, row_number() OVER (PARTITION BY request_id, entity_type ORDER BY pos, value) + CASE WHEN entity_type = 'click' THEN CASE WHEN row_number() OVER (PARTITION BY request_id, entity_type ORDER BY pos, value) >= 2 THEN 1 ELSE 0 END ELSE 0 END AS n FROM f")
def _(spark, d):
    values = _log(spark, d).select(F.col("user").alias("request_id"), "call_type", F.col("model").alias("value"), F.col("request_id").cast("long").alias("pos"))
    values = values.withColumn("entity_type", F.upper("call_type"))
    texts = values.select("request_id").distinct().withColumn("text", F.lit("literal <CLICK_2> and <PLAIN>"))
    found = pii.token_ordinals(values, texts)
    return found.select("request_id", F.lower("entity_type").alias("entity_type"), "value", "n")


@query("pi17_handle_tokens")
def _(spark, d):
    return pii.handle_tokens(pii.encode(_requests(spark, d))[1]).select("token", "request_id", F.length("handle").alias("length"))


@query("pi17_handle_round_trip", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    """Texts encoded by random handles and restored."""
    codec = pii.Handles()
    encoded, rows = pii.encode(_requests(spark, d), codec=codec)
    back = pii.decode(encoded.withColumnRenamed("encoded", "text"), rows, codec)
    return back.select(F.col("text_no").alias("doc_id"), F.sha2("text", 256).alias("digest"))


@query("pi18_find_tokens", with_(LOG) + "SELECT request_id, 'PERSON_' || k || ',MAIL_BOX_2' AS tokens FROM log")
def _(spark, d):
    text = F.concat(F.lit("see < person _"), F.col("k").cast("string"), F.lit(r" > and <MAIL\_box\_2>, not <x> or <A_>"))
    found = pii.find_tokens(text)
    return _log(spark, d).select("request_id", F.array_join(F.transform(found, lambda t: F.regexp_replace(t, "[<>]", "")), ",").alias("tokens"))


@query("pi19_decode", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    requests = _requests(spark, d)
    encoded, vault = pii.encode(requests)
    back = pii.decode(encoded.withColumnRenamed("encoded", "text"), vault)
    return back.select(F.col("text_no").alias("doc_id"), F.sha2("text", 256).alias("digest"))


@query("pi20_seal")
def _(spark, d):
    rows = pii.encode(_requests(spark, d))[1]
    return vault.unseal(vault.seal(rows, "0123456789abcdef"), "0123456789abcdef")


@query("pi20_round_trip", with_(LOG) + "SELECT '<V_' || request_id || '>' AS token, api_key AS request_id, call_type || ' ' || model AS value, true AS hidden FROM log")
def _(spark, d):
    rows = _log(spark, d).select(F.concat(F.lit("<V_"), "request_id", F.lit(">")).alias("token"), F.col("api_key").alias("request_id"), F.concat_ws(" ", "call_type", "model").alias("value"))
    sealed = vault.seal(rows, "0123456789abcdef").withColumn("hidden", ~F.contains("ciphertext", F.lit("model")))
    return vault.unseal(sealed, "0123456789abcdef").select("token", "request_id", "value", "hidden")


def _vault(spark, d):
    k = F.col("k")
    return _log(spark, d).select(
        _text("<V_", F.col("request_id")).alias("token"), F.col("api_key").alias("request_id"), F.col("call_type").alias("value"), F.col("user").alias("subject_id"),
        F.col("team_id").alias("session_id"), F.when(k % 3 != 0, F.col("start_time") + F.make_dt_interval(days=k % 10)).cast("timestamp").alias("expires_at"),
    )


@query("pi21_vault_search", with_(LOG) + "SELECT '<V_' || request_id AS token, call_type AS value FROM log WHERE api_key = 'key-3' AND contains(lower(call_type), 'purch')")
def _(spark, d):
    return vault.scan(_vault(spark, d), "key-3", "PURCH", "substring", 10_000_000).select("token", "value")


def _orders_vault(spark, d):
    """A token for each order, a third of them in one scope."""
    customers = b.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    value = F.concat_ws(" ", "c_name", F.concat("o_orderpriority", F.lit(" ")), "o_orderstatus")
    scope = F.when(F.col("o_orderkey") % 3 == 0, "all").otherwise(F.col("c_mktsegment"))
    return b.read(spark, d, "orders").join(customers, "o_custkey").select(_text("<O_", F.col("o_orderkey")).alias("token"), scope.alias("request_id"), value.alias("value"), "o_custkey")


_ORDERS = """v AS (SELECT '<O_' || o_orderkey AS token, CASE WHEN o_orderkey % 3 = 0 THEN 'all' ELSE c_mktsegment END AS request_id, c_name || ' ' || o_orderpriority || '  ' || o_orderstatus AS value, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _indexed(spark, d, queries, mode):
    """Hits by an index that has been written and read again."""
    path = new_path(spark, "vault-index")
    vault.index(_orders_vault(spark, d), "0123456789abcdef", [mode], path)
    return vault.search(vault.read_index(spark, path), queries, "0123456789abcdef", mode).select("query_id", "token", "request_id", "o_custkey")


def _asked(spark, d, query):
    """Every twentieth customer asks, in the scope of all."""
    return b.read(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.lit("all").alias("request_id"), query.alias("query"))


def _search_sql(query: str, fits: str) -> str:
    return with_(_ORDERS, f"q AS (SELECT c_custkey AS query_id, {query} AS query FROM customer WHERE c_custkey % 20 = 0)", r"f AS (SELECT *, regexp_replace(lower(value), '\s+', ' ', 'g') AS folded FROM v WHERE request_id = 'all')") + f"SELECT query_id, token, request_id, o_custkey FROM q JOIN f ON {fits}"


@query("pi21_search_exact", _search_sql("c_name || ' 5-LOW  P'", "value = query"))
def _(spark, d):
    return _indexed(spark, d, _asked(spark, d, F.concat("c_name", F.lit(" 5-LOW  P"))), "exact")


@query("pi21_search_normalized", _search_sql("lower(c_name || ' 2-HIGH F')", "folded = query"))
def _(spark, d):
    return _indexed(spark, d, _asked(spark, d, F.concat(F.lit(" "), F.upper("c_name"), F.lit("\t2-hígh  f"))), "normalized")


@query("pi21_search_substring", _search_sql("right(c_name, 3) || ' 5-low'", "contains(folded, query)"))
def _(spark, d):
    return _indexed(spark, d, _asked(spark, d, F.concat(F.right("c_name", F.lit(3)), F.lit(" 5-Low"))), "substring")


_VAULT = """v AS (SELECT '<V_' || request_id AS token, "user" AS subject_id, coalesce(team_id, '') AS session_id, CASE WHEN k % 3 <> 0 THEN start_time + to_days(k % 10) END AS expires_at FROM log)"""


@query("pi22_live", with_(LOG, _VAULT) + "SELECT token FROM v WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'")
def _(spark, d):
    return pii.live(_vault(spark, d), "2024-01-20").select("token")


@query("pi22_revoke_session", with_(LOG, _VAULT) + "SELECT token FROM v WHERE session_id NOT IN ('team-1', 'team-2')")
def _(spark, d):
    gone = spark.createDataFrame([("team-1",), ("team-2",)], "session_id string")
    return pii.erase(_vault(spark, d), "session_id", gone).select("token")


@query("pi22_export_subject", with_(LOG, _VAULT) + "SELECT token FROM v WHERE subject_id = '7'")
def _(spark, d):
    return pii.export_subject(_vault(spark, d), "7").select("token")


@query("pi23_activity_counts", with_(LOG) + f"SELECT tool AS entity_type, CASE WHEN k % 2 = 0 THEN 'MASK' ELSE 'ENCODE' END AS action, count(*) AS spans, {n('sum(k % 4)')} AS seen, {n('sum(k % 2)')} AS resolved FROM (SELECT k, unnest(tools) AS tool FROM log) GROUP BY 1, 2")
def _(spark, d):
    k = F.col("k")
    entities = F.transform("tools", lambda x: F.struct(x.alias("entity_type"), F.when(k % 2 == 0, "MASK").otherwise("ENCODE").alias("action")))
    return pii.activity_counts(_log(spark, d).select("request_id", entities.alias("entities"), (k % 4).alias("seen"), (k % 2).alias("resolved")))


def _sides(spark, d):
    k = F.col("k")
    log = _log(spark, d)
    expected = log.select(F.col("user").alias("doc_id"), (k % 20).alias("start"), (k % 20 + 4).alias("end"), F.col("call_type").alias("cls"))
    predicted = log.select(F.col("user").alias("doc_id"), ((k + 1) % 20).alias("start"), ((k + 1) % 20 + 4).alias("end"), F.col("call_type").alias("cls"))
    return expected, predicted


_STRICT = with_(LOG, """e AS (SELECT "user" AS u, k % 20 AS s, call_type AS cls, count(*) AS n FROM log GROUP BY 1, 2, 3)""", """p AS (SELECT "user" AS u, (k + 1) % 20 AS s, call_type AS cls, count(*) AS m FROM log GROUP BY 1, 2, 3)""",
 "x AS (SELECT coalesce(e.cls, p.cls) AS cls, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM e FULL JOIN p ON e.u = p.u AND e.s = p.s AND e.cls = p.cls)", "c AS (SELECT cls, sum(least(n, m)) AS tp, sum(m - least(n, m)) AS fp, sum(n - least(n, m)) AS fn FROM x GROUP BY 1)")
_RATIOS = f"{rnd('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END')} AS precision, {rnd('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END')} AS recall"


@query("pi24_score_strict", _STRICT + f"SELECT cls, {n('tp')} AS tp, {n('fp')} AS fp, {n('fn')} AS fn, {_RATIOS} FROM c")
def _(spark, d):
    return pii.score_strict(*_sides(spark, d))


@query("pi24_score_lenient")
def _(spark, d):
    return pii.score_lenient(*_sides(spark, d))


@query("pi25_merge_reports", _STRICT + f"SELECT cls, {n('2 * tp')} AS tp, {n('2 * fp')} AS fp, {n('2 * fn')} AS fn, {_RATIOS} FROM c")
def _(spark, d):
    one = pii.score_strict(*_sides(spark, d))
    return pii.merge_reports(one.union(one))


@query("pi26_detect_once", r"SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS emails, 'v1' AS version, 'strict' AS policy, 'de-CH' AS locale FROM documents")
def _(spark, d):
    """Detected once and kept; the second run takes what the first has kept."""
    kept = new_path(spark, "kept-spans")
    for _run in range(2):
        once = pii.detect_once(_docs(spark, d), pii.detect_rules, "v1", "strict", "de-CH", kept)
    return once.select("doc_id", F.size(F.filter("spans", lambda s: s["entity_type"] == "EMAIL")).cast("long").alias("emails"), "version", "policy", "locale")


@query("pi_detected_documents")
def _(spark, d):
    return pii.detected_documents(pii.detect_rules(_docs(spark, d)))


QUERIES, ORACLE_SQL = _ops, _sql
