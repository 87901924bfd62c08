"""Rows made by hand for queries that SQL can't express or the given tables hardly reach."""

import pytest
from meterline.functions import extensions
from meterline.functions import scalars as sc
from meterline.operators import pii
from meterline.operators import text as tx
from meterline.sources import files
from meterline.streaming import jobs
from pyspark.sql import functions as F


def found(df, texts):
    """(doc_id, entity, value) of all spans."""
    return {(r.doc_id, s.entity_type, texts[r.doc_id][s.start : s.end]) for r in df.collect() for s in r.spans}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets(spark):
    gitlab, stripe, npm = "glpat-" + "a1B2" * 5, "sk_" + "live_" + "a1" * 12, "npm_" + "Ab1x" * 9
    texts = [f"é {gitlab}.", f"key={stripe}", f"{npm} {gitlab}", "glpat-short", "x" + npm, ""]
    want = {(0, "gitlab", gitlab), (1, "stripe", stripe), (2, "npm", npm), (2, "gitlab", gitlab)}
    assert found(pii.detect_secrets(docs(spark, texts)), texts) == want


def test_regional(spark):
    texts = ["id S1234567D", "ssn 123-45-6789", "sin 046 454 286", "Singapore 238823", "12-345 S123D", "vat DE123456789"]
    want = {(0, "SG_NRIC", "S1234567D"), (1, "US_SSN", "123-45-6789"), (2, "CA_SIN", "046 454 286"), (3, "SG_POSTAL", "Singapore 238823"), (5, "EU_VAT", "DE123456789")}
    assert found(pii.detect_regional(docs(spark, texts)), texts) == want


def test_handles(spark):
    vault = spark.createDataFrame([(f"<A_{i}>", f"v{i}") for i in range(50)], "token string, value string")
    rows = pii.handle_tokens(vault).collect()
    assert len({r.handle for r in rows}) == 50 and all(len(r.handle) == 16 and int(r.handle, 16) >= 0 for r in rows)
    assert {(r.token, r.value) for r in rows} == {(f"<A_{i}>", f"v{i}") for i in range(50)}


def test_leaks(spark):
    pairs = [("1", " Anna BELL", "anna bell"), ("2", "Anna", "Anna Bell"), ("3", "xx Bell", "Anna Bell"), ("4", "zzz", "Anna Bell"), ("5", "", "Anna"), ("6", None, "Anna")]
    df = spark.createDataFrame(pairs, "value_id string, released string, original string")
    got = {r.value_id: r.reason for r in sc.leak_check(df.select("value_id", "released"), df.select("value_id", "original")).collect()}
    assert got == {"1": "equal", "2": "prefix", "3": "substring"}


def test_html_chunks(spark):
    pages = [(1, "<h1>A  b</h1><p>c<br>d &amp; e</p><script>x</script><p> </p>"), (2, None), (3, "<p>" + "y" * 4_001 + "</p>")]
    rows = files.html_chunks(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert sorted((r.page_id, r.chunk, r.text) for r in rows) == [(1, 0, "A b"), (1, 1, "c"), (1, 2, "d & e"), (3, 0, "y" * 4_000), (3, 1, "y")]


def test_splitters_of_sql_and_dataframes_agree(spark):
    extensions.register_splitters(spark)
    texts = docs(spark, ["para one.\n\n" + "word " * 60, "", "aa bb cc dd", "x" * 130])
    texts.createOrReplaceTempView("texts_to_split")
    cut = spark.sql("SELECT doc_id, s.chunk, s.text FROM texts_to_split, LATERAL split_text(text, 50, 10) s")
    want = tx.split_text(texts, 50, 10)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.select("doc_id", "chunk", "text").collect()))
    bounds = spark.sql("SELECT doc_id, w.n, w.start, w.end FROM texts_to_split, LATERAL text_windows(text, 50, 10) w")
    assert sorted((r.doc_id, r.start, r.end) for r in bounds.collect()) == sorted((r.doc_id, r.start, r.end) for r in pii.windows(texts, 50, 10).collect())


def streamed(spark, tmp_path, parts, schema):
    """The parts, lists of rows, as a stream of one file after the other."""
    path = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENTS = "session_id string, at long, seq long"


def test_session_limit(spark, tmp_path):
    parts = [[("s", 0, 1), ("s", 1, 2), ("t", 1, 1)], [("s", 2, 3), ("s", 200, 4)]]
    rows = jobs.drain(jobs.session_limit(streamed(spark, tmp_path, parts, EVENTS), 2, 100)).collect()
    assert sorted((r.session_id, r.seq, r.n, r.over) for r in rows) == [("s", 1, 1, False), ("s", 2, 2, False), ("s", 3, 3, True), ("s", 4, 1, False), ("t", 1, 1, False)]


def test_cooldown(spark, tmp_path):
    parts = [[("d", 0, 1), ("d", 5, 2)], [("d", 7, 3), ("d", 80, 4), ("d", 85, 5)]]
    rows = jobs.drain(jobs.stream_cooldown(streamed(spark, tmp_path, parts, EVENTS), 1, 10, 60)).collect()
    assert sorted((r.seq, r.until) for r in rows) == [(2, 65), (5, 145)]


def test_state_of_past_sessions_is_dropped(spark, tmp_path):
    parts = [[(f"s{i}", i, 1) for i in range(20)], [("t", 1_000_000, 1)], [("s0", 1_000_000, 2)]]
    limited = jobs.session_limit(streamed(spark, tmp_path, parts, EVENTS), 5, 100)
    out = str(tmp_path / "out")
    query = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    assert {(r.session_id, r.n) for r in spark.read.parquet(out).where("seq = 2").collect()} == {("s0", 1)}


def test_held_text_comes_out_when_its_session_ends(spark, tmp_path):
    kind = "session_id string, at long, seq long, text string, vault map<string,string>, last boolean"
    vault = {"<P_1>": "Anna"}
    parts = [[("s", 0, 0, "hi <P", vault, False), ("u", 0, 0, "a <P_", vault, False)], [("s", 1, 2, "_1> x", vault, False)], [("t", 1_000_000, 0, "end <", vault, True)]]
    rows = jobs.drain(jobs.stream_decode(streamed(spark, tmp_path, parts, kind), 60)).collect()
    text = {s: "".join(r.text for r in sorted(rows, key=lambda r: r.seq) if r.session_id == s) for s in "stu"}
    assert text == {"s": "hi Anna x", "t": "end <", "u": "a <P_"}


def test_hanging_stream(spark, tmp_path):
    at = "timestamp_seconds(1700000000 + {})".format
    started = streamed(spark, tmp_path / "a", [[("r1", 0), ("r2", 0), ("r3", 7_200)]], "request_id string, s long")
    ended = streamed(spark, tmp_path / "b", [[("r1", 60), ("r3", 7_200)]], "request_id string, s long")
    started = started.select("request_id", F.expr(at("s")).alias("start_time"))
    ended = ended.select("request_id", F.expr(at("s")).alias("end_time"))
    assert [r.request_id for r in jobs.drain(jobs.stream_hanging(started, ended, 5)).collect()] == ["r2"]


def test_streamed_detection_equals_the_batch(spark, tmp_path):
    texts = [(0, "mail a.b@ex.org"), (1, "10.0.0.1 and 10.0.0.2"), (2, None), (3, "")]
    kind = "doc_id long, text string"
    got = jobs.drain(jobs.stream_detect(streamed(spark, tmp_path, [texts[:2], texts[2:]], kind)))
    want = pii.merge_spans(pii.detect_rules(spark.createDataFrame(texts, kind)))
    rows = lambda df: sorted((r.doc_id, r.text, r.spans) for r in df.where("text is not null").collect())
    assert rows(got) == rows(want) and got.count() == 4
