"""Cases for spans, tokens, vault and evaluation."""

import pytest
from meterline.operators import models as md
from meterline.operators import pii
from meterline.operators import text as tx
from meterline.operators import vault as vault_ops
from meterline.streaming import jobs
from pyspark.sql import functions as F

ROW = f"doc_id long, text string, spans array<{pii.SPAN}>"


def spans(spark, text, *given):
    return spark.createDataFrame([(1, text, [(e, a, b, s, d) for e, a, b, s, d in given])], ROW)


def flat(df):
    return [(s.entity_type, s.start, s.end, s.score) for s in df.collect()[0].spans]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([("A", 0, 2, 0.5, "model"), ("B", 3, 5, 0.5, "model")], [("A", 0, 2, 0.5), ("B", 3, 5, 0.5)]),
        ([("A", 0, 9, 0.5, "model"), ("B", 3, 5, 0.9, "model")], [("B", 3, 5, 0.9)]),  # the surer
        ([("A", 0, 5, 0.9, "model"), ("B", 3, 8, 0.9, "rules")], [("B", 3, 8, 0.9)]),  # rules first
        ([("A", 0, 5, 0.9, "rules"), ("B", 3, 9, 0.9, "rules")], [("B", 3, 9, 0.9)]),  # the longer
        ([("A", 0, 3, 0.9, "rules"), ("B", 3, 6, 0.9, "rules")], [("A", 0, 3, 0.9), ("B", 3, 6, 0.9)]),  # touching
        ([], []),
    ],
)
def test_overlaps(spark, given, want):
    df = spans(spark, "x" * 10, *given)
    assert flat(df.withColumn("spans", pii.resolve_overlaps(F.col("spans")))) == want
    assert flat(df.withColumn("spans", pii.resolve_overlaps(F.reverse("spans")))) == want


def test_merge(spark):
    text = " Ánna  Bell, Jo"
    given = [("PERSON", 0, 6, 0.9, "model"), ("PERSON", 6, 11, 0.7, "model"), ("PERSON", 5, 7, 0.1, "model"), ("PERSON", 13, 15, 0.8, "model")]
    assert flat(pii.merge_spans(spans(spark, text, *given))) == [("PERSON", 1, 5, 0.9), ("PERSON", 7, 11, 0.7), ("PERSON", 13, 15, 0.8)]
    near = [("PERSON", 1, 5, 0.9, "model"), ("PERSON", 6, 11, 0.7, "model")]
    assert flat(pii.merge_spans(spans(spark, " Anna Bell, Jo", *near))) == [("PERSON", 1, 11, 0.7)]


def test_union(spark):
    given = [("A", 0, 4, 1.0, "model"), ("B", 2, 8, 1.0, "rule"), ("C", 8, 9, 1.0, "model"), ("D", 7, 8, 1.0, "model")]
    found = flat(spans(spark, "x" * 10, *given).withColumn("spans", pii.union_spans(F.col("spans"))))
    assert [s[:3] for s in found] == [("B", 0, 8), ("C", 8, 9)]


FAKE = {"AWS_KEY": "AKIA" + "A1" * 8, "GITHUB_TOKEN": "ghp_" + "a1" * 18, "SLACK_TOKEN": "xoxb-" + "1a" * 8, "JWT": "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "MODEL_KEY": "sk-" + "ab1" * 8}


def test_rules_find_valid_shapes_only(spark):
    good = {"IBAN": "DE89 3704 0044 0532 0130 00", "AHV": "756.9217.0769.85", "CARD": "4111 1111 1111 1111", "EMAIL": "a.b+c@ex-ample.org", "PHONE": "+41 79 123 45 67", "IP": "10.0.255.1", **FAKE}
    bad = ["DE89 3704 0044 0532 0130 01", "756.9217.0769.84", "4111 1111 1111 1112", "a@b", "300.1.1.1", "AKIA123"]
    docs = [(i, f"é {v} .") for i, v in enumerate(good.values())] + [(100 + i, f"é {v} .") for i, v in enumerate(bad)] + [(200, None), (201, "")]
    found = {x.doc_id: x for x in pii.detect_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (name, value) in enumerate(good.items()):
        assert (name, 2, 2 + len(value)) in [(s.entity_type, s.start, s.end) for s in found[i].spans], name
    for i, value in enumerate(bad):
        assert not [s for s in found[100 + i].spans if s.end - s.start >= len(value)], value
    assert found[200].spans == [] and found[201].spans == []


def test_round_trip_shares_tokens_and_passes_over_taken_numbers(spark):
    texts = [(1, 0, "mail a@b.org or c@d.org, not <EMAIL_1>"), (1, 1, "again c@d.org from 10.0.0.1"), (2, 0, "c@d.org"), (3, 0, None)]
    df = spark.createDataFrame(texts, "request_id long, text_no int, text string")
    key = F.struct("request_id", "text_no")
    rows = pii.detect_rules(df.select(key.alias("doc_id"), "text")).select("doc_id.*", "text", "spans")
    encoded, vault = pii.encode(rows, {"IP": "MASK"})
    got = {(x.request_id, x.text_no): x.encoded for x in encoded.collect()}
    assert got == {(1, 0): "mail <EMAIL_2> or <EMAIL_3>, not <EMAIL_1>", (1, 1): "again <EMAIL_3> from <IP>", (2, 0): "<EMAIL_1>", (3, 0): None}
    loose = encoded.where("request_id = 1 and text_no = 0").select("request_id", "text_no", F.lit(r"x < email _2 > y <EMAIL\_3> z <EMAIL_9>").alias("text"))
    assert pii.decode(loose, vault).collect()[0].text == "x a@b.org y c@d.org z <EMAIL_9>"
    assert pii.encode(rows, {"EMAIL": "BLOCK"})[0].count() == 1
    sealed = vault_ops.seal(vault, "0123456789abcdef")
    assert "value" not in sealed.columns
    moved = vault_ops.unseal(sealed.withColumn("request_id", F.lit(9)), "0123456789abcdef")
    assert {x.value for x in moved.collect()} == {None}
    assert sorted(x.value for x in vault_ops.unseal(sealed, "0123456789abcdef").collect()) == ["a@b.org", "c@d.org", "c@d.org"]


@pytest.mark.parametrize(("text", "size", "overlap"), [("abc", 10, 2), ("a" * 95, 10, 9), ("a" * 30, 10, 12), ("one two three\n\nfour five. six " * 9, 40, 7)])
def test_windows_cover_the_text(text, size, overlap):
    found = pii.window_bounds(text, size, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(b - a <= size for a, b in found)
    assert all(c <= b for (_, b), (c, _) in zip(found, found[1:]))


def test_evaluation(spark):
    kind = "doc_id long, start int, end int, cls string"
    expected = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "A"), (2, 0, 3, "B")], kind)
    predicted = spark.createDataFrame([(1, 0, 5, "A"), (1, 0, 5, "A"), (1, 11, 13, "A"), (3, 0, 1, "C")], kind)
    strict = {x.cls: (x.tp, x.fp, x.fn, x.precision, x.recall) for x in pii.score_strict(expected, predicted).collect()}
    lenient = {x.cls: (x.tp, x.fp, x.fn, x.precision, x.recall) for x in pii.score_lenient(expected, predicted).collect()}
    assert strict == {"A": (1, 2, 1, 0.333333, 0.5), "B": (0, 0, 1, 1.0, 0.0), "C": (0, 1, 0, 0.0, 1.0)}
    assert lenient == {"A": (2, 1, 0, 0.666667, 1.0), "B": (0, 0, 1, 1.0, 0.0), "C": (0, 1, 0, 0.0, 1.0)}


def test_capped_deltas_drop_what_would_pass(spark):
    deltas = spark.createDataFrame([("r", "t", "m", i, a, 0.0) for i, a in enumerate([150.0, 60.0, 50.0, 1.0])], "router string, request_type string, model string, seq int, delta_alpha double, delta_beta double")
    found = md.apply_capped(deltas.repartition(4)).collect()[0]
    assert (found.alpha, found.dropped) == (200.0, 2)


def test_draws_repeat(spark):
    cells = spark.createDataFrame([("r", "t", f"m{i}", 1.0 + i, 2.0, 1.0) for i in range(5)], "router string, request_type string, model string, alpha double, beta double, cost double")
    assert md.thompson_rank(cells.repartition(3), 5).collect() == md.thompson_rank(cells.coalesce(1), 5).collect()


def test_splitting():
    text = "para one.\n\n" + "word " * 60 + "\nline\n" + "x" * 130
    chunks = tx.split_recursively(text, 50, 10)
    assert tx.split_recursively("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"] and tx.split_recursively("", 5, 0) == []
    bare = lambda t: "".join(t.split())
    assert all(0 < len(c) <= 50 and bare(c) in bare(text) for c in chunks)
    assert bare(chunks[-1]) in bare(text)[-60:] and len(bare("".join(chunks))) >= len(bare(text))


def test_overlap_must_be_smaller_than_size(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="overlap"):
        tx.split_text(docs, 10, 10)
    assert [(x.start, x.end) for x in pii.windows(docs, 10, 10).collect()] == [(0, 1)]


def test_stream_state_gives_the_same_in_one_batch_or_many(spark, tmp_path):
    rows = [("s", t, i, None if i % 3 else f"r{i}") for i, t in enumerate([0, 5, 10, 50, 200, 201, 500])]
    kind = "session_id string, at long, seq long, override string"
    df = spark.createDataFrame(rows, kind).withColumn("tenant", F.lit("t"))
    want = sorted(map(tuple, jobs.sticky_route_batch(df, 100).collect()))
    for parts in (1, 4):
        path = str(tmp_path / f"in{parts}")
        for i in range(parts):
            df.where(F.col("seq") * parts >= i * 7).where(F.col("seq") * parts < (i + 1) * 7).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = str(tmp_path / f"out{parts}")
        q = jobs.sticky_route(stream, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).select("tenant", "session_id", "seq", "route").collect())) == want
