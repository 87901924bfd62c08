"""Changes in place, batch files that are split, staged detection, codecs and state that ends."""

import datetime as dt
import glob
import json
import os
import random

import pandas as pd
import pytest
from meterline import shared
from meterline.operators import pii
from meterline.sources import files
from meterline.streaming import jobs
from pyspark.sql import functions as F

DAY = "usage_date date, model string, tokens long, request_id string"


def days(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), m, t, r) for d, m, t, r in rows], DAY)


def stored(spark, path):
    return sorted((r.usage_date.day, r.model, r.tokens, r.request_id) for r in spark.read.parquet(path).collect())


def parts(path):
    return {os.path.basename(f) for f in glob.glob(f"{path}/*/part-*")}


def upsert(delta, path, name):
    files.upsert_into(delta, path, ["usage_date", "model"], ["tokens"], "usage_date", name)


def test_upserts_touch_their_days_only(spark, tmp_path):
    path = str(tmp_path / "rollup")
    upsert(days(spark, [(1, "a", 5, "r1"), (1, "a", 2, None), (2, "b", 1, "r2")]), path, "one")
    assert stored(spark, path) == [(1, "a", 7, "r1"), (2, "b", 1, "r2")]
    before = glob.glob(f"{path}/usage_date=2024-01-01/part-*")
    upsert(days(spark, [(2, "b", 10, None), (3, "c", 4, "r3")]), path, "two")
    assert stored(spark, path) == [(1, "a", 7, "r1"), (2, "b", 11, "r2"), (3, "c", 4, "r3")]
    assert glob.glob(f"{path}/usage_date=2024-01-01/part-*") == before
    upsert(days(spark, [(2, "b", 10, None), (3, "c", 4, "r3")]), path, "two")  # repeated
    upsert(days(spark, []), path, "three")
    assert stored(spark, path) == [(1, "a", 7, "r1"), (2, "b", 11, "r2"), (3, "c", 4, "r3")]


@pytest.mark.parametrize("where", ["before complete", "before put in place", "half put in place", "before noted"])
def test_a_run_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, where):
    path, delta = str(tmp_path / "rollup"), days(spark, [(1, "a", 10, "x"), (2, "b", 10, "y")])
    upsert(days(spark, [(1, "a", 5, "r1"), (2, "b", 1, "r2"), (3, "c", 1, "r3")]), path, "one")

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    def half(df, path, by):
        real(df.where("model = 'a'"), path, by)
        broken()

    real = files.write_partitioned
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        if where == "before complete":
            m.setattr(files, "_fs", lambda s, p, fs=files._fs: broken() if p.endswith("two/_SUCCESS") and os.path.exists(f"{path}/_staging/two/rows") else fs(s, p))
        elif where == "before put in place":
            m.setattr(files, "_install", broken)
        elif where == "half put in place":
            m.setattr(files, "write_partitioned", half)
        else:
            m.setattr(files, "_fs", lambda s, p, fs=files._fs: broken() if p.endswith("_applied/two") and os.path.exists(f"{path}/_staging/two/_SUCCESS") else fs(s, p))
        upsert(delta, path, "two")
    for _ in range(2):  # the run is repeated
        upsert(delta, path, "two")
        assert stored(spark, path) == [(1, "a", 15, "x"), (2, "b", 11, "y"), (3, "c", 1, "r3")]
    assert not os.listdir(f"{path}/_staging")


def test_erasing_in_place(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = days(spark, [(1, "a", 1, "u"), (1, "b", 2, "v"), (2, "c", 3, "w"), (3, "d", 4, "u")])
    files.write_partitioned(rows, path)
    untouched = glob.glob(f"{path}/usage_date=2024-01-02/part-*")
    files.erase_from(spark, path, "usage_date", "request_id", spark.createDataFrame([("u",), (None,)], "request_id string"), "erase")
    assert stored(spark, path) == [(1, "b", 2, "v"), (2, "c", 3, "w")]
    assert glob.glob(f"{path}/usage_date=2024-01-02/part-*") == untouched and not os.path.exists(f"{path}/usage_date=2024-01-03")
    odd = str(tmp_path / "odd")
    table = spark.createDataFrame([("a/b:c", "u"), ("a/b:c", "v"), (None, "u"), (None, "v")], "k string, who string")
    files.write_partitioned(table, odd, "k")
    files.erase_from(spark, odd, "k", "who", spark.createDataFrame([("u",)], "who string"), "e")
    assert sorted(map(tuple, spark.read.parquet(odd).select("k", "who").collect()), key=str) == [("a/b:c", "v"), (None, "v")]


def test_batch_files_are_split(spark, tmp_path):
    rng = random.Random(8)
    objects = [{"id": i, "text": 'say "{[" \\ ' * rng.randrange(4), "list": [1, {"x": "]}"}]} for i in range(400)]
    text = "\n".join(json.dumps(o, indent=rng.choice([None, 1, 2])) + rng.choice(["", "\n\n", " "]) for o in objects)
    (tmp_path / "one.jsonl").write_text(text)
    (tmp_path / "two.jsonl").write_text('{"a": 1} {"b":\n 2}\n17\n"x"\n{"c": [1,\n2}\n{"d": 4}\n')
    (tmp_path / "three.jsonl").write_text('{"a": 1}\n{"b": 2\n' + "\n".join('{"never": "read"}' for _ in range(50)))
    (tmp_path / "four.jsonl").write_text('{"a": 1}\n}\n{"b": 2}')
    (tmp_path / "five.jsonl").write_text('{"a": "x\ny"}\n{"b": 2}')
    (tmp_path / "empty.jsonl").write_text("\n \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # a file is many tasks' work
        assert spark.read.text(str(tmp_path / "one.jsonl")).rdd.getNumPartitions() > 5
        found = files.read_batch_jsonl(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in sorted(found, key=lambda r: r.n):
        by.setdefault(os.path.basename(r.path), []).append(json.loads(r.request) if r.error is None else "fault")
    assert [r for r in by.pop("one.jsonl")] == objects
    assert by == {"two.jsonl": [{"a": 1}, {"b": 2}, 17, "x", "fault"], "three.jsonl": [{"a": 1}, "fault"], "four.jsonl": [{"a": 1}, "fault"], "five.jsonl": ["fault"]}
    assert files.read_batch_jsonl(spark, str(tmp_path / "empty.jsonl")).count() == 0


# Detection in stages


ROW = f"doc_id long, text string, spans array<{pii.SPAN}>"


def test_cascade(spark):
    def find(text):
        if "boom" in text:
            raise ValueError("down")
        return [("M", 6, 8, 0.9)]

    low, high = ("A", 0, 2, 0.3, "rules"), ("B", 3, 5, 0.9, "rules")
    rows = [(1, "ab cd ef", [low, high]), (2, "ab cd ef", [low]), (3, "ab cd ef", []), (4, "boom  ef", [low]), (5, "ab cd ef", None), (5, "ab cd ef", None)]
    df = spark.createDataFrame(rows, ROW).withColumn("error", F.when(F.col("doc_id") == 5, "rules down"))
    asked = []

    def model(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return pii.detect_each(rows, find, "model")

    run = lambda policy, closed: sorted(((r.doc_id, None if r.spans is None else [s.entity_type for s in r.spans], r.model_ran, r.error) for r in pii.cascade(df, policy, model, fail_closed=closed).collect()), key=str)
    assert run("low_confidence", True) == [
        (1, ["A", "B"], False, None), (2, ["A", "M"], True, None), (3, ["M"], True, None), (4, None, False, "ValueError: down"), (5, None, False, "rules down"), (5, None, False, "rules down"),
    ]
    assert asked == [["ab cd ef", "ab cd ef", "boom  ef"]]
    assert run("low_confidence", False) == [(1, ["A", "B"], False, None), (2, ["A", "M"], True, None), (3, ["M"], True, None), (4, ["A"], False, None), (5, [], False, None), (5, [], False, None)]
    assert [x[2] for x in run("never", True)] == [False] * 6 and [x[0] for x in run("on_miss", True) if x[2]] == [3]
    assert [x[0] for x in run("always", True) if x[2]] == [1, 2, 3]


def test_detection_is_kept(spark, tmp_path):
    kept, seen = str(tmp_path / "kept"), []

    def detector(df):
        seen.append(df.count())
        return pii.detect_rules(df)

    docs = spark.createDataFrame([(1, "a@b.org"), (2, "a@b.org"), (3, None), (4, "x"), (5, "")], "doc_id long, text string")
    run = lambda docs, *key: {r.doc_id: None if r.spans is None else len(r.spans) for r in pii.detect_once(docs, detector, *key, kept=kept).collect()}
    want = {1: 1, 2: 1, 3: None, 4: 0, 5: 0}
    assert run(docs, "v1") == want and run(docs, "v1") == want and seen == [3, 0]
    more = docs.union(spark.createDataFrame([(6, "c@d.org")], docs.schema))
    assert run(more, "v1") == want | {6: 1} and seen[-1] == 1
    for key in (("v2",), ("v1", "strict"), ("v1", "", "de/CH"), ("v1", "strict", "de/CH")):
        assert run(docs, *key) == want and run(docs, *key) == want and seen[-2:] == [3, 0], key


def test_handles_round_trip(spark):
    texts = [(1, 0, "mail a@b.org or c@d.org, not <EMAIL:aaaaaaaaaaaaaaaa>"), (1, 1, "again c@d.org"), (2, 0, "c@d.org"), (3, 0, None)]
    df = spark.createDataFrame(texts, "request_id long, text_no int, text string")
    rows = pii.detect_rules(df.select(F.struct("request_id", "text_no").alias("doc_id"), "text")).select("doc_id.*", "text", "spans")
    codec = pii.Handles()
    encoded, vault = pii.encode(rows, codec=codec)
    stored = {(r.request_id, r.value): r.token for r in vault.collect()}
    assert len(set(stored.values())) == 3 and all(len(t) == 24 and t.startswith("<EMAIL:") for t in stored.values())
    got = {(r.request_id, r.text_no): r.encoded for r in encoded.collect()}
    assert got[1, 1] == f"again {stored[1, 'c@d.org']}" and "@" not in "".join(t for t in got.values() if t)
    loose = encoded.withColumn("text", F.regexp_replace(F.lower("encoded"), "<email:", "< Email : "))
    assert {r.text_no: r.text for r in pii.decode(loose.where("request_id = 1"), vault, codec).collect()}[1] == "again c@d.org"
    back = pii.decode(encoded.withColumnRenamed("encoded", "text"), vault, codec)
    assert sorted((r.request_id, r.text_no, r.text) for r in back.collect()) == [t for t in texts if t[2]]
    # A value keeps its token; colliding draws are drawn again.
    again = {(r.request_id, r.value): r.token for r in pii.encode(rows, codec=pii.Handles(vault))[1].collect()}
    assert again == stored
    letter = lambda: F.element_at(F.array(*map(F.lit, "abcd")), (F.floor(F.rand() * 4) + 1).cast("int"))
    few = pii.Handles(draw=lambda: F.repeat(letter(), 16), most_rounds=200)
    drawn = {r.token for r in pii.encode(rows, codec=few)[1].collect()}
    assert len(drawn) == 3 and "<EMAIL:aaaaaaaaaaaaaaaa>" not in drawn
    with pytest.raises(ValueError, match="collide"):
        pii.encode(rows, codec=pii.Handles(draw=lambda: F.lit("e" * 16), most_rounds=3))


# State


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def limited(spark, path, out, checkpoint, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.session_limit(stream, 5, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_a_session_beyond_a_batch_and_state_that_is_dropped(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "session_id string, at long, seq long"
    write(spark, path, [("big", 10, i) for i in random.Random(1).sample(range(30_000), 30_000)] + [("small", 10, 0)], schema)
    limited(spark, path, out, checkpoint, schema)
    found = {(r.session_id, r.seq): (r.n, r.over) for r in spark.read.parquet(out).collect()}
    assert len(found) == 30_001 and all(found["big", i] == (i + 1, i >= 5) for i in range(30_000))
    rows = lambda q: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    # It goes on from the checkpoint: the count is still known.
    write(spark, path, [("big", 50, 30_000)], schema)
    held = rows(limited(spark, path, out, checkpoint, schema))
    assert {r.n for r in spark.read.parquet(out).where("seq = 30000").collect()} == {30_001}
    # An hour and the time to live later both sessions are forgotten, and one begins anew.
    write(spark, path, [("other", 9_000, 1)], schema)
    limited(spark, path, out, checkpoint, schema)
    write(spark, path, [("big", 9_001, 30_001)], schema)
    now = rows(limited(spark, path, out, checkpoint, schema))
    assert {r.n for r in spark.read.parquet(out).where("seq = 30001").collect()} == {1} and now <= held


def test_windows_leave_the_state(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "deployment string, start_time timestamp, tokens long"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for k in range(3):
        write(spark, path, [("d", at(60 * k + m), 1) for m in range(60)], schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = jobs.drain_closed(source, jobs.stream_load, "start_time", "load").collect()
    assert len(found) == 180 and all((r.tpm, r.rpm) == (1, 1) for r in found)
    query = jobs.stream_load(source).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12  # what the last ten minutes need


def test_staged_tables_are_cleared(spark):
    since = len(shared.staged_paths)
    tables = [shared.staged(spark.range(3), "clear") for _ in range(3)]
    paths = [p.removeprefix("file:") for p in shared.staged_paths[since:]]
    assert shared.clear_staged(spark, since, but=1) == 2
    assert [os.path.exists(p.replace("//", "/")) for p in paths] == [False, False, True] and tables[2].count() == 3
    assert shared.clear_staged(spark, since) == 1 and len(shared.staged_paths) == since


class Calls:
    """Stands for a stream's state and timers and notes what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.made = None, [], []

    def __getattr__(self, name):
        def call(*args):
            self.made.append(name)
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name == "listTimers":
                return iter(list(self.timers))
            elif name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return 0

        return call


def test_a_fold_asks_the_jvm_only_for_what_may_be_there():
    step = lambda state, row: ((row.seq,) if row.seq < 9 else None, (row.at, row.seq))
    fold, calls = jobs._Fold(step, lambda s: 50, "n long", ["key", "at", "seq"]), Calls()
    fold.handle = fold.state = calls

    def run(*frames):
        calls.made.clear()
        frames = (pd.DataFrame(f, columns=["at", "seq"]) for f in frames)
        return [tuple(r)[1:] for out in fold.handleInputRows(("k",), frames, Calls()) for r in out.itertuples(index=False)], list(calls.made)

    assert run([(3, 1), (1, 2), (1, 1)], [(2, 0)]) == ([(1, 1), (1, 2), (2, 0), (3, 1)], ["get", "update", "registerTimer"])
    assert calls.value == (1,) and len(calls.timers) == 1
    assert run([(7, 8), (6, 8)]) == ([(6, 8), (7, 8)], ["get", "listTimers", "deleteTimer", "update", "registerTimer"])
    assert len(calls.timers) == 1
    assert run([(8, 9)]) == ([(8, 9)], ["get", "listTimers", "deleteTimer", "clear"]) and calls.value is None and not calls.timers
    assert run([(9, 9)]) == ([(9, 9)], ["get"])
