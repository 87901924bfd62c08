"""Joins by wildcards, running sums and names where one key holds most rows, against plain versions."""

import random
import re
from collections import Counter

from meterline.operators import relations as r
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_of_one_key(spark):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        running_sums(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def running_sums(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else None, i // 3, i % 3, rng.randrange(-5, 9)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, at long, d int, v int").repartition(7)
    found = r.running_sum(df, "k", ["at", "d"], "v", "total")
    want, sums = [], {}
    for k, at, d, v in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        sums[k] = sums.get(k, 0) + v
        want.append((k, at, d, v, sums[k]))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    spread = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(x["count"] for x in spread) < 1_200
    assert r.running_sum(df.limit(0), "k", ["at", "d"], "v", "total").count() == 0


def names_by_hand(names):
    used = []
    for name in names:
        key, n = name, 2
        while key in used:
            key, n = f"{name}_{n}", n + 1
        used.append(key)
    return used


def test_names_are_unique(spark):
    assert names_by_hand(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    rng = random.Random(2)
    for _ in range(300):
        names = [rng.choice(["a", "a_2", "a_3", "a_2_2", "a_02", "a_1", "b_2", "a_", "_2", ""]) for _ in range(rng.randrange(1, 40))]
        fold = r.UsedNames()
        assert [fold.give(n) for n in names] == names_by_hand(names), names
    many = r.UsedNames()
    assert [many.give("x") for _ in range(50_000)][-1] == "x_50000" and len(many.next) == 1
    rows = [(c, i, n) for c in (1, 2, None) for i, n in enumerate(["a", "a", "a_2", None, "b", "b", "a"])]
    found = r.dedupe_names(spark.createDataFrame(rows, "c long, at long, name string").withColumn("x", F.lit(1)), "c", "name", "at")
    assert found.columns == ["c", "at", "name", "x", "unique_name"]
    got = {(x.c, x.at): x.unique_name for x in found.collect()}
    assert all([got[c, i] for i in range(7)] == ["a", "a_2", "a_2_2", None, "b", "b_2", "a_3"] for c in (1, 2, None))


def fits(pattern, value):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), value) is not None


def test_policies_by_prefix(spark):
    rng = random.Random(3)
    pattern = lambda: rng.choice(["*", "ab*", "a*c", "abc", "*c", "b*", ""])
    value = lambda: rng.choice([None, "", "abc", "ab", "abxc", "b", "bc"])
    policies = [(f"p{i}", pattern(), pattern(), pattern(), [pattern() for _ in range(rng.choice([0, 0, 1, 3]))]) for i in range(60)]
    policies += [("all", "*", "*", "*", []), ("none", None, "*", "*", []), ("tags", "*", "*", "*", ["a*", "ab*", "b"]), ("null tags", "*", "*", "*", None)]
    contexts = [(i, value(), value(), value(), rng.choice([None, [], ["abc"], ["b", "abc"], ["ab", "ab"]])) for i in range(80)]
    one = lambda p, v: p == "*" if v is None else fits(p, v)
    want = [
        (i, name) for i, *vs, tags in contexts for name, *ps, ptags in policies
        if None not in ps and all(map(one, ps, vs)) and (not ptags or any(fits(p, t) for t in tags or [] for p in ptags))
    ]
    c = spark.createDataFrame(contexts, "context_id long, team string, key string, model string, tags array<string>").withColumn("prefix", F.lit("clash"))
    p = spark.createDataFrame(policies, "policy string, p_team string, p_key string, p_model string, p_tags array<string>")
    found = r.policy_match(c, p)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert r.policy_match(c, p.limit(0)).count() == 0 and r.policy_match(c.limit(0), p).count() == 0
    per_policy = Counter(name for _, name in want)
    counts = r.policy_counts(c, p)
    assert {x.policy: x.contexts for x in counts.collect()} == per_policy
    assert "NestedLoop" not in plan_of(counts) and "Cartesian" not in plan_of(counts)
    assert r.policy_counts(c, p.limit(0)).count() == 0 and r.policy_counts(c.limit(0), p).count() == 0
    assert {x.policy: x.contexts for x in r.policy_counts(c.union(c), p.union(p)).collect()} == {k: 4 * n for k, n in per_policy.items()}


def test_alike_contexts_are_matched_once(spark):
    c = spark.range(1000).selectExpr("id AS context_id", "'t' AS team", "concat('k', id % 2) AS key", "cast(null AS string) AS model", "array('x') AS tags")
    p = spark.createDataFrame([("all", "*", "*", "*", []), ("one", "*", "k1", "*", ["x"])], "policy string, p_team string, p_key string, p_model string, p_tags array<string>")
    found = r.policy_match(c, p)
    assert {(x.policy, x["count"]) for x in found.groupBy("policy").count().collect()} == {("all", 1000), ("one", 500)}
    opened = [line for line in plan_of(found).splitlines() if "Generate explode" in line]
    assert opened and not any("context_id" in line for line in opened)


def test_contexts_and_counted_policies_are_never_broadcast(spark, tmp_path, monkeypatch):
    c = spark.range(5000).selectExpr("id AS context_id", "'t' AS team", "concat('k', id % 2) AS key", "cast(null AS string) AS model", "array('x') AS tags")
    c.write.parquet(f"{tmp_path}/contexts")
    c = spark.read.parquet(f"{tmp_path}/contexts")  # files small enough for Spark to broadcast
    p = spark.createDataFrame([("all", "*", "*", "*", []), ("one", "*", "k1", "*", ["x"])], "policy string, p_team string, p_key string, p_model string, p_tags array<string>")
    few = r.policy_match(c, p)
    plan = plan_of(few)
    assert "BuildLeft" not in plan and "SortMergeJoin" not in plan and not any("context_id" in line for line in plan.splitlines() if "Exchange" in line)
    p.write.parquet(f"{tmp_path}/policies")
    p = spark.read.parquet(f"{tmp_path}/policies")
    counts = r.policy_counts(c, p)
    assert "BuildLeft" not in plan_of(counts) and {x.policy: x.contexts for x in counts.collect()} == {"all": 5000, "one": 2500}
    monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
    many, counts = r.policy_match(c, p), r.policy_counts(c, p)
    assert "BroadcastHashJoin" not in plan_of(many) and "SortMergeJoin" in plan_of(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == sorted([(i, "all") for i in range(5000)] + [(i, "one") for i in range(1, 5000, 2)])
    assert "BroadcastHashJoin" not in plan_of(counts) and {x.policy: x.contexts for x in counts.collect()} == {"all": 5000, "one": 2500}


def test_patterns_take_line_ends(spark):
    df = spark.createDataFrame([("a\nb", "*"), ("a\nb", "a*"), ("a\nb", "*b"), ("a\nb", "a*b"), ("a\n", "a"), ("a.b", "a.*"), ("axb", "a.*"), ("a*", "a*"), ("ab", "a**b")], "v string, p string")
    assert [x[0] for x in df.select(r.fits_pattern(F.col("v"), F.col("p"))).collect()] == [True, True, True, True, False, True, False, True, True]


def test_models_by_prefix(spark):
    log = spark.createDataFrame([("gpt-4-turbo",), ("gpt-4",), ("x/gpt-4",), (None,), ("",)], "model string")
    patterns = spark.createDataFrame([("gpt-*", "a/*"), ("gpt-4*", "b/*"), ("*/gpt-4", "c/*"), ("*", "any")], "pattern string, deployment string")
    found = r.map_models(log, patterns)
    assert {x.model: x.deployment for x in found.collect()} == {"gpt-4-turbo": "b/-turbo", "gpt-4": "b/", "x/gpt-4": "c/x", None: None, "": "any"}
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
