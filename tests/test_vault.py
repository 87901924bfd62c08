"""The sealed vault and its blind index."""

import random
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from meterline.operators import relations, vault
from meterline.shared import new_path, staged_paths
from pyspark.sql import functions as F

KEY = "0123456789abcdef"
ROW = "token string, request_id string, value string, subject_id string"


def test_scan(spark):
    rows = [("r", "<P_1>", "Anna Bell"), ("r", "<P_2>", "anna bell"), ("r", "<P_3>", "Bob"), ("s", "<P_1>", "Anna Bell")]
    df = spark.createDataFrame(rows, "request_id string, token string, value string")
    tokens = lambda query, mode: sorted(r.token for r in vault.scan(df, "r", query, mode).collect())
    assert tokens("Anna Bell", "exact") == ["<P_1>"]
    assert tokens("ANNA BELL", "normalized") == ["<P_1>", "<P_2>"] and tokens("bell", "normalized") == []
    assert tokens("BELL", "part") == ["<P_1>", "<P_2>"]
    with pytest.raises(ValueError, match="candidates"):
        vault.scan(df, "r", "Bob", most=2)


def searched(spark, rows, queries, path=None):
    made = vault.index(spark.createDataFrame(rows, ROW), KEY)
    path = path or new_path(spark, "index")
    vault.write_index(made, path)
    asked = spark.createDataFrame(queries, "query_id long, request_id string, query string")
    made = vault.read_index(spark, path)
    return made, {m: sorted((r.query_id, r.token, r.request_id) for r in vault.search(made, asked, KEY, m).collect()) for m in vault.MODES}


def by_hand(rows, queries):
    plain = lambda t: __import__("unicodedata").normalize("NFKD", t)
    fold = lambda t: " ".join("".join(c for c in plain(t) if not __import__("unicodedata").combining(c)).casefold().split())
    fits = {"exact": lambda v, q: v == q, "normalized": lambda v, q: fold(v) == fold(q), "substring": lambda v, q: fold(q) in fold(v)}
    return {m: sorted((i, t, s) for i, scope, q in queries if q is not None for t, s, v, _ in rows if s is not None and s == scope and v is not None and f(v, q)) for m, f in fits.items()}


def test_search_equals_the_scan(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÀé ß") for _ in range(rng.randrange(1, 9)))
    rows = [(f"<T_{i}>", rng.choice(["hot", "hot", "cold"]), word(), "s") for i in range(400)]
    rows += [("<N>", "hot", None, "s"), ("<E>", "hot", "", "s"), ("<S>", None, "abc", "s")]
    queries = [(i, rng.choice(["hot", "cold", "none"]), rng.choice([word(), word()[:2], rows[i][2]])) for i in range(60)]
    queries += [(100, "hot", ""), (101, "hot", "  "), (102, "hot", "zzzz"), (103, "hot", None), (104, "cold", "A"), (105, "hot", "ẞ")]
    assert searched(spark, rows, queries)[1] == by_hand(rows, queries)


def test_rows_added_later_are_found(spark):
    path = new_path(spark, "index")
    first, second = [("<A>", "r", "Anna Bell", "s")], [("<B>", "r", "Annabel", "s"), ("<C>", "r", "Bob", "s")]
    searched(spark, first, [(1, "r", "x")], path)
    assert searched(spark, second, [(1, "r", "ANNA")], path)[1]["substring"] == [(1, "<A>", "r"), (1, "<B>", "r")]


def test_equal_values_share_postings_and_are_found_once(spark):
    """A value's postings don't grow with its rows, nor do its hits with the times it was added."""
    path, made = new_path(spark, "index"), None
    for part in ("A", "B"):
        rows = [(f"<{part}{i}>", "r", v, "s") for i in range(50) for v in (["Anna Bell", "ANNA  bell"][i % 2],)]
        made, hits = searched(spark, rows, [(1, "r", "nna"), (2, "r", "NNA"), (2, "r", "nna"), (3, "q", "nna")], path)
    assert made.postings.where("gram is not null").count() == 2 * len({"anna bell"[i : i + n] for n in (1, 2, 3) for i in range(10 - n)})
    assert sorted(q for q, *_ in hits["substring"]) == [1] * 100 + [2] * 200
    assert len(set(hits["substring"])) == 200


def test_an_index_for_exact_queries_has_no_postings(spark):
    path, asked = new_path(spark, "index"), spark.createDataFrame([(1, "r", "Anna")], "query_id long, request_id string, query string")
    df = spark.createDataFrame([("<A>", "r", "Anna", "s"), ("<B>", "r", "anna", "s")], ROW)
    vault.write_index(vault.index(df, KEY, ["exact"]), path)
    made = vault.read_index(spark, path)
    assert made.postings is None
    assert [r.token for r in vault.search(made, asked, KEY, "exact").collect()] == ["<A>"]
    assert sorted(r.token for r in vault.search(made, asked, KEY, "normalized").collect()) == ["<A>", "<B>"]
    with pytest.raises(ValueError, match="substrings"):
        vault.search(made, asked, KEY, "substring")
    with pytest.raises(ValueError, match="other modes"):
        vault.write_index(vault.index(df, KEY), path)


def test_what_is_stored_shows_no_value_and_no_key(spark):
    rows = [("<A>", "r", "Anna Bell", "s"), ("<B>", "r", "Anna Bell", "s"), ("<A>", "q", "Anna Bell", "s")]
    made, _ = searched(spark, rows, [(1, "r", "x")])
    stored = {(r.token, r.request_id): r for r in made.rows.collect()}
    assert "value" not in made.rows.columns and not any("Anna" in str(r) for r in stored.values())
    assert stored["<A>", "r"].exact_term == stored["<B>", "r"].exact_term != stored["<A>", "q"].exact_term
    assert len({r.ciphertext for r in stored.values()}) == 3
    sealed = vault.seal(spark.createDataFrame(rows, ROW), KEY)
    for df in (sealed, vault.unseal(sealed, KEY), vault.search(made, spark.createDataFrame([(1, "r", "x")], "query_id long, request_id string, query string"), KEY)):
        assert KEY not in df._jdf.queryExecution().toString()
    assert {r.value for r in vault.unseal(sealed, KEY).collect()} == {"Anna Bell"}
    assert {r.value for r in vault.unseal(sealed, KEY + "x").collect()} == {None}


def test_no_join_is_a_product(spark):
    made, _ = searched(spark, [("<A>", "r", "Anna Bell", "s")], [(1, "r", "x")])
    asked = spark.createDataFrame([(1, "r", "bel")], "query_id long, request_id string, query string").withColumn("value", F.lit("clash"))
    for mode in vault.MODES:
        plan = vault.search(made, asked, KEY, mode)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def size(path, name):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:"), name).rglob("*.parquet"))


def test_postings_take_less_than_half_of_the_rows(spark, tmp_path):
    """Each value has some 70 grams, each a few bits of a list and not a term of its own."""
    df = spark.range(20_000).selectExpr("concat('<T_', id, '>') AS token", "'r' AS request_id", "concat('Customer#', lpad(id * 7919 % 1000003, 9, '0'), ' 5-LOW  P') AS value", "'s' AS subject_id")
    vault.write_index(vault.index(df, KEY, ["substring"]), f"{tmp_path}/index")
    assert 0 < 2 * size(f"{tmp_path}/index", "postings") < size(f"{tmp_path}/index", "rows")


def test_an_index_in_place_is_written_once_and_counts_when_complete(spark, tmp_path):
    path, before = f"{tmp_path}/index", len(staged_paths)
    df = spark.createDataFrame([("<A>", "r", "Anna Bell", "s")], ROW)
    made = vault.index(df, KEY, path=path)
    assert len(staged_paths) == before and made.rows.inputFiles() and all("/index/rows/" in f for f in made.rows.inputFiles())
    vault._put(made.rows, path, "rows", "bunfinished")
    assert vault.read_index(spark, path).rows.count() == 1
    vault.index(df.withColumn("token", F.lit("<B>")), KEY, path=path)
    asked = spark.createDataFrame([(1, "r", "NNA")], "query_id long, request_id string, query string")
    hits = lambda: sorted(r.token for r in vault.search(vault.read_index(spark, path), asked, KEY, "substring").collect())
    assert hits() == ["<A>", "<B>"]
    with pytest.raises(ValueError, match="other modes"):
        vault.index(df, KEY, ["exact"], path)
    vault.write_index(vault.index(df.withColumn("token", F.lit("<C>")), KEY), path, "overwrite")
    assert hits() == ["<C>"] and size(path, "values") and len(list(Path(path, "values").glob("__batch=*"))) == 1


def test_lists_name_each_value_by_its_place(monkeypatch):
    rng = random.Random(3)
    ids = [*range(70, 100), 5, 6, *range(2**40, 2**40 + 30)]
    rows = [(i, rng.choice("rs"), "".join(rng.choice("ab é\U0010ffff\0") for _ in range(rng.randrange(0, 30)))) for i in ids]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 40])], ["id", "request_id", "text"]) for i in (0, 40)]
    for block, held in ((10_000, 1_000_000), (8, 1_000_000), (10_000, 50)):
        monkeypatch.setattr(vault, "BLOCK", block)
        monkeypatch.setattr(vault, "HELD", held)
        made = [r for b in vault._lists(SimpleNamespace(value=b"k"))(iter(batches)) for r in b.to_pylist()]
        assert all(r["n"] == len(r["places"]) and max(r["places"]) < block for r in made)
        found = sorted((r["gram"], r["first"] + p) for r in made for p in r["places"])
        assert found == sorted((vault._gram_key(b"k", s, g), i) for i, s, t in rows for g in vault._grams(t, (1, 2, 3)))


def test_search_without_broadcasts(spark, monkeypatch):
    rows = [(f"<T_{i}>", "hot" if i % 3 else "cold", f"Anna Bell {i % 40}", "s") for i in range(300)]
    queries = [(1, "hot", "Bell 3"), (2, "cold", "BELL 3"), (3, "hot", ""), (4, "none", "Bell"), (5, "hot", "l 39"), (6, "hot", "Bell 3")]
    monkeypatch.setattr(relations, "BROADCAST_BYTES", 0)
    assert searched(spark, rows, queries)[1] == by_hand(rows, queries)
