"""Cases for usage operators whose meaning a single oracle query doesn't settle."""

import datetime as dt
import tracemalloc
from decimal import Decimal

import pyarrow as pa
import pytest
from meterline.functions import pricing as pr
from meterline.functions import scalars as sc
from meterline.operators import aggregates as ag
from meterline.operators import relations as r
from meterline.operators import text
from meterline.plans import scalars
from meterline.sources import files, policies
from pyspark.sql import functions as F


def one(df):
    return df.collect()[0]


def test_a_cached_failure_is_subtracted_twice(spark):
    log = spark.createDataFrame([("", "True", "failure", 5), ("a", "False", "success", 7)], "call_type string, cache_hit string, status string, completion_tokens long")
    rows = {x.call_type: x for x in ag.cache_activity(log).collect()}
    assert rows["Unknown"].api_requests == -1 and rows["Unknown"].cached_completion_tokens == 5
    assert rows["a"].api_requests == 1 and rows["a"].generated_completion_tokens == 7
    empty = one(ag.cache_totals(ag.cache_activity(log.limit(0))))
    assert (empty.api_requests, empty.hit_ratio) == (0, 0.0)


@pytest.mark.parametrize("parts", [1, 8])
def test_rollup_merges_null_and_empty_keys_in_any_order(spark, parts):
    kind = "usage_date date, team string, api_key string, model string, provider string, mcp_namespaced_tool_name string, endpoint string, model_group string, order_key long, line int, " + ", ".join([*(f"{c} decimal(18,6)" for c in ag.ROLLUP_MONEY), *(f"{c} long" for c in ag.ROLLUP_COUNTERS)])
    day, money = dt.date(2024, 1, 1), Decimal("0.1")
    rows = [(day, t, "k", None, "p", None if i else "", "e", f"g{i}", i, 0, money, money, None, money, *[1] * 7, None) for i, t in enumerate([None, "", None])]
    for order in (rows, rows[::-1]):
        found = one(ag.daily_rollup(spark.createDataFrame(order, kind).repartition(parts), "team"))
        assert (found.team, found.api_requests, found.spend, found.model_group) == ("", 3, Decimal("0.3"), "g0")
        assert (found.mcp_namespaced_tool_name, found.compression_saved_tokens, found.prompt_caching_savings_spend) == ("", 0, 0)


def test_upsert_keeps_the_old_request_where_the_new_is_null(spark):
    kind = "k string, n long, request_id string"
    old = spark.createDataFrame([("a", 1, "r1"), ("b", 2, "r2")], kind)
    new = spark.createDataFrame([("a", 10, None), ("b", 20, "r9"), ("c", 30, None)], kind)
    found = {x.k: (x.n, x.request_id) for x in files.upsert_rollup(old, new, ["k"], ["n"]).collect()}
    assert found == {"a": (11, "r1"), "b": (22, "r9"), "c": (30, None)}


@pytest.mark.parametrize(
    ("day", "spend", "limit", "projected", "exceeds"),
    [
        ("2024-02-15", 140.0, 100.0, 280.0, "2024-02-15"),  # leap year, already over
        ("2023-02-15", 140.0, 200.0, 270.0, "2023-02-21"),
        ("2024-01-01", 10.0, 100.0, 310.0, "2024-01-10"),  # first of the month
        ("2024-01-10", 9.0, 100.0, None, None),  # within the limit
        ("2024-01-10", 9.0, None, None, None),
        ("2024-01-10", 0.0, -1.0, 0.0, "2024-01-10"),  # nothing spent, negative limit
    ],
)
def test_month_end(spark, day, spend, limit, projected, exceeds):
    df = spark.createDataFrame([(dt.date.fromisoformat(day), spend, limit)], "as_of date, current_spend double, soft_limit double")
    found = one(sc.month_end_projection(df))
    assert found.projected_spend == projected and (str(found.exceed_date) if found.exceed_date else None) == exceeds


def test_tier_edges(spark):
    tiers = spark.createDataFrame([("m", 0, 100, 1.0), ("m", 100, 200, 2.0)], "model string, range_start long, range_end long, rate double")
    usage = spark.createDataFrame([("m", 100), ("m", 101), ("m", 999), ("m", 0), ("x", 5)], "model string, tokens long")
    assert [x.rate for x in sorted(r.tier_price(usage, tiers).collect(), key=lambda x: (x.model, x.tokens))] == [None, 1.0, 2.0, 2.0, None]


def test_model_patterns(spark):
    patterns = spark.createDataFrame([("a/*::x::*", "d-*/*"), ("a/*", "w/*"), ("b.c", "plain$"), ("*", "any")], "pattern string, deployment string")
    log = spark.createDataFrame([("a/1::x::2",), ("a/z",), ("b.c",), ("b.cd",), ("bxc",)], "model string")
    found = {x.model: x.deployment for x in r.map_models(log, patterns).collect()}
    assert found == {"a/1::x::2": "d-1/2", "a/z": "w/z", "b.c": "any", "b.cd": "any", "bxc": "any"}  # the star has more operators than b.c


def test_capital_keywords_never_match(spark):
    texts = spark.createDataFrame([("A Clown and an IDIOT",)], "text string")
    assert one(r.banned_keywords(texts, ["Clown", "idiot"])).hits == ["idiot"]


def test_underscore_aliases_never_match(spark):
    df = spark.createDataFrame([("vertex_ai",), ("bedrock",), (None,)], "p string")
    names = [x.n for x in df.select(sc.resource_name(F.col("p"), F.lit(" A--b! "), F.lit("m/1")).alias("n")).collect()]
    assert names == ["czrn:gateway:vertex-ai:cross-region:a-b:llm-usage:m/1", "czrn:gateway:aws:cross-region:a-b:llm-usage:m/1", None]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Write me a python script", "code_generation"), ("build a tiny little api now", "code_generation"), ("explain this function", "code_understanding"),
        ("design a billing system", "technical_design"), ("Suppose x is 3", "analytical_reasoning"), ("draft an EMAIL to Bo", "writing"),
        ("what is it", "factual_lookup"), ("hello", "general"), ("", "general"), ("x" * 2000 + " write a python", "general"),
    ],
)
def test_prompt_classes(spark, text, name):
    assert one(spark.range(1).select(sc.classify_prompt(F.lit(text)).alias("c"))).c == name


@pytest.mark.parametrize(
    ("value", "iban", "card", "ahv"),
    [
        ("DE89 3704 0044 0532 0130 00", True, False, False), ("DE89 3704 0044 0532 0130 01", False, False, False),
        ("4111 1111 1111 1111", False, True, False), ("4111 1111 1111 1112", False, False, False),
        ("756.9217.0769.85", False, False, True), ("756.9217.0769.84", False, False, False), ("", False, False, False),
    ],
)
def test_checksums(spark, value, iban, card, ahv):
    v = F.lit(value)
    found = one(spark.range(1).select(sc.iban_ok(v).alias("i"), sc.luhn_ok(v).alias("c"), F.coalesce(sc.ahv_ok(v), F.lit(False)).alias("a")))
    assert (found.i, found.a) == (iban, ahv) and (not card or found.c)


def test_masks_and_paths(spark):
    df = spark.createDataFrame([('{"api_key": "abcdefghijkl", "cost_key": "abcdefghijkl", "n": {"token": ["xy"]}}', "abcdefghijkl")], "j string, s string")
    found = one(df.select(sc.mask_json()(F.col("j")).alias("j"), sc.mask_secret(F.col("s")).alias("s"), sc.get_path(F.col("j"), "n.token").alias("p"), sc.get_path(F.col("j"), "a.b", "d").alias("q")))
    assert found.j == '{"api_key": "abcd****ijkl", "cost_key": "abcdefghijkl", "n": {"token": ["**"]}}'
    assert (found.s, found.p, found.q) == ("abcd****ijkl", '["xy"]', "d")


def test_normalization(spark):
    rows = [("EMAIL", " Ab@EXAMPLE.Org", "Ab@example.org"), ("PHONE", "079 123 45 67", "+41791234567"), ("PHONE", "0049 30 1", "+49301"), ("IBAN", "de89 3704", "DE893704"), ("NAME", "ＡB​c", "abc")]
    df = spark.createDataFrame(rows, "c string, v string, want string")
    assert all(x.got == x.want for x in df.select(sc.normalize_value(F.col("c"), F.col("v")).alias("got"), "want").collect())
    assert one(spark.range(1).select(sc.normalize_search(F.lit("  Édouard  STRAßE ")).alias("x"))).x == "edouard strasse"


def test_price_defaults(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0, None, None, None)], "model string, input_rate double, output_rate double, cache_read_rate double, cache_write_rate double, reasoning_rate double")
    log = spark.createDataFrame([("m", 10, 5, 4, None, 2), ("m", 1, 0, 4, 0, 0), ("x", 10, 5, 0, 0, 0)], "model string, prompt_tokens long, completion_tokens long, cached_tokens long, cache_write_tokens long, reasoning_tokens long")
    assert sorted((x.prompt_cost, x.completion_cost) for x in pr.price_tokens(log, prices).collect()) == [(0.0, 0.0), (4.0, 0.0), (10.0, 10.0)]


def test_batch_files_with_objects_over_lines_and_a_broken_end(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"b":\n {"c": 2}}\n{"broken": ')
    found = sorted(files.read_batch_jsonl(spark, str(tmp_path)).collect(), key=lambda x: x.n)
    assert [x.request for x in found] == ['{"a": 1}', '{"b": {"c": 2}}', None] and found[2].error


def test_exports_keep_their_schema_when_empty(spark, tmp_path):
    df = spark.createDataFrame([], "date string, api_key string, api_key_alias string, model string, model_group string, provider string, spend double, api_requests long, team_id string, team_alias string, user_id string, user_email string")
    files.write_parquet_export(sc.focus_export(df), str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == 0 and len(back.columns) == 44 and back.schema["BilledCost"].dataType.simpleString() == "decimal(18,6)"


def test_empty_tables(spark):
    log = spark.createDataFrame([], "usage_date date, api_key string, spend decimal(18,6), user string, model string, end_user string, request_tags array<string>, tools array<string>, prompt_tokens long, completion_tokens long")
    for found in (ag.spend_by_day(log, "2024-01-31"), ag.daily_tag_spend(log), ag.top_end_users(log), ag.tool_spend(log), ag.top_models(log, "2024-01-31")):
        assert found.count() == 0


def test_a_rewritten_request_keeps_all_but_its_model(spark):
    whole = '{"custom_id":"é/1","metadata":{"a":[1,2.5,null]},"body":{"model":"old","tools":[{"type":"function"}],"messages":[{"role":"user","content":[{"type":"text","text":"x\\n"}],"name":"n"}]}}'
    cases = {whole: whole.replace('"old"', '"new"'), '{"body": null}': '{"body": null}', "[1]": "[1]", "no JSON": "no JSON", '{"body":{}}': '{"body":{"model":"new"}}'}
    found = files.rewrite_batch_model(spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, request string"), "new").collect()
    assert {r.i: r.request for r in found} == dict(enumerate([*cases.values(), None]))


def test_category_files_keep_marks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.yaml").write_text('category_name: "x"  # note\nexceptions:\n  - "issue #5"  # why\n  - plain # gone\n')
    (tmp_path / "b.txt").write_text("category_name: other\nexceptions:\n  - no\n")
    found = policies.load_policy_table(spark, str(tmp_path)).collect()
    assert [(r.category, r.kind, r.value) for r in found] == [("x", "exception", "issue #5"), ("x", "exception", "plain")]


def test_no_rule_is_dropped(spark):
    rules = spark.createDataFrame([("c", "BLOCK", "always", f"word{i:05d}", None) for i in range(5_001)], policies.RULES)
    docs = spark.createDataFrame([(1, "word00000"), (2, "WORD05000"), (3, "word09999"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keyword) for r in text.screen_keywords(docs, rules, "c").collect()) == [(1, "word00000"), (2, "word05000")]


def test_paths_with_indices(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b"), (3, "c")],)], "list array<struct<n:int,p:string>>").select(F.struct("list", F.lit(1).alias("x")).alias("s"))
    values = lambda path: df.select(sc.drop_path(F.col("s"), path).alias("s")).first().s.asDict(recursive=True)
    assert values("list[1].p") == {"list": [{"n": 1, "p": "a"}, {"n": 2, "p": None}, {"n": 3, "p": "c"}], "x": 1}
    assert values("list[*].p") == {"list": [{"n": 1}, {"n": 2}, {"n": 3}], "x": 1}
    assert values("list[9].p") == values("list[1]") == values("list[z].p") == values("list[*]") == {"list": [{"n": 1, "p": "a"}, {"n": 2, "p": "b"}, {"n": 3, "p": "c"}], "x": 1}
    assert values("x") == {"list": [{"n": 1, "p": "a"}, {"n": 2, "p": "b"}, {"n": 3, "p": "c"}]}


def test_content_type_query_holds_for_prose_with_words_of_code(spark, tmp_path):
    prose = "a from b, from c, from d\n    x\n\ty\n    z\n    u\n    v\n    w"
    rows = [(1, i, "user", text) for i, text in enumerate([prose, prose, prose, "", "", '{"a": 1}', "", "", "import a\nimport b\nimport c"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = scalars.QUERIES["sc14_content_type"](spark, str(tmp_path)).collect()
    assert {r.turn: r.type for r in found} == {i: ["json", "code", "text"][i % 3] for i in range(9)}
    said = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").where("turn in (2, 5, 8)")
    assert [r.type for r in said.orderBy("turn").select(sc.content_type(F.col("text")).alias("type")).collect()] == ["code", "json", "code"]


def test_texts_become_pythons_a_few_at_a_time(spark):
    texts = pa.array([f"{i} É " + "x" * 1000 for i in range(10_000)] + [None])
    tracemalloc.start()
    found = sc.normalize_search.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # 10 MB of texts
    assert found[:2].to_pylist() == ["0 e " + "x" * 1000, "1 e " + "x" * 1000] and found[10_000].as_py() is None and len(found) == 10_001
    assert sc.normalize_search.func(pa.array([], pa.string())).to_pylist() == []


def test_chunks_are_given_out_a_few_pages_at_a_time(spark):
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1_000)), "html": [f"<p>a{i}</p>" * (i % 3) for i in range(1_000)]})
    parts = list(files.html_chunks(Pages())(iter([batch])))
    assert max(p.num_rows for p in parts) <= 2 * files.PAGES_AT_ONCE
    assert [r for p in parts for r in p.to_pylist()] == [{"page_id": i, "chunk": n, "text": f"a{i}"} for i in range(1_000) for n in range(i % 3)]
