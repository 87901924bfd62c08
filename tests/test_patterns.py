"""One pass for many patterns: the same as each pattern by itself."""

import random
import re

import pytest
from meterline.operators import patterns, pii, shapes
from meterline.operators import text as tx
from pyspark.sql import functions as F

ALL = [*shapes.RULES, *shapes.REGIONAL, *shapes.SECRETS, shapes.ORGANIZATION]


def alone(shapes_, text):
    found = []
    for s in shapes_:
        p = re.compile(s.pattern)
        g = 1 if p.groups else 0
        found += [(m.start(g), m.end(g), s.entity) for m in p.finditer(text) if s.check is None or s.check(m[g])]
    return [(e, a, b) for a, b, e in sorted(found)]


def sample(form, rng):
    """A text that fits a simple pattern."""
    out, i = "", 0
    form = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", form)
    while i < len(form):
        c = form[i]
        if c == "[":
            end = form.index("]", i)
            kinds, i = form[i + 1 : end], end + 1
            pick = lambda: rng.choice("0123456789") if "0-9" in kinds or "\\d" in kinds else "a" if "a-z" in kinds else kinds[0]  # noqa: B023, E731
        elif c == "\\":
            kinds, i = form[i + 1], i + 2
            pick = lambda: rng.choice("0123456789") if kinds == "d" else kinds  # noqa: B023, E731
        else:
            kinds, i = c, i + 1
            pick = lambda: kinds  # noqa: B023, E731
        n = 1
        if m := re.match(r"\{(\d+)(?:,\d*)?\}", form[i:]):
            n, i = int(m[1]), i + m.end()
        elif form[i : i + 1] in ("+", "?", "*"):
            n, i = {"+": 2, "?": 1, "*": 1}[form[i]], i + 1
        out += "".join(pick() for _ in range(n))
    return out


PARTS = [
    "a", "Z", "7", "12", "756", ".", "-", "_", " ", "  ", "@", "+", "é", "İ", "ſecret", "paſſword = 'abcdefgh1'", "\n", "AKIA", "eyJ", "sk-", "token", "= '", "secret: \"", "00", "0", "044 123 45 67", "+41 79 123 45 67",
    "DE89 3704 0044 0532 0130 00", "756.9217.0769.85", "4111 1111 1111 1111", "a.b+c@ex-ample.org", "10.0.255.1", "S1234567D", "123-45-6789", "AG", "GmbH", "Foo Bar", "Foo-Bar", "SARL", "DE123456789", "singapore 238823", "heroku", "key", "abcdef0123456789", "'", "\"",
]


def test_the_same_as_each_pattern_alone():
    rng = random.Random(9)
    scanner = patterns.Scanner(ALL)
    hits = 0
    for _ in range(4_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25)))
        want = alone(ALL, text)
        assert scanner.scan(text) == want, repr(text)
        hits += len(want)
    assert hits > 2_000


def test_every_secret_shape_is_found():
    rng = random.Random(3)
    scanner = patterns.Scanner(shapes.SECRETS)
    for name, form in shapes.PREFIXED:
        value = sample(form, rng)
        assert (name, 2, 2 + len(value)) in scanner.scan(f"é {value} x"), (name, value)
    for names, forms in shapes.ASSIGNED:
        provider = names.split("|")[0]
        value = sample(forms.split("|")[0], rng)
        text = f"{names.split('|')[-1].upper()}_KEY = '{value}'"
        at = text.index(value)
        assert (provider, at, at + len(value)) in scanner.scan(text), (provider, text)
    assert len({s.entity for s in shapes.SECRETS}) >= 90


@pytest.mark.parametrize("value", ["044 123 45 67", "+41 79 123 45 67", "0041 79 123 45 67"])
def test_phones(value):
    assert ("PHONE", 5, 5 + len(value)) in patterns.Scanner(shapes.RULES).scan(f"tel: {value}.")


def test_a_token_of_three_parts():
    value = "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10
    assert ("JWT", 1, 1 + len(value)) in patterns.Scanner(shapes.RULES).scan(f" {value}")


def test_hits_by_blocks(spark):
    words = ["he", "she", "hers", "his", "x y", "", None, "he"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    texts = spark.createDataFrame([(1, "ushers"), (2, None), (3, ""), (4, "this x y"), (4, "this x y")], "doc_id long, t string").withColumn("n", F.lit(1))
    for most in (1, 2, 100):
        found = patterns.with_hits(texts, "t", {"hits": table, "none": table.limit(0)}, most=most)
        assert found.columns == ["doc_id", "t", "n", "hits", "none"]
        assert sorted((r.doc_id, r.hits, r.none) for r in found.collect()) == [(1, ["he", "hers", "she"], []), (2, [], []), (3, [], []), (4, ["his", "x y"], []), (4, ["his", "x y"], [])]


def test_names_as_whole_words(spark):
    texts = ["Anna Keller met Foo Bar GmbH", "anna keller, foo gmbh", "Joanna Keller, Anna", "Anna-Lena Keller", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([("Anna", "PERSON"), ("Anna Keller", "PERSON"), ("Keller", "LOCATION"), ("Anna-Lena", "PERSON"), (None, "PERSON")], "name string, entity_type string")
    for most in (1, 100):
        found = {(r.doc_id, s.entity_type, texts[r.doc_id][s.start : s.end]) for r in pii.detect_gazetteer(docs, names, most).collect() for s in r.spans}
        always = {(0, "PERSON", "Anna Keller"), (0, "ORGANIZATION", "Foo Bar GmbH"), (2, "LOCATION", "Keller"), (2, "PERSON", "Anna"), (3, "PERSON", "Anna-Lena"), (3, "LOCATION", "Keller")}
        assert found >= always and (most == 1 or found == always)


def test_routes_by_blocks(spark):
    rng = random.Random(4)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    vectors = spark.createDataFrame([(i, vector(4)) for i in range(50)] + [(50, None), (51, [1.0])], "vec_id long, embedding array<double>")
    routes = spark.createDataFrame([(f"r{i % 7}", vector(4), None if i % 2 else 0.3) for i in range(40)] + [("r9", [], None), (None, vector(4), None)], "route string, utterance array<double>, route_threshold double")
    one, *others = (sorted(map(tuple, tx.semantic_match(vectors, routes, 0.5, most).collect())) for most in (10_000, 7, 1))
    assert len(one) > 10 and all(o == one for o in others)


def test_rules_in_any_number(spark):
    docs = spark.createDataFrame([(1, "Please kill the lights. Or hurt me"), (2, "nothing")], "doc_id long, text string")
    rows = [("always", "c", f"word{i}", "high") for i in range(3_000)] + [("always", "c", "lights", "low"), ("always", "d", "nothing", "low")]
    rows += [("phrase", "c", f"x{i}y", None) for i in range(1_500)] + [("phrase", "c", "hurt (me|us)", None), ("exception", "c", "please", None)]
    rules = spark.createDataFrame(rows, "kind string, category string, value string, severity string")
    assert [tuple(r) for r in tx.screen_keywords(docs, rules, "c").collect()] == [(1, "lights", "low")]
    hits = tx.screen_phrases(docs, rules, "c")
    assert [(r.doc_id, r.s.strip()) for r in hits.collect()] == [(1, "or hurt me")]
    assert tx.apply_exceptions(hits, rules, "c").count() == 1
