"""Small cases and brute-force versions of the operators that SQL can't express."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from meterline.llm import decontam, extraction, langid, lm, packing, sharding, simhash, topk, toxicity, urlfilter
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, score double, rank int"


def frame(spark, rows, schema=DOCS):
    names = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (names - len(r))) for r in rows], schema)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


HARD = [(1, None), (2, ""), (3, "   \n"), (4, "..."), (5, "x"), (5, "x"), (None, "y z"), (7, "word " * 20_000)]


# 1: top-k


def top_by_hand(data, is_query, k=5):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for r, (a, x) in enumerate(sound):
        if is_query(a):
            best = sorted((-sum(m * n for m, n in zip(x, y)), b) for s, (b, y) in enumerate(sound) if s != r)[:k]
            want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(best)]
    return sorted(want, key=str)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    data += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (0, data[0][1])]
    data += [(2000 + i, data[5][1]) for i in range(40)]  # ties
    data += [(3000, []), (77, data[3][1]), (3050, [0.0] * 6)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    got = rows(topk.top_k(vectors, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=4), "query_id", "rank", "vec_id", "score")
    assert got == [g for g in top_by_hand([d if d[1] != [] else (d[0], [0.0]) for d in data], lambda i: i % 50 == 0)]


def test_topk_of_rows_that_share_an_id(spark):
    data = [(0, [1.0]), (1, [2.0]), (1, [3.0]), (0, [2.0])]
    got = rows(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score")
    assert got == top_by_hand(data, lambda i: i == 0) and (0, 1, 1, 196608) in got


def test_topk_of_few_huge_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [3e9]), (1, [2e9]), (2, [-1e9, 5.0])], kind)
    found = topk.top_k(huge, F.col("vec_id") == 0).collect()
    x = [int(256 * float(np.float32(v))) for v in (3e9, 2e9, -1e9)]
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [
        (1, 1, min(2**63 - 1, x[0] * x[1])),
        (2, 2, max(-(2**63 - 1), x[0] * x[2])),
    ]


def test_search_finds_the_best_and_reads_less_where_it_can():
    rng = np.random.default_rng(5)
    n, d = 2000, 16
    values = np.floor(rng.pareto(1.5, size=(n, 1)) * 99 * rng.random((n, d)))  # a few vectors are large in every list
    queries = np.floor(rng.random((20, d)) * 9)
    q, c, scores, read = topk.block_top(values, np.full(20, -1), queries, 5)
    assert read < 0.6 * 20 * n * d
    best = np.sort(values @ queries.T, axis=0)[::-1][:5]
    for i in range(20):
        assert np.array_equal(np.sort(scores[q == i])[::-1][:5], best[:, i])
    # With a floor that other candidates are known to reach, lists of even values are left early as well.
    even, x = np.floor(rng.normal(size=(n, d)) * 256), np.floor(rng.normal(size=(4, d)) * 256)
    floors = np.sort(even @ x.T, axis=0)[::-1][0] + 1
    q, c, scores, read = topk.block_top(even, np.full(4, -1), x, 5, floors)
    assert read < 0.75 * 4 * n * d and np.isin(np.arange(n)[(even @ x.T)[:, 0] >= floors[0]], c[q == 0]).all()


def test_queries_read_on_together():
    """As far as each would alone, with the same candidates left."""
    rng = np.random.default_rng(6)
    values, queries = np.floor(rng.pareto(1.5, size=(900, 1)) * 99 * rng.normal(size=(900, 8))), np.floor(rng.normal(size=(60, 8)) * 9)
    queries[::7, 2], queries[5] = 0, 0
    scores = values @ queries.T
    own, floors = rng.integers(-1, 900, 60), np.where(rng.random(60) < 0.5, -np.inf, np.sort(scores, axis=0)[::-1][2])
    lists = topk.SortedLists(values)
    alive, read = lists.search(queries, 5, floors, own)
    alone = [lists.search(queries[i : i + 1], 5, floors[i : i + 1], own[i : i + 1]) for i in range(60)]
    assert np.array_equal(alive, np.concatenate([a for a, _ in alone])) and read == sum(r for _, r in alone) < 59 * 900 * 8
    for i in range(60):
        others = np.delete(np.arange(900), own[i]) if own[i] >= 0 else np.arange(900)
        best = others[np.argsort(-scores[others, i], kind="stable")[:5]]
        assert alive[i, best[scores[best, i] >= floors[i]]].all() and (own[i] < 0 or not alive[i, own[i]])


# 2: toxicity


def toxic_corpus(n=600):
    rng, out, labels = random.Random(1), [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [rng.choice("abcdefgh") + rng.choice("mnop") * rng.randint(1, 4) for _ in range(rng.randint(5, 30))]
        words += rng.sample(["grumble", "snarky", "vileness"], 2) if bad else []
        rng.shuffle(words)
        out.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return out, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus()
    docs += [(1000, None), (1001, ""), (None, "grumble snarky"), (1002, "GRUMBLE, snarky!"), (1002, "GRUMBLE, snarky!")]
    labels_df = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7), (99999, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(frame(spark, docs), labels_df).collect()
    assert len(found) == len(docs)
    truth = dict(labels)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r.predicted)
    assert by[1000] == [0] and by[1001] == [0] and by[None] == [1] and by[1002] == [1, 1]
    kept = toxicity.remove_toxic(frame(spark, docs), labels_df)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "rank"]
    assert kept.count() == sum(r.predicted == 0 for r in found)


def random_examples(rng, n, terms, most):
    out = []
    for i in range(n):
        ids = np.sort(rng.choice(terms, rng.integers(0, most), replace=False))
        out.append((i, ids, rng.integers(1, 4, len(ids)), int(rng.integers(0, 2))))
    return out


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    examples = random_examples(rng, 500, 30, 6)
    index = toxicity.BlockMaxIndex(rng.random(30) + 0.5, examples, block=16)
    vector = lambda ids, counts: dict(zip(ids.tolist(), index.weights(ids, counts)))
    by_name = {e[0]: vector(e[1], e[2]) for e in examples}
    for _ in range(40):
        ids, counts = np.sort(rng.choice(30, 4, replace=False)), rng.integers(1, 4, 4)
        at, cosines, _ = index.nearest(ids, counts, 10)
        q = vector(ids, counts)
        cos = sorted((sum(q[t] * v.get(t, 0) for t in q) for v in by_name.values()), reverse=True)[:10]
        assert np.allclose(cosines, cos[: len(cosines)])
        assert all(np.isclose(sum(q[t] * by_name[index.names[i]].get(t, 0) for t in q), c) for i, c in zip(at, cosines))


def test_words_are_runs_of_letters_without_a_pattern(monkeypatch):
    chars = [c for c in map(chr, range(0x2100)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["a%sB%s" % (c, c) for c in chars] + ["", None, "".join(chars), "\x1c\x85\xa0ÀÉß²½ºµ_9x"]
    want = [re.findall(r"[^\W\d_]+", t.lower()) if t else [] for t in texts]
    assert [toxicity.words(t) for t in texts] == want
    monkeypatch.setattr(toxicity, "_WORD", None)  # texts in Latin-1 do without it
    assert [toxicity.words(t) for t in texts[:256]] == want[:256]


def test_blocks_out_of_reach_are_not_read():
    rng = np.random.default_rng(4)
    weights = np.where(np.arange(400) < 20, 30.0, 1.0)  # twenty telling terms
    examples = []
    for i in range(2000):
        ids = np.unique(np.append(rng.choice(np.arange(20, 400), 30, replace=False), i % 20))
        examples.append((i, ids, np.ones(len(ids), np.int64), 1))
    index = toxicity.BlockMaxIndex(weights, examples)
    read = [index.nearest(e[1], e[2])[2] for e in examples[:100]]
    assert index.blocks == 32 and max(read) < 16


def toxicity_by_hand(docs, labels, k=toxicity.NEIGHBOURS):
    """Scores of (doc_id, text) by all labelled rows that aren't held out, of which no two are near copies."""
    split = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    text, bags = dict(docs), [split(t) for _, t in docs]
    known = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in text)
    n0, n1 = (sum(labels[i] == y for i in known) for y in (0, 1))
    held = [Counter(t for i in known if labels[i] == y for t in split(text[i])) for y in (0, 1)]

    def vector(bag):
        v = {}
        for t, n in bag.items():
            a, b = held[0][t], held[1][t]
            if a + b:
                chi = (b * n0 - a * n1) ** 2 / max(1, (a + b) * (n0 + n1 - a - b) * n0 * n1)
                v[t] = (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + sum(t in x for x in bags))) + 1) * chi
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    examples = [(vector(split(text[i])), labels[i]) for i in known]
    rate = (n1 + 0.5) / (len(known) + 5)
    blank = [y for v, y in examples if not v]
    out = []
    for bag in bags:
        q = vector(bag)
        near = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), y) for v, y in examples), key=lambda c: -c[0])[:k]
        votes = [(1 / (1.1 - min(1, c)), y) for c, y in near if c > 1e-6]
        total = sum(w for w, _ in votes)
        out.append((sum(w * y for w, y in votes) + rate) / (total + 1) if votes else (sum(blank) + rate) / (len(blank) + 1))
    return out


def test_toxicity_equals_brute_force(spark):
    docs, labels = toxic_corpus(300)
    docs += [(1000, None), (1001, ""), (1002, "GRUMBLE, snarky! " * 3), (1003, "word " * 20_000 + "vileness"), (1004, "unknown zzz")]
    found = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    want = toxicity_by_hand(docs, dict(labels))
    # Equally near examples at the k-th place may be others there.
    close = [abs(found[d] - w) < 1e-4 for (d, _), w in zip(docs, want)]
    assert np.mean(close) > 0.97 and all(close[-5:])


def test_near_copies_among_the_examples_count_once(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 5) for _ in range(n))
    base = text(60)
    copies = [(i, 1, base + f" extra{i}") for i in range(5)] + [(10, 1, base), (11, 1, base), (12, 0, text(60)), (13, 0, None), (14, 0, "")]
    kept = rows(toxicity.without_copies(spark.createDataFrame(copies, "doc_id long, toxic int, text string")), "doc_id")
    assert len([i for (i,) in kept if i < 12]) == 1 and len([i for (i,) in kept if i > 12]) == 2 and (12,) in kept


def test_blank_texts_have_the_rate_of_all_blank_examples(spark):
    blanks = [(i, None if i % 3 else " ", int(i == 7)) for i in range(40)]
    docs = [(i, t) for i, t, _ in blanks] + [(100 + i, f"word{i} here and there") for i in range(20)]
    labels = [(i, y) for i, _, y in blanks] + [(100 + i, i % 2) for i in range(20)]
    found = {r.doc_id: r for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert {found[i].predicted for i in range(40)} == {0} and len({found[i].score for i in range(40)}) == 1
    assert found[0].score < 0.1


def test_copies_of_opposite_labels(spark):
    schema = "doc_id long, toxic int, text string"
    base = " ".join(f"word{chr(97 + i)}" for i in range(26))
    near = [(1, 0, base), (2, 0, base + " more"), (3, 1, base + " vile"), (4, 1, base + " viler")]
    kept = {r.doc_id: r.toxic for r in toxicity.without_copies(spark.createDataFrame(near, schema)).collect()}
    assert sorted(kept.values()) == [0, 1]  # one of each label
    equal = [(i, int(i == 3), "the same words again") for i in range(10)]
    found = toxicity.without_copies(spark.createDataFrame(equal, schema)).collect()
    assert [(r.doc_id, r.toxic, r.share) for r in found] == [(0, 0, 0.1)]


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(frame(spark, HARD), none).collect()} == {0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


# 3: decontamination


def contamination_by_hand(text, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, named = split(text), set(), set()
    for name, item in items:
        v = split(item)
        size = min(window, len(v))
        for o in range(len(v) - size + 1 if v else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == v[o : o + size]:
                    hit.update(range(p, p + size))
                    named |= {name} - {None}
    named = sorted(map(str, named))
    digest = hashlib.sha256(",".join(named).encode()).hexdigest()
    return len(w), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, item_bytes, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "Dé", "e9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(12) if i] + [(50, None), (51, "..."), (None, "zz yy"), (52, "c c c c c"), (52, "e9 a")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(5) + "; " + items[i][1] + " -- " + text(5)) for i in range(8)]
    docs += [(200, None), (201, "zz, YY!"), (201, "zz, YY!"), (None, items[3][1]), (202, "c " * 300)]
    monkeypatch.setattr(decontam.longest_matches, "__defaults__", (13, item_bytes))
    bench = frame(spark, items, "item_id long, text string, n_words int")
    found = decontam.contamination(frame(spark, docs), bench)
    want = [(d, *contamination_by_hand(t, items)) for d, t in docs]
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    kept = decontam.remove_contaminated(frame(spark, docs), bench, item_bytes=item_bytes)
    assert rows(kept, "doc_id") == sorted(((w[0],) for w in want if not w[5]), key=str)


def test_longest_match_has_its_place(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z")]
    m = decontam.longest_matches(frame(spark, docs), frame(spark, [(9, item)], "item_id long, text string")).first()
    assert [s.asDict() for s in m.spans] == [{"start": 2, "n": 20}]
    assert [x.asDict() for x in m.matches] == [{"item": "9", "start": 2, "n": 20}]


def test_matches_are_verbatim(spark):
    """Items with repeated words and windows: the longest common stretch of at least a window."""
    w = [f"w{i}" for i in range(13)]
    docs = [(1, " ".join([*w, "zz"])), (2, "c " * 60), (3, " ".join([*w, "gap", *w[1:], "zz", *w])), (4, " ".join(w * 3))]
    items = [(1, " ".join([*w, "gap", *w[1:], "zz"])), (2, "c " * 20), (3, " ".join(w * 2)), (4, "c c")]
    found = {r.doc_id: {m.item: m for m in r.matches} for r in decontam.longest_matches(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}

    def longest(a, b, least):
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
        return best if best >= least else 0

    for d, t in docs:
        for i, u in items:
            a, b = t.split(), u.split()
            want = longest(a, b, min(13, len(b)))
            assert (found[d][str(i)].n if str(i) in found[d] else 0) == want, (d, i)
            if want:
                m = found[d][str(i)]
                assert " ".join(a[m.start : m.start + m.n]) in " ".join(b)


# 4: SimHash


def fingerprint_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_by_hand(prints, radius=4):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= radius:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in root}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)  # most buckets are then cut into blocks
    rng = random.Random(7)
    base = [[rng.choice(["The", "of", "tion", "é", "zu"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 300))] for _ in range(12)]
    docs = []
    for words in base:
        for _ in range(10):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            docs.append((len(docs), " ".join(w)))
    docs += [(500, None), (501, ""), (502, "\t "), (503, "One two"), (504, "one  TWO"), (505, docs[0][1])]
    found = simhash.near_duplicates(frame(spark, docs)).collect()
    prints = [(d, fingerprint_by_hand(t)) for d, t in docs]
    want = components_by_hand(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{p:016x}", want[d]) for d, p in prints}


def copies_by_hand(docs, similarity=0.8):
    def cut(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}

    sets, root = [cut(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= similarity * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def edited(text, rng, words):
    """A text with words changed, put in, taken out or added at its end, and its likeness to the first."""
    w = text.split(" ")
    for _ in range(rng.choice([1, 1, 2, 3]) if len(w) > 60 else 1):
        i = rng.randrange(len(w)) if len(w) >= 60 else rng.choice([0, len(w) - 1, rng.randrange(len(w))])
        w[i : i + rng.randrange(2)] = rng.choice([[], [rng.choice(words)], [rng.choice(words), rng.choice(words)]])
    cut = lambda t: {" ".join(x[i : i + 5]) for x in [t.lower().split()] for i in range(max(1, len(x) - 4))}
    a, b = cut(text), cut(" ".join(w))
    return " ".join(w), len(a & b) / len(a | b)


@pytest.mark.parametrize("fewest, most", [(9, 20), (20, 201), (201, 100_000)])
def test_share_of_near_copies_that_go(spark, fewest, most):
    """By length in words, through the stage's own function."""
    rng = random.Random(fewest)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    words = [w for t in texts[:300] for w in t.split()]
    short = [" ".join(t.split()[:n]) for t in texts for n in [rng.randrange(fewest, min(most, 200))] if len(t.split()) > n] if most == 20 else []
    made = []
    for t in rng.sample([*short, *(t for t in texts if fewest <= len(t.split()) < most)], 400 if most == 20 else 200):
        u, likeness = edited(t, rng, words)
        if 0.8 <= likeness < 1 and fewest <= len(u.split()) < most:
            made.append((t, u))
    docs = [(i, x) for i, (t, u) in enumerate(made) for x in (t,)] + [(10_000 + i, u) for i, (t, u) in enumerate(made)]
    kept = {r.doc_id for r in simhash.one_of_each(frame(spark, docs)).collect()}
    gone = sum(10_000 + i not in kept for i in range(len(made)))
    assert len(made) >= 50 and gone >= 0.95 * len(made), (gone, len(made))


@pytest.mark.parametrize("block, radius", [(500_000, simhash.COPY_RADIUS), (150, 8)])
def test_one_of_each_equals_brute_force(spark, monkeypatch, block, radius):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(simhash, "GROUP_SHINGLES", 400 if block < 1_000 else 4_000)
    rng = random.Random(9)
    docs = []
    for g in range(12):
        base = [rng.choice(["The", "of", "tion", "é", "zu"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(80, 300))]
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            docs.append((len(docs), " ".join(w)))
        docs.append((len(docs), " ".join(rng.sample(base, len(base)))))  # the same words in another order
    docs += [(500, None), (501, ""), (502, "\t "), (503, "One two"), (504, "one  TWO"), (505, docs[0][1]), (506, "one two three")]
    kept = simhash.one_of_each(frame(spark, docs), radius=radius)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "rank"]
    kept, want = {r.doc_id for r in kept.collect()}, copies_by_hand(docs)
    # The greater radius reaches every pair here; the default misses few.
    assert kept == want if radius > simhash.COPY_RADIUS else want <= kept and len(kept - want) <= 2


def test_near_duplicates_of_hard_rows(spark):
    found = rows(simhash.near_duplicates(frame(spark, HARD)), "doc_id", "component_id")
    assert found == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (None, None), (7, 7)], key=str)
    kept = rows(simhash.one_of_each(frame(spark, [*HARD, (None, "x"), (None, "y z"), (None, "Y  z")])), "doc_id", "text")
    assert [k for k in kept if k[0]] == sorted([(1, None), (4, "..."), (5, "x"), (7, "word " * 20_000)], key=str)
    assert len(kept) == 5 and kept[-1][1] in ("y z", "Y  z")
    assert simhash.one_of_each(frame(spark, [])).count() == 0
    both = [(1, "a b c"), (1, "d e f"), (2, "D e f"), (None, "a b c")]  # two texts under one id
    assert rows(simhash.one_of_each(frame(spark, both)), "doc_id", "text") == [(1, "a b c"), (1, "d e f")]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [4, 6])
def test_masks_cover_every_difference_within_the_radius(radius):
    rng, masks = random.Random(1), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert min((m & (1 << 64) - 1).bit_count() for m in masks) >= 26  # none so empty that unlike texts meet under it
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), radius):
            b ^= 1 << i
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("bucket", [64, simhash.BUCKET])
def test_links_of_a_large_group_are_about_one_a_member(spark, monkeypatch, bucket):
    """However many buckets and blocks its members share."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centre = rng.getrandbits(64)
    group = {centre} | {centre ^ sum(1 << i for i in rng.sample(range(64), 2)) for _ in range(700)}
    fps = sorted(map(signed, group | {rng.getrandbits(64) for _ in range(50)}))
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all(a < b for a, b in pairs) and len(group) <= len(pairs) + 1 and len(pairs) < 1.3 * len(group)
    least = min(map(signed, group))
    assert {r.node: r.root for r in simhash.components(found).collect()} == {f: least for f in map(signed, group) if f != least}


def test_components_of_a_long_chain(spark):
    chain = list(range(0, 400))
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1001)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 400)} | {(1001, 1000)}


# 5: packing


def test_packing_is_a_round_trip(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abé ") for _ in range(rng.choice([1, 5, 15, 16, 31, 32, 33, 63, 64, 200])))) for i in range(300)]
    docs += [(900, None), (901, ""), (None, "abc"), (902, "dup"), (902, "dup")]
    found = packing.pack(frame(spark, docs), lengths=(16, 32, 64), group_pieces=50).collect()
    text = {d: t for d, t in docs}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
        if r.doc_id not in (None, 902):
            parts[r.doc_id].append((r.start, r.n))
    for d, ps in parts.items():
        ps.sort()
        assert "".join(text[d][s : s + n] for s, n in ps) == text[d]
    assert set(parts) == {d for d, t in docs if t and d not in (None, 902)}
    assert sum(r.doc_id == 902 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
    for rs in bins.values():
        rs.sort(key=lambda r: r.offset)
        ends = [r.offset + r.n + 1 for r in rs]
        assert [r.offset for r in rs] == [0, *ends[:-1]] and ends[-1] == rs[0].used
        assert rs[0].capacity == min(c for c in (16, 32, 64) if c >= rs[0].used)
    assert sum(b[0].used for b in bins.values()) / sum(b[0].capacity for b in bins.values()) > 0.9
    assert packing.pack(frame(spark, [])).count() == 0


def cost_of(packed):
    return sum(packing.sequence_cost(length) for length, _ in packed)


def least_cost(sizes, lengths):
    """By trying every way to part the pieces into sequences."""
    if not sizes:
        return 0.0
    first, rest, best = sizes[0], sizes[1:], float("inf")
    for mask in range(1 << len(rest)):
        used = first + sum(s for i, s in enumerate(rest) if mask >> i & 1)
        fit = [c for c in lengths if c >= used]
        if fit:
            others = [s for i, s in enumerate(rest) if not mask >> i & 1]
            best = min(best, packing.sequence_cost(min(fit)) + least_cost(others, lengths))
    return best


def smallest_fit(sizes, lengths):
    """Best fit decreasing, with every sequence opened at the least length that holds its first piece."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fit:
            min(fit, key=lambda b: b[0] - sum(b[1]))[1].append(s)
        else:
            bins.append((min(c for c in lengths if c >= s), [s]))
    return bins


def test_lengths_are_chosen_jointly():
    rng = random.Random(8)
    sizes = [rng.randint(4_200, 5_600) for _ in range(400)]  # over 4,096, and only one fits in 8,192
    found = packing.sequences(sizes, packing.LENGTHS)
    assert sorted(s for _, own in found for s in own) == sorted(sizes)
    assert cost_of(found) < 0.75 * cost_of(smallest_fit(sizes, packing.LENGTHS))
    # What is left at the end goes to short sequences.
    assert [c for c, _ in packing.sequences([1_500] * 5 + [300], packing.LENGTHS)] == [8_192]
    assert [c for c, _ in packing.sequences([1_500], packing.LENGTHS)] == [2_048]
    for _ in range(40):
        sizes = [rng.choice([rng.randint(1, 2_000), rng.randint(1_000, 16_384)]) for _ in range(7)]
        assert cost_of(packing.sequences(sizes, packing.LENGTHS)) <= 1.25 * least_cost(sizes, packing.LENGTHS)


def test_packing_of_long_texts_ties_and_clashing_columns(spark):
    docs = frame(spark, [(1, "x" * 1_000_000), (2, "y" * 100), (3, "z" * 100), (3, "z" * 100)])
    for c in ("start", "n", "piece", "bin_id", "n_chars"):
        docs = docs.withColumn(c, F.lit("clash"))
    found = packing.pack(docs).collect()
    assert sum(r.n for r in found if r.doc_id == 1) == 1_000_000 and max(r.capacity for r in found) == 16_384
    assert sorted(r.n for r in found if r.doc_id > 1) == [100, 100, 100]


# 6: URL filter


def test_url_filter_on_hard_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow")], "host string, path string, verdict string")
    urls = ["HTTP://A.Example.ORG/en/12?x", "http://org/", "http://notorg", "http://borg/x", "http://x.com/de/#y", "no scheme", None, "", "x://com?/de/", "http://example.org/EN/1", "a://b://c.com/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h"), (0, urls[0], "h")], "page_id long, url string, host string")
    found = rows(urlfilter.filter_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    want = [
        (0, "a.example.org", "/en/12", "example.org/en/1", "block"), (1, "org", "/", "org/", "allow"), (2, "notorg", "", None, "allow"),
        (3, "borg", "/x", None, "allow"), (4, "x.com", "/de/", "com/de/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "com", "", None, "allow"), (9, "example.org", "/EN/1", "org/", "allow"), (10, "b:", "//c.com/de/", None, "allow"),
        (None, "a.example.org", "/en/12", "example.org/en/1", "block"), (0, "a.example.org", "/en/12", "example.org/en/1", "block"),
    ]
    assert found == sorted(want, key=str)
    assert urlfilter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(want)
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_url_rules_of_many_lengths(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", broadcast)
    rules = [("h.org", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(4_200)] + [(None, "/", "block"), ("", "/", "block"), ("x", None, "block")]
    pages = [(n, "http://w.h.org/" + "a" * n) for n in (0, 1, 4_098, 4_199, 5_000)] + [(7, "http://x"), (8, "http://y.x/z")]
    found = urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = [(n, len("h.org/") + min(n, 4_199), "block" if min(n, 4_199) % 2 else "allow") for n in (0, 1, 4_098, 4_199, 5_000)] + [(7, 1, "block"), (8, 1, "block")]
    assert sorted((r.page_id, len(r.rule), r.verdict) for r in found.collect()) == sorted(want)


# 7: extraction

PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice"><p>We use cookies</p></div><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="wrap"><div class="post-{n} content"><h1>Title &amp; more</h1><p>First <a href="x>y">para</a>,  <b>bold.<p>Second&nbsp;para &#8212; here<br>next.
<ul><li>one<li>two</ul><div class="share">Share</div><form>f</form></div><section class="comments"><p>Reader</p></section></div><footer>(c)</footer></body></html>"""
TEXT = "Title & more\n\nFirst para, bold.\n\nSecond para — here next.\n\none\n\ntwo"


def test_extraction(spark):
    pages = [(i, "http://h.example/" + str(i), PAGE.replace("{n}", str(i))) for i in range(5)]
    pages += [(10, None, PAGE), (11, "http://h.example/x", None), (12, "http://h.example/y", ""), (13, "http://h.example/z", "<p>other page"), (None, "http://h.example/0", "<div"), (0, "http://h.example/0", pages[0][2])]
    found = extraction.main_text(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string"))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in found.collect()}
    for i in range(5):
        assert got[i, f"http://h.example/{i}"] == (TEXT, len(TEXT))
    assert got[10, None][0] == TEXT and got[11, "http://h.example/x"] == ("", 0) and got[12, "http://h.example/y"] == ("", 0)
    assert got[13, "http://h.example/z"][0] == "other page" and found.count() == len(pages)


@pytest.mark.parametrize(
    "around",
    [
        '<div id="siteHeader">{}</div>', '<div class="mainmenu">{}</div>', '<section id="commentSection"><p>{}</p></section>', '<div role="dialog">{}</div>',
        '<div style="display: none">{}</div>', "<aside>{}</aside>", "<noscript>{}</noscript>", '<span class="ad">{}</span>', '<article class="comment"><p>{}</p></article>',
        "<!-- {} -->", "<form><p>{}</p></form>", '<div class="cookie-banner"><p>{}</p></div>', "<select><option>{}</select>", '<ul class="breadcrumbs"><li>{}</ul>',
    ],
)
def test_what_is_left_out(around):
    junk = around.format("left out")
    page = f"<body>{junk}<article><h1>Head</h1><p>One{junk}</p>{junk}<p>Two</article>{junk}</body>"
    assert "left out" not in extraction.extract(extraction.blocks(page), None)
    assert extraction.extract(extraction.blocks(page), None).split() == ["Head", "One", "Two"]


def test_headlines_and_shadows_stay():
    page = '<main><div class="headline">A</div><div class="shadow adapted">B</div><p>C</main>'
    assert extraction.extract(extraction.blocks(page), None) == "A\n\nB\n\nC"


@pytest.mark.parametrize(
    "wrapper",
    ["content has-sidebar", "with-sidebar", "no-header", "page side-layout", "commentary", "layout-sidebar wide"],
)
@pytest.mark.parametrize("body", ["<h1>Head</h1><p>One of many", "<article><p>Head</p><p>One of many</article>", "<p>Head</p><p>One of many"])
def test_a_layout_wrapper_keeps_its_article(wrapper, body):
    page = f"<body><div class='cookie-notice'>left out</div><div class='{wrapper}'><div class='sidebar'>junk</div>{body}</div></body>"
    assert extraction.extract(extraction.blocks(page), None).split() == ["Head", "One", "of", "many"]


def test_long_comments_are_still_left_out():
    page = "<body><p>Article text</p><section class='comments'><article>" + "reader " * 99 + "</article></section><div class='cookie-bar'>" + "we use " * 99 + "</div>"
    assert extraction.extract(extraction.blocks(page), None) == "Article text"


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='wrap'><div class='intro'><p>{}</div><div class='x7'><p>{}</div><section class='part'><p>{}</section></div></body>",
        "<body><div class='wrap'><article><p>{}</article><div class='x7'><p>{}</div><div class='x8'><p>{}</div></div></body>",
        "<div class='a'><p>{}</div><div class='b'><p>{}</div><div class='c'><p>{}</div>",
    ],
)
def test_an_article_in_several_containers_is_whole(spark, page):
    parts = ["lead " * 30, "long part " * 30, "rest " * 40]
    text = "\n\n".join(p.strip() for p in parts)
    assert extraction.extract(extraction.blocks(page.format(*parts)), None) == text
    if "<body>" in page:
        pages = [(i, "http://x/", page.format(*parts)) for i in range(4)]
        found = extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
        assert {r.text for r in found} == {text}


def test_the_host_decides_where_a_page_alone_would_not(spark):
    page = "<body><div class='a1'>{}</div><div class='b2'>{}</div></body>"
    pages = [(i, "http://x/", page.format("<p>" + "long text " * 30, "<p>aside here")) for i in range(6)]
    pages.append((9, "http://x/", page.format("<p>short", "<p>" + "loud aside " * 30)))
    found = extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()}[9] == "short"


# 8: sharding


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(8)
    docs = [(i, "same copy " * 20 if i % 3 == 0 else "é" * rng.randint(0, 400)) for i in range(3000)] + [(None, None), (5, "twice"), (5, "twice"), (6, "")]
    found = sharding.shard(frame(spark, docs)).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
    assert sharding.shard(frame(spark, [])).count() == 0
    assert rows(sharding.shard(frame(spark, HARD)), "slot") and sharding.shard(frame(spark, HARD)).count() == len(HARD)


def test_repeated_rows_of_one_id_are_spread(spark):
    docs = [(5, "one and the same " * 50)] * 2000 + [(None, "other")] * 1000
    found = sharding.shard(frame(spark, docs)).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(found) == 3000 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)


# 9: language model


@pytest.mark.parametrize("frequent", [3, 510])
def test_backoff_scores_equal_brute_force(spark, frequent):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", *[f"w{i}" for i in range(40)]]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    docs += [(300, None), (301, "--"), (None, "The of, THE!"), (302, "Éa é"), (302, "the")]
    size = 20
    words = {i: lm.words(t) for i, (_, t) in enumerate(docs)}
    count = Counter(w for ws in words.values() for w in ws)
    total = sum(count.values())
    top = sorted(count, key=lambda w: (-count[w], w))[:size]
    known = {w: i + 1 for i, w in enumerate(top)}
    unigram = {i + 1: count[w] for i, w in enumerate(top)} | {0: total - sum(count[w] for w in top), "s": sum(bool(w) for w in words.values())}
    number = {i: [known.get(w, 0) for w in ws] for i, ws in words.items()}
    pairs = {i: Counter(zip(["s", *n], n)) for i, n in number.items()}
    both, holders = Counter(), Counter()
    for p in pairs.values():
        both.update(p)
        holders.update(set(p))
    want = defaultdict(lambda: [0, 0.0])
    for i, (d, _) in enumerate(docs):
        want[d][0] += len(words[i])
        for (a, b), n in pairs[i].items():
            want[d][1] += n * np.log(both[a, b] / unigram[a] if holders[a, b] > 1 else 0.4 * unigram[b] / total)
    found = lm.backoff_scores(frame(spark, docs), vocabulary=size, frequent=frequent).collect()
    assert len(found) == len(want)
    for r in found:
        assert r.n_words == want[r.doc_id][0] and abs(r.log_score - want[r.doc_id][1]) < 2e-6
        assert (r.mean_score is None) == (r.n_words == 0)
    assert lm.backoff_scores(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("n_words", "sizes"), [(60, {"frequent": 3, "numbered": 20}), (66_000, {})])
def test_every_word_has_its_own_counts(spark, n_words, sizes):
    rng = random.Random(19)
    docs = [(i, f"the rare w{i} the x{i % 7} w{i % 50} x{i % 50}") for i in range(n_words)] + [(-1, "x1 w1 junk"), (-2, "junk heap"), (None, None)]
    words = {i: ["<s>", *lm.words(t)] for i, (_, t) in enumerate(docs)}
    count = Counter(w for ws in words.values() if ws[1:] for w in ws)
    total = sum(count.values()) - count["<s>"]
    assert len(count) > sizes.get("numbered", lm.NUMBERED) + 1
    pairs = {i: Counter(zip(ws, ws[1:])) for i, ws in words.items()}
    both, holders = Counter(), Counter()
    for p in pairs.values():
        both.update(p)
        holders.update(set(p))
    one = lambda a, b: np.log(both[a, b] / count[a] if holders[a, b] > 1 else 0.4 * count[b] / total)
    want = {d: sum(n * one(*p) for p, n in pairs[i].items()) for i, (d, _) in enumerate(docs)}
    found = {r.doc_id: r.log_score for r in lm.backoff_scores(frame(spark, docs), **sizes).collect()}
    assert found.keys() == want.keys()
    for d in rng.sample(list(want), 50) + [-1, -2, None]:
        assert abs(found[d] - want[d]) < 2e-6


# 10: language


def test_language_on_held_out_documents(spark):
    rng = random.Random(10)
    syllables = {"xx": ["tha", "ing", "ed"], "yy": ["ción", "os", "ña"], "zz": ["sch", "ung", "ö"]}
    docs = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))]
        docs.append((i, " ".join(words), lang))
    extra = [(900, None, "xx"), (901, "12 -- !", "yy"), (902, "", None), (None, "THAING inged", "xx"), (903, "schung", None), (903, "schung", None)]
    found = langid.learn_and_identify(frame(spark, docs + extra)).collect()
    assert len(found) == len(docs) + len(extra)
    truth = {d: lang for d, _, lang in docs}
    assert all(r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth)
    assert sum(r.held_out for r in found) > 30 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.lang_pred for r in found}
    assert (by[900], by[901], by[902], by[None], by[903]) == ("und", "und", "und", "xx", "zz")
    assert {r.lang_pred for r in langid.learn_and_identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.learn_and_identify(frame(spark, [])).count() == 0
    kept = langid.keep_identified(frame(spark, docs + extra))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "rank"] and kept.count() == len(docs) + 3


def test_predictions_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 6)))
    docs = [(i, " ".join(word("abcdé" if i % 2 else "cdefß") for _ in range(rng.randint(1, 40))), "xy"[i % 2]) for i in range(60)]
    docs += [(100, "abc " * 50_000, None), (101, "zzz", None)]
    size, learnt = 30, [(t, l) for d, t, l in docs if l and zlib.crc32(str(d).encode()) % 5]
    counts = {l: Counter(g for t, k in learnt if k == l for g in map(int, langid.grams(t))) for l in "xy"}
    ranks = {l: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for l, c in counts.items()}

    def by_hand(text):
        own = sorted(Counter(map(int, langid.grams(text))).items(), key=lambda x: (-x[1], x[0]))[:size]
        mean = {n: np.mean([i for i, (_, m) in enumerate(own) if m == n]) for _, n in own}
        far = {l: sum(abs(r[g] - mean[n]) if g in r else size for g, n in own) for l, r in ranks.items()}
        best = min(far, key=lambda l: (far[l], l))
        return best, 1 - far[best] / (len(own) * size)

    spark_docs = frame(spark, docs)
    found = langid.identify(spark_docs, langid.learn_profiles(spark_docs.where(~langid.held_out()), size), size).collect()
    for r in found:
        lang, score = by_hand(dict((d, t) for d, t, _ in docs)[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_languages_that_no_profile_knows(spark):
    docs = [(i, "the and of with " * 5, "en") for i in range(40)]
    others = [(100, "Ωμέγα και άλφα", None), (101, "the", None), (102, "...", None), (103, None, None)]
    assert rows(langid.keep_identified(frame(spark, docs + others)).where("doc_id >= 100"), "doc_id") == [(101,)]
    # Without any language all texts with a letter stay.
    assert rows(langid.keep_identified(frame(spark, others)), "doc_id") == [(100,), (101,)]


def test_grams_by_hand():
    def by_hand(text):
        out = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f"_{w}_"
            for n in (1, 2, 3):
                out += [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != "_"]
        return Counter(out)

    def decoded(key):
        codes = [(int(key) >> s) & 0x1FFFFF for s in (42, 21, 0)]
        return "".join("_" if c == langid.EDGE else chr(c) for c in codes if c)

    for text in ("a", "Ab, cd1e", " x ", "Été 𝒳y"):
        assert Counter(map(decoded, langid.grams(text))) == by_hand(text)


def test_languages_beyond_one_block(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    one = rows(langid.identify(docs, profiles), "doc_id", "lang_pred", "score")
    for most in (1, 3):
        assert rows(langid.identify(docs, profiles, most=most), "doc_id", "lang_pred", "score") == one
        assert langid.keep_identified(docs, most=most).count() == langid.keep_identified(docs).count()
    many = frame(spark, [(i, f"abc def g{i}", f"lang{i}") for i in range(50)])
    assert langid.identify(many, langid.learn_profiles(many), most=7).where("lang_pred <> 'und'").count() == 50


def test_rows_without_an_id_and_equal_texts_are_spread(spark):
    docs = frame(spark, [(None, "x" * 30)] * 6_000)
    packed = packing.pack(docs, group_pieces=1_000).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in packed.groupBy("task").count().collect()]
    assert sum(tasks) == 6_000 and len(tasks) == 6 and max(tasks) < 1_300
