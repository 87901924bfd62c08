"""Text screening and retrieval: policy rules by sentence, competitor intent, BM25, semantic routes, chunking."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged
from .aggregates import count_if
from .patterns import with_hits, word_blocks


def sentences(docs: DataFrame, max_words: int | None = None) -> DataFrame:
    """doc_id, sentence number and lower-cased sentence; a full stop, question or exclamation mark or line break ends one."""
    parts = F.filter(F.split(F.lower("text"), r"[.!?\n]+"), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("sentence", "s"))


def _of(rules: DataFrame, kind: str, category: str) -> DataFrame:
    return rules.where((F.col("kind") == kind) & (F.col("category") == category)).select("value", "severity")


def _constant(rows: list, kind: str) -> Column:
    """A list as a constant array."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _hits(text: Column, words: list[str]) -> Column:
    return F.filter(_constant(words, "string"), lambda w: F.contains(text, w))


def screen_keywords(docs: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Texts that hold an always-blocked keyword, with the keyword and its severity.

    All keywords are found in one pass over a text and then meet their severities on equal keys.
    """
    listed = _of(rules, "always", category)
    low = docs.select("doc_id", F.lower("text").alias("t"))
    found = with_hits(low, "t", {"hits": listed}, "value").select("doc_id", F.explode("hits").alias("keyword"))
    return found.join(listed.select(F.col("value").alias("keyword"), "severity"), "keyword").select("doc_id", "keyword", "severity")


def screen_conditional(docs: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Sentences with both an identifier and a blocked action word."""
    found = with_hits(sentences(docs), "s", {"identifiers": _of(rules, "identifier", category), "actions": _of(rules, "block", category)}, "value")
    found = found.where((F.size("identifiers") > 0) & (F.size("actions") > 0))
    return found.select("doc_id", "sentence", "s", F.lit(category).alias("category"), F.col("identifiers")[0].alias("identifier"), F.col("actions")[0].alias("action"))


PHRASES = 1_000  # regular expressions joined into one


def screen_phrases(docs: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Sentences that match one of a category's phrases, which are regular expressions.

    Phrases are tried by the thousand, joined; a further thousand costs another filter over the sentences not yet found.
    """
    left, found = sentences(docs), sentences(docs).limit(0)
    for block in word_blocks(_of(rules, "phrase", category), "value", PHRASES):
        fits = F.col("s").rlike("|".join(f"(?:{p})" for p in sorted(block)))
        found, left = found.unionByName(left.where(fits)), left.where(~fits)
    return found.withColumn("category", F.lit(category))


def apply_exceptions(hits: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Hits whose sentence holds none of the category's exceptions."""
    found = with_hits(hits, "s", {"__exceptions": _of(rules, "exception", category)}, "value")
    return found.where(F.size("__exceptions") == 0).drop("__exceptions")


def competitor_intent(docs: DataFrame, brands: list[str], markers: list[str], operational: list[str], signals: list[str], threshold: float = 0.6) -> DataFrame:
    """Whether a text that names a competitor wants to compare: by a plain marker; not if it is only operational; else by its share of signals."""
    low = F.lower("text")
    any_of = lambda words: F.size(_hits(low, words)) > 0
    share = F.size(_hits(low, signals)) / float(max(1, len(signals)))
    verdict = F.when(~any_of(brands), "none").when(any_of(markers), "competitor").when(any_of(operational), "operational")
    verdict = verdict.when(share >= threshold, "competitor").otherwise("unclear")
    return docs.select("doc_id", verdict.alias("intent"), F.round(share, 6).alias("signal_share"))


def competitor_terms(brands: DataFrame, own: DataFrame) -> DataFrame:
    """Each term of a comma-separated list, less the own brand's."""
    terms = brands.select(F.explode(F.split("terms", r"\s*,\s*")).alias("term")).select(F.trim(F.lower("term")).alias("term")).where("term <> ''").distinct()
    return terms.join(own.select(F.lower("term").alias("term")), "term", "left_anti")


def confusion(scored: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 of predicted against truth (0 or 1); a ratio over nothing is 0."""
    p, t = F.col("predicted") == 1, F.col("truth") == 1
    sums = scored.agg(count_if(p & t).alias("tp"), count_if(p & ~t).alias("fp"), count_if(~p & t).alias("fn"), count_if(~p & ~t).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("*", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector's norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


UTTERANCES = 10_000  # sent at once


def semantic_match(vectors: DataFrame, routes: DataFrame, threshold: float, most: int = UTTERANCES) -> DataFrame:
    """The best route of each vector, if the greatest cosine to one of its utterances reaches its threshold, or the global one.

    Utterances (route, utterance, route_threshold) are sent in blocks of ``most``, in order of route and utterance; each row carries its best so
    far from block to block, so any number is exact. Of equal ones the last counts. Vectors of another length than a block's take no part in it.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, embedding array<double>, route string, score double, least double"
    none = F.lit(None)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), none.cast("string").alias("route"), none.cast("double").alias("score"), none.cast("double").alias("least"))
    listed = routes.where("route IS NOT NULL AND size(utterance) > 0").orderBy("route", "utterance", "route_threshold").select("route", "utterance", "route_threshold")
    for block in _route_blocks(listed, threshold, most):
        rows = _best_of(rows, block, fields)
    return rows.where(F.col("score") >= F.col("least")).select("vec_id", "route", "score")


def _route_blocks(listed: DataFrame, threshold: float, most: int) -> Iterator[list[tuple]]:
    """Utterances of one length, at most ``most``: a block ends where the length changes as well."""
    block: list[tuple] = []
    for r in listed.toLocalIterator():
        if block and (len(block) == most or len(block[0][1]) != len(r.utterance)):
            yield block
            block = []
        block.append((r.route, r.utterance, threshold if r.route_threshold is None else r.route_threshold))
    if block:
        yield block


def _best_of(rows: DataFrame, block: list[tuple], fields: str) -> DataFrame:
    names, utterances, limits = zip(*block)
    sent = rows.sparkSession.sparkContext.broadcast((names, np.array(utterances, np.float64), limits))
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(float).tiny)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, limits = sent.value
        wanted = unit(wanted)
        for batch in batches:
            route, score, least = (batch[c].to_pylist() for c in ("route", "score", "least"))
            vectors = batch["embedding"].to_pylist()
            sound = [i for i, v in enumerate(vectors) if v is not None and len(v) == wanted.shape[1]]
            if sound:
                scores = np.round(unit(np.array([vectors[i] for i in sound], np.float64)) @ wanted.T, 9)
                best = scores.shape[1] - 1 - scores[:, ::-1].argmax(axis=1)  # of equal ones the last
                for i, at, s in zip(sound, best.tolist(), scores.max(axis=1).tolist()):
                    if score[i] is None or s >= score[i]:
                        route[i], score[i], least[i] = names[at], s, float(limits[at])
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["embedding"], pa.array(route, pa.string()), pa.array(score, pa.float64()), pa.array(least, pa.float64())], ["vec_id", "embedding", "route", "score", "least"]
            )

    return rows.mapInArrow(match, fields)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores of the texts that hold a term of ``query``.

    A term of four or more characters that occurs nowhere in a text counts that text's terms which begin with it. Document
    frequencies are those of exact terms. A repeated query term counts repeatedly.
    """
    terms = docs.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    terms = [(r.term, r.times) for r in terms.orderBy("term").collect()]  # of one query
    low, edge = F.lower("text"), "(?<![a-z0-9_])"
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    exact = [count(f"{edge}{t}(?![a-z0-9_])") for t, _ in terms]
    begins = [count(f"{edge}{t}") if len(t) >= 4 else F.lit(0) for t, _ in terms]
    counted = docs.select(
        "doc_id",
        F.coalesce(count("[a-z0-9_]+"), F.lit(0)).alias("length"),
        *[c.alias(f"exact{i}") for i, c in enumerate(exact)],
        *[F.when(e == 0, s).otherwise(e).alias(f"tf{i}") for i, (e, s) in enumerate(zip(exact, begins, strict=True))],
    )
    counted = staged(counted, "bm25")  # the texts are read once
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not terms or not totals.n:
        return counted.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    df = counted.agg(*[count_if(F.col(f"exact{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, (_, times) in enumerate(terms):
        idf = F.log(F.lit((totals.n - df[i] + 0.5) / (df[i] + 0.5) + 1))
        f = F.col(f"tf{i}")
        score = score + times * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.lit(totals.mean or 1.0)))
    return counted.select("doc_id", F.round(score, 6).alias("score")).where("score > 0")


def head_tail(text: Column, most: int = 30_000) -> Column:
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.substring(text, F.length(text) - half + 1, F.lit(half))))


SEPARATORS = ("\n\n", "\n", " ", "")
Span = tuple[int, int]


def _between(text: str, start: int, end: int, sep: str) -> list[Span]:
    """The stretches of ``text`` from start to end that ``sep`` parts; single characters if it is empty."""
    if not sep:
        return [(i, i + 1) for i in range(start, end)]
    cuts = [m.start() for m in re.finditer(re.escape(sep), text[start:end])]
    return list(zip([start, *(start + c + len(sep) for c in cuts)], [*(start + c for c in cuts), end]))


def _together(spans: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Runs of neighbouring spans that are ``size`` long at most; a run begins with those of the last ``overlap`` characters of the run before, or with its last span."""
    starts, first = [a for a, _ in spans], 0
    for i, (_, end) in enumerate(spans):
        if end - starts[first] > size and i > first:
            last = spans[i - 1][1]
            yield starts[first], last
            first = min(bisect_left(starts, last - overlap, first, i), i - 1)
    if spans:
        yield starts[first], spans[-1][1]


def _chunk_spans(text: str, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[Span]:
    sep = next(s for s in separators if not s or s in text[start:end])
    finer = separators[separators.index(sep) + 1 :]
    for fits, spans in groupby(_between(text, start, end, sep), lambda s: s[1] - s[0] < size):
        if fits:
            yield from _together(list(spans), size, overlap)
        for a, b in [] if fits else spans:
            if finer:
                yield from _chunk_spans(text, a, b, size, overlap, finer)
            else:
                yield from ((i, min(i + size, b)) for i in range(a, max(a + 1, b - overlap), size - overlap))


def split_recursively(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of a text, split at the first separator that it has; parts of ``size`` and more are split by the finer ones.

    Chunks are stretches of the text, found by their offsets: parts are put together while they fit.
    """
    chunks = (text[a:b].strip() for a, b in _chunk_spans(text, 0, len(text), size, overlap, SEPARATORS))
    return [c for c in chunks if c]


def split_text(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk number and chunk of every text. The overlap must be smaller than the size."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to less than size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, t in enumerate(batch["text"].to_pylist()) for n, c in enumerate(split_recursively(t or "", size, overlap))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "chunk", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, text string")


def first_per_group(df: DataFrame, by: str, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("n", n).where("n = 1").drop("n")
