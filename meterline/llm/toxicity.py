"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

EXAMPLES = 4_000  # labelled rows, at most, that are indexed
NEIGHBOURS = 24
BLOCK = 64
STEPS = (8,)  # blocks that are read before the rest is judged by what they held
EPSILON = 1e-6  # beyond the rounding of the stored weights
PRIOR_VOTES = 1.0  # weight of the base rate among the votes
THRESHOLD = 0.3
SKETCH = 8  # least hashes of runs of three words by which near copies among the examples are known
EVIDENCE = 3

_WORD = re.compile(r"[^\W\d_]+")
#: The characters of one byte in Latin-1, letters as they are and all others as a space.
_LETTERS = "".join(c if _WORD.match(c) else " " for c in map(chr, range(256))).encode("latin-1")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    text = text.lower() if text else ""
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()  # several times as quick as the pattern
    except UnicodeEncodeError:
        return _WORD.findall(text)


def _sketch(text: str | None) -> list[int]:
    """The SKETCH least hashes of a text's runs of three words; none without a word, so blank texts are no copies of one another."""
    found = words(text)
    if not found:
        return []
    runs = {" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))}
    return sorted(xxhash.xxh64_intdigest(r) >> 1 for r in runs)[:SKETCH]


def without_copies(examples: DataFrame) -> DataFrame:
    """``examples`` (doc_id, toxic, text), one of each group of near copies of one label, with ``share``.

    Of equal texts the one of least id stays; ``share`` is the part of them that is labelled toxic, and ``toxic`` whether that is at least half.
    Near copies share most of their sketch. For each hash and label the holder of the least text hash leads; an example that has at
    least half of its sketch from one other leader of its label goes. Else the words of a text with many copies would pass
    for signs of its label, and its copies would fill a neighbourhood. Copies of opposite labels both stay. Texts without a word are all kept.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_sketch(t.as_py()) for t in batch["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["toxic"], found], ["key", "toxic", "sketch"])

    worded = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = examples.withColumn("share", F.col("toxic").cast("double")).withColumn("blank_id", F.when(~worded, F.col("doc_id")))
    equal = own.groupBy("text", "blank_id").agg(F.avg("share").alias("share"), F.min("doc_id").alias("doc_id"))
    keyed = equal.withColumn("toxic", (F.col("share") >= 0.5).cast("int")).withColumn("key", F.to_json(F.struct(F.xxhash64("text").alias("t"), F.xxhash64("doc_id").alias("i"))))
    keyed = staged(keyed.select("doc_id", "toxic", "share", "text", "key"), "toxicity-texts")
    flat = keyed.select("key", "toxic", "text").mapInArrow(sketched, "key string, toxic int, sketch array<long>")
    flat = flat.select("key", "toxic", F.size("sketch").alias("size"), F.explode("sketch").alias("hash"))
    flat = staged(flat, "toxicity-sketches")
    leaders = flat.groupBy("hash", "toxic").agg(F.min("key").alias("leader"))
    shared = flat.join(leaders, ["hash", "toxic"]).where("leader <> key").groupBy("key", "leader", "size").agg(F.count("*").alias("n"))
    copies = shared.where(2 * F.col("n") >= F.col("size")).select("key").distinct()
    return keyed.join(copies, "key", "left_anti").select("doc_id", "toxic", "share", "text")


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples by term and label, summed over a task."""
    seen = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            seen[toxic].update(set(words(text)))
    terms = list(seen[0] | seen[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)], ["term", "n0", "n1"]
    )


def _numbered(text: str | None, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """A text's known terms, ascending, and their counts."""
    found = Counter(words(text))
    ids = np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))
    counts = np.fromiter(found.values(), np.int64, len(found))
    order = np.argsort(ids)[np.count_nonzero(ids < 0) :]
    return ids[order], counts[order]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The integers from each ``first`` to before its ``last``, one range after the other."""
    n = last - first
    if not len(n):
        return np.empty(0, np.int64)
    ends = n.cumsum()
    out = np.arange(ends[-1])
    out += (first - ends + n).repeat(n)
    return out


class BlockMaxIndex:
    """An inverted index of unit vectors whose postings are cut at the same examples for all terms.

    For each term and block of examples that has it, the greatest weight is kept. Their products with a query bound
    every cosine in a block, so blocks are read from the greatest bound down until no other can hold a
    nearer example than those found. ``rows`` are (name, ids, counts, label), in the order in which equally near ones are taken.
    """

    def __init__(self, term_weights: np.ndarray, rows: list[tuple[object, np.ndarray, np.ndarray, float]], block: int = BLOCK) -> None:
        self.term_weights, self.size = term_weights, block
        vectors = [(self.weights(ids, counts), ids, name, label) for name, ids, counts, label in rows]
        blank = [label for w, _, _, label in vectors if not len(w)]
        labels = [label for *_, label in rows]
        self.rate = (sum(labels) + 0.5) / (len(labels) + 5)
        self.blank_rate = (sum(blank) + self.rate) / (len(blank) + 1)
        vectors = [v for v in vectors if len(v[0])]
        # Examples that share their weightiest term are neighbours: it tightens the bounds.
        vectors.sort(key=lambda v: (int(v[1][v[0].argmax()]), len(v[1])))
        self.names, self.labels = [v[2] for v in vectors], np.array([v[3] for v in vectors], np.float64)
        self.blocks = -(-len(vectors) // block)
        term = (np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0, np.int64)).astype(np.int32)
        value = (np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0))
        example = np.repeat(np.arange(len(vectors)), [len(v[1]) for v in vectors])
        order = np.argsort(term, kind="stable")
        term, self.value, self.example = term[order], value[order], example[order]
        # A cell is a term's postings in one block.
        block_of = self.example // block
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block_of[1:] != block_of[:-1])))) if len(term) else order
        self.postings_from = np.append(new, len(term))
        self.cell_block = block_of[new]
        self.cell_max = np.maximum.reduceat(self.value, new) if len(term) else self.value
        self.cells_from = np.searchsorted(term[new], np.arange(len(term_weights) + 1))

    def weights(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of (1 + ln tf) times the terms' weights; empty if all are 0."""
        w = (1 + np.log(counts)) * self.term_weights[ids] if len(ids) else np.empty(0)
        norm = math.sqrt(float(w @ w))
        return w / norm if norm > 0 else np.empty(0)

    def nearest(self, ids: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples of greatest cosine over 0, equal ones in index order, their cosines, and the number of blocks read."""
        w = self.weights(ids, counts)
        best_at, best, read = np.empty(0, np.int64), np.empty(0), 0
        if not len(w) or not self.blocks:
            return best_at, best, read
        first, last = self.cells_from[ids], self.cells_from[ids + 1]
        cells, own = _ranges(first, last), w.repeat(last - first)
        block_of = self.cell_block.take(cells)
        bounds = np.bincount(block_of, own * self.cell_max.take(cells), minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        for step in (*STEPS, self.blocks):
            floor = best[-1] - EPSILON if len(best) == k else EPSILON
            some = order[read : read + step]
            some = some[bounds[some] >= floor]
            if not len(some):
                break
            read += len(some)
            chosen = np.zeros(self.blocks, bool)
            chosen[some] = True
            chosen = np.flatnonzero(chosen.take(block_of))
            of = cells.take(chosen)
            a = self.postings_from.take(of)
            n = self.postings_from.take(of + 1) - a
            at = _ranges(a, a + n)
            products = own.take(chosen).repeat(n)
            products *= self.value.take(at)
            scores = np.bincount(self.example.take(at), products, minlength=len(self.labels))
            found = np.flatnonzero(scores >= floor)
            best_at, best = np.concatenate((best_at, found)), np.concatenate((best, np.round(scores[found], 9)))
            kept = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[kept], best[kept]
        return best_at, best, read

    def score(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
        """The chance of label 1 and the nearest examples.

        Votes weigh the inverse of the distance 1 - cosine; the base rate counts as PRIOR_VOTES votes, so few and far
        neighbours move the score little. A text without a known term has the rate of such examples.
        """
        at, cosines, _ = self.nearest(ids, counts)
        if not len(at):
            return float(self.blank_rate), []
        votes = 1 / (1 - np.minimum(cosines, 1) + 0.1)
        share = (votes @ self.labels[at] + PRIOR_VOTES * self.rate) / (votes.sum() + PRIOR_VOTES)
        evidence = [
            {"doc_id": self.names[i], "cosine": float(c), "toxic": int(self.labels[i] >= 0.5)}
            for i, c in zip(at[:EVIDENCE].tolist(), cosines, strict=False)
        ]
        return float(min(1.0, max(0.0, share))), evidence


def term_weights(n0: np.ndarray, n1: np.ndarray, holders0: np.ndarray, holders1: np.ndarray, docs: int, frequency: np.ndarray) -> np.ndarray:
    """Inverse document frequency over all documents times the chi-square of a term's presence and the label, as a share of the examples.

    No term is left out; one that tells the labels apart counts for more.
    """
    n, has = n0 + n1, holders0 + holders1
    excess = holders1 * float(n0) - holders0 * float(n1)
    chi2 = excess * excess / np.maximum(has * (n - has) * float(n0) * float(n1), 1)
    return (np.log((1 + docs) / (1 + frequency)) + 1) * chi2


def held_out():
    """True for documents whose labels are never learnt; a null id is never held out, and has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    """What ``fit`` has learnt, as sent to the tasks: each term's number, and the index."""

    number: Broadcast
    index: Broadcast


def _frequencies(docs: DataFrame, number: Broadcast) -> tuple[int, dict[int, int]]:
    """The number of ``docs``, and of those with each known term, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = number.value, 0
        totals = np.zeros(len(known), np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch["text"]:
                found = [known[w] for w in set(words(text.as_py())) if w in known]
                totals[found] += 1
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(totals[at], n))], ["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals = dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))
    return totals.pop(-1, 0), totals


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Weigh the terms and build the index of examples.

    Examples are up to ``examples`` rows, by hash of doc_id, of ``labels`` (doc_id, toxic) that aren't held
    out and have a document; near copies count once. Terms are all words of the examples. A term weighs its inverse document frequency,
    from all ``docs``, times its chi-square with the label among the examples.
    Labels other than 0 and 1 and null ids are left out; of several labels of one id the greatest
    counts, of several documents under one id the first by text. With examples of one label only, chi-squares are 0, and every
    text gets the base rate.
    """
    known = labels.where(~held_out()).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = staged(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-examples")
    texts = staged(without_copies(texts), "toxicity-originals")

    counts = texts.select("text", "toxic").mapInArrow(_term_labels, "term string, n0 long, n1 long")
    counts = counts.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("term")
    spark = docs.sparkSession
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(counts["term"].to_pylist())})
    n, found = _frequencies(docs, number)
    frequency = np.zeros(len(number.value), np.int64)
    frequency[list(found)] = list(found.values())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_numbered(t.as_py(), number.value) for t in batch["text"]]
            columns = [pa.array([o[i] for o in own], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "toxic", "share", "t")), *columns], ["doc_id", "toxic", "share", "t", "ids", "counts"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.withColumn("t", F.xxhash64("text")).mapInArrow(numbered, f"doc_id {kind}, toxic int, share double, t long, ids array<int>, counts array<int>")
    rows = rows.toArrow().sort_by([("t", "ascending"), ("toxic", "ascending")])  # at most ``examples``
    by = [int((np.array(rows["toxic"]) == label).sum()) for label in (0, 1)]
    weights = term_weights(*by, *(counts[c].to_numpy().astype(np.float64) for c in ("n0", "n1")), n, frequency)
    vectors = list(
        zip(
            rows["doc_id"].to_pylist(),
            *([x.values.to_numpy().astype(np.int64) for x in rows[c]] for c in ("ids", "counts")),
            rows["share"].to_pylist(),
            strict=True,
        )
    )
    return Model(number, spark.sparkContext.broadcast(BlockMaxIndex(weights, vectors)))


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text) by the labelled examples most like it; see ``fit``.

    Every text is scored whole; null and empty ones, and those without a known term, get the rate
    of such examples. Repeated rows and null ids are kept. Without labels of both kinds all get the base rate.

    Returns doc_id, held_out, score, predicted, evidence (doc_id, cosine, toxic of the nearest).
    """
    number, sent = fit(docs, labels, examples)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = sent.value, number.value
        for batch in batches:
            own = batch.schema.field("doc_id").type
            evidence = pa.list_(pa.struct([("doc_id", own), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            found = [index.score(*_numbered(t.as_py(), known)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], evidence)],
                ["doc_id", "score", "evidence"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},cosine:double,toxic:int>>"
    )
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; see ``toxicity``."""
    number, sent = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = sent.value, number.value
        for batch in batches:
            scores = [index.score(*_numbered(text.as_py(), known))[0] for text in batch["text"]]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
