"""Language-model scores by stupid backoff over counts of the whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

NUMBERED = 65_534  # most frequent words, whose counts are sent; 16 bits hold their numbers, 0 and the start
FREQUENT = 510  # of the most frequent words; pairs of these, the unknown word and the start are at most 262,144
BACKOFF = 0.4
FLUSH_WORDS = 200_000
SLICE_ROWS = 1_000  # documents whose pairs are held at once
NONE = np.iinfo(np.int64).max  # in place of a null
START = b""  # stands before a document's first word
SEED = 42  # of Spark's xxhash64
WORD = 1 << 16  # added to a word's number to tell it from a context's

_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"]
        )
        seen.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            found = words(text.as_py())
            seen.update([START, *found] if found else [])
            if len(seen) > FLUSH_WORDS:
                yield emit()
    yield emit()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8) and n over all of ``docs`` (text); the start is counted once for each row with words."""
    return docs.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_key(word: bytes) -> int:
    """The 63-bit hash, negative, that stands for a word without a number; as Spark's xxhash64, with the sign bit set."""
    return (xxhash.xxh64_intdigest(word, SEED) | 1 << 63) - (1 << 64)


class Pairs:
    """How a text's words become pairs.

    A pair of two numbers is context << 16 | word. Any other pair has an anchor, the key of its word or, if the word has
    a number, of its context, and the other word: the context's number or key, or the word's number plus WORD.
    """

    def __init__(self, numbers: dict[bytes, int], start: int, frequent: int = FREQUENT, unknown: bool = False) -> None:
        self.numbers, self.start, self.most, self.unknown = numbers, start, frequent, unknown

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Each word's context and the word, as numbers; a word without one is 0 if ``unknown``, else its key."""
        found, number = words(text), self.numbers.get
        each = map(number, found, repeat(0)) if self.unknown else (number(w) or word_key(w) for w in found)
        ids = np.fromiter(each, np.int64, len(found))
        return (np.concatenate(([self.start], ids[:-1])), ids) if len(ids) else (ids, ids)

    def numbered(self, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of two numbers, ascending, and how often each occurs."""
        both = (contexts >= 0) & (ids >= 0)
        return np.unique((contexts << 16 | ids)[both], return_counts=True)

    def keyed(self, contexts: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Anchors and others of the different pairs with a word that has no number, and how often each occurs."""
        some = (contexts < 0) | (ids < 0)
        contexts, ids = contexts[some], ids[some]
        anchors, others = np.where(ids < 0, ids, contexts), np.where(ids < 0, contexts, ids + WORD)
        found = Counter(zip(anchors.tolist(), others.tolist(), strict=True))
        return [np.array(c, np.int64) for c in ([a for a, _ in found], [o for _, o in found], list(found.values()))]

    def frequent(self, pairs: np.ndarray) -> np.ndarray:
        """Whether both of a pair's words are among the most frequent, unknown or the start."""
        common = lambda x: (x <= self.most) | (x == self.start)
        return common(pairs >> 16) & common(pairs & 0xFFFF)


def frequent_pairs(docs: DataFrame, sent: Broadcast) -> pa.Table:
    """pair, n and holders (document rows) of the pairs of frequent words: at most (FREQUENT + 2) ** 2 rows, summed by task before they are shuffled.

    Every other pair has a word that at least FREQUENT words outnumber, so no such pair makes up over
    1 / (FREQUENT + 1) of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [sent.value.numbered(*sent.value.ids(text.as_py())) for text in batch["text"]]
            pairs = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
            times = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
            keep = sent.value.frequent(pairs)
            own, at = np.unique(pairs[keep], return_inverse=True)
            n = np.bincount(at, weights=times[keep], minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(np.bincount(at, minlength=len(own)))], ["pair", "n", "holders"])

    counts = docs.select("text").mapInArrow(count, "pair long, n long, holders long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("holders").alias("holders")).orderBy("pair").toArrow()


class FrequentScores:
    """The logarithm of the score of each pair of frequent words."""

    def __init__(self, counts: pa.Table, unigrams: dict[int, int], total: int, backoff: float) -> None:
        self.pairs = counts["pair"].to_numpy()
        n, holders = counts["n"].to_numpy(), counts["holders"].to_numpy()
        of = lambda ids: np.array([unigrams[i] for i in ids.tolist()], np.float64)
        seen, unseen = n / of(self.pairs >> 16), of(self.pairs & 0xFFFF) * (backoff / max(1, total))
        self.logs = np.log(np.where(holders > 1, seen, unseen))

    def sum(self, pairs: np.ndarray, n: np.ndarray) -> float:
        return float(self.logs[np.searchsorted(self.pairs, pairs)] @ n)


def bigrams(docs: DataFrame, pairs: Broadcast, scores: Broadcast) -> DataFrame:
    """For each document row its rarer pairs, each different one once, and one row with the sums over its frequent ones.

    doc_id, anchor, n, s and other (see ``Pairs``); for two numbers the anchor is the pair and other is null. s is the frequent
    pairs' score and null in a pair's row. The row of sums has a number beyond all pairs' for an anchor, a hash of the
    id and text, so that these rows spread as well.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own, counts, sums, others, sizes = [], [], [], [], np.ones(batch.num_rows, np.int64)
            for i, (name, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                contexts, ids = pairs.value.ids(text)
                found, n = pairs.value.numbered(contexts, ids)
                anchors, other, times = pairs.value.keyed(contexts, ids)
                common = pairs.value.frequent(found)
                mark = xxhash.xxh64_intdigest(f"{name} {text}".encode("utf-8", "surrogatepass")) >> 1 | 1 << 32
                own += [anchors, found[~common], np.array([mark])]
                counts += [times, n[~common], np.array([n[common].sum()])]
                sizes[i] += len(anchors) + len(own[-2])
                sums += [np.full(sizes[i] - 1, np.nan), np.array([scores.value.sum(found[common], n[common])])]
                others += [other, np.full(sizes[i] - len(anchors), NONE)]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            flat = [np.concatenate(c) if c else np.empty(0) for c in (own, counts, sums, others)]
            other = flat[3].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(rows),
                    pa.array(flat[0].astype(np.int64)),
                    pa.array(flat[1].astype(np.int64)),
                    pa.array(flat[2], from_pandas=True),
                    pa.array(other, mask=other == NONE),
                ],
                ["doc_id", "anchor", "n", "s", "other"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(split, f"doc_id {kind}, anchor long, n long, s double, other long")


def backoff_scores(
    docs: DataFrame, vocabulary: int | None = None, backoff: float = BACKOFF, frequent: int = FREQUENT, numbered: int = NUMBERED
) -> DataFrame:
    """Score each document of ``docs`` (doc_id, text) by a bigram model of all of them.

    Words and pairs are counted over the whole corpus, each word on its own. A word's score after its
    predecessor is c(predecessor, word) / c(predecessor) if another document has the pair as well, and
    ``backoff`` * c(word) / N if not. The ``numbered`` most frequent words (at most 65,534) have numbers and their counts are
    sent to the tasks; any other word goes by a 63-bit hash, where its count meets its pairs. Pairs of the ``frequent``
    most frequent words are counted first and their table is sent. All other pairs meet by a word without a number, or else by the pair, where a pair's
    total is summed beside its rows, and the logarithms are summed per document. None of these sizes changes a score.

    With a ``vocabulary`` (at most 65,534) all but that many most frequent words are one unknown word, whose count is theirs together.

    Returns doc_id, n_words, log_score (natural logarithm, 6 decimals) and mean_score (null without words). Null
    and empty texts have no words and a log_score of 0. Rows that share an id, null included, are one document.
    """
    for name, size in (("vocabulary", vocabulary), ("numbered", numbered)):
        if size is not None and not 0 < size <= NUMBERED:
            raise ValueError(f"{name} must be from 1 to {NUMBERED}")
    sent = vocabulary or numbered
    counted = staged(word_counts(docs), "lm-words")
    is_start = F.col("word") == F.lit(START)
    total, starts = counted.agg(
        F.coalesce(F.sum(F.when(~is_start, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(is_start, F.col("n"))), F.lit(0))
    ).first()
    top = counted.where(~is_start).orderBy(F.desc("n"), "word").limit(sent).collect()
    start = sent + 1
    # At most 65,536 rows.
    unigrams = [(0, total - sum(r.n for r in top)), *((i + 1, r.n) for i, r in enumerate(top)), (start, starts)]
    spark = docs.sparkSession
    numbers = {bytes(r.word): i + 1 for i, r in enumerate(top)}
    pairs = spark.sparkContext.broadcast(Pairs(numbers, start, frequent, vocabulary is not None))
    scores = FrequentScores(frequent_pairs(docs, pairs), dict(unigrams), total, backoff)
    rows = bigrams(docs, pairs, spark.sparkContext.broadcast(scores))
    rare = vocabulary is None and total > sum(r.n for r in top)
    if rare:  # a word's count meets its pairs; a word without a row here occurs once
        rows = rows.unionByName(counted.where("n > 1").select(_key().alias("anchor"), "n"), allowMissingColumns=True)
    rows = rows.repartition("anchor").withColumns(
        {k: f.over(Window.partitionBy("anchor", "other")) for k, f in (("both", F.sum("n")), ("holders", F.count("*")))}
    )
    if rare:
        is_count = (F.col("anchor") < 0) & F.col("other").isNull()
        rows = rows.withColumn("own", F.max(F.when(is_count, F.col("n"))).over(Window.partitionBy("anchor"))).where(~is_count)
    else:
        rows = rows.withColumn("own", F.lit(None).cast("long"))
    seen, other = F.col("holders") > 1, F.col("other")
    # The word whose count a row's score takes, the context's if the pair is seen, else its own; null if that is the anchor.
    key = F.when(other.isNull(), F.when(seen, F.shiftright("anchor", 16)).otherwise(F.col("anchor").bitwiseAND(0xFFFF)))
    key = key.when(seen & (other < WORD), other).when(~seen & (other >= WORD), other - WORD)
    rows = rows.withColumn("key", F.when(F.col("s").isNull(), key))
    table = spark.createDataFrame(unigrams, "key long, c long")
    rows = rows.join(F.broadcast(table), "key", "left")
    count = F.coalesce(F.log(F.when(F.col("key").isNull(), F.col("own")).otherwise(F.col("c"))), F.lit(0.0))
    one = F.when(seen, F.log("both") - count).otherwise(F.log(F.lit(backoff / max(1, total))) + count)
    rows = rows.select(
        "doc_id",
        "n",
        F.coalesce("s", F.col("n") * one).alias("s"),
        F.when(F.col("key") < 0, F.col("key")).alias("key"),
        F.when(F.col("key") < 0, -F.col("n")).alias("times"),
    )
    if rare:
        rows = _with_counts(rows, counted)
    sums = rows.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("s").alias("s"))
    return sums.select(
        "doc_id",
        "n_words",
        F.round("s", 6).alias("log_score"),
        F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).alias("mean_score"),
    )


def _key():
    return F.xxhash64("word").bitwiseOR(F.lit(-(1 << 63)))


def _with_counts(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` with ``times`` logarithms of the count of the word ``key`` added to s.

    Rows without a key are summed by document first and spread by its hash, which isn't negative and so meets no key. A
    word without a number is outnumbered by all that have one, so no key makes a large group.
    """
    held = rows.groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("times").alias("times"))
    held = held.withColumn("key", F.coalesce("key", F.shiftrightunsigned(F.xxhash64("doc_id"), 1)))
    counts = counted.where("n > 1").groupBy(_key().alias("key")).agg(F.max("n").alias("c"))
    added = F.coalesce(F.col("times") * F.log("c"), F.lit(0.0))
    return held.join(counts, "key", "left").select("doc_id", "n", (F.col("s") + added).alias("s"))
