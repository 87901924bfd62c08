"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PROFILE = 400  # n-grams in a profile, and most of a document's that are compared
MAX_LANGUAGES = 2_000  # profiles are broadcast: 2,000 of 400 n-grams are under 20 MB
MIN_SCORE = 0.1  # of a text that is kept; texts of the learnt languages score 0.39 or more
FLUSH_KEYS = 2_000_000
UNDETERMINED = "und"
EDGE = 1  # stands for the blank around words; no letter has this code point


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """The 1-, 2- and 3-grams of the letters in a text's words, each word between two edges, as integers.

    Three code points of 21 bits each; a shorter n-gram has zeros in front.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, EDGE)
    before = np.concatenate(([True], letter[:-1]))
    codes = codes[letter | before]
    edge = np.array([EDGE], np.int64)
    codes = np.concatenate((edge[: int(codes[0] != EDGE)], codes, edge[: int(codes[-1] != EDGE)]))
    pairs = codes[:-1] << 21 | codes[1:]
    triples = pairs[:-1] << 21 | codes[2:]
    return np.concatenate((codes[codes != EDGE], pairs, triples[codes[1:-1] != EDGE]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def ranked(keys: np.ndarray, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their ranks; equally frequent ones share their mean rank."""
    values, counts = _counted(keys)
    order = np.argsort(-counts, kind="stable")[:size]
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1])))
    last = np.concatenate((first[1:], [len(counts)]))
    return values, np.repeat((first + last - 1) / 2, last - first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and n-gram, summed over a task as far as memory allows."""
    sums: dict[str, list] = {}
    raw: dict[str, list] = {}
    pending = 0

    def fold() -> None:
        for lang, keys in raw.items():
            sums[lang] = [_merged([*sums.get(lang, []), _counted(np.concatenate(keys))])]
        raw.clear()

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, [(keys, counts)] in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts, pa.int64())],
                ["lang", "gram", "n"],
            )
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            keys = grams(text)
            if len(keys):
                raw.setdefault(lang, []).append(keys)
                pending += len(keys)
            if pending > FLUSH_KEYS:
                fold()
                pending = 0
                if sum(len(keys) for [(keys, _)] in sums.values()) > FLUSH_KEYS:
                    yield from emit()
    fold()
    yield from emit()


def learn_profiles(examples: DataFrame, size: int = PROFILE) -> DataFrame:
    """The ``size`` most frequent n-grams of each language over all ``examples`` (text, lang), with ranks from 0.

    Examples with null text or null lang, or without a letter, teach nothing. Returns lang, gram, rank.
    """
    counts = (
        examples.select("lang", "text")
        .where("lang is not null and text is not null")
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The condition is on the row number itself: Spark then drops most n-grams before they are shuffled.
    ranks = counts.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= size)
    return ranks.select("lang", "gram", (F.col("nth") - 1).alias("rank"))


class Profiles:
    """All languages' ranks, by n-gram; ``size`` where a language's profile lacks it."""

    def __init__(self, rows: list, size: int) -> None:
        self.size = size
        self.langs = sorted({r.lang for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), float(size))
        where = np.searchsorted(self.grams, np.array([r.gram for r in rows], np.int64))
        self.ranks[where, [at[r.lang] for r in rows]] = [r.rank for r in rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance; the score is 1 less its share of the greatest possible."""
        keys = grams(text) if text else np.empty(0, np.int64)
        if not len(keys) or not self.langs:
            return UNDETERMINED, 0.0
        values, ranks = ranked(keys, self.size)
        where = np.minimum(np.searchsorted(self.grams, values), len(self.grams) - 1)
        known = (self.grams[where] == values)[:, None]
        theirs = np.where(known, self.ranks[where], self.size)
        places = np.where(theirs < self.size, np.abs(theirs - ranks[:, None]), self.size)
        distances = places.sum(axis=0)
        best = int(distances.argmin())
        return self.langs[best], float(1 - distances[best] / (len(values) * self.size))


def _blocks(profiles: DataFrame, size: int, most: int) -> Iterator[Broadcast]:
    """Profiles of up to ``most`` languages at a time, in order of name, as sent to the tasks; one without any if there is no profile."""
    context = profiles.sparkSession.sparkContext
    block: list = []
    langs = 0
    for r in staged(profiles, "profiles").orderBy("lang", "rank").toLocalIterator():
        if not block or block[-1].lang != r.lang:
            if langs == most:
                yield context.broadcast(Profiles(block, size))
                block, langs = [], 0
            langs += 1
        block.append(r)
    yield context.broadcast(Profiles(block, size))


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE, most: int = MAX_LANGUAGES) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to the rows of ``docs`` (doc_id, text).

    A document's most frequent n-grams are compared, by out-of-place distance, to each profile; whole
    texts count. Null texts and texts without a letter get ``und`` and 0, as does every text if there is no
    profile. Of equally near languages the first by name is taken. Beyond ``most`` languages their profiles are sent block by block, each of which
    improves on the ones before. Returns a row for each row, repeated ones and null ids included: doc_id, lang_pred, score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    for sent in _blocks(profiles, size, most):
        rows = rows.mapInArrow(_improved(sent), f"doc_id {kind}, text string, lang_pred string, score double")
    return rows.drop("text")


def _improved(sent: Broadcast):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = []
            for text, had in zip(batch["text"], zip(batch["lang_pred"].to_pylist(), batch["score"].to_pylist())):
                lang, score = known.predict(text.as_py())
                found.append((lang, score) if had[0] == UNDETERMINED or score > had[1] else had)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "text", "lang_pred", "score"],
            )

    return label


def held_out():
    """True for documents that profiles don't learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out, and predict for all."""
    found = identify(docs, learn_profiles(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, size: int = PROFILE, min_score: float = MIN_SCORE, most: int = MAX_LANGUAGES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told; see ``learn_and_identify``.

    Texts without a letter go, null and empty ones included, and texts that are as far from every profile as can be: whose score
    is under ``min_score``. If there is no profile, because no row has a lang, only the former go.
    """
    mark = "__identified"
    kept = docs.withColumn(mark, F.lit(False))
    for sent in _blocks(learn_profiles(docs.where(~held_out()), size), size, most):
        kept = kept.mapInArrow(_marked(sent, mark, min_score), kept.schema)
    return kept.where(mark).drop(mark)


def _marked(sent: Broadcast, mark: str, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts, had = [t.as_py() for t in batch["text"]], batch[mark].to_pylist()
            if known.langs:
                found = [h or s >= min_score and p != UNDETERMINED for h, (p, s) in zip(had, map(known.predict, texts))]
            else:
                found = [bool(t) and len(grams(t)) > 0 for t in texts]
            at = batch.schema.get_field_index(mark)
            columns = [batch[i] for i in range(batch.num_columns)]
            columns[at] = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run
