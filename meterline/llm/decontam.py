"""Benchmark decontamination by suffix arrays of the training texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHARE = 20  # a document is contaminated if one word in so many is hit
ITEM_BYTES = 2 << 20  # benchmark text that is broadcast at once; a larger benchmark goes in several parts
SHARD_BYTES = 16 << 20  # text under one suffix array

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class TestSuffixes:
    """The windows of some items, each different one once, as rows of word numbers that suffix arrays are searched for.

    A window is every stretch of ``window`` words of an item, or an item of fewer words as a whole.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window, self.names = window, []
        self.vocabulary: dict[bytes, int] = {}
        where: dict[tuple[int, ...], list[tuple[int, int]]] = {}  # the items and their places that have a window
        for name, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if numbers:
                self.names.append(name)
                for i in range(max(1, len(numbers) - window + 1)):
                    where.setdefault(tuple(numbers[i : i + window]), []).append((len(self.names) - 1, i))
        self.lengths = np.array([len(w) for w in where], np.int64)
        self.rows = np.zeros((len(where), window), np.int64)
        for i, w in enumerate(where):
            self.rows[i, : len(w)] = w
        self.holders = np.array([h for hs in where.values() for h in hs], np.int64).reshape(-1, 2)
        self.held_from = np.cumsum([0, *(len(hs) for hs in where.values())])
        bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.bits, self.per = bits, 63 // bits
        # Suffixes that begin with no window's first two words (or only word) match none.
        first, second = self.rows[:, 0], self.rows[:, min(1, window - 1)]
        self.single = np.zeros(len(self.vocabulary) + 1, bool)
        self.single[first[self.lengths == 1]] = True
        self.pairs = np.unique(first[self.lengths > 1] << bits | second[self.lengths > 1])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.pairs)] = True

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 7) & 0xFFFFF

    def packed(self, rows: np.ndarray, fill: np.ndarray | None = None) -> list[np.ndarray]:
        """Rows of word numbers as columns of integers that compare alike; where ``fill`` is true, the greatest number."""
        rows = rows if fill is None else np.where(fill, (1 << self.bits) - 1, rows)
        columns = []
        for i in range(0, rows.shape[1], self.per):
            part = np.zeros(len(rows), np.int64)
            for j in range(i, min(i + self.per, rows.shape[1])):
                part = part << self.bits | rows[:, j]
            columns.append(part)
        return columns

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        """Positions whose suffix may begin with a window."""
        found = self.single[numbers[:-1]] if self.single.any() else np.zeros(len(numbers) - 1, bool)
        both = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        pairs = numbers[both] << self.bits | numbers[both + 1]
        kept = self.maybe[self._slot(pairs)]
        both, pairs = both[kept], pairs[kept]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            found[both[self.pairs[at] == pairs]] = True
        return np.flatnonzero(found)


def _bound(array: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """By binary search, for each key the first place in the sorted ``array`` not before (or, ``after``, beyond) it."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(array[0]), np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) >> 1, len(array[0]) - 1)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for column, key in zip(array, keys, strict=True):
            here = column[middle]
            less |= equal & (here < key)
            equal &= here == key
        less = (less | equal if after else less) & open_
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


def search_shard(tests: TestSuffixes, texts: list[str | None]) -> list[tuple[int, list[dict], list[dict]]]:
    """For each text its number of words, its hit stretches and, for each matching item, the longest match.

    The texts' suffixes, compared by their first ``window`` words, are sorted into one suffix array, in which every
    test suffix is looked up. A match is a stretch of the text that stands in the item word for word: windows make one longer where
    both their places in the text and those in the item follow each other.
    """
    number = tests.vocabulary.get
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = words(text)
        sizes[i] = len(found)
        parts += [np.fromiter(map(number, found, repeat(0)), np.int64, len(found)), np.zeros(1, np.int64)]
    numbers = np.concatenate([*parts, np.zeros(tests.window + 1, np.int64)])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    starts = tests.starts(numbers)
    out = [(int(n), [], []) for n in sizes]
    if not len(starts) or not len(tests.rows):
        return out
    columns = tests.packed(numbers[starts[:, None] + np.arange(tests.window)])
    order = np.lexsort(columns[::-1])
    suffixes, columns = starts[order], [c[order] for c in columns]
    low = _bound(columns, tests.packed(tests.rows), after=False)
    high = _bound(columns, tests.packed(tests.rows, np.arange(tests.window) >= tests.lengths[:, None]), after=True)
    times = np.maximum(high - low, 0)
    if not times.any():
        return out
    window = np.repeat(np.arange(len(times)), times)
    place = suffixes[np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(window))]

    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + tests.lengths[window], -1)
    hit = np.concatenate(([False], np.cumsum(edges) > 0, [False]))
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    for a, b, d in zip(first, last, np.searchsorted(begin, first, "right") - 1, strict=True):
        out[d][1].append({"start": int(a - begin[d]), "n": int(b - a)})

    holders = tests.held_from[window + 1] - tests.held_from[window]
    at = np.repeat(tests.held_from[window] - np.concatenate(([0], np.cumsum(holders)[:-1])), holders) + np.arange(holders.sum())
    item, theirs = tests.holders[at].T
    place, length = np.repeat(place, holders), np.repeat(tests.lengths[window], holders)
    apart = place - theirs
    order = np.lexsort((place, apart, item))
    item, place, length, apart = item[order], place[order], length[order], apart[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (apart[1:] != apart[:-1]) | (place[1:] != place[:-1] + 1)))
    run = np.flatnonzero(new)
    spans = np.diff(np.concatenate((run, [len(item)]))) - 1 + length[run]
    of = np.searchsorted(begin, place[run], "right") - 1
    order = np.lexsort((place[run], -spans, item[run], of))
    seen = None
    for i in order:
        key = (int(of[i]), int(item[run[i]]))
        if key != seen:
            seen = key
            out[key[0]][2].append(
                {"item": tests.names[key[1]], "start": int(place[run[i]] - begin[key[0]]), "n": int(spans[i])}
            )
    return out


MATCHES = "n_words long, spans array<struct<start:long,n:long>>, matches array<struct<item:string,start:long,n:long>>"
_TYPES = pa.schema(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))),
        ("matches", pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))),
    ]
)


def _shards(tests: TestSuffixes, batch: pa.RecordBatch) -> list[tuple[int, list[dict], list[dict]]]:
    """What ``search_shard`` finds for a batch's texts, at most about SHARD_BYTES of them at once."""
    texts, size, found = [], 0, []
    for text in batch["text"].to_pylist():
        texts.append(text)
        size += len(text or "")
        if size > SHARD_BYTES:
            found += search_shard(tests, texts)
            texts, size = [], 0
    return found + search_shard(tests, texts) if texts else found


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            found = _shards(tests, batch)
            columns = [pa.array([f[i] for f in found], t.type) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], *columns], ["doc_id", "text_key", *_TYPES.names])

    return run


def _parts(benchmark: DataFrame, item_bytes: int) -> tuple[DataFrame, int]:
    """The items that have a text, and the number of parts in which they are sent."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first().size
    return items, max(1, math.ceil(size / item_bytes))


def _tests(items: DataFrame, part: int, parts: int, window: int) -> Broadcast:
    own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    tests = TestSuffixes([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], window)
    return items.sparkSession.sparkContext.broadcast(tests)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The stretches of each row of ``docs`` (doc_id, text) that occur in ``benchmark`` (item_id, text).

    Every task builds suffix arrays of its texts and binary-searches all test suffixes in them. The
    benchmark is sent whole while it has at most ``item_bytes`` of text; a larger one is cut by item into as
    many parts as needed, each searched in a pass of its own, and the passes' findings are united by row.

    Returns doc_id, n_words, spans (start, n: disjoint stretches of hit words) and matches (item, start, n:
    each item's longest verbatim one). Null and empty texts have no words and no match. Items of fewer words than a window match as a
    whole; those without words match nothing; those without an id hit words but are named null.
    """
    items, parts = _parts(benchmark, item_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("text") if parts > 1 else F.lit(0).cast("long")
    keyed = docs.select("doc_id", "text", key.alias("text_key"))
    passes = [
        keyed.mapInArrow(_search(_tests(items, part, parts, window)), f"doc_id {kind}, text_key long, {MATCHES}")
        for part in range(parts)
    ]
    if parts == 1:
        return passes[0].drop("text_key")
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    found = union.groupBy("doc_id", "text_key", "n_words").agg(
        (F.count("*") / parts).cast("int").alias("rows"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
    )
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select("doc_id", "n_words", "spans", "matches")


def _covered(spans):
    """The words in the union of spans, which may overlap if they come from several passes."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["n"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], F.least(s["start"], end))).alias("n"), end.alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Judge each row of ``docs``: contaminated if at least one word in ``share``, and any, is in a benchmark window.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim match, 0 if none) and the matches. Items are counted by their
    id; a benchmark item without an id contaminates but isn't counted. Repeated rows and null ids are kept.
    """
    found = longest_matches(docs, benchmark, window)
    named = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    found = found.withColumn("n_hit", _covered(F.col("spans"))).withColumn("items", named)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n"])), F.lit(0)).alias("longest"),
        "matches",
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contamination`` finds clean."""
    items, parts = _parts(benchmark, item_bytes)
    if parts > 1:  # a verdict needs all parts; equal texts have equal ones
        judged = contamination(docs.select(F.sha2("text", 256).alias("doc_id"), "text"), benchmark, window, share)
        bad = judged.where("contaminated").select(F.col("doc_id").alias("__text_digest")).distinct()
        return docs.join(bad, F.sha2(docs["text"], 256) == F.col("__text_digest"), "left_anti")
    sent = _tests(items, 0, 1, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for n_words, spans, _ in _shards(sent.value, batch):
                n_hit = sum(s["n"] for s in spans)
                clean.append(not (n_hit and share * n_hit >= n_words))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
