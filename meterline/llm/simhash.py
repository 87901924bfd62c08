"""SimHash near-duplicate detection by covering locality-sensitive hashing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BUCKET = 1_024  # a larger bucket is compared in blocks of this size, pair of blocks by pair
COPY_WORDS = 5  # words in a shingle by which near copies are judged
COPY_SIMILARITY = 0.8
COPY_RADIUS = 5  # differing bits of the fingerprints of words that candidates may have
GROUP_SHINGLES = 4_000  # groups of candidates of at most so many shingles are compared many at a time
BLOCK_SHINGLES = 500_000  # a larger group is compared in blocks of about this many, pair of blocks by pair
CACHED_WORDS = 100_000
SHORT_WORDS = 64  # texts of fewer words are candidates by their rarest shingles as well: few words make fingerprints differ in many bits
MIDDLE_WORDS = 256  # texts of fewer words, from SHORT_WORDS on, have a second fingerprint
OTHER_SEED = 43

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The bits of each byte value, the highest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a whole text: a bit is set if it is in over half the shingles' hashes.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than a shingle
    make one shingle; null and no words give 0.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends, strict=False)])
    octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        counts = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(octets)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, key: str = "doc_id") -> DataFrame:
    """``key`` and fp (the fingerprint as a signed long) for each row of ``docs`` (key, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(hashed, f"{key} {kind}, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 masks such that any two words of 64 bits that differ in at most ``radius`` bits agree under one.

    Each bit position i gets a vector m(i) of radius + 1 bits, the mask of a nonzero vector v keeps the
    positions where m(i) . v is 1. Differences at ``radius`` positions put as many linear
    conditions m(i) . v = 0 on v, and one more unknown leaves a nonzero v that meets all of them.
    """
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    if size <= 64:
        # The nonzero vectors in turn, shuffled: each mask then keeps about half the positions.
        vectors = rng.permutation(np.arange(64) % (size - 1) + 1)
    else:
        # Of some draws of 64 vectors the one whose emptiest mask keeps the most positions.
        parity = np.array([bin(x).count("1") & 1 for x in range(size)])
        kept = lambda drawn: min(parity[drawn & v].sum() for v in range(1, size))
        vectors = max((rng.permutation(np.arange(1, size))[:64] for _ in range(32)), key=kept)
    odd = lambda v: sum(1 << i for i, m in enumerate(vectors) if (int(m) & v).bit_count() & 1)
    return [m - (1 << 64) if m >> 63 else m for m in map(odd, range(1, size))]


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (smallest member, member) that join what is linked within ``radius`` among distinct ``fps``.

    Visited members leave the set that later ones are compared to, so a dense group takes few rounds.
    """
    found, rest = [], np.sort(fps)
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = _distance(rest, todo.pop()) <= radius
            if near.any():
                todo += list(rest[near])
                found += [(int(root), int(x)) for x in rest[near]]
                rest = rest[~near]
    return found


def _linked(radius: int):
    """A function for mapInArrow: links within each row's list of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fps"]
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            sizes = np.diff(at)
            two = at[:-1][sizes == 2]
            a, b = flat[two], flat[two + 1]
            near = _distance(a, b) <= radius
            a, b = [np.minimum(a, b)[near]], [np.maximum(a, b)[near]]
            for i in np.flatnonzero(sizes > 2):
                if found := _forest(flat[at[i] : at[i + 1]], radius):
                    x, y = np.array(found, np.int64).T
                    a.append(x)
                    b.append(y)
            links = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a < b that connect the ``fp`` of ``distinct`` exactly as all pairs within ``radius`` do.

    Every fingerprint goes to one bucket of each covering table. Buckets of one are left out;
    within the others pairs are compared. A bucket of over BUCKET members is cut into blocks, and each pair of
    blocks is compared on its own, so no task holds a whole large bucket and no pair is missed.
    """
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    rows = distinct.select("fp", F.posexplode(masks).alias("t", "mask"))
    # Dealt by bucket once: Spark uses the same shuffle for the sizes and for the rows that meet them.
    rows = rows.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp").repartition("bucket")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = staged(rows.join(sizes, "bucket"), "simhash-buckets")
    small = held.where(F.col("size") <= BUCKET).groupBy("bucket").agg(F.collect_list("fp").alias("fps"))
    large = held.where(F.col("size") > BUCKET)
    blocks = F.ceil(F.col("size") / BUCKET)
    large = large.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), blocks)).select(
        "bucket", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    )
    large = large.groupBy("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps")
    )
    return _fewest(small.select("fps").union(large.select("fps")).mapInArrow(_linked(radius), "a long, b long"))


def _fewest(found: DataFrame) -> DataFrame:
    """Links a < b that connect the same as ``found`` (a, b), about one for each b.

    A member of a large group has another leader in most of its buckets and pairs of blocks. It is tied to the least of them, and
    so are the others, which are few and the same for many members. A member's leaders are no more than its buckets and pairs of blocks.
    """
    led = found.groupBy("b").agg(F.collect_set("a").alias("leaders")).withColumn("m", F.array_min("leaders"))
    tied = F.transform("leaders", lambda x: F.struct(F.col("m").alias("a"), F.when(x == F.col("m"), F.col("b")).otherwise(x).alias("b")))
    return led.select(F.explode(tied).alias("l")).select("l.a", "l.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest member of each node's component, as (node, root), from ``edges`` (a, b).

    Large-star and small-star steps in turn: each node's larger, then smaller neighbours are
    tied to the least of them, until nothing changes. What is left is a star around each root.
    """
    at = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    at, before = staged(at, "components"), None
    while True:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # Large star: a's larger neighbours go to a's least neighbour.
        at = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: b's smaller neighbours, and b, go to the least of them.
        least = at.groupBy("b").agg(F.min("a").alias("m"))
        tied = at.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
        at = tied.union(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        at = staged(at, "components")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return at.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of each row of ``docs`` (doc_id, text).

    Returns doc_id, fingerprint (16 lower-case hex digits), component_id: the smallest doc_id that
    links of at most ``radius`` differing bits reach. Copies share a fingerprint and are
    compared once. Null, empty and blank texts have fingerprint zero and link like any other. Rows
    with a null id get the component of their fingerprint, null if no row in it has an id. Repeated rows are
    kept.
    """
    prints = staged(fingerprints(docs, words), "simhash")
    return prints.join(classes(prints, radius).drop("root"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root (the class's least fingerprint) and component_id (its least doc_id) for each fp of ``prints`` (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, radius))
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # Written, so that the join's sides are plain shuffles, of which Spark splits a large class's.
    least = staged(tied.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-classes")
    return tied.join(least, "root").select("fp", "root", "component_id")


def text_key(text):
    """A column that tells texts apart: their hash; 0 for null and for texts without a word."""
    return F.when(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def word_fingerprint(words: list[bytes], known: dict[bytes, bytes], seed: int = SEED) -> int:
    """The 64-bit fingerprint of words, each weighing 1 + ln of its frequency; ``known`` remembers words' hashes of this seed.

    A changed word changes one feature of this, but several shingles, so near copies' fingerprints differ in fewer bits.
    """
    found = Counter(words)
    if not found:
        return 0
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh64_digest(w, seed)
    bits = np.unpackbits(np.frombuffer(b"".join([known[w] for w in found]), np.uint8).reshape(-1, 8), axis=1)
    weights = 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))
    return int.from_bytes(np.packbits(2 * (weights @ bits) > weights.sum()).tobytes(), "big")


def _word_fingerprints(words: int, short: int, middle: int):
    """Each text's fingerprint, a second one of a text of middle length, and the shingles of a short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        others: dict[bytes, bytes] = {}
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            prints, seconds, sets = [], [], []
            for text in batch["text"]:
                own = _words(text.as_py())
                prints.append(signed(word_fingerprint(own, known)))
                seconds.append(signed(word_fingerprint(own, others, OTHER_SEED)) if short <= len(own) < middle else None)
                sets.append(shingles(text.as_py(), words).tolist() if 0 < len(own) < short else None)
            columns = [pa.array(prints, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *columns], ["doc_id", "key", "fp", "second", "shingles"])

    return run


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a shorter text is one shingle."""
    found = _words(text)
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64).view(np.int64))


def _copies(keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (member, member) that join what is linked by pairs of at least ``similarity`` (Jaccard) among ``sets``.

    Visited members leave the set that later ones are compared to, so a group of copies takes few rounds.
    """
    order = np.argsort(keys)  # the least key leads, so groups that share members give the same links
    keys, sets = keys[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    flat, begin = np.concatenate(sets), np.cumsum(sizes) - sizes
    rest, found = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        todo = [first] if rest[first] else []
        rest[first] = False
        while todo:
            x = todo.pop()
            near = np.flatnonzero(rest & (sizes >= similarity * sizes[x]) & (similarity * sizes <= sizes[x]))
            if not len(near):
                continue
            n = sizes[near]
            starts = np.cumsum(n) - n
            others = flat[np.repeat(begin[near] - starts, n) + np.arange(n.sum())]
            place = np.minimum(np.searchsorted(sets[x], others), sizes[x] - 1)
            shared = np.add.reduceat((sets[x][place] == others).astype(np.int64), starts)
            near = near[shared >= similarity * (sizes[x] + n - shared) - 1e-9]
            rest[near] = False
            todo += near.tolist()
            found += [(int(keys[first]), int(keys[i])) for i in near]
    return found


_LINK = "a long, b long"


def _link_batch(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate("ab")})


def copy_links(docs: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between the keys of near copies in the same group of ``candidates`` (least, key, root).

    The text of each candidate is fetched once and cut into shingles.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t.as_py(), words) for t in batch["text"]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["root"], found], ["key", "root", "shingles"])

    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    wanted = candidates.select(F.col("least").alias("id"), F.col("key").alias("k"), "root")
    texts = texts.join(wanted, (texts["key"] == wanted["k"]) & texts["doc_id"].eqNullSafe(wanted["id"]))
    sets = texts.select("key", "root", "text").mapInArrow(cut, "key long, root long, shingles array<long>")
    # A repeated row is fetched as often as it occurs.
    sets = staged(sets.groupBy("key").agg(F.first("root").alias("root"), F.first("shingles").alias("shingles")), "simhash-shingles")
    return _group_links(sets, similarity)


def short_links(short: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the keys of near copies among ``short`` (key, shingles), all of them.

    Shingles are ordered from the rarest: two sets of the ``similarity`` share one of their first, as many as may differ and one more. Texts that share such a
    shingle are compared; a shingle that no other text has makes no group.
    """
    each = short.select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = each.groupBy("s").agg(F.count("*").alias("texts"))
    ranked = each.join(held, "s").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "s"))).alias("all"))  # under SHORT_WORDS
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    roots = ranked.select("key", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("f")).where("f.texts > 1").select("key", F.col("f.s").alias("root"))
    return _group_links(staged(roots.join(short, "key"), "simhash-short"), similarity)


def _group_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the near copies in each group (root) of ``sets`` (root, key, shingles).

    Groups are compared as a whole if they are small;
    of a large one every pair of blocks is compared, so no task holds more than two blocks and no pair is missed.
    """
    sizes = staged(sets.groupBy("root").agg(F.sum(F.size("shingles")).alias("size"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-sizes")
    sized = sets.join(sizes, "root")
    small = sized.where(F.col("size") <= GROUP_SHINGLES).groupBy("root").agg(F.collect_list(F.struct("key", "shingles")).alias("texts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for group in batch["texts"]:
                keys = group.values.field("key").to_numpy()
                sets = [x.values.to_numpy() for x in group.values.field("shingles")]
                found += _copies(keys, sets, similarity)
            yield from _link_batch(found).to_batches()

    def compare_blocks(group: pa.Table) -> pa.Table:
        return _link_batch(_copies(group["key"].to_numpy(), [x.values.to_numpy() for x in group["shingles"]], similarity))

    blocks = F.ceil(F.col("size") / BLOCK_SHINGLES)
    large = sized.where(F.col("size") > GROUP_SHINGLES).withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), blocks))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    large = large.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "shingles")
    return _fewest(small.select("texts").mapInArrow(compare, _LINK).union(large.groupBy("root", "i", "j").applyInArrow(compare_blocks, _LINK)))


def near_copies(prints: DataFrame, docs: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """key (of each different text), least (its least doc_id) and class (a key) for ``prints`` (doc_id, key, fp, second, shingles) of ``docs``.

    Texts are candidates if their first or second fingerprints are joined by links of at most ``radius`` bits, or, short ones, if they share a rare shingle, and
    near copies if their sets of shingles then have the ``similarity``. Classes are what such pairs join.
    """
    distinct = staged(prints.groupBy("key", "fp").agg(F.min("doc_id").alias("least")), "simhash-texts")
    seconds = prints.where("second is not null")
    near = staged(links(distinct.select("fp").union(seconds.select("second")).distinct(), radius), "simhash-links")
    # A text's two fingerprints belong together; that matters if the second has a link.
    linked = near.select(F.explode(F.array("a", "b")).alias("second")).distinct()
    ties = seconds.select(F.col("fp").alias("a"), F.col("second").alias("b")).distinct().join(linked, F.col("b") == F.col("second"), "left_semi")
    roots = components(near.unionByName(ties))
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("key", "least", F.coalesce("root", "fp").alias("root"))
    # Written, like the sizes of groups, so that joins with them are of plain shuffles, of which Spark splits a large group's.
    several = staged(tied.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "simhash-groups")
    candidates = staged(tied.where("key <> 0").join(several, "root", "left_semi"), "simhash-candidates")
    short = staged(prints.where("shingles is not null and key <> 0").select("key", "shingles").dropDuplicates(["key"]), "simhash-short-texts")
    found = copy_links(docs, candidates, words, similarity).unionByName(short_links(short, similarity))
    joined = components(found).select(F.col("node").alias("key"), F.col("root").alias("class"))
    return distinct.join(joined, "key", "left").select("key", "least", F.coalesce("class", "key").alias("class"))


def one_of_each(
    docs: DataFrame, words: int = COPY_WORDS, similarity: float = COPY_SIMILARITY, radius: int = COPY_RADIUS, short: int = SHORT_WORDS, middle: int = MIDDLE_WORDS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less near copies: one row of each class stays; see ``near_copies``.

    It is the one with the least id (null last), of several texts under that id the one of the least hash; of its repeated rows
    one. Null texts and those without a word are one class. Texts that differ in case and white space only are copies.
    """
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = staged(keyed.mapInArrow(_word_fingerprints(words, short, middle), f"doc_id {kind}, key long, fp long, second long, shingles array<long>"), "simhash-words")
    found = near_copies(prints, docs, words, similarity, radius)
    order = F.struct(F.col("least").isNull().alias("unnamed"), "least", "key")
    stay = staged(found.groupBy("class").agg(F.min(order).alias("one")).select("one.least", "one.key"), "simhash-one-of-each")
    key, id_ = "__text_key", "__least_id"
    stay = stay.select(F.col("least").alias(id_), F.col("key").alias(key + "_"))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    named = keyed.where("doc_id is not null")
    named = named.join(stay, (named["doc_id"] == stay[id_]) & (named[key] == stay[key + "_"]), "left_semi")
    nameless = keyed.where("doc_id is null").join(stay.where(f"{id_} is null"), F.col(key) == F.col(key + "_"), "left_semi")
    return _first(named, ["doc_id", key]).unionByName(_first(nameless, [key])).select(docs.columns)


def _first(rows: DataFrame, by: list) -> DataFrame:
    n = "__first_of_copies"
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))).where(F.col(n) == 1).drop(n)
