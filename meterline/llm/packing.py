"""Packing documents into training sequences of several permitted lengths by best fit."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

LENGTHS = (2_048, 4_096, 8_192, 16_384)  # permitted sequence lengths, in code points
SEPARATOR = 1  # every piece is followed by one separator
GROUP_PIECES = 20_000  # pieces that are packed together


def sequence_cost(length: int) -> float:
    """What training on a sequence costs, in code points: a fixed part, a linear one and attention's square.

    Short sequences suffer from the first, long ones from the last; 8,192 of the permitted lengths costs least for each code point.
    """
    return 1_024 + length + length * length / 65_536


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start and n (code points, separator left out) of each row of ``docs``: texts too long for any sequence are cut."""
    most = longest - SEPARATOR
    n = F.length("text")
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / most).cast("int") - 1))
    split = docs.where(n > 0).select("doc_id", n.alias("n_chars"), F.explode(cuts).alias("piece"))
    start = F.col("piece").cast("long") * most
    return split.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most), F.col("n_chars") - start).cast("int").alias("n"))


class Unpacked:
    """The sizes that are still to be packed: different ones in ascending order, and how many there are of each."""

    def __init__(self, sizes: Sequence[int]) -> None:
        found = sorted(Counter(sizes).items())
        self.sizes, self.left = [s for s, _ in found], [n for _, n in found]
        self.below = list(range(len(found)))  # itself, or a smaller size to go to once there are none left

    def at_most(self, size: int, before: int) -> int:
        """The place, under ``before``, of the greatest size left that is at most ``size``; -1 if there is none."""
        i = min(bisect_right(self.sizes, size), before) - 1
        path = []
        while i >= 0 and self.below[i] != i:
            path.append(i)
            i = self.below[i]
        for j in path:
            self.below[j] = i
        return i

    def take(self, i: int, n: int) -> None:
        self.left[i] -= n
        if not self.left[i]:
            self.below[i] = i - 1

    def filled(self, length: int) -> tuple[list[tuple[int, int]], int]:
        """A sequence of ``length`` filled by best fit, the greatest size that fits the room first: places with numbers of pieces, and what they use."""
        room, found, i = length, [], len(self.sizes)
        while room and (i := self.at_most(room, i)) >= 0:
            n = min(self.left[i], room // self.sizes[i])
            found.append((i, n))
            room -= n * self.sizes[i]
        return found, length - room


def sequences(sizes: Sequence[int], lengths: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Pack all ``sizes``, none over the greatest of ``lengths``: each sequence's length and the sizes in it.

    Every sequence takes the greatest size left. All lengths that hold it are filled on trial with what else is left and shrunk
    to the least length that holds their contents; the one that costs least for each code point of its contents is opened.
    """
    rest, out, lengths = Unpacked(sizes), [], sorted(lengths)
    while (largest := rest.at_most(lengths[-1], len(rest.sizes))) >= 0:
        best = None
        for length in lengths[bisect_left(lengths, rest.sizes[largest]) :]:
            found, used = rest.filled(length)
            final = lengths[bisect_left(lengths, used)]
            cost = sequence_cost(final) / used
            if best is None or cost < best[0] - 1e-12:
                best = cost, final, found
        _, final, found = best
        for i, n in found:
            rest.take(i, n)
        out.append((final, [rest.sizes[i] for i, n in found for _ in range(n)]))
    return out


def _packed(lengths: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # by size, the largest first
        if not held:
            return
        sizes = np.concatenate([b["n"].to_numpy() for b in held]).astype(np.int64) + SEPARATOR
        values, first = np.unique(-sizes, return_index=True)  # pieces of one size follow each other
        next_ = dict(zip((-values).tolist(), first.tolist(), strict=True))
        bins = np.zeros((4, len(sizes)), np.int64)  # number, length, used, offset
        for number, (length, own) in enumerate(sequences(sizes.tolist(), lengths)):
            offset, used = 0, sum(own)
            for size in own:
                bins[:, next_[size]] = number, length, used, offset
                next_[size] += 1
                offset += size
        bins[0] += TaskContext.get().partitionId() << 32
        at = 0
        for batch in held:
            places, at = bins[:, at : at + batch.num_rows], at + batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, places), *(batch[c] for c in ("doc_id", "piece", "start", "n"))],
                ["bin_id", "capacity", "used", "offset", "doc_id", "piece", "start", "n"],
            )

    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Assign every code point of ``docs`` (doc_id, text) to a place in a sequence of one of the permitted ``lengths``.

    Texts are cut where they exceed the greatest length; pieces are written with a row number of their own and dealt by its hash into groups of
    about ``group_pieces``, so rows without an id or with many copies are spread as well. Each group is packed from its largest piece down; see ``sequences``. A task holds some
    numbers for each of its pieces, never their texts.

    Returns bin_id, capacity, used (with separators), offset, doc_id, piece, start, n. Null and empty texts have nothing to
    pack and give no row. Null and repeated ids are packed as any others; a repeated row is packed as often as it occurs.
    """
    cut = staged(pieces(docs, max(lengths)).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, math.ceil(cut.count() / group_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = cut.repartition(groups, F.xxhash64("row")).drop("row").sortWithinPartitions(F.desc("n"), "doc_id", "piece")
    columns = f"bin_id long, capacity long, used long, offset long, doc_id {kind}, piece int, start long, n int"
    return dealt.mapInArrow(_packed(lengths), columns)
