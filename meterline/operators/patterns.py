"""Many patterns in one pass over a text: an automaton finds the literals that they require, and a pattern is tried only where one stands."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

DIGITS = ("0-9",)  # in place of literals: every run of digits


def here(text: str, at: int) -> Iterable[int]:
    """A match begins where its literal does."""
    return (at,)


def back(*steps: int) -> Callable[[str, int], Iterable[int]]:
    """A match begins so many characters before its literal or run of digits."""
    return lambda text, at: (at - n for n in steps)


def run_of(allowed: str) -> Callable[[str, int], Iterable[int]]:
    """A match begins where the run of characters that are word characters or ``allowed`` begins, which ends before its literal."""

    def starts(text: str, at: int) -> Iterable[int]:
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_" or text[at - 1] in allowed):
            at -= 1
        return (at,)

    return starts


def words_before(most: int, words: tuple[str, ...]) -> Callable[[str, int], Iterable[int]]:
    """A match begins in one of the ``most`` words before the blank and whole word that are its literal; blanks part words."""

    def starts(text: str, at: int) -> Iterable[int]:
        if not any(text.startswith(w, at + 1) and not (text[at + 1 + len(w) : at + 2 + len(w)].isalnum()) for w in words):
            return
        end = at
        for _ in range(most):
            first = text.rfind(" ", 0, at) + 1
            yield from range(first, end)
            at = end = first - 1
            if at < 0:
                return

    return starts


class Shape(NamedTuple):
    """What to find: an entity's pattern, its checksum, and the literals (lower case) of which every match holds one, with where it may begin.

    Without literals the pattern searches the whole text.
    """

    entity: str
    pattern: str
    check: Callable[[str], bool] | None = None
    literals: tuple[str, ...] | None = None
    starts: Callable[[str, int], Iterable[int]] = here


def folded(text: str) -> str:
    """Lower case, character by character, with the letters that a pattern without case takes for s, i and k."""
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")


class Scanner:
    """Finds the matches of all shapes, each shape's apart from one another as ``re.finditer`` does."""

    def __init__(self, shapes: Iterable[Shape]):
        self.shapes = [Shape(*s) for s in shapes]
        self.patterns = [re.compile(s.pattern) for s in self.shapes]
        self.groups = [1 if p.groups else 0 for p in self.patterns]  # what is reported, if a pattern has a group
        self.free = [i for i, s in enumerate(self.shapes) if s.literals is None]
        self.digits = [i for i, s in enumerate(self.shapes) if s.literals == DIGITS]
        self.run = re.compile(r"\d+")
        wanted: dict[str, list[int]] = {}
        for i, s in enumerate(self.shapes):
            if s.literals is not None and i not in self.digits:
                for literal in s.literals:
                    wanted.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, found in wanted.items():
            self.automaton.add_word(literal, (len(literal), tuple(found)))
        if wanted:
            self.automaton.make_automaton()

    def _places(self, text: str) -> dict[int, set[int]]:
        """Where each shape's matches may begin."""
        places: dict[int, set[int]] = {}
        if len(self.automaton):
            for end, (length, found) in self.automaton.iter(folded(text)):
                for i in found:
                    places.setdefault(i, set()).update(self.shapes[i].starts(text, end - length + 1))
        if self.digits:
            for run in self.run.finditer(text):
                for i in self.digits:
                    places.setdefault(i, set()).update(self.shapes[i].starts(text, run.start()))
        return places

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """Entity, start and end of each match that passes its check, in text order."""
        found = []
        for i in self.free:
            found += [(i, m) for m in self.patterns[i].finditer(text)]
        for i, starts in self._places(text).items():
            match, last = self.patterns[i].match, 0
            for at in sorted(starts):
                if at >= last and (m := match(text, at)):
                    found.append((i, m))
                    last = m.end()
        spans = []
        for i, m in found:
            check, group = self.shapes[i].check, self.groups[i]
            if check is None or check(m[group]):
                spans.append((m.start(group), m.end(group), self.shapes[i].entity))
        return [(e, a, b) for a, b, e in sorted(spans)]


# Plain words, in any number

MOST_WORDS = 200_000  # in one automaton; more are sought block by block


def word_blocks(words: DataFrame, column: str, most: int = MOST_WORDS) -> Iterator[list[str]]:
    """The different words of a table, non-empty, in blocks that the driver holds one at a time."""
    block: list[str] = []
    for r in words.select(column).where(F.length(column) > 0).distinct().toLocalIterator():
        block.append(r[0])
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def with_hits(df: DataFrame, text: str, lists: dict[str, DataFrame], column: str = "word", most: int = MOST_WORDS) -> DataFrame:
    """Adds, for each name in ``lists``, an array of those of the list's words that the text holds as a part, in order; none for null.

    All of a block's words are found in one pass over the texts, however many they are. Words beyond a block cost another pass
    each block, so no number is refused; what the driver holds and sends is a block.
    """
    for name in lists:
        df = df.withColumn(name, F.array().cast("array<string>"))
    for name, words in lists.items():
        for block in word_blocks(words, column, most):
            df = _add_hits(df, text, name, block)
    return df


def _add_hits(df: DataFrame, text: str, name: str, block: list[str]) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in sent.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at = batch.schema.get_field_index(name)
            hits = [sorted({*had, *(w for _, w in automaton.iter(t or ""))}) for t, had in zip(batch[text].to_pylist(), batch[name].to_pylist())]
            columns = [batch[i] for i in range(batch.num_columns)]
            columns[at] = pa.array(hits, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    kind = StructType([f if f.name != name else f.__class__(name, ArrayType(StringType())) for f in df.schema.fields])
    return df.mapInArrow(run, kind)


# Names


def name_blocks(names: DataFrame, most: int = MOST_WORDS) -> Iterator[list[tuple[str, str]]]:
    """Names (name, entity_type), of equal ones the least entity, in blocks."""
    block: list[tuple[str, str]] = []
    for r in names.where("length(name) > 0").groupBy("name").agg(F.min("entity_type").alias("entity_type")).toLocalIterator():
        block.append((r.name, r.entity_type))
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


class WholeWords:
    """Finds names that no word character touches; of overlapping ones the leftmost, then the longest."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton()
        for name, entity in names:
            self.automaton.add_word(name, (len(name), entity))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        found = [(end - n + 1, -(end + 1), entity) for end, (n, entity) in self.automaton.iter(text) if not inside(end + 1) and not inside(end - n)]
        out, last = [], 0
        for start, end, entity in sorted(found):
            if start >= last:
                out.append((entity, start, -end))
                last = -end
        return out
