"""Quality rules, line first: lines that break a rule go, then documents that lose too much of their text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", "…", "。", "！", "？")  # of sentences
CLOSING = (".", "!", "?", ":", ";", "…", "\"", "'", ")", "]", "”", "’", "»", "。", "！", "？")  # what a line of prose may end with
DOUBLED = ("!!", "??", "##", "$$", "%%", "&&", "**", "||")  # marks at a word's end that prose doesn't double
SEPARATORS = ("|", ">", "»", "•", "·", "/", "-", "*")  # between the entries of a menu, as words of their own
#: What entries of a menu begin with, and what a page's notices hold, in lower case. English; other phrases are a parameter.
MENU = ("home", "menu", "log in", "login", "sign in", "sign up", "register", "next page", "previous page", "back to top", "read more", "click here", "share this", "skip to", "contact us", "about us")
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "enable javascript",
    "javascript is", "lorem ipsum", "licensed under", "license, version", "copyright (c)", "subscribe to", "newsletter",
)
MENU_WORDS = 8  # the longest line that is taken for an entry by its beginning
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated windows
MOST_LOST = 30  # per cent of words in lines that break a rule

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "lost_lines", "lost_words"]


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # numbered anew, so that the next product fits
    _, window, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : len(words) - 2 + i] |= twice
    return int(inside.sum())


class Rules:
    """The three rules for a line, which is given as UTF-8 with at least one word."""

    def __init__(self, menu: tuple[str, ...] = MENU, notices: tuple[str, ...] = NOTICES):
        self.ends, self.closing, self.doubled, self.separators = (tuple(x.encode() for x in xs) for xs in (ENDS, CLOSING, DOUBLED, SEPARATORS))
        self.menu = tuple(x.encode() for x in menu)
        self.notice = re.compile(b"|".join(re.escape(x.encode()) for x in notices)) if notices else None

    def unpunctuated(self, words: list[bytes]) -> bool:
        """Neither it nor a sentence in it ends (a cut paragraph passes), or over a tenth of its words end in doubled marks."""
        return not words[-1].endswith(self.closing) and not any(w.endswith(self.ends) for w in words) or 10 * sum(w.endswith(self.doubled) for w in words) > len(words)

    def navigation(self, words: list[bytes], low: bytes) -> bool:
        """At least two separators that are a fifth of its words, or a short line that begins like an entry of a menu."""
        between = sum(w in self.separators for w in words)
        return between > 1 and 5 * between >= len(words) or len(words) <= MENU_WORDS and low.startswith(self.menu)

    def boilerplate(self, low: bytes) -> bool:
        return self.notice is not None and self.notice.search(low) is not None

    def fails(self, words: list[bytes], line: bytes) -> bool:
        low = line.lower().lstrip()  # of bytes: A-Z only
        return self.unpunctuated(words) or self.boilerplate(low) or self.navigation(words, low)


def _measure(text: str, rules: Rules) -> tuple[list[int], str]:
    """The measures of a text and what is left of it."""
    raw = text.encode("utf-8", "surrogatepass")
    words: list[bytes] = []
    kept: list[bytes] = []
    seen: set[bytes] = set()
    n_lines = dup = lost_lines = lost_words = 0
    for line in raw.split(b"\n"):
        own = line.split()  # bytes split at \x20 and \x09-\x0D only
        if own:
            words += own
            n_lines += 1
            dup += line in seen
            seen.add(line)
            if rules.fails(own, line):
                lost_lines += 1
                lost_words += len(own)
                continue
        kept.append(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\f")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    measures = [len(words), chars, symbols, dup, repeated_words(words), n_lines, lost_lines, lost_words]
    return measures, b"\n".join(kept).decode("utf-8", "surrogatepass")


def clean_lines(
    docs: DataFrame,
    menu: tuple[str, ...] = MENU,
    notices: tuple[str, ...] = NOTICES,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
    most_lost: int = MOST_LOST,
) -> DataFrame:
    """A row for each document: its measures, its text without the lines that break a rule, and whether it is kept.

    Line first: every line with a word is judged by punctuation, navigation and boilerplate; a failing one goes. Then a document
    goes (``kept`` is false) if it has too few or too repetitive words (``base_failed``), or if its failing lines hold over
    ``most_lost`` per cent of its words. One pass without a shuffle; a task holds one text at a time.

    A null or empty text has no words: all measures are 0 and it fails; its text stays null or empty. Repeated rows are judged
    each. Only doc_id and text are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(menu, notices)
        for batch in batches:
            texts = [t.as_py() for t in batch["text"]]
            found = [_measure(t or "", rules) for t in texts]
            columns = [pa.array([m[i] for m, _ in found], pa.int64()) for i in range(len(_MEASURES))]
            left = pa.array([None if t is None else x for t, (_, x) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, left], ["doc_id", *_MEASURES, "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{m} long' for m in _MEASURES)}, text string")
    judged = measured.selectExpr("*", f"n_words < {int(least_words)} OR 100 * n_repeat_words > {int(most_repeated)} * n_words AS base_failed")
    return judged.selectExpr("*", f"NOT base_failed AND 100 * lost_words <= {int(most_lost)} * n_words AS kept")


def oracle_sql() -> str:
    """The same rows, without the texts, in DuckDB's SQL."""
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    ends = lambda xs, c: " OR ".join(f"ends_with({c}, '{x.replace(chr(39), chr(39) * 2)}')" for x in xs)
    starts = " OR ".join(f"starts_with(low, '{x}')" for x in MENU)
    holds = " OR ".join(f"contains(low, '{x}')" for x in NOTICES)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {word}) AS w FROM d),
l AS (SELECT r, line, regexp_extract_all(line, {word}) AS lw,
    ltrim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS low
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT r, line, len(lw) AS n, NOT ({ends(CLOSING, 'lw[-1]')}) AND len(list_filter(lw, lambda x: {ends(ENDS, 'x')})) = 0 OR 10 * len(list_filter(lw, lambda x: {ends(DOUBLED, 'x')})) > len(lw)
    OR {holds}
    OR len(list_filter(lw, lambda x: x IN ({quoted(SEPARATORS)}))) > 1 AND 5 * len(list_filter(lw, lambda x: x IN ({quoted(SEPARATORS)}))) >= len(lw)
    OR len(lw) <= {MENU_WORDS} AND ({starts}) AS bad
  FROM l WHERE len(lw) > 0),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS lost_lines, coalesce(sum(n) FILTER (bad), 0) AS lost_words FROM f GROUP BY r),
win AS (SELECT r, o, w[o] || ' ' || w[o + 1] || ' ' || w[o + 2] AS win FROM w, unnest(range(1, len(w) - 1)) AS t(o)),
rep AS (SELECT r, o FROM (SELECT r, o, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rw AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM rep, unnest(range(o, o + 3)) AS t(p) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(lost_lines, 0) AS lost_lines, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
  FROM w LEFT JOIN ls USING (r) LEFT JOIN rw USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept
FROM m
"""
