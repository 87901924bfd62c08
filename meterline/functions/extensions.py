"""Where users plug in their own detectors, guardrails and splitters, as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..operators import pii
from ..operators.patterns import Scanner, Shape
from ..operators.text import split_recursively


def register_detector(spark: SparkSession, name: str, rules: Sequence[Shape | tuple], detector: str = "user") -> None:
    """A SQL function from a text to its spans, for rules of (entity, pattern, check or None) or shapes with literals."""
    rules = [Shape(*r) for r in rules]
    made: list[Scanner] = []  # by each worker for itself

    def spans(text: str | None) -> list[dict]:
        if not made:
            made.append(Scanner(rules))
        return [{"entity_type": e, "start": a, "end": b, "score": 1.0, "detector": detector} for e, a, b in made[0].scan(text or "")]

    spark.udf.register(name, F.udf(spans, f"array<{pii.SPAN}>", useArrow=True))


def register_guardrail(spark: SparkSession, name: str, passes: Callable[[str], bool]) -> None:
    """A SQL predicate on a text; null passes. It is given whole Arrow batches."""

    @F.pandas_udf(BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: True if t is None else bool(passes(t))).astype(bool)

    spark.udf.register(name, run)


def register_splitters(spark: SparkSession) -> None:
    """Table functions ``split_text(text, size, overlap)`` and ``text_windows(text, size, overlap)``, for lateral joins."""

    @F.udtf(returnType="chunk int, text string")
    class SplitText:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(split_recursively(text or "", size, overlap))

    @F.udtf(returnType="n int, start int, end int")
    class TextWindows:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
            if text:
                yield from ((i, a, b) for i, (a, b) in enumerate(pii.window_bounds(text, size, overlap)))

    spark.udtf.register("split_text", SplitText)
    spark.udtf.register("text_windows", TextWindows)
