"""Screening rules as a table: read from category files, or small sets of our own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "category string, default_action string, kind string, value string, severity string"
#: The lists that a category file may hold, and the kind of rule that each makes.
LISTS = {
    "identifier_words": "identifier",
    "additional_block_words": "block",
    "always_block_keywords": "always",
    "exceptions": "exception",
    "phrase_patterns": "phrase",
}

#: A line up to a comment: quoted parts may hold the mark.
_COMMENT = re.compile(r"""^((?:"(?:[^"\\]|\\.)*"|'[^']*'|(?!\s\#).)*?)\s\#.*$""")

#: Our own rules over the invented words of the given tables.
SAMPLE = [
    ("insults", "BLOCK", "always", "idiot", "high"),
    ("insults", "BLOCK", "always", "scum", "medium"),
    ("insults", "BLOCK", "always", "pathetic", "low"),
    ("insults", "BLOCK", "identifier", "the", None),
    ("insults", "BLOCK", "identifier", "this", None),
    ("insults", "BLOCK", "block", "worthless", None),
    ("insults", "BLOCK", "block", "stupid", None),
    ("insults", "BLOCK", "exception", "not", None),
    ("insults", "BLOCK", "phrase", "(the|and) [a-z]+ing", None),
]


def parse_category(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """The rules of one category file: plain ``key: value`` lines and lists of texts, or of ``keyword``/``severity`` pairs."""
    name, action, kind, rows = "", "BLOCK", None, []
    for line in text.splitlines():
        body = _COMMENT.sub(r"\1", line).rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        item = body.strip()
        if not body.startswith((" ", "-")):
            key, _, value = body.partition(":")
            value = value.strip().strip("\"'")
            kind = LISTS.get(key.strip())
            if key.strip() in ("category_name", "name"):
                name = value
            elif key.strip() == "default_action":
                action = value
        elif kind and item.startswith("- "):
            value = item[2:].strip()
            if value.startswith("keyword:"):
                value = value[8:].strip()
            rows.append([kind, value.strip("\"'"), None])
        elif kind and rows and item.startswith("severity:"):
            rows[-1][2] = item[9:].strip().strip("\"'")
    return [(name, action, k, v.replace("\\\\", "\\"), s) for k, v, s in rows]


def load_policy_table(spark: SparkSession, folder: str, names: str = "*.yaml") -> DataFrame:
    """All category files under a folder, those whose names fit, as one table of rules; each file is one task's text."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True).select("value")

    def run(batches):
        import pandas as pd

        names = ["category", "default_action", "kind", "value", "severity"]
        for batch in batches:
            yield pd.DataFrame([r for text in batch["value"] for r in parse_category(text)], columns=names)

    return files.mapInPandas(run, RULES)


def sample_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, RULES).where(F.col("value") != "")
