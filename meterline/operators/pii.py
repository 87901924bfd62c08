"""Personal data and secrets: find spans, merge them, replace them by tokens, restore, search, erase, score.

Offsets count code points of the original text; a span's end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..shared import new_path, staged
from . import shapes
from .aggregates import count_if
from .patterns import MOST_WORDS, Scanner, Shape, WholeWords, name_blocks

SPAN = "struct<entity_type:string,start:int,end:int,score:double,detector:string>"
_ARROW_SPAN = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("detector", pa.string())])


def detect(docs: DataFrame, rules: Iterable[Shape | tuple], detector: str, score: float = 1.0) -> DataFrame:
    """doc_id, text and the spans that ``rules`` find in each whole text, in text order. A null text has none.

    A rule is a ``Shape``, or its first fields: entity, pattern and checksum. All rules' literals are found in one pass over a text.
    """
    rules = [Shape(*r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [[_one(e, a, b, score, detector) for e, a, b in scanner.scan(t.as_py() or "")] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(found, pa.list_(_ARROW_SPAN))], ["doc_id", "text", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans array<{SPAN}>")


def _one(entity: str, start: int, end: int, score: float, detector: str) -> dict:
    return {"entity_type": entity, "start": start, "end": end, "score": score, "detector": detector}


def detect_rules(docs: DataFrame) -> DataFrame:
    return detect(docs, shapes.RULES, "rules")


def detect_secrets(docs: DataFrame) -> DataFrame:
    return detect(docs, shapes.SECRETS, "secrets")


def detect_regional(docs: DataFrame) -> DataFrame:
    return detect(docs, shapes.REGIONAL, "rules", 0.8)


def detect_gazetteer(docs: DataFrame, names: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, text and spans of the names (name, entity_type) that stand in a text as whole words, and of organizations by their legal form.

    Case counts. Where names overlap the leftmost and then the longest stays. Any number of names may be given: beyond ``most`` the texts are
    read once for each block of names.
    """
    found = detect(docs, [shapes.ORGANIZATION], "model", 0.6)
    for block in name_blocks(names, most):
        found = _add_names(found, block)
    return found


def _add_names(rows: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WholeWords(sent.value)
        for batch in batches:
            out = []
            for text, had in zip(batch["text"], batch["spans"].to_pylist()):
                spans = had + [_one(e, a, b, 0.6, "model") for e, a, b in names.scan(text.as_py() or "")]
                out.append(sorted(spans, key=lambda s: (s["start"], s["end"], s["entity_type"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(out, pa.list_(_ARROW_SPAN))], ["doc_id", "text", "spans"])

    return rows.mapInArrow(run, rows.schema)


def detect_each(docs: DataFrame, find: Callable[[str], list[tuple[str, int, int, float]]], detector: str) -> DataFrame:
    """doc_id, text, spans and error: a model applied to each text (entity, start, end, score), whose failure on a text is kept as that row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, errors = [], []
            for text in batch["text"]:
                try:
                    spans.append([_one(e, a, b, score, detector) for e, a, b, score in find(text.as_py() or "")])
                    errors.append(None)
                except Exception as e:  # whatever a user's model raises
                    spans.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(spans, pa.list_(_ARROW_SPAN)), pa.array(errors, pa.string())], ["doc_id", "text", "spans", "error"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans array<{SPAN}>, error string")


_KEPT = ("version", "policy", "locale")


def detect_once(docs: DataFrame, detector: Callable[[DataFrame], DataFrame], version: str, policy: str = "", locale: str = "", kept: str | None = None) -> DataFrame:
    """Spans of every row, each different text looked at once for a detector's version, policy and locale.

    ``kept`` is the path of a table of results by (text hash, version, policy, locale), in partitions of the last three. Only texts
    whose hash isn't there for these go to the detector; what it finds is added before it is used, so a run that is broken off or repeated
    redoes only what is missing. Without a path a table of this run's own is used. Null texts have no spans (null).
    """
    spark = docs.sparkSession
    kept = kept or new_path(spark, "detected")
    fields = f"text_hash string, spans array<{SPAN}>, version string, policy string, locale string"
    key = dict(zip(_KEPT, (version, policy, locale)))

    def known() -> DataFrame:
        try:
            table = spark.read.option("basePath", kept).schema(fields).parquet(kept)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], fields)
        # An empty key is a partition without a name.
        return table.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) == v for c, v in key.items()]))

    keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    once = keyed.where("text is not null").groupBy("text_hash").agg(F.any_value("text").alias("text"))
    new = once.join(known().select("text_hash"), "text_hash", "left_anti")
    found = detector(new.withColumnRenamed("text_hash", "doc_id")).select(F.col("doc_id").alias("text_hash"), "spans")
    found.withColumns({c: F.lit(v) for c, v in key.items()}).write.mode("append").partitionBy(*_KEPT).parquet(kept)
    spans = known().select("text_hash", "spans").dropDuplicates(["text_hash"])  # two runs at once may both have added one
    return keyed.join(spans, "text_hash", "left").select("doc_id", "text", "spans", *[F.lit(v).alias(c) for c, v in key.items()])


VOCABULARY = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "ORG": "ORGANIZATION", "MAIL": "EMAIL"}


def map_labels(spans: DataFrame, vocabulary: dict[str, str] | None = None) -> DataFrame:
    """Model labels (label) without B-, I-, E- or S- as entity types; unknown ones are dropped."""
    known = F.create_map(*[F.lit(x) for pair in (vocabulary or VOCABULARY).items() for x in pair])
    plain = F.regexp_replace(F.upper("label"), "^[BIES][-_]", "")
    return spans.withColumn("entity_type", F.try_element_at(known, plain)).where("entity_type is not null")


def needs_model(rows: DataFrame, policy: str, threshold: float = 0.5) -> Column:
    """Whether a row (spans) goes to the model stage: never, on_miss, low_confidence (its surest span is below ``threshold``) or always."""
    none = F.size("spans") == 0
    low = F.array_max(F.transform("spans", lambda s: s["score"])) < threshold
    return {"never": F.lit(False), "on_miss": none, "low_confidence": none | low, "always": F.lit(True)}[policy]


def cascade(rows: DataFrame, policy: str, model: Callable[[DataFrame], DataFrame], threshold: float = 0.5, fail_closed: bool = True) -> DataFrame:
    """doc_id, text, merged spans, model_ran and error: rule spans, and for the rows that the policy names also the model's, found on those rows only.

    ``rows`` and the model's result may have an ``error``, not null where the stage failed on a row (``detect_each`` makes one). Closed, such
    a row has that error and null spans, so it can't pass for clean. Open, it goes on without the stage: failed rules leave no
    spans, a failed model leaves the rules'.
    """
    none = F.array().cast(f"array<{SPAN}>")
    with_error = lambda df: df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))
    rows = with_error(rows).select("doc_id", "text", F.when(F.col("error").isNull(), F.coalesce("spans", none)).otherwise(none).alias("spans"), "error")
    need = F.coalesce(needs_model(rows, policy, threshold), F.lit(False)) & F.col("error").isNull()
    second = rows.where(need)
    found = with_error(model(second.select(F.struct("doc_id", "spans").alias("doc_id"), "text")))
    own, ran = F.col("doc_id.spans"), F.col("error").isNull()
    both = found.select("doc_id.doc_id", "text", F.when(ran, F.concat(own, F.coalesce("spans", none))).otherwise(own).alias("spans"), ran.alias("model_ran"), "error")
    merged = merge_spans(rows.where(~need).select("doc_id", "text", "spans", F.lit(False).alias("model_ran"), "error").unionByName(both))
    if not fail_closed:
        return merged.withColumn("error", F.lit(None).cast("string"))
    return merged.withColumn("spans", F.when(F.col("error").isNull(), F.col("spans")))


#: Where a window may end, the most structural first.
BOUNDARIES = ("\n\n", "\n", ". ", ", ", " ")


def window_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of at most ``size`` that overlap and end at the last natural boundary in their latter part, if there is one.

    An overlap of ``size`` or more still moves on, by a character at least.
    """
    out, start = [], 0
    least = max(size - overlap, size // 2, 1) // 2
    while True:
        end = min(len(text), start + size)
        if end < len(text):
            found = ((text.rfind(b, start + least, end), len(b)) for b in BOUNDARIES)
            end = next((at + n for at, n in found if at > start + least), end)
        out.append((start, end))
        if end >= len(text):
            return out
        start = max(start + 1, end - overlap)


def windows(docs: DataFrame, size: int = 2_000, overlap: int = 200) -> DataFrame:
    """doc_id, window number, start, end and text of each window of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, b, t[a:b]) for i, t in enumerate(batch["text"].to_pylist()) if t for n, (a, b) in enumerate(window_bounds(t, size, overlap))]
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.string()
            columns = [pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64())), *columns], ["doc_id", "window", "start", "end", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, window int, start int, end int, text string")


def shift_spans(spans: DataFrame) -> DataFrame:
    """Window spans (doc_id, w_start, w_end, text_length, start, end) in the text's offsets, less those that touch an interior cut."""
    touches = ((F.col("start") == 0) & (F.col("w_start") > 0)) | ((F.col("end") == F.col("w_end") - F.col("w_start")) & (F.col("w_end") < F.col("text_length")))
    return spans.where(~touches).withColumns({"start": F.col("start") + F.col("w_start"), "end": F.col("end") + F.col("w_start")})


# Span folds over each row's array


def _span(entity, start, end, score, detector) -> Column:
    return F.struct(entity.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("score"), detector.alias("detector"))


def trim_spans(spans: Column, text: Column) -> Column:
    """Spans without the white space at their edges; blank ones go."""

    def trim(s):
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left = F.length(own) - F.length(F.regexp_replace(own, r"^\s+", ""))
        right = F.length(own) - F.length(F.regexp_replace(own, r"\s+$", ""))
        return _span(s["entity_type"], s["start"] + left, F.greatest(s["start"] + left, s["end"] - right), s["score"], s["detector"])

    return F.filter(F.transform(spans, trim), lambda s: s["end"] > s["start"])


def _typed_empty(spans: Column) -> Column:
    return F.slice(spans, 1, 0)


def _sorted_by(spans: Column, *keys) -> Column:
    """Spans in the order of keys; the entity comes last, so the order is total."""
    keyed = F.transform(spans, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s["entity_type"].alias("k9"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def resolve_overlaps(spans: Column) -> Column:
    """No two spans overlap: the greater score stays, then rules before models, the longer, the leftmost."""
    order = _sorted_by(spans, lambda s: -s["score"], lambda s: F.when(s["detector"] == "rules", 0).otherwise(1), lambda s: s["start"] - s["end"], lambda s: s["start"])
    free = lambda kept, s: ~F.exists(kept, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    kept = F.aggregate(order, _typed_empty(spans), lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a))
    return _sorted_by(kept, lambda s: s["start"], lambda s: s["end"])


def coalesce_adjacent(spans: Column, text: Column) -> Column:
    """Neighbours of one entity with at most one blank between them become one span of the lesser score. Spans must be in order and apart."""

    def step(a, s):
        last = F.try_element_at(a, F.lit(-1))
        gap = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        joins = F.coalesce((last["entity_type"] == s["entity_type"]) & (s["start"] - last["end"] <= 1) & (F.trim(gap) == ""), F.lit(False))
        one = _span(s["entity_type"], last["start"], s["end"], F.least(last["score"], s["score"]), last["detector"])
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(one))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(spans, _typed_empty(spans), step)


def merge_spans(rows: DataFrame) -> DataFrame:
    """Rows (text, spans) with their spans trimmed, apart and joined."""
    trimmed = rows.withColumn("spans", trim_spans(F.coalesce("spans", F.array().cast(f"array<{SPAN}>")), F.col("text")))
    apart = trimmed.withColumn("spans", resolve_overlaps(F.col("spans")))
    return apart.withColumn("spans", coalesce_adjacent(F.col("spans"), F.col("text")))


ORIGIN_RANK = {"annotation": 3, "rule": 2, "rules": 2, "model": 1}


def union_spans(spans: Column) -> Column:
    """Clusters of overlapping spans become their union, of the class with the highest origin, then the longer, then the leftmost."""
    rank = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ORIGIN_RANK.items() for x in p]), s["detector"]), F.lit(0))
    order = _sorted_by(spans, lambda s: s["start"], lambda s: -s["end"])

    def step(a, s):
        last = F.try_element_at(a, F.lit(-1))
        meets = F.coalesce(s["start"] < last["end"], F.lit(False))
        # The score carries the strongest member's length, so a later one can be compared to it.
        better = F.coalesce((rank(s) > rank(last)) | ((rank(s) == rank(last)) & (s["end"] - s["start"] > last["score"])), F.lit(False))
        length = (s["end"] - s["start"]).cast("double")
        both = _span(
            F.when(better, s["entity_type"]).otherwise(last["entity_type"]), last["start"], F.greatest(last["end"], s["end"]),
            F.when(better, length).otherwise(last["score"]), F.when(better, s["detector"]).otherwise(last["detector"]),
        )
        own = _span(s["entity_type"], s["start"], s["end"], length, s["detector"])
        return F.when(meets, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(own)))

    return F.aggregate(order, _typed_empty(spans), step)


def value_registry(values: DataFrame) -> DataFrame:
    """One entry for each normalized value (cls, text, origin), of the class with the highest origin."""
    normal = F.lower(F.trim("text"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ORIGIN_RANK.items() for x in p]), F.col("origin")), F.lit(0))
    keyed = values.select(sc.value_id(normal).alias("value_id"), normal.alias("value"), "cls", rank.alias("rank"))
    return keyed.groupBy("value_id").agg(F.any_value("value").alias("value"), F.max_by("cls", F.struct("rank", "cls")).alias("cls"), F.count("*").alias("mentions"))


# Tokens

TAKEN_LIMIT = 64
TOKEN = r"<([A-Z][A-Z_]*)_([0-9]+)>"


def token_ordinals(values: DataFrame, texts: DataFrame, by: str = "request_id") -> DataFrame:
    """The number of each value (request, entity_type, value, pos) of an entity: by first appearance, passing over numbers that stand in the request's texts.

    An error is raised if TAKEN_LIMIT numbers in a row are taken.
    """
    first = values.groupBy(by, "entity_type", "value").agg(F.min("pos").alias("pos"))
    order = F.row_number().over(Window.partitionBy(by, "entity_type").orderBy("pos", "value"))
    wanted = first.withColumn("k", order)
    taken = texts.select(by, F.explode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), 1)).alias("token"))
    taken = taken.select(by, F.regexp_extract("token", TOKEN, 1).alias("entity_type"), F.regexp_extract("token", TOKEN, 2).cast("decimal(38,0)").alias("n"))
    taken = taken.groupBy(by, "entity_type").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    joined = wanted.join(taken, [by, "entity_type"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<decimal(38,0)>")))
    free = F.aggregate("taken", F.col("k").cast("decimal(38,0)"), lambda n, t: F.when(t <= n, n + 1).otherwise(n).cast("decimal(38,0)"))
    run = F.aggregate(
        "taken", F.struct(F.lit(-1).cast("decimal(38,0)").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, t: F.struct(t.alias("last"), F.when(t == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["most"], F.when(t == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("most")),
        lambda a: a["most"],
    )
    number = F.when(run > TAKEN_LIMIT, F.raise_error(F.lit("too many token numbers in a row are taken"))).otherwise(free.cast("long"))
    return joined.select(by, "entity_type", "value", number.alias("n"))


class Codec(Protocol):
    """How tokens are made: ``mint`` gives a token to each value (request_id, entity_type, value, token); ``pattern`` finds such tokens in loose form, its
    two groups a label and what tells tokens of one label apart; ``plain`` spells a found one as it was made."""

    pattern: str

    def mint(self, values: DataFrame, texts: DataFrame) -> DataFrame: ...

    def plain(self, found: Column) -> Column: ...


class Ordinals:
    """Tokens ``<PERSON_1>``, numbered in each request by first appearance."""

    pattern = r"(?i)<\s*([a-z][a-z_\\]*?)\s*\\?_\s*([0-9]+)\s*\\?>"

    def mint(self, values: DataFrame, texts: DataFrame) -> DataFrame:
        token = F.concat(F.lit("<"), "entity_type", F.lit("_"), F.col("n").cast("string"), F.lit(">"))
        return token_ordinals(values, texts).select("request_id", "entity_type", "value", token.alias("token"))

    def plain(self, found: Column) -> Column:
        return F.upper(F.regexp_replace(F.regexp_replace(found, r"[\s\\]", ""), "_+", "_"))


class Handles:
    """Tokens ``<PERSON:3f9c2e1b8d4a7f60>`` with random handles, which tell nothing of a value's order or number.

    Handles are drawn once and written before they are used. One that is drawn twice, that a vault kept from before has (``kept``, with a column token), or that
    stands in a text is drawn again, until none is. A value keeps its token from ``kept`` (request_id, entity_type, value, token).
    """

    pattern = r"(?i)<\s*([a-z][a-z_]*)\s*:\s*([0-9a-f]+)\s*>"

    def __init__(self, kept: DataFrame | None = None, draw: Callable[[], Column] | None = None, most_rounds: int = 20):
        self.kept, self.most_rounds = kept, most_rounds
        self.draw = draw or (lambda: F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))

    def mint(self, values: DataFrame, texts: DataFrame) -> DataFrame:
        key = ["request_id", "entity_type", "value"]
        wanted = values.select(*key).distinct()
        spelt = F.explode(F.transform(F.regexp_extract_all("text", F.lit(f"({self.pattern})"), 1), self.plain))
        taken = texts.select(spelt.alias("token"))
        done = None
        if self.kept is not None:
            taken = taken.unionByName(self.kept.select("token"))
            done = staged(wanted.join(self.kept.select(*key, "token").dropDuplicates(key), key), "tokens")
            wanted = wanted.join(done, key, "left_anti")
        taken = taken.where("token is not null").distinct()
        for _ in range(self.most_rounds):
            token = F.concat(F.lit("<"), "entity_type", F.lit(":"), self.draw(), F.lit(">"))
            drawn = staged(wanted.withColumn("token", token), "tokens")
            earlier = taken if done is None else taken.unionByName(done.select("token"))
            once = drawn.groupBy("token").agg(F.count("*").alias("n")).where("n = 1").join(earlier, "token", "left_anti").select("token")
            good = staged(drawn.join(once, "token"), "tokens").select(*key, "token")
            done = good if done is None else done.unionByName(good)
            wanted = drawn.select(*key).join(good, key, "left_anti")
            if wanted.isEmpty():
                return done
        raise ValueError(f"handles still collide after {self.most_rounds} draws")

    def plain(self, found: Column) -> Column:
        bare = F.regexp_replace(found, r"\s", "")
        return F.concat(F.upper(F.substring_index(bare, ":", 1)), F.lit(":"), F.lower(F.substring_index(bare, ":", -1)))


def encode(rows: DataFrame, actions: dict[str, str] | None = None, default: str = "ENCODE", codec: Codec | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts with their spans replaced, and the vault that restores them.

    ``rows`` has request_id, text_no, text and spans that are apart and in order. ENCODE puts ``<PERSON_1>``, the same for the same value in
    all of a request's texts; MASK puts ``<PERSON>``; BLOCK rejects the whole request. Write the vault before the texts. ``codec`` mints the tokens,
    by default numbered ones.
    """
    rows = staged(rows.select("request_id", "text_no", "text", "spans"), "encode")  # read several times below; detection is costly
    known = F.create_map(*[F.lit(x) for p in (actions or {"": default}).items() for x in p])
    opened = rows.select("request_id", "text_no", F.posexplode("spans").alias("i", "s"), "text").select(
        "request_id", "text_no", "i", F.col("s.entity_type").alias("entity_type"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"),
        (F.col("text_no").cast("long") * (1 << 32) + F.col("s.start")).alias("pos"),
    )
    opened = opened.withColumn("action", F.coalesce(F.try_element_at(known, F.col("entity_type")), F.lit(default)))
    blocked = opened.where("action = 'BLOCK'").select("request_id").distinct()
    minted = (codec or Ordinals()).mint(opened.where("action = 'ENCODE'"), rows.select("request_id", "text"))
    token = F.when(F.col("action") == "MASK", F.concat(F.lit("<"), "entity_type", F.lit(">"))).otherwise(F.col("minted"))
    named = opened.join(minted.withColumnRenamed("token", "minted"), ["request_id", "entity_type", "value"], "left").withColumn("token", token)
    placed = named.groupBy("request_id", "text_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens"))
    joined = rows.join(placed, ["request_id", "text_no"], "left").join(blocked, "request_id", "left_anti")
    pairs = F.reverse(F.coalesce(F.arrays_zip("spans", "tokens"), F.array().cast(f"array<struct<spans:{SPAN},tokens:string>>")))
    splice = lambda t, p: F.when(p["tokens"].isNull(), t).otherwise(
        F.concat(F.substring(t, F.lit(1), p["spans"]["start"]), p["tokens"], F.substring(t, p["spans"]["end"] + 1, F.length(t)))
    )
    encoded = joined.select("request_id", "text_no", F.aggregate(pairs, F.col("text"), splice).alias("encoded"))
    vault = minted.join(blocked, "request_id", "left_anti").select("token", "entity_type", "value", "request_id")
    return encoded, vault


def handle_tokens(vault: DataFrame) -> DataFrame:
    """Random 8-byte handles. Write the result before using it: another evaluation would give other handles."""
    return vault.withColumn("handle", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))


_LOOSE = Ordinals.pattern


def find_tokens(text: Column) -> Column:
    """Tokens in a text in plain form, whatever their case, inner blanks or escapes."""
    raw = F.regexp_extract_all(text, F.lit(f"({_LOOSE})"), 1)
    return F.transform(raw, lambda t: F.upper(F.regexp_replace(F.regexp_replace(t, r"[\s\\]", ""), "_+", "_")))


def decode(texts: DataFrame, vault: DataFrame, codec: Codec | None = None) -> DataFrame:
    """Texts (request_id, text_no, text) with the codec's tokens restored in one pass; unknown ones stay as they are."""
    codec = codec or Ordinals()
    marked = texts.select("request_id", "text_no", F.regexp_extract_all("text", F.lit(f"({codec.pattern})"), 1).alias("raw"), F.split("text", codec.pattern).alias("literal"))
    parts = marked.select("request_id", "text_no", F.posexplode(F.arrays_zip("literal", "raw")).alias("i", "p")).select("request_id", "text_no", "i", "p.literal", "p.raw")
    known = vault.select("request_id", F.col("token").alias("plain"), "value")
    joined = parts.withColumn("plain", codec.plain(F.col("raw"))).join(known, ["request_id", "plain"], "left")
    piece = F.concat(F.coalesce("literal", F.lit("")), F.coalesce("value", "raw", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("piece"))))
    return joined.groupBy("request_id", "text_no").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


# Vault


def live(vault: DataFrame, as_of: str) -> DataFrame:
    return vault.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def sweep_expired(vault: DataFrame, as_of: str) -> DataFrame:
    """What stays when expired tokens are erased; overwrite the table with it."""
    return live(vault, as_of)


def erase(vault: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The vault without the sessions or subjects listed in ``values`` (column)."""
    return vault.join(values.select(column).distinct(), column, "left_anti")


def export_subject(vault: DataFrame, subject: str) -> DataFrame:
    return vault.where(F.col("subject_id") == subject).orderBy("token", "request_id")


def activity_counts(events: DataFrame) -> DataFrame:
    """Spans by entity and action, and tokens seen and resolved."""
    opened = events.select("request_id", F.explode("entities").alias("e"), "seen", "resolved")
    return opened.groupBy(F.col("e.entity_type").alias("entity_type"), F.col("e.action").alias("action")).agg(
        F.count("*").alias("spans"), F.sum("seen").alias("seen"), F.sum("resolved").alias("resolved")
    )


# Evaluation


def score_strict(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """True and false positives and misses by class: of n expected and m predicted equal spans, the lesser number agree."""
    key = ["doc_id", "start", "end", "cls"]
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = count(expected, "n").join(count(predicted, "m"), key, "full").na.fill(0, ["n", "m"])
    hit = F.least("n", "m")
    sums = both.groupBy("cls").agg(F.sum(hit).alias("tp"), F.sum(F.col("m") - hit).alias("fp"), F.sum(F.col("n") - hit).alias("fn"))
    return with_ratios(sums)


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision and recall, 1 where there is nothing to find."""
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(1.0), 6)
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def score_lenient(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """As ``score_strict``, but overlapping spans of one class agree, each with at most one, from left to right.

    The fold runs in each document and class; a document's spans are few.
    """
    spans = lambda df, name: df.groupBy("doc_id", "cls").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    both = spans(expected, "e").join(spans(predicted, "p"), ["doc_id", "cls"], "full")
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = both.select("cls", *[F.coalesce(F.col(c).cast("array<struct<start:int,end:int>>"), none).alias(c) for c in ("e", "p")])

    def step(a, x):
        meets = F.filter(a["left"], lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        hit = F.size(meets) > 0
        at = F.array_position(a["left"], F.try_element_at(meets, F.lit(1)))
        rest = F.concat(F.slice(a["left"], F.lit(1), (at - 1).cast("int")), F.slice(a["left"], (at + 1).cast("int"), F.size(a["left"])))
        return F.struct(F.when(hit, rest).otherwise(a["left"]).alias("left"), (a["tp"] + hit.cast("int")).alias("tp"))

    tp = F.aggregate("e", F.struct(F.col("p").alias("left"), F.lit(0).alias("tp")), step, lambda a: a["tp"])
    counted = both.select("cls", tp.alias("t"), F.size("e").alias("n"), F.size("p").alias("m"))
    return with_ratios(counted.groupBy("cls").agg(F.sum("t").alias("tp"), F.sum(F.col("m") - F.col("t")).alias("fp"), F.sum(F.col("n") - F.col("t")).alias("fn")))


def merge_reports(reports: DataFrame) -> DataFrame:
    return with_ratios(reports.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def detected_documents(rows: DataFrame) -> DataFrame:
    """Documents and spans by entity."""
    opened = rows.select("doc_id", F.explode("spans").alias("s"))
    return opened.groupBy(F.col("s.entity_type").alias("entity_type")).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("spans"), count_if(F.col("s.detector") == "rules").alias("by_rules"))
