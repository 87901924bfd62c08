"""Reading batch files and pages, and writing exports, windows and rollups."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relations import running_sum
from ..shared import staged

# Sources


def split_objects(text: str) -> Iterator[tuple[str | None, str | None]]:
    """The JSON objects of a text, which may span lines, and at last what can't be read, with its fault."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return
        try:
            found, end = decoder.raw_decode(text, at)
        except ValueError as e:
            yield None, str(e)
            return
        yield json.dumps(found, ensure_ascii=False), None
        at = end


_STRING = re.compile(r'"(?:[^"\\]|\\.)*("?)')
_PLACE = ["path", "block", "line"]


def line_depth(line: str) -> tuple[int, bool]:
    """By how much a line of JSON nests deeper, and whether it ends outside a string, as it must."""
    if '"' not in line:
        return line.count("{") + line.count("[") - line.count("}") - line.count("]"), True
    open_end = any(not m[1] for m in _STRING.finditer(line))
    bare = _STRING.sub("", line)
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]"), not open_end


def read_batch_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """path, n, request (JSON) and error of each object in the batch files under ``path``; an unreadable rest is one error row.

    Objects may span lines. Spark splits a file among tasks at line ends; each line's change of nesting is summed up over the lines
    before it, in two levels (``running_sum``), and the lines between two places without nesting are put together and parsed. So a file of any size is
    read by many tasks, and a task holds no more than one object's lines. Blank lines are passed over.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    lines = staged(spark.read.text(path).select(*place, "value"), "batch-lines")

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_depth(v.as_py() or "") for v in batch["value"]]
            columns = [*[batch[c] for c in _PLACE], pa.array([d for d, _ in found], pa.int64()), pa.array([ok for _, ok in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*_PLACE, "deeper", "ok"])

    nested = running_sum(lines.mapInArrow(depths, "path string, block long, line long, deeper long, ok boolean"), "path", ["block", "line"], "deeper", "depth")
    # A line after which nothing is open ends a part; the next begins another.
    parts = running_sum(nested.withColumn("ends", (F.col("depth") <= 0).cast("long")), "path", ["block", "line"], "ends", "closed")
    parts = parts.withColumn("part", F.col("closed") - F.col("ends"))
    # A part that never ends, ends below nothing or breaks off in a string can't be read, and so needn't be put together.
    faults = parts.groupBy("path", "part").agg(F.max("ends").alias("ends"), F.min("depth").alias("least"), F.min(F.col("ok").cast("long")).alias("ok"), F.max("line").alias("at"))
    sound = (F.col("ends") > 0) & (F.col("least") >= 0) & (F.col("ok") > 0)
    own = parts.select(*_PLACE, "part").join(faults.where(sound).select("path", "part"), ["path", "part"])
    whole = lines.join(own, _PLACE).groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    whole = whole.select("path", "part", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, i, r, e) for p, k, v in zip(*(batch[c].to_pylist() for c in ("path", "part", "text"))) for i, (r, e) in enumerate(split_objects(v))]
            kinds = pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["path", "part", "i", "request", "error"])

    broken = faults.where(~sound).select("path", "part", F.lit(0).alias("i"), F.lit(None).cast("string").alias("request"), F.lit("an object isn't closed, or is closed twice").alias("error"))
    parsed = staged(whole.mapInArrow(parse, "path string, part long, i int, request string, error string").unionByName(broken), "batch-objects")
    # Nothing after a file's first fault is read.
    fault = parsed.where("error IS NOT NULL").groupBy(F.col("path").alias("p")).agg(F.min("part").alias("fault"))
    read = parsed.join(fault, F.col("path") == F.col("p"), "left").where("fault IS NULL OR part <= fault").withColumn("one", F.lit(1).cast("long"))
    numbered = running_sum(read.select("path", "part", "i", "request", "error", "one"), "path", ["part", "i"], "one", "n")
    return numbered.select("path", (F.col("n") - 1).cast("int").alias("n"), "request", "error")


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, request (JSON) and error of each line that isn't blank, for files with one object a line: a large file is split among tasks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value")).where("value <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [next(split_objects(v)) for v in batch["value"]]
            yield pd.DataFrame({"path": batch["path"], "request": [f[0] for f in found], "error": [f[1] for f in found]})

    return lines.mapInPandas(run, "path string, request string, error string")


def rewrite_batch_model(requests: DataFrame, model: str) -> DataFrame:
    """Requests (request, JSON) with ``body.model`` set and all else as it was, in compact form.

    What isn't an object, or has no object for a body, stays as it is, and so does what isn't JSON.
    """

    @F.pandas_udf("string")
    def rewritten(column: pd.Series) -> pd.Series:
        return column.map(lambda text: _with_model(text, model))

    return requests.withColumn("request", rewritten("request"))


def _with_model(text: str | None, model: str) -> str | None:
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return text
    if not isinstance(found, dict) or not isinstance(found.get("body"), dict):
        return text
    found["body"]["model"] = model
    return json.dumps(found, ensure_ascii=False, separators=(",", ":"))


CHUNK_CHARS = 4_000
_SKIPPED = {"script", "style", "noscript", "template", "textarea", "input", "select", "option", "button"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "table", "section", "article", "nav", "header", "footer", "aside", "blockquote", "pre", "body", "main", "form", "title"}


class _Chunks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.skipped = 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        self.out += [line[i : i + CHUNK_CHARS] for i in range(0, len(line), CHUNK_CHARS)]

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED and tag != "input":
            self.skipped += 1
        elif tag in _BLOCKS or tag == "br":
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


PAGES_AT_ONCE = 64  # that are parsed and given out together


def html_chunks(pages: DataFrame) -> DataFrame:
    """page_id, chunk number and text of the block-level chunks of each page, at most CHUNK_CHARS characters each; longer blocks make several.

    A worker holds one batch of pages as Arrow has it, and the Python texts and chunks of PAGES_AT_ONCE of them.
    """

    kind = pa.schema([("page_id", pa.int64()), ("chunk", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part, rows = batch.slice(i, PAGES_AT_ONCE), []
                for page, html in zip(part["page_id"].to_pylist(), part["html"].to_pylist(), strict=True):
                    parser = _Chunks()
                    parser.feed(html or "")
                    parser.close()
                    parser.flush()
                    rows += [(page, n, t) for n, t in enumerate(parser.out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((), (), ()), kind)], schema=kind)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, chunk int, text string")


# Sinks


def csv_ready(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as readers of the export expect."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def write_csv_export(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet_export(df: DataFrame, path: str) -> None:
    """Snappy files; an empty export keeps its schema."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def export_window(df: DataFrame, start: str, end: str, column: str = "updated_at") -> DataFrame:
    """Rows changed from ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def window_path(root: str, start: str, end: str) -> str:
    plain = lambda s: "".join(c for c in s if c.isalnum())
    return f"{root.rstrip('/')}/usage_{plain(start)}_{plain(end)}"


def write_partitioned(df: DataFrame, path: str, by: str = "usage_date") -> None:
    """Overwrites the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def expire_partitions(spark: SparkSession, path: str, keep_from: str, by: str = "usage_date") -> list[str]:
    """Drops whole day partitions from before ``keep_from`` through Hadoop's file system, and names them."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{by}=") and name.removeprefix(f"{by}=") < keep_from:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix(f"{by}="))
    return sorted(gone)


def upsert_rollup(existing: DataFrame, delta: DataFrame, keys: list[str], counters: list[str], latest: Column | None = None) -> DataFrame:
    """The rollup after ``delta``: counters grow where the key exists, new keys are added, request_id is the new one unless null."""
    old = existing.select(*keys, *counters, "request_id", F.lit(0).alias("age"))
    new = delta.select(*keys, *counters, "request_id", F.lit(1).alias("age"))
    last = F.max_by("request_id", F.when(F.col("request_id").isNotNull(), F.struct("age", "request_id")))
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], last.alias("request_id"))


# Changes in place


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _folder(spark: SparkSession, path: str, by: str, value) -> str:
    """A partition's folder, by Spark's own rule for its name."""
    rule = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{path}/{rule.getPartitionPathString(by, None if value is None else str(value))}"


def recover(spark: SparkSession, path: str, by: str) -> None:
    """Finish what an earlier run has staged wholly; drop what it has staged in part. Run before each change of the table."""
    fs, at = _fs(spark, f"{path}/_staging")
    if fs.exists(at):
        for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if _exists(spark, f"{path}/_staging/{name}/_SUCCESS"):
                _install(spark, path, by, name)
            else:
                _delete(spark, f"{path}/_staging/{name}")


def _install(spark: SparkSession, path: str, by: str, name: str) -> None:
    """Put the staged partitions in the place of the table's; may be repeated, as the staged ones stay until it is done and noted."""
    staging = f"{path}/_staging/{name}"
    rows = spark.read.parquet(f"{staging}/rows")
    if not rows.isEmpty():
        write_partitioned(rows, path, by)
    # A partition that has been emptied isn't overwritten by dynamic overwrite.
    left = rows.select(F.col(by).alias("__left")).distinct()
    emptied = spark.read.parquet(f"{staging}/touched").join(left, F.col(by).eqNullSafe(F.col("__left")), "left_anti").select(F.col(by).cast("string")).collect()
    for r in emptied:
        _delete(spark, _folder(spark, path, by, r[0]))
    fs, done = _fs(spark, f"{path}/_applied/{name}")
    fs.create(done, True).close()
    _delete(spark, staging)


def rewrite_partitions(spark: SparkSession, path: str, by: str, touched: DataFrame, change: Callable[[DataFrame | None], DataFrame], name: str) -> None:
    """Replace the partitions listed in ``touched`` (by) by ``change`` of their rows (None if the table isn't there yet); others aren't read or written.

    The new partitions are written aside, marked complete, then put in place and noted under ``name``. A run that breaks off is finished or dropped by the next, and a
    change whose name is noted isn't made again. The partitions of one change are listed on the driver; writers must take turns.
    """
    recover(spark, path, by)
    if _exists(spark, f"{path}/_applied/{name}"):
        return
    values = touched.select(by).distinct()
    listed = [r[0] for r in values.collect()]
    if not listed:
        return
    present = [folder for folder in (_folder(spark, path, by, v) for v in listed) if _exists(spark, folder)]
    old = None
    if present:
        old = spark.read.option("basePath", path).parquet(*present)
    staging = f"{path}/_staging/{name}"
    change(old).write.mode("overwrite").parquet(f"{staging}/rows")
    values.write.mode("overwrite").parquet(f"{staging}/touched")
    fs, mark = _fs(spark, f"{staging}/_SUCCESS")
    fs.create(mark, True).close()
    _install(spark, path, by, name)


def upsert_into(delta: DataFrame, path: str, keys: list[str], counters: list[str], by: str, name: str) -> None:
    """Add ``delta``'s counters to the rollup at ``path``, which lies in partitions of ``by``, one of its keys. See ``upsert_rollup`` and ``rewrite_partitions``."""
    sums = upsert_rollup(delta.limit(0), delta, keys, counters).select(*keys, *counters, "request_id")
    sums = sums.select(*[F.col(c).cast(delta.schema[c].dataType if c in keys else sums.schema[c].dataType).alias(c) for c in sums.columns])

    def change(old: DataFrame | None) -> DataFrame:
        if old is None:
            return sums
        merged = upsert_rollup(old.withColumn(by, F.col(by).cast(sums.schema[by].dataType)), sums, keys, counters)
        return merged.select(*[F.col(c).cast(sums.schema[c].dataType).alias(c) for c in sums.columns])

    rewrite_partitions(delta.sparkSession, path, by, delta, change, name)


def erase_from(spark: SparkSession, path: str, by: str, column: str, values: DataFrame, name: str) -> None:
    """Erase the rows whose ``column`` is listed in ``values`` from a table in partitions of ``by``; partitions without such rows keep their files."""
    recover(spark, path, by)
    table, gone = spark.read.parquet(path), values.select(column).distinct()
    touched = staged(table.join(gone, column, "left_semi").select(by).distinct(), "touched")
    rewrite_partitions(spark, path, by, touched, lambda old: old.join(gone, column, "left_anti"), name)
