"""The vault at rest: values sealed under keys of their scope, and a blind index by which a search reads only rows that may fit.

A row is (token, request_id, value, …); its scope is the request. Keys reach the tasks as broadcasts, so neither plans nor event logs show them.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..shared import bytes_in_memory, new_path, staged, staged_paths
from . import relations

# Sealing

_AAD = ("token", "request_id")


def secret(spark: SparkSession, key: str | bytes | Broadcast) -> Broadcast:
    """A master key as the tasks read it."""
    return key if isinstance(key, Broadcast) else spark.sparkContext.broadcast(key.encode() if isinstance(key, str) else bytes(key))


def _scope_key(master: Broadcast) -> Column:
    """The 32 bytes that seal a scope's values."""

    @F.arrow_udf("binary")
    def derive(scope: pa.Array) -> pa.Array:
        return pa.array([hmac.digest(master.value, b"seal\0" + str(s).encode(), "sha256") for s in scope.to_pylist()], pa.binary())

    return derive(F.col("request_id").cast("string"))


def _aad() -> Column:
    return F.concat_ws("\x01", *_AAD)


def seal(vault: DataFrame, key: str | bytes | Broadcast) -> DataFrame:
    """Values encrypted under their scope's key and bound to their token and request: ``ciphertext`` in place of ``value``.

    The nonce derives from token, request and value, so a task that is run again writes the same; equal rows therefore look equal,
    while one value under two tokens or in two requests doesn't.
    """
    nonce = F.unhex(F.substring(F.sha2(F.concat_ws("\x01", *_AAD, "value"), 256), 1, 24))
    sealed = F.aes_encrypt(F.col("value"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, _aad())
    keyed = vault.withColumn("__key", _scope_key(secret(vault.sparkSession, key)))
    return keyed.withColumn("ciphertext", F.base64(sealed)).drop("value", "__key")


def _opened(vault: DataFrame, master: Broadcast, sealed: Column) -> DataFrame:
    value = F.try_aes_decrypt(sealed, F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), _aad()).cast("string")
    return vault.withColumn("__key", _scope_key(master)).withColumn("value", value).drop("ciphertext", "__key")


def unseal(vault: DataFrame, key: str | bytes | Broadcast) -> DataFrame:
    """``value`` in place of ``ciphertext``; null where token, request or key aren't those it was sealed with."""
    return _opened(vault, secret(vault.sparkSession, key), F.unbase64("ciphertext"))


# Blind index

GRAM = 3
BLOCK, HELD = 10_000, 300_000  # values that a list of postings covers at most, and characters whose grams a task holds, but for those of one value
TERMS = "struct<exact:binary,normalized:binary>"
POSTINGS = "gram long, first long, n int, places array<smallint>"
MODES = ("exact", "normalized", "substring")


def _mac(master: bytes, kind: bytes, scope: str, text: str, size: int) -> bytes:
    own = hashlib.blake2b(kind + len(scope).to_bytes(4, "big") + scope.encode("utf-8", "surrogatepass"), key=master[:64], digest_size=size)
    own.update(text.encode("utf-8", "surrogatepass"))
    return own.digest()


def _grams(text: str, lengths: Iterable[int]) -> set[str]:
    return {text[i : i + n] for n in lengths for i in range(len(text) - n + 1)}


def _gram_key(master: bytes, scope: str, gram: str) -> int:
    return int.from_bytes(_mac(master, b"g", scope, gram, 8), "big", signed=True)


def _terms(master: Broadcast, text: Column) -> Column:
    """The keyed terms of whole values."""

    @F.arrow_udf(TERMS)
    def make(scopes: pa.Array, values: pa.Array, folded: pa.Array) -> pa.Array:
        key, out = master.value, []
        for scope, value, plain in zip(scopes.to_pylist(), values.to_pylist(), folded.to_pylist()):
            known = value is not None and scope is not None
            out.append({"exact": _mac(key, b"e", scope, value, 16), "normalized": _mac(key, b"n", scope, plain, 16)} if known else None)
        return pa.array(out, pa.struct([("exact", pa.binary()), ("normalized", pa.binary())]))

    return make(F.col("request_id").cast("string"), text, sc.normalize_search(text))


def _asked_grams(master: Broadcast, text: Column) -> Column:
    """A normalized query's keyed grams of its greatest length up to GRAM."""

    @F.arrow_udf("array<long>")
    def make(scopes: pa.Array, folded: pa.Array) -> pa.Array:
        key, out = master.value, []
        for scope, plain in zip(scopes.to_pylist(), folded.to_pylist()):
            known = plain is not None and scope is not None
            out.append(sorted(_gram_key(key, scope, g) for g in _grams(plain, [min(GRAM, len(plain))]) if g) if known else None)
        return pa.array(out, pa.list_(pa.int64()))

    return make(F.col("request_id").cast("string"), text)


def _different(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order; np.unique takes several times as long."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])]


def _lists(master: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From values (id, scope, normalized text) the postings of each block of them: a gram, the block's first id, and the places after it that have the gram."""

    def packed(ids: np.ndarray, scopes: list[str], texts: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        place = np.repeat(ids - ids[0], [len(t) for t in texts])
        codes, places = [], []
        for n in range(1, GRAM + 1):  # a gram's number: 21 bits for each character, 0 for none
            size = max(0, len(points) - n + 1)
            inside = place[:size] == place[n - 1 :]  # not over the end of a text
            codes.append(sum(points[i : size + i] << 21 * i for i in range(n))[inside])
            places.append(place[:size][inside])
        names = {s: i for i, s in enumerate(dict.fromkeys(scopes))}
        scope_at = np.zeros(BLOCK, np.int64)
        scope_at[ids - ids[0]] = [names[s] for s in scopes]
        codes, at = np.concatenate(codes), np.concatenate(places)
        grams = _different(codes)
        gram = np.searchsorted(grams, codes)
        pairs = _different((scope_at[at] * len(grams) + gram) * BLOCK + at)  # by scope and gram, each value once
        lists = pairs // BLOCK
        starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        lists = lists[starts]
        own, key = list(names), master.value
        text = ["".join(chr((g >> 21 * i & 0x1FFFFF) - 1) for i in range(GRAM) if g >> 21 * i) for g in grams.tolist()]
        keyed = [_gram_key(key, own[x // len(grams)], text[x % len(grams)]) for x in lists.tolist()]
        ends = np.append(starts, len(pairs)).astype(np.int32)
        columns = [pa.array(keyed, pa.int64()), pa.array(np.full(len(lists), ids[0])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(ends, (pairs % BLOCK).astype(np.int16))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "first", "n", "places"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scopes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            start, held = 0, 0
            for i in range(len(ids) + 1):
                if i == len(ids) or i > start and (held >= HELD or not 0 < ids[i] - ids[i - 1] or ids[i] - ids[start] >= BLOCK):
                    if held:
                        yield packed(ids[start:i], scopes[start:i], texts[start:i])
                    start, held = i, 0
                if i < len(ids):
                    held += len(texts[i])

    return make


@dataclass(frozen=True)
class Index:
    """``rows``: the sealed vault with the terms of its whole values; ``values`` (id, request_id, token, ciphertext, normalized_term): one row for all of its normalized value;
    ``postings`` (gram, first, n, places): a gram and the ``n`` values, by their places after ``first``, that have it; ``frequencies`` (gram, n). All but the rows are None if it isn't made for substrings."""

    rows: DataFrame
    values: DataFrame | None
    postings: DataFrame | None
    frequencies: DataFrame | None


def index(vault: DataFrame, key: str | bytes | Broadcast, modes: Iterable[str] = MODES, path: str | None = None) -> Index:
    """Seal a vault and derive its terms: keyed hashes of each value, of its normalized form and of that form's grams, all bound to the scope.

    The index is written to ``path``, or added to the one there; without a path it lies in the shared folder until ``write_index`` copies it.
    Equal values of a scope share their postings, which name values by number and not the rows. A list of places, in place of a term for each gram and value,
    keeps the postings smaller than the rows. Postings are made for substring
    queries alone; without that mode among ``modes`` there are none, and such a search is refused. Who has the tables but not the key learns which rows of one scope have
    equal values or grams, and nothing across scopes. Rows with a null value or scope stay, without terms.
    """
    spark, grams = vault.sparkSession, "substring" in modes
    master = secret(spark, key)
    if path is None:
        path = new_path(spark, "vault-index")
        staged_paths.append(path)
    _same_modes(spark, path, grams)
    batch = _new_batch()
    termed = seal(vault.withColumn("__terms", _terms(master, F.col("value"))), master)
    rows = termed.select("*", F.col("__terms.exact").alias("exact_term"), F.col("__terms.normalized").alias("normalized_term")).drop("__terms")
    rows = _put(rows, path, "rows", batch)  # terms are derived once
    if grams:
        # One sealed row stands for all of its value, so no value is shuffled unsealed.
        one = rows.where("normalized_term is not null").select("request_id", "token", F.unbase64("ciphertext").alias("ciphertext"), "normalized_term").dropDuplicates(["normalized_term"])
        start = uuid.uuid4().int >> 66  # ids of one batch are seldom those of another; where they are, a search compares a few more values
        values = _put(one.select((F.lit(start) + F.monotonically_increasing_id()).alias("id"), "*"), path, "values", batch)
        opened = _opened(values, master, F.col("ciphertext")).where("value is not null")
        texts = opened.select("id", F.col("request_id").cast("string"), sc.normalize_search(F.col("value")).alias("text"))
        postings = _put(texts.mapInArrow(_lists(master), POSTINGS), path, "postings", batch)
        _put(postings.groupBy("gram").agg(F.sum("n").alias("n")), path, "frequencies", batch)
    _note(spark, path, batch, grams)
    return read_index(spark, path)


# The tables of an index lie in a folder for each batch; a batch counts once ``batches`` names it, when all of its tables are there.
_BATCH = "__batch"
_TABLES = ("rows", "values", "postings", "frequencies")


def _new_batch() -> str:
    return f"b{uuid.uuid4().hex}"


def _put(df: DataFrame, path: str, name: str, batch: str) -> DataFrame:
    at = f"{path}/{name}/{_BATCH}={batch}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _note(spark: SparkSession, path: str, batch: str, grams: bool, mode: str = "append") -> None:
    spark.createDataFrame([(batch, grams)], "batch string, substrings boolean").coalesce(1).write.mode(mode).parquet(f"{path}/batches")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _batches(spark: SparkSession, path: str) -> dict[str, bool]:
    """The batches that count, and whether they are made for substrings: a row for each time the index was added to."""
    files, at = _folder(spark, f"{path}/batches")
    return {r.batch: r.substrings for r in spark.read.parquet(f"{path}/batches").collect()} if files.exists(at) else {}


def _same_modes(spark: SparkSession, path: str, grams: bool) -> None:
    if (not grams) in _batches(spark, path).values():
        raise ValueError("the index there is made for other modes")


def write_index(made: Index, path: str, mode: str = "append") -> None:
    """Copy an index to a path, or add it to the one there; ``index`` with a path does without the copy.

    One that is made for substrings and one that isn't can't be added to each other.
    """
    spark, grams = made.rows.sparkSession, made.postings is not None
    _same_modes(spark, path, grams)
    before, batch = _batches(spark, path), _new_batch()
    for name in _TABLES:
        if (table := getattr(made, name)) is not None:
            _put(table, path, name, batch)
    _note(spark, path, batch, grams, mode)  # last: a row counts once its terms are there
    for gone in before.keys() - _batches(spark, path).keys():
        for name in _TABLES:
            files, at = _folder(spark, f"{path}/{name}/{_BATCH}={gone}")
            files.delete(at, True)


def read_index(spark: SparkSession, path: str) -> Index:
    """What has been written; rows added later bring values, postings and frequencies of their own, of which the last are summed."""
    batches = _batches(spark, path)
    read = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col(_BATCH).isin(*batches)).drop(_BATCH)
    if not all(batches.values()):
        return Index(read("rows"), None, None, None)
    return Index(read("rows"), read("values"), read("postings"), read("frequencies").groupBy("gram").agg(F.sum("n").alias("n")))


_OWN = ("ciphertext", "exact_term", "normalized_term", "value")


def _in_scopes(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of the scopes alone; where these aren't few, all rows, which then meet on the scope."""
    return rows.join(F.broadcast(scopes), "request_id", "left_semi") if bytes_in_memory(scopes) <= relations.BROADCAST_BYTES else rows


def _with_substring(made: Index, asked: DataFrame, master: Broadcast) -> DataFrame:
    """The rows of each different query (request_id, query) whose value has it as a part.

    Values are met by the query's rarest gram, opened and compared; only by those that fit are rows met, and these stay sealed.
    """
    termed = staged(asked.withColumn("grams", _asked_grams(master, F.col("query"))), "vault-grams-asked")
    each = termed.select("request_id", "query", F.explode("grams").alias("gram")).join(made.frequencies, "gram", "left")
    least = each.groupBy("request_id", "query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = staged(least.select("request_id", "query", "least.*").where("n > 0"), "vault-rarest")
    met = relations.meeting(made.postings.drop("n"), rarest, ["gram"]).select("request_id", "query", "first", F.explode("places").alias("place"))
    met = met.select("request_id", "query", (F.col("first") + F.col("place")).alias("id"))
    # Of the values met the number is known before they are.
    size = rarest.agg(F.sum(F.col("n") * (F.octet_length("query") + F.octet_length(F.col("request_id").cast("string")) + 64))).first()[0] or 0
    scopes = staged(termed.select("request_id").distinct(), "vault-scopes")
    opened = _opened(relations.meeting(_in_scopes(made.values, scopes), met, ["request_id", "id"], size), master, F.col("ciphertext"))
    fits = opened.where(F.contains(sc.normalize_search(F.col("value")), F.col("query")))
    fits = staged(fits.select("request_id", "query", "normalized_term").distinct(), "vault-fits")  # a value added twice has two ids
    rows = _in_scopes(made.rows.drop("ciphertext", "exact_term").where("normalized_term is not null"), scopes)
    every = termed.where(F.size("grams") == 0).select("request_id", "query")
    return relations.meeting(rows, fits, ["request_id", "normalized_term"]).unionByName(rows.join(every, "request_id"))


def search(made: Index, queries: DataFrame, key: str | bytes | Broadcast, mode: str = "normalized") -> DataFrame:
    """Hits of each query (query_id, request_id, query): query_id and the vault's columns, without the values.

    Queries that ask the same are answered once. Exact and normalized ones meet their rows by the term. A substring query meets the postings
    of its rarest gram, and by them values, which are opened and compared; the rows of those that fit are its hits. One without a posting finds
    nothing, and an empty one fits every value of its scope. Only what is so met is opened, so a scope of any size can be searched and nothing
    is refused. All joins are on equal keys; null queries and rows without a value find nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "substring" and made.postings is None:
        raise ValueError("the index isn't made for substrings")
    master = secret(made.rows.sparkSession, key)
    wanted = F.col("query") if mode == "exact" else sc.normalize_search(F.col("query"))
    asked = staged(queries.where("query IS NOT NULL").select("query_id", "request_id", wanted.alias("query")), "vault-queries")
    once = asked.select("request_id", "query").distinct()
    if mode == "substring":
        hits = _with_substring(made, once, master)
    else:
        term = f"{mode}_term"
        opened = unseal(once.withColumn(term, _terms(master, F.col("query"))[mode]).join(made.rows, ["request_id", term]), master)
        hits = opened.where((F.col("value") if mode == "exact" else sc.normalize_search(F.col("value"))) == F.col("query"))
    own = [c for c in made.rows.columns if c not in _OWN]
    found = hits.select(F.col("query").alias("__query"), *own)
    asked = asked.select("query_id", F.col("request_id").alias("__scope"), F.col("query").alias("__query"))
    return found.join(asked, (found["request_id"] == asked["__scope"]) & (found["__query"] == asked["__query"])).select("query_id", *own)


# Without an index

MAX_CANDIDATES = 100_000


def scan(vault: DataFrame, scope: str, query: str, mode: str = "normalized", most: int = MAX_CANDIDATES) -> DataFrame:
    """A scope's tokens whose value is ``query``: exact, normalized or as a part, by reading all of the scope.

    As in the system this serves, a scope of over ``most`` tokens is refused; ``search`` has no such bound.
    """
    own = vault.where(F.col("request_id") == scope)
    if own.limit(most + 1).count() > most:
        raise ValueError(f"over {most} candidates: narrow the scope or search by an index")
    if mode == "exact":
        return own.where(F.col("value") == query)
    wanted = sc.normalize_search(F.lit(query))
    folded = sc.normalize_search(F.col("value"))
    return own.where(folded == wanted if mode == "normalized" else F.contains(folded, wanted))
