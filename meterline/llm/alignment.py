"""Cross-tokenizer alignment: each distinct text is tokenised and aligned once, its pairs weighed by its copies."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SENT_PAIRS = 1 << 19  # most frequent pairs whose counts are sent (9 MB); the links of the others are joined to their counts
CACHE_PIECES = 320_000  # pieces of text in each of the two generations whose alignment a worker keeps
SLICE_ROWS = 256  # texts whose links are held at once
B_IDS = 1 << 31  # a pair is one number: A's id times this, plus B's id

#: A text is cut before a space that follows no white space, control or invisible character, nor the stand-in for a space.
_CUT = re.compile(r"(?<=[^\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u2581\u3000\ufeff])(?= )")


class Piece(NamedTuple):
    """What a piece of text adds: A's tokens, the groups' rendering, and the linked pairs of ids."""

    n_a: int
    rendered: str
    links: bytes  # of longs: a * 2 ** 31 + b


#: How the byte-level tokenizer cuts a text before it merges bytes; fixed by its kind.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\t\n\r -\u024f]*").fullmatch  # no version of the character tables disagrees on these


class Aligner:
    """Encodes pieces by both tokenizers and aligns them; kept by its worker."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = _byte_level(self.a)
        self.b_pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b_pieces)]
        self.a_size = {i: len(t) for i, t in self.a_bytes.items()}
        self.b_size = [len(t) for t in self.b_bytes]
        self.names = list(map(str, range(max(len(self.b), max(self.a_bytes) + 1))))
        self.fast = _ranked(a_file, self.a_bytes)
        # Where no token has a place to cut inside, none reaches over a cut.
        self.cuts = not any(_CUT.search(t.decode("utf-8", "replace")) for t in (*self.a_bytes.values(), *self.b_bytes))
        self.known: dict[str, Piece | None] = {}
        self.older: dict[str, Piece | None] = {}  # goes when the newer generation is full; what is met again moves to the newer

    def pieces(self, text: str) -> list[str]:
        """The space and the text, cut where both tokenizers cut as well."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encode_a(self, pieces: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        return [self.fast(p) if p.isascii() or _PLAIN(p) else self.a.encode(p, add_special_tokens=False).ids for p in pieces]

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        new = [p for p in pieces if p not in self.known]
        if self.older:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.known]
        if new:
            b = self.b.encode([p[1:] for p in new], num_threads=1)  # the space is put before by the tokenizer
            self.known.update(zip(new, map(self.align, new, self.encode_a(new), b)))

    def _returns(self, piece: str, a: list[int], b: list[int]) -> bool:
        """Whether the joined bytes of both sides are the piece's."""
        pieces = self.b_pieces
        if "▁" not in piece and "".join([pieces[x] for x in b]) == piece.replace(" ", "▁"):
            raw, sizes = len(piece.encode("utf-8", "surrogatepass")), self.a_size
            return sum([sizes[x] for x in a]) == raw  # the byte-level side changes no byte
        raw = piece.encode("utf-8", "surrogatepass")
        return b"".join([self.a_bytes[x] for x in a]) == raw == b"".join([self.b_bytes[x] for x in b])

    def align(self, piece: str, a: list[int], b: list[int]) -> Piece | None:
        """None if the joined bytes of either side differ from the piece's."""
        if not a or not self._returns(piece, a, b):
            return None
        a_size, b_size, names = self.a_size, self.b_size, self.names
        n, i, j = len(a), 0, 0
        x, y = a[0], b[0]
        end_a, end_b, left, right = a_size[x], b_size[y], names[x], names[y]
        out, links = [], [x * B_IDS + y]
        while True:
            # The side that ends first goes on; tokens that overlap are linked; where both end a group does.
            if end_a == end_b:
                out.append(f"{left}|{right}")
                i, j = i + 1, j + 1
                if i == n:
                    return Piece(n, ";".join(out), array("q", links).tobytes())
                x, y = a[i], b[j]
                left, right = names[x], names[y]
                end_a, end_b = end_a + a_size[x], end_b + b_size[y]
            elif end_a < end_b:
                i += 1
                x = a[i]
                left = f"{left},{names[x]}"
                end_a += a_size[x]
            else:
                j += 1
                y = b[j]
                right = f"{right},{names[y]}"
                end_b += b_size[y]
            links.append(x * B_IDS + y)

    def text(self, text: str) -> list[Piece] | None:
        """The pieces of a text, or none if its bytes don't come back."""
        parts = self.pieces(text)
        self.learn(set(parts))
        found = list(map(self.known.__getitem__, parts))
        if None not in found:
            return found
        whole = " " + text  # pieces that differ could make up for each other
        one = self.align(whole, self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(text))
        return None if one is None else [one]


def _byte_level(tokenizer) -> dict[int, bytes]:
    """Each id's bytes: byte-level tokens spell a byte by a printable character, bytes that have none by those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    return {i: special[i].encode() if i in special else bytes(spelt[c] for c in t) for t, i in tokenizer.get_vocab().items()}


def _ranked(a_file: str, a_bytes: dict[int, bytes]):
    """The same encoding by a quicker library, which merges by the ids' order; None if the file's merges have another or it cuts words otherwise."""
    import tiktoken

    with open(a_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if made != sorted(set(made)) or -1 in made or spec["normalizer"] or not own.items() <= cut.items() or model.get("ignore_merges"):
        return None
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for i, t in a_bytes.items() if i not in special}
    return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_LINKS = pa.struct([("pair", pa.int64()), ("n", pa.int64())])


def _lists(values: np.ndarray, n: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of pairs and numbers, of which ``ends`` has the offsets."""
    inner = pa.StructArray.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], fields=list(_LINKS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)


def _align(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str) -> Iterator[pa.RecordBatch]:
    """Each text's measures and its different links with their numbers."""
    aligner = _aligner(a_file, b_file)
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(start, SLICE_ROWS)
            rows, digests, pairs, times, ends = [], [], [], [], [0]
            for text in batch["text"]:
                pieces = aligner.text(text.as_py()) or []
                flat = np.frombuffer(b"".join([p.links for p in pieces]), np.int64)
                rendered = ";".join([p.rendered for p in pieces]).encode()
                n_a, n_groups = sum([p.n_a for p in pieces]), rendered.count(b"|")
                rows.append([n_a, len(flat) + n_groups - n_a, n_groups, len(flat)])  # each further end of a token begins a link or a group
                digests.append(hashlib.sha256(rendered).hexdigest() if pieces else "")
                found, n = np.unique(flat, return_counts=True)
                pairs.append(found)
                times.append(n)
                ends.append(ends[-1] + len(found))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            links = _lists(np.concatenate(pairs), np.concatenate(times), np.array(ends))
            names = ["text_key", "copies", *MEASURES, "groups_sha256", "links"]
            yield pa.RecordBatch.from_arrays([batch["text_key"], batch["copies"], *columns, pa.array(digests, pa.string()), links], names)


def _look_up(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Each text's sums over the links whose counts were sent, and its other links."""
    pairs, counts, best = sent.value
    for batch in batches:
        links = batch["links"]
        ends = links.offsets.to_numpy() - links.offsets[0].as_py()
        inner = links.flatten()
        pair, n = inner.field("pair").to_numpy(), inner.field("n").to_numpy()
        at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
        hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        n_best = summed(np.where(hit, n * best[at], 0) if len(pairs) else n * 0)
        count_sum = summed(np.where(hit, n * counts[at], 0) if len(pairs) else n * 0)
        left = np.concatenate([[0], np.cumsum(~hit)])[ends]
        columns = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), _lists(pair[~hit], n[~hit], left)]
        kept = ["text_key", *MEASURES, "groups_sha256"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *columns], [*kept, "n_best", "count_sum", "rest"])


def align(docs: DataFrame, a_file: str, b_file: str, sent_pairs: int = SENT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Each document's measures of how a byte-level tokenizer (A) and a piece tokenizer (B) agree on it, and the corpus's linked pairs (a_id, b_id, n, best).

    Documents are shuffled by their full text, so that each distinct text is tokenised and aligned once; copies are counted before the
    shuffle. The work goes piece by piece, cut at spaces where neither tokenizer has a token that reaches
    over, so a worker aligns a frequent word once. A pair's count sums the links of every text times its copies; ``best`` marks
    the pairs with their B id's highest count. The counts of the ``sent_pairs`` most frequent pairs are sent to the tasks;
    a text's links of other pairs are joined to the pairs by a shuffle, so the result doesn't depend on that bound. Measures meet
    the documents by the text's SHA-256, in a join that Spark can split.

    Texts that are null or empty, or whose tokens don't join to their bytes, have no tokens: measures 0, groups_sha256 ''. Repeated
    rows and null ids give a row each. Only doc_id and text are read, so other columns may have any name. The vocabulary files must
    be at their paths on every worker.
    """
    key = F.sha2("text", 256)
    longs = ", ".join(f"{m} long" for m in MEASURES)
    links = "array<struct<pair:long,n:long>>"
    distinct = docs.where("length(text) > 0").groupBy("text").agg(F.count("*").alias("copies"))
    fields = f"text_key string, copies long, {longs}, groups_sha256 string, links {links}"
    aligned = staged(distinct.select(key.alias("text_key"), "text", "copies").mapInArrow(lambda b: _align(b, a_file, b_file), fields), "align-texts")
    linked = aligned.select("copies", F.explode("links").alias("l"))
    totals = linked.groupBy("l.pair").agg(F.sum(F.col("l.n") * F.col("copies")).alias("n")).withColumn("b_id", F.col("pair") % B_IDS)
    highest = totals.groupBy("b_id").agg(F.max("n").alias("highest"))
    pairs = staged(totals.join(highest, "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "align-pairs")
    first = pairs.orderBy(F.desc("n"), "pair").limit(sent_pairs).toArrow().sort_by("pair")
    held = docs.sparkSession.sparkContext.broadcast(tuple(first[c].to_numpy() for c in ("pair", "n", "best")))
    fields = f"text_key string, {longs}, groups_sha256 string, n_best long, count_sum long, rest {links}"
    measured = staged(aligned.mapInArrow(lambda b: _look_up(b, held), fields), "align-measures")
    rest = measured.select("text_key", F.explode("rest").alias("r")).select("text_key", "r.pair", F.col("r.n").alias("times"))
    more = rest.join(pairs, "pair").groupBy("text_key").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = measured.drop("rest").join(more, "text_key", "left")
    plus = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
    whole = whole.select("text_key", "n_a", "n_b", "n_groups", "n_links", plus("n_best", F.col("more_best")).alias("n_best"), plus("count_sum", F.col("more_sum")).alias("count_sum"), "groups_sha256")
    whole = staged(whole, "align-whole")  # the join below then has two plain sides, which Spark can split at a text with many copies
    joined = docs.select("doc_id", key.alias("text_key")).join(whole, "text_key", "left")
    none = {"groups_sha256": F.lit("")}
    rows = joined.select("doc_id", *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in whole.columns[1:]])
    ids = pairs.select(F.floor(F.col("pair") / B_IDS).cast("long").alias("a_id"), (F.col("pair") % B_IDS).alias("b_id"), "n", "best")
    return rows, ids
