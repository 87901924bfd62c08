"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60  # the cost of what can't be

# A row's code is 3 times its role's initial (s, u, a, other) plus its fault.
INITIALS = "sua"
CLEAN, MUST_GO, CUT = 0, 1, 2

# States: nothing yet, after s, after u, after a. Whole are the first and the last; the next role is always fixed, but that s may come first.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies (0: dropped) after a deterministic damage by crc32(conv_id:turn) % 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 doubles it, 4 makes it the
    user's. A null role, text or part of the key is taken for one space; a null turn stays null.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _step(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The states' least costs before a row, from those after it."""
    initial, fault = divmod(code, 3)
    costs = []
    for q in range(4):
        least = DELETE + after[q]
        if fault != MUST_GO:
            more = TRUNCATED if fault == CUT else 0
            to = NEXT[q]
            if initial == to - 1:
                least = min(least, KEEP + more + after[to])
            elif q == START and initial == 0:
                least = min(least, KEEP + more + after[AFTER_S])
            least = min(least, REROLE + more + after[to])
        costs.append(least)
    return _inserted(costs)


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first; two suffice to come round."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = _inserted([0, FAR, FAR, 0])


class Edits:
    """The ASCII-least of the cheapest edits of a conversation, given its rows' codes; iterating gives each row's, then those at the end.

    Costs of all states are kept at every ``block``-th row only, by default about the square root of their number; a block's are
    computed again as the walk enters it. So beside the codes, a byte a row, memory grows with the square root of the rows.
    """

    def __init__(self, codes: bytes | bytearray, block: int | None = None):
        self.codes, self.block = codes, block or max(1, isqrt(len(codes)))
        self.checkpoints: list[tuple[int, ...]] = []
        after = END
        for i in range(len(codes), -1, -1):
            if i < len(codes):
                after = _step(codes[i], after)
            if i % self.block == 0:
                self.checkpoints.append(after)
        self.checkpoints.reverse()
        self.cost = after[START]

    def _block(self, start: int) -> list[tuple[int, ...]]:
        """Costs before the rows of the block at ``start`` and before the row after it."""
        end = min(start + self.block, len(self.codes))
        costs = [self.checkpoints[end // self.block] if end % self.block == 0 else END]
        for i in range(end - 1, start - 1, -1):
            costs.append(_step(self.codes[i], costs[-1]))
        return costs[::-1]

    def __iter__(self) -> Iterator[str]:
        q = START
        for start in range(0, len(self.codes), self.block):
            costs = self._block(start)
            for i in range(start, min(start + self.block, len(self.codes))):
                q, edits = self._row(q, self.codes[i], costs[i - start], costs[i - start + 1])
                yield edits
        edits = ""
        while END[q] and END[q] == INSERT + END[NEXT[q]]:
            q, edits = NEXT[q], edits + "I"
        yield edits

    @staticmethod
    def _row(q: int, code: int, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[int, str]:
        """Inserts before a row and its own edit: at each place the first of D, I, K and R that costs the least."""
        initial, fault = divmod(code, 3)
        more = TRUNCATED if fault == CUT else 0
        edits = ""
        while True:
            if before[q] == DELETE + after[q]:
                return q, edits + "D"
            if before[q] == INSERT + before[NEXT[q]]:
                q, edits = NEXT[q], edits + "I"
                continue
            to = AFTER_S if q == START and initial == 0 else NEXT[q]
            if initial == to - 1 and before[q] == KEEP + more + after[to]:
                return to, edits + "K"
            return NEXT[q], edits + "R"


class _Conversation:
    """One conversation as its rows pass by: first their codes, then their texts."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial, self.edits, self.audit = None, None, bytearray()
        self.hash, self.written, self.state = hashlib.sha256(), False, START

    def code(self, turn: int | None, initial: str, faults: str, copies: int) -> None:
        """Equal rows at one turn, of which only the first can be no duplicate. faults: of the first."""
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last or self.turns == 0
            self.last = turn
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + (copies - 1)
        self.initial = initial
        again = copies - 1
        if faults == "blank":
            self.blank += copies
            again = 0
            self.codes += bytes([3 * 3 + MUST_GO]) * copies
            return
        self.duplicate += again + (faults == "duplicate")
        self.truncated += faults == "truncated"
        fault = {"duplicate": MUST_GO, "truncated": CUT}.get(faults, CLEAN)
        at = INITIALS.find(initial) if initial else -1
        self.codes += bytes([3 * (at if at >= 0 else 3) + fault]) + bytes([3 * 3 + MUST_GO]) * again

    def _solve(self) -> None:
        if self.edits is None:
            self.solved = Edits(self.codes)
            self.edits = iter(self.solved)

    def _write(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.written else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.written = True

    def _apply(self, edits: str, role: str, text: str) -> None:
        self.audit += edits.encode()
        for e in edits.replace("D", ""):
            self.state = AFTER_S if e == "K" and self.state == START and role[:1] == "s" else NEXT[self.state]
            fixed = "user" if self.state == AFTER_U else "assistant"
            self._write(role if e == "K" else fixed, "" if e == "I" else text)

    def text(self, role: str, text: str, copies: int) -> None:
        self._solve()
        for _ in range(copies):
            self._apply(next(self.edits), role, text)

    def row(self) -> tuple:
        self._solve()
        for edits in self.edits:
            self._apply(edits, "", "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.solved.cost, self.audit.decode(), self.hash.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation: phase 0 opens it, 1 has its rows without and 2 with their texts, both in the same order."""
    now: _Conversation | None = None
    done: list[tuple] = []
    kind = None

    def emit() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, phase, turn, role, fault, copies, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "phase", "turn", "role", "fault", "copies", "text"))):
            if phase == 0:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            elif phase == 1:
                now.code(turn, role[:1], fault, copies)
            else:
                now.text(role, text, copies)
        if done:
            yield emit()
    if now is not None:
        done.append(now.row())
        yield emit()


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text, copies): its faults, the cheapest edits and its repaired hash.

    Rows are taken by turn, nulls first, then by role and by the SHA-256 of the text. A row's fault is the first of blank,
    duplicate (role and text seen earlier) and truncated. Keep costs 0, Rerole 1, Delete 2, Insert 5, a truncated row that stays 5 more; a blank or duplicate
    row must go. ``audit`` has the initials of the cheapest edits that leave roles ``(s?(ua)+)?``, the ASCII-least where several
    cost the same, found by ``Edits``. ``gaps`` counts the turns missing between the first and the last.

    Equal rows are counted and their first turn is found by sums that combine before the shuffle, over rows without
    texts; the texts are shuffled once, to their conversation. A task reads its conversations sorted (Spark sorts on disk if need be), first
    their codes, then their texts, so it holds two bytes for each row of one conversation and one text. A hash over a conversation can
    only be computed from its beginning to its end, so one task hashes a conversation however long.

    A conversation whose rows are all dropped (copies 0) has zeros, an empty audit and the hash of nothing. Null ids are one
    conversation. A null role or text counts as one space, null copies as 1. An empty table gives none. Other columns are not read.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), F.coalesce("copies", F.lit(1)).alias("copies"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    left = rows.where("copies > 0")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    alone = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    each = left.groupBy("conv_id", "turn", "role", "digest", alone.alias("alone")).agg(F.sum("copies").alias("copies"))
    said = each.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    first = said.agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"))  # nulls come first
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("alone") == "blank", "blank").when(F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), "duplicate").otherwise(F.col("alone"))
    none = lambda kind: F.lit(None).cast(kind)
    codes = each.join(first, same).select("conv_id", F.lit(1).alias("phase"), "turn", "role", "digest", fault.alias("fault"), "copies", none("string").alias("text"))
    texts = left.select("conv_id", F.lit(2).alias("phase"), "turn", "role", "digest", none("string").alias("fault"), F.col("copies").cast("long").alias("copies"), "text")
    opened = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", F.lit(0).alias("phase"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("fault"), none("long").alias("copies"), none("string").alias("text")
    )
    together = opened.unionByName(codes).unionByName(texts).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return ordered.select("conv_id", "phase", "turn", "role", "fault", "copies", "text").mapInArrow(_repair, fields)


def oracle_sql() -> str:
    """The rows of ``repair(damage(conversations))`` in DuckDB's SQL: least (cost, edits) for each state, folded over a conversation's rows."""
    plus = lambda s, e, c: f"{{'c': a.s[{s}].c + {c}, 'e': a.s[{s}].e || '{e}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    kept = lambda i: f"CASE WHEN x.op % 3 = 1 OR x.op // 3 <> {i} THEN {FAR} WHEN x.op % 3 = 2 THEN {KEEP + TRUNCATED} ELSE {KEEP} END"
    roled = f"CASE x.op % 3 WHEN 1 THEN {FAR} WHEN 2 THEN {REROLE + TRUNCATED} ELSE {REROLE} END"
    to_user = [plus(s, "K", kept(1)) for s in (1, 2, 4)] + [plus(s, "R", roled) for s in (1, 2, 4)]
    row = [
        plus(1, "D", DELETE), least(plus(2, "D", DELETE), plus(1, "K", kept(0))), least(plus(3, "D", DELETE), *to_user),
        least(plus(4, "D", DELETE), plus(3, "K", kept(2)), plus(3, "R", roled)),
    ]
    inserted = ["a.s[1]", "a.s[2]", least("a.s[3]", *[plus(s, "I", INSERT) for s in (1, 2, 4)]), least("a.s[4]", plus(3, "I", INSERT))]
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH p AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]) AS steps
  FROM conversations),
k AS (SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(steps)),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS kind FROM p),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again, right(rtrim(text, {blanks}), 1) AS last, left(role, 1) AS initial FROM o),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
c AS (SELECT *, CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END * 3 + CASE fault WHEN 'blank' THEN 1 WHEN 'duplicate' THEN 1 WHEN 'truncated' THEN 2 ELSE 0 END AS code FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list_concat([-1, -2, -2], flatten(list_transform(list(code ORDER BY pos), lambda o: [o, -2, -2]))) AS ops FROM c GROUP BY conv_id),
d AS (SELECT *, list_reduce(list_transform(ops, lambda o: {{'op': o, 's': [{{'c': CAST(0 AS BIGINT), 'e': ''}}, {{'c': {FAR}, 'e': ''}}, {{'c': {FAR}, 'e': ''}}, {{'c': {FAR}, 'e': ''}}]}}),
    lambda a, x: {{'op': x.op, 's': CASE x.op WHEN -2 THEN [{', '.join(inserted)}] ELSE [{', '.join(row)}] END}}) AS done FROM t),
b AS (SELECT *, list_min([done.s[1], done.s[4]]) AS best FROM d),
e AS (SELECT conv_id, best.e AS audit, len(replace(best.e, 'D', '')) % 2 AS odd, unnest(range(1, len(best.e) + 1)) AS i FROM b),
u AS (SELECT conv_id, i, odd, audit[i] AS edit, len(replace(audit[1:i], 'I', '')) AS pos, len(replace(audit[1:i], 'D', '')) AS out FROM e),
r AS (SELECT u.conv_id, u.i, CASE WHEN edit = 'K' THEN c.role WHEN (out + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE c.text END AS line
  FROM u LEFT JOIN c ON u.conv_id IS NOT DISTINCT FROM c.conv_id AND u.pos = c.pos WHERE edit <> 'D'),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS repaired FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""
