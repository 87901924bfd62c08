"""Filters, joins, running figures, rankings and set operations over usage tables and conversations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..shared import bytes_in_memory, staged
from .patterns import with_hits

# Filters


def in_window(df: DataFrame, start: str, end: str, column: str = "start_time") -> DataFrame:
    """Rows from the day ``start`` through the day ``end``, UTC."""
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < after))


def optional_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if values else df


def like_literal(text: str) -> str:
    """A LIKE pattern that finds ``text`` anywhere, wildcards taken as they stand."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


MAX_PAGE = 100


def list_page(df: DataFrame, conditions: list[tuple[str, str, object]], sort: str, tie: str, page: int, size: int, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of the rows that meet all conditions (column, operator, value), and their number.

    Operators: in, is_null, gte, lte, contains. At most MAX_PAGE rows a page; ``tie`` settles equal ones.
    """
    tests = {
        "in": lambda c, v: c.isin(*v),
        "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
        "gte": lambda c, v: c >= v,
        "lte": lambda c, v: c <= v,
        "contains": lambda c, v: c.like(like_literal(v)),
    }
    found = reduce(lambda d, x: d.where(tests[x[1]](F.col(x[0]), x[2])), conditions, df)
    size = max(1, min(size, MAX_PAGE))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    rows = found.orderBy(order, tie).offset((max(1, page) - 1) * size).limit(size)
    return rows, found.agg(F.count("*").alias("total"))


def audit_search(audit: DataFrame, equal: dict[str, object], since: str, path: str, needle: str) -> DataFrame:
    """Audit rows by equality and date, whose JSON before or after the change holds ``needle`` at ``path``."""
    found = reduce(lambda d, x: d.where(F.col(x[0]) == x[1]), equal.items(), audit)
    holds = [F.coalesce(F.get_json_object(c, path), F.lit("")).contains(needle) for c in ("before", "after")]
    return found.where(F.col("changed_at") >= F.lit(since).cast("timestamp")).where(holds[0] | holds[1])


def blocked_users(df: DataFrame, blocked: DataFrame, keep: bool = False) -> DataFrame:
    """Rows whose user is not on the list, or is (``keep``); Spark broadcasts the list if it is small."""
    return df.join(blocked.select("user").distinct(), "user", "left_semi" if keep else "left_anti")


def banned_keywords(texts: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """Texts that hold a keyword in lower-cased form; a keyword in capitals therefore never matches.

    Keywords are a short list or a table (word) of any length, all of which are found in one pass over a text.
    """
    if isinstance(words, DataFrame):
        return with_hits(texts.withColumn("__low", F.lower("text")), "__low", {"hits": words}).drop("__low").where(F.size("hits") > 0)
    low = F.lower("text")
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return texts.withColumn("hits", hits).where(F.size("hits") > 0)


def wildcard(pattern: Column) -> Column:
    """A regular expression for a pattern in which * stands for anything, line ends too."""
    escaped = F.regexp_replace(pattern, r"([.\\+?^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(escaped, r"\*", ".*"), F.lit(r"\z"))


def fits_pattern(value: Column, pattern: Column) -> Column:
    """Whether a value fits a pattern; only one with a * before its end is compiled, as it is anew for each row."""
    stars = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    prefix = F.endswith(pattern, F.lit("*")) & (stars == 1)
    return F.when(stars == 0, value == pattern).when(prefix, F.startswith(value, literal_prefix(pattern))).otherwise(F.rlike(value, wildcard(pattern)))


def literal_prefix(pattern: Column) -> Column:
    """What a value must begin with to fit a pattern in which * stands for anything."""
    return F.substring_index(pattern, "*", 1)


def prefixes(value: Column, lengths: list[int]) -> Column:
    """The beginnings of a value that have one of the lengths; of null only the empty one."""
    text = F.coalesce(value, F.lit(""))
    own = [F.when(F.length(text) >= n, F.left(text, F.lit(n))) for n in lengths]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")


def _lengths(keyed: DataFrame) -> dict[str, list[int]]:
    """The lengths of key prefixes in use by column: at most one row for each length that a pattern has."""
    rows = keyed.select("k.c", F.length("k.prefix").alias("n")).distinct().collect()
    return {c: sorted(r.n for r in rows if r.c == c) for c in {r.c for r in rows}}


_CONTEXT, _SCOPE = ("team", "key", "model", "tags"), ("p_team", "p_key", "p_model", "p_tags")
#: A table of at most so many bytes is broadcast to meet contexts or policies; above, both sides are sorted, which spills.
BROADCAST_BYTES = 32 << 20


def meeting(grows: DataFrame, few: DataFrame, on: Column | list[str], size: int | None = None) -> DataFrame:
    """A join in which only ``few`` may be broadcast, by its bytes as measured or known; files, which repeat and compress, can make ``grows`` look small."""
    if (bytes_in_memory(few) if size is None else size) <= BROADCAST_BYTES:
        return grows.join(F.broadcast(few), on)
    return grows.hint("merge").join(few.hint("merge"), on)


def _sound_policies(policies: DataFrame) -> DataFrame:
    tags = F.coalesce("p_tags", F.array().cast("array<string>")).alias("p_tags")
    return policies.select("policy", "p_team", "p_key", "p_model", tags).dropna(subset=["p_team", "p_key", "p_model"])


def _as_asked(contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """Contexts with null in place of what no policy asks for, so that those which no policy tells apart are alike."""
    asked = policies.agg(*[F.max(F.size(p) > 0 if p == "p_tags" else F.col(p) != "*").alias(c) for c, p in zip(_CONTEXT, _SCOPE)]).first()
    return contexts.select(*[F.col(c) if asked[c] else F.lit(None).cast(contexts.schema[c].dataType).alias(c) for c in _CONTEXT], *[c for c in contexts.columns if c == "context_id"])


def _fitting(contexts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each context's columns with those of each scope (p_team, p_key, p_model, p_tags) that it fits."""
    columns, own_columns = ("team", "key", "model"), contexts.columns
    key = lambda c, prefix: F.struct(F.length(prefix).alias("n"), F.lit(c).alias("c"), prefix.alias("prefix"))
    best = F.array_max(F.array(*[key(c, literal_prefix(F.col(f"p_{c}"))) for c in columns]))
    tags = F.array_distinct(F.transform("p_tags", lambda t: key("tag", literal_prefix(t))))
    keyed = scopes.withColumn("__keys", F.when((best["n"] > 0) | (F.size("p_tags") == 0), F.array(best)).otherwise(tags)).withColumn("k", F.explode("__keys"))
    lengths = _lengths(keyed)
    under = lambda c, found: F.transform(found, lambda x: F.struct(F.lit(c).alias("c"), x.alias("prefix")))
    own = [under(c, prefixes(F.col(c), lengths.get(c, []))) for c in columns]
    own.append(under("tag", F.array_distinct(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: prefixes(t, lengths.get("tag", [])))))))
    opened = contexts.select("*", F.explode(F.concat(*own)).alias("o")).select(*own_columns, F.col("o.c").alias("c"), F.col("o.prefix").alias("prefix"))
    met = meeting(opened, keyed.select("*", F.col("k.c").alias("c"), F.col("k.prefix").alias("prefix")).drop("k"), ["c", "prefix"])
    fits = lambda c: F.when(F.col(c).isNull(), F.col(f"p_{c}") == "*").otherwise(fits_pattern(F.col(c), F.col(f"p_{c}")))
    tagged = (F.size("p_tags") == 0) | F.exists("tags", lambda v: F.exists("p_tags", lambda p: fits_pattern(v, p)))
    # A policy with several tags may be met by more than one: the first counts.
    first = F.filter("__keys", lambda k: (k["c"] != "tag") | F.exists("tags", lambda t: F.startswith(t, k["prefix"])))[0]
    return met.where(fits("team") & fits("key") & fits("model") & tagged & (first["prefix"] == F.col("prefix"))).select(*own_columns, *_SCOPE)


def policy_match(contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """Context and policy pairs whose team, key and model fit and, if the policy has tags, one of whose tags does.

    A null value fits only ``*``. Alike contexts are matched once, and so are policies of one scope; the pairs found then meet the contexts and
    the policies on equal keys. Each scope is keyed by the longest literal prefix that its patterns have, or by those of its tags if it names
    no team, key or model; contexts are expanded into their beginnings of the lengths in use and meet the scopes on equal keys, whatever
    their number. What is met is then compared as a whole. The contexts themselves are neither broadcast nor, while the pairs found are few, sorted.
    """
    sound = _sound_policies(policies)
    asked = _as_asked(contexts, sound)
    different = staged(asked.select(*_CONTEXT).distinct(), "contexts")
    found = _fitting(different, sound.select(*_SCOPE).distinct())
    found = meeting(found, sound, list(_SCOPE)).select(*[F.col(c).alias(f"__{c}") for c in _CONTEXT], "policy")
    alike = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _CONTEXT])
    return meeting(asked, found, alike).select("context_id", "policy")


def policy_counts(contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """The number of contexts that each policy fits, as ``policy_match`` pairs them; policies that fit none are left out.

    Alike contexts are counted before they are matched, so the pairs themselves are never made.
    """
    sound = _sound_policies(policies)
    counted = _as_asked(contexts, sound).groupBy(*_CONTEXT).agg(F.count("*").alias("contexts"))
    found = staged(_fitting(counted, sound.select(*_SCOPE).distinct()).groupBy(*_SCOPE).agg(F.sum("contexts").alias("contexts")), "scopes")
    return meeting(sound, found, list(_SCOPE)).groupBy("policy").agg(F.sum("contexts").alias("contexts"))


def policy_condition(df: DataFrame, column: str, condition: str | list[str]) -> DataFrame:
    """Rows whose value is in a list, equals a text, or fully matches it as a regular expression.

    A text that is no valid Java regular expression only matches itself.
    """
    c = F.col(column)
    if isinstance(condition, list):
        return df.where(c.isin(*condition))
    return df.where((c == condition) | c.rlike(f"^(?:{condition})$") if _is_regex(df, condition) else c == condition)


def _is_regex(df: DataFrame, text: str) -> bool:
    """Whether the JVM, which will match it, takes it for a regular expression."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return False
    return True


# Joins


def keys_with_team_limits(keys: DataFrame, teams: DataFrame) -> DataFrame:
    return keys.join(teams.select("team_id", "team_alias", "tpm_limit", "rpm_limit"), "team_id", "left")


def usage_enriched(usage: DataFrame, keys: DataFrame, teams: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Usage with key, team, user and organization; the key's organization comes before its team's."""
    k = keys.select(F.col("token").alias("api_key"), "key_alias", "team_id", F.col("organization_id").alias("key_org"))
    t = teams.select("team_id", "team_alias", F.col("organization_id").alias("team_org"))
    joined = usage.join(k, "api_key", "left").join(t, "team_id", "left").join(users, "user_id", "left")
    joined = joined.withColumn("organization_id", F.coalesce("key_org", "team_org")).drop("key_org", "team_org")
    return joined.join(orgs, "organization_id", "left")


def usage_enriched_basic(usage: DataFrame, keys: DataFrame, teams: DataFrame, users: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        usage = usage.where(F.col("usage_date") >= F.lit(start).cast("date"))
    if end:
        usage = usage.where(F.col("usage_date") <= F.lit(end).cast("date"))
    k = keys.select(F.col("token").alias("api_key"), "key_alias", "team_id")
    t = teams.select("team_id", "team_alias")
    return usage.join(k, "api_key", "left").join(t, "team_id", "left").join(users, "user_id", "left")


def backfill_tool_spend(index: DataFrame, log: DataFrame, existing: DataFrame, cutover: str) -> DataFrame:
    """Daily tool spend up to ``cutover`` for the buckets that don't exist yet."""
    old = log.where(F.col("usage_date") < F.lit(cutover).cast("date")).select("request_id", "usage_date", "spend")
    sums = index.join(old, "request_id").groupBy("usage_date", "tool").agg(F.count("*").alias("requests"), F.sum("spend").alias("spend"))
    return sums.join(existing, ["usage_date", "tool"], "left_anti")


def fill_missing_team(log: DataFrame, keys: DataFrame) -> DataFrame:
    own = keys.select(F.col("token").alias("api_key"), F.col("team_id").alias("key_team"))
    return log.join(own, "api_key", "left").withColumn("team_id", F.coalesce("team_id", "key_team")).drop("key_team")


def tier_price(usage: DataFrame, tiers: DataFrame) -> DataFrame:
    """Every request at the rate of the one tier with start < tokens <= end, of its model's last tier beyond all of them, of none for no tokens.

    Tiers (model, range_start, range_end, rate) meet their model; Spark broadcasts them if they are small.
    """
    within = (F.col("tokens") > F.col("range_start")) & (F.col("tokens") <= F.col("range_end"))
    t = tiers.select(F.col("model").alias("t_model"), "range_start", "range_end", "rate")
    last = tiers.groupBy(F.col("model").alias("l_model")).agg(F.max_by("rate", "range_end").alias("last_rate"))
    joined = usage.join(t, (F.col("model") == F.col("t_model")) & within, "left")
    joined = joined.join(last, F.col("model") == F.col("l_model"), "left")
    rate = F.when(F.col("tokens") > 0, F.coalesce("rate", "last_rate"))
    return joined.select(*usage.columns, rate.alias("rate"), F.round(rate * F.col("tokens"), 6).alias("cost"))


def rerank_pick(results: DataFrame, rerank: DataFrame) -> DataFrame:
    """Each query's results in reranked order; indices out of range vanish."""
    return rerank.join(results, ["query_id", "idx"]).select("query_id", "place", "idx", "text", "relevance")


def resolve_tool_results(messages: DataFrame) -> DataFrame:
    """Tool results with the name of the tool that an earlier assistant turn called; the latest call of an id counts."""
    calls = messages.where("role = 'assistant'").select("conv_id", F.col("turn").alias("call_turn"), F.explode("tool_calls").alias("c"))
    calls = calls.select("conv_id", "call_turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"))
    results = messages.where("role = 'tool'").select("conv_id", "turn", "call_id")
    joined = results.join(calls, ["conv_id", "call_id"], "left").where("call_turn is null or call_turn < turn")
    named = joined.groupBy("conv_id", "turn", "call_id").agg(F.max_by("name", "call_turn").alias("name"))
    return results.join(named, ["conv_id", "turn", "call_id"], "left")


def reconcile_membership(teams: DataFrame, desired: DataFrame) -> DataFrame:
    """Each team's groups after attaching and detaching, and which were attached and detached."""
    want = desired.groupBy("team_id").agg(F.array_sort(F.collect_set("group_id")).alias("want"))
    none = F.array().cast("array<string>")
    both = teams.join(want, "team_id", "full").select(
        "team_id", F.coalesce("groups", none).alias("have"), F.coalesce("want", none).alias("want")
    )
    return both.select(
        "team_id",
        F.array_sort(F.array_union(F.array_intersect("have", "want"), "want")).alias("groups"),
        F.array_sort(F.array_except("want", "have")).alias("attached"),
        F.array_sort(F.array_except("have", "want")).alias("detached"),
    )


def team_emails(teams: DataFrame, users: DataFrame) -> DataFrame:
    """Team members, a JSON array, with their addresses; members without one are left out."""
    members = F.explode(F.from_json("members", "array<struct<user_id:string,role:string>>"))
    listed = teams.select("team_id", members.alias("m")).select("team_id", "m.user_id", "m.role")
    return listed.join(users, "user_id").where("user_email is not null")


def map_models(log: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each model's deployment by the most specific pattern that it begins with, * standing for anything.

    Specific is the pattern whose regular expression is longest, then the one with the most operators in it. What a pattern's
    stars stand for takes the place of the deployment's, in order. Different models, expanded into their beginnings, meet the patterns by literal prefix.
    """
    escaped = F.regexp_replace("pattern", r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r])", r"\\$1")
    p = patterns.withColumn("regex", F.regexp_replace(escaped, r"\\\*", "(.*)"))
    p = p.withColumn("operators", F.regexp_count("regex", F.lit(r"[*+?\\^$|()]"))).withColumn("stars", F.regexp_count("pattern", F.lit(r"\*")))
    p = p.withColumn("k", F.struct(F.lit("model").alias("c"), literal_prefix(F.col("pattern")).alias("prefix")))
    models = log.select("model").distinct().where("model is not null")
    opened = models.withColumn("prefix", F.explode(prefixes(F.col("model"), _lengths(p).get("model", []))))
    fits = opened.join(p.withColumn("prefix", F.col("k.prefix")), "prefix").where(F.rlike(F.col("model"), F.concat(F.lit("^"), "regex")))
    order = F.struct(F.length("regex"), "operators", "pattern")
    best = fits.groupBy("model").agg(F.max_by(F.struct("pattern", "deployment", "regex", "stars"), order).alias("b")).select("model", "b.*")
    parts = F.split(F.regexp_replace("deployment", r"([\\$])", r"\\$1"), r"\*")
    star = lambda i: F.when(i + 1 >= F.size(parts), "").when(i < F.col("stars"), F.concat(F.lit("$"), (i + 1).cast("string"))).otherwise("*")
    template = F.array_join(F.transform(parts, lambda x, i: F.concat(x, star(i))), "")
    mapped = best.select("model", "pattern", F.regexp_replace(F.col("model"), F.concat(F.lit("(?s)^"), "regex", F.lit(".*$")), template).alias("deployment"))
    return log.join(mapped, "model", "left")


# Running figures


def cumulative_savings(daily: DataFrame, drivers: list[str], start: str, anchor: bool = True) -> DataFrame:
    """Running totals from ``start`` on, after an optional row of zeros the day before. One row a day: a single task is enough."""
    rows = daily.where(F.col("usage_date") >= F.lit(start).cast("date")).select("usage_date", *drivers)
    if anchor:
        zero = daily.sparkSession.range(1).select(F.date_sub(F.lit(start).cast("date"), 1).alias("usage_date"), *[F.lit(0).cast(daily.schema[d].dataType).alias(d) for d in drivers])
        rows = zero.unionByName(rows)
    w = Window.orderBy("usage_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("usage_date", *[F.sum(d).over(w).alias(d) for d in drivers])


def protected_turns(conv: DataFrame) -> DataFrame:
    """Turns that compression leaves alone: all system ones, the last user's and the last assistant's."""
    last = F.max("turn").over(Window.partitionBy("conv_id", "role"))
    kept = (F.col("role") == "system") | (F.col("role").isin("user", "assistant") & (F.col("turn") == last))
    return conv.withColumn("protected", kept)


_SUFFIX = re.compile(r"(.*)_([1-9][0-9]*)\Z", re.S)


class UsedNames:
    """Gives each name, in order, a form that no earlier one has: itself, or the first free of name_2, name_3, …

    Kept is only where each different name goes on: all its numbers below are taken.
    """

    def __init__(self):
        self.next: dict[str, int] = {}

    def taken(self, name: str) -> bool:
        if name in self.next:
            return True
        parts = _SUFFIX.match(name)
        return parts is not None and 2 <= int(parts[2]) < self.next.get(parts[1], 0)

    def give(self, name: str) -> str:
        if not self.taken(name):
            self.next[name] = 2
            return name
        n = self.next.get(name, 2)
        while self.taken(f"{name}_{n}"):
            n += 1
        self.next[name] = n + 1
        return f"{name}_{n}"


def dedupe_names(df: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """``unique_name``: the name, or with the first suffix _2, _3, … that no earlier row of its ``by`` has taken, in the order of ``order`` and then the name.

    Names that could meet have one stem, the name without any numbers at its end; a fold goes over the rows of each ``by`` and stem as Spark
    has sorted them and holds their different names only. A null name stays null.
    """
    stem = F.regexp_replace(name, r"(?s)(_[1-9][0-9]*)+\z", "")
    ordered = df.withColumn("__stem", stem).repartition(F.col(by), "__stem").sortWithinPartitions(by, "__stem", order, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, UsedNames()
        for batch in batches:
            out = []
            for key in zip(batch[by].to_pylist(), batch["__stem"].to_pylist(), batch[name].to_pylist()):
                if now != key[:2]:
                    now, used = key[:2], UsedNames()
                out.append(None if key[2] is None else used.give(key[2]))
            kept = [c for c in batch.schema.names if c != "__stem"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(out, pa.string())], [*kept, "unique_name"])

    return ordered.mapInArrow(run, StructType([*df.schema.fields]).add("unique_name", StringType()))


def running_sum(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over a row and those before it in ``order``, within ``by``; order is unique there.

    In two levels, so that one key may hold most rows: rows are dealt into ranges of (by, order), each range's sums are added up over the ranges
    before it, and what comes before a range is added to the running sum inside.
    """
    ranged = staged(df.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "running-sum")
    totals = ranged.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__of")).agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__by", "__of", F.coalesce(before, F.lit(0)).alias("__before"))  # a row for each key and range that holds it
    joined = ranged.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    inside = F.sum(value).over(Window.partitionBy("__range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, inside + F.col("__before")).select(*df.columns, name)


def in_flight(log: DataFrame) -> DataFrame:
    """Requests under way at each start and end, by deployment; at one instant ends come before starts."""
    at = F.struct(F.col("start_time").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("d"))
    moves = log.select("deployment", F.explode(F.array(*at)).alias("e")).select("deployment", "e.*")
    moves = moves.groupBy("deployment", "at", "d").agg(F.sum("d").alias("change"))
    return running_sum(moves, "deployment", ["at", "d"], "change", "in_flight").select("deployment", "at", "change", "in_flight")


def counter_delta(samples: DataFrame) -> DataFrame:
    """A cumulative metric's increase since the sample before; after a reset all of it counts."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("usage_date"))
    return samples.withColumn("increase", F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def word_set(c: Column) -> Column:
    """The different lower-cased words of letters a-z, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def repeated_turns(conv: DataFrame, role: str, threshold: float, name: str) -> DataFrame:
    """A role's turns, flagged as ``name`` if their words are those of its turn before to at least ``threshold``."""
    words = conv.where(F.col("role") == role).select("conv_id", "turn", word_set(F.col("text")).alias("words"))
    before = F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))
    likeness = F.coalesce(jaccard(F.col("words"), F.col("before")), F.lit(0.0))
    return words.withColumn("before", before).select("conv_id", "turn", (likeness >= threshold).alias(name))


def misalignment(conv: DataFrame, threshold: float = 0.45) -> DataFrame:
    return repeated_turns(conv, "user", threshold, "misaligned")


def stagnation(conv: DataFrame, threshold: float = 0.50) -> DataFrame:
    return repeated_turns(conv, "assistant", threshold, "stagnant")


def tool_loops(calls: DataFrame, times: int = 3) -> DataFrame:
    """Runs of at least ``times`` calls of one tool in a row, by session."""
    session = Window.partitionBy("session_id").orderBy("seq")
    same = Window.partitionBy("session_id", "tool").orderBy("seq")
    island = F.row_number().over(session) - F.row_number().over(same)
    runs = calls.withColumn("island", island).groupBy("session_id", "tool", "island")
    return runs.agg(F.min("seq").alias("first_seq"), F.count("*").alias("calls")).where(F.col("calls") >= times).drop("island")


def satisfaction_credit(conv: DataFrame, pattern: str, min_turns: int = 3) -> DataFrame:
    """The one turn of a session that is credited: its first satisfied user turn, not before ``min_turns``."""
    said = conv.where(F.col("role") == "user").where(F.lower("text").rlike(pattern)).where(F.col("turn") >= min_turns)
    return said.groupBy("conv_id").agg(F.min("turn").alias("credited_turn"))


# Rankings


def top_tools(daily: DataFrame, n: int = 8) -> DataFrame:
    return daily.groupBy("tool").agg(F.sum("spend").alias("spend")).orderBy(F.desc("spend"), "tool").limit(n)


def tool_series(daily: DataFrame, tools: list[str]) -> DataFrame:
    """A column for each tool, a row for each day with at least one of them, 0 where a tool has none."""
    rows = daily.where(F.col("tool").isin(*tools)).groupBy("usage_date").pivot("tool", tools).agg(F.sum("spend"))
    return rows.na.fill(0)


def top_routes(counts: DataFrame, n: int = 15) -> DataFrame:
    label = F.when(F.col("category") == "llm", F.col("route")).otherwise(F.concat_ws(": ", "category", "route"))
    sums = counts.groupBy(label.alias("route")).agg(F.sum(F.col("successful_requests") + F.col("failed_requests")).alias("requests"))
    return sums.orderBy(F.desc("requests"), "route").limit(n)


def top_scored(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# Sets


def entity_scope(requested: DataFrame, supported: list[str]) -> DataFrame:
    """The supported ones of the entities asked for; all if none is asked for."""
    all_ = F.array(*[F.lit(s) for s in supported])
    asked = F.coalesce("entities", F.array().cast("array<string>"))
    return requested.withColumn("scope", F.when(F.size(asked) == 0, all_).otherwise(F.array_intersect(all_, asked)))


ORIGINS = {"annotation": 3, "rule": 2, "model": 1}


def origin_rank(c: Column) -> Column:
    return reduce(lambda a, x: a.when(c == x[0], x[1]), list(ORIGINS.items())[1:], F.when(c == "annotation", ORIGINS["annotation"])).otherwise(0)


def canonical_spans(spans: DataFrame) -> DataFrame:
    """Equal spans become one, with the highest origin."""
    best = F.max_by("origin", F.struct(origin_rank(F.col("origin")), "origin"))
    return spans.groupBy("doc_id", "start", "end", "cls").agg(best.alias("origin"))


def membership_changes(have: DataFrame, want: DataFrame) -> DataFrame:
    """(team_id, group_id) pairs to attach and to detach."""
    attach = want.exceptAll(have).withColumn("change", F.lit("attach"))
    return attach.unionByName(have.exceptAll(want).withColumn("change", F.lit("detach")))
