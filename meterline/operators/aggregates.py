"""Usage aggregates. Money is decimal, so sums don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def last_days(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on, as a predicate that prunes date partitions."""
    return log.where(F.col("usage_date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def spend_by_day(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return last_days(log, as_of, days).groupBy("usage_date").agg(F.sum("spend").alias("spend"))


def top_keys(log: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """Spend by key with its alias, the greatest first; summed before the join."""
    spend = last_days(log, as_of).groupBy("api_key").agg(F.sum("spend").alias("spend"))
    named = keys.select(F.col("token").alias("api_key"), "key_alias")
    return spend.join(named, "api_key", "left").orderBy(F.desc("spend"), "api_key")


def top_models(log: DataFrame, as_of: str) -> DataFrame:
    named = last_days(log, as_of).where("model <> ''")
    return named.groupBy("model").agg(F.sum("spend").alias("spend")).orderBy(F.desc("spend"), "model")


def spend_by_day_key(log: DataFrame, as_of: str) -> DataFrame:
    return last_days(log, as_of).groupBy("usage_date", "api_key").agg(F.sum("spend").alias("spend"))


def spend_by_day_user_key(log: DataFrame, as_of: str) -> DataFrame:
    return last_days(log, as_of).groupBy("usage_date", "user", "api_key").agg(F.sum("spend").alias("spend"))


def daily_tag_spend(log: DataFrame) -> DataFrame:
    """A request's spend counts once for each of its tags; untagged requests vanish."""
    tagged = log.select("usage_date", "spend", F.explode("request_tags").alias("tag"))
    return tagged.groupBy("tag", "usage_date").agg(F.count("*").alias("log_count"), F.sum("spend").alias("spend"))


def top_end_users(log: DataFrame, n: int = 100) -> DataFrame:
    """End users other than the request's own user, by number of requests."""
    ours = log.where("end_user <> '' and end_user <> user")
    return (
        ours.groupBy("end_user")
        .agg(F.count("*").alias("requests"), F.sum("spend").alias("spend"))
        .orderBy(F.desc("spend"), "end_user")
        .limit(n)
    )


def cache_activity(log: DataFrame) -> DataFrame:
    """Requests, hits, failures and tokens by call type.

    Requests are all less hits less failures, so a cached failure is subtracted twice.
    """
    hit, failed = F.col("cache_hit") == "True", F.col("status") == "failure"
    tokens = lambda condition: F.sum(F.when(condition, F.col("completion_tokens")).otherwise(0))
    return log.groupBy(F.when(F.col("call_type") == "", "Unknown").otherwise(F.col("call_type")).alias("call_type")).agg(
        (F.count("*") - count_if(hit) - count_if(failed)).alias("api_requests"),
        count_if(hit).alias("cache_hits"),
        count_if(failed).alias("failed_requests"),
        tokens(hit).alias("cached_completion_tokens"),
        tokens(~hit).alias("generated_completion_tokens"),
    )


def cache_totals(groups: DataFrame) -> DataFrame:
    """Totals over ``cache_activity``; the hit ratio in percent is 0 for no requests."""
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in groups.columns if c != "call_type"])
    all_ = F.col("api_requests") + F.col("cache_hits")
    return total.withColumn("hit_ratio", F.when(all_ > 0, F.round(F.col("cache_hits") * 100.0 / all_, 6)).otherwise(0.0))


def filter_options(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The values a report can be filtered by: key aliases and models."""
    alias = F.coalesce("key_alias", F.lit("Unnamed Key")).alias("value")
    used = log.select("api_key").distinct()
    aliases = used.join(keys, used.api_key == keys.token).select(F.lit("key_alias").alias("kind"), alias).distinct()
    models = log.where("model <> ''").select(F.lit("model").alias("kind"), F.col("model").alias("value")).distinct()
    return aliases.union(models)


def gateway_activity(log: DataFrame) -> DataFrame:
    """Successes and failures in total, by date and by route, in one pass."""
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return (
        log.groupingSets([["usage_date"], ["category", "route"], []], "usage_date", "category", "route")
        .agg(count_if(ok).alias("successes"), count_if(~ok).alias("failures"), F.grouping_id().alias("level"))
    )


def count_requests(log: DataFrame) -> DataFrame:
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return log.groupBy("usage_date", "category", "route").agg(
        count_if(ok).alias("successful_requests"), count_if(~ok).alias("failed_requests")
    )


COUNTERS = ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_creation_tokens",
            "api_requests", "successful_requests", "failed_requests")


ROLLUP_COUNTERS = (*COUNTERS, "compression_saved_tokens")
ROLLUP_MONEY = ("spend", "compression_savings_spend", "prompt_caching_savings_spend", "autorouter_savings_spend")


def daily_rollup(deltas: DataFrame, entity: str) -> DataFrame:
    """Counters and money by day, entity, key, model, provider, tool and endpoint; null and '' members are one, an absent counter or amount counts 0.

    ``model_group`` is that of the first row by order_key and line.
    """
    by = ["usage_date", entity, "api_key", "model", "provider", "mcp_namespaced_tool_name", "endpoint"]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in by[1:]]
    return deltas.groupBy("usage_date", *texts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*ROLLUP_COUNTERS, *ROLLUP_MONEY)],
        F.min_by("model_group", F.struct("order_key", "line")).alias("model_group"),
    )


def fold_deltas(deltas: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Queued deltas by key; an absent metric counts 0."""
    return deltas.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in metrics])


ENTITIES = ("user", "key", "team", "team_member", "org", "end_user", "tag", "agent")


def entity_spend(updates: DataFrame) -> DataFrame:
    """Total by entity (entity_type, entity_id, amount); unknown types are skipped."""
    known = updates.where(F.col("entity_type").isin(*ENTITIES))
    return known.groupBy("entity_type", "entity_id").agg(F.sum("amount").alias("amount"))


def tool_spend(log: DataFrame) -> DataFrame:
    """Each of a request's distinct tools gets the request's full spend."""
    used = log.select("usage_date", "spend", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
                      F.explode(F.array_distinct("tools")).alias("tool"))
    return used.groupBy("usage_date", "tool").agg(
        F.count("*").alias("requests"), F.sum("spend").alias("spend"), F.sum("tokens").alias("tokens")
    )


def guardrail_daily(checks: DataFrame) -> DataFrame:
    """Outcomes by guardrail and day; sums and counts are kept so that averages can be merged."""
    of = lambda a: count_if(F.col("action") == a).alias(a)
    return checks.groupBy("guardrail", "usage_date").agg(
        F.count("*").alias("evaluated"), of("passed"), of("blocked"), of("flagged"),
        F.round(F.sum("score") / F.count("score"), 6).alias("avg_score"),
        F.round(F.sum("latency_ms") / F.count("latency_ms"), 6).alias("avg_latency_ms"),
    )


def guardrail_units(log: DataFrame) -> DataFrame:
    """Units by guardrail, day, team, key and unit, from a map of units for each request."""
    opened = log.select("guardrail", "usage_date", "team_id", "api_key", F.explode("units").alias("unit", "n"))
    return opened.groupBy("guardrail", "usage_date", "team_id", "api_key", "unit").agg(F.sum("n").alias("units"))


def guardrail_cost(units: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by guardrail: the region's price, else the default one, else 0; costs of 0 or less, NaN and infinity count 0."""
    regional = prices.where("region is not null").select("unit", "region", F.col("price").alias("regional"))
    default = prices.where("region is null").select("unit", F.col("price").alias("default"))
    priced = units.join(regional, ["unit", "region"], "left").join(default, "unit", "left")
    cost = F.col("units") * F.coalesce("regional", "default", F.lit(0.0))
    sound = F.when(~F.isnan(cost) & (cost > 0) & (cost < float("inf")), cost).otherwise(0.0)
    return priced.groupBy("guardrail").agg(F.round(F.sum(sound), 6).alias("cost"))


def compression_saved(meta: DataFrame) -> DataFrame:
    """Tokens saved by the request's own compression and by its guardrail entries; wrong shapes and negatives are 0.

    ``metadata`` is JSON; a bare object in place of the list of entries is one entry.
    """
    whole = F.try_parse_json("metadata")
    number = lambda v, path: F.when(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin("BIGINT", "INT"),
        F.greatest(F.lit(0), F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0))),
    ).otherwise(0)
    info = F.try_variant_get(whole, "$.guardrail_information", "variant")
    listed = F.try_variant_get(whole, "$.guardrail_information", "array<variant>")
    entries = F.coalesce(listed, F.when(info.isNotNull(), F.array(info)), F.array().cast("array<variant>"))
    saved = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + number(e, "$.tokens_saved"))
    return meta.select("request_id", (number(whole, "$.compression_savings.tokens_saved") + saved).alias("tokens_saved"))


def provider_spend(rollup: DataFrame) -> DataFrame:
    sums = rollup.groupBy("provider").agg(
        F.sum("spend").alias("spend"), F.sum("api_requests").alias("requests"), F.sum("successful_requests").alias("successful")
    )
    return sums.where("spend > 0")


def top_entities(rollup: DataFrame, dim: str, n: int = 5) -> DataFrame:
    sums = rollup.groupBy(dim).agg(F.sum("spend").alias("spend"), F.sum("api_requests").alias("requests"))
    return sums.orderBy(F.desc("spend"), dim).limit(n)


def top_keys_with_tags(tagged: DataFrame, n: int = 5) -> DataFrame:
    """The keys of most spend, each with its tags of the first day on which it appears."""
    daily = tagged.groupBy("api_key", "usage_date").agg(
        F.sum("spend").alias("spend"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags")
    )
    keys = daily.groupBy("api_key").agg(F.sum("spend").alias("spend"), F.min_by("tags", "usage_date").alias("tags"))
    return keys.orderBy(F.desc("spend"), "api_key").limit(n)


def endpoint_usage(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("endpoint").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.sum("spend").alias("spend"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def cache_leakage(rollup: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """Prompt tokens that no cache served, by ``dim``, ranked by what caching them might have saved.

    The fleet's net rate is its caching savings for each token that was read from or written to a cache. Unless it is positive
    there is no saving to extrapolate from: savings are null, and tokens rank.
    """
    columns = ("prompt_tokens", "cache_read_tokens", "cache_creation_tokens", "caching_savings")
    sums = rollup.groupBy(dim).agg(*[F.sum(c).alias(c) for c in columns])
    cached = F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    fleet = sums.agg(F.try_divide(F.sum("caching_savings").cast("double"), F.sum(cached)).alias("net_rate"))
    uncached = F.greatest(F.lit(0), F.col("prompt_tokens") - cached)
    ratio = F.when(F.col("prompt_tokens") > 0, F.round(F.col("cache_read_tokens") / F.col("prompt_tokens"), 6)).otherwise(0.0)
    priced = sums.withColumn("uncached", uncached).where("uncached > 0").crossJoin(F.broadcast(fleet))  # one row
    saving = F.when(F.col("net_rate") > 0, F.round(F.col("uncached") * F.col("net_rate"), 6))
    ranked = priced.select(dim, "uncached", ratio.alias("hit_ratio"), saving.alias("savings"))
    return ranked.orderBy(F.coalesce("savings", F.col("uncached").cast("double")).desc(), dim).limit(n)


def squash_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("url", "type").agg(F.count("*").alias("n"), F.min_by("message", "seq").alias("message"))


def compliance(entries: DataFrame) -> DataFrame:
    """Checks on each request's guardrail entry, and whether all passed."""
    checks = {
        "guardrail_applied": F.col("guardrail").isNotNull(),
        "screened_before_call": F.col("mode") == "pre_call",
        "audit_complete": F.col("user").isNotNull() & (F.col("user") != "") & F.col("model").isNotNull() & (F.col("model") != ""),
        "sensitive_data_protected": (F.col("sensitive") == 0) | F.col("action").isin("blocked", "masked"),
    }
    checked = entries.select("request_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return checked.withColumn("compliant", passed)


def deprecations(models: DataFrame, dates: DataFrame, as_of: str, warn_days: int = 30) -> DataFrame:
    """When each model ends: its own date, else its base model's, else its name's, else its name's without the provider."""
    at = lambda name, by: dates.select(F.col("name").alias(by), F.col("date").alias(name))
    bare = F.element_at(F.split("model", "/"), -1)
    joined = (
        models.withColumn("bare", bare)
        .join(at("d1", "base_model"), "base_model", "left")
        .join(at("d2", "model"), "model", "left")
        .join(at("d3", "bare"), "bare", "left")
    )
    date = F.coalesce(F.col("override").cast("date"), "d1", "d2", "d3")
    days = F.datediff("date", F.lit(as_of).cast("date"))
    state = F.when(days <= 0, "deprecated").when(days <= warn_days, "imminent").otherwise("upcoming")
    found = joined.withColumn("date", date).where("date is not null")
    return found.select(F.col("model").alias("name"), "date", state.alias("state")).dropDuplicates(["name", "date"])


def shadow_eval(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("job", "tier", "outcome").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum("judge_cost").alias("judge_cost")
    )


def savings_baseline(prices: DataFrame) -> DataFrame:
    """The model that costs most on a fixed request: 20,000 prompt tokens, 19,000 of them cached, 1,000 written to the cache, 1,000 out."""
    cost = (
        F.col("cache_read") * 19_000 + F.col("cache_write") * 1_000 + F.col("output") * 1_000
        + F.col("input") * F.greatest(F.lit(0), F.lit(20_000 - 19_000 - 1_000))
    )
    return prices.withColumn("cost", F.round(cost, 6)).where("cost > 0").agg(
        F.max_by("model", F.struct("cost", "model")).alias("model"), F.max("cost").alias("cost")
    )


def export_summary(rows: DataFrame) -> DataFrame:
    """Rows, totals and different teams and models; null counts as one more value."""
    distinct = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.sum("spend").alias("spend"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        distinct("team_id").alias("teams"), distinct("model").alias("models"),
    )


def model_latency(log: DataFrame) -> DataFrame:
    """Requests, spend an hour, tokens a minute and exact 95th percentiles of duration, by model and hour."""
    hour = F.date_trunc("hour", "start_time").alias("hour")
    return log.where("model <> ''").groupBy("model", hour).agg(
        F.count("*").alias("requests"), F.sum("spend").alias("spend"),
        F.round(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")) / 60, 6).alias("tokens_per_minute"),
        F.round(F.percentile("seconds", F.lit(0.95)), 6).alias("p95_seconds"),
    )


def pii_outcomes(events: DataFrame) -> DataFrame:
    """Outcomes by surface and direction, and how many values were tokenized and masked."""
    kinds = ["applied", "blocked", "failed", "unscanned"]
    counts = events.groupBy("surface", "direction").pivot("outcome", kinds).count().na.fill(0, kinds)
    sums = events.groupBy("surface", "direction").agg(F.sum("tokenized").alias("tokenized"), F.sum("masked").alias("masked"))
    return counts.join(sums, ["surface", "direction"])
