"""Pricing the usage log. Prices are a table of models, whose size Spark checks before it broadcasts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_tokens(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by token kind. Cache rates default to the input rate, the reasoning rate to the output rate."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = log.join(prices, "model", "left")
    text = F.greatest(F.col("prompt_tokens") - zero("cached_tokens") - zero("cache_write_tokens"), F.lit(0))
    rate_in = zero("input_rate")
    prompt = text * rate_in + zero("cached_tokens") * F.coalesce("cache_read_rate", rate_in) + zero("cache_write_tokens") * F.coalesce("cache_write_rate", rate_in)
    spoken = F.greatest(F.col("completion_tokens") - zero("reasoning_tokens"), F.lit(0))
    output = spoken * zero("output_rate") + zero("reasoning_tokens") * F.coalesce(F.col("reasoning_rate"), zero("output_rate"))
    return j.select(*log.columns, F.round(prompt, 9).alias("prompt_cost"), F.round(output, 9).alias("completion_cost"))


def price_tiered(log: DataFrame, tiers: DataFrame, rates: DataFrame) -> DataFrame:
    """The whole request at the rates of the tier that its prompt falls into; output falls back to the model's rate."""
    t = tiers.select(F.col("model").alias("t_model"), "range_start", "range_end", "input_rate", "output_rate")
    last = tiers.groupBy(F.col("model").alias("l_model")).agg(F.max_by(F.struct("input_rate", "output_rate"), "range_end").alias("last"))
    within = (F.col("model") == F.col("t_model")) & (F.col("prompt_tokens") > F.col("range_start")) & (F.col("prompt_tokens") <= F.col("range_end"))
    j = log.join(t, within, "left").join(last, F.col("model") == F.col("l_model"), "left")
    j = j.join(rates.select("model", F.col("output_rate").alias("model_output")), "model", "left")
    found = F.col("t_model").isNotNull()
    pick = lambda c: F.when(F.col("prompt_tokens") > 0, F.when(found, F.col(c)).otherwise(F.col(f"last.{c}")))
    cost = F.col("prompt_tokens") * pick("input_rate") + F.col("completion_tokens") * F.coalesce(pick("output_rate"), F.col("model_output"))
    return j.select(*log.columns, F.round(cost, 9).alias("cost"))


def apply_multipliers(text_cost: Column, cache_cost: Column, speed: Column, region: Column) -> Column:
    """Speed makes all but cache costs dearer, the region everything."""
    return (text_cost * F.coalesce(speed, F.lit(1.0)) + cache_cost) * F.coalesce(region, F.lit(1.0))


def search_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cost = zero("searches") * zero("search_fee") + zero("citation_tokens") * zero("citation_rate")
    return log.join(prices, "model", "left").select(*log.columns, F.round(cost, 9).alias("search_cost"))


def price_seconds(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Speech by the second: what is made at the output rate, what is heard at the input rate."""
    rate = F.when(F.col("call_type") == "speech", F.col("output_per_second")).otherwise(F.col("input_per_second"))
    return log.join(prices, "model", "left").select(*log.columns, F.round(F.col("seconds") * F.coalesce(rate, F.lit(0.0)), 9).alias("cost"))


def price_class(model: Column) -> Column:
    """A size bracket from a model's name: billions of parameters, experts multiplied, or an embedding model's millions."""
    name = F.lower(model)
    experts = F.regexp_extract(name, r"(\d+)x(\d+(?:\.\d+)?)b", 1).try_cast("double") * F.regexp_extract(name, r"(\d+)x(\d+(?:\.\d+)?)b", 2).try_cast("double")
    size = F.coalesce(experts, F.regexp_extract(name, r"(\d+(?:\.\d+)?)b\b", 1).try_cast("double"))
    small = F.regexp_extract(name, r"(\d+)m\b", 1).try_cast("double")
    bracket = F.when(size <= 4, "up-to-4b").when(size <= 8, "4.1b-8b").when(size <= 21, "8.1b-21b").when(size <= 41, "21.1b-41b").when(size <= 80, "41.1b-80b")
    bracket = bracket.when(size <= 110, "80.1b-110b").when(size > 110, "over-110b")
    return F.coalesce(bracket, F.when(small <= 150, "embedding-up-to-150m").when(small > 150, "embedding-over-150m"), F.lit("unknown"))


def reported_cost_first(reported: Column, computed: Column) -> Column:
    return F.coalesce(reported, computed)


def cost_estimate(scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by request, day and month (30 days), with the provider's margin, a percentage and a fixed amount, apart."""
    j = scenarios.join(prices, "model")
    cost = F.col("prompt_tokens") * F.col("input_rate") + F.col("completion_tokens") * F.col("output_rate")
    margin = cost * F.coalesce("margin_share", F.lit(0.0)) + F.coalesce("margin_fixed", F.lit(0.0))
    whole = cost + margin
    return j.select(
        "scenario", F.round(cost, 9).alias("base_cost"), F.round(margin, 9).alias("margin"), F.round(whole, 9).alias("per_request"),
        F.round(whole * F.col("requests_per_day"), 9).alias("per_day"), F.round(whole * F.col("requests_per_day") * 30, 9).alias("per_month"),
    )
