"""Conversation and model analytics: bandits, sessions, load and health of deployments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import relations as r
from .aggregates import count_if

#: Prior means by quality tier.
TIER_MEANS = {1: 0.3, 2: 0.5, 3: 0.7}
MASS = 10.0


def cold_start(models: DataFrame) -> DataFrame:
    """Prior successes and failures: the tier's mean, 0.3 more if the request type is a strength, at most 0.95, of mass 10. Other tiers are an error."""
    means = F.create_map(*[F.lit(x) for pair in TIER_MEANS.items() for x in pair])
    mean = F.least(F.lit(0.95), F.coalesce(F.try_element_at(means, F.col("quality_tier")), F.raise_error(F.lit("unknown quality tier")).cast("double")) + F.when(F.array_contains("strengths", F.col("request_type")), 0.3).otherwise(0.0))
    return models.select("model", "request_type", F.round(mean * MASS, 6).alias("alpha"), F.round((1 - mean) * MASS, 6).alias("beta"))


CELL = ["router", "request_type", "model"]


def fold_bandit(deltas: DataFrame) -> DataFrame:
    """Deltas by cell. A cell that is new to the store then starts from its deltas alone, without a prior."""
    return deltas.groupBy(*CELL).agg(F.sum("delta_alpha").alias("alpha"), F.sum("delta_beta").alias("beta"))


def apply_capped(deltas: DataFrame, cap: float = 200.0) -> DataFrame:
    """Each cell's deltas in their order, leaving out one that would take its total beyond ``cap``.

    The fold is sequential by nature; a cell has few deltas, as queued ones are summed first.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta_alpha", "delta_beta")))
    zero = F.struct(F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(0).alias("dropped"))

    def step(a, x):
        fits = a["alpha"] + a["beta"] + x["delta_alpha"] + x["delta_beta"] <= cap
        return F.struct(
            F.when(fits, a["alpha"] + x["delta_alpha"]).otherwise(a["alpha"]).alias("alpha"),
            F.when(fits, a["beta"] + x["delta_beta"]).otherwise(a["beta"]).alias("beta"),
            F.when(fits, a["dropped"]).otherwise(a["dropped"] + 1).alias("dropped"),
        )

    return deltas.groupBy(*CELL).agg(F.aggregate(ordered, zero, step).alias("f")).select(*CELL, "f.alpha", "f.beta", "f.dropped")


def posterior(cells: DataFrame) -> DataFrame:
    """Each cell's mean, and the whole samples that it has beyond the prior's mass."""
    total = F.col("alpha") + F.col("beta")
    return cells.select(*CELL, F.round(F.when(total > 0, F.col("alpha") / total).otherwise(0.5), 6).alias("mean"), F.greatest(F.lit(0), (total - MASS).cast("int")).alias("samples"))


@F.pandas_udf(DoubleType())
def beta_draw(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    """A draw that depends on the row's own seed alone, so a retried task repeats it."""
    return pd.Series([np.random.default_rng(int(s) & (2**63 - 1)).beta(a, b) for a, b, s in zip(alpha, beta, seed, strict=True)])


def thompson_rank(cells: DataFrame, seed: int) -> DataFrame:
    """The best model of each router and request type by a Beta draw blended with cost (0.7 and 0.3)."""
    drawn = cells.withColumn("draw", beta_draw("alpha", "beta", F.xxhash64(*CELL, F.lit(seed))))
    w = Window.partitionBy("router", "request_type")
    low, high = F.min("cost").over(w), F.max("cost").over(w)
    scaled = F.when(high > low, (F.col("cost") - low) / (high - low)).otherwise(0.5)
    scored = drawn.withColumn("score", 0.7 * F.col("draw") + 0.3 * (1 - scaled))
    return scored.groupBy("router", "request_type").agg(F.max_by("model", F.struct("score", "model")).alias("model"), F.max("score").alias("score"))


SATISFIED = r"\b(thanks|thank you|perfect|great|works)\b"
DISENGAGED = r"\b(never mind|forget it|give up|stop)\b"


def signal_delta(conv: DataFrame, calls: DataFrame, failures: DataFrame, satisfied: str = SATISFIED, disengaged: str = DISENGAGED) -> DataFrame:
    """What a session adds to its model's successes and failures; sessions of under 4 messages are skipped.

    Satisfaction adds a success. Misalignment, stagnation, disengagement and failure add a failure each time, a tool loop half of one.
    """
    long = conv.groupBy("conv_id").agg(F.count("*").alias("messages")).where("messages >= 4")
    flagged = lambda df, c: df.where(F.col(c)).groupBy("conv_id").agg(F.count("*").alias(c))
    loops = r.tool_loops(calls).groupBy(F.col("session_id").alias("conv_id")).agg(F.count("*").alias("loops"))
    left = conv.where((F.col("role") == "user") & F.lower("text").rlike(disengaged)).groupBy("conv_id").agg(F.count("*").alias("disengaged"))
    happy = r.satisfaction_credit(conv, satisfied).select("conv_id", F.lit(1).alias("satisfied"))
    failed = failures.groupBy("conv_id").agg(F.count("*").alias("failed"))
    joined = long
    for part in (flagged(r.misalignment(conv), "misaligned"), flagged(r.stagnation(conv), "stagnant"), loops, left, happy, failed):
        joined = joined.join(part, "conv_id", "left")
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    beta = v("misaligned") + v("stagnant") + v("disengaged") + v("failed") + 0.5 * v("loops")
    return joined.select("conv_id", v("satisfied").cast("double").alias("delta_alpha"), beta.cast("double").alias("delta_beta"))


def session_snapshot(turns: DataFrame) -> DataFrame:
    """The last state of each session, router and model."""
    return turns.groupBy("session_id", "router", "model").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("at"))


def router_sessions(turns: DataFrame) -> DataFrame:
    """By session: turns, cache hits split by whether the model is the same as before, new or returned to, tokens and spend."""
    w = Window.partitionBy("session_id").orderBy("seq")
    seen = F.row_number().over(Window.partitionBy("session_id", "model").orderBy("seq")) > 1
    before = F.lag("model").over(w)
    kind = F.when(F.col("model") == before, "same").when(seen, "return").otherwise("first")
    rows = turns.withColumn("kind", kind)
    hit = F.col("cache_hit") == "True"
    return rows.groupBy("session_id").agg(
        F.count("*").alias("turns"), count_if(hit).alias("hits"),
        *[count_if(hit & (F.col("kind") == k)).alias(f"{k}_hits") for k in ("same", "first", "return")],
        F.sum("tokens").alias("tokens"), F.sum("spend").alias("spend"),
    )


def load_by_minute(log: DataFrame) -> DataFrame:
    """Tokens and requests of each deployment in true minutes, so that days don't collide."""
    return log.groupBy("deployment", F.window("start_time", "1 minute").alias("w")).agg(F.sum("tokens").alias("tpm"), F.count("*").alias("rpm")).select(
        "deployment", F.col("w.start").alias("minute"), "tpm", "rpm"
    )


def least_used(load: DataFrame, limits: DataFrame, tokens: int) -> DataFrame:
    """In each group the deployment of least load that still has room for a request of ``tokens``; idle ones count 0."""
    j = limits.join(load, "deployment", "left").withColumn("tpm", F.coalesce("tpm", F.lit(0))).withColumn("rpm", F.coalesce("rpm", F.lit(0)))
    fits = (F.col("tpm") + tokens <= F.col("tpm_limit")) & (F.col("rpm") + 1 < F.col("rpm_limit"))
    return j.where(fits).groupBy("group").agg(F.min_by("deployment", F.struct("tpm", "deployment")).alias("deployment"))


def unhealthy(states: DataFrame, as_of: str, staleness_s: int) -> DataFrame:
    """Deployments reported unhealthy lately; stale reports count as healthy."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("checked_at").cast("timestamp"))
    return states.where(~F.col("healthy") & (age <= staleness_s))


def cooldowns(failures: DataFrame, as_of: str, default_s: int = 60) -> DataFrame:
    """Deployments that still rest after their last failure, and for how many seconds."""
    until = F.unix_seconds(F.col("failed_at").cast("timestamp")) + F.coalesce("cooldown_s", F.lit(default_s))
    last = failures.groupBy("deployment").agg(F.max(until).alias("until"))
    left = F.col("until") - F.unix_seconds(F.lit(as_of).cast("timestamp"))
    return last.select("deployment", left.alias("seconds_left")).where("seconds_left > 0")


def user_costs(log: DataFrame) -> DataFrame:
    """A user's cost, and by model as ``model=cost`` pairs in order."""
    by_model = log.groupBy("user", "model").agg(F.sum("spend").alias("cost"))
    pair = F.struct("model", "cost")
    return by_model.groupBy("user").agg(F.sum("cost").alias("cost"), F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("model_cost"))


def router_benchmark(turns: DataFrame) -> DataFrame:
    """Each bucket's share of the turns in whole percent, and expired misses as a share of all bucketed turns; null without any."""
    b = turns.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), count_if(F.col("expired")).alias("expired"))
    total = b.agg(F.sum("n").alias("total"), F.sum("expired").alias("all_expired"))
    return b.crossJoin(F.broadcast(total)).select(  # one row
        "bucket", F.round(F.col("n") * 100.0 / F.col("total")).cast("int").alias("percent"),
        F.when(F.col("total") > 0, F.round(F.col("all_expired") * 100.0 / F.col("total"), 4)).alias("expired_percent"),
    )


def bucket(c: Column, edges: list[int]) -> Column:
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(c < e, i).otherwise(out)
    return out
