"""Row-wise functions: billing projections, budgets, text and JSON helpers, checksums, masks."""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, StringType

MONEY = DecimalType(18, 6)
DAY = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Billing projections


def tags_json(*names: str) -> Column:
    """The columns that aren't null, as JSON with text values."""
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]))


def focus_export(usage: DataFrame) -> DataFrame:
    """The 44-column billing projection. A day becomes the period from midnight to midnight, an unreadable one null; money is Decimal(18,6), missing spend 0."""
    start = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    begin, end = (F.date_format(start + F.make_dt_interval(F.lit(days)), DAY) for days in (0, 1))
    spend = F.coalesce(F.col("spend").cast(MONEY), F.lit(0).cast(MONEY))
    requests = F.coalesce(F.col("api_requests").cast("long"), F.lit(0)).cast(MONEY)
    text, money = F.lit(None).cast("string"), F.lit(None).cast(MONEY)
    # The columns' names and the constants among them.
    columns = {
        "BilledCost": spend, "BillingAccountId": F.col("api_key"), "BillingAccountName": F.col("api_key_alias"), "BillingAccountType": F.lit("API Key"),
        "BillingCurrency": F.lit("USD"), "BillingPeriodEnd": end, "BillingPeriodStart": begin, "ChargeCategory": F.lit("Usage"), "ChargeClass": text,
        "ChargeDescription": F.col("model"), "ChargeFrequency": F.lit("Usage-Based"), "ChargePeriodEnd": end, "ChargePeriodStart": begin,
        "ConsumedQuantity": requests, "ConsumedUnit": F.lit("Requests"), "ContractedCost": spend, "ContractedUnitPrice": text, "EffectiveCost": spend,
        "InvoiceIssuerName": F.col("provider"), "InvoiceId": text, "ListCost": spend, "ListUnitPrice": money, "AvailabilityZone": text,
        "PricingCurrency": F.lit("USD"), "PricingCategory": text, "PricingQuantity": requests, "PricingCurrencyContractedUnitPrice": money,
        "PricingCurrencyEffectiveCost": spend, "PricingCurrencyListUnitPrice": money, "PricingUnit": F.lit("Requests"), "ProviderName": F.col("provider"),
        "PublisherName": F.col("provider"), "RegionId": text, "RegionName": text, "ResourceId": F.col("model"), "ResourceName": F.col("model"),
        "ResourceType": F.col("model"), "ServiceCategory": F.lit("AI and Machine Learning"), "ServiceSubcategory": F.lit("Generative AI"),
        "ServiceName": F.col("model_group"), "SubAccountId": F.col("team_id"), "SubAccountName": F.col("team_alias"), "SubAccountType": text,
        "Tags": tags_json("team_id", "team_alias", "user_id", "user_email", "api_key_alias", "model", "model_group", "provider", "api_key", "date"),
    }
    return usage.select(*[c.alias(n) for n, c in columns.items()])


#: Provider names that stand for another.
PROVIDERS = {
    "azure": "azure", "azure_ai": "azure", "anthropic": "anthropic", "bedrock": "aws", "vertex_ai": "gcp", "gemini": "google",
    "cohere": "cohere", "huggingface": "huggingface", "replicate": "replicate", "together_ai": "together-ai",
}
REGION, RESOURCE_KIND = "cross-region", "llm-usage"


def resource_part(c: Column) -> Column:
    """Lower-case letters, digits and single hyphens; nothing left becomes ``unknown``."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(clean == "", "unknown").otherwise(clean)


def resource_name(provider: Column, account: Column, model: Column, service: str = "gateway") -> Column:
    """czrn:service:provider:region:account:kind:model; null without a provider or model, for which there is no valid name.

    Underscores turn to hyphens before the alias lookup, so aliases with an underscore never match. The model stays as it is.
    """
    hyphened = F.replace(F.lower(provider), F.lit("_"), F.lit("-"))
    known = F.create_map(*[F.lit(x) for pair in PROVIDERS.items() for x in pair])
    name = F.concat_ws(":", F.lit("czrn"), F.lit(service), resource_part(F.coalesce(F.try_element_at(known, hyphened), hyphened)), F.lit(REGION), resource_part(account), F.lit(RESOURCE_KIND), model)
    return F.when(provider.isNotNull() & (model != ""), name)


def cbf_export(usage: DataFrame) -> DataFrame:
    """Cost-billing rows for usage with successful requests and a valid resource name; tags without meaning are left out."""
    tags = F.create_map(*[x for n in ("model", "user_id", "team_alias", "key_alias") for x in (F.lit(n), F.col(n).cast("string"))])
    meaningful = F.map_filter(tags, lambda _, v: v.isNotNull() & ~F.lower(v).isin("", "n/a", "none", "null", "unknown"))
    name = resource_name(F.col("provider"), F.col("team_id"), F.col("model"))
    return usage.where((F.col("successful_requests") > 0) & name.isNotNull()).select(
        F.date_format(F.col("usage_date").cast("timestamp"), DAY).alias("usage_start"),
        F.coalesce("spend", F.lit(0)).cast(MONEY).alias("cost"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("usage_amount"),
        name.alias("resource_id"), F.lit("Usage").alias("line_item_type"), meaningful.alias("tags"),
    )


def billing_events(log: DataFrame, charge_by: str) -> DataFrame:
    """A metering event for each request, charged to its end user, user or team; without one it is an error row."""
    column = {"end_user_id": "end_user", "user_id": "user", "team_id": "team_id"}[charge_by]
    who = F.when(F.col(column) != "", F.col(column))
    return log.select(
        F.col("request_id").alias("transaction_id"), who.alias("external_customer_id"), F.lit("request_cost").alias("code"),
        F.col("spend").alias("cost"), F.col("model"), F.when(who.isNull(), f"{charge_by} is missing").alias("error"),
    )


def meter_events(log: DataFrame, trust_user: bool) -> DataFrame:
    """Events in the CloudEvents shape. The subject is the user if it is trusted, else the key's team, else ``unknown``."""
    user = F.when(F.col("user") != "", F.col("user")) if trust_user else F.lit(None).cast("string")
    data = F.to_json(F.struct("model", F.col("spend").cast("double").alias("cost"), "prompt_tokens", "completion_tokens"))
    return log.select(
        F.lit("1.0").alias("specversion"), F.lit("model.request").alias("type"), F.col("request_id").alias("id"),
        F.date_format(F.col("start_time").cast("timestamp"), DAY).alias("time"), F.coalesce(user, "team_id", F.lit("unknown")).alias("subject"), data.alias("data"),
    )


# Budgets


def month_end_projection(df: DataFrame) -> DataFrame:
    """Projected spend and the day on which the limit is exceeded, from as_of, current_spend and soft_limit.

    A day's spend is that of the days before, on the first that of the day itself. Within the limit, or without one, both are null.
    """
    day, left = F.dayofmonth("as_of"), F.datediff(F.last_day("as_of"), F.col("as_of"))
    daily = F.when(day == 1, F.col("current_spend")).otherwise(F.col("current_spend") / (day - 1))
    projected = F.col("current_spend") + daily * left
    over = projected > F.col("soft_limit")
    until = F.when(F.col("current_spend") > F.col("soft_limit"), 0).otherwise(
        F.floor(F.try_divide(F.col("soft_limit") - F.col("current_spend"), daily)).cast("int")
    )
    return df.withColumn("projected_spend", F.when(over, F.round(projected, 6))).withColumn("exceed_date", F.when(over, F.date_add("as_of", until)))


DURATIONS = {"daily": 86_400, "weekly": 604_800, "monthly": 2_592_000, "yearly": 31_536_000}


def budget_window(users: DataFrame, now: str) -> DataFrame:
    """Costs start at 0 again when the budget is at least as old as its duration."""
    seconds = F.create_map(*[F.lit(x) for pair in DURATIONS.items() for x in pair])
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    due = age >= F.try_element_at(seconds, F.col("duration"))
    return users.withColumn("reset", F.coalesce(due, F.lit(False))).withColumn("cost", F.when(F.col("reset"), 0).otherwise(F.col("cost")))


def throttled_limit(limit: Column, share: Column) -> Column:
    """At least 1; a share outside (0, 1] leaves the limit as it is, and no limit stays none."""
    return F.when(limit.isNotNull() & (share > 0) & (share <= 1), F.greatest(F.lit(1), F.floor(limit * share))).otherwise(limit)


def priority_share(value: Column, unit: Column, capacity_rpm: Column, capacity_tpm: Column) -> Column:
    """A reservation as a share of capacity, given as a share, or in requests or tokens a minute; of no known capacity it is taken for a share."""
    part = F.when((unit == "rpm") & (capacity_rpm > 0), F.try_divide(value, capacity_rpm)).when((unit == "tpm") & (capacity_tpm > 0), F.try_divide(value, capacity_tpm))
    return part.otherwise(value.cast("double"))


def blend_score(models: DataFrame, quality_weight: float = 0.7, cost_weight: float = 0.3) -> DataFrame:
    """Quality blended with cheapness; costs are scaled between the group's extremes, 0.5 if these are equal."""
    w = Window.partitionBy("router")
    low, high = F.min("cost").over(w), F.max("cost").over(w)
    scaled = F.when(high > low, (F.col("cost") - low) / (high - low)).otherwise(0.5)
    rows = models.withColumn("normalized_cost", F.round(scaled, 6))
    return rows.withColumn("blend", F.round(quality_weight * F.col("quality") + cost_weight * (1 - F.col("normalized_cost")), 9))


def confidence_tier(confidence: Column, evidence: Column, time: Column) -> Column:
    """Tier by cut points 0.3, 0.5 and 0.7; unverified evidence asks for the smart one, then time from memory for the fast one."""
    cut = F.when(confidence < 0.3, "cloud-smart").when(confidence < 0.5, "cloud-fast").when(confidence < 0.7, "local").otherwise("deep")
    return F.when(F.array_contains(evidence, "UNVERIFIED"), "cloud-smart").when(time == "MEM", "cloud-fast").otherwise(cut)


# Text

PROMPT_CHARS = 2_000
#: Class and pattern in order; the first that is found names the class. Case doesn't matter.
PROMPT_RULES = [
    ("code_generation", r"\b(write|create|generate|implement|build)\s+(?:a |an |the |me )?(?:python|javascript|typescript|java|rust|go|c\+\+|sql|bash|shell)\b"),
    ("code_generation", r"\b(write|create|implement|build)\b(?:\s+\w+){0,4}?\s+(function|class|method|script|program|api|endpoint|microservice)\b"),
    ("code_understanding", r"\b(explain|describe|understand|walk me through|what does)\b.*\b(code|function|method|class|algorithm|snippet)\b"),
    ("code_understanding", r"\b(debug|fix|why (?:is|does|isn't)|what.s wrong|trace)\b.*\b(error|bug|exception|stacktrace|stack trace|traceback)\b"),
    ("code_understanding", r"\b(review|critique)\s+(?:this |my |the )?(?:code|pr|pull request|diff|patch)\b"),
    ("technical_design", r"\b(design|architect|plan|architecture)\b.*\b(system|service|api|database|schema|module|microservice)\b"),
    ("technical_design", r"\b(should i (?:use|choose|pick)|tradeoffs? between|compare)\b.*\b(library|framework|language|database|protocol|postgres|postgresql|mongodb|dynamodb|mysql|redis|kafka|sql|nosql)\b"),
    ("technical_design", r"\bhow (?:should|do) i (?:design|structure|organize|model)\b"),
    ("analytical_reasoning", r"\b(solve|compute|calculate|prove|derive)\b.*\b(equation|integral|derivative|theorem|proof|problem)\b"),
    ("analytical_reasoning", r"\b(if .+ then|given .+ find|suppose|assume)\b"),
    ("analytical_reasoning", r"\b(probability|statistics|combinatorics|optimization problem)\b"),
    ("writing", r"\b(write|draft|compose|rewrite|edit|proofread|polish)\b.*\b(email|essay|blog|post|article|letter|memo|copy|paragraph|sentence)\b"),
    ("writing", r"\b(make (?:this|it)|help me)\s+(?:more |less )?(?:concise|formal|casual|professional|persuasive)\b"),
    ("factual_lookup", r"^\s*(who|what|when|where|which)\s+(?:is|was|were|are)\b"),
    ("factual_lookup", r"^\s*(define|definition of|meaning of)\b"),
    ("factual_lookup", r"^\s*how (?:do you spell|to spell|many .* are there|tall is)\b"),
]


def classify_prompt(text: Column) -> Column:
    head = F.substring(text, 1, PROMPT_CHARS)
    return F.coalesce(*[F.when(head.rlike(f"(?i){rule}"), name) for name, rule in PROMPT_RULES], F.lit("general"))


SAMPLE_CHARS = 5_000
#: Words of code, and where a file's path stands near the beginning of a text.
CODE_WORDS = r"\b(?:def |function |class |import |from |require\(|#include|fn |func |const |let |var |public |private |static )\b"
PATH_PATTERNS = [r"(?m)^#\s*(\S+\.\w+)", r"(?m)^//\s*(\S+\.\w+)", r"(?m)^File:\s*(\S+)", r"(?m)^---\s*(\S+\.\w+)", r"`(\S+\.\w{1,5})`"]


def content_type(text: Column) -> Column:
    """json, code (three words of code, or of over five lines three in ten indented) or text."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    is_json = bare.rlike(r"^[\[{]") & F.try_parse_json(bare).isNotNull()
    sample = F.substring(bare, 1, SAMPLE_CHARS)
    lines = F.split(sample, "\n")
    indented = F.size(F.filter(lines, lambda x: x.rlike(r"^(    |\t)\s*\S")))
    code = (F.regexp_count(sample, F.lit(CODE_WORDS)) >= 3) | ((F.size(lines) > 5) & (indented > F.size(lines) * 0.3))
    return F.when(is_json, "json").when(code, "code").otherwise("text")


def extract_key(text: Column) -> Column:
    """The base name of the first path that one of the patterns finds, in their order; null if none does."""
    head = F.substring(text, 1, PROMPT_CHARS)
    found = F.coalesce(*[F.when(F.regexp_extract(head, p, 1) != "", F.regexp_extract(head, p, 1)) for p in PATH_PATTERNS])
    return F.element_at(F.split(found, "/"), -1)


def stub_message(text: Column, key: Column, tool: str = "retrieve") -> Column:
    """What stands for a message that is left out, with the name of the tool that brings it back."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.format_string(f"[Compressed: %s — %d lines, %s. Use {tool} tool to get full content.]", key, lines, content_type(text))


#: Fixed value, as is the text of ``stub_message``.
CUT = "\n...[truncated for context window]...\n"


def truncate_middle(text: Column, max_tokens: int) -> Column:
    """At 3 characters a token, and at least 100, whole lines: the first 70 % and the last 30 % of as many as fit on average."""
    allowed = max(100, max_tokens * 3)
    lines = F.split(text, "\n")
    mean = F.greatest(F.lit(1), F.floor(F.length(text) / F.size(lines)))
    keep = F.greatest(F.lit(2), F.floor(F.lit(allowed) / mean)).cast("int")
    head = F.floor(keep * 7 / 10).cast("int")
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), head), "\n"), F.lit(CUT), F.array_join(F.slice(lines, F.size(lines) - (keep - head) + 1, keep - head), "\n"))
    return F.when((F.length(text) <= allowed) | (F.size(lines) <= keep), text).otherwise(cut)


TEXTS_AT_ONCE = 64


def _arrow_text(f):
    """A text function as an Arrow UDF, null to null.

    A batch's texts become Python's a few at a time; besides them a worker holds the batch and its result as Arrow has them.
    """

    @F.arrow_udf(StringType())
    def run(v: pa.Array) -> pa.Array:
        parts = (v.slice(i, TEXTS_AT_ONCE).to_pylist() for i in range(0, len(v), TEXTS_AT_ONCE))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if x is None else f(x) for x in part], pa.string()) for part in parts)])

    return run


@_arrow_text
def nfkc(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text) if c not in "​‌‍⁠﻿")


@_arrow_text
def normalize_search(text):
    """Compatibility decomposition without marks, case folded, white space single."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


def normalize_value(cls: Column, text: Column, country: str = "41") -> Column:
    """One form for values that mean the same: e-mail domains lower, phones in E.164, structured ids upper without separators, else lower."""
    plain = F.trim(nfkc(text))
    at = F.instr(plain, "@")
    mail = F.when(at > 0, F.concat(F.substring(plain, F.lit(1), at), F.lower(F.substring(plain, at + 1, F.length(plain))))).otherwise(F.lower(plain))
    digits = F.regexp_replace(plain, r"[^0-9+]", "")
    phone = F.when(digits.startswith("+"), digits).when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits))))
    phone = phone.when(digits.startswith("0"), F.concat(F.lit("+" + country), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    structured = F.upper(F.regexp_replace(plain, r"[\s.\-]", ""))
    return F.when(cls == "EMAIL", mail).when(cls == "PHONE", phone).when(cls.isin("IBAN", "CARD", "AHV", "SECRET"), structured).otherwise(F.lower(plain))


# Checksums


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9])"), 1), lambda x: x.cast("int"))


def luhn_ok(text: Column) -> Column:
    d = F.reverse(_digits(text))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return (F.size(d) >= 12) & (total % 10 == 0)


def iban_ok(text: Column) -> Column:
    v = F.upper(F.regexp_replace(text, r"\s", ""))
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    number = lambda x: F.when(x.rlike("[0-9]"), x.cast("string")).otherwise((F.ascii(x) - 55).cast("string"))
    signs = F.regexp_extract_all(F.array_join(F.transform(F.regexp_extract_all(turned, F.lit("([0-9A-Z])"), 1), number), ""), F.lit("([0-9])"), 1)
    rest = F.aggregate(signs, F.lit(0), lambda a, x: (a * 10 + x.cast("int")) % 97)
    return v.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (rest == 1)


def ahv_ok(text: Column) -> Column:
    """13 digits that begin with 756 and end with the EAN-13 check digit."""
    d = _digits(text)
    total = F.aggregate(F.transform(F.slice(d, 1, 12), lambda x, i: F.when(i % 2 == 1, x * 3).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.regexp_replace(text, "[^0-9]", "").rlike("^756[0-9]{10}$") & ((10 - total % 10) % 10 == F.try_element_at(d, F.lit(13)))


# Masks and digests


def mask_secret(value: Column, prefix: int = 4, suffix: int = 4) -> Column:
    """The first and last few characters with stars between; all stars if too short."""
    n = F.length(value)
    shown = F.concat(F.substring(value, 1, prefix), F.repeat(F.lit("*"), n - prefix - suffix), F.substring(value, n - suffix + 1, F.lit(suffix)))
    return F.when(n > prefix + suffix, shown).otherwise(F.repeat(F.lit("*"), n))


#: Segments of a key that make it sensitive, and those that make it harmless all the same.
SENSITIVE = frozenset(
    "password secret key token auth authorization credential credentials access private certificate fingerprint tenancy".split()
)
HARMLESS = frozenset(["cost"])


def mask_json(prefix: int = 4, suffix: int = 4):
    """An Arrow function that masks the plain values, and lists of texts, under sensitive keys of a JSON text. Other texts stay as they are.

    A key is sensitive by one of its segments between underscores or hyphens; objects under it go by their own keys.
    """

    def masked(v: str) -> str:
        hidden = len(v) - prefix - suffix
        return v[:prefix] + "*" * hidden + v[prefix + hidden :] if hidden > 0 else "*" * len(v)

    def sensitive(key: str) -> bool:
        parts = set(key.lower().replace("-", "_").split("_"))
        return not parts.isdisjoint(SENSITIVE) and parts.isdisjoint(HARMLESS)

    def walk(x, hide: bool, inside_list: bool = False):
        if isinstance(x, dict):
            return {k: walk(v, sensitive(k)) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, hide, True) for v in x]
        if not hide or inside_list and not isinstance(x, str):
            return x
        return masked("" if x is None else str(x))

    def run(text: str) -> str:
        try:
            return json.dumps(walk(json.loads(text), False), ensure_ascii=False)
        except ValueError:
            return text

    return _arrow_text(run)


def mask_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: mask_secret(F.col(c)) for c in df.columns if c in names})


def value_id(text: Column) -> Column:
    return F.sha2(text, 256)


@F.arrow_udf(IntegerType())
def common_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """The length of the longest common substring."""

    def longest(x: str, y: str) -> int:
        best, row = 0, [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == e else 0
                best = max(best, row[j])
        return best

    return pa.array([None if x is None or y is None else longest(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def leak_check(released: DataFrame, vault: DataFrame) -> DataFrame:
    """Released values (value_id, released) that still reveal the vault's originals: equal once folded, a prefix, or a common part of at least min(4, half)."""
    joined = released.join(vault.select("value_id", "original"), "value_id")
    a, b = F.lower(F.trim("released")), F.lower(F.trim("original"))
    least = F.least(F.lit(4), F.ceil(F.length(b) / 2))
    reason = F.when(a == b, "equal").when((a != "") & b.startswith(a), "prefix").when(common_length(a, b) >= least, "substring")
    return joined.withColumn("reason", reason).where("reason is not null")


# JSON paths


def json_path(dotted: str) -> str:
    """A dotted path, in which ``\\.`` is a plain dot, as a JSON path."""
    parts = [p.replace("\0", ".") for p in dotted.replace("\\.", "\0").split(".")]
    return "$" + "".join(f"['{p}']" for p in parts)


def get_path(json: Column, dotted: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(json, json_path(dotted)), F.lit(default))


def drop_path(c: Column, path: str) -> Column:
    """A typed struct without a nested field. ``[*]`` goes into an array's elements, ``[n]`` into its n-th from 0; elements themselves stay.

    All elements of an array have one type, so under ``[n]`` the field of that element becomes null.
    """
    return _without(c, re.findall(r"[^.\[]+|\[[^\]]*\]", path), False)


def _without(c: Column, steps: list[str], nulls: bool) -> Column:
    step, rest = steps[0], steps[1:]
    if step == "[*]":
        return F.transform(c, lambda x: _without(x, rest, nulls)) if rest else c
    if step.startswith("["):
        number = step[1:-1]
        return F.transform(c, lambda x, i: F.when(i == int(number), _without(x, rest, True)).otherwise(x)) if rest and number.isdigit() else c
    if rest:
        return c.withField(step, _without(c[step], rest, nulls))
    return c.withField(step, F.nullif(c[step], c[step])) if nulls else c.dropFields(step)


def query_text(conv: DataFrame) -> DataFrame:
    return conv.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query_text"))


def context_block(chunks: DataFrame, prefix: str = "Context:") -> DataFrame:
    """A query's chunks, best first, under a heading and a blank line apart. Chunks are a top-k's, so few for each query."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return chunks.groupBy("query_id").agg(F.concat_ws("\n\n", F.lit(prefix), F.array_join(ordered, "\n\n")).alias("context"))
