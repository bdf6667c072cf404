"""Model-usage cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.schema import lookup

# Price per 1K prompt and completion tokens in billionths of a dollar per token.
PRICES = {
    "gpt-4o": (5000, 15000),
    "gpt-4o-mini": (150, 600),
    "gpt-4-turbo": (10000, 30000),
    "gpt-4": (30000, 60000),
    "claude-3-5-sonnet": (3000, 15000),
    "claude-3-haiku": (250, 1250),
    "claude-3-opus": (15000, 75000),
    "gemini-1.5-pro": (1250, 5000),
    "gemini-1.5-flash": (75, 300),
}
DEFAULT_PRICE = (10000, 30000)


def ai_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """Cost in dollars as an exact decimal with six places."""
    rate = lambda i: lookup({m: p[i] for m, p in PRICES.items()}, model, DEFAULT_PRICE[i]).cast("long")
    nano = prompt.cast("long") * rate(0) + completion.cast("long") * rate(1)
    micro = F.floor((nano + 500).cast("decimal(20,0)") / F.lit(1000))
    return (micro.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")


def priced(calls: DataFrame) -> DataFrame:
    """Usage records with total tokens and estimated cost."""
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    return calls.withColumns(
        {"total_tokens": prompt + completion, "estimated_cost_usd": ai_cost(F.col("model"), prompt, completion)}
    )


def _totals() -> list[Column]:
    return [
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("estimated_cost_usd").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("api_calls"),
    ]


def daily_costs(usage: DataFrame) -> DataFrame:
    """Tokens, cost and calls per user, day and provider."""
    return usage.groupBy("user_id", F.to_date("created_at").alias("date"), "provider").agg(*_totals())


def daily_cost(costs: DataFrame) -> DataFrame:
    """Per user and day over all providers."""
    return costs.groupBy("user_id", "date").agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.sum("api_calls").alias("api_calls"),
    )


def monthly_cost(usage: DataFrame, year: int, month: int) -> DataFrame:
    """Per user within one calendar month, a range that prunes by time."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    inside = (F.col("created_at") >= first) & (F.col("created_at") < F.add_months(first, 1))
    return usage.where(inside).groupBy("user_id").agg(*_totals())
