"""Prices, costs and usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (patterns, (USD for a million input, cached input and output tokens)), in order of precedence.
PRICES = [
    (("claude-opus", "opus-4"), (15.0, 1.50, 75.0)),
    (("claude-sonnet", "sonnet-4"), (3.0, 0.30, 15.0)),
    (("claude-haiku", "haiku-4"), (1.0, 0.10, 5.0)),
    (("claude-3-5-sonnet", "claude-3.7-sonnet", "claude-3.5-sonnet"), (3.0, 0.30, 15.0)),
    (("claude-3-5-haiku", "claude-3.5-haiku"), (0.80, 0.08, 4.0)),
    (("gpt-5-pro",), (15.0, 15.0, 105.0)),
    (("gpt-5-mini", "gpt-5-nano"), (0.25, 0.025, 2.0)),
    (("gpt-5", "chatgpt-5"), (1.25, 0.125, 10.0)),
    (("o3", "o4-mini", "gpt-4.1-mini", "gpt-4o-mini"), (1.10, 0.55, 4.40)),
    (("gpt-4.1", "gpt-4o", "codex"), (2.50, 1.25, 10.0)),
    (("gemini-2.5-pro",), (1.25, 0.3125, 10.0)),
    (("gemini-2.5-flash", "gemini-flash"), (0.30, 0.075, 2.50)),
    (("kimi", "moonshot"), (0.60, 0.10, 2.50)),
    (("deepseek",), (0.27, 0.07, 1.10)),
    (("qwen3-coder", "qwen-coder"), (0.50, 0.10, 2.00)),
]
FALLBACK = (3.0, 0.30, 15.0)
PRICE_NAMES = ("price_in", "price_cached", "price_out")


def price_columns(model: Column, prices: list = PRICES, fallback: tuple = FALLBACK) -> dict[str, Column]:
    """price_in, price_cached and price_out by the first pattern that the lower-case model name holds."""
    name = F.lower(F.coalesce(model, F.lit("")))
    out = {}
    for i, column in enumerate(PRICE_NAMES):
        case = F.when(F.lit(False), 0.0)
        for patterns, price in prices:
            hit = name.contains(patterns[0])
            for p in patterns[1:]:
                hit = hit | name.contains(p)
            case = case.when(hit, price[i])
        out[column] = case.otherwise(fallback[i])
    return out


def with_price(requests: DataFrame, model: str = "model") -> DataFrame:
    return requests.withColumns(price_columns(F.col(model)))


def cost_usd() -> Column:
    """Cost of a request with price columns; cache writes cost as much as input, reasoning nothing."""
    return (F.col("in_tok") * F.col("price_in") + F.col("cr_tok") * F.col("price_cached") + F.col("cw_tok") * F.col("price_in") + F.col("out_tok") * F.col("price_out")) / 1e6


def price_sql(model: str = "model", prices: list = PRICES, fallback: tuple = FALLBACK) -> str:
    """The same prices as SQL text, for comparison with other engines."""
    cases = []
    for i, column in enumerate(PRICE_NAMES):
        when = " ".join("WHEN " + " OR ".join(f"contains(lower({model}), '{p}')" for p in patterns) + f" THEN {price[i]}::DOUBLE" for patterns, price in prices)
        cases.append(f"CASE {when} ELSE {fallback[i]}::DOUBLE END AS {column}")
    return ", ".join(cases)


def usage(provider: Column, prompt: Column, cached: Column, completion: Column, reasoning: Column, cache_write: Column) -> Column:
    """One usage record from a provider's numbers; only the message dialect splits cached input off itself."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    uncached = F.when(provider == "anthropic", zero(prompt)).otherwise(F.greatest(F.lit(0), zero(prompt) - zero(cached)))
    write = F.when(provider == "anthropic", zero(cache_write)).otherwise(F.lit(0)).cast("long")
    return F.struct(uncached.alias("input_uncached"), write.alias("cache_write"), zero(cached).alias("cache_read"), zero(completion).alias("output"), zero(reasoning).alias("reasoning"))


def response_usage(dialect: Column, response: Column) -> Column:
    """The usage record of a response body (JSON text) of one of four dialects; null without usage.

    Each dialect names its numbers otherwise, and a stream's final event of the responses dialect
    wraps the body. What is no number counts as 0.
    """
    wrapped = F.get_json_object(response, "$.response")
    body = F.when((dialect == "responses") & F.startswith(F.get_json_object(response, "$.type"), F.lit("response.")), wrapped).otherwise(response)
    whole = F.when(dialect == "gemini", F.get_json_object(body, "$.usageMetadata")).otherwise(F.get_json_object(body, "$.usage"))

    def number(**paths: str) -> Column:
        out = F.lit(None).cast("long")
        for name, path in paths.items():
            out = F.when(dialect == name, F.get_json_object(whole, path).try_cast("long")).otherwise(out)
        return out

    prompt = number(openai="$.prompt_tokens", anthropic="$.input_tokens", gemini="$.promptTokenCount", responses="$.input_tokens")
    cached = number(openai="$.prompt_tokens_details.cached_tokens", anthropic="$.cache_read_input_tokens", gemini="$.cachedContentTokenCount", responses="$.input_tokens_details.cached_tokens")
    completion = number(openai="$.completion_tokens", anthropic="$.output_tokens", gemini="$.candidatesTokenCount", responses="$.output_tokens")
    reasoning = number(openai="$.completion_tokens_details.reasoning_tokens", gemini="$.thoughtsTokenCount", responses="$.output_tokens_details.reasoning_tokens")
    record = usage(dialect, prompt, cached, completion, reasoning, number(anthropic="$.cache_creation_input_tokens"))
    return F.when(whole.isNotNull() & (whole != "{}"), record)


def merge_usage(final: str, streamed: str, fields: tuple = ("input_uncached", "cache_write", "cache_read", "output", "reasoning")) -> Column:
    """The final record with zeros filled from what was streamed."""
    return F.struct(*(F.coalesce(F.nullif(F.col(f"{final}.{f}"), F.lit(0)), F.col(f"{streamed}.{f}"), F.lit(0)).alias(f) for f in fields))
