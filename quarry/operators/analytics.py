"""Usage analytics over model calls (P) and cache events (K): hash aggregations with partial sums before each shuffle.

Windows end at as_of, by default the latest created_at: a scalar subquery over that one column, which Spark runs before the scan that its value
is a filter of; nothing runs while a plan is built. Divisions by zero give null.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio

c = F.col
MICRO = 1e-6


def latest(df: DataFrame) -> Column:
    """The latest created_at, as a scalar subquery."""
    return df.agg(F.max("created_at")).scalar()


def since(df: DataFrame, days: float, as_of: datetime | Column | None = None, inclusive: bool = True) -> DataFrame:
    """Rows of the last days before as_of."""
    end = latest(df) if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    start = end.cast(df.schema["created_at"].dataType) - F.make_dt_interval(secs=F.lit(round(days * 86400)))
    return df.filter(c("created_at") >= start if inclusive else c("created_at") > start)


def n(name: str = "calls") -> Column:
    return F.count("*").alias(name)


def total(column: str, name: str) -> Column:
    return F.sum(column).cast("long").alias(name)


def dollars(name: str, digits: int = 4) -> Column:
    return half_up(F.sum("cost_micro") * MICRO, digits).alias(name)


def mean(column: str, name: str, digits: int | None = None) -> Column:
    return ratio(F.sum(column), F.count(column), digits).alias(name)


def per_call(name: str, digits: int = 6) -> Column:
    return half_up(F.sum("cost_micro") / F.count("cost_micro") * MICRO, digits).alias(name)


def per_million(name: str) -> Column:
    """Dollars for a million tokens: micro-dollars a token."""
    return ratio(F.sum("cost_micro"), F.sum("total_tokens"), 2).alias(name)


def truth(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def failed() -> Column:
    return c("error_message").isNotNull()


def day() -> Column:
    return c("created_at").cast("date").alias("day")


def cost_per_deal(p: DataFrame) -> DataFrame:
    return p.groupBy("deal_id").agg(
        F.max("cycle_number").alias("max_cycle"), n(), total("input_tokens", "input_tokens"), total("output_tokens", "output_tokens"), total("total_tokens", "total_tokens"),
        dollars("cost"), mean("latency_ms", "avg_latency"), truth(c("cached"), "cached_calls"), ratio(F.count_if("cached"), F.count("*"), 4).alias("cached_ratio"),
    ).orderBy(F.desc_nulls_first("cost"), "deal_id")


def model_selection(p: DataFrame, days: int = 30, as_of: datetime | None = None, same_window: bool = False) -> DataFrame:
    """Share of each model; of all rows ever, or with same_window of the rows in the window."""
    recent = since(p, days, as_of)
    rows = recent.groupBy("selected_model", "provider_type").agg(n(), total("total_tokens", "total_tokens"), dollars("cost"), mean("latency_ms", "avg_latency", 2))
    whole = (recent if same_window else p).agg(F.count("*").alias("all_calls"))
    return rows.crossJoin(F.broadcast(whole)).select("*", ratio(c("calls"), c("all_calls"), 2, 100).alias("pct")).drop("all_calls")


def task_performance(p: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of).groupBy("task_type").agg(
        n(), total("input_tokens", "input_tokens"), total("output_tokens", "output_tokens"), mean("latency_ms", "avg_latency", 2), F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"), dollars("cost"), per_call("cost_per_call"), mean("total_tokens", "tokens_per_call", 0),
    )


def cache_counters(k: DataFrame) -> DataFrame:
    """The counter form of the event log: one row per (content_hash, task_type, model)."""
    return k.groupBy("content_hash", "task_type", "model").agg(
        truth(c("event_type") == "hit", "hit_count"), truth(c("event_type") == "miss", "miss_count"), total("tokens_saved", "total_tokens_saved"), total("cost_saved_micro", "cost_saved_micro")
    )


def _cache_totals() -> list[Column]:
    hits, misses = F.sum("hit_count").cast("long"), F.sum("miss_count").cast("long")
    return [
        F.count("*").alias("entries"), hits.alias("hits"), misses.alias("misses"), ratio(hits, hits + misses, 2, 100).alias("hit_rate"),
        total("total_tokens_saved", "tokens_saved"), half_up(F.sum("cost_saved_micro") * MICRO, 2).alias("cost_saved"),
    ]


def cache_effectiveness(k: DataFrame) -> DataFrame:
    return cache_counters(k).groupBy("task_type").agg(*_cache_totals())


def cache_metrics(k: DataFrame) -> DataFrame:
    return cache_counters(k).agg(*_cache_totals())


def cost_trend(p: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of).groupBy(day()).agg(n(), total("total_tokens", "total_tokens"), dollars("cost"), per_call("avg_cost"), per_million("cost_per_million"))


def provider_comparison(p: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of).groupBy("provider_type").agg(
        n(), total("total_tokens", "total_tokens"), dollars("cost"), mean("latency_ms", "avg_latency", 1), per_million("cost_per_million"), truth(failed(), "errors"),
        ratio(F.count_if(~failed()), F.count("*"), 2, 100).alias("success_rate"),
    )


def token_efficiency(p: DataFrame) -> DataFrame:
    """By day; the input to output ratio divides by null where output is 1, as the rule says."""
    daily = p.groupBy(day()).agg(n(), total("input_tokens", "i"), total("output_tokens", "o"), total("total_tokens", "t"), total("cost_micro", "m"))
    return daily.select(
        "day", "calls", ratio(c("t"), c("calls"), 0).alias("avg_tokens"), half_up(c("i").cast("double") / F.nullif(c("o"), F.lit(1)), 2).alias("io_ratio"),
        ratio(c("m"), c("t"), 2).alias("cost_per_million"), half_up(c("m") * MICRO, 2).alias("daily_cost"),
    )


def compression_effectiveness(p: DataFrame, days: int = 30, as_of: datetime | None = None, below: int = 2000) -> DataFrame:
    small = c("input_tokens") < below
    return since(p, days, as_of).groupBy(day()).agg(truth(small, "compressed"), n(), ratio(F.count_if(small), F.count("*"), 2, 100).alias("rate"), mean("input_tokens", "avg_input", 0), per_call("avg_cost"))


def error_analysis(p: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    """By error and provider, with the sorted distinct deals. The deals of one error are bounded by the deals."""
    return since(p, days, as_of).filter(failed()).groupBy("error_message", "provider_type").agg(
        n("errors"), F.array_sort(F.collect_set("deal_id")).alias("deals"), F.max("created_at").alias("last_seen")
    ).orderBy(F.desc("errors"), "error_message", "provider_type")


def cycle_breakdown(p: DataFrame, deal_id: int) -> DataFrame:
    return p.filter(c("deal_id") == deal_id).groupBy("cycle_number", "task_type", "selected_model").agg(n(), total("total_tokens", "total_tokens"), dollars("cost"), mean("latency_ms", "avg_latency", 2))


def top_deals(p: DataFrame, limit: int = 20, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    rows = since(p, days, as_of).groupBy("deal_id").agg(n(), total("total_tokens", "total_tokens"), total("cost_micro", "m"), mean("latency_ms", "avg_latency", 0))
    return rows.orderBy(F.desc_nulls_first("m"), "deal_id").limit(limit).select("deal_id", "calls", "total_tokens", half_up(c("m") * MICRO, 4).alias("cost"), "avg_latency")


def provider_reliability(p: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of).groupBy("provider_type").agg(n("total"), truth(~failed(), "successes"), ratio(F.count_if(~failed()), F.count("*"), 2, 100).alias("success_rate"), mean("latency_ms", "avg_latency", 1))


def cost_by_task(p: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of).groupBy("task_type").agg(n(), total("total_tokens", "total_tokens"), dollars("cost"), per_call("avg_cost"))


def summary_report(p: DataFrame, k: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    """Six reports in one row of arrays. Each is a few rows; deals are the top ten, days as many as the window."""
    as_of = latest(p) if as_of is None else as_of
    parts = {
        "top_deals": top_deals(p, 10, days, as_of), "models": model_selection(p, days, as_of, same_window=True), "cache": cache_metrics(k),
        "trend": cost_trend(p, days, as_of), "providers": provider_reliability(p, 7, as_of), "tasks": cost_by_task(p, days, as_of),
    }
    out = None
    for name, part in parts.items():
        row = part.agg(F.array_sort(F.collect_list(F.struct(*sorted(part.columns)))).alias(name))
        out = row if out is None else out.crossJoin(F.broadcast(row))
    return out


def api_cost_per_deal(p: DataFrame, limit: int = 10, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    rows = since(p, days, as_of, inclusive=False).groupBy("deal_id").agg(n(), total("cost_micro", "m"), per_call("avg_cost"), F.sum(c("input_tokens") + c("output_tokens")).alias("tokens"))
    return rows.orderBy(F.desc_nulls_first("m"), "deal_id").limit(limit).select("deal_id", "calls", half_up(c("m") * MICRO, 6).alias("cost"), "avg_cost", "tokens")


def api_model_selection(p: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of, inclusive=False).groupBy("selected_model").agg(n(), dollars("cost", 6), F.floor(ratio(F.sum("latency_ms"), F.count("latency_ms"))).alias("avg_latency"), truth(failed(), "errors"))


def api_task_performance(p: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of, inclusive=False).filter(c("task_type").isNotNull()).groupBy("task_type").agg(
        n(), dollars("cost", 6), per_call("avg_cost"), F.floor(ratio(F.sum("latency_ms"), F.count("latency_ms"))).alias("avg_latency"),
        F.floor(ratio(F.sum(c("input_tokens") + c("output_tokens")), F.count("*"))).alias("avg_tokens"), truth(c("cached"), "cached_calls"),
    )


def api_cache_effectiveness(k: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    hits, misses = F.count_if(c("event_type") == "hit"), F.count_if(c("event_type") == "miss")
    rows = since(k, days, as_of, inclusive=False).groupBy("task_type").agg(
        hits.alias("hits"), misses.alias("misses"), F.coalesce(ratio(hits, hits + misses, 2, 100), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.coalesce(half_up(F.sum("cost_saved_micro") * MICRO, 6), F.lit(0.0)).alias("cost_saved"),
    )
    return rows.orderBy(F.desc_nulls_last("hit_rate"), "task_type")


def api_cost_trend(p: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    return since(p, days, as_of, inclusive=False).groupBy(day()).agg(n(), dollars("cost", 6), F.sum(c("input_tokens") + c("output_tokens")).alias("tokens"), truth(c("cached"), "cached_calls")).orderBy("day")


def api_error_analysis(p: DataFrame, days: int = 7, as_of: datetime | None = None) -> DataFrame:
    rows = since(p, days, as_of, inclusive=False).groupBy("task_type").agg(n("total"), truth(failed(), "errors"), ratio(F.count_if(failed()), F.count("*"), 2, 100).alias("error_rate"), F.max("error_message").alias("sample"))
    return rows.filter("errors > 0")


def _two_totals(p: DataFrame, k: DataFrame) -> DataFrame:
    zero = lambda x, name: F.coalesce(x, F.lit(0)).alias(name)
    a = p.agg(
        n(), zero(F.sum("total_tokens"), "tokens"), F.coalesce(half_up(F.sum("cost_micro") * MICRO, 6), F.lit(0.0)).alias("cost"), truth(failed(), "errors"),
        truth(c("cached"), "cached_calls"), F.coalesce(F.floor(ratio(F.sum("latency_ms"), F.count("latency_ms"))), F.lit(0)).alias("avg_latency"),
    )
    b = k.agg(truth(c("event_type") == "hit", "hits"), truth(c("event_type") == "miss", "misses"), zero(F.sum("tokens_saved"), "tokens_saved"))
    return a.crossJoin(F.broadcast(b))


def api_summary(p: DataFrame, k: DataFrame, days: int = 30, as_of: datetime | None = None) -> DataFrame:
    as_of = latest(p) if as_of is None else as_of
    return _two_totals(since(p, days, as_of, inclusive=False), since(k, days, as_of, inclusive=False))


def deal_summary(p: DataFrame, k: DataFrame, deal_id: int) -> DataFrame:
    return _two_totals(p.filter(c("deal_id") == deal_id), k.filter(c("deal_id") == deal_id))


def health(p: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Calls and errors of the last hour, its beginning excluded."""
    as_of = latest(p) if as_of is None else as_of
    return since(p, 1 / 24, as_of, inclusive=False).agg(n(), truth(failed(), "errors"))


def metric_rows(calls: DataFrame) -> DataFrame:
    """Rows to append for recorded calls: total is input plus output, an empty error is null."""
    return calls.withColumns({"total_tokens": c("input_tokens") + c("output_tokens"), "error_message": F.nullif("error_message", F.lit(""))})


def cache_rows(events: DataFrame) -> DataFrame:
    """Rows to append for cache events: missing savings are 0."""
    return events.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("tokens_saved", "cost_saved_micro")})
