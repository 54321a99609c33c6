"""Queries over model calls and cache events."""

from __future__ import annotations

from ..operators import analytics as a
from .registry import query
from .sql import big, half_up, ratio, since
from .views import standalone, view

COST4, COST6 = half_up("sum(cost_micro) * 1e-6", 4), half_up("sum(cost_micro) * 1e-6", 6)
AVG6 = half_up("CAST(sum(cost_micro) AS DOUBLE) / count(cost_micro) * 1e-6", 6)
PER_M = ratio("sum(cost_micro)", "sum(total_tokens)", 2)
LAT = ratio("sum(latency_ms)", "count(latency_ms)")
LAT2, LAT1, LAT0 = (ratio("sum(latency_ms)", "count(latency_ms)", d) for d in (2, 1, 0))
TOK = f"{big('sum(total_tokens)')} AS total_tokens"
INOUT = f"{big('sum(input_tokens)')} AS input_tokens, {big('sum(output_tokens)')} AS output_tokens"
DAY = "CAST(created_at AS DATE)"
ERR = "count(*) FILTER (WHERE error_message IS NOT NULL)"
OK = "count(*) FILTER (WHERE error_message IS NULL)"
HIT, MISS = ("count(*) FILTER (WHERE event_type = 'hit')", "count(*) FILTER (WHERE event_type = 'miss')")
COUNTERS = f"""SELECT content_hash, task_type, model, {HIT} AS h, {MISS} AS m, {big('sum(tokens_saved)')} AS t, {big('sum(cost_saved_micro)')} AS s FROM {{cache_events}} GROUP BY 1, 2, 3"""
CACHE = f"""count(*) AS entries, {big('sum(h)')} AS hits, {big('sum(m)')} AS misses, {ratio('sum(h)', '(sum(h) + sum(m))', 2, 100)} AS hit_rate,
  {big('sum(t)')} AS tokens_saved, {half_up('sum(s) * 1e-6', 2)} AS cost_saved"""


def _p(name: str, f, sql: str) -> None:
    query(name, standalone(sql))(lambda spark, d: f(view(spark, d, "llm_calls")))


def _k(name: str, f, sql: str) -> None:
    query(name, standalone(sql))(lambda spark, d: f(view(spark, d, "cache_events")))


def _pk(name: str, f, sql: str | None) -> None:
    query(name, sql and standalone(sql))(lambda spark, d: f(view(spark, d, "llm_calls"), view(spark, d, "cache_events")))


_p("a01_cost_per_deal", a.cost_per_deal, f"""SELECT deal_id, max(cycle_number) AS max_cycle, count(*) AS calls, {INOUT}, {TOK}, {COST4} AS cost, {LAT} AS avg_latency,
  count(*) FILTER (WHERE cached) AS cached_calls, {ratio('count(*) FILTER (WHERE cached)', 'count(*)', 4)} AS cached_ratio FROM {{llm_calls}} GROUP BY 1""")
_p("a02_model_selection", a.model_selection, f"""SELECT selected_model, provider_type, count(*) AS calls, {TOK}, {COST4} AS cost, {LAT2} AS avg_latency,
  {ratio('count(*)', '(SELECT count(*) FROM {llm_calls})', 2, 100)} AS pct {since('llm_calls', 30)} GROUP BY 1, 2""")
_p("a03_task_performance", a.task_performance, f"""SELECT task_type, count(*) AS calls, {INOUT}, {LAT2} AS avg_latency, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency,
  {COST4} AS cost, {AVG6} AS cost_per_call, {ratio('sum(total_tokens)', 'count(*)', 0)} AS tokens_per_call {since('llm_calls', 30)} GROUP BY 1""")
_k("a04_cache_effectiveness", a.cache_effectiveness, f"WITH k AS ({COUNTERS}) SELECT task_type, {CACHE} FROM k GROUP BY 1")
_p("a05_cost_trend", a.cost_trend, f"SELECT {DAY} AS day, count(*) AS calls, {TOK}, {COST4} AS cost, {AVG6} AS avg_cost, {PER_M} AS cost_per_million {since('llm_calls', 30)} GROUP BY 1")
_p("a06_provider_comparison", a.provider_comparison, f"""SELECT provider_type, count(*) AS calls, {TOK}, {COST4} AS cost, {LAT1} AS avg_latency, {PER_M} AS cost_per_million, {ERR} AS errors,
  {ratio(OK, 'count(*)', 2, 100)} AS success_rate {since('llm_calls', 30)} GROUP BY 1""")
_p("a07_token_efficiency", a.token_efficiency, f"""WITH d AS (SELECT {DAY} AS day, count(*) AS calls, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(total_tokens) AS t, sum(cost_micro) AS m FROM {{llm_calls}} GROUP BY 1)
  SELECT day, calls, {ratio('t', 'calls', 0)} AS avg_tokens, {half_up('CAST(i AS DOUBLE) / nullif(o, 1)', 2)} AS io_ratio, {ratio('m', 't', 2)} AS cost_per_million, {half_up('m * 1e-6', 2)} AS daily_cost FROM d""")
_p("a08_compression_effectiveness", a.compression_effectiveness, f"""SELECT {DAY} AS day, count(*) FILTER (WHERE input_tokens < 2000) AS compressed, count(*) AS calls,
  {ratio('count(*) FILTER (WHERE input_tokens < 2000)', 'count(*)', 2, 100)} AS rate, {ratio('sum(input_tokens)', 'count(*)', 0)} AS avg_input, {AVG6} AS avg_cost {since('llm_calls', 30)} GROUP BY 1""")
_p("a09_error_analysis", a.error_analysis, f"""SELECT error_message, provider_type, count(*) AS errors, list_sort(list(DISTINCT deal_id)) AS deals, max(created_at) AS last_seen
  {since('llm_calls', 7, more=' AND error_message IS NOT NULL')} GROUP BY 1, 2""")
_p("a10_cycle_breakdown", lambda p: a.cycle_breakdown(p, 7), f"""SELECT cycle_number, task_type, selected_model, count(*) AS calls, {TOK}, {COST4} AS cost, {LAT2} AS avg_latency
  FROM {{llm_calls}} WHERE deal_id = 7 GROUP BY 1, 2, 3""")
_p("a11_top_deals", a.top_deals, f"""SELECT deal_id, count(*) AS calls, {TOK}, {COST4} AS cost, {LAT0} AS avg_latency {since('llm_calls', 30)} GROUP BY 1 ORDER BY sum(cost_micro) DESC, deal_id LIMIT 20""")
_p("a12_model_preferences", lambda p: a.model_selection(p, same_window=True), f"""WITH w AS (SELECT * {since('llm_calls', 30)}) SELECT selected_model, provider_type, count(*) AS calls, {TOK}, {COST4} AS cost, {LAT2} AS avg_latency,
  {ratio('count(*)', '(SELECT count(*) FROM w)', 2, 100)} AS pct FROM w GROUP BY 1, 2""")
_k("a13_cache_metrics", a.cache_metrics, f"WITH k AS ({COUNTERS}) SELECT {CACHE} FROM k")
_p("a14_cost_trend_week", lambda p: a.cost_trend(p, 7), f"SELECT {DAY} AS day, count(*) AS calls, {TOK}, {COST4} AS cost, {AVG6} AS avg_cost, {PER_M} AS cost_per_million {since('llm_calls', 7)} GROUP BY 1")
_p("a15_provider_reliability", a.provider_reliability, f"SELECT provider_type, count(*) AS total, {OK} AS successes, {ratio(OK, 'count(*)', 2, 100)} AS success_rate, {LAT1} AS avg_latency {since('llm_calls', 7)} GROUP BY 1")
_p("a16_cost_by_task", a.cost_by_task, f"SELECT task_type, count(*) AS calls, {TOK}, {COST4} AS cost, {AVG6} AS avg_cost {since('llm_calls', 30)} GROUP BY 1")
_pk("a17_summary_report", lambda p, k: a.summary_report(p, k).selectExpr(
    "size(top_deals) AS deals", "size(models) AS models", "size(trend) AS days", "size(providers) AS providers", "size(tasks) AS tasks", "cache[0].entries AS cache_entries", "cache[0].hits AS cache_hits"),
    f"""WITH k AS ({COUNTERS}), w AS (SELECT * {since('llm_calls', 30)}), v AS (SELECT * {since('llm_calls', 7)})
  SELECT CAST(least(10, (SELECT count(DISTINCT deal_id) FROM w)) AS INT) AS deals, CAST((SELECT count(DISTINCT selected_model) FROM w) AS INT) AS models, CAST((SELECT count(DISTINCT {DAY}) FROM w) AS INT) AS days,
    CAST((SELECT count(DISTINCT provider_type) FROM v) AS INT) AS providers, CAST((SELECT count(DISTINCT task_type) FROM w) AS INT) AS tasks, (SELECT count(*) FROM k) AS cache_entries, {big('(SELECT sum(h) FROM k)')} AS cache_hits""")
_p("a18_api_cost_per_deal", a.api_cost_per_deal, f"""SELECT deal_id, count(*) AS calls, {COST6} AS cost, {AVG6} AS avg_cost, {big('sum(input_tokens + output_tokens)')} AS tokens
  {since('llm_calls', 30, '>')} GROUP BY 1 ORDER BY sum(cost_micro) DESC, deal_id LIMIT 10""")
_p("a19_api_model_selection", a.api_model_selection, f"SELECT selected_model, count(*) AS calls, {COST6} AS cost, {big(f'floor({LAT})')} AS avg_latency, {ERR} AS errors {since('llm_calls', 7, '>')} GROUP BY 1")
_p("a20_api_task_performance", a.api_task_performance, f"""SELECT task_type, count(*) AS calls, {COST6} AS cost, {AVG6} AS avg_cost, {big(f'floor({LAT})')} AS avg_latency,
  {big(f"floor({ratio('sum(input_tokens + output_tokens)', 'count(*)')})")} AS avg_tokens, count(*) FILTER (WHERE cached) AS cached_calls {since('llm_calls', 7, '>', ' AND task_type IS NOT NULL')} GROUP BY 1""")
_k("a21_api_cache_effectiveness", a.api_cache_effectiveness, f"""SELECT task_type, {HIT} AS hits, {MISS} AS misses, coalesce({ratio(HIT, f'({HIT} + {MISS})', 2, 100)}, 0e0) AS hit_rate,
  {big('sum(tokens_saved)')} AS tokens_saved, {half_up('sum(cost_saved_micro) * 1e-6', 6)} AS cost_saved {since('cache_events', 7, '>')} GROUP BY 1""")
_p("a22_api_cost_trend", a.api_cost_trend, f"SELECT {DAY} AS day, count(*) AS calls, {COST6} AS cost, {big('sum(input_tokens + output_tokens)')} AS tokens, count(*) FILTER (WHERE cached) AS cached_calls {since('llm_calls', 30, '>')} GROUP BY 1")
_p("a23_api_error_analysis", a.api_error_analysis, f"SELECT task_type, count(*) AS total, {ERR} AS errors, {ratio(ERR, 'count(*)', 2, 100)} AS error_rate, max(error_message) AS sample {since('llm_calls', 7, '>')} GROUP BY 1 HAVING {ERR} > 0")


def _totals(p: str, k: str) -> str:
    return f"""SELECT * FROM (SELECT count(*) AS calls, coalesce({big('sum(total_tokens)')}, 0) AS tokens, coalesce({COST6}, 0e0) AS cost, {ERR} AS errors, count(*) FILTER (WHERE cached) AS cached_calls,
    coalesce({big(f'floor({LAT})')}, 0) AS avg_latency {p}) x CROSS JOIN (SELECT {HIT} AS hits, {MISS} AS misses, coalesce({big('sum(tokens_saved)')}, 0) AS tokens_saved {k}) y"""


_pk("a24_api_summary", a.api_summary, _totals(since("llm_calls", 30, ">"), since("cache_events", 30, ">")))
_pk("a25_deal_summary", lambda p, k: a.deal_summary(p, k, 7), _totals("FROM {llm_calls} WHERE deal_id = 7", "FROM {cache_events} WHERE deal_id = 7"))
_p("a26_health", a.health, f"SELECT count(*) AS calls, {ERR} AS errors {since('llm_calls', 1 / 24, '>')}")
_p("a27_metric_rows", lambda p: a.metric_rows(p).groupBy("provider_type").agg(a.n(), a.total("total_tokens", "total_tokens"), a.truth(a.failed(), "errors")),
   f"SELECT provider_type, count(*) AS calls, {big('sum(input_tokens + output_tokens)')} AS total_tokens, {ERR} AS errors FROM {{llm_calls}} GROUP BY 1")
_k("a28_cache_rows", lambda k: a.cache_rows(k).groupBy("event_type").agg(a.n("events"), a.total("tokens_saved", "tokens_saved")),
   f"SELECT event_type, count(*) AS events, {big('sum(tokens_saved)')} AS tokens_saved FROM {{cache_events}} GROUP BY 1")
