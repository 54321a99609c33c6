"""Deal tables over the driver's star schema, as SQL text that both engines run.

Names in braces are base tables or other views. Costs are integer micro-dollars until they are reported.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "llm_calls": """
SELECT event_id AS id, ts AS created_at, user_id AS deal_id, CAST(event_id % 3 + 1 AS INT) AS cycle_number, event_type AS task_type,
  CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'qwen-14b' WHEN 2 THEN 'qwen-7b-quantized' ELSE 'llama-70b' END AS selected_model,
  CASE WHEN event_id % 4 = 0 THEN 'openai' ELSE 'self-hosted' END AS provider_type,
  CAST(floor(value * 40) AS BIGINT) + 1 AS input_tokens, CAST(floor(value * 7) AS BIGINT) + 1 AS output_tokens,
  CAST(floor(value * 40) AS BIGINT) + CAST(floor(value * 7) AS BIGINT) + 2 AS total_tokens,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_id % 5 = 0 AS cached,
  CASE WHEN event_type = 'error' THEN concat('E', CAST(event_id % 7 AS VARCHAR(8))) END AS error_message,
  (CAST(floor(value * 40) AS BIGINT) + 1) * 5 + (CAST(floor(value * 7) AS BIGINT) + 1) * 15 AS cost_micro
FROM {events}""",
    "cache_events": """
SELECT id, created_at, deal_id, task_type, concat('h', CAST(deal_id AS VARCHAR(20))) AS content_hash, selected_model AS model,
  CASE id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE 'eviction' END AS event_type,
  CASE WHEN id % 3 = 0 THEN input_tokens ELSE 0 END AS tokens_saved,
  CASE WHEN id % 3 = 0 THEN input_tokens * 5 ELSE 0 END AS cost_saved_micro
FROM {llm_calls}""",
    "deals": """
SELECT c_custkey AS id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'pitched' WHEN 'MACHINERY' THEN 'ready_decision' WHEN 'AUTOMOBILE' THEN 'in_diligence' WHEN 'FURNITURE' THEN 'under_review' ELSE 'intake' END AS stage,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 37 % 101 AS BIGINT) END AS score,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('owner', CAST(c_custkey % 13 AS VARCHAR(8))) END AS owner,
  DATE '2024-01-01' + CAST(c_custkey % 200 AS INT) AS created_at, DATE '2024-02-01' + CAST(c_custkey * 7 % 300 AS INT) AS updated_at,
  c_custkey % 17 = 0 AS deleted
FROM {customer}""",
    "deal_documents": """
SELECT o_orderkey AS document_id, o_custkey AS deal_id, concat('Doc ', CAST(o_orderkey % 50 AS VARCHAR(8))) AS title,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pitch_deck' WHEN '2' THEN 'financials' WHEN '3' THEN 'product' WHEN '4' THEN 'legal' ELSE 'other' END AS type,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
  o_orderdate AS uploaded_at, CAST(o_orderkey % 41 AS INT) AS page_count,
  CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'warnings' WHEN 3 THEN 'failed' END AS verification_status,
  CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey * 13 % 101 AS BIGINT) END AS quality_pct,
  CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderkey * 29 % 101 AS BIGINT) END AS ocr_confidence
FROM {orders}""",
    "evidence": """
SELECT l_orderkey * 8 + l_linenumber AS evidence_id, o_custkey AS deal_id, l_orderkey AS document_id,
  CASE l_returnflag WHEN 'A' THEN 'fetch_evidence' ELSE 'ingest' END AS source,
  CASE l_returnflag WHEN 'A' THEN 'fact' WHEN 'N' THEN 'metric' ELSE 'heading' END AS kind,
  concat('line ', CAST(l_partkey AS VARCHAR(20))) AS text, CASE WHEN l_suppkey % 3 <> 0 THEN concat('part ', CAST(l_suppkey AS VARCHAR(20))) END AS excerpt,
  CAST(100 - floor(l_discount * 100 + 0.5) AS BIGINT) AS confidence_pct, l_shipdate AS created_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "dio_versions": """
SELECT o_orderkey AS id, o_custkey AS deal_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
  'published' AS status, o_orderdate AS created_at
FROM {orders} WHERE o_orderstatus = 'F'""",
    "jobs": """
SELECT event_id AS id, event_id % 500 AS job_id, user_id AS deal_id, CASE WHEN event_id % 7 <> 0 THEN event_id % 4000 END AS document_id, event_type AS type,
  CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'retrying' END AS status,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 101 AS INT) END AS progress_pct,
  CASE WHEN event_id % 3 <> 0 THEN concat('m', CAST(event_id % 9 AS VARCHAR(8))) END AS message, ts AS updated_at
FROM {events}""",
    "fact_rows": """
SELECT doc_id AS id, doc_id % 20 AS deal_id, text AS claim,
  CASE doc_id % 4 WHEN 0 THEN 'deck.pdf' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'https://example.org/a' ELSE 'notes.txt' END AS source,
  CAST(doc_id * 31 % 108 AS BIGINT) AS confidence_pct, CAST(doc_id % 4 + 1 AS INT) AS created_cycle
FROM {documents}""",
    "cycles": """
SELECT user_id AS deal_id, CAST(event_id % 3 + 1 AS INT) AS cycle_number, CAST(count(*) AS BIGINT) AS findings_count,
  CAST(sum(event_id % 4) AS BIGINT) AS facts_extracted, CAST(min(event_id) % 4 AS BIGINT) AS questions, CAST(max(event_id) % 3 AS BIGINT) AS uncertainties,
  min(event_id) % 2 = 0 AS constraints_met, max(event_id) % 5 <> 0 AS coverage_met, CAST(min(event_id) * 7 % 101 AS BIGINT) AS paraphrase_pct,
  CAST(sum(event_id) % 101 AS BIGINT) AS confidence_pct
FROM {events} GROUP BY user_id, event_id % 3 + 1""",
    "ledgers": """
SELECT c_custkey AS deal_id, CAST(c_custkey % 4 AS BIGINT) AS cycles, CAST(c_custkey * 3 % 7 AS BIGINT) AS subgoals, CAST(c_custkey * 5 % 6 AS BIGINT) AS constraints_checked,
  CAST(c_custkey % 3 AS BIGINT) AS dead_ends, CAST(c_custkey * 11 % 101 AS BIGINT) AS paraphrase_pct, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey * 17 % 51 AS BIGINT) END AS brier_pct,
  CAST(c_custkey * 19 % 121 AS BIGINT) AS depth_tenths
FROM {customer}""",
    "upload_files": """
SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN concat('PD - ', source, ' Labs - Deck v', CAST(doc_id % 5 AS VARCHAR(4)), '.pdf') WHEN 1 THEN concat('BP - ', source, ' - Business Plan.docx')
  WHEN 2 THEN concat(source, ' Raise v2.pptx') WHEN 3 THEN concat('Financials - ', source, ' - 2024.xlsx') WHEN 4 THEN concat('WP - ', source, ' Labs - Whitepaper.pdf')
  WHEN 5 THEN concat('notes ', source, ' v6 (v2).docx') WHEN 6 THEN concat(upper(source), ' Labs Fund overview.PNG') ELSE concat(source, '_v3') END AS filename, CAST(n_chars AS BIGINT) * 30000 AS n_bytes
FROM {documents}""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{([a-z_][a-z_0-9]*)}", sql)))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL whose braces name views or base tables."""
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names(sql)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table's Parquet scan."""
    return frame(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standalone(sql: str) -> str:
    """The same SQL for an engine that has the base tables: views become common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in names(VIEWS[name]):
                visit(n)
            order.append(name)

    for n in names(sql):
        visit(n)
    plain = lambda s: re.sub(r"{([a-z_][a-z_0-9]*)}", r"\1", s)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
