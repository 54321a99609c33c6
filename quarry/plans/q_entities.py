"""Queries over deals, documents, evidence and jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import entities as e
from ..operators import rules as r
from .registry import query
from .sql import half_up, ratio
from .views import names, standalone, view

c = F.col


def q(name: str, tables: str, f: Callable[..., DataFrame], sql: str | None) -> None:
    """Register f over the named views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*(view(spark, sf_dir, t) for t in tables.split()))

    assert sql is None or set(names(sql))
    query(name, sql and standalone(sql))(run)


def ratio_col(name: str) -> Column:
    from ..functions.numbers import ratio as column_ratio

    return column_ratio(c(name), F.lit(100), 2)


POINTS = """CASE WHEN score >= 80 THEN 40 WHEN score >= 70 THEN 30 WHEN score >= 60 THEN 20 WHEN score >= 50 THEN 10 ELSE 0 END
  + CASE WHEN documents >= 4 THEN 25 WHEN documents = 3 THEN 18 WHEN documents = 2 THEN 12 WHEN documents = 1 THEN 6 ELSE 0 END
  + CASE stage WHEN 'pitched' THEN 20 WHEN 'ready_decision' THEN 18 WHEN 'in_diligence' THEN 10 WHEN 'under_review' THEN 5 ELSE 0 END
  + CASE WHEN evidence >= 5 THEN 15 WHEN evidence >= 3 THEN 10 WHEN evidence >= 1 THEN 5 ELSE 0 END"""
METRICS = """m AS (SELECT d.*, (SELECT count(*) FROM {deal_documents} x WHERE x.deal_id = d.id) AS documents, (SELECT count(*) FROM {evidence} y WHERE y.deal_id = d.id) AS evidence
  FROM {deals} d WHERE NOT deleted)"""
PRIORITY = "CASE WHEN points >= 70 THEN 'high' WHEN points >= 40 THEN 'medium' ELSE 'low' END"

q("r01_valid_deals", "deals", lambda d: e.valid_deals(d.withColumn("stage", F.when(c("id") % 10 == 0, "closed").otherwise(c("stage")))).groupBy("stage", "priority").agg(F.count("*").alias("n")),
  "SELECT stage, priority, count(*) AS n FROM {deals} WHERE id % 10 <> 0 GROUP BY 1, 2")
q("r02_live_deals", "deals", lambda d: e.live_deals(d).select("id", "name", "created_at"), "SELECT id, name, created_at FROM {deals} WHERE NOT deleted")
q("r03_deal_with_version", "deals dio_versions", e.deal_with_version, """SELECT d.id, d.name, d.stage, v.version, v.id AS version_id FROM {deals} d
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY version DESC) AS k FROM {dio_versions}) v ON v.deal_id = d.id AND k = 1 WHERE NOT d.deleted""")
q("r04_patched_deals", "deals", lambda d: e.patch(d, d.filter("id % 3 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("string").alias("owner")), "id", ["name", "owner"], ~c("deleted")).select("id", "name", "owner"),
  "SELECT id, CASE WHEN id % 3 = 0 AND NOT deleted THEN concat('new ', name) ELSE name END AS name, owner FROM {deals}")
q("r05_soft_delete", "deals", lambda d: e.soft_delete(d, d.filter("id % 5 = 0").select("id")).groupBy("deleted").agg(F.count("*").alias("n")), "SELECT deleted OR id % 5 = 0 AS deleted, count(*) AS n FROM {deals} GROUP BY 1")
q("r06_accepted_requests", "deals dio_versions", lambda d, v: e.accepted(v.select("deal_id", c("id").alias("request")), d).groupBy("status").agg(F.count("*").alias("n")),
  "SELECT CASE WHEN NOT d.deleted THEN 202 ELSE 404 END AS status, count(*) AS n FROM {dio_versions} v LEFT JOIN {deals} d ON d.id = v.deal_id GROUP BY 1")
q("r07_deal_rows", "deals", lambda d: e.live(d).select(c("id").cast("string").alias("deal_id"), "name", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("score", F.lit(0)).alias("score")),
  "SELECT CAST(id AS VARCHAR(20)) AS deal_id, name, coalesce(owner, '') AS owner, coalesce(score, 0) AS score FROM {deals} WHERE NOT deleted")
UP = "uploads AS (SELECT o_custkey AS deal_id, upper(concat('Doc ', CAST(o_orderkey % 70 AS VARCHAR(8)))) AS title, o_orderkey AS upload FROM {orders} WHERE o_orderkey % 9 = 0)"
HAVE = "EXISTS (SELECT 1 FROM {deal_documents} x WHERE x.deal_id = u.deal_id AND lower(x.title) = lower(u.title))"


def _uploads(o: DataFrame) -> DataFrame:
    return o.filter("o_orderkey % 9 = 0").select(c("o_custkey").alias("deal_id"), F.upper(F.concat(F.lit("Doc "), (c("o_orderkey") % 70).cast("string"))).alias("title"), c("o_orderkey").alias("upload"))


q("r08_upload_conflicts", "orders deal_documents", lambda o, d: e.upload_conflicts(_uploads(o), d), f"WITH {UP} SELECT * FROM uploads u WHERE {HAVE}")
q("r08_uploads_accepted", "orders deal_documents", lambda o, d: e.uploads_accepted(_uploads(o), d), f"WITH {UP} SELECT * FROM uploads u WHERE NOT {HAVE}")
q("r09_document_types", "events", lambda v: v.select(e.document_type(F.when(c("event_id") % 3 == 0, "legal").otherwise(c("event_type"))).alias("type")).groupBy("type").agg(F.count("*").alias("n")),
  "SELECT CASE WHEN event_id % 3 = 0 THEN 'legal' ELSE 'other' END AS type, count(*) AS n FROM {events} GROUP BY 1")
q("r10_documents_of_deal", "deal_documents", lambda d: d.filter("deal_id = 7").orderBy(F.desc("uploaded_at")).select("document_id", "title", "uploaded_at"), "SELECT document_id, title, uploaded_at FROM {deal_documents} WHERE deal_id = 7")
q("r11_document_with_job", "deal_documents jobs", e.document_with_job, """SELECT d.document_id, d.deal_id, d.title, j.id AS job, j.status AS job_status, j.message AS job_message, j.progress_pct AS job_progress FROM {deal_documents} d
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, id DESC) AS k FROM {jobs}) j ON j.document_id = d.document_id AND k = 1""")
q("r12_retried", "deal_documents", lambda d: e.retried(d).groupBy("status", "type").agg(F.count("*").alias("n")), "SELECT 'pending' AS status, type, count(*) AS n FROM {deal_documents} WHERE status <> 'completed' GROUP BY 1, 2")
q("r12_retry_jobs", "deal_documents", lambda d: e.retry_jobs(d, F.lit("2024-06-01").cast("timestamp_ntz")), "SELECT document_id, deal_id, 'ingest' AS type, 'queued' AS status, TIMESTAMP '2024-06-01 00:00:00' AS updated_at FROM {deal_documents} WHERE status <> 'completed'")
q("r13_deals_by_name", "deals", lambda d: d.select("id", "name").orderBy("name", "id"), "SELECT id, name FROM {deals}")
q("r14_bulk_assign", "upload_files deals", lambda u, d: e.bulk_assign(u.select("filename", F.when(c("doc_id") % 3 != 0, c("doc_id")).alias("deal_id"), F.when(c("doc_id") % 6 != 0, c("filename")).alias("new_name")), d).groupBy("outcome").agg(F.count("*").alias("n")),
  """SELECT CASE WHEN d.id IS NOT NULL THEN 'assigned' WHEN u.doc_id % 3 = 0 AND u.doc_id % 6 <> 0 THEN 'created' ELSE 'error' END AS outcome, count(*) AS n
  FROM {upload_files} u LEFT JOIN {deals} d ON d.id = u.doc_id AND u.doc_id % 3 <> 0 AND NOT d.deleted GROUP BY 1""")
q("r15_ingestion_status", "deal_documents", e.ingestion_status, """SELECT *, CASE WHEN pending > 0 THEN 'in_progress' WHEN failed > 0 THEN 'failed' WHEN warnings > 0 THEN 'needs_review' ELSE 'ready' END AS readiness FROM (
  SELECT deal_id, count(*) AS documents, count(*) FILTER (WHERE verification_status = 'verified') AS verified, count(*) FILTER (WHERE verification_status = 'warnings') AS warnings,
  count(*) FILTER (WHERE verification_status = 'failed') AS failed, count(*) FILTER (WHERE verification_status IS NULL) AS pending, CAST(sum(page_count) AS BIGINT) AS pages FROM {deal_documents} GROUP BY 1) x""")
def _verifiable(d: DataFrame) -> DataFrame:
    """Documents with what was read in them; lists are missing, empty or short, and some have no data or no result."""
    some = lambda n, x: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(x), i.cast("string")))).when(n == 0, F.array().cast("array<string>"))
    data = F.struct(some((c("document_id") % 8 - 1).cast("int"), "m").alias("keyMetrics"), some((c("document_id") % 6 - 1).cast("int"), "h").alias("mainHeadings"))
    result = F.when(c("quality_pct").isNotNull(), F.to_json(F.struct(c("quality_pct").alias("overall_score"))))
    return d.withColumn("structured_data", F.when(c("document_id") % 9 > 0, data)).withColumn("verification_result", result)


q("r16_verification_detail", "deal_documents", lambda d: an.verification_detail(_verifiable(d)), """SELECT deal_id, document_id, title, type, status, coalesce(verification_status, 'pending') AS verification_status, coalesce(page_count, 0) AS pages,
  CASE WHEN document_id % 9 = 0 THEN 0 ELSE greatest(document_id % 8 - 1, 0) END AS metrics_extracted, CASE WHEN document_id % 9 = 0 THEN 0 ELSE greatest(document_id % 6 - 1, 0) END AS sections_found,
  CASE WHEN quality_pct IS NULL THEN '{"message":"Verification in progress or not yet started"}' ELSE concat('{"overall_score":', quality_pct, '}') END AS verification_result FROM {deal_documents}""")


def _snapshot(g: DataFrame) -> DataFrame:
    """Planners and ledgers of deals, of which some have the one or the other alone."""
    i = c("deal_id")
    planner = F.struct((i % 4).alias("cycle"), F.array(F.lit("g")).alias("goals"), F.array().alias("constraints"), F.array(F.concat(F.lit("h"), i.cast("string"))).alias("hypotheses"), F.array().alias("subgoals"), F.lit("old").alias("focus"), F.when(i % 3 == 0, "stop").alias("stop_reason"))
    ledger = F.struct(c("cycles"), F.array((c("depth_tenths") / 10).cast("double")).alias("depth_delta"), c("subgoals"), c("constraints_checked").alias("constraints"), c("dead_ends"), (c("paraphrase_pct") / 100).alias("paraphrase_invariance"), (c("brier_pct") / 100).alias("brier"))
    return g.select("deal_id", F.when(i % 5 > 0, planner.cast(an.PLANNER)).alias("planner"), F.when(i % 7 > 0, ledger.cast(an.LEDGER)).alias("ledger"))


def _packs(o: DataFrame) -> DataFrame:
    """Decision packs from orders: risks by priority and status, for every fifth order none."""
    risk = lambda x: F.struct(x.alias("risk"), F.lit("high").alias("severity"))
    risks = F.when(c("o_orderkey") % 5 > 0, F.array(risk(c("o_orderpriority")), risk(c("o_orderstatus"))))
    return o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("deal_id"), c("o_orderdate").alias("created_at"), F.lit("go").alias("go_no_go"), F.lit(None).cast("array<string>").alias("tranche_plan"), risks.alias("risk_map"), F.array(F.lit("v")).alias("what_to_verify"))


_BEGUN = f"""SELECT deal_id, 1 AS cycle, {len(an.GOALS)} AS goals, '{an.FOCUS}' AS focus, CAST(NULL AS VARCHAR) AS stop_reason, 0 AS cycles, CASE WHEN deal_id % 7 > 0 THEN subgoals ELSE 0 END AS subgoals, 1e0 AS invariance FROM {{ledgers}} WHERE deal_id % 3 = 1
  UNION ALL SELECT deal_id, CASE WHEN deal_id % 5 > 0 THEN deal_id % 4 END, CASE WHEN deal_id % 5 > 0 THEN 1 END, CASE WHEN deal_id % 5 > 0 THEN 'old' END, CASE WHEN deal_id % 5 > 0 AND deal_id % 3 = 0 THEN 'stop' END,
  CASE WHEN deal_id % 7 > 0 THEN cycles END, CASE WHEN deal_id % 7 > 0 THEN subgoals END, CASE WHEN deal_id % 7 > 0 THEN CAST(paraphrase_pct AS DOUBLE) / 100 END FROM {{ledgers}} WHERE deal_id % 3 <> 1"""
q("r36_begin_analyses", "ledgers", lambda g: an.begin(_snapshot(g), g.filter("deal_id % 3 = 1")).select("deal_id", c("planner.cycle").alias("cycle"), F.array_size("planner.goals").alias("goals"), c("planner.focus").alias("focus"), c("planner.stop_reason").alias("stop_reason"), c("ledger.cycles").alias("cycles"), c("ledger.subgoals").alias("subgoals"), c("ledger.paraphrase_invariance").alias("invariance")), _BEGUN)


def _changes(g: DataFrame) -> DataFrame:
    """Three changes of every other deal: an early one of both, a later one of the planner, one of the ledger between them."""
    made = lambda k: F.struct((c("deal_id") % 3 + k).alias("cycle"), F.array(F.concat(F.lit("a\x01"), F.lit("b"))).alias("goals"), F.array().alias("constraints"), F.array().alias("hypotheses"), F.array().alias("subgoals"), F.lit(f"new{k}").alias("focus"), F.lit(None).alias("stop_reason")).cast(an.PLANNER)
    done = lambda k: an.first_ledger().withField("cycles", F.lit(k).cast("long"))
    rows = F.array(*[F.struct(F.lit(at).alias("at"), p.alias("planner"), x.alias("ledger")) for at, p, x in ((3, made(3), F.lit(None).cast(an.LEDGER)), (1, made(1), done(11)), (2, F.lit(None).cast(an.PLANNER), done(12)))])
    return g.filter("deal_id % 2 = 0").select("deal_id", F.explode(rows).alias("x")).select("deal_id", "x.*")


q("r36_save_analyses", "ledgers", lambda g: an.saved(_snapshot(g), _changes(g)).select("deal_id", c("planner.cycle").alias("cycle"), F.get("planner.goals", F.lit(0)).alias("goal"), c("planner.focus").alias("focus"), c("ledger.cycles").alias("cycles")),
  """SELECT deal_id, CASE WHEN deal_id % 2 = 0 THEN deal_id % 3 + 3 WHEN deal_id % 5 > 0 THEN deal_id % 4 END AS cycle, CASE WHEN deal_id % 2 = 0 THEN 'a b' WHEN deal_id % 5 > 0 THEN 'g' END AS goal, CASE WHEN deal_id % 2 = 0 THEN 'new3' WHEN deal_id % 5 > 0 THEN 'old' END AS focus,
  CASE WHEN deal_id % 2 = 0 THEN 12 WHEN deal_id % 7 > 0 THEN cycles END AS cycles FROM {ledgers}""")
_FACTS = "SELECT deal_id, count(*) AS n, CAST(sum(confidence_pct) AS DOUBLE) / count(*) AS m FROM {fact_rows} GROUP BY 1"
_LAST = "SELECT o_custkey AS deal_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM {orders} GROUP BY 1"
q("r37_states", "ledgers fact_rows orders", lambda g, f, o: an.states(_snapshot(g), f, _packs(o)).select("deal_id", "current_cycle", c("ledger.cycles").alias("cycles"), c("ledger.paraphrase_invariance").alias("invariance"), c("ledger.brier").alias("brier"), c("pack.id").alias("pack_id"), F.array_size("pack.tranche_plan").alias("tranches"), "n_facts", "confidence", "risks"),
  f"""SELECT g.deal_id, CASE WHEN g.deal_id % 4 > 0 THEN CAST(g.deal_id % 4 AS INT) END AS current_cycle, CASE WHEN g.deal_id % 7 > 0 THEN cycles ELSE 0 END AS cycles, CASE WHEN g.deal_id % 7 > 0 AND paraphrase_pct > 0 THEN CAST(paraphrase_pct AS DOUBLE) / 100 ELSE 1e0 END AS invariance,
  CASE WHEN g.deal_id % 7 > 0 AND brier_pct > 0 THEN CAST(brier_pct AS DOUBLE) / 100 ELSE 0e0 END AS brier, k AS pack_id, CASE WHEN k IS NOT NULL THEN 0 END AS tranches, coalesce(n, 0) AS n_facts, coalesce({half_up('m')}, 0e0) AS confidence,
  CASE WHEN k % 5 > 0 THEN [p, s] ELSE [] END AS risks FROM {{ledgers}} g LEFT JOIN ({_FACTS}) f ON f.deal_id = g.deal_id LEFT JOIN ({_LAST}) l ON l.deal_id = g.deal_id WHERE g.deal_id % 5 > 0""")
q("r37_facts_in_order", "fact_rows ledgers", lambda f, g: an.facts_in_order(f, _snapshot(g)).select("deal_id", "id", "place"),
  "SELECT deal_id, id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY created_cycle, id) AS INT) AS place FROM {fact_rows} WHERE deal_id % 5 > 0 AND deal_id IN (SELECT deal_id FROM {ledgers})")
q("r17_evidence_list", "evidence deals", lambda v, d: e.evidence_list(v, d).select("deal_id", "evidence_id", "rank"), """SELECT deal_id, evidence_id, CAST(rank AS INT) AS rank FROM (SELECT v.deal_id, v.evidence_id,
  row_number() OVER (PARTITION BY v.deal_id ORDER BY v.created_at DESC, v.evidence_id DESC) AS rank FROM {evidence} v WHERE v.deal_id IN (SELECT id FROM {deals} WHERE NOT deleted)) x WHERE rank <= 50""")
q("r18_evidence_requests", "deals", lambda d: e.accepted(d.select(c("id").alias("deal_id")), d), "SELECT id AS deal_id, CASE WHEN deleted THEN 404 ELSE 202 END AS status FROM {deals}")
q("r19_evidence_rows", "evidence", lambda v: e.with_default_confidence(v.withColumn("confidence", F.when(c("evidence_id") % 2 == 0, c("confidence_pct") / 100.0))).groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("confidence") == 0.5).alias("half")),
  "SELECT source, count(*) AS n, count(*) FILTER (WHERE evidence_id % 2 <> 0 OR confidence_pct = 50) AS half FROM {evidence} GROUP BY 1")
q("r20_documents_with_evidence", "evidence", e.documents_with_evidence, "SELECT DISTINCT document_id FROM {evidence} WHERE source = 'fetch_evidence'")
q("r20_documents_without_evidence", "deal_documents evidence", lambda d, v: e.documents_without_evidence(d, v).select("document_id"), "SELECT document_id FROM {deal_documents} WHERE document_id NOT IN (SELECT document_id FROM {evidence} WHERE source = 'fetch_evidence')")
q("r21_latest_documents", "deal_documents", lambda d: e.top_per(d, "deal_id", 100, F.desc("uploaded_at"), F.desc("document_id")).select("deal_id", "document_id"),
  "SELECT deal_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY uploaded_at DESC, document_id DESC) AS k FROM {deal_documents}) x WHERE k <= 100")
q("r22_documents_by_ids", "deal_documents evidence", lambda d, v: e.by_ids(d, v.filter("confidence_pct = 97").select("document_id")).select("document_id", "title"),
  "SELECT document_id, title FROM {deal_documents} WHERE document_id IN (SELECT document_id FROM {evidence} WHERE confidence_pct = 97)")
q("r23_document_analysis", "deal_documents", lambda d: e.patch(d, d.filter("document_id % 4 = 1").select("document_id", F.lit("completed").alias("status"), F.when(c("document_id") % 8 == 1, F.lit(99)).alias("page_count")), "document_id", ["status", "page_count"]).groupBy("status").agg(F.count("*").alias("n"), F.sum("page_count").alias("pages")),
  "SELECT CASE WHEN document_id % 4 = 1 THEN 'completed' ELSE status END AS status, count(*) AS n, CAST(sum(CASE WHEN document_id % 8 = 1 THEN 99 ELSE page_count END) AS BIGINT) AS pages FROM {deal_documents} GROUP BY 1")
q("r24_document_status", "deal_documents", lambda d: e.patch(d, d.filter("status = 'pending'").select("document_id", F.lit("processing").alias("status")), "document_id", ["status"]).groupBy("status").agg(F.count("*").alias("n")),
  "SELECT CASE WHEN status = 'pending' THEN 'processing' ELSE status END AS status, count(*) AS n FROM {deal_documents} GROUP BY 1")
q("r25_document_verification", "deal_documents", lambda d: e.patch(d, d.filter("verification_status is null").select("document_id", F.lit("warnings").alias("verification_status")), "document_id", ["verification_status"]).groupBy("verification_status").agg(F.count("*").alias("n")),
  "SELECT coalesce(verification_status, 'warnings') AS verification_status, count(*) AS n FROM {deal_documents} GROUP BY 1")
q("r26_insert_reports", "deals", lambda d: e.insert_ignore(d.filter("id % 2 = 0").select("id", "name"), d.filter("id % 3 = 0").select("id", F.upper("name").alias("name")), ["id"]),
  "SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE upper(name) END AS name FROM {deals} WHERE id % 2 = 0 OR id % 3 = 0")
q("r27_job_updates", "jobs", lambda j: j.filter("job_id = 42").select("id", "status", "progress_pct"), "SELECT id, status, progress_pct FROM {jobs} WHERE job_id = 42")
q("r28_job_state", "jobs", e.job_state, """SELECT job_id, max_by(status, k) AS status, max_by(progress_pct, k) FILTER (WHERE progress_pct IS NOT NULL) AS progress_pct, max_by(message, k) FILTER (WHERE message IS NOT NULL) AS message,
  max(updated_at) AS updated_at, count(*) AS updates FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at, id) AS k FROM {jobs}) x GROUP BY 1""")
q("r29_poll", "jobs", lambda j: e.poll(j, "2024-01-10 00:00:00", 50).select("id", "job_id", "updated_at"), "SELECT id, job_id, updated_at FROM {jobs} WHERE updated_at > TIMESTAMP '2024-01-10 00:00:00' ORDER BY updated_at, id LIMIT 50")
q("r30_citations", "evidence", lambda v: e.citations(v).select("deal_id", "evidence_id", F.coalesce("excerpt", "text").alias("excerpt")),
  "SELECT deal_id, evidence_id, coalesce(excerpt, text) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY created_at DESC, evidence_id DESC) AS k FROM {evidence}) x WHERE k <= 3")
q("r30_latest_versions", "dio_versions", e.latest_version, "SELECT deal_id, id, version, status FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY version DESC NULLS LAST, id DESC) AS k FROM {dio_versions}) x WHERE k = 1")
q("r31_deal_metrics", "deals deal_documents evidence", lambda d, x, v: e.deal_metrics(d, x, v).select("id", "score", "documents", "evidence"), f"WITH {METRICS} SELECT id, score, documents, evidence FROM m")
q("r32_priority_tally", "deals deal_documents evidence", lambda d, x, v: e.reprioritised(e.deal_metrics(d, x, v)).groupBy("new_priority").agg(F.count("*").alias("n")),
  f"WITH {METRICS}, p AS (SELECT {POINTS} AS points FROM m) SELECT {PRIORITY} AS new_priority, count(*) AS n FROM p GROUP BY 1")
q("r33_stage_inputs", "deals deal_documents evidence dio_versions", lambda d, x, v, w: e.stage_inputs(e.deal_metrics(d, x, v), w, F.lit("2025-01-01").cast("date")),
  f"WITH {METRICS} SELECT id, stage, score, documents, evidence, id IN (SELECT deal_id FROM {{dio_versions}}) AS analysed, CAST(date_diff('day', updated_at, DATE '2025-01-01') AS BIGINT) AS days FROM m")
NEXT = """CASE WHEN stage = 'intake' AND analysed THEN 'under_review' WHEN stage = 'under_review' AND analysed AND documents >= 2 THEN 'in_diligence'
  WHEN stage = 'in_diligence' AND score >= 70 AND evidence >= 2 THEN 'ready_decision' ELSE stage END"""
CHANGES = f"{METRICS}, s AS (SELECT m.*, id IN (SELECT deal_id FROM {{dio_versions}}) AS analysed FROM m), t AS (SELECT id, stage AS old, {NEXT} AS new FROM s)"
q("r34_stage_then_priority", "deals deal_documents evidence dio_versions", lambda d, x, v, w: e.progressed(e.deal_metrics(d, x, v), w),
  f"WITH {CHANGES}, u AS (SELECT t.id, old, new, documents, evidence, score, new AS stage FROM t JOIN m ON m.id = t.id WHERE old <> new), p AS (SELECT id, old, new, {POINTS} AS points FROM u) SELECT id, old, new, {PRIORITY} AS priority FROM p")
q("r35_stage_changes", "deals deal_documents evidence dio_versions", lambda d, x, v, w: e.stage_changes(e.deal_metrics(d, x, v), w), f"WITH {CHANGES} SELECT * FROM t WHERE old <> new")
q("r36_upsert_ledgers", "ledgers", lambda g: e.upsert(g, g.filter("deal_id % 4 = 0").withColumn("cycles", c("cycles") + 1), ["deal_id"]).select("deal_id", "cycles"), "SELECT deal_id, CASE WHEN deal_id % 4 = 0 THEN cycles + 1 ELSE cycles END AS cycles FROM {ledgers}")
q("r37_analysis_state", "deals fact_rows ledgers", e.analysis_state, """SELECT f.deal_id, f.fact_ids, g.cycles, coalesce(g.paraphrase_pct, 100) AS paraphrase_pct, coalesce(g.brier_pct, 0) AS brier_pct
  FROM (SELECT deal_id, list(id ORDER BY created_cycle, id) AS fact_ids FROM {fact_rows} GROUP BY 1) f LEFT JOIN {ledgers} g ON g.deal_id = f.deal_id""")
q("r38_insert_facts", "fact_rows", lambda f: e.insert_ignore(f.filter("id % 2 = 0").select("id", "deal_id", "claim", "created_cycle"), f.select("id", "deal_id", "claim", "created_cycle"), ["deal_id", "claim", "created_cycle"]).select("id", "deal_id"),
  """SELECT id, deal_id FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, claim, created_cycle ORDER BY id) AS k FROM {fact_rows} f
  WHERE NOT EXISTS (SELECT 1 FROM {fact_rows} g WHERE g.id % 2 = 0 AND g.deal_id = f.deal_id AND g.claim = f.claim AND g.created_cycle = f.created_cycle)) x WHERE k = 1 UNION ALL SELECT id, deal_id FROM {fact_rows} WHERE id % 2 = 0""")
q("r39_start_checks", "deals deal_documents", e.start_checks, """SELECT id, documents, decks, list_filter([CASE WHEN deleted THEN 'the deal doesn''t exist' END, CASE WHEN documents = 0 THEN 'a document is needed' END,
  CASE WHEN documents > 0 AND decks = 0 THEN 'a pitch deck is needed' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT d.id, d.deleted, count(x.document_id) AS documents,
  count(x.document_id) FILTER (WHERE x.type IN ('pitch_deck', 'other')) AS decks FROM {deals} d LEFT JOIN {deal_documents} x ON x.deal_id = d.id GROUP BY 1, 2) y""")
q("r40_legacy_stages", "deals", lambda d: d.select("id", r.remap_stage(F.when(c("id") % 4 == 0, "idea").when(c("id") % 4 == 1, "progress").when(c("id") % 4 == 2, "ready").otherwise(c("stage"))).alias("stage")),
  "SELECT id, CASE id % 4 WHEN 0 THEN 'intake' WHEN 1 THEN 'in_diligence' WHEN 2 THEN 'ready_decision' ELSE stage END AS stage FROM {deals}")


# Rules

CY = "paraphrase_pct / 100e0"
DEPTH = """least((CASE WHEN findings_count >= 5 THEN 3 WHEN findings_count >= 3 THEN 2 WHEN findings_count >= 1 THEN 1 ELSE 0 END + CASE WHEN facts_extracted >= 10 THEN 2 WHEN facts_extracted >= 5 THEN 1 ELSE 0 END
  + CASE WHEN questions > 0 THEN 2 ELSE 0 END + CASE WHEN uncertainties > 0 THEN 2 ELSE 0 END + CASE WHEN constraints_met THEN 1 ELSE 0 END + CASE WHEN coverage_met THEN 1 ELSE 0 END) / 11e0 * 10e0, 10e0)"""


def _depth() -> Column:
    return r.depth(c("findings_count"), c("facts_extracted"), c("questions"), c("uncertainties"), c("constraints_met"), c("coverage_met"))


def _par() -> Column:
    return c("paraphrase_pct") / F.lit(100.0)


q("s01_priority_points", "deals deal_documents evidence", lambda d, x, v: e.reprioritised(e.deal_metrics(d, x, v)).select("id", c("points").cast("int").alias("points"), "new_priority"),
  f"WITH {METRICS}, p AS (SELECT id, {POINTS} AS points FROM m) SELECT id, CAST(points AS INT) AS points, {PRIORITY} AS new_priority FROM p")
q("s02_next_stage", "deals", lambda d: d.select("id", r.next_stage(c("stage"), c("id") % 2 == 0, c("id") % 4, c("score"), c("id") % 5).alias("stage")),
  "SELECT id, CASE WHEN stage = 'intake' AND id % 2 = 0 THEN 'under_review' WHEN stage = 'under_review' AND id % 2 = 0 AND id % 4 >= 2 THEN 'in_diligence' WHEN stage = 'in_diligence' AND score >= 70 AND id % 5 >= 2 THEN 'ready_decision' ELSE stage END AS stage FROM {deals}")
q("s03_depth", "cycles", lambda y: y.select("deal_id", "cycle_number", r.half_up(_depth(), 6).alias("depth"), r.depth_continues(c("constraints_met"), c("coverage_met"), _par()).alias("goes_on")),
  f"SELECT deal_id, cycle_number, {half_up(DEPTH, 6)} AS depth, NOT constraints_met OR NOT coverage_met OR {CY} < 0.75e0 AS goes_on FROM {{cycles}}")
q("s04_depth_reason", "cycles", lambda y: y.select("deal_id", "cycle_number", r.depth_reason(c("questions"), c("uncertainties"), c("constraints_met"), c("coverage_met"), _par()).alias("reason")),
  f"""SELECT deal_id, cycle_number, CASE WHEN len(l) = 0 THEN 'Depth adequate' ELSE concat('Depth insufficient: ', array_to_string(l, '; ')) END AS reason FROM (SELECT deal_id, cycle_number, list_filter([CASE WHEN questions = 0 THEN 'no key questions' END,
  CASE WHEN uncertainties = 0 THEN 'uncertainties unmapped' END, CASE WHEN NOT constraints_met THEN 'constraints unclear' END, CASE WHEN NOT coverage_met THEN 'thin evidence' END, CASE WHEN {CY} < 0.75e0 THEN 'answers vary' END], lambda x: x IS NOT NULL) AS l FROM {{cycles}}) y""")
q("s05_next_cycle", "cycles", lambda y: y.select("deal_id", "cycle_number", r.next_cycle(c("cycle_number"), c("questions") * 1.0, c("coverage_met")).alias("next")),
  "SELECT deal_id, cycle_number, CASE WHEN cycle_number >= 3 OR (questions < 2 AND NOT coverage_met) THEN 'synthesize' ELSE CAST(cycle_number + 1 AS VARCHAR(8)) END AS next FROM {cycles}")
q("s06_stop_reason", "cycles", lambda y: y.select("deal_id", "cycle_number", r.stop_reason(c("uncertainties"), c("cycle_number"), _par()).alias("stop")),
  f"SELECT deal_id, cycle_number, CASE WHEN uncertainties > 0 THEN 'errors' WHEN cycle_number >= 3 THEN 'max_cycles' WHEN {CY} < 0.5e0 THEN 'inconsistent' END AS stop FROM {{cycles}}")
q("s07_overall_confidence", "cycles", lambda y: y.select("deal_id", "cycle_number", r.half_up(r.overall_confidence(c("confidence_pct") / F.lit(100.0), _depth(), _par(), c("facts_extracted")), 6).alias("confidence")),
  f"SELECT deal_id, cycle_number, {half_up(f'CASE WHEN facts_extracted = 0 THEN 0e0 ELSE least(greatest(0.5e0 * (confidence_pct / 100e0) + 0.3e0 * {DEPTH} / 10e0 + 0.2e0 * ({CY}), 0e0), 1e0) END', 6)} AS confidence FROM {{cycles}}")
q("s08_cycle_summary", "cycles", lambda y: y.select("deal_id", "cycle_number", r.cycle_summary(c("cycle_number"), c("facts_extracted") * 10, c("findings_count"), c("facts_extracted"), c("findings_count") / F.lit(8.0), c("coverage_met")).alias("summary")),
  """SELECT deal_id, cycle_number, concat('Cycle ', CAST(cycle_number AS VARCHAR(8)), ' completed in ', CAST(facts_extracted * 10 AS VARCHAR(20)), 'ms | Findings: ', CAST(findings_count AS VARCHAR(20)), ' | Facts: ', CAST(facts_extracted AS VARCHAR(20)),
  ' | Depth: ', CAST(CAST(floor(findings_count / 0.8e0 + 0.5e0) AS BIGINT) // 10 AS VARCHAR(20)), '.', CAST(CAST(floor(findings_count / 0.8e0 + 0.5e0) AS BIGINT) % 10 AS VARCHAR(4)), '/10 | Continue: ', CASE WHEN coverage_met THEN 'true' ELSE 'false' END) AS summary FROM {cycles}""")
q("s09_cycle_errors", "cycles", lambda y: y.select("deal_id", "cycle_number", r.cycle_errors(c("cycle_number") + c("uncertainties") - 1, F.when(c("questions") == 0, "").when(c("questions") == 1, "failure").otherwise("success"), F.when(c("coverage_met"), F.lit("x")), F.when(c("constraints_met"), F.lit(1.0)), c("uncertainties") - 1, F.when(c("uncertainties") == 2, "e")).alias("errors")),
  """SELECT deal_id, cycle_number, list_filter([CASE WHEN cycle_number + uncertainties - 1 < 1 OR cycle_number + uncertainties - 1 > 3 THEN 'cycle must be 1 to 3' END, CASE WHEN questions = 0 THEN 'a status is needed' END, CASE WHEN NOT coverage_met THEN 'a worker output is needed' END,
  CASE WHEN NOT constraints_met THEN 'a depth is needed' END, CASE WHEN uncertainties < 1 THEN 'duration must not be negative' END, CASE WHEN questions = 1 AND uncertainties <> 2 THEN 'a failure needs its error' END], lambda x: x IS NOT NULL) AS errors FROM {cycles}""")
q("s10_progression", "cycles", lambda y: r.progression(y.withColumn("confidence", c("confidence_pct"))).select("deal_id", "cycle_number", "findings_delta", "facts_delta", "confidence_delta", "depth_delta", "goes_on"),
  """SELECT deal_id, cycle_number, d AS findings_delta, f AS facts_delta, k AS confidence_delta, CASE WHEN d > 0 THEN least(10e0, 2e0 + 0.5e0 * d) ELSE 1.5e0 END AS depth_delta, coalesce(d > 0 AND k >= -0.05, false) AS goes_on
  FROM (SELECT *, findings_count - lag(findings_count) OVER w AS d, facts_extracted - lag(facts_extracted) OVER w AS f, confidence_pct - lag(confidence_pct) OVER w AS k FROM {cycles} WINDOW w AS (PARTITION BY deal_id ORDER BY cycle_number)) x""")
q("s11_cycles_remaining", "cycles", lambda y: y.select("deal_id", "cycle_number", r.cycles_remaining(c("cycle_number"), c("confidence_pct") / F.lit(100.0)).alias("remaining")),
  "SELECT deal_id, cycle_number, CASE WHEN confidence_pct / 100e0 >= 0.7e0 THEN CASE WHEN cycle_number >= 3 THEN 0 ELSE 1 END ELSE greatest(3 - cycle_number, 0) END AS remaining FROM {cycles}")
q("s12_cycle_log", "cycles", lambda y: y.select("deal_id", r.cycle_log(F.lit("2024-06-01T00:00:00.000Z"), c("cycle_number"), c("facts_extracted") * 10, c("findings_count"), c("facts_extracted"), c("confidence_pct") / F.lit(100.0), c("findings_count") / F.lit(8.0)).alias("entry")),
  """SELECT deal_id, concat('[CYCLE ', CAST(cycle_number AS VARCHAR(4)), '] <"timestamp":"2024-06-01T00:00:00.000Z","cycle":', CAST(cycle_number AS VARCHAR(4)), ',"duration_ms":', CAST(facts_extracted * 10 AS VARCHAR(20)), ',"findings_count":', CAST(findings_count AS VARCHAR(20)),
  ',"facts_count":', CAST(facts_extracted AS VARCHAR(20)), ',"confidence_score":"', CASE WHEN confidence_pct = 100 THEN '1.00' ELSE concat('0.', lpad(CAST(confidence_pct AS VARCHAR(4)), 2, '0')) END, '","depth_metric":"', CAST(CAST(floor(findings_count / 0.8e0 + 0.5e0) AS BIGINT) // 10 AS VARCHAR(20)), '.',
  CAST(CAST(floor(findings_count / 0.8e0 + 0.5e0) AS BIGINT) % 10 AS VARCHAR(4)), '">') AS entry FROM {cycles}""".replace("<", chr(123)).replace(">", chr(125)))
q("s13_empty_ledgers", "deals", lambda d: d.select("id", F.lit(0).alias("cycles"), F.lit(0).alias("facts"), F.lit(1.0).alias("paraphrase")), "SELECT id, 0 AS cycles, 0 AS facts, 1e0 AS paraphrase FROM {deals}")
FACT_ERRORS = """list_filter([CASE WHEN coalesce(length(claim) < 10, true) THEN 'claim too short' END, CASE WHEN length(claim) > 200 THEN 'claim too long' END,
  CASE WHEN NOT (source IN ('deck.pdf', 'uncertain') OR starts_with(source, 'http')) THEN 'source must be deck.pdf, uncertain or a link' END,
  CASE WHEN confidence_pct < 0 THEN 'confidence below 0' END, CASE WHEN confidence_pct > 100 THEN 'confidence above 1' END, CASE WHEN created_cycle < 1 OR created_cycle > 3 THEN 'cycle must be 1 to 3' END], lambda x: x IS NOT NULL)"""


def _facts(f: DataFrame) -> DataFrame:
    return f.withColumn("confidence", c("confidence_pct") / F.lit(100.0))


q("s14_fact_errors", "fact_rows", lambda f: _facts(f).select("id", r.fact_errors(c("claim"), c("source"), c("confidence"), c("created_cycle")).alias("errors")), f"SELECT id, {FACT_ERRORS} AS errors FROM {{fact_rows}}")
q("s15_add_facts", "fact_rows", lambda f: r.add_facts(_facts(f)).select("id", "deal_id"), f"SELECT id, deal_id FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, claim, created_cycle ORDER BY id) AS k FROM {{fact_rows}} WHERE len({FACT_ERRORS}) = 0) x WHERE k = 1")
q("s16_update_confidence", "fact_rows", lambda f: r.update_confidence(_facts(f).select("id", "confidence"), f.filter("id % 2 = 0").select("id", (c("confidence_pct") / F.lit(50.0) - F.lit(0.5)).alias("confidence"))),
  "SELECT id, CASE WHEN id % 2 = 0 THEN least(greatest(confidence_pct / 50e0 - 0.5e0, 0e0), 1e0) ELSE confidence_pct / 100e0 END AS confidence FROM {fact_rows}")
q("s17_facts_by_cycle", "fact_rows", lambda f: f.filter("created_cycle = 2").select("id"), "SELECT id FROM {fact_rows} WHERE created_cycle = 2")
q("s18_confident_facts", "fact_rows", lambda f: _facts(f).filter("confidence >= 0.7").select("id"), "SELECT id FROM {fact_rows} WHERE confidence_pct >= 70")
q("s19_facts_by_source", "fact_rows", lambda f: f.filter("source = 'deck.pdf'").select("id"), "SELECT id FROM {fact_rows} WHERE source = 'deck.pdf'")
q("s20_s22_fact_ledger", "fact_rows", r.fact_ledger, f"""SELECT deal_id, count(*) AS facts, count(*) FILTER (WHERE source = 'uncertain') AS uncited, {ratio("(count(*) - count(*) FILTER (WHERE source = 'uncertain'))", 'count(*)', 4)} AS citation_compliance,
  {half_up("CAST(sum(confidence_pct) AS DOUBLE) * 0.01e0 / count(confidence_pct)", 4)} AS avg_confidence FROM {{fact_rows}} GROUP BY 1""")
q("s23_record_depth", "cycles", lambda y: y.select("deal_id", "cycle_number", *(x.alias(n) for n, x in zip(("deltas", "cycles"), r.record_depth(F.array(c("findings_count")), c("facts_extracted"), F.lit(2), c("cycle_number")), strict=True))),
  "SELECT deal_id, cycle_number, [findings_count, facts_extracted] AS deltas, greatest(2, cycle_number) AS cycles FROM {cycles}")
q("s24_counters", "cycles", lambda y: y.groupBy("deal_id").agg(F.sum("questions").alias("subgoals"), F.sum("uncertainties").alias("dead_ends"), F.sum("facts_extracted").alias("facts")),
  "SELECT deal_id, CAST(sum(questions) AS BIGINT) AS subgoals, CAST(sum(uncertainties) AS BIGINT) AS dead_ends, CAST(sum(facts_extracted) AS BIGINT) AS facts FROM {cycles} GROUP BY 1")
q("s25_calibration", "ledgers", lambda g: g.select("deal_id", F.coalesce(F.when(c("deal_id") % 2 == 0, F.lit(10)), c("brier_pct")).alias("brier_pct")), "SELECT deal_id, CASE WHEN deal_id % 2 = 0 THEN 10 ELSE brier_pct END AS brier_pct FROM {ledgers}")
q("s26_ledger_quality", "ledgers", lambda g: g.select("deal_id", r.ledger_quality(_par(), c("brier_pct") / F.lit(100.0)).cast("int").alias("quality"), r.citation_grade(c("depth_tenths") > 0).alias("citation"), r.paraphrase_grade(_par()).alias("paraphrase"), r.calibration_grade(c("brier_pct") / F.lit(100.0)).alias("calibration")),
  f"""SELECT deal_id, CAST(least(100, 45 + CASE WHEN {CY} >= 0.9e0 THEN 30 WHEN {CY} >= 0.8e0 THEN 25 WHEN {CY} >= 0.7e0 THEN 15 ELSE 5 END
  + CASE WHEN coalesce(brier_pct, 50) < 10 THEN 25 WHEN coalesce(brier_pct, 50) < 20 THEN 20 WHEN coalesce(brier_pct, 50) < 30 THEN 10 ELSE 5 END) AS INT) AS quality, CASE WHEN depth_tenths > 0 THEN 'good' ELSE 'acceptable' END AS citation,
  CASE WHEN paraphrase_pct >= 90 THEN 'excellent' WHEN paraphrase_pct >= 80 THEN 'good' WHEN paraphrase_pct >= 70 THEN 'acceptable' ELSE 'poor' END AS paraphrase,
  CASE WHEN brier_pct < 10 THEN 'excellent' WHEN brier_pct < 20 THEN 'good' WHEN brier_pct < 30 THEN 'acceptable' ELSE 'poor' END AS calibration FROM {{ledgers}}""")
q("s27_ledger_summary", "ledgers", lambda g: g.select("deal_id", r.ledger_summary(c("cycles"), c("subgoals"), c("constraints_checked"), c("dead_ends"), _par(), c("brier_pct") / F.lit(100.0)).alias("summary")),
  "SELECT deal_id, format('Cycles: {} | Facts: {} | Constraints: {} | Dead Ends: {} | Paraphrase Invariance: {}% | Brier: 0.{:02d}', cycles, subgoals, constraints_checked, dead_ends, paraphrase_pct, coalesce(brier_pct, 0)) AS summary FROM {ledgers}")
q("s28_planner_defaults", "deals", lambda d: d.select("id", F.size(F.array(*map(F.lit, r.DEFAULT_GOALS))).alias("goals"), F.size(F.array(*map(F.lit, r.DEFAULT_CONSTRAINTS))).alias("constraints")), "SELECT id, 4 AS goals, 2 AS constraints FROM {deals}")
q("s29_hypotheses", "deals", lambda d: d.select("id", r.remove_item(r.add_item(F.array(F.lit("a"), F.lit("b")), F.when(c("id") % 2 == 0, "a").otherwise("c")), F.lit("b")).alias("items")), "SELECT id, CASE WHEN id % 2 = 0 THEN ['a'] ELSE ['a', 'c'] END AS items FROM {deals}")
q("s30_subgoals", "deals", lambda d: d.select("id", r.add_item(F.array(F.lit("x")), F.concat(F.lit("g"), (c("id") % 3).cast("string"))).alias("items")), "SELECT id, ['x', concat('g', CAST(id % 3 AS VARCHAR(4)))] AS items FROM {deals}")
q("s31_planner_state", "cycles", lambda y: y.select("deal_id", F.struct(c("cycle_number").alias("cycle"), F.lit("a").alias("focus")).withField("focus", r.next_focus(F.array().cast("array<string>"), c("cycle_number"))).alias("s")).select("deal_id", "s.cycle", "s.focus"),
  "SELECT deal_id, cycle_number AS cycle, CASE cycle_number WHEN 1 THEN 'go deeper into the constraints' WHEN 2 THEN 'bring the findings together' WHEN 3 THEN 'finish the decision pack' ELSE 'go on' END AS focus FROM {cycles}")
q("s32_planner_goes_on", "cycles", lambda y: y.select("deal_id", "cycle_number", r.planner_goes_on(c("cycle_number"), c("questions")).alias("goes_on")), "SELECT deal_id, cycle_number, cycle_number <> 3 AND questions >= 2 AS goes_on FROM {cycles}")
q("s33_hypothesis_status", "cycles", lambda y: y.select("deal_id", "cycle_number", r.hypothesis_status(F.when(c("questions") == 0, "resolved").when(c("questions") == 1, "refined"), c("confidence_pct") / F.lit(100.0)).alias("status")),
  "SELECT deal_id, cycle_number, CASE WHEN questions = 0 THEN CASE WHEN confidence_pct > 70 THEN 'supported' ELSE 'contradicted' END WHEN questions = 1 THEN 'inconclusive' ELSE 'testing' END AS status FROM {cycles}")
q("s34_planner_errors", "cycles", lambda y: y.select("deal_id", "cycle_number", r.planner_errors(F.when(c("coverage_met"), F.array(F.lit("g"))), F.when(c("constraints_met"), F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")), c("cycle_number") + c("questions") - 1).alias("errors")),
  "SELECT deal_id, cycle_number, list_filter([CASE WHEN NOT coverage_met THEN 'a goal is needed' END, CASE WHEN NOT constraints_met THEN 'a constraint is needed' END, CASE WHEN cycle_number + questions - 1 < 1 OR cycle_number + questions - 1 > 3 THEN 'cycle must be 1 to 3' END], lambda x: x IS NOT NULL) AS errors FROM {cycles}")
q("s35_next_focus", "cycles", lambda y: y.select("deal_id", "cycle_number", r.next_focus(F.when(c("coverage_met"), F.array(F.lit("price"), F.lit("team"))).otherwise(F.array().cast("array<string>")), c("cycle_number")).alias("focus")),
  "SELECT deal_id, cycle_number, CASE WHEN coverage_met THEN 'Address: price' ELSE CASE cycle_number WHEN 1 THEN 'go deeper into the constraints' WHEN 2 THEN 'bring the findings together' WHEN 3 THEN 'finish the decision pack' ELSE 'go on' END END AS focus FROM {cycles}")
q("s36_planner_summary", "cycles", lambda y: y.select("deal_id", "cycle_number", r.planner_summary(c("cycle_number"), F.array(F.lit("g"), F.lit("h"), F.lit("i")), F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)), F.when(c("coverage_met"), "team"), F.when(c("constraints_met"), "").otherwise("errors")).alias("summary")),
  "SELECT deal_id, cycle_number, format('Cycle {} | Goals: 3 | Hypotheses: 1 | Subgoals: 2 | Focus: {} | {}', cycle_number, CASE WHEN coverage_met THEN 'team' ELSE 'None' END, CASE WHEN constraints_met THEN 'Active' ELSE 'Stopped: errors' END) AS summary FROM {cycles}")
q("s37_progress_rule", "cycles", lambda y: y.select("deal_id", "cycle_number", r.progress_rule(c("cycle_number"), c("questions")).alias("p")).select("deal_id", "cycle_number", "p.*"),
  """SELECT deal_id, cycle_number, cycle_number <> 3 AND questions >= 2 AS progresses, CASE WHEN cycle_number = 1 AND questions >= 2 THEN '2' WHEN cycle_number = 2 AND questions >= 2 THEN '3' ELSE 'synthesize' END AS next,
  CASE WHEN cycle_number = 3 THEN 'last cycle' WHEN questions >= 2 THEN 'depth still grows' ELSE 'depth no longer grows' END AS reason FROM {cycles}""")
q("s38_analysis_summary", "fact_rows", lambda f: r.fact_ledger(f).select("deal_id", "facts", r.half_up(c("avg_confidence") * 100).alias("confidence"), r.next_action((c("deal_id") % 5).cast("int"), F.when(c("deal_id") % 2 == 0, "complete").otherwise("running")).alias("next_action")),
  f"""SELECT deal_id, facts, {half_up('a * 100')} AS confidence, CASE deal_id % 5 WHEN 1 THEN 'run_cycle_2' WHEN 2 THEN 'run_cycle_3' WHEN 3 THEN 'synthesize' ELSE CASE WHEN deal_id % 2 = 0 THEN 'view_decision_pack' ELSE 'waiting_for_cycle_1' END END AS next_action
  FROM (SELECT deal_id, count(*) AS facts, {half_up("CAST(sum(confidence_pct) AS DOUBLE) * 0.01e0 / count(confidence_pct)", 4)} AS a FROM {{fact_rows}} GROUP BY 1) x""")
q("s39_prerequisites", "deals deal_documents", lambda d, x: e.prerequisites(d, x).groupBy("errors").agg(F.count("*").alias("n")), """SELECT CAST(deleted AS INT) + CAST(n = 0 AS INT) + CAST(k = 0 AS INT) AS errors, count(*) AS n FROM (SELECT d.id, d.deleted, count(x.document_id) AS n,
  count(x.document_id) FILTER (WHERE x.type IN ('pitch_deck', 'other')) AS k FROM {deals} d LEFT JOIN {deal_documents} x ON x.deal_id = d.id GROUP BY 1, 2) y GROUP BY 1""")
q("s40_progress", "cycles", lambda y: y.select("deal_id", "cycle_number", r.progress_percent(c("cycle_number"), c("questions") == 0).alias("percent")), f"SELECT deal_id, cycle_number, CASE WHEN questions = 0 THEN 100e0 ELSE {half_up('cycle_number / 3e0 * 100e0')} END AS percent FROM {{cycles}}")
q("s41_result", "ledgers fact_rows orders", lambda g, f, o: an.states(_snapshot(g), f, _packs(o)).filter("pack IS NOT NULL").select("deal_id", "risks", "confidence"),
  f"""SELECT g.deal_id, CASE WHEN k % 5 > 0 THEN [p, s] ELSE [] END AS risks, coalesce({half_up('m')}, 0e0) AS confidence FROM {{ledgers}} g JOIN ({_LAST}) l ON l.deal_id = g.deal_id LEFT JOIN ({_FACTS}) f ON f.deal_id = g.deal_id WHERE g.deal_id % 5 > 0""")
q("s42_request_gates", "cycles", lambda y: y.select("deal_id", "cycle_number", c("cycle_number").between(1, 3).alias("may_run"), c("cycle_number").isin(2, 3).alias("may_synthesize")), "SELECT deal_id, cycle_number, cycle_number BETWEEN 1 AND 3 AS may_run, cycle_number IN (2, 3) AS may_synthesize FROM {cycles}")
