"""Declared schemas of the deal tables, as DDL; enumerations are strings that the writers check."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "deals": "id string, name string, stage string, priority string, trend string, score double, owner string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "dio_versions": "id string, deal_id string, version long, status string, created_at timestamp",
    "documents": """document_id string, deal_id string, title string, type string, status string, uploaded_at timestamp, updated_at timestamp,
        structured_data struct<key_financial_metrics:map<string,struct<min:double,max:double,avg:double>>,key_metrics:array<struct<key:string,value:string,source:string>>,main_headings:array<string>,text_summary:string,entities:array<struct<type:string,value:string>>>,
        extraction_metadata struct<content_type:string,file_size_bytes:long,attempt:int,pages_processed:int,total_pages:int,total_words:long,headings_count:int,summary_length:int,error_message:string,needs_ocr:boolean>,
        full_text string, page_count int, verification_status string, verification_result struct<overall_score:double,ocr:string,coherence:double,completeness:double,recommendations:array<string>>, ready_for_analysis_at timestamp""",
    "evidence": "evidence_id string, deal_id string, document_id string, source string, kind string, text string, excerpt string, confidence double, created_at timestamp",
    "jobs": "id long, job_id string, deal_id string, document_id string, type string, status string, progress_pct int, message string, created_at timestamp, updated_at timestamp",
    "ingestion_reports": "report_id string, deal_id string, created_at timestamp, summary string, document_ids array<string>",
    "fact_rows": "id string, deal_id string, claim string, source string, page string, confidence decimal(3,2), created_cycle int, created_at timestamp_ntz",
    "planner_states": "deal_id string, cycle int, goals array<string>, constraints array<string>, hypotheses array<string>, subgoals array<string>, focus string, stop_reason string",
    "analysis_cycles": "deal_id string, cycle_number int, focus string, status string, duration_ms long, findings_count int, facts_extracted int, depth_delta decimal(5,2), should_continue boolean, error_message string",
    "cycle_outputs": "cycle_id string, deal_id string, cycle_number int, hypotheses array<struct<statement:string,confidence:double>>, uncertainties array<struct<question:string>>, constraints array<struct<constraint:string>>",
    "ledger_manifests": "deal_id string, cycles_completed int, depth_delta array<double>, subgoals_addressed int, constraints_checked int, dead_ends int, paraphrase_invariance decimal(3,2), calibration_brier decimal(3,2), total_facts int, total_findings int",
    "decision_packs": "deal_id string, executive_summary string, go_no_go string, tranche_plan array<struct<name:string,amount:double>>, risk_map array<struct<risk:string,severity:string>>, what_to_verify array<string>, calibration_audit map<string,double>",
    "analysis_metrics": "deal_id string, citation_compliance double, paraphrase_invariance double, overall_depth double, confidence_average double, processing_time_seconds double",
    "citations": "fact_id string, claim string, source string, page string, confidence decimal(3,2)",
    "paraphrase_tests": "deal_id string, cycle_number int, original_prompt string, paraphrases array<string>, responses array<string>, variance_score double, inconsistencies array<string>, overall_confidence double",
    "llm_performance_metrics": "id long, created_at timestamp, deal_id string, cycle_number int, task_type string, selected_model string, provider_type string, input_tokens int, output_tokens int, total_tokens int, cost_usd decimal(10,6), latency_ms int, cached boolean, error_message string",
    "llm_cache_metrics": "id long, created_at timestamp, deal_id string, task_type string, content_hash string, cache_key string, event_type string, tokens_saved int, cost_saved_usd decimal(10,6), hit_count int, miss_count int",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
