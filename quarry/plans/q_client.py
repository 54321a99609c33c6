"""Queries of the cache, routing and prompt operators, and of list operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cache as k
from ..operators import client as x
from ..operators import rules as r
from .q_entities import q
from .q_text import FILES
from .registry import query
from .sql import half_up, ratio
from .views import standalone, view

c = F.col
HIT, MISS = "count(*) FILTER (WHERE event_type = 'hit')", "count(*) FILTER (WHERE event_type = 'miss')"


def s(n: Column) -> Column:
    return n.cast("string")


q("s43_user_prompts", "cycles", lambda y: y.select("deal_id", "cycle_number", k.user_prompt(c("cycle_number"), s(c("deal_id")), F.lit("deck"), F.when(c("coverage_met"), F.array(F.lit("one"), F.lit("two"))), F.lit("out1"), F.lit("out2"), F.array(F.struct(F.lit("a").alias("claim"), F.lit("deck.pdf").alias("source"), s(c("questions")).alias("confidence")))).alias("prompt")),
  """SELECT deal_id, cycle_number, concat('DEAL: ', CAST(deal_id AS VARCHAR(20)), chr(10), chr(10), CASE cycle_number
  WHEN 1 THEN concat('PITCH DECK:', chr(10), 'deck', CASE WHEN coverage_met THEN concat(chr(10), chr(10), 'SUPPORTING DOCUMENTS:', chr(10), 'one', chr(10), '---', chr(10), 'two') ELSE '' END)
  WHEN 2 THEN concat('CYCLE 1 ANALYSIS:', chr(10), 'out1', chr(10), chr(10), 'DEAL MATERIALS:', chr(10), 'deck')
  ELSE concat('CYCLE 1 ANALYSIS:', chr(10), 'out1', chr(10), chr(10), 'CYCLE 2 ANALYSIS:', chr(10), 'out2', chr(10), chr(10), 'ALL EXTRACTED FACTS:', chr(10), '- "a" (deck.pdf, confidence: ', CAST(questions AS VARCHAR(20)), ')') END,
  chr(10), chr(10), 'Carry out cycle ', CAST(cycle_number AS VARCHAR(4)), ' as the system prompt says. Answer in valid JSON.') AS prompt FROM {cycles}""")
q("s44_system_prompts", "cycles", lambda y: y.select("deal_id", F.length(k.system_prompt(c("cycle_number"))).alias("n")), f"SELECT deal_id, CASE cycle_number WHEN 1 THEN {len(k.SYSTEM_PROMPTS[1])} WHEN 2 THEN {len(k.SYSTEM_PROMPTS[2])} ELSE {len(k.SYSTEM_PROMPTS[3])} END AS n FROM {{cycles}}")
q("s45_paraphrases", "deals", lambda d: d.select("id", k.paraphrases(F.concat(F.when(c("id") % 3 == 0, "What is it? Does ").when(c("id") % 3 == 1, "Please specify, please: How can ").otherwise("To what extent does "), "name", F.lit(" What is"))).alias("p")),
  """SELECT id, CASE id % 3 WHEN 0 THEN [concat('What is it? Does ', name, ' What is'), concat('Please specify it? To what extent does ', name, ' What is'), concat('What is it? Does ', name, ' What is')]
  WHEN 1 THEN [concat('Please specify, please: How can ', name, ' What is'), concat('Please specify, please: In what manner might ', name, ' Please specify'), concat('What is, please: How can ', name, ' What is')]
  ELSE [concat('To what extent does ', name, ' What is'), concat('To what extent does ', name, ' Please specify'), concat('Does ', name, ' What is')] END AS p FROM {deals}""")
q("s46_check_prompts", "deals", lambda d: d.select("id", k.citation_prompt(c("name"), c("stage")).alias("citation"), k.calibration_prompt(c("name"), c("stage"), s(c("id"))).alias("calibration"), k.pressure_prompt(c("name"), F.array("stage", "priority")).alias("pressure"), k.risk_prompt(c("name"), c("stage")).alias("risk")),
  f"""SELECT id, concat('CLAIM: "', name, '"', chr(10), 'PROPOSED SOURCE: "', stage, '"', chr(10), chr(10), '{k.CITATION_ASK}') AS citation, concat('CLAIM: "', name, '"', chr(10), 'EVIDENCE: "', stage, '"', chr(10), 'ASSIGNED CONFIDENCE: ', CAST(id AS VARCHAR(20)), chr(10), chr(10), '{k.CALIBRATION_ASK}') AS calibration,
  concat('BINDING CONSTRAINT: "', name, '"', chr(10), chr(10), 'EVIDENCE:', chr(10), '- ', stage, chr(10), '- ', priority, chr(10), chr(10), '{k.PRESSURE_ASK}') AS pressure, concat('CLAIM: "', name, '"', chr(10), 'CONTEXT: "', stage, '"', chr(10), chr(10), '{k.RISK_ASK}') AS risk FROM {{deals}}""")
q("s47_prompt_errors", "documents", lambda d: d.select("doc_id", k.prompt_errors(F.when(c("doc_id") % 3 == 0, F.concat(F.lit("OBJECTIVE "), "text")).otherwise(c("source"))).alias("errors")),
  "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(text) + 10 > 8000 THEN ['the prompt is too long'] ELSE [] END ELSE ['the prompt has no instructions'] END AS errors FROM {documents}")
q("s48_cache_keys", "cache_events", lambda v: v.select("id", k.cache_key(c("content_hash"), c("task_type"), F.when(c("id") % 2 == 0, c("model")), F.when(c("id") % 5 == 0, F.lit(0.0)).when(c("id") % 5 == 1, F.lit(0.2)).when(c("id") % 5 == 2, F.lit(1.0))).alias("key")),
  "SELECT id, sha256(concat_ws(':', content_hash, task_type, CASE WHEN id % 2 = 0 THEN model ELSE 'default' END, CASE id % 5 WHEN 1 THEN '0.2' WHEN 2 THEN '1' ELSE '0.7' END)) AS key FROM {cache_events}")
q("s49_cache_replay", "cache_events", lambda v: k.replay(v.select(c("content_hash").alias("key"), c("created_at").alias("at"), (c("task_type") != "error").alias("eligible"), "id")).groupBy("outcome").agg(F.count("*").alias("n")),
  """WITH RECURSIVE o AS (SELECT content_hash AS key, created_at AS stamp, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS n FROM {cache_events} WHERE task_type <> 'error'),
  f AS (SELECT key, n, stamp AS stored, false AS hit FROM o WHERE n = 1 UNION ALL SELECT o.key, o.n, CASE WHEN o.stamp - f.stored <= INTERVAL 7 DAY THEN f.stored ELSE o.stamp END, o.stamp - f.stored <= INTERVAL 7 DAY FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
  SELECT CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM {cache_events} WHERE task_type = 'error'""")
_KIND = "CASE {x} % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'fact-extraction' ELSE 'chat-response' END"


def _lookups(v: DataFrame) -> DataFrame:
    """Requests at each event against entries that misses stored: those of a key live for a week from its last store."""
    requests = v.select("id", c("content_hash").alias("key"), F.expr(_KIND.format(x="id")).alias("task"), c("created_at").alias("at"))
    entries = v.filter("event_type = 'miss' AND id % 2 = 0").select(c("content_hash").alias("key"), (c("created_at") - F.expr("INTERVAL 3 DAYS")).alias("expires_at"))
    return k.looked_up(requests, entries, c("id") % 10 > 0)


_LOOKED = f"""SELECT v.id, v.content_hash AS key, CASE WHEN v.id % 10 > 0 AND v.id % 3 < 2 THEN CASE WHEN v.created_at <= e.x THEN 'hit' ELSE 'miss' END END AS outcome FROM {{cache_events}} v
  LEFT JOIN (SELECT content_hash, max(created_at) - INTERVAL 3 DAY AS x FROM {{cache_events}} WHERE event_type = 'miss' AND id % 2 = 0 GROUP BY 1) e ON e.content_hash = v.content_hash"""
q("s49_lookups", "cache_events", lambda v: _lookups(v).select("id", "key", "outcome"), _LOOKED)
q("s49_hits", "cache_events", lambda v: k.with_hits(v.groupBy(c("content_hash").alias("key")).agg(F.count("*").alias("hits")), _lookups(v)), f"SELECT key, count(*) + count(*) FILTER (outcome = 'hit') AS hits FROM ({_LOOKED}) y GROUP BY 1")
q("s50_eviction", "cache_events", lambda v: k.evict(v.select(c("id").alias("key"), "created_at"), k.MOST_ENTRIES - 1).select("key"), "SELECT id AS key FROM {cache_events} ORDER BY created_at DESC, id LIMIT 9999")
q("s51_savings", "cache_events", lambda v: v.filter("event_type = 'hit'").select("id", k.savings(c("tokens_saved"), c("model")).alias("saved")),
  "SELECT id, tokens_saved / 1e6 * CASE model WHEN 'llama-70b' THEN 0.05e0 WHEN 'qwen-14b' THEN 0.02e0 ELSE 5e0 END AS saved FROM {cache_events} WHERE event_type = 'hit'")
q("s52_cache_stats", "cache_events", k.stats, f"SELECT {HIT} AS hits, {MISS} AS misses, {ratio(HIT, f'({HIT} + {MISS})', 2, 100)} AS hit_rate, min(created_at) AS oldest, max(created_at) AS newest FROM {{cache_events}}")
q("s53_top_hits", "cache_events", k.top_hits, "SELECT content_hash, count(*) AS hits FROM {cache_events} WHERE event_type = 'hit' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
q("s53_entries_by_task", "cache_events", lambda v: k.by_task(v, "click").select("id", "content_hash"), "SELECT id, content_hash FROM {cache_events} WHERE task_type = 'click'")
q("s54_compress", "conversations", lambda v: v.select("conv_id", "turn", t.compress(c("text"), 500).alias("text")), None)
q("s55_squeeze", "conversations", lambda v: v.select("conv_id", "turn", t.squeeze(c("text")).alias("text")),
  "SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(?m)[\\t\\v\\f\\r ]+$', '', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM {conversations}")
q("s56_repeats", "conversations", lambda v: v.select("conv_id", "turn", t.abbreviate_repeats(c("text")).alias("text")), None)
q("s57_truncate", "documents", lambda d: d.select("doc_id", t.truncate(c("text"), 200).alias("text")),
  """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(CASE WHEN stop > 160 THEN substr(text, 1, stop + 1) ELSE substr(text, 1, 200) END, chr(10), '[... truncated due to length ...]') END AS text FROM (SELECT doc_id, text,
  greatest(CASE WHEN instr(b, '.') > 0 THEN 200 - instr(b, '.') ELSE -1 END, CASE WHEN instr(b, chr(10)) > 0 THEN 200 - instr(b, chr(10)) ELSE -1 END) AS stop FROM (SELECT doc_id, text, reverse(substr(text, 1, 200)) AS b FROM {documents}) y) z""")
q("s58_summarize_lines", "documents", lambda d: d.select("doc_id", F.size(F.split(t.summarize_lines(c("text"), 8), "\n")).alias("n")),
  "SELECT doc_id, CAST(least(8, len(string_split(text, chr(10)))) AS INT) AS n FROM {documents}")
q("s59_document_contexts", "documents", lambda d: k.document_contexts(d.select("doc_id", c("text").alias("document"), F.concat(F.lit("Extract facts.  "), "lang").alias("instructions"))).select("doc_id", F.length("document").alias("n"), "instructions", r.half_up(c("reduction"), 6).alias("reduction")), None)
q("s59_analysis_contexts", "documents", lambda d: k.analysis_contexts(d.select("doc_id", c("text").alias("facts"), F.concat(F.lit("H:   "), "lang").alias("hypotheses"), F.concat(F.lit("Q:   "), "source").alias("queries"))).select("doc_id", F.length("facts").alias("n"), "hypotheses", "queries", r.half_up(c("reduction"), 6).alias("reduction")), None)
q("s60_estimate", "documents", lambda d: d.select("doc_id", t.compression_estimate(c("text")).alias("pct")),
  """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM {documents}), m AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2) v GROUP BY 1)
  SELECT doc_id, least(40, CASE WHEN regexp_matches(text, '\\n\\n\\n|\\s\\s+') THEN 7 ELSE 0 END + CASE WHEN regexp_matches(text, '/\\*|//|<!--|--') THEN 10 ELSE 0 END + CASE WHEN most > 5 THEN 3 ELSE 0 END + CASE WHEN length(text) > 5000 THEN 20 ELSE 0 END) AS pct FROM {documents} JOIN m USING (doc_id)""")


# The task of a request by its id; one that no configuration has, and an unknown one, are among them.
_TASK = "CASE id % 7 WHEN 0 THEN 'fact-extraction' WHEN 1 THEN 'classification' WHEN 2 THEN 'synthesis' WHEN 3 THEN 'validation' WHEN 4 THEN 'cycle-analysis' WHEN 5 THEN 'other' END"


def _routed(down: str) -> None:
    """Routing with all providers up, or one of them down."""
    hosted, own = down != "openai", down != "self-hosted"
    model = f"""CASE WHEN id % 5 = 0 THEN 'llama-70b' WHEN id % 7 = 0 THEN 'qwen-14b' WHEN id % 7 = 1 THEN 'qwen-7b-quantized' WHEN id % 7 = 2 THEN 'gpt-4o' WHEN id % 7 = 3 THEN '{"gpt-4o" if hosted else "llama-70b"}'
      WHEN id % 7 = 4 THEN '{"qwen-14b" if own else "gpt-4o"}' ELSE 'gpt-4o' END"""
    where = f"CASE WHEN model = 'gpt-4o' THEN '{'openai' if hosted else 'self-hosted'}' ELSE '{'self-hosted' if own else 'openai'}' END"
    name = "s61_routing" + (f"_without_{down.replace('-', '_')}" if down else "")
    sql = f"SELECT model, {where} AS provider, '{'openai' if hosted else 'self-hosted'}' AS fallback, count(*) AS n FROM (SELECT {model} AS model FROM {{llm_calls}}) y GROUP BY 1"

    @query(name, standalone(sql))
    def _run(spark: SparkSession, d: str) -> DataFrame:
        rows = view(spark, d, "llm_calls").select("id", F.expr(_TASK).alias("task"), F.when(c("id") % 5 == 0, "llama-70b").alias("model"))
        return k.route(rows, k.task_config(spark), k.providers(spark, (down,))).groupBy("model", "provider", "fallback").agg(F.count("*").alias("n"))


for _down in ("", "openai", "self-hosted"):
    _routed(_down)
q("s62_call_cost", "llm_calls documents", lambda p, d: p.select("id", k.call_cost(c("selected_model"), c("input_tokens"), c("output_tokens")).alias("cost")),
  "SELECT id, CASE WHEN selected_model = 'gpt-4o' THEN input_tokens / 1e6 * 5 + output_tokens / 1e6 * 15 END AS cost FROM {llm_calls}")
q("s62_estimated_tokens", "documents", lambda d: d.select("doc_id", t.estimated_tokens(c("text")).alias("n")), "SELECT doc_id, CAST(ceil(length(text) / 4e0) AS BIGINT) AS n FROM {documents}")
q("s63_feature_flags", "customer", lambda d: d.groupBy(k.feature_enabled(F.lit(True), F.lit(30), c("c_name")).alias("on")).agg(F.count("*").alias("n")),
  "SELECT abs(list_reduce(list_transform(string_split(c_name, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda h, k: ((h * 31 + k + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT))) % 100 < 30 AS on, count(*) AS n FROM {customer} GROUP BY 1".replace("AS on", 'AS "on"'))
q("s64_flag_settings", "events", lambda v: k.latest_flags(v.select(c("event_type").alias("name"), c("event_id").alias("version"), (c("event_id") % 2 == 0).alias("enabled"))), "SELECT event_type AS name, max(event_id) AS version, max(event_id) % 2 = 0 AS enabled FROM {events} GROUP BY 1")


#: Calls a hundred times as dense as they are, so that buffers fill.
DENSE = "SELECT provider_type AS provider, id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(id // 9 AS BIGINT)) AS stamp FROM {llm_calls}"
q("s65_flushes", "llm_calls", lambda p: k.flushes(p.select(c("provider_type").alias("provider"), "id", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id DIV 9 AS DECIMAL(18, 6)))").alias("at"))).select("provider", "events", "total_flushed"),
  f"""SELECT provider, events, CAST(sum(events) OVER (PARTITION BY provider ORDER BY tick, flush) AS BIGINT) AS total_flushed FROM (SELECT provider, tick, flush, count(*) AS events FROM (SELECT provider, tick, (row_number() OVER (PARTITION BY provider, tick ORDER BY stamp, id) - 1) // 100 AS flush
  FROM (SELECT *, CAST(floor(epoch(stamp) / 30) AS BIGINT) AS tick FROM ({DENSE}) y) z) w GROUP BY 1, 2, 3) v""")
q("s65_retry_delays", "region", lambda g: g.select("r_regionkey", k.retry_delay(c("r_regionkey")).alias("ms")), "SELECT r_regionkey, CAST(1000 * power(2, r_regionkey) AS BIGINT) AS ms FROM {region}")


@query("s66_complete", standalone("SELECT CASE WHEN doc_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN doc_id % 4 <> 0 THEN 'qwen-14b' END AS model, count(*) AS n FROM {documents} GROUP BY 1, 2"))
def _complete(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "documents")
    now = F.lit("2024-06-01").cast("timestamp")
    requests = docs.select(s(c("doc_id")).alias("key"), F.lit("fact-extraction").alias("task"), c("text").alias("content"))
    entries = docs.filter("doc_id % 4 = 0 or doc_id % 4 = 1").select(s(c("doc_id")).alias("key"), F.when(c("doc_id") % 4 == 0, F.lit("2024-07-01")).otherwise("2024-05-01").cast("timestamp").alias("expires_at"), F.lit("r").alias("result"))
    return k.complete(requests, entries, k.task_config(spark), k.providers(spark), now).groupBy("outcome", "model").agg(F.count("*").alias("n"))


@query("s66_stored", standalone("SELECT CAST(doc_id AS VARCHAR(20)) AS key, 'fact-extraction' AS task, source AS result, TIMESTAMP '2024-06-01 00:00:00' AS created_at, TIMESTAMP '2024-06-08 00:00:00' AS expires_at FROM {documents} WHERE doc_id % 4 <> 0 AND doc_id % 2 = 0"))
def _stored(spark: SparkSession, d: str) -> DataFrame:
    docs, now = view(spark, d, "documents"), F.lit("2024-06-01").cast("timestamp_ntz")
    requests = docs.select(s(c("doc_id")).alias("key"), F.when(c("doc_id") % 2 == 0, "fact-extraction").otherwise("synthesis").alias("task"), c("text").alias("content"))
    entries = docs.filter("doc_id % 4 = 0").select(s(c("doc_id")).alias("key"), F.lit("2024-07-01").cast("timestamp_ntz").alias("expires_at"), F.lit("r").alias("result"))
    completed = k.complete(requests, entries, k.task_config(spark), k.providers(spark), now)
    return k.entries_of(completed, docs.select(s(c("doc_id")).alias("key"), c("source").alias("result")), now)


q("s67_extract_requests", "documents", lambda d: k.extract_requests(d.select("doc_id", c("source").alias("document"), F.concat(F.lit("Extract facts.   "), "lang").alias("instructions"))).select("doc_id", "task", c("messages")[0]["role"].alias("first"), c("messages")[1]["content"].alias("content"), "temperature", "max_tokens"),
  "SELECT doc_id, 'fact-extraction' AS task, 'system' AS first, concat('Extract facts.   ', lang, chr(10), chr(10), 'Document:', chr(10), source) AS content, 0.2e0 AS temperature, 2000 AS max_tokens FROM {documents}")
q("s67_synthesize_requests", "documents", lambda d: k.synthesize_requests(d.select("doc_id", c("source").alias("facts"), c("lang").alias("hypotheses"), F.concat(F.lit("Why "), "lang").alias("queries"))).select("doc_id", "task", c("messages")[1]["content"].alias("content"), "temperature", "max_tokens"),
  "SELECT doc_id, 'synthesis' AS task, concat('Facts:', chr(10), source, chr(10), chr(10), 'Hypotheses:', chr(10), lang, chr(10), chr(10), 'Analyze:', chr(10), 'Why ', lang) AS content, 0.5e0 AS temperature, 3000 AS max_tokens FROM {documents}")
q("s67_task_requests", "documents", lambda d: d.select("doc_id", F.format_string("Extract facts from %s of %s", "source", "lang").alias("prompt")), "SELECT doc_id, concat('Extract facts from ', source, ' of ', lang) AS prompt FROM {documents}")


_TASKS = ", ".join(f"('{a}', '{b}', {n}, CAST({x} AS DOUBLE))" for a, b, n, x in k.TASKS)


@query("s68_task_config", standalone(f"""SELECT r.id, r.task, v.model, v.max_tokens, v.temperature FROM (SELECT id, CASE id % 4 WHEN 3 THEN 'unknown' ELSE {_KIND.format(x="id")} END AS task FROM {{llm_calls}}) r
  LEFT JOIN (VALUES {_TASKS}) v(task, model, max_tokens, temperature) ON v.task = r.task"""))
def _config(spark: SparkSession, d: str) -> DataFrame:
    calls = view(spark, d, "llm_calls").select("id", F.when(c("id") % 4 == 3, "unknown").otherwise(F.expr(_KIND.format(x="id"))).alias("task"))
    return k.configured(calls, k.task_config(spark)).select("id", "task", "model", "max_tokens", "temperature")


def _key() -> Column:
    return F.when(c("p_size") % 4 == 1, "sk-1").when(c("p_size") % 4 == 2, "key-1234567").when(c("p_size") % 4 == 3, "sk-12345678")


q("s69_config_errors", "part", lambda p: p.select("p_partkey", k.config_errors(_key()).alias("errors"), k.config_warnings(c("p_size") % 3 > 0, _key(), c("p_size") % 2 == 0, c("p_size") % 5 > 0, c("p_size") % 7 > 0, c("p_size") * 3 - 5, c("p_size") * 10, F.when(c("p_size") % 2 == 0, "cost-aware").otherwise("none")).alias("warnings")),
  """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['no key'] WHEN 1 THEN ['the key is short'] ELSE [] END AS errors, list_filter([CASE WHEN p_size % 3 = 0 THEN 'models are off' END, CASE WHEN p_size % 4 = 2 THEN 'the key has another form' END, CASE WHEN p_size % 2 <> 0 THEN 'the cache is off' END,
  CASE WHEN p_size % 5 = 0 THEN 'compression is off' END, CASE WHEN p_size % 7 = 0 THEN 'analytics is off' END, CASE WHEN p_size * 3 - 5 < 1 OR p_size * 3 - 5 > 90 THEN 'time to live is out of 1 to 90 days' END, CASE WHEN p_size * 10 < 100 THEN 'the cache is below 100 entries' END,
  CASE WHEN p_size % 2 <> 0 THEN 'unknown strategy' END], lambda x: x IS NOT NULL) AS warnings FROM {part}""")
q("s70_answers", "deals", lambda d: d.select("id", k.parse_answer(F.concat(F.lit('{"summary":"'), "name", F.lit('","risks":[{"risk":"a","severity":"low"}],"what_to_verify":["x","y"]}')), 3).alias("a")).select("id", "a.summary", c("a.risks")[0]["risk"].alias("risk"), F.size("a.what_to_verify").alias("verify")),
  "SELECT id, name AS summary, 'a' AS risk, 2 AS verify FROM {deals}")

# Lists

q("c01_document_counts", "deals deal_documents", lambda d, y: x.with_document_counts(d, y).select("id", "documents"), "SELECT d.id, count(y.document_id) AS documents FROM {deals} d LEFT JOIN {deal_documents} y ON y.deal_id = d.id GROUP BY 1")
q("c02_latest_by_name", "deals", lambda d: x.latest_by_name(d.withColumn("name", F.concat(F.lit("n"), s(c("id") % 97)))).select("id", "name", "updated_at"),
  "SELECT id, name, updated_at FROM (SELECT id, concat('n', CAST(id % 97 AS VARCHAR(4))) AS name, updated_at, row_number() OVER (PARTITION BY id % 97 ORDER BY updated_at DESC, id) AS n FROM {deals}) y WHERE n = 1")
q("c03_search", "deals", lambda d: x.search(d, "0001", "pitched", "high").select("id"), "SELECT id FROM {deals} WHERE contains(lower(name), '0001') AND stage = 'pitched' AND priority = 'high'")
q("c04_portfolio", "deals", x.portfolio_stats, f"SELECT count(*) AS total, count(*) FILTER (WHERE stage = 'ready_decision') AS ready, coalesce({half_up('CAST(sum(score) AS DOUBLE) / count(score)')}, 0e0) AS avg_score, CAST(sum(id) AS BIGINT) AS views FROM {{deals}}")
q("c05_sorted", "deals", lambda d: x.sort_by(d, "score", "desc").select("id", "score"), "SELECT id, score FROM {deals}")
q("c06_stage_distribution", "deals", lambda d: x.distribution(d, "stage"), f"SELECT stage AS key, count(*) AS n, {ratio('count(*)', '(SELECT count(*) FROM {deals})', 1, 100)} AS pct FROM {{deals}} GROUP BY 1")
q("c06_score_buckets", "deals", lambda d: x.distribution(d, x.score_bucket(c("score"))), f"SELECT CASE WHEN score <= 50 THEN '0-50' WHEN score <= 70 THEN '51-70' WHEN score <= 85 THEN '71-85' WHEN score <= 100 THEN '86-100' END AS key, count(*) AS n, {ratio('count(*)', '(SELECT count(*) FROM {deals})', 1, 100)} AS pct FROM {{deals}} GROUP BY 1")
q("c07_monthly", "deal_documents", lambda d: x.monthly(d, "uploaded_at"), "SELECT month, n, n - lag(n) OVER (ORDER BY month) AS change FROM (SELECT CAST(date_trunc('month', uploaded_at) AS DATE) AS month, count(*) AS n FROM {deal_documents} GROUP BY 1) y")
q("c07_kpi", "deal_documents", lambda d: x.kpi(x.monthly(d, "uploaded_at")), f"""SELECT max_by(n, month) AS value, max_by(change, month) AS change FROM (SELECT month, n, {half_up('(n - b) / nullif(CAST(b AS DOUBLE), 0e0) * 100')} AS change FROM (SELECT month, n, lag(n) OVER (ORDER BY month) AS b
  FROM (SELECT CAST(date_trunc('month', uploaded_at) AS DATE) AS month, count(*) AS n FROM {{deal_documents}} GROUP BY 1) y) z) w""")
#: A form of each deal, as SQL that both engines run; a field is null, empty or given.
FORM_SQL = """SELECT id, name AS company_name, CASE WHEN id % 2 = 0 THEN 'saas' END AS industry, CASE id % 4 WHEN 0 THEN 'Pre-Seed' WHEN 1 THEN 'seed' WHEN 2 THEN '' ELSE 'series-a' END AS stage, CASE WHEN id % 3 <> 0 THEN 'smb' ELSE '' END AS target_market,
  CASE WHEN id % 5 = 0 THEN '1B' END AS market_size, CASE WHEN id % 8 = 0 THEN 'x' END AS competitor_analysis, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '5' WHEN 4 THEN '6-10' ELSE '12 people' END AS team_size,
  CASE WHEN id % 4 = 0 THEN 'x' END AS founder_experience, CASE WHEN id % 9 = 0 THEN 'x' END AS advisors,
  CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN '$0' WHEN 3 THEN '$100,000' WHEN 4 THEN '$100,001' WHEN 5 THEN '$1,000,001 ARR' ELSE '' END AS revenue,
  CASE WHEN id % 5 < 3 THEN '$2M' END AS funding_amount, CASE WHEN id % 6 < 2 THEN 'angel' END AS previous_funding, CASE WHEN id % 10 < 4 THEN '50k' END AS burn_rate, CASE WHEN id % 11 < 5 THEN 'x' END AS unit_economics, CASE WHEN id % 12 = 0 THEN 'x' END AS financial_projections,
  CASE id % 5 WHEN 0 THEN '0' WHEN 1 THEN '50' WHEN 2 THEN '51' WHEN 3 THEN 'many' END AS customers, CASE WHEN id % 6 <> 0 THEN '10%' END AS growth_rate, CASE WHEN id % 3 = 1 THEN 'x' END AS key_metrics, CASE WHEN id % 7 < 3 THEN 'x' END AS risk_factors,
  CASE WHEN id % 7 < 2 THEN 'x' END AS mitigation_strategy, CASE WHEN id % 2 = 1 THEN 'x' END AS unique_value, CASE WHEN id % 10 < 5 THEN 'x' ELSE '' END AS competitive_advantage, CASE WHEN id % 13 = 0 THEN 'x' END AS moat FROM {deals}"""
FORM = f"form AS ({FORM_SQL})"
HAS = lambda f: f"(coalesce({f}, '') <> '')"
P = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
REV = "coalesce(TRY_CAST(regexp_replace(coalesce(revenue, ''), '[^0-9]', '', 'g') AS DOUBLE), 0e0)"
INT = lambda f: f"TRY_CAST(regexp_extract({f}, '^[ ]*([+-]?[0-9]+)', 1) AS DOUBLE)"
TEAM, CUSTOMERS = INT("team_size"), INT("customers")
NO_CUSTOMERS = f"(NOT {HAS('customers')} OR coalesce({CUSTOMERS} = 0, false))"
SMALL = lambda n: f"(NOT {HAS('team_size')} OR coalesce({TEAM} < {n}, false))"
SCORES = f"""{FORM}, sc AS (SELECT *, least(100, {P(HAS('industry'), 20)} + {P(HAS('stage'), 15)} + {P(HAS('target_market'), 25)} + {P(HAS('funding_amount'), 20)} + {P(REV + ' > 0', 20)}) AS market,
  least(100, 40 + {P(TEAM + ' > 5', 20)} + {P(HAS('company_name'), 20)} + {P(HAS('founder_experience'), 20)}) AS team,
  least(100, {P(REV + ' > 0', 30)} + {P(REV + ' > 100000', 15)} + {P(REV + ' > 1000000', 15)} + {P(HAS('funding_amount'), 20)} + {P(HAS('previous_funding'), 20)}) AS financial,
  least(100, {P(REV + ' > 0', 40)} + {P(CUSTOMERS + ' > 0', 30)} + {P(HAS('growth_rate'), 30)}) AS traction,
  greatest(0, 70 - {P(f"NOT {HAS('revenue')} OR regexp_replace(revenue, '[^0-9]', '', 'g') = '0'", 15)} - {P(NO_CUSTOMERS, 15)} - {P(SMALL(3), 10)}) AS risk,
  least(100, 50 + {P(HAS('unique_value'), 25)} + {P(HAS('competitive_advantage'), 25)}) AS competitive FROM form),
  ov AS (SELECT *, {half_up('(market + team + financial + traction + risk + competitive) / 6e0')} AS overall FROM sc)"""


def _form(d: DataFrame) -> DataFrame:
    return d.sparkSession.sql(FORM_SQL, deals=d)


def _scores(d: DataFrame) -> DataFrame:
    return x.overall(x.category_scores(_form(d)))


CATS = ", ".join(f"CAST({k_} AS INT) AS {k_}" for k_ in x.CATEGORIES)
q("c08_pivot", "deals", lambda d: x.pivot_scores(_scores(d), [1, 2, 3]), f"WITH {SCORES} SELECT category, " + ", ".join(f"max(score) FILTER (WHERE id = {i}) AS deal_{i}" for i in (1, 2, 3)) + " FROM (" + " UNION ALL ".join(f"SELECT id, '{k_}' AS category, CAST({k_} AS INT) AS score FROM ov" for k_ in x.CATEGORIES) + ") y WHERE id <= 3 GROUP BY 1")
q("c09_best_deal", "deals", lambda d: x.best_deal(_scores(d)), f"WITH {SCORES} SELECT id AS best, overall FROM ov ORDER BY overall DESC, id LIMIT 1")
q("c10_selectable", "deals", lambda d: x.selectable(d.select("id"), d.filter("id % 50 = 0").select("id", (-c("id")).alias("at")))[1], "SELECT id FROM {deals} WHERE id NOT IN (SELECT id FROM {deals} WHERE id % 50 = 0 ORDER BY id DESC LIMIT 4)")
q("c11_document_filter", "deal_documents", lambda d: x.filter_documents(d, {"pitch_deck": "Pitch Deck", "legal": "Legal File"}, "file", "completed").select("document_id", "label"), "SELECT document_id, 'Legal File' AS label FROM {deal_documents} WHERE type = 'legal' AND status = 'completed'")
q("c12_document_stats", "deal_documents", lambda d: x.document_stats(d.withColumn("size", F.concat(s(c("page_count")), F.lit(".5 MB")))), f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS done, {ratio('count(*) FILTER (WHERE status = ' + chr(39) + 'completed' + chr(39) + ')', 'count(*)', 0, 100)} AS pct, {half_up('CAST(sum(quality_pct) AS DOUBLE) / count(quality_pct)')} AS avg_score, {half_up('sum(page_count * 10 + 5) / 10e0', 1)} AS mb FROM {{deal_documents}}")
q("c13_library", "documents", lambda d: x.library(d.select(c("doc_id").alias("id"), c("source").alias("name"), F.array("lang", F.lit("Text")).alias("tags"), c("lang").alias("category")), "EN", "all").select("id"), "SELECT doc_id AS id FROM {documents} WHERE contains(lower(source), 'en') OR contains(lower(lang), 'en')")
q("c14_file_sizes", "upload_files", lambda u: u.select("doc_id", t.human_size(c("n_bytes")).alias("size")),
  f"SELECT doc_id, CASE WHEN n_bytes = 0 THEN '0 Bytes' ELSE concat(CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END, ' ', unit) END AS size FROM (SELECT doc_id, n_bytes, {half_up('n_bytes / d', 2)} AS v, unit FROM (SELECT *, CASE WHEN n_bytes < 1024 THEN 1e0 WHEN n_bytes < 1048576 THEN 1024e0 WHEN n_bytes < 1073741824 THEN 1048576e0 ELSE 1073741824e0 END AS d, CASE WHEN n_bytes < 1024 THEN 'Bytes' WHEN n_bytes < 1048576 THEN 'KB' WHEN n_bytes < 1073741824 THEN 'MB' ELSE 'GB' END AS unit FROM {{upload_files}}) y) z")
q("c15_category_scores", "deals", lambda d: x.category_scores(_form(d)).select("id", *x.CATEGORIES), f"WITH {SCORES} SELECT id, {CATS} FROM sc")
q("c16_overall", "deals", lambda d: _scores(d).select("id", "overall", "grade"), f"WITH {SCORES} SELECT id, overall, CASE WHEN overall >= 85 THEN 'Excellent' WHEN overall >= 70 THEN 'Good' WHEN overall >= 55 THEN 'Fair' ELSE 'Needs Improvement' END AS grade FROM ov")
q("c17_completeness", "deals", lambda d: _form(d).select("id", x.completeness().alias("pct")), f"WITH {FORM} SELECT id, {half_up('(' + ' + '.join(f'CAST({HAS(f)} AS INT)' for f in x.FORM_FIELDS) + f') * 100e0 / {len(x.FORM_FIELDS)}e0')} AS pct FROM form")
def listed(*checks: tuple[str, str]) -> str:
    """SQL for the list of the texts (SQL expressions) whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {say} END" for cond, say in checks) + "], lambda z: z IS NOT NULL)"


NOT = lambda f: f"NOT {HAS(f)}"
ISSUES = {
    "market": listed((NOT("target_market"), "'no target market'"), (NOT("industry"), "'no industry'"), (f"{REV} = 0", "'no revenue figure'")),
    "team": listed((SMALL(3), "'the team is small'"), (NOT("founder_experience"), "'nothing on the founders'")),
    "financial": listed((f"{REV} = 0", "'no revenue yet'"), (NOT("funding_amount"), "'no funding amount'"), (NOT("burn_rate"), "'no burn rate'")),
    "traction": listed((NO_CUSTOMERS, "'no customers shown'"), (NOT("growth_rate"), "'no growth rate'"), (NOT("key_metrics"), "'no key metrics'")),
    "risk": listed((NOT("risk_factors"), "'no risks listed'"), (NOT("mitigation_strategy"), "'no mitigation'")),
    "competitive": listed((NOT("competitive_advantage"), "'no advantage named'"), (NOT("moat"), "'no moat named'")),
}
STRENGTHS = {
    "market": listed((HAS("target_market"), "'target market named'"), (HAS("industry"), "concat('sector: ', industry)"), (f"{REV} > 100000", "'revenue of six figures'")),
    "team": listed((f"{TEAM} >= 5", "'a team of five or more'"), (HAS("founder_experience"), "'experienced founders'")),
    "financial": listed((f"{REV} > 0", "concat('revenue: ', revenue)"), (HAS("funding_amount"), "concat('asks for ', funding_amount)"), (HAS("previous_funding"), "'funded before'")),
    "traction": listed((f"{CUSTOMERS} > 0", "concat('customers: ', customers)"), (HAS("growth_rate"), "concat('growth: ', growth_rate)")),
    "risk": listed((HAS("risk_factors"), "'risks disclosed'"), (HAS("mitigation_strategy"), "'mitigation described'")),
    "competitive": listed((HAS("competitive_advantage"), "'clear advantage'"), (HAS("unique_value"), "'unique value'")),
}
q("c18_issues", "deals", lambda d: _form(d).select("id", *(v.alias(f"{n}_issues") for n, v in x.issues().items()), *(v.alias(f"{n}_strengths") for n, v in x.strengths().items()), *(F.size(v).alias(f"{n}_advice") for n, v in x.recommendations().items())),
  f"WITH {FORM} SELECT id, " + ", ".join(f"{v} AS {n}_issues" for n, v in ISSUES.items()) + ", " + ", ".join(f"{v} AS {n}_strengths" for n, v in STRENGTHS.items())
  + f""", {P(NOT('target_market'), 1)} + {P(NOT('market_size'), 1)} + {P(NOT('competitor_analysis'), 1)} AS market_advice, {P(NOT('founder_experience'), 1)} + {P(NOT('advisors'), 1)} + 1 AS team_advice,
  {P(NOT('burn_rate'), 1)} + {P(NOT('unit_economics'), 1)} + {P(NOT('financial_projections'), 1)} AS financial_advice, 3 AS traction_advice, 3 AS risk_advice, 3 AS competitive_advice FROM form""")
FLAGS = (
    (f"{REV} = 0 AND lower(coalesce(stage, '')) <> 'pre-seed'", "'high: no revenue after the first stage'"), (NO_CUSTOMERS, "'medium: no customers'"), (SMALL(2), "'medium: a founder alone'"), (NOT("competitive_advantage"), "'low: no advantage named'"),
)
GREEN = (
    (f"{REV} > 100000", "'revenue above 100 thousand'"), (f"{REV} > 1000000", "'revenue above a million'"), (f"{CUSTOMERS} > 50", "'more than 50 customers'"), (f"{TEAM} >= 10", "'a team of ten or more'"), (HAS("previous_funding"), "'funded before'"),
    ("greatest(market, team, financial, traction, risk, competitive) >= 90", "'a category at 90 or more'"),
)
q("c19_flags", "deals", lambda d: _scores(d).select("id", F.transform(x.red_flags(), lambda f: F.concat(f["severity"], F.lit(": "), f["message"])).alias("red"), x.green_flags().alias("green")), f"WITH {SCORES} SELECT id, {listed(*FLAGS)} AS red, {listed(*GREEN)} AS green FROM ov")
# The first advice of a category below 70; an effort is medium for the market's first and second and for the team's second and the competitive one.
FIRST = {
    "market": ((NOT("target_market"), "medium"), (NOT("market_size"), "medium"), (NOT("competitor_analysis"), "low")), "team": ((NOT("founder_experience"), "low"), (NOT("advisors"), "medium"), ("true", "low")),
    "financial": ((NOT("burn_rate"), "low"), (NOT("unit_economics"), "low"), (NOT("financial_projections"), "low")), "traction": (("true", "low"),), "risk": (("true", "low"),), "competitive": (("true", "medium"),),
}
WINS = [(f"{n} < 70 AND ({' OR '.join(cond for cond, _ in steps)})", f"concat('{n}', ' ', CAST(100 - {n} AS VARCHAR(8)), ' ', CASE " + " ".join(f"WHEN {cond} THEN '{effort}'" for cond, effort in steps) + " END)") for n, steps in FIRST.items()]
q("c20_quick_wins", "deals", lambda d: _scores(d).select("id", F.transform(x.quick_wins(), lambda w: F.concat_ws(" ", w["category"], w["impact"].cast("string"), w["effort"])).alias("wins")), f"WITH {SCORES} SELECT id, list_slice({listed(*WINS)}, 1, 3) AS wins FROM ov")
q("c21_achievements", "deals", lambda d: _scores(d).select("id", x.achievements(c("overall"), x.completeness()).alias("a")).select("id", "a.*"),
  f"WITH {SCORES} SELECT id, true AS first_analysis, {half_up('(' + ' + '.join(f'CAST({HAS(f)} AS INT)' for f in x.FORM_FIELDS) + f') * 100e0 / {len(x.FORM_FIELDS)}e0')} >= 80 AS complete_profile, overall >= 85 AS investment_ready, overall = 100 AS perfect FROM ov")
ROUND, STAGE = ("CASE id % 7 WHEN 0 THEN 'seed' WHEN 1 THEN 'series-a' WHEN 2 THEN 'series-b' WHEN 3 THEN 'series-c' WHEN 4 THEN 'series-d' WHEN 5 THEN 'other' END", "CASE id % 6 WHEN 0 THEN 'idea' WHEN 1 THEN 'mvp' WHEN 2 THEN 'growth' WHEN 3 THEN 'scale' WHEN 4 THEN 'other' END")
TIMES = "CASE id % 7 WHEN 1 THEN 1.3e0 WHEN 2 THEN 1.6e0 WHEN 3 THEN 2e0 WHEN 4 THEN 2.5e0 ELSE 1e0 END * CASE id % 6 WHEN 0 THEN 1.5e0 WHEN 1 THEN 1.2e0 WHEN 3 THEN 0.9e0 WHEN 5 THEN 1.5e0 ELSE 1e0 END"
q("c22_savings", "deals", lambda d: d.select("id", *(v.alias(n) for n, v in zip(("dollars", "hours"), r.savings(F.expr(ROUND), F.expr(STAGE)), strict=True))),
  f"SELECT id, {half_up('22000e0*' + TIMES)} AS dollars, {half_up('85e0*' + TIMES)} AS hours FROM {{deals}}")
RISKS = "(SELECT CAST(id % 5 + 1 AS INT) AS probability, CAST(id * 3 % 5 + 1 AS INT) AS impact FROM {deals}) y"


def _risks(d: DataFrame) -> DataFrame:
    return d.select((c("id") % 5 + 1).cast("int").alias("probability"), (c("id") * 3 % 5 + 1).cast("int").alias("impact"))


q("c23_risk_matrix", "deals", lambda d: x.risk_matrix(_risks(d)), f"SELECT probability, impact, count(*) AS n, probability * impact AS score FROM {RISKS} GROUP BY 1, 2")
q("c24_risk_bands", "deals", lambda d: _risks(d).groupBy(r.risk_band(r.risk_score(c("probability"), c("impact"))).alias("band")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN probability * impact >= 15 THEN 'critical' WHEN probability * impact >= 10 THEN 'high' WHEN probability * impact >= 5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM {RISKS} GROUP BY 1")
q("c25_means", "deals", lambda d: _risks(d).agg(r.half_up(F.sum(c("probability") * c("impact")) / F.count("*")).alias("risk"), r.half_up(F.sum("impact") / F.count("*")).alias("ai"), F.sum("impact").alias("points")),
  f"SELECT {half_up('CAST(sum(probability * impact) AS DOUBLE) / count(*)')} AS risk, {half_up('CAST(sum(impact) AS DOUBLE) / count(*)')} AS ai, CAST(sum(impact) AS BIGINT) AS points FROM {RISKS}")
q("c26_notifications", "events", lambda v: x.notifications(v.select(c("event_type").alias("type"), (c("event_id") % 2 == 0).alias("unread"), F.expr("CASE event_id % 8 WHEN 0 THEN '5 minutes ago' WHEN 1 THEN 'Yesterday, 4:22 PM' WHEN 2 THEN 'Today, 9:00' WHEN 3 THEN '1 hour ago' WHEN 4 THEN 'just now' WHEN 5 THEN 'yesterday' WHEN 6 THEN '1 day ago' ELSE '5 min' END").alias("when")), v.select(c("event_type").alias("type"), (c("event_type") != "error").alias("enabled")).distinct()),
  "SELECT CASE WHEN event_id % 8 IN (0, 2, 3, 4) THEN 'today' WHEN event_id % 8 = 1 THEN 'yesterday' ELSE 'this week' END AS bucket, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS unread FROM {events} WHERE event_type <> 'error' GROUP BY 1")
q("c27_template_counts", "deal_documents", lambda d: x.counts_with_all(d, "type"), "SELECT type AS key, count(*) AS n FROM {deal_documents} GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM {deal_documents}")
q("c27_templates", "part", lambda m: x.templates(m.select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_type").alias("description"), c("p_brand").alias("category")), "E", "Brand#11").select("id"), "SELECT p_partkey AS id FROM {part} WHERE (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e')) AND p_brand = 'Brand#11'")
q("c27_popular", "part", lambda m: m.filter(c("p_size") > 40).select(c("p_partkey").alias("id")), "SELECT p_partkey AS id FROM {part} WHERE p_size > 40")
q("c28_members", "customer", lambda m: m.filter(F.lower("c_name").contains("0042") & (c("c_mktsegment") == "BUILDING")).select("c_custkey"), "SELECT c_custkey FROM {customer} WHERE contains(lower(c_name), '0042') AND c_mktsegment = 'BUILDING'")
#: The order of a funnel's steps: not that of their names.
PLACE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'login' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"
STEPS = f"(SELECT user_id AS deal_id, event_type AS step, {PLACE} AS position, count(*) AS n FROM {{events}} GROUP BY 1, 2, 3) y"
q("c29_funnel", "events", lambda v: x.funnel(v.groupBy(c("user_id").alias("deal_id"), c("event_type").alias("step"), F.expr(PLACE).alias("position")).agg(F.count("*").alias("n"))),
  f"SELECT deal_id, step, n, greatest({ratio('n', 'first_value(n) OVER (PARTITION BY deal_id ORDER BY position)', 1, 100)}, 30e0) AS width, {ratio('n', 'max(n) OVER (PARTITION BY deal_id)', 1, 100)} AS bar FROM {STEPS}")
MONTHS = "(SELECT o_custkey AS deal_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS v, CAST(max(o_orderkey) % 101 AS BIGINT) AS retention FROM {orders} GROUP BY 1, 2) y"


def _months(o: DataFrame) -> DataFrame:
    return o.groupBy(c("o_custkey").alias("deal_id"), F.trunc(c("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("v"), (F.max("o_orderkey") % 101).alias("retention"))


q("c29_first_and_last", "orders", lambda o: x.first_and_last(_months(o)), f"SELECT deal_id, min_by(v, month) AS first, max_by(v, month) AS last, max(v) AS most FROM {MONTHS} GROUP BY 1".replace("AS first", 'AS "first"').replace("AS last", 'AS "last"'))
q("c29_last_cohorts", "orders", lambda o: x.last_cohorts(_months(o)).select("deal_id", "month", "retention", "band"), f"SELECT deal_id, month, retention, CASE WHEN retention >= 70 THEN 'strong' WHEN retention >= 50 THEN 'fair' ELSE 'weak' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY month DESC) AS k FROM {MONTHS}) z WHERE k <= 6")
q("c29_retention_bands", "ledgers", lambda g: g.groupBy(x.retention_band(c("paraphrase_pct")).alias("band")).agg(F.count("*").alias("n")), "SELECT CASE WHEN paraphrase_pct >= 70 THEN 'strong' WHEN paraphrase_pct >= 50 THEN 'fair' ELSE 'weak' END AS band, count(*) AS n FROM {ledgers} GROUP BY 1")
q("c30_sparkline", "cycles", lambda y: x.sparkline(y.select("deal_id", c("cycle_number").alias("i"), c("findings_count").alias("v"))),
  f"""SELECT deal_id, cycle_number AS i, coalesce({ratio('row_number() OVER (PARTITION BY deal_id ORDER BY cycle_number) - 1', 'count(*) OVER (PARTITION BY deal_id) - 1')}, 0e0) AS x,
  coalesce(100 - {ratio('(findings_count - min(findings_count) OVER (PARTITION BY deal_id))', '(max(findings_count) OVER (PARTITION BY deal_id) - min(findings_count) OVER (PARTITION BY deal_id))')} * 100, 100e0) AS y FROM {{cycles}}""")
q("c31_dashboard", "deals", lambda d: d.orderBy("id").limit(4).select("id", x.verdict(c("score")).alias("verdict")), "SELECT id, CASE WHEN score >= 75 THEN 'go' WHEN score >= 50 THEN 'hold' ELSE 'no-go' END AS verdict FROM {deals} ORDER BY id LIMIT 4")
q("c32_export_plan", "deal_documents", lambda d: x.export_plan(d.select(c("type").alias("category"), (c("document_id") % 3 > 0).alias("enabled"), c("page_count").alias("pages"))),
  f"SELECT type AS category, count(*) AS sections, CAST(sum(CASE WHEN document_id % 3 > 0 THEN page_count ELSE 0 END) AS BIGINT) AS enabled_pages, CAST(ceil(sum(CASE WHEN document_id % 3 > 0 THEN page_count ELSE 0 END) * 0.8e0) AS BIGINT) AS minutes, {ratio('count(*) FILTER (WHERE document_id % 3 > 0)', 'count(*)', 0, 100)} AS pct FROM {{deal_documents}} GROUP BY 1")
q("c33_log_summary", "events", lambda v: x.log_summary(v.select(c("event_type").alias("source"), c("ts").alias("seen"), c("event_id").alias("id"))), 'SELECT source, count(*) AS n, max(seen) AS latest FROM (SELECT event_type AS source, ts AS seen FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 1000) y GROUP BY 1')
q("c34_industries", "nation region", lambda n, g: n.join(F.broadcast(g), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")), "SELECT r_name, list_sort(list(n_name)) AS names FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1")
q("c34_recommendations", "deals", lambda d: d.groupBy(x.recommendation(c("score")).alias("band")).agg(F.count("*").alias("n")), "SELECT CASE WHEN score >= 85 THEN 'strong buy' WHEN score >= 70 THEN 'buy' WHEN score >= 55 THEN 'watch' ELSE 'pass' END AS band, count(*) AS n FROM {deals} GROUP BY 1")
q("c34_pinned_first", "conversations", lambda v: x.pinned_first(v.select("conv_id", (c("turn") % 3 == 0).alias("pinned"), c("turn").alias("position"))), "SELECT conv_id, turn % 3 = 0 AS pinned, turn AS position FROM {conversations}")
q("c35_assigned_files", "upload_files documents", lambda u, d: x.assigned_files(u.select("filename"), u.filter("doc_id % 3 <> 0").select("filename", t.company(c("filename")).alias("company")).distinct(), d.filter("doc_id % 2 = 0").select(c("doc_id").alias("id"), F.concat("source", F.lit(" labs")).alias("name"))).groupBy("action").agg(F.count("*").alias("n")),
  f"""WITH {FILES}, a AS (SELECT DISTINCT filename, company FROM g WHERE doc_id % 3 <> 0), e AS (SELECT lower(concat(source, ' labs')) AS n, min(doc_id) AS id FROM {{documents}} WHERE doc_id % 2 = 0 GROUP BY 1)
  SELECT CASE WHEN a.company IS NULL THEN 'unassigned' WHEN e.id IS NULL THEN 'new deal' ELSE 'confirm' END AS action, count(*) AS n FROM {{upload_files}} u LEFT JOIN a ON a.filename = u.filename LEFT JOIN e ON e.n = lower(a.company) GROUP BY 1""")
q("c36_upload_valid", "upload_files", lambda u: u.select("doc_id", x.upload_valid(c("filename"), c("n_bytes"), ["pdf", "docx", "png"], 100).alias("ok")), "SELECT doc_id, doc_id % 8 IN (0, 1, 4, 5, 6) AND n_chars * 30000 / 1048576e0 <= 100 AS ok FROM {documents}")
ASKED = "CASE turn % 9 WHEN 0 THEN ' Any RED FLAG?' WHEN 1 THEN ' benchmark, then a memo' WHEN 2 THEN ' a Summary' WHEN 3 THEN ' improve the pitch' WHEN 4 THEN ' missing document' WHEN 5 THEN ' value prop' WHEN 6 THEN ' compare the score' WHEN 7 THEN ' risk of the team' ELSE '' END"
q("c37_intents", "conversations", lambda v: v.groupBy(x.intent(F.concat("role", F.expr(ASKED)), c("conv_id") % 2 == 0).alias("intent")).agg(F.count("*").alias("n")),
  """SELECT CASE WHEN conv_id % 2 = 0 THEN CASE turn % 9 WHEN 0 THEN 'risk' WHEN 1 THEN 'compare' WHEN 2 THEN 'memo' WHEN 6 THEN 'compare' WHEN 7 THEN 'risk' ELSE 'general' END
  ELSE CASE turn % 9 WHEN 3 THEN 'score' WHEN 4 THEN 'documents' WHEN 5 THEN 'pitch' WHEN 6 THEN 'score' ELSE 'general' END END AS intent, count(*) AS n FROM {conversations} GROUP BY 1""")
q("c38_profit_flags", "customer", lambda m: m.select("c_custkey", x.is_profit(F.concat(F.when(c("c_acctbal") < 0, "-$").otherwise("$"), F.lit("1.2M - 3M"))).alias("profit")), "SELECT c_custkey, c_acctbal >= 0 AS profit FROM {customer}")
