"""The content-hash cache, model routing, prompts and flags as table operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbers import half_up, ratio
from .rules import messages

c = F.col
TTL_DAYS, MOST_ENTRIES = 7, 10_000
CACHED_TASKS = ("fact-extraction", "hypothesis-generation", "classification", "query-generation")
# Dollars for a million tokens saved, by the model's whole name.
PRICES = {"gpt-4o": 5.0, "qwen-14b": 0.02, "llama-70b": 0.05}
DEFAULT_PRICE = 5.0


def cache_key(content_hash: Column, task: Column, model: Column, temperature: Column) -> Column:
    """A missing model is 'default'; a missing temperature, or one of 0, is 0.7; whole numbers have no point."""
    number = F.when(temperature == F.floor(temperature), temperature.cast("long").cast("string")).otherwise(temperature.cast("string"))
    parts = (content_hash, task, F.coalesce(F.nullif(model, F.lit("")), F.lit("default")), F.coalesce(F.when(temperature != 0, number), F.lit("0.7")))
    return F.sha2(F.concat_ws(":", *parts), 256)


def _replayed(ttl: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over requests (key, at in microseconds, id) in order of key and time: one entry in memory, however long a key's history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored = object(), 0
        for batch in batches:
            outcomes = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit = k == key and at - stored <= ttl
                if not hit:
                    key, stored = k, at
                outcomes.append("hit" if hit else "miss")
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(outcomes, pa.string())], names=["key", "id", "outcome"])

    return run


def replay(requests: DataFrame, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Replay of requests (key, at, eligible, id) against an unbounded cache: hit, miss, or null where the task isn't
    eligible. A miss stores the result; an entry lives for ttl_days from its store, which only going through a key's
    requests in order can tell: they are sorted by key and time in their partition and read as a stream."""
    micros = F.unix_micros(c("at").cast("timestamp"))
    ordered = requests.filter("eligible").select("key", micros.alias("at"), "id").repartition("key").sortWithinPartitions("key", "at", "id")
    done = ordered.mapInArrow(_replayed(ttl_days * 86_400_000_000), "key string, id long, outcome string")
    return done.unionByName(requests.filter(~c("eligible")).select(c("key").cast("string").alias("key"), c("id").cast("long").alias("id"), F.lit(None).cast("string").alias("outcome")))


def lookup(requests: DataFrame, entries: DataFrame, at: Column) -> DataFrame:
    """Requests (key) joined to live entries (key, expires_at, result): hit or miss."""
    alive = entries.filter(c("expires_at") >= at).select("key", "result")
    return requests.join(alive, "key", "left").withColumn("outcome", F.when(c("result").isNull(), "miss").otherwise("hit"))


def looked_up(requests: DataFrame, entries: DataFrame, enabled: Column | bool = True) -> DataFrame:
    """Each request (key, task, at) with an outcome: null, which isn't counted, where the cache is off or the task isn't one that is
    cached; hit where its key's entry (key, expires_at) hasn't expired at that time; else miss. One join; of entries that share a key the
    one that lives longest counts; a null key has no entry."""
    alive = entries.groupBy("key").agg(F.max("expires_at").alias("__expires"))
    counted = (enabled if isinstance(enabled, Column) else F.lit(enabled)) & c("task").isin(*CACHED_TASKS)
    live = F.coalesce(c("at") <= c("__expires"), F.lit(False))
    rows = requests.join(alive, "key", "left")
    return rows.withColumn("outcome", F.when(counted, F.when(live, "hit").otherwise("miss"))).drop("__expires")


def with_hits(entries: DataFrame, looked: DataFrame) -> DataFrame:
    """Entries with their hits (a column of them) raised by those that looked_up() found."""
    new = looked.filter("outcome = 'hit'").groupBy("key").agg(F.count("*").alias("__new"))
    return entries.join(new, "key", "left").withColumn("hits", c("hits") + F.coalesce("__new", F.lit(0))).drop("__new")


def evict(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The most recently created entries; the limit is the feature. A top-k, so each task keeps most rows before the merge."""
    return entries.orderBy(F.desc("created_at"), "key").limit(most)


def import_entries(entries: DataFrame, at: Column) -> DataFrame:
    return entries.filter(c("expires_at") >= at)


def model_price(model: Column) -> Column:
    known = F.create_map(*(F.lit(v) for kv in PRICES.items() for v in kv))
    return F.coalesce(F.try_element_at(known, model), F.lit(DEFAULT_PRICE))


def savings(tokens: Column, model: Column) -> Column:
    return tokens / F.lit(1e6) * model_price(model)


def stats(events: DataFrame) -> DataFrame:
    hits, misses = F.count_if(c("event_type") == "hit"), F.count_if(c("event_type") == "miss")
    return events.agg(hits.alias("hits"), misses.alias("misses"), ratio(hits, hits + misses, 2, 100).alias("hit_rate"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def top_hits(events: DataFrame, k: int = 10) -> DataFrame:
    return events.filter("event_type = 'hit'").groupBy("content_hash").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "content_hash").limit(k)


def by_task(entries: DataFrame, task: str) -> DataFrame:
    return entries.filter(c("task_type") == task)


def entries_of(completed: DataFrame, answers: DataFrame, at: Column, days: int = TTL_DAYS) -> DataFrame:
    """The entries that answers (key, result) to the misses among completed requests add to the cache; tasks that aren't
    cached add none."""
    misses = completed.filter((c("outcome") == "miss") & c("task").isin(*CACHED_TASKS)).select("key", "task").distinct()
    return misses.join(answers, "key").select("key", "task", "result", at.alias("created_at"), (at + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"))


# Routing

# The default model, tokens and temperature of each task.
TASKS = [
    ("fact-extraction", "qwen-14b", 2000, 0.2), ("hypothesis-generation", "gpt-4o", 3000, 0.7), ("classification", "qwen-7b-quantized", 500, 0.1),
    ("synthesis", "gpt-4o", 4000, 0.5), ("chat-response", "llama-70b", 1500, 0.7), ("query-generation", "qwen-7b-quantized", 800, 0.3),
]
# Each provider's priority, health and models; the model of a task that has no configuration, if the
# provider named first is up, and otherwise.
PROVIDERS = [("openai", 1, True, ["gpt-4o"]), ("self-hosted", 2, True, ["qwen-14b", "qwen-7b-quantized", "llama-70b"])]
SIMPLE_TASKS = ("fact-extraction", "classification", "query-generation", "hypothesis-generation", "cycle-analysis")
HARD_TASKS = ("synthesis", "validation", "chat-response")
SIMPLE_CHOICE, HARD_CHOICE = ("self-hosted", "qwen-14b", "gpt-4o"), ("openai", "gpt-4o", "llama-70b")


def task_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task string, model string, max_tokens int, temperature double")


def providers(spark: SparkSession, down: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(p, n, up and p not in down, m) for p, n, up, m in PROVIDERS], "provider string, priority int, healthy boolean, models array<string>")


def route(requests: DataFrame, tasks: DataFrame, offers: DataFrame, default: str = "gpt-4o") -> DataFrame:
    """Model, provider and fallback provider of each request (task, model).

    Model: the one asked for, else the task's in tasks (task, model, and perhaps provider and fallback_provider), else by
    the kind of task and what is up, else default. Provider: the task's if it is up and has the model, unless a model
    was asked for; else one that is up and has it; else any that is up, by priority; else null. Fallback: the task's if
    it is up, else the one up with the lowest priority number. The routing tables are literals of a few rows.
    """
    extra = [x if x in tasks.columns else F.lit(None).cast("string").alias(x) for x in ("provider", "fallback_provider")]
    config = tasks.select("task", c("model").alias("__model"), *extra).withColumnsRenamed({"provider": "__provider", "fallback_provider": "__fallback"})
    up = offers.filter("healthy").agg(F.array_sort(F.collect_list(F.struct("priority", "provider", "models"))).alias("__up"))
    rows = requests.withColumnRenamed("model", "__asked").join(F.broadcast(config), "task", "left").crossJoin(F.broadcast(up))
    is_up = lambda p: F.exists("__up", lambda x: x["provider"] == p)
    choice = lambda first, good, other: F.when(is_up(F.lit(first)), good).otherwise(other)
    by_kind = F.when(c("task").isin(*SIMPLE_TASKS), choice(*SIMPLE_CHOICE)).when(c("task").isin(*HARD_TASKS), choice(*HARD_CHOICE))
    asked = F.nullif(c("__asked"), F.lit(""))
    rows = rows.withColumn("model", F.coalesce(asked, "__model", by_kind, F.lit(default)))
    serving = F.filter("__up", lambda x: F.array_contains(x["models"], c("model")))
    wanted = F.filter(serving, lambda x: asked.isNull() & (x["provider"] == c("__provider")))
    first = lambda xs: F.get(xs, F.lit(0))["provider"]
    out = rows.withColumns({
        "provider": F.coalesce(first(wanted), first(serving), first(c("__up"))),
        "fallback": F.coalesce(F.when(is_up(c("__fallback")), c("__fallback")), first(c("__up"))),
    })
    return out.drop("__asked", "__model", "__provider", "__fallback", "__up")


# Events that fill a provider's buffer, seconds between its timed flushes, the first delay of a retry.
BUFFER_EVENTS, BUFFER_SECONDS, FIRST_DELAY = 100, 30, 1000


def configured(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests (task) with their task's configuration (model, max_tokens, temperature); nulls where it has none. tasks is a few rows of
    settings, checked to be one a task."""
    one = tasks.groupBy("task").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("model", "max_tokens", "temperature")])
    checked = one.withColumn("task", F.when(c("n") > 1, F.raise_error(F.lit("a task has two configurations"))).otherwise(c("task"))).drop("n")
    return requests.join(checked, "task", "left")


# Settings of the two kinds of request.
EXTRACT, SYNTHESIZE = ("fact-extraction", 0.2, 2000), ("synthesis", 0.5, 3000)


def _request(kind: tuple[str, float, int], system: str, *user: Column) -> list[Column]:
    messages_ = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", F.concat(*user)))])
    return [F.lit(kind[0]).alias("task"), messages_.alias("messages"), F.lit(kind[1]).alias("temperature"), F.lit(kind[2]).alias("max_tokens")]


def extract_requests(rows: DataFrame) -> DataFrame:
    """Requests that ask for the facts of documents: rows (document, instructions, ...) condensed, as task, messages, temperature and
    max_tokens beside the other columns."""
    keep = [x for x in rows.columns if x not in ("document", "instructions")]
    made = document_contexts(rows)
    return made.select(*keep, *_request(EXTRACT, "You find structured facts in documents.", c("instructions"), F.lit("\n\nDocument:\n"), c("document")))


def synthesize_requests(rows: DataFrame) -> DataFrame:
    """Requests that ask for a synthesis: rows (facts, hypotheses, queries, ...) condensed."""
    keep = [x for x in rows.columns if x not in ("facts", "hypotheses", "queries")]
    user = (F.lit("Facts:\n"), c("facts"), F.lit("\n\nHypotheses:\n"), c("hypotheses"), F.lit("\n\nAnalyze:\n"), c("queries"))
    return analysis_contexts(rows).select(*keep, *_request(SYNTHESIZE, "You weigh evidence for an investment. Be exact and name sources.", *user))


def flushes(events: DataFrame) -> DataFrame:
    """The flushes of each provider's event buffer, from events (provider, at, id): a full buffer is flushed at once, the
    rest at the next tick of the clock. Per flush its number of events and the total so far."""
    tick = F.floor(F.unix_micros(c("at").cast("timestamp")) / (BUFFER_SECONDS * 1_000_000))
    within = Window.partitionBy("provider", "tick").orderBy("at", "id")
    rows = events.withColumn("tick", tick).withColumn("flush", F.floor((F.row_number().over(within) - 1) / BUFFER_EVENTS))
    done = rows.groupBy("provider", "tick", "flush").agg(F.count("*").alias("events"))
    return done.withColumn("total_flushed", F.sum("events").over(Window.partitionBy("provider").orderBy("tick", "flush")))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before the next attempt: doubled each time, from attempt 0 on."""
    return F.lit(FIRST_DELAY) * F.pow(F.lit(2), attempt).cast("long")


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a hosted call; null for models that have no price."""
    return F.when(model == "gpt-4o", tokens_in / F.lit(1e6) * 5 + tokens_out / F.lit(1e6) * 15)


def feature_enabled(enabled: Column, percentage: Column, user: Column) -> Column:
    return enabled & F.when(percentage <= 0, False).when(percentage >= 100, True).otherwise(t.bucket_31(user) < percentage)


# Fixed values.
STRATEGIES = ("cost-aware", "performance", "balanced")


def config_errors(key: Column) -> Column:
    """What keeps a configuration from running: a model key that is missing or has less than ten characters."""
    n = F.length(F.coalesce(key, F.lit("")))
    return messages((n == 0, "no key"), ((n > 0) & (n < 10), "the key is short"))


def config_warnings(enabled: Column, key: Column, cache: Column, compression: Column, analytics: Column, ttl: Column, size: Column, strategy: Column) -> Column:
    """What may be meant otherwise: switches that are off, a key of another form, and values out of their ranges."""
    n = F.length(F.coalesce(key, F.lit("")))
    return messages(
        (~enabled, "models are off"), ((n >= 10) & ~key.startswith("sk-"), "the key has another form"), (~cache, "the cache is off"), (~compression, "compression is off"), (~analytics, "analytics is off"),
        (~ttl.between(1, 90), "time to live is out of 1 to 90 days"), (size < 100, "the cache is below 100 entries"), (~strategy.isin(*STRATEGIES), "unknown strategy"),
    )


# Prompts

# Own wording; the cycles and what each asks for are the rule.
SYSTEM_PROMPTS = {
    1: "OBJECTIVE: scan the material broadly. INSTRUCTIONS: list hypotheses, uncertainties and binding constraints as JSON, cite a source for each.",
    2: "OBJECTIVE: resolve what is uncertain. INSTRUCTIONS: give resolutions and tests as JSON, with confidence from 0 to 1.",
    3: "OBJECTIVE: reach a recommendation. INSTRUCTIONS: give summary, go_no_go_recommendation, tranches, risks and what_to_verify as JSON.",
}


def system_prompt(cycle: Column) -> Column:
    return F.element_at(F.array(*(F.lit(SYSTEM_PROMPTS[k]) for k in (1, 2, 3))), cycle)


def user_prompt(cycle: Column, deal: Column, deck: Column, documents: Column, first: Column, second: Column, facts: Column) -> Column:
    """The prompt of a cycle: the first with deck and documents, the second with the first's output and the deck, the
    third with both outputs and the facts (claim, source, confidence). The asking sentence is in own wording."""
    part = lambda title, body: F.concat(F.lit(f"{title}:\n"), body)
    blocks = lambda *x: F.concat_ws("\n\n", *x)
    some = F.when(F.size(F.coalesce(documents, F.array().cast("array<string>"))) > 0, part("SUPPORTING DOCUMENTS", F.array_join(documents, "\n---\n")))
    listed = F.array_join(F.transform(facts, lambda f: F.concat(F.lit('- "'), f["claim"], F.lit('" ('), f["source"], F.lit(", confidence: "), f["confidence"], F.lit(")"))), "\n")
    body = (
        F.when(cycle == 1, blocks(part("PITCH DECK", deck), some))
        .when(cycle == 2, blocks(part("CYCLE 1 ANALYSIS", first), part("DEAL MATERIALS", deck)))
        .otherwise(blocks(part("CYCLE 1 ANALYSIS", first), part("CYCLE 2 ANALYSIS", second), part("ALL EXTRACTED FACTS", listed)))
    )
    ask = F.concat(F.lit("Carry out cycle "), cycle.cast("string"), F.lit(" as the system prompt says. Answer in valid JSON."))
    return blocks(F.concat(F.lit("DEAL: "), deal), body, ask)


def replace_first(x: Column, old: str, new: str) -> Column:
    at = F.instr(x, old)
    return F.when(at > 0, F.concat(F.left(x, at - 1), F.lit(new), F.substring(x, at + len(old), F.length(x)))).otherwise(x)


# The plain and the formal wording.
REPHRASED = (("What is", "Please specify"), ("How can", "In what manner might"), ("Does", "To what extent does"))


def paraphrases(prompt: Column, count: int = 3) -> Column:
    """The prompt; with count 2 its formal form too, with 3 its casual one, the inverse. Each wording is replaced where
    it first stands, one after the other."""
    formal, casual = prompt, prompt
    for plain, stiff in REPHRASED:
        formal, casual = replace_first(formal, plain, stiff), replace_first(casual, stiff, plain)
    return F.array(*(prompt, formal, casual)[: min(max(count, 1), 3)])


# Own wording; the answers asked for are the rule.
CITATION_ASK = "Does the source bear the claim? Answer VALID, NEEDS_VERIFICATION or INVALID."
CALIBRATION_ASK = "Does the confidence fit the evidence? Answer APPROPRIATE, TOO_HIGH or TOO_LOW."
PRESSURE_ASK = "Does it bind, what speaks against it, how likely is it met? Answer BINDING, CONDITIONALLY_BINDING or NOT_BINDING."
RISK_ASK = "Which risks follow if the claim is false? Answer in JSON: risks with risk, severity and mitigation."


def citation_prompt(claim: Column, source: Column) -> Column:
    return F.concat(F.lit('CLAIM: "'), claim, F.lit('"\nPROPOSED SOURCE: "'), source, F.lit(f'"\n\n{CITATION_ASK}'))


def calibration_prompt(claim: Column, evidence: Column, confidence: Column) -> Column:
    return F.concat(F.lit('CLAIM: "'), claim, F.lit('"\nEVIDENCE: "'), evidence, F.lit('"\nASSIGNED CONFIDENCE: '), confidence, F.lit(f"\n\n{CALIBRATION_ASK}"))


def pressure_prompt(constraint: Column, evidence: Column) -> Column:
    lines = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(F.lit('BINDING CONSTRAINT: "'), constraint, F.lit('"\n\nEVIDENCE:\n'), lines, F.lit(f"\n\n{PRESSURE_ASK}"))


def risk_prompt(claim: Column, context: Column) -> Column:
    return F.concat(F.lit('CLAIM: "'), claim, F.lit('"\nCONTEXT: "'), context, F.lit(f'"\n\n{RISK_ASK}'))


def prompt_errors(prompt: Column) -> Column:
    p = t.text(prompt)
    return messages((F.trim(p) == "", "the prompt is empty"), (F.length(p) > 8000, "the prompt is too long"), (~(p.contains("INSTRUCTIONS") | p.contains("OBJECTIVE")), "the prompt has no instructions"))


# The JSON contract of a model's answer in each cycle.
CONTRACTS = {
    1: "hypotheses array<struct<statement:string,confidence:double>>, uncertainties array<struct<question:string>>, constraints array<struct<constraint:string>>",
    2: "resolutions array<struct<question:string,answer:string,confidence:double>>, tests array<struct<test:string>>",
    3: "summary string, go_no_go_recommendation string, tranches array<struct<name:string,amount:double>>, risks array<struct<risk:string,severity:string>>, what_to_verify array<string>, calibration map<string,double>",
}


def parse_answer(answer: Column, cycle: int) -> Column:
    return F.from_json(answer, CONTRACTS[cycle])


def _reduced(rows: DataFrame, names: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """rows with the named texts condensed, cut at so many characters and summarised to so many lines, and the
    reduction in per cent. The Python half is a projection of its own, below the lambdas of the summary."""
    folded = rows.withColumns({f"__{n}": t.condensed(c(n)) for n in names})
    out = {}
    for n, (most, lines) in names.items():
        x = t.truncate(c(f"__{n}"), most) if most else c(f"__{n}")
        out[f"__{n}"] = t.summarize_lines(x, lines) if lines else x
    size = lambda xs: reduce(lambda a, b: a + b, (F.length(t.text(c(x))) for x in xs))
    cut = folded.withColumns(out)
    cut = cut.withColumn("reduction", 100 - ratio(size([f"__{n}" for n in names]), size(names)) * 100)
    return cut.drop(*names).withColumnsRenamed({f"__{n}": n for n in names})


def document_contexts(rows: DataFrame) -> DataFrame:
    """rows (document, instructions, ...): the document to 5,000 characters and 100 lines, the instructions whole."""
    return _reduced(rows, {"document": (5000, 100), "instructions": (None, None)})


def analysis_contexts(rows: DataFrame) -> DataFrame:
    """rows (facts, hypotheses, queries, ...): facts to 8,000 characters, hypotheses whole, queries to 4,000 and 50 lines."""
    return _reduced(rows, {"facts": (8000, None), "hypotheses": (None, None), "queries": (4000, 50)})


def complete(requests: DataFrame, entries: DataFrame, tasks: DataFrame, models: DataFrame, at: Column, most: int = 5000) -> DataFrame:
    """A request table through cache, compression and routing: hits keep their result, misses have a compressed prompt and a model."""
    looked = lookup(requests, entries, at)
    routed = route(looked.withColumn("model", F.lit(None).cast("string")), tasks, models)
    miss = c("outcome") == "miss"
    return routed.select("key", "task", "outcome", "result", F.when(miss, t.compress(c("content"), most)).alias("prompt"), F.when(miss, c("model")).alias("model"))


def average_cost(p: DataFrame) -> DataFrame:
    return p.groupBy("selected_model").agg(half_up(F.sum("cost_micro") / F.count("*"), 2).alias("micro"))


def latest_flags(flags: DataFrame) -> DataFrame:
    """The last setting of each flag."""
    w = Window.partitionBy("name").orderBy(F.desc("version"))
    return flags.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
