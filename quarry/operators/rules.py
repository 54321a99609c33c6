"""Score and rule engines as Columns: priorities, stages, cycle depth, ledgers, planners.

Every rule is an expression over one row, so that any number of rows is one projection; rules that fold over a deal's
history are windows or aggregates partitioned by deal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, points, ratio

c = F.col
STAGES = ("intake", "under_review", "in_diligence", "ready_decision", "pitched")
#: Old stage names and what they became.
LEGACY_STAGES = {"idea": "intake", "progress": "in_diligence", "ready": "ready_decision"}
MAX_CYCLE = 3
DEPTH_THRESHOLD = 2.0


def messages(*checks: tuple[Column, str | Column]) -> Column:
    """The messages of the checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks)))


# Priority and stage


def priority_points(score: Column, documents: Column, stage: Column, evidence: Column) -> Column:
    return (
        points((score >= 80, 40), (score >= 70, 30), (score >= 60, 20), (score >= 50, 10))
        + points((documents >= 4, 25), (documents == 3, 18), (documents == 2, 12), (documents == 1, 6))
        + points((stage == "pitched", 20), (stage == "ready_decision", 18), (stage == "in_diligence", 10), (stage == "under_review", 5))
        + points((evidence >= 5, 15), (evidence >= 3, 10), (evidence >= 1, 5))
    )


def priority(p: Column) -> Column:
    return F.when(p >= 70, "high").when(p >= 40, "medium").otherwise("low")


def next_stage(stage: Column, analysed: Column, documents: Column, score: Column, evidence: Column) -> Column:
    """The stage that the first rule that holds leads to, or the same."""
    return (
        F.when((stage == "intake") & analysed, "under_review")
        .when((stage == "under_review") & analysed & (documents >= 2), "in_diligence")
        .when((stage == "in_diligence") & (score >= 70) & (evidence >= 2), "ready_decision")
        .otherwise(stage)
    )


def remap_stage(stage: Column) -> Column:
    out = stage
    for old, new in LEGACY_STAGES.items():
        out = F.when(stage == old, new).otherwise(out)
    return out


# Cycles


def depth(findings: Column, facts: Column, questions: Column, uncertainties: Column, constraints: Column, coverage: Column) -> Column:
    """0 to 10, of eleven points."""
    got = (
        points((findings >= 5, 3), (findings >= 3, 2), (findings >= 1, 1))
        + points((facts >= 10, 2), (facts >= 5, 1))
        + points((questions > 0, 2))
        + points((uncertainties > 0, 2))
        + points((constraints, 1))
        + points((coverage, 1))
    )
    return F.least(got.cast("double") / F.lit(11.0) * F.lit(10.0), F.lit(10.0))


def depth_continues(constraints: Column, coverage: Column, paraphrase: Column) -> Column:
    return ~constraints | ~coverage | (paraphrase < 0.75)


def depth_reason(questions: Column, uncertainties: Column, constraints: Column, coverage: Column, paraphrase: Column) -> Column:
    """What the depth lacks, or that it is adequate. Own wording."""
    lacking = messages(
        (questions == 0, "no key questions"), (uncertainties == 0, "uncertainties unmapped"), (~constraints, "constraints unclear"), (~coverage, "thin evidence"),
        (F.coalesce(paraphrase, F.lit(1.0)) < 0.75, "answers vary"),
    )
    return F.when(F.size(lacking) == 0, "Depth adequate").otherwise(F.concat(F.lit("Depth insufficient: "), F.array_join(lacking, "; ")))


def next_cycle(cycle: Column, metric: Column, goes_on: Column, threshold: float = DEPTH_THRESHOLD) -> Column:
    """The next cycle's number as text, or synthesize."""
    stop = (cycle >= MAX_CYCLE) | ((metric < threshold) & ~goes_on)
    return F.when(stop, "synthesize").otherwise((cycle + 1).cast("string"))


def stop_reason(errors: Column, cycle: Column, paraphrase: Column) -> Column:
    return F.when(errors > 0, "errors").when(cycle >= MAX_CYCLE, "max_cycles").when(paraphrase < 0.5, "inconsistent")


def overall_confidence(avg_fact: Column, depth_: Column, citation: Column, facts: Column) -> Column:
    mixed = F.lit(0.5) * avg_fact + F.lit(0.3) * depth_ / F.lit(10.0) + F.lit(0.2) * citation
    return F.when(facts == 0, F.lit(0.0)).otherwise(clamp(mixed, 0.0, 1.0))


def fixed(x: Column, digits: int) -> Column:
    """x as text with so many digits behind the point, rounded half up."""
    scaled = F.floor(x.cast("double") * 10**digits + F.lit(0.5)).cast("long")
    whole = F.floor(scaled / 10**digits).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0")) if digits else scaled.cast("string")


def cycle_summary(cycle: Column, millis: Column, findings: Column, facts: Column, depth_: Column, goes_on: Column) -> Column:
    return F.format_string("Cycle %d completed in %dms | Findings: %d | Facts: %d | Depth: %s/10 | Continue: %s", cycle, millis, findings, facts, fixed(depth_, 1), goes_on.cast("string"))


def cycle_log(at: Column, cycle: Column, millis: Column, findings: Column, facts: Column, confidence: Column, depth_: Column) -> Column:
    """A log line: the cycle, then its metrics as JSON, shares with fixed digits."""
    entry = {"timestamp": at, "cycle": cycle, "duration_ms": millis, "findings_count": findings, "facts_count": facts, "confidence_score": fixed(confidence, 2), "depth_metric": fixed(depth_, 1)}
    return F.concat(F.lit("[CYCLE "), cycle.cast("string"), F.lit("] "), F.to_json(F.struct(*(v.alias(n) for n, v in entry.items()))))


def cycle_errors(cycle: Column, status: Column, output: Column, depth_: Column, millis: Column, error: Column) -> Column:
    """What is wrong with a cycle's result: number, status, worker output, depth, duration, and an error where it failed."""
    empty = lambda x: F.length(F.coalesce(x, F.lit(""))) == 0
    return messages(
        (~F.coalesce(cycle.between(1, MAX_CYCLE), F.lit(False)), "cycle must be 1 to 3"), (empty(status), "a status is needed"), (output.isNull(), "a worker output is needed"), (depth_.isNull(), "a depth is needed"),
        (F.coalesce(millis < 0, F.lit(True)), "duration must not be negative"), ((status == "failure") & empty(error), "a failure needs its error"),
    )


def progression(cycles: DataFrame) -> DataFrame:
    """Changes against the deal's cycle before (deal_id, cycle_number, findings_count, facts_extracted, confidence)."""
    w = Window.partitionBy("deal_id").orderBy("cycle_number")
    change = lambda x: (c(x) - F.lag(x).over(w))
    out = cycles.select("*", change("findings_count").alias("findings_delta"), change("facts_extracted").alias("facts_delta"), change("confidence").alias("confidence_delta"))
    d = c("findings_delta")
    return out.select(
        "deal_id", "cycle_number", "findings_delta", "facts_delta", "confidence_delta",
        F.when(d > 0, F.least(F.lit(10.0), F.lit(2.0) + F.lit(0.5) * d)).otherwise(F.lit(1.5)).alias("depth_delta"),
        F.coalesce((d > 0) & (c("confidence_delta") >= -0.05), F.lit(False)).alias("goes_on"),
    )


def cycles_remaining(cycle: Column, confidence: Column) -> Column:
    return F.when(confidence >= 0.7, F.when(cycle >= MAX_CYCLE, 0).otherwise(1)).otherwise(F.greatest(F.lit(MAX_CYCLE) - cycle, F.lit(0)))


# Facts and ledger


def fact_errors(claim: Column, source: Column, confidence: Column, cycle: Column) -> Column:
    """What is wrong with a fact; nulls are wrong in the first of two ways."""
    good_source = source.isin("deck.pdf", "uncertain") | source.startswith("http")
    return messages(
        (F.coalesce(F.length(claim) < 10, F.lit(True)), "claim too short"), (F.length(claim) > 200, "claim too long"), (~F.coalesce(good_source, F.lit(False)), "source must be deck.pdf, uncertain or a link"),
        (F.coalesce(confidence < 0, F.lit(True)), "confidence below 0"), (confidence > 1, "confidence above 1"), (~F.coalesce(cycle.between(1, MAX_CYCLE), F.lit(False)), "cycle must be 1 to 3"),
    )


def add_facts(facts: DataFrame) -> DataFrame:
    """Valid facts, the first (smallest id) of each (deal, claim, cycle)."""
    valid = facts.filter(F.size(fact_errors(c("claim"), c("source"), c("confidence"), c("created_cycle"))) == 0)
    w = Window.partitionBy("deal_id", "claim", "created_cycle").orderBy("id")
    return valid.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def fact_ledger(facts: DataFrame) -> DataFrame:
    """Per deal: facts, uncited ones, citation compliance (1 without facts), average confidence (0 without)."""
    uncited = F.count_if(c("source") == "uncertain")
    return facts.groupBy("deal_id").agg(
        F.count("*").alias("facts"), uncited.alias("uncited"), F.coalesce(ratio(F.count("*") - uncited, F.count("*"), 4), F.lit(1.0)).alias("citation_compliance"),
        F.coalesce(ratio(F.sum("confidence_pct"), F.count("confidence_pct"), 4, 0.01), F.lit(0.0)).alias("avg_confidence"),
    )


def update_confidence(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """facts with confidence replaced by that of changes (id, confidence), clamped to 0..1."""
    new = changes.select("id", c("confidence").alias("__new"))
    return facts.join(new, "id", "left").withColumn("confidence", F.when(c("__new").isNull(), c("confidence")).otherwise(clamp(c("__new"), 0.0, 1.0))).drop("__new")


def record_depth(deltas: Column, delta: Column, cycles: Column, cycle: Column) -> tuple[Column, Column]:
    """(depth deltas with one more, completed cycles)."""
    return F.array_append(deltas, delta), F.greatest(cycles, cycle)


def ledger_quality(paraphrase: Column, brier: Column) -> Column:
    """Quality points, 100 at most: 25 for citations, up to 30 for paraphrases, up to 25 for calibration, 20."""
    b = F.coalesce(brier, F.lit(0.5))
    p = points((paraphrase >= 0.9, 30), (paraphrase >= 0.8, 25), (paraphrase >= 0.7, 15), otherwise=5)
    q = points((b < 0.1, 25), (b < 0.2, 20), (b < 0.3, 10), otherwise=5)
    return F.least(F.lit(25) + p + q + F.lit(20), F.lit(100))


def citation_grade(any_depth: Column) -> Column:
    return F.when(any_depth, "good").otherwise("acceptable")


def paraphrase_grade(paraphrase: Column) -> Column:
    return F.when(paraphrase >= 0.9, "excellent").when(paraphrase >= 0.8, "good").when(paraphrase >= 0.7, "acceptable").otherwise("poor")


def calibration_grade(brier: Column) -> Column:
    """A missing Brier score counts as 0.5."""
    b = F.coalesce(brier, F.lit(0.5))
    return F.when(b < 0.1, "excellent").when(b < 0.2, "good").when(b < 0.3, "acceptable").otherwise("poor")


def ledger_summary(cycles: Column, subgoals: Column, constraints: Column, dead_ends: Column, paraphrase: Column, brier: Column) -> Column:
    """The subgoals are printed as facts, as the rule says."""
    last = (fixed(paraphrase * 100, 0), fixed(F.coalesce(brier, F.lit(0.0)), 2))
    return F.format_string("Cycles: %d | Facts: %d | Constraints: %d | Dead Ends: %d | Paraphrase Invariance: %s%% | Brier: %s", cycles, subgoals, constraints, dead_ends, *last)


# Planner

DEFAULT_GOALS = ("understand the business", "check the claims", "name the risks", "reach a decision")
DEFAULT_CONSTRAINTS = ("cite every fact", "stay within three cycles")


def add_item(items: Column, item: Column) -> Column:
    """Set semantics, order kept."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def remove_item(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def planner_goes_on(cycle: Column, delta: Column, threshold: float = DEPTH_THRESHOLD) -> Column:
    return (cycle != MAX_CYCLE) & (delta >= threshold)


def hypothesis_status(state: Column, confidence: Column) -> Column:
    return F.when(state == "resolved", F.when(confidence > 0.7, "supported").otherwise("contradicted")).when(state == "refined", "inconclusive").otherwise("testing")


def planner_errors(goals: Column, constraints: Column, cycle: Column) -> Column:
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    return messages((none(goals), "a goal is needed"), (none(constraints), "a constraint is needed"), (~cycle.between(1, MAX_CYCLE), "cycle must be 1 to 3"))


def next_focus(subgoals: Column, cycle: Column) -> Column:
    """The first open subgoal, else by the cycle. Own wording but for the prefix."""
    by_cycle = F.when(cycle == 1, "go deeper into the constraints").when(cycle == 2, "bring the findings together").when(cycle == 3, "finish the decision pack").otherwise("go on")
    return F.when(F.size(subgoals) > 0, F.concat(F.lit("Address: "), F.get(subgoals, F.lit(0)))).otherwise(by_cycle)


def planner_summary(cycle: Column, goals: Column, hypotheses: Column, subgoals: Column, focus: Column, stop: Column) -> Column:
    text = lambda x: F.nullif(x, F.lit(""))
    state = F.coalesce(F.concat(F.lit("Stopped: "), text(stop)), F.lit("Active"))
    return F.format_string("Cycle %d | Goals: %d | Hypotheses: %d | Subgoals: %d | Focus: %s | %s", cycle, F.size(goals), F.size(hypotheses), F.size(subgoals), F.coalesce(text(focus), F.lit("None")), state)


def progress_rule(cycle: Column, delta: Column) -> Column:
    """(progresses, next, reason): synthesize at the last cycle or below the threshold, else the next cycle's number."""
    grows = (cycle != MAX_CYCLE) & (delta >= DEPTH_THRESHOLD)
    reason = F.when(cycle == MAX_CYCLE, "last cycle").when(delta >= DEPTH_THRESHOLD, "depth still grows").otherwise("depth no longer grows")
    return F.struct(grows.alias("progresses"), F.when(grows, (cycle + 1).cast("string")).otherwise("synthesize").alias("next"), reason.alias("reason"))


# The states of an analysis by its cycle.
ACTIONS = {1: "run_cycle_2", 2: "run_cycle_3", 3: "synthesize"}


def next_action(cycle: Column, status: Column) -> Column:
    out = F
    for k, action in ACTIONS.items():
        out = out.when(cycle == k, action)
    return out.when(status == "complete", "view_decision_pack").otherwise("waiting_for_cycle_1")


def progress_percent(cycle: Column, done: Column) -> Column:
    return F.when(done, F.lit(100.0)).otherwise(half_up(cycle / F.lit(3.0) * F.lit(100.0)))


def prerequisite_errors(live: Column, documents: Column, decks: Column) -> Column:
    return messages((~live, "the deal doesn't exist"), (documents == 0, "a document is needed"), (decks == 0, "a pitch deck is needed"))


# Workspace scores


def grade(score: Column) -> Column:
    return F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 55, "Fair").otherwise("Needs Improvement")


# Multipliers of a deal's round and stage, and the dollars and hours of a plain deal.
ROUNDS = {"seed": 1.0, "series-a": 1.3, "series-b": 1.6, "series-c": 2.0, "series-d": 2.5}
ROUND_STAGES = {"idea": 1.5, "mvp": 1.2, "growth": 1.0, "scale": 0.9}
BASE_DOLLARS, BASE_HOURS = 22_000, 85


def savings(round_type: Column, stage: Column) -> tuple[Column, Column]:
    """(dollars, hours) saved, by the multipliers; a missing round is a seed, a missing stage an idea, an unknown one 1."""

    def pick(m: dict[str, float], x: Column, default: str) -> Column:
        known = F.create_map(*(F.lit(v) for kv in m.items() for v in kv))
        return F.coalesce(F.try_element_at(known, F.coalesce(F.nullif(x, F.lit("")), F.lit(default))), F.lit(1.0))

    money, hours = (F.lit(float(base)) * pick(ROUNDS, round_type, "seed") * pick(ROUND_STAGES, stage, "idea") for base in (BASE_DOLLARS, BASE_HOURS))
    return half_up(money), half_up(hours)


def risk_score(probability: Column, impact: Column) -> Column:
    return probability * impact


def risk_band(score: Column) -> Column:
    return F.when(score >= 15, "critical").when(score >= 10, "high").when(score >= 5, "medium").otherwise("low")
