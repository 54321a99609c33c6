"""Operations that screens apply to lists: search, filter, dedupe, pivot, distribution, scores, funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio
from .rules import grade, messages

c = F.col
CATEGORIES = ("market", "team", "financial", "traction", "risk", "competitive")


def with_document_counts(deals: DataFrame, documents: DataFrame) -> DataFrame:
    n = documents.groupBy(c("deal_id").alias("id")).agg(F.count("*").alias("documents"))
    return deals.join(n, "id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def latest_by_name(deals: DataFrame) -> DataFrame:
    """One deal of each name: the latest, then the first by id. An aggregate, so copies shrink before the shuffle."""
    cols = deals.columns
    best = F.max_by(F.struct(*cols), F.struct(c("updated_at"), -c("id"))).alias("d")
    return deals.groupBy(c("name").alias("__name")).agg(best).select("d.*")


def search(deals: DataFrame, term: str = "", stage: str = "all", priority: str = "all") -> DataFrame:
    if term:
        deals = deals.filter(F.contains(F.lower("name"), F.lit(term.lower())))
    if stage != "all":
        deals = deals.filter(c("stage") == stage)
    return deals.filter(c("priority") == priority) if priority != "all" else deals


def portfolio_stats(deals: DataFrame) -> DataFrame:
    return deals.agg(F.count("*").alias("total"), F.count_if(c("stage") == "ready_decision").alias("ready"), F.coalesce(half_up(F.sum("score") / F.count("score")), F.lit(0.0)).alias("avg_score"), F.sum("id").alias("views"))


def sort_by(rows: DataFrame, key: str, direction: str | None) -> DataFrame:
    """desc, asc, or as it is."""
    return rows.orderBy(F.desc(key)) if direction == "desc" else rows.orderBy(F.asc(key)) if direction == "asc" else rows


def distribution(rows: DataFrame, key: str | Column) -> DataFrame:
    key = c(key) if isinstance(key, str) else key
    n = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("__all"))
    return n.crossJoin(F.broadcast(whole)).select("key", "n", ratio(c("n"), c("__all"), 1, 100).alias("pct"))


def score_bucket(score: Column) -> Column:
    return F.when(score <= 50, "0-50").when(score <= 70, "51-70").when(score <= 85, "71-85").when(score <= 100, "86-100")


def monthly(rows: DataFrame, at: str) -> DataFrame:
    """Counts per month with the change on the month before; months are few."""
    n = rows.groupBy(F.trunc(c(at).cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    return n.withColumn("change", c("n") - F.lag("n").over(Window.orderBy("month")))


def pivot_scores(scores: DataFrame, deals: list[int]) -> DataFrame:
    """Category by deal from one score column a category; the deals compared are named, so that there is no extra pass."""
    pairs = ", ".join(f"'{x}', {x}" for x in CATEGORIES)
    long = scores.filter(c("id").isin(deals)).selectExpr("id", f"stack({len(CATEGORIES)}, {pairs}) AS (category, score)")
    out = long.groupBy("category").pivot("id", deals).agg(F.max("score"))
    return out.select("category", *(c(str(d)).alias(f"deal_{d}") for d in deals))


def best_deal(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by("id", F.struct(c("overall"), -c("id"))).alias("best"), F.max("overall").alias("overall"))


def selectable(deals: DataFrame, chosen: DataFrame, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(the first distinct chosen, the deals that are left)."""
    taken = chosen.groupBy("id").agg(F.min("at").alias("at")).orderBy("at", "id").limit(most)
    return taken, deals.join(taken.select("id"), "id", "left_anti")


def filter_documents(documents: DataFrame, labels: dict[str, str], term: str = "", status: str | None = None, kind: str | None = None) -> DataFrame:
    """By a search in title or type label, a status, a type."""
    label = F.try_element_at(F.create_map(*(F.lit(v) for kv in labels.items() for v in kv)), c("type"))
    rows = documents.withColumn("label", F.coalesce(label, c("type")))
    if term:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(term.lower())) | F.contains(F.lower("label"), F.lit(term.lower())))
    rows = rows.filter(c("status") == status) if status else rows
    return rows.filter(c("type") == kind) if kind else rows


def document_stats(documents: DataFrame) -> DataFrame:
    """documents (status, quality_pct, size like '1.5 MB')."""
    done = F.count_if(c("status") == "completed")
    size = F.expr("try_cast(replace(size, ' MB', '') AS double)")
    return documents.agg(
        F.count("*").alias("total"), done.alias("done"), F.coalesce(ratio(done, F.count("*"), 0, 100), F.lit(0.0)).alias("pct"),
        F.coalesce(half_up(F.sum("quality_pct") / F.count("quality_pct")), F.lit(0.0)).alias("avg_score"), half_up(F.sum((size * 10).cast("long")) / 10.0, 1).alias("mb"),
    )


def library(rows: DataFrame, term: str = "", category: str = "all") -> DataFrame:
    """By name, any tag, or category."""
    if term:
        low = term.lower()
        rows = rows.filter(F.contains(F.lower("name"), F.lit(low)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low))))
    return rows.filter(c("category") == category) if category != "all" else rows


# Workspace

#: Fields of a deal form; a field counts as given unless it is null or empty.
FORM_FIELDS = (
    "company_name", "industry", "stage", "target_market", "market_size", "competitor_analysis", "team_size", "founder_experience", "advisors", "revenue", "funding_amount", "previous_funding", "burn_rate",
    "unit_economics", "financial_projections", "customers", "growth_rate", "key_metrics", "risk_factors", "mitigation_strategy", "unique_value", "competitive_advantage", "moat",
)


def given(field: str | Column) -> Column:
    return F.length(F.coalesce(c(field) if isinstance(field, str) else field, F.lit(""))) > 0


def revenue(x: Column) -> Column:
    """The digits of a text as a number, 0 if there are none."""
    return F.coalesce(digits(x), F.lit(0.0))


def digits(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", ""), F.lit("")).cast("decimal(38,0)").cast("double")


def leading_number(x: Column) -> Column:
    """The integer that a text starts with, else null."""
    return F.nullif(F.regexp_extract(x, "^\\s*([+-]?[0-9]+)", 1), F.lit("")).cast("double")


def holds(condition: Column) -> Column:
    """The condition, false where it is null."""
    return F.coalesce(condition, F.lit(False))


def _money() -> Column:
    return revenue(c("revenue"))


def _team() -> Column:
    return leading_number(c("team_size"))


def _customers() -> Column:
    return leading_number(c("customers"))


def _no_customers() -> Column:
    return ~given("customers") | holds(_customers() == 0)


def _smaller(n: int) -> Column:
    return ~given("team_size") | holds(_team() < n)


def category_scores(form: DataFrame) -> DataFrame:
    """form (id and FORM_FIELDS as text) with a score of 0 to 100 for each category."""
    p = lambda condition, n: F.when(condition, n).otherwise(0)
    market = p(given("industry"), 20) + p(given("stage"), 15) + p(given("target_market"), 25) + p(given("funding_amount"), 20) + p(_money() > 0, 20)
    team = 40 + p(_team() > 5, 20) + p(given("company_name"), 20) + p(given("founder_experience"), 20)
    money = p(_money() > 0, 30) + p(_money() > 100_000, 15) + p(_money() > 1_000_000, 15) + p(given("funding_amount"), 20) + p(given("previous_funding"), 20)
    traction = p(_money() > 0, 40) + p(_customers() > 0, 30) + p(given("growth_rate"), 30)
    risk = 70 - p(~given("revenue") | (digits(c("revenue")) == 0), 15) - p(_no_customers(), 15) - p(_smaller(3), 10)
    competitive = 50 + p(given("unique_value"), 25) + p(given("competitive_advantage"), 25)
    return form.select("*", *(F.greatest(F.least(x, F.lit(100)), F.lit(0)).alias(n) for n, x in zip(CATEGORIES, (market, team, money, traction, risk, competitive), strict=True)))


def overall(scores: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, (c(x) for x in CATEGORIES))
    return scores.withColumn("overall", half_up(total / F.lit(6.0))).withColumn("grade", grade(c("overall")))


def completeness(fields: tuple[str, ...] = FORM_FIELDS) -> Column:
    """Per cent of the fields that are given."""
    filled = reduce(lambda a, b: a + b, (given(c(f).cast("string")).cast("int") for f in fields))
    return half_up(filled * 100.0 / F.lit(float(len(fields))))


def issues() -> dict[str, Column]:
    """Per category, what is missing; own wording."""
    return {
        "market": messages((~given("target_market"), "no target market"), (~given("industry"), "no industry"), (_money() == 0, "no revenue figure")),
        "team": messages((_smaller(3), "the team is small"), (~given("founder_experience"), "nothing on the founders")),
        "financial": messages((_money() == 0, "no revenue yet"), (~given("funding_amount"), "no funding amount"), (~given("burn_rate"), "no burn rate")),
        "traction": messages((_no_customers(), "no customers shown"), (~given("growth_rate"), "no growth rate"), (~given("key_metrics"), "no key metrics")),
        "risk": messages((~given("risk_factors"), "no risks listed"), (~given("mitigation_strategy"), "no mitigation")),
        "competitive": messages((~given("competitive_advantage"), "no advantage named"), (~given("moat"), "no moat named")),
    }


def strengths() -> dict[str, Column]:
    say = lambda before, field, after="": F.concat(F.lit(before), c(field), F.lit(after))
    return {
        "market": messages((given("target_market"), "target market named"), (given("industry"), say("sector: ", "industry")), (_money() > 100_000, "revenue of six figures")),
        "team": messages((holds(_team() >= 5), "a team of five or more"), (given("founder_experience"), "experienced founders")),
        "financial": messages((_money() > 0, say("revenue: ", "revenue")), (given("funding_amount"), say("asks for ", "funding_amount")), (given("previous_funding"), "funded before")),
        "traction": messages((holds(_customers() > 0), say("customers: ", "customers")), (given("growth_rate"), say("growth: ", "growth_rate"))),
        "risk": messages((given("risk_factors"), "risks disclosed"), (given("mitigation_strategy"), "mitigation described")),
        "competitive": messages((given("competitive_advantage"), "clear advantage"), (given("unique_value"), "unique value")),
    }


def recommendations() -> dict[str, Column]:
    """Per category, what to do next. Own wording; a text has 50 characters or more where the effort must be medium."""
    always = F.lit(True)
    return {
        "market": messages((~given("target_market"), "Name the buyers that you address and count them by segment"), (~given("market_size"), "Put numbers with their sources to the size of the market"), (~given("competitor_analysis"), "Compare with the rivals")),
        "team": messages((~given("founder_experience"), "Say what the founders did before"), (~given("advisors"), "List advisers who would vouch for the team and its plan"), (always, "Show open positions")),
        "financial": messages((~given("burn_rate"), "Give monthly burn and runway"), (~given("unit_economics"), "Give cost and value of a customer"), (~given("financial_projections"), "Project three years")),
        "traction": F.array(F.lit("Show growth month by month"), F.lit("Show retention"), F.lit("Tell of customers won")),
        "risk": F.array(F.lit("List the main risks"), F.lit("Answer each risk"), F.lit("Cover regulation")),
        "competitive": F.array(F.lit("Set your features beside those of each rival in a table"), F.lit("Name the barriers"), F.lit("Say why you win")),
    }


def red_flags() -> Column:
    """Severity, message and action of what speaks against a deal."""

    def flag(bad: Column, severity: str, text: str, action: str) -> Column:
        return F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message"), F.lit(action).alias("action")))

    late = F.lower(F.coalesce("stage", F.lit(""))) != "pre-seed"
    return F.array_compact(F.array(
        flag((_money() == 0) & late, "high", "no revenue after the first stage", "add revenue or say when it comes"), flag(_no_customers(), "medium", "no customers", "add references or letters of intent"),
        flag(_smaller(2), "medium", "a founder alone", "add a founder or advisers"), flag(~given("competitive_advantage"), "low", "no advantage named", "say what sets the product apart"),
    ))


def green_flags() -> Column:
    best = F.greatest(*CATEGORIES)
    return messages(
        (_money() > 100_000, "revenue above 100 thousand"), (_money() > 1_000_000, "revenue above a million"), (holds(_customers() > 50), "more than 50 customers"), (holds(_team() >= 10), "a team of ten or more"),
        (given("previous_funding"), "funded before"), (best >= 90, "a category at 90 or more"),
    )


def quick_wins(most: int = 3) -> Column:
    """Of the categories below 70 with a recommendation, in order: the first one, its impact, its effort by its length."""
    rows = F.array(*(F.struct(F.lit(x).alias("category"), c(x).alias("score"), F.get(r, F.lit(0)).alias("what")) for x, r in recommendations().items()))
    weak = F.filter(rows, lambda r: (r["score"] < 70) & r["what"].isNotNull())
    win = lambda r: F.struct(r["category"].alias("category"), r["what"].alias("what"), (100 - r["score"]).alias("impact"), F.when(F.length(r["what"]) < 50, "low").otherwise("medium").alias("effort"))
    return F.slice(F.transform(weak, win), 1, most)


def achievements(score: Column, complete: Column) -> Column:
    return F.struct(F.lit(True).alias("first_analysis"), (complete >= 80).alias("complete_profile"), (score >= 85).alias("investment_ready"), (score == 100).alias("perfect"))


# Reports


def risk_matrix(risks: DataFrame) -> DataFrame:
    """risks (probability, impact of 1..5): cells with their counts and score."""
    return risks.groupBy("probability", "impact").agg(F.count("*").alias("n")).withColumn("score", c("probability") * c("impact"))


def notification_bucket(when: Column) -> Column:
    """By words in a text such as '5 minutes ago'; upper and lower case differ."""
    return F.when(when.rlike("now|minute|hour|Today"), "today").when(when.contains("Yesterday"), "yesterday").otherwise("this week")


def notifications(rows: DataFrame, preferences: DataFrame) -> DataFrame:
    """Rows (type, unread, when) of the types that preferences (type, enabled) allow; types it doesn't name are allowed."""
    off = preferences.filter(~c("enabled")).select("type")
    kept = rows.join(off, "type", "left_anti")
    return kept.groupBy(notification_bucket(c("when")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("unread").alias("unread"))


def counts_with_all(rows: DataFrame, key: str) -> DataFrame:
    """Counts per key and in all, as one more key."""
    n = rows.groupBy(c(key).alias("key")).agg(F.count("*").alias("n"))
    return n.unionByName(rows.agg(F.lit("all").alias("key"), F.count("*").alias("n")))


def funnel(steps: DataFrame) -> DataFrame:
    """steps (deal_id, position, step, n): width as per cent of the step at the first position, 30 at least; share of the largest."""
    w = Window.partitionBy("deal_id")
    first = F.min_by("n", "position").over(w)
    return steps.select("deal_id", "step", "n", F.greatest(ratio(c("n"), first, 1, 100), F.lit(30.0)).alias("width"), ratio(c("n"), F.max("n").over(w), 1, 100).alias("bar"))


def first_and_last(points: DataFrame) -> DataFrame:
    """points (deal_id, month, v): the first and the last value of each deal, and the largest."""
    return points.groupBy("deal_id").agg(F.min_by("v", "month").alias("first"), F.max_by("v", "month").alias("last"), F.max("v").alias("most"))


def last_cohorts(cohorts: DataFrame, most: int = 6) -> DataFrame:
    """cohorts (deal_id, month, retention): the last ones of each deal with their band; the number is the feature."""
    w = Window.partitionBy("deal_id").orderBy(F.desc("month"))
    return cohorts.withColumn("__n", F.row_number().over(w)).filter(c("__n") <= most).drop("__n").withColumn("band", retention_band(c("retention")))


def templates(rows: DataFrame, term: str = "", category: str = "all") -> DataFrame:
    """By a search in name or description, and category."""
    low = term.lower()
    found = rows.filter(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("description"), F.lit(low))) if low else rows
    return found.filter(c("category") == category) if category != "all" else found


def kpi(months: DataFrame) -> DataFrame:
    """months (month, n): the last month's value and its change on the month before in per cent."""
    w = Window.orderBy("month")  # months are few
    rows = months.select("month", "n", F.lag("n").over(w).alias("before"))
    return rows.agg(F.max_by("n", "month").alias("value"), F.max_by(half_up((c("n") - c("before")) / F.nullif(c("before").cast("double"), F.lit(0.0)) * 100), "month").alias("change"))


def retention_band(pct: Column) -> Column:
    return F.when(pct >= 70, "strong").when(pct >= 50, "fair").otherwise("weak")


def sparkline(points: DataFrame) -> DataFrame:
    """points (deal_id, i, v): x in 0..1, y in 0..100 from the top."""
    w = Window.partitionBy("deal_id")
    n, low, high = F.count("*").over(w), F.min("v").over(w), F.max("v").over(w)
    x = ratio(F.row_number().over(w.orderBy("i")) - 1, n - 1)
    return points.select("deal_id", "i", F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(100 - ratio(c("v") - low, high - low) * 100, F.lit(100.0)).alias("y"))


def verdict(score: Column) -> Column:
    return F.when(score >= 75, "go").when(score >= 50, "hold").otherwise("no-go")


def export_plan(sections: DataFrame) -> DataFrame:
    """sections (category, enabled, pages): pages, minutes and completion per category."""
    on = c("enabled")
    pages = F.sum(F.when(on, c("pages")).otherwise(0))
    return sections.groupBy("category").agg(F.count("*").alias("sections"), pages.alias("enabled_pages"), F.ceil(pages * 0.8).alias("minutes"), ratio(F.count_if(on), F.count("*"), 0, 100).alias("pct"))


def log_summary(log: DataFrame, most: int = 1000) -> DataFrame:
    """Counts per source of the most recent entries; the ring's size is the feature."""
    recent = log.orderBy(F.desc("seen"), F.desc("id")).limit(most)
    return recent.groupBy("source").agg(F.count("*").alias("n"), F.max("seen").alias("latest"))


def pinned_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("pinned"), "position")


def recommendation(score: Column) -> Column:
    return F.when(score >= 85, "strong buy").when(score >= 70, "buy").when(score >= 55, "watch").otherwise("pass")


def assigned_files(files: DataFrame, assignments: DataFrame, deals: DataFrame) -> DataFrame:
    """Files with the deal of their assignment (filename, company), by the deal's name; deals without one are new."""
    rows = files.join(assignments, "filename", "left").join(deals.groupBy(F.lower("name").alias("__n")).agg(F.min("id").alias("deal_id")), F.lower("company") == c("__n"), "left").drop("__n")
    return rows.withColumn("action", F.when(c("company").isNull(), "unassigned").when(c("deal_id").isNull(), "new deal").otherwise("confirm"))


def upload_valid(filename: Column, n_bytes: Column, accepted: list[str], most_mb: float) -> Column:
    return F.lower(F.regexp_extract(filename, "\\.([^.]+)$", 1)).isin(accepted) & (n_bytes / F.lit(1024.0 * 1024.0) <= most_mb)


def intent(question: Column, investor: Column) -> Column:
    """The first keyword's intent, by who asks."""
    low = F.lower(question)
    by = lambda table: F.coalesce(*(F.when(low.rlike(words), name) for words, name in table), F.lit("general"))
    return F.when(investor, by(INVESTOR_INTENTS)).otherwise(by(FOUNDER_INTENTS))


# Keywords of an investor's and of a founder's question, in order.
INVESTOR_INTENTS = (("red flag|risk", "risk"), ("compare|benchmark", "compare"), ("memo|summary", "memo"))
FOUNDER_INTENTS = (("score|improve", "score"), ("missing|document", "documents"), ("value prop|pitch", "pitch"))


def is_profit(amount: Column) -> Column:
    return amount.startswith("$")
