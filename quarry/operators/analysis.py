"""Analysis state of deals: planner, ledger and decision pack, kept as nested snapshots; facts stay rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import half_up
from ..functions.text import sanitize_deep

# What an analysis begins with.
GOALS = ("Validate market & problem", "Verify predictive validity", "Quantify monetization realism", "Team/competition assessment")
CONSTRAINTS = ("deck-facts-only", "cite-or-uncertain")
FOCUS = "Initial market validation"

PLANNER = "struct<cycle:int,goals:array<string>,constraints:array<string>,hypotheses:array<string>,subgoals:array<string>,focus:string,stop_reason:string>"
LEDGER = "struct<cycles:bigint,depth_delta:array<double>,subgoals:bigint,constraints:bigint,dead_ends:bigint,paraphrase_invariance:double,brier:double>"


def _texts(values: tuple[str, ...] = ()) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _or(x: Column, default: Column | float | int) -> Column:
    """x, or the default where it is null or zero."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, default if isinstance(default, Column) else F.lit(default)).otherwise(x)


def first_planner() -> Column:
    """The planner of an analysis that begins."""
    return F.struct(
        F.lit(1).alias("cycle"), _texts(GOALS).alias("goals"), _texts(CONSTRAINTS).alias("constraints"), _texts().alias("hypotheses"), _texts().alias("subgoals"), F.lit(FOCUS).alias("focus"), F.lit(None).cast("string").alias("stop_reason"),
    ).cast(PLANNER)


def first_ledger() -> Column:
    zero = F.lit(0)
    return F.struct(zero.alias("cycles"), F.array().alias("depth_delta"), zero.alias("subgoals"), zero.alias("constraints"), zero.alias("dead_ends"), F.lit(1.0).alias("paraphrase_invariance"), F.lit(0.0).alias("brier")).cast(LEDGER)


def begin(snapshot: DataFrame, deals: DataFrame) -> DataFrame:
    """The snapshot (deal_id, planner, ledger) after analyses of deals (deal_id) have begun: the whole planner is replaced, of a ledger that is
    there cycles and paraphrase_invariance alone; other deals keep theirs. One join; a deal that is asked for twice begins once."""
    asked = deals.select("deal_id").filter("deal_id IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    rows = snapshot.select("deal_id", F.col("planner").cast(PLANNER).alias("planner"), F.col("ledger").cast(LEDGER).alias("ledger")).join(asked, "deal_id", "full")
    kept = F.col("ledger").withField("cycles", F.lit(0).cast("long")).withField("paraphrase_invariance", F.lit(1.0))
    begun = F.coalesce("asked", F.lit(False))
    return rows.select("deal_id", F.when(begun, first_planner()).otherwise(F.col("planner")).alias("planner"), F.when(begun, F.coalesce(kept, first_ledger())).otherwise(F.col("ledger")).alias("ledger"))


def saved(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after changes (deal_id, at, planner, ledger), of which either may be null: by deal the last planner and the last ledger
    hold, each as a whole and each with the other's earlier state beside it. Texts of planners lose control characters."""
    clean = sanitize_deep(F.col("planner").cast(PLANNER), T.DataType.fromDDL(PLANNER))
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.struct("at", F.col(x)))).alias(f"new_{x}")  # noqa: E731  ties: the greater
    new = changes.withColumns({"planner": F.when(F.col("planner").isNotNull(), clean), "ledger": F.col("ledger").cast(LEDGER)}).groupBy("deal_id").agg(last("planner"), last("ledger"))
    rows = snapshot.select("deal_id", "planner", "ledger").join(new, "deal_id", "full")
    return rows.select("deal_id", F.coalesce("new_planner", "planner").alias("planner"), F.coalesce("new_ledger", "ledger").alias("ledger"))


def states(snapshot: DataFrame, facts: DataFrame, packs: DataFrame) -> DataFrame:
    """Per deal with a planner: current_cycle (null for 0), planner, ledger with its defaults (1.0 for an invariance that is null or 0), its
    latest pack with empty lists for null ones, n_facts, confidence (mean of facts in whole hundredths, 0 without facts), and risks,
    those of the pack's risk map. Facts and packs are aggregated before they are joined; the facts themselves are facts_in_order()."""
    g = F.col("ledger")
    ledger = F.struct(
        _or(g["cycles"], F.lit(0).cast("long")).alias("cycles"), F.coalesce(g["depth_delta"], F.array().cast("array<double>")).alias("depth_delta"), *[_or(g[x], F.lit(0).cast("long")).alias(x) for x in ("subgoals", "constraints", "dead_ends")],
        _or(g["paraphrase_invariance"], 1.0).alias("paraphrase_invariance"), _or(g["brier"], 0.0).alias("brier"),
    )
    columns = [x for x in packs.columns if x not in ("deal_id", "created_at")]
    pack = packs.groupBy("deal_id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("pack"))
    for x in ("tranche_plan", "risk_map", "what_to_verify"):
        kind = packs.schema[x].dataType
        pack = pack.withColumn("pack", F.col("pack").withField(x, F.coalesce(F.col("pack")[x], F.array().cast(kind))))
    known = facts.groupBy("deal_id").agg(F.count("*").alias("n_facts"), half_up(F.sum("confidence_pct") / F.count("*")).alias("confidence"))
    rows = snapshot.filter("planner IS NOT NULL").join(known, "deal_id", "left").join(pack, "deal_id", "left")
    cycle = F.nullif(F.col("planner")["cycle"], F.lit(0))
    risks = F.coalesce(F.transform(F.col("pack")["risk_map"], lambda x: x["risk"]), _texts())
    return rows.select("deal_id", cycle.alias("current_cycle"), "planner", ledger.alias("ledger"), "pack", F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), risks.alias("risks"))


def facts_in_order(facts: DataFrame, snapshot: DataFrame, at: str = "id") -> DataFrame:
    """The facts of deals that have a planner, with their place in the deal: by cycle, then by when they were made."""
    order = Window.partitionBy("deal_id").orderBy("created_cycle", at, "id")
    return facts.join(snapshot.filter("planner IS NOT NULL").select("deal_id"), "deal_id", "left_semi").withColumn("place", F.row_number().over(order))


def verification_detail(documents: DataFrame) -> DataFrame:
    """A document's verification: its status (pending where there is none), pages, sizes of its lists of metrics and headings, and its result, or
    the message that there is none yet. documents: document_id, deal_id, title, type, status, verification_status, page_count,
    structured_data (with keyMetrics and mainHeadings) and verification_result (text)."""
    size = lambda x: F.coalesce(F.array_size(F.col("structured_data")[x]), F.lit(0)).cast("long")
    status = F.coalesce(F.nullif("verification_status", F.lit("")), F.lit("pending"))
    result = F.coalesce("verification_result", F.to_json(F.struct(F.lit("Verification in progress or not yet started").alias("message"))))
    return documents.select(
        "deal_id", "document_id", "title", "type", "status", status.alias("verification_status"), F.coalesce("page_count", F.lit(0)).alias("pages"), size("keyMetrics").alias("metrics_extracted"), size("mainHeadings").alias("sections_found"), result.alias("verification_result"),
    )

