"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of the id and the epoch) and queued; a copy's
virtual finish time is the source's cumulative tokens divided by the source's target. All
copies are sorted by that time, over range slots rather than in one task, and the queue is
cut at the total budget. Small sources repeat, up to ``max_repeats`` epochs.

Cumulative sums are in two levels, sums of slots and sums inside a slot, so that a source with
a third of all rows is spread over as many tasks as it has ``slot_rows`` rows.

Defined cases: a null text has size 0; rows of size 0 are never taken; null sources form one
source that comes last; null ids are ordinary ids; repeated rows are queued separately; a
source of size 0 has target 0; an empty table gives an empty result. Columns other than the
three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, staged

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = 3, budget: float | None = None) -> DataFrame:
    """``source, source_size, rows`` with each source's ``target``.

    Targets share the budget (all sizes by default) in proportion to the weights; a target
    stops at ``max_repeats`` times its source's size and the excess is shared again. In
    closed form: target = min(cap, level * weight) where the level is the largest over k of
    (budget - the k smallest caps per weight) / (the other weights).
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeats))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.lit(float(budget)) if budget is not None else F.sum(F.col("source_size").cast("double")).over(whole)
    ranked = ranked.withColumns({
        "total": total,
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = F.max((F.col("total") - F.col("capped")) / F.col("left")).over(whole)
    return ranked.select("source", "source_size", "rows", F.least("cap", level * F.col("weight")).alias("target"), "total")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeats: int = 3,
    budget: float | None = None,
    seed: int = 17,
    slot_rows: int = 4096,
) -> DataFrame:
    """One row per input row: ``row`` (a number), id, source, size, source_size, target, copies, taken, text_md5."""
    sized = staged(
        docs.select(
            col(docs, id_col).alias("doc_id"),
            col(docs, source_col).alias("source"),
            F.coalesce(F.regexp_count(col(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(col(docs, text_col), F.lit("")).cast("binary")).alias("text_md5"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = staged(source_targets(sources, weights, max_repeats, budget), "mix-targets")

    same = sized["source"].eqNullSafe(sources["source"])
    epochs = F.least(F.lit(max_repeats), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    copies = (
        sized.join(sources, same).where("size > 0 AND target > 0").select(
            "row", "doc_id", sized["source"].alias("source"), "size", "target",
            F.greatest(F.lit(1), F.ceil(F.col("rows") / slot_rows)).alias("slots"),
            F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"),
        )
    )
    h = F.xxhash64(F.col("doc_id"), F.col("epoch"), F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
    copies = copies.withColumn("h", h).withColumn("slot", F.floor(F.col("h") / float(2**63) * F.col("slots")))

    slots = copies.groupBy("source", "epoch", "slot").agg(F.sum("size").alias("slot_size"))
    queue = Window.partitionBy("source").orderBy("epoch", "slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("source").alias("s_source"), F.col("epoch").alias("s_epoch"), F.col("slot").alias("s_slot"),
        F.coalesce(F.sum("slot_size").over(queue), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "epoch", "slot").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        copies.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("epoch") == F.col("s_epoch")) & (F.col("slot") == F.col("s_slot")))
        .withColumn("finish", (F.col("before") + F.sum("size").over(inside)) / F.col("target"))
        .select("row", "doc_id", "source", "epoch", "size", "finish")
    )
    queued = staged(queued, "mix-queue")

    # Global order: range slots of the finish time, then the order inside the one slot that
    # holds the end of the budget.
    head = sources.agg(F.first("total").alias("total"), F.sum("rows").alias("rows")).first()
    total, rows = (head["total"] or 0.0), (head["rows"] or 0)
    cells = max(64, rows * max_repeats // slot_rows)
    cell = F.floor(F.col("finish") * cells)
    sums = queued.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.orderBy("cell"))
    ends = sums.select("cell", "size", running.alias("upto")).where(F.col("upto") > F.lit(total)).orderBy("cell").limit(1).first()
    if ends is None:  # the queue is no longer than the budget
        chosen = queued
    else:
        order = Window.orderBy("finish", F.col("source").isNull(), "source", "epoch", "doc_id", "row")
        last = queued.where(cell == ends["cell"]).withColumn("upto", F.sum("size").over(order) + F.lit(ends["upto"] - ends["size"]))
        chosen = queued.where(cell < ends["cell"]).unionByName(last.where(F.col("upto") <= total).drop("upto"))
    taken = chosen.groupBy("row").agg(F.count("*").alias("n"), F.sum("size").alias("words")).withColumnRenamed("row", "t_row")
    return (
        sized.join(sources, same).join(taken, F.col("row") == F.col("t_row"), "left")
        .select(
            "row", "doc_id", sized["source"].alias("source"), "size", "source_size", "target",
            F.coalesce("n", F.lit(0)).cast("int").alias("copies"), F.coalesce("words", F.lit(0)).alias("taken"), "text_md5",
        )
    )


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Rows with one id and text count as one document, which
    appears as often as they are taken together."""
    mixed = staged(mix_sources(docs, id_col=id_col, text_col=text_col, **options), "mix-result")
    keys = mixed.groupBy(F.col("doc_id").alias("g_id"), F.col("text_md5").alias("g_md5")).agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows"))
    keys = staged(keys, "mix-copies")
    if not keys.where("_rows > 1").isEmpty():
        docs = docs.dropDuplicates([id_col, text_col])
    taken = keys.where("_copies > 0").drop("_rows")
    same = col(docs, id_col).cast("long").eqNullSafe(taken["g_id"]) & (F.md5(F.coalesce(col(docs, text_col), F.lit("")).cast("binary")) == taken["g_md5"])
    joined = docs.join(taken, same)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[col(docs, c) for c in docs.columns])
