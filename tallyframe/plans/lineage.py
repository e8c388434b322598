"""Column lineage as joins: what each step did to each column, composed.

``step_columns`` holds one row per output column and input column of every step.
Chaining them gives ``DERIVES_FROM`` edges; walking edges gives origins and impact.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from tallyframe.plans.models import build_order
from tallyframe.plans.spec import run_spec, step_inputs
from tallyframe.session import hold, pin, pin_rows, small_frame

STEP_COLUMNS = (
    "model string, step_pos int, step string, op string, out_col string, in_kind string, "
    "in_table string, in_col string, rank int"
)


def column_id(label, table, column):
    """Node id of a column; its table's label is part of it."""
    return F.concat(F.lower(label), F.lit(":"), table, F.lit("::"), column)


def step_rows(model: str, results, sources: dict[str, str]):
    """Rows of ``step_columns`` for one model's steps. A source is keyed by its path."""
    for position, result in enumerate(results):
        kinds = {t.name: t.kind for t in result.inputs}
        for o in result.origins:
            kind = kinds.get(o.input)
            table = sources.get(o.input, o.input) if kind == "source" else o.input
            yield (model, position, result.id, result.op, o.output, kind, table, o.column, o.rank)


def step_columns(spark: SparkSession, models: dict[str, dict], **options) -> tuple[DataFrame, int]:
    """``step_columns`` of every model, and the most steps any has. Runs no data job."""
    rows, depth, book = [], 0, {}
    for name in build_order(models):
        results = run_spec(
            spark, models[name], models=models, measure=False, _book=book, **options
        )
        depth = max(depth, len(results))
        rows += step_rows(name, results, models[name].get("sources") or {})
    return small_frame(spark, rows, STEP_COLUMNS), depth


def model_reads(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """``model, in_kind, in_table``: the sources (by path) and models that each model's steps name as inputs.

    Taken from the declared inputs, so that a step whose columns cannot be traced, as one
    of SQL, still reads what it reads.
    """
    rows = set()
    for model, spec in models.items():
        sources, steps = spec.get("sources") or {}, spec.get("steps") or []
        for name in {n for step in steps for n in step_inputs(step)} - {step["id"] for step in steps}:
            rows.add((model, "source", sources[name]) if name in sources else (model, "model", name))
    return small_frame(spark, sorted(rows), "model string, in_kind string, in_table string")


def compose(steps: DataFrame, depth: int) -> DataFrame:
    """Each model column's origins: ``model, column, in_kind, in_table, in_col, via, step``.

    Starts at the last step and follows columns back through earlier steps of the
    same model, ``depth - 1`` joins in all. Where several steps touched a column the
    one that changed it most explains it, the later one on a tie.
    """
    last = steps.groupBy("model").agg(F.max("step_pos").alias("step_pos"))
    fields = ["model", "column", "in_kind", "in_table", "in_col", "rank", "pos", "op", "step"]
    current = steps.join(last, ["model", "step_pos"]).select(
        "model", F.col("out_col").alias("column"), "in_kind", "in_table", "in_col", "rank",
        F.col("step_pos").alias("pos"), "op", "step",
    )
    settled = []
    for _ in range(max(depth - 1, 0)):
        settled.append(current.where(F.col("in_kind") != "step"))
        inner = current.where(F.col("in_kind") == "step")
        back = steps.select(
            "model", F.col("step").alias("in_table"), F.col("out_col").alias("in_col"),
            F.col("in_kind").alias("b_kind"), F.col("in_table").alias("b_table"),
            F.col("in_col").alias("b_col"), F.col("rank").alias("b_rank"),
            F.col("step_pos").alias("b_pos"), F.col("op").alias("b_op"), F.col("step").alias("b_step"),
        )
        better = F.col("b_rank") > F.col("rank")
        pick = lambda a, b: F.when(better, F.col(b)).otherwise(F.col(a)).alias(a)
        current = inner.join(back, ["model", "in_table", "in_col"]).select(
            "model", "column", F.col("b_kind").alias("in_kind"), F.col("b_table").alias("in_table"),
            F.col("b_col").alias("in_col"), F.greatest("rank", "b_rank").alias("rank"),
            pick("pos", "b_pos"), pick("op", "b_op"), pick("step", "b_step"),
        )
    settled.append(current.where(F.col("in_kind") != "step"))
    traces = reduce(DataFrame.unionByName, [s.select(*fields) for s in settled])
    best = F.max_by(F.struct("op", "step"), F.struct("rank", "pos"))
    return (
        traces.groupBy("model", "column", "in_kind", "in_table", "in_col")
        .agg(best.alias("best"))
        .select(
            "model", "column", "in_kind", "in_table", "in_col", F.col("best.op").alias("via"),
            F.concat("model", F.lit("#"), "best.step").alias("step"),
        )
    )


def derives_from(composed: DataFrame) -> DataFrame:
    """``kind, src, dst, via, step``: edges from a model column back to its origins."""
    return composed.select(
        F.lit("DERIVES_FROM").alias("kind"),
        column_id(F.lit("Model"), F.col("model"), F.col("column")).alias("src"),
        column_id(F.col("in_kind"), F.col("in_table"), F.col("in_col")).alias("dst"),
        "via",
        "step",
    )


def unresolved(model_columns: DataFrame, composed: DataFrame) -> DataFrame:
    """``model, column, reason``: model columns with no origin that could be named."""
    return model_columns.join(composed, ["model", "column"], "left_anti").select(
        "model", "column", F.lit("no input column could be named underneath it").alias("reason")
    )


# --- walking ----------------------------------------------------------------------


EDGES_A_CELL = 250_000  # edges that a task walks back over in a round
FEW_STARTS = 4  # a walk forward comes first where the starts have less than one in so many edges


def origins(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``start, origin, hops``: where each start's trail ends, at the fewest hops.

    ``edges`` is ``src, dst``; ``starts`` is ``start``. One shuffle by node drops repeated
    edges, marks those of starts and of nodes with several. Origins then travel back, one hop a
    round: the edges are kept dealt by their ends, so a round moves only what the one before
    found. A node takes each of its origins up once, so that cycles end; a node with one edge
    cannot meet an origin twice, and only the others are compared with what they have. Where
    the starts are few, a walk forward first leaves out the edges that none can reach; it
    saves work and changes no row. ``max_hops`` leaves out longer trails if given.
    """
    rows = edges.where("src IS NOT NULL").select("src", "dst", F.lit(True).alias("edge")).unionByName(
        starts.select(F.col("start").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(False).alias("edge")))
    node = Window.partitionBy("src")
    seen = Observation()
    every = pin(rows.repartition("src").distinct().select(
        "src", "dst", "edge", (~F.min("edge").over(node)).alias("wanted"), (F.count_if("edge").over(node) > 1).alias("several"))
        .where("edge").drop("edge").observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("wanted").alias("wanted")))
    size = seen.get
    live = every if FEW_STARTS * size["wanted"] >= size["n"] else _ahead(every)
    by_end = hold(live.repartition(math.ceil(size["n"] / EDGES_A_CELL) or 1, "dst").sortWithinPartitions("dst"))
    # an edge to a node from which nothing goes on ends a trail
    goes_on = live.select(F.col("src").alias("dst")).distinct()
    found, n = pin_rows(by_end.join(goes_on, "dst", "left_anti").select(
        F.col("src").alias("node"), F.col("dst").alias("origin"), F.lit(1).alias("hops"), "wanted", "several"))
    reached = [found]
    while n and (max_hops is None or len(reached) < max_hops):
        back = by_end.join(reached[-1].select(F.col("node").alias("dst"), "origin"), "dst").select(
            F.col("src").alias("node"), "origin", F.lit(len(reached) + 1).alias("hops"), "wanted", "several")
        repeats = Observation()
        found = pin(back.observe(repeats, F.count(F.lit(1)).alias("n"), F.count_if("several").alias("several")))
        n = repeats.get["n"]
        if several := repeats.get["several"]:
            known = reduce(DataFrame.unionByName, reached).where("several").select("node", "origin")
            fresh, more = pin_rows(found.where("several").distinct().join(known, ["node", "origin"], "left_anti"))
            found, n = found.where("NOT several").unionByName(fresh), n - several + more
        reached.append(found)
    by_end.unpersist()
    return reduce(DataFrame.unionByName, reached).where("wanted").select(F.col("node").alias("start"), "origin", "hops")


def _ahead(every: DataFrame) -> DataFrame:
    """The edges that a start can reach, found node by node."""
    frontier, n = pin_rows(every.where("wanted").select("src").distinct())
    seen = [frontier]
    while n:
        known = reduce(DataFrame.unionByName, seen)
        further = every.join(seen[-1], "src").select(F.col("dst").alias("src")).distinct()
        frontier, n = pin_rows(further.join(known, "src", "left_anti"))
        seen.append(frontier)
    return pin(every.join(reduce(DataFrame.unionByName, seen), "src", "left_semi"))


def impact(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``node, hops``: everything built from the starts, the whole downstream closure.

    Each level is pinned, so the walk does not recompute itself, and ends when a
    level adds nothing new.
    """
    back = pin(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    seen = pin(starts.select(F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier, hop = seen, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = frontier.join(back, "node").select(F.col("next").alias("node")).distinct()
        frontier, n = pin_rows(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("hops") > 0)
