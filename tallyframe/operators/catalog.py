"""Catalog rows: the compact facts kept per source column, beside human judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What a flag is called in a source's summary.
WATCH_OUTS = {
    "high_null": "mostly null",
    "all_null": "empty",
    "numeric_stored_as_text": "numbers stored as text",
    "mixed_types": "mixed types",
    "constant": "constant value",
}


def column_facts(profiled: DataFrame, source: str) -> DataFrame:
    """One row per column: the slice of its profile a catalog keeps."""
    return profiled.select(
        F.lit(source).alias("source"),
        "position",
        "name",
        "inferred",
        "null_rate",
        "n_distinct",
        "flags",
        "median",
        "std",
        "top",
        "top_freq",
    )


def refresh(facts: DataFrame, recorded: DataFrame) -> DataFrame:
    """New facts with the ``role`` someone gave each column before."""
    kept = recorded.select("source", "name", "role")
    return facts.drop("role").join(kept, ["source", "name"], "left")


def refresh_sources(facts: DataFrame, recorded: DataFrame) -> DataFrame:
    """New source facts; a summary someone wrote stays, a drafted one is replaced."""
    kept = recorded.where(~F.col("drafted")).select("source", F.col("summary").alias("kept"))
    joined = facts.join(kept, "source", "left")
    return joined.withColumn("drafted", F.col("kept").isNull()).withColumn(
        "summary", F.coalesce("kept", "summary")
    ).drop("kept")


def source_summary(profiled: DataFrame, source: str) -> DataFrame:
    """``source, n_rows, n_cols, candidate_keys, watch_outs, summary``: facts restated."""
    phrases = F.create_map(*[F.lit(x) for pair in WATCH_OUTS.items() for x in pair])
    notable = F.filter("flags", lambda f: F.map_contains_key(phrases, f))
    said = F.concat(
        F.col("name"), F.lit(" ("),
        F.array_join(F.transform(notable, lambda f: phrases[f]), ", "), F.lit(")"),
    )
    # one row per column of one table: a list bounded by its width
    pick = lambda condition, value: F.transform(
        F.array_sort(F.collect_list(F.when(condition, F.struct("position", value.alias("v"))))),
        lambda s: s["v"],
    )
    rows = profiled.groupBy().agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        pick(F.array_contains("flags", "possible_key"), F.col("name")).alias("candidate_keys"),
        pick(F.size(notable) > 0, said).alias("noted"),
    )
    keys, noted = F.array_join("candidate_keys", ", "), F.array_join("noted", "; ")
    text = F.concat(
        F.format_string("%d rows, %d columns.", "n_rows", "n_cols"),
        F.when(keys != "", F.concat(F.lit(" Candidate key(s): "), keys, F.lit("."))).otherwise(""),
        F.when(noted != "", F.concat(F.lit(" Watch-outs: "), noted, F.lit("."))).otherwise(""),
    )
    return rows.select(
        F.lit(source).alias("source"), "n_rows", "n_cols", "candidate_keys",
        noted.alias("watch_outs"), text.alias("summary"), F.lit(True).alias("drafted"),
    )
