"""The project graph as tables: nodes, structural edges, and measured overlaps.

``nodes``: id, label, key, name, table_id and the facts a node carries.
``edges``: kind, src, dst, via, step. ``overlaps``: one row per measured pair.
Node ids are ``<label>:<key>``; a column's is ``<label>:<table>::<column>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.plans.lineage import column_id

LABELS = ("Source", "Model", "Column", "Group")
STRUCTURAL = ("HAS_COLUMN", "IN_GROUP", "READS", "DERIVES_FROM")

NODE_COLUMNS = {
    "id": "string", "label": "string", "key": "string", "name": "string", "table_id": "string",
    "role": "string", "inferred": "string", "null_rate": "double", "n_distinct": "bigint",
    "flags": "array<string>", "summary": "string", "context": "string",
    "fingerprint": "string", "derivation": "string",
}
EDGE_COLUMNS = {"kind": "string", "src": "string", "dst": "string", "via": "string", "step": "string"}


def _shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()
    ])


def _id(label: str, key) -> Column:
    return F.concat(F.lit(label.lower() + ":"), key)


def build_nodes(sources, source_columns, models, model_columns, groups=None, unresolved=None):
    """Every node, from catalog and model tables. No data is read.

    ``sources``: name, path, and optional summary, drafted, fingerprint.
    ``source_columns``: source (its name), name, and column facts.
    ``models``: name, optional fingerprint. ``model_columns``: model, column.
    ``groups``: group, context, source. ``unresolved``: model, column.
    """
    paths = sources.select(F.col("name").alias("source"), "path")
    drafted = F.col("drafted") if "drafted" in sources.columns else F.lit(False)
    summary = F.col("summary") if "summary" in sources.columns else F.lit(None)
    parts = [
        # a summary drafted from checks is no one's reading and is left out
        sources.withColumn("summary", F.when(~drafted, summary)).select(
            "*", _id("Source", F.col("path")).alias("id"), F.lit("Source").alias("label"),
            F.col("path").alias("key"),
        ),
        models.select("*", _id("Model", F.col("name")).alias("id"), F.lit("Model").alias("label"),
                      F.col("name").alias("key")),
    ]
    own = source_columns.join(paths, "source")
    own_id = column_id(F.lit("Source"), F.col("path"), F.col("name"))
    parts.append(own.select(
        "*", own_id.alias("id"), own_id.alias("key"), F.lit("Column").alias("label"),
        _id("Source", F.col("path")).alias("table_id"),
    ))
    built = model_columns
    if unresolved is not None:
        marked = unresolved.select("model", "column", F.lit("unknown").alias("derivation")).distinct()
        built = built.join(marked, ["model", "column"], "left")
    built_id = column_id(F.lit("Model"), F.col("model"), F.col("column"))
    parts.append(built.select(
        "*", built_id.alias("id"), built_id.alias("key"), F.lit("Column").alias("label"),
        F.col("column").alias("name"), _id("Model", F.col("model")).alias("table_id"),
    ))
    if groups is not None:
        parts.append(groups.select("group", "context").distinct().select(
            _id("Group", F.col("group")).alias("id"), F.lit("Group").alias("label"),
            F.col("group").alias("key"), F.col("group").alias("name"), "context",
        ))
    return reduce(DataFrame.unionByName, [_shaped(p, NODE_COLUMNS) for p in parts])


def build_edges(nodes, model_reads, derived, sources=None, groups=None):
    """Structural edges. ``model_reads``: model, in_kind, in_table. ``derived`` as edges."""
    columns = nodes.where(F.col("label") == "Column")
    parts = [
        columns.select(F.lit("HAS_COLUMN").alias("kind"), F.col("table_id").alias("src"),
                       F.col("id").alias("dst")),
        model_reads.where(F.col("in_kind").isin("source", "model")).select(
            F.lit("READS").alias("kind"), _id("Model", F.col("model")).alias("src"),
            F.concat("in_kind", F.lit(":"), "in_table").alias("dst"),
        ).distinct(),
        # an origin whose own table is not in the graph says nothing
        derived.join(columns.select(F.col("id").alias("dst")), "dst", "left_semi"),
    ]
    if groups is not None and sources is not None:
        members = groups.join(sources.select(F.col("name").alias("source"), "path"), "source")
        parts.append(members.select(
            F.lit("IN_GROUP").alias("kind"), _id("Source", F.col("path")).alias("src"),
            _id("Group", F.col("group")).alias("dst"),
        ).distinct())
    return reduce(DataFrame.unionByName, [_shaped(p, EDGE_COLUMNS) for p in parts])


# --- overlaps on the graph ---------------------------------------------------------


def overlap_edges(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Overlap records keyed by column node, the latest per directed pair.

    Table names are resolved to nodes; see :func:`unattachable` for the rest.
    """
    resolved = _resolved(records, nodes).where(F.col("left_known") & F.col("right_known"))
    kept = ["n_shared_values", "left_coverage", "right_coverage", "comparable_types",
            "asked_because", "measured_at", "left_fingerprint", "right_fingerprint"]
    latest = F.max_by(F.struct(*kept), "measured_at")
    return resolved.groupBy("src", "dst", "src_table", "dst_table").agg(latest.alias("m")).select(
        "src", "dst", "src_table", "dst_table", "m.*"
    )


def unattachable(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Measured pairs with a column the graph does not hold: reported, never lost."""
    return _resolved(records, nodes).where(~(F.col("left_known") & F.col("right_known"))).select(
        *records.columns, "left_known", "right_known"
    )


def _resolved(records: DataFrame, nodes: DataFrame) -> DataFrame:
    tables = nodes.where(F.col("label").isin("Source", "Model")).select("id", "name")
    columns = nodes.where(F.col("label") == "Column").select("table_id", "name", "id")
    out = records
    for side, node, table in (("left", "src", "src_table"), ("right", "dst", "dst_table")):
        ends = tables.join(columns.select("table_id", F.col("name").alias("column"),
                                          F.col("id").alias("column_id")),
                           F.col("id") == F.col("table_id"))
        ends = ends.select(F.col("name").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"),
                           F.col("column_id").alias(node), F.col("id").alias(table))
        out = out.join(ends, [f"{side}_table", f"{side}_column"], "left").withColumn(
            f"{side}_known", F.col(node).isNotNull()
        )
    return out


def with_staleness(overlaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``stale``: a table changed since the measurement; null where that cannot be told."""
    now = lambda side, table: nodes.select(
        F.col("id").alias(table), F.col("fingerprint").alias(f"{side}_now")
    )
    joined = overlaps.join(now("left", "src_table"), "src_table", "left").join(
        now("right", "dst_table"), "dst_table", "left"
    )
    moved = (F.col("left_fingerprint") != F.col("left_now")) | (
        F.col("right_fingerprint") != F.col("right_now")
    )
    return joined.withColumn("stale", moved).drop("left_now", "right_now")


def overlap_rollup(overlaps: DataFrame) -> DataFrame:
    """``src_table, dst_table, n_measured_pairs`` across different tables."""
    return overlaps.where(F.col("src_table") != F.col("dst_table")).groupBy(
        "src_table", "dst_table"
    ).agg(F.count(F.lit(1)).alias("n_measured_pairs"))


def actionable_zeros(overlaps: DataFrame) -> DataFrame:
    """Pairs measured, comparable, and without one shared value."""
    return overlaps.where((F.col("n_shared_values") == 0) & F.col("comparable_types"))


def find(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that a user may mean: by id, by key (a path, or table and column), or by name."""
    return nodes.where((F.col("id") == text) | (F.col("key") == text) | (F.col("name") == text))


def column_overlaps(overlaps: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """What one column was measured against: ``other, direction, n_shared_values, own_coverage, other_coverage, ..., stale``.

    ``direction`` is ``from`` where the measurement started at the column and ``to`` where it
    ended there; coverages are told from the column's side either way.
    """
    here = with_staleness(overlaps, nodes).where((F.col("src") == column) | (F.col("dst") == column))
    own = F.col("src") == column
    side = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return here.select(
        side("dst", "src").alias("other"), F.when(own, "from").otherwise("to").alias("direction"), "n_shared_values",
        side("left_coverage", "right_coverage").alias("own_coverage"), side("right_coverage", "left_coverage").alias("other_coverage"),
        "comparable_types", "asked_because", "measured_at", "stale")


# --- questions ------------------------------------------------------------------------


def _related(df: DataFrame, relation: str, limit: int | None, *order: str) -> DataFrame:
    """The rows under their relation. With a limit, its first by name and a row saying how many more there are."""
    rows = df if limit is None else df.orderBy(*order).limit(limit)
    rows = rows.select(F.lit(relation).alias("relation"), *df.columns,
                       F.lit(None).cast("bigint").alias("not_shown"))
    if limit is None:
        return rows
    more = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(
        F.lit(relation).alias("relation"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
        (F.col("n") - limit).alias("not_shown"),
    )
    return rows.unionByName(more)


def table_neighbourhood(nodes, edges, overlaps, table_id: str, limit: int | None = None) -> DataFrame:
    """What a table reads, is read by, belongs to, and was measured against.

    A group has one row per member, named in ``member``. With a ``limit`` a longer relation
    ends in a row whose ``not_shown`` says how many more there are.
    """
    here = F.lit(table_id)
    tables = nodes.select(F.col("id").alias("other"), "label", "name", "key")
    none = F.lit(None).cast("bigint").alias("n_measured_pairs")

    def follow(kind, near, far):
        hit = edges.where((F.col("kind") == kind) & (F.col(near) == here))
        found = hit.select(F.col(far).alias("other")).join(tables, "other")
        return found.select("other", "label", "name", "key", none)

    touching = overlaps.where(
        ((F.col("src_table") == here) | (F.col("dst_table") == here))
        & (F.col("src_table") != F.col("dst_table"))
    ).select(F.when(F.col("src_table") == here, F.col("dst_table")).otherwise(
        F.col("src_table")).alias("other"))
    counted = touching.groupBy("other").agg(F.count(F.lit(1)).alias("n_measured_pairs"))
    counted = counted.join(tables, "other").select("other", "label", "name", "key", "n_measured_pairs")
    near = [
        _related(follow("READS", "src", "dst"), "reads", limit, "name"),
        _related(follow("READS", "dst", "src"), "read_by", limit, "name"),
        _related(counted, "overlaps", limit, "name"),
    ]
    member = edges.where(F.col("kind") == "IN_GROUP").join(
        nodes.select(F.col("id").alias("src"), F.col("name").alias("member")), "src"
    ).select(F.col("dst").alias("other"), "member")
    groups = _related(follow("IN_GROUP", "src", "dst"), "group", limit, "name").join(member, "other", "left")
    near = reduce(DataFrame.unionByName, near).withColumn("member", F.lit(None).cast("string"))
    return near.unionByName(groups).drop("other")


def column_lineage(nodes, edges, column: str, limit: int | None = None) -> DataFrame:
    """One hop each way: what a column derives from and what it feeds."""
    derived = edges.where(F.col("kind") == "DERIVES_FROM")
    named = nodes.select(F.col("id").alias("other"), F.col("name").alias("column"), "table_id")
    tables = nodes.select(F.col("id").alias("table_id"), F.col("label"), F.col("name").alias("table"))
    parts = []
    for relation, near, far in (("derives_from", "src", "dst"), ("feeds", "dst", "src")):
        hit = derived.where(F.col(near) == column).select(F.col(far).alias("other"), "via", "step")
        rows = hit.join(named, "other").join(tables, "table_id").select(
            "label", "table", "column", "via", "step"
        )
        parts.append(_related(rows, relation, limit, "table", "column"))
    return parts[0].unionByName(parts[1])


def with_derivation(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Origins with the table they lie in and whether the trail ends unread there."""
    named = nodes.select(F.col("id").alias("origin"), F.col("name").alias("column"), "table_id",
                         "derivation")
    return found.join(named, "origin", "left")


def unread_sources(nodes: DataFrame) -> DataFrame:
    """Sources nobody has summarised."""
    return nodes.where((F.col("label") == "Source") & F.col("summary").isNull()).select("id", "name")


def shared_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``group, context, source``: one row per membership."""
    member = edges.where(F.col("kind") == "IN_GROUP")
    source = nodes.select(F.col("id").alias("src"), F.col("name").alias("source"))
    group = nodes.select(F.col("id").alias("dst"), F.col("name").alias("group"), "context")
    return member.join(source, "src").join(group, "dst").select("group", "context", "source")


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, kind, n`` for node labels and edge kinds."""
    count = lambda df, what, by: df.groupBy(F.col(by).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node", "label").unionByName(count(edges, "edge", "kind"))


def merge_build(old_nodes, new_nodes, overlaps) -> DataFrame:
    """Nodes after a rebuild: the new ones, and old ones that carry a measurement.

    Structural edges are simply replaced by the new build's. Overlaps are never
    removed by a rebuild, so their ends stay.
    """
    ends = overlaps.select(F.col("src").alias("id")).unionByName(
        overlaps.select(F.col("dst").alias("id"))).distinct()
    gone = old_nodes.join(new_nodes.select("id"), "id", "left_anti")
    kept = gone.join(ends, "id", "left_semi")
    return new_nodes.unionByName(kept.select(*new_nodes.columns))


def subgraph(nodes, edges, overlaps, *, columns: bool = False, cap: int | None = None):
    """Nodes and edges to draw: tables and groups, or everything.

    Returns ``(nodes, edges)``; an edge is kept when both its ends are. A caller that
    draws on a page may give a ``cap``; the first nodes by label and name stay.
    """
    labels = LABELS if columns else ("Source", "Model", "Group")
    shown = nodes.where(F.col("label").isin(*labels))
    if cap is not None:
        shown = shown.orderBy("label", "name", "id").limit(cap)
    ids = shown.select("id")
    drawn = edges.select("kind", "src", "dst", F.lit(None).cast("bigint").alias("n_measured_pairs"))
    pairs = overlaps.select(F.lit("OVERLAPS").alias("kind"), "src", "dst",
                            F.lit(1).cast("bigint").alias("n_measured_pairs"))
    if not columns:
        pairs = overlap_rollup(overlaps).select(
            F.lit("OVERLAPS").alias("kind"), F.col("src_table").alias("src"),
            F.col("dst_table").alias("dst"), "n_measured_pairs")
    drawn = drawn.unionByName(pairs)
    for end in ("src", "dst"):
        drawn = drawn.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return shown, drawn.select("kind", "src", "dst", "n_measured_pairs")
