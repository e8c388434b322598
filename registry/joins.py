"""Join diagnosis and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import commas, read, rounded, sql_flags
from tallyframe.operators import overlap as O
from tallyframe.operators.joincheck import JoinCheck
from tallyframe.operators.joining import apply_join

# Each pair: left and right as (Spark frame, oracle relation), and their keys. Both
# sides of a pair may be a table or an expression over one, given once for both.
_NULLED = "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events"
_FIRST_LINE = "SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CAST(1 AS INT) AS line, o_orderstatus FROM orders"
_TEXT_KEY = "SELECT CAST(CASE WHEN c_custkey % 3 > 0 THEN c_custkey ELSE -c_custkey END AS {text}) AS cust_text, c_name FROM customer"

PAIRS = {
    "lineitem_orders": ("lineitem", "orders", ["l_orderkey"], ["o_orderkey"]),
    "orders_customer": ("orders", "customer", ["o_custkey"], ["c_custkey"]),
    "customer_supplier": ("customer", "supplier", ["c_nationkey"], ["s_nationkey"]),
    "documents_labels": ("documents", "labels", ["doc_id"], ["doc_id"]),
    "events_customer": ("events", "customer", ["user_id"], ["c_custkey"]),
    "null_keys": (_NULLED, "customer", ["user_id"], ["c_custkey"]),
    "composite": ("lineitem", _FIRST_LINE, ["l_orderkey", "l_linenumber"], ["o_orderkey", "line"]),
    "mismatched": ("orders", _TEXT_KEY, ["o_custkey"], ["cust_text"]),
}


def _frame(spark, sf_dir, relation: str):
    if not relation.startswith("SELECT"):
        return read(spark, sf_dir, relation)
    table = relation.split(" FROM ")[1].split()[0]
    body, where = relation.split(f" FROM {table}")
    df = read(spark, sf_dir, table)
    if where:
        df = df.where(where.removeprefix(" WHERE "))
    return df.selectExpr(*_items(body.removeprefix("SELECT ").format(text="STRING")))


def _items(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def _check(spark, sf_dir, pair: str) -> JoinCheck:
    left, right, lk, rk = PAIRS[pair]
    return JoinCheck(_frame(spark, sf_dir, left), _frame(spark, sf_dir, right),
                     left_on=lk, right_on=rk)


# --- the report -------------------------------------------------------------------


def _sides(pair):
    def run(spark, sf_dir):
        r = _check(spark, sf_dir, pair).report()
        pick = lambda s: r.select(F.lit(s).alias("side"), f"{s}.*")
        return pick("left").unionByName(pick("right"))

    return run


def _overlap(pair):
    def run(spark, sf_dir):
        return _check(spark, sf_dir, pair).report().select(
            "relationship", "key_dtype_match", "overlap.n_shared_keys", "overlap.n_left_only_keys",
            "overlap.n_right_only_keys", F.round("overlap.left_coverage", 6).alias("left_coverage"),
            F.round("overlap.right_coverage", 6).alias("right_coverage"),
            "fan_out.max_left_to_right", "fan_out.max_right_to_left",
            F.round("fan_out.result_per_matched_left", 6).alias("result_per_matched_left"),
        )

    return run


def _conservation(pair):
    def run(spark, sf_dir):
        rows = _check(spark, sf_dir, pair).conservation()
        return rows.withColumn("result_rows", F.col("result_rows").cast("bigint"))

    return run


def _flags(pair):
    return lambda spark, sf_dir: _check(spark, sf_dir, pair).report().select(
        commas("flags").alias("flags")
    )


def _sql_source(relation: str) -> str:
    return f"({relation.format(text='VARCHAR')})" if relation.startswith("SELECT") else relation


def report_sql(pair: str, select: str) -> str:
    """Every count of the report, by the same FULL JOIN of key counts."""
    left, right, lk, rk = PAIRS[pair]
    mixed = pair == "mismatched"

    def side(s, relation, keys):
        source = _sql_source(relation)
        present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        names = ", ".join(f"{f'CAST({k} AS VARCHAR)' if mixed else k} AS k{i}" for i, k in enumerate(keys))
        return (
            f"{s}c AS (SELECT {names}, count(*) AS n FROM {source} WHERE {present} GROUP BY ALL), "
            f"{s}s AS (SELECT (SELECT count(*) FROM {source}) AS n_rows, "
            f"(SELECT count(*) FROM {source} WHERE NOT ({present})) AS n_null_keys, "
            f"count(*) AS n_distinct_keys, count(*) FILTER (WHERE n > 1) AS n_duplicated_keys, "
            f"coalesce(max(n), 0) AS max_key_multiplicity, coalesce(max(n), 0) <= 1 AS unique_keys FROM {s}c)"
        )

    match = " AND ".join(f"l.k{i} = r.k{i}" for i in range(len(lk)))
    total = lambda what, where: f"CAST(coalesce(sum({what}) FILTER (WHERE {where}), 0) AS BIGINT)"
    both, lo, ro = "l.n IS NOT NULL AND r.n IS NOT NULL", "r.n IS NULL", "l.n IS NULL"
    return f"""
        WITH {side('l', left, lk)}, {side('r', right, rk)},
        o AS (SELECT {total('l.n * r.n', both)} AS inner_rows, {total('l.n', both)} AS matched_left,
                {total('r.n', both)} AS matched_right, count(*) FILTER (WHERE {both}) AS n_shared_keys,
                count(*) FILTER (WHERE {lo}) AS n_left_only_keys, count(*) FILTER (WHERE {ro}) AS n_right_only_keys,
                {total('l.n', lo)} AS left_only_rows, {total('r.n', ro)} AS right_only_rows,
                coalesce(max(r.n) FILTER (WHERE {both}), 0) AS max_left_to_right,
                coalesce(max(l.n) FILTER (WHERE {both}), 0) AS max_right_to_left
              FROM lc AS l FULL JOIN rc AS r ON {match}),
        f AS (SELECT o.*, ls.n_rows AS l_rows, rs.n_rows AS r_rows, ls.n_null_keys + o.left_only_rows AS left_dropped,
                rs.n_null_keys + o.right_only_rows AS right_dropped, ls.n_null_keys + rs.n_null_keys AS null_keys,
                CASE WHEN ls.unique_keys AND rs.unique_keys THEN '1:1' WHEN ls.unique_keys THEN '1:many'
                     WHEN rs.unique_keys THEN 'many:1' ELSE 'many:many' END AS relationship,
                CASE WHEN ls.n_rows > 0 THEN o.matched_left / ls.n_rows ELSE 0 END AS left_coverage,
                CASE WHEN rs.n_rows > 0 THEN o.matched_right / rs.n_rows ELSE 0 END AS right_coverage,
                {'false' if mixed else 'true'} AS key_dtype_match
              FROM o, ls, rs)
        {select}"""


_SIDES_SQL = "SELECT 'left' AS side, * FROM ls UNION ALL SELECT 'right' AS side, * FROM rs"
_OVERLAP_SQL = """SELECT relationship, key_dtype_match, n_shared_keys, n_left_only_keys, n_right_only_keys,
    round(left_coverage, 6) AS left_coverage, round(right_coverage, 6) AS right_coverage, max_left_to_right,
    max_right_to_left, CASE WHEN matched_left > 0 THEN round(inner_rows / matched_left, 6) ELSE 0 END
    AS result_per_matched_left FROM f"""
_CONSERVATION_SQL = """SELECT 'inner' AS how, inner_rows AS result_rows, left_dropped, right_dropped FROM f
    UNION ALL SELECT 'left', inner_rows + left_dropped, 0, right_dropped FROM f
    UNION ALL SELECT 'right', inner_rows + right_dropped, left_dropped, 0 FROM f
    UNION ALL SELECT 'outer', inner_rows + left_dropped + right_dropped, 0, 0 FROM f"""
_FLAGS_SQL = "SELECT " + sql_flags(
    ("key_dtype_mismatch", "NOT key_dtype_match"),
    ("no_matches", "inner_rows = 0"),
    ("many_to_many", "relationship = 'many:many'"),
    ("left_rows_dropped", "left_dropped > 0"),
    ("fan_out", "greatest(max_left_to_right, max_right_to_left) > 1"),
    ("null_keys", "null_keys > 0"),
    ("low_overlap", "left_coverage < 0.5"),
    ("right_rows_dropped", "right_dropped > 0"),
) + " AS flags FROM f"


def conservation_by_joining_sql(pair: str) -> str:
    """The four result sizes by really joining: what the counts must predict."""
    left, right, lk, rk = PAIRS[pair]
    on = " AND ".join(f"l.{a} = r.{b}" for a, b in zip(lk, rk))
    lsrc, rsrc = _sql_source(left), _sql_source(right)
    lone = lambda own, keys, other, okeys: (
        f"(SELECT count(*) FROM {own} AS a WHERE NOT EXISTS (SELECT 1 FROM {other} AS b WHERE "
        + " AND ".join(f"a.{x} = b.{y}" for x, y in zip(keys, okeys)) + "))"
    )
    ld, rd = lone(lsrc, lk, rsrc, rk), lone(rsrc, rk, lsrc, lk)
    lost = {"inner": (ld, rd), "left": ("0", rd), "right": (ld, "0"), "outer": ("0", "0")}
    word = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}
    return " UNION ALL ".join(
        f"SELECT '{how}' AS how, (SELECT count(*) FROM {lsrc} AS l {word[how]} JOIN {rsrc} AS r ON {on}) "
        f"AS result_rows, {a} AS left_dropped, {b} AS right_dropped"
        for how, (a, b) in lost.items()
    )


# --- evidence -----------------------------------------------------------------------


def _unmatched_keys(pair, side):
    return lambda spark, sf_dir: _check(spark, sf_dir, pair).unmatched_keys(side)


def unmatched_keys_sql(pair, side, text=False):
    left, right, lk, rk = PAIRS[pair]
    own, keys, other, okeys = (left, lk, right, rk) if side == "left" else (right, rk, left, lk)
    cast = (lambda c: f"CAST({c} AS VARCHAR)") if text else (lambda c: c)
    match = " AND ".join(f"{cast('a.' + x)} = {cast('b.' + y)}" for x, y in zip(keys, okeys))
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    names = ", ".join(keys)
    return (
        f"SELECT DISTINCT {names} FROM {_sql_source(own)} AS a WHERE {present} AND NOT EXISTS "
        f"(SELECT 1 FROM {_sql_source(other)} AS b WHERE {match}) ORDER BY {names} LIMIT 5"
    )


def _unmatched_rows(pair, side, measured=False):
    def run(spark, sf_dir):
        check = _check(spark, sf_dir, pair)
        if measured:
            check.measured()
        return check.unmatched_rows(side)

    return run


def unmatched_rows_sql(pair, side):
    left, right, lk, rk = PAIRS[pair]
    own, keys, other, okeys = (left, lk, right, rk) if side == "left" else (right, rk, left, lk)
    match = " AND ".join(f"a.{x} = b.{y}" for x, y in zip(keys, okeys))
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT * FROM {_sql_source(own)} AS a WHERE {present} AND NOT EXISTS "
        f"(SELECT 1 FROM {_sql_source(other)} AS b WHERE {match}) ORDER BY ALL NULLS LAST LIMIT 3"
    )


def null_key_rows(spark, sf_dir):
    return _check(spark, sf_dir, "null_keys").null_key_rows("left")


def _fan_out(pair):
    return lambda spark, sf_dir: _check(spark, sf_dir, pair).fan_out_examples()


def fan_out_sql(pair):
    left, right, lk, rk = PAIRS[pair]
    counts = lambda relation, keys: (
        f"(SELECT {', '.join(f'{k} AS k{i}' for i, k in enumerate(keys))}, count(*) AS n "
        f"FROM {_sql_source(relation)} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY ALL)"
    )
    match = " AND ".join(f"l.k{i} = r.k{i}" for i in range(len(lk)))
    keys = ", ".join(f"l.k{i}" for i in range(len(lk)))
    shown = ", ".join(f"l.k{i} AS {k}" for i, k in enumerate(lk))
    return (
        f"SELECT {shown}, l.n AS n_left, r.n AS n_right FROM {counts(left, lk)} AS l JOIN "
        f"{counts(right, rk)} AS r ON {match} WHERE l.n > 1 OR r.n > 1 "
        f"ORDER BY l.n * r.n DESC, {keys} LIMIT 5"
    )


# --- column overlap -----------------------------------------------------------------


_OVERLAP_SHOWN = (
    "left_table", "left_column", "left_n_rows", "left_n_null", "left_n_distinct", "left_type",
    "right_table", "right_column", "right_n_rows", "right_n_null", "right_n_distinct", "right_type",
    "n_shared_values", "n_left_only_values", "n_right_only_values",
)


def _column_overlap(pair, left_table, right_table):
    def run(spark, sf_dir):
        left, right, lk, rk = PAIRS[pair]
        measured = O.column_overlap(
            _frame(spark, sf_dir, left), lk[0], _frame(spark, sf_dir, right), rk[0],
            left_table=left_table, right_table=right_table,
        )
        return measured.select(*_OVERLAP_SHOWN, rounded("left_coverage"), rounded("right_coverage"),
                               "comparable_types")

    return run


def column_overlap_sql(pair, left_table, right_table, left_type="numeric", right_type="numeric"):
    _, _, lk, rk = PAIRS[pair]
    side = lambda s, table, column, kind: (
        f"'{table}' AS {s}_table, '{column}' AS {s}_column, {s[0]}s.n_rows AS {s}_n_rows, "
        f"{s[0]}s.n_null_keys AS {s}_n_null, {s[0]}s.n_distinct_keys AS {s}_n_distinct, '{kind}' AS {s}_type"
    )
    return report_sql(pair, f"""SELECT {side('left', left_table, lk[0], left_type)},
        {side('right', right_table, rk[0], right_type)}, n_shared_keys AS n_shared_values,
        n_left_only_keys AS n_left_only_values, n_right_only_keys AS n_right_only_values,
        round(left_coverage, 6) AS left_coverage, round(right_coverage, 6) AS right_coverage,
        key_dtype_match AS comparable_types FROM f, ls, rs""")


# --- joins ---------------------------------------------------------------------------


def _join(left, right, how, lazy=True, **keys):
    def run(spark, sf_dir):
        return apply_join(read(spark, sf_dir, left), read(spark, sf_dir, right), how=how,
                          diagnose=not lazy, **keys).df

    return run


def join_collision(spark, sf_dir):
    """Both sides carry an unkeyed column of one name: it is suffixed, never lost."""
    orders = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS custkey", "o_orderkey AS id", "o_totalprice AS amount")
    customer = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS custkey", "c_acctbal AS amount", "c_name AS name")
    return apply_join(orders, customer, how="left", on="custkey", diagnose=False).df


def join_hot_keys(spark, sf_dir):
    """A join whose busiest keys are split over tasks; the rows are those of any join."""
    lineitem = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    joined = apply_join(
        lineitem, read(spark, sf_dir, "supplier").withColumn(
            "s_suppkey", F.expr("IF(s_suppkey % 4 > 0, s_suppkey, -s_suppkey)")), how="outer",
        left_on="l_suppkey", right_on="s_suppkey", hot_key_rows=600,
    )
    return joined.df


def join_null_keys_apart(spark, sf_dir):
    """Null and partnerless keys of an outer side skip the shuffle."""
    joined = apply_join(
        _frame(spark, sf_dir, _NULLED), read(spark, sf_dir, "customer"), how="left",
        left_on="user_id", right_on="c_custkey", hot_key_rows=50,
    )
    return joined.df


def _provenance(how):
    def run(spark, sf_dir):
        joined = apply_join(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"),
                            how=how, left_on="o_custkey", right_on="c_custkey")
        p = joined.provenance()
        row = (p["how"], p["relationship"], p["input_rows"]["left"], p["input_rows"]["right"],
               p["result_rows"], p["predicted_rows"], p["matches_prediction"], p["left_dropped"],
               p["right_dropped"], ",".join(p["flags"]))
        return spark.createDataFrame([row], (
            "how string, relationship string, left_rows bigint, right_rows bigint, result_rows bigint, "
            "predicted_rows bigint, matches_prediction boolean, left_dropped bigint, "
            "right_dropped bigint, flags string"))

    return run


_MANY = ("lineitem_orders", "orders_customer", "customer_supplier", "documents_labels",
         "events_customer", "null_keys", "composite", "mismatched")

QUERIES = {
    **{f"join_sides_{p}": _sides(p) for p in _MANY},
    **{f"join_overlap_{p}": _overlap(p) for p in _MANY},
    **{f"join_conservation_{p}": _conservation(p) for p in _MANY},
    **{f"join_flags_{p}": _flags(p) for p in _MANY},
    "unmatched_keys_left": _unmatched_keys("composite", "left"),
    "unmatched_keys_right": _unmatched_keys("events_customer", "right"),
    "unmatched_keys_composite": _unmatched_keys("composite", "right"),
    "unmatched_keys_mismatched": _unmatched_keys("mismatched", "left"),
    "unmatched_rows_right": _unmatched_rows("lineitem_orders", "right"),
    "unmatched_rows_measured": _unmatched_rows("events_customer", "right", measured=True),
    "null_key_rows": null_key_rows,
    "fan_out_examples": _fan_out("lineitem_orders"),
    "fan_out_many_to_many": _fan_out("customer_supplier"),
    "column_overlap_user_customer": _column_overlap("events_customer", "events", "customer"),
    "column_overlap_mismatched": _column_overlap("mismatched", "orders", "customer"),
    **{f"join_{how}": _join("orders", "customer", how, left_on="o_custkey", right_on="c_custkey")
       for how in ("inner", "left", "right", "outer")},
    "join_shared_key": _join("labels", "documents", "outer", on="doc_id"),
    "join_two_names": _join("nation", "region", "inner", left_on="n_regionkey", right_on="r_regionkey"),
    "join_collision": join_collision,
    "join_hot_keys": join_hot_keys,
    "join_null_keys_apart": join_null_keys_apart,
    "join_provenance_left": _provenance("left"),
    "join_provenance_outer": _provenance("outer"),
}

_WORD = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}


def _provenance_sql(how):
    size = f"(SELECT count(*) FROM orders {_WORD[how]} JOIN customer ON o_custkey = c_custkey)"
    lost = "left_dropped" if how in ("inner", "right") else "0", \
        "right_dropped" if how in ("inner", "left") else "0"
    return report_sql("orders_customer", f"""SELECT '{how}' AS how, relationship, l_rows AS left_rows,
        r_rows AS right_rows, {size} AS result_rows, {size} AS predicted_rows, true AS matches_prediction,
        {lost[0]} AS left_dropped, {lost[1]} AS right_dropped, flags FROM f, ({_FLAGS_SQL})""")


ORACLES = {
    **{f"join_sides_{p}": report_sql(p, _SIDES_SQL) for p in _MANY},
    **{f"join_overlap_{p}": report_sql(p, _OVERLAP_SQL) for p in _MANY},
    **{f"join_conservation_{p}": report_sql(p, _CONSERVATION_SQL) for p in _MANY},
    "join_conservation_lineitem_orders": conservation_by_joining_sql("lineitem_orders"),
    "join_conservation_null_keys": conservation_by_joining_sql("null_keys"),
    "join_conservation_composite": conservation_by_joining_sql("composite"),
    **{f"join_flags_{p}": report_sql(p, _FLAGS_SQL) for p in _MANY},
    "unmatched_keys_left": unmatched_keys_sql("composite", "left"),
    "unmatched_keys_right": unmatched_keys_sql("events_customer", "right"),
    "unmatched_keys_composite": unmatched_keys_sql("composite", "right"),
    "unmatched_keys_mismatched": unmatched_keys_sql("mismatched", "left", text=True),
    "unmatched_rows_right": unmatched_rows_sql("lineitem_orders", "right"),
    "unmatched_rows_measured": unmatched_rows_sql("events_customer", "right"),
    "null_key_rows": f"SELECT * FROM ({_NULLED}) WHERE user_id IS NULL ORDER BY ALL NULLS LAST LIMIT 3",
    "fan_out_examples": fan_out_sql("lineitem_orders"),
    "fan_out_many_to_many": fan_out_sql("customer_supplier"),
    "column_overlap_user_customer": column_overlap_sql("events_customer", "events", "customer"),
    "column_overlap_mismatched": column_overlap_sql(
        "mismatched", "orders", "customer", right_type="string"),
    **{f"join_{how}": f"SELECT * FROM orders {_WORD[how]} JOIN customer ON o_custkey = c_custkey"
       for how in _WORD},
    "join_shared_key": """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, quality, toxic, text, lang, source,
        n_chars FROM labels AS l FULL JOIN documents AS d ON l.doc_id = d.doc_id""",
    "join_two_names": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_collision": """SELECT o_custkey AS custkey, o_orderkey AS id, o_totalprice AS amount_x,
        c_acctbal AS amount_y, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "join_hot_keys": """SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, s.* FROM lineitem
        FULL JOIN (SELECT * REPLACE (CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey ELSE -s_suppkey END AS s_suppkey) FROM supplier) AS s ON l_suppkey = s_suppkey""",
    "join_null_keys_apart": f"""SELECT e.*, c.* FROM ({_NULLED}) AS e
        LEFT JOIN customer AS c ON user_id = c_custkey""",
    "join_provenance_left": _provenance_sql("left"),
    "join_provenance_outer": _provenance_sql("outer"),
}
