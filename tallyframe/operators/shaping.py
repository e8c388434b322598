"""Steps that filter, derive, impute, deduplicate or join as of a time, as a spec records them.

Each builds its table and says what it did in counts, and where every output column comes
from: an input and a column of it, or nothing that could be named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators import asof, dedupe, impute, sqlstep

PROVENANCE_KEYS = {
    "filter": frozenset("op where input_rows result_rows rows_dropped flags".split()),
    "derive": frozenset("op columns input_rows result_rows flags".split()),
    "impute": frozenset("op column by rule n_rows n_missing n_filled n_left n_groups n_groups_without flags".split()),
    "dedupe": frozenset("op keys rules input_rows result_rows rows_dropped n_null_keys n_keys n_duplicated_keys "
                        "max_key_multiplicity conflicts flags".split()),
    "asof": frozenset("op how direction keys input_rows result_rows matched_left unmatched_left left_coverage flags".split()),
}

# an output column, the position of the input it comes from (None: not known), the column there, whether it was changed
Origin = tuple[str, int | None, str | None, bool]


@dataclass
class Shaped:
    """A step's table, where its columns come from, its statement if it has one, and what it did."""

    df: DataFrame
    origins: list[Origin]
    described: str | None
    provenance: Callable[[int, list[int]], dict]


def apply(step: dict, frames: list[DataFrame]) -> Shaped:
    return {"filter": _filter, "derive": _derive, "impute": _impute, "dedupe": _dedupe, "asof": _asof}[step["op"]](step, frames)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _expression(df: DataFrame, text: str) -> None:
    """Refuse what is not one expression over the input's own columns."""
    sqlstep.check_sql(df.sparkSession, f"SELECT ({text}) FROM given", ["given"])


def _filter(step: dict, frames: list[DataFrame]) -> Shaped:
    (df,), where = frames, step["where"]
    _expression(df, where)
    return Shaped(df.where(F.expr(where)), [(c, 0, c, False) for c in df.columns],
                  f"SELECT * FROM {_quoted(step['input'])} WHERE ({where})",
                  lambda rows, inputs: {"op": "filter", "where": where, "input_rows": inputs[0], "result_rows": rows,
                                        "rows_dropped": inputs[0] - rows, "flags": []})


def _derive(step: dict, frames: list[DataFrame]) -> Shaped:
    """New columns, all read off the input's own; a name that is there already is replaced in its place."""
    (df,), columns = frames, step["columns"]
    for text in columns.values():
        _expression(df, text)
    shown = [(c, f"({columns[c]})" if c in columns else _quoted(c)) for c in df.columns]
    shown += [(c, f"({text})") for c, text in columns.items() if c not in df.columns]
    origins = [(c, None, None, True) if c in columns else (c, 0, c, False) for c, _ in shown]
    statement = ", ".join(f"{text} AS {_quoted(c)}" for c, text in shown)
    return Shaped(df.select(*[F.expr(text).alias(c) for c, text in shown]), origins, f"SELECT {statement} FROM {_quoted(step['input'])}",
                  lambda rows, inputs: {"op": "derive", "columns": sorted(columns), "input_rows": inputs[0], "result_rows": rows, "flags": []})


def _impute(step: dict, frames: list[DataFrame]) -> Shaped:
    done = impute.impute(frames[0], step["column"], step.get("by") or (), step.get("rule", "median"))
    return Shaped(done.df, [(c, 0, c, c == step["column"]) for c in done.df.columns], None, lambda rows, inputs: done.provenance())


def _dedupe(step: dict, frames: list[DataFrame]) -> Shaped:
    done = dedupe.dedupe(frames[0], step["keys"], step.get("order") or (), step.get("rules"), step.get("default", "first"))
    return Shaped(done.df, [(c, 0, c, c in done.rules) for c in done.df.columns], None, lambda rows, inputs: done.provenance())


def _asof(step: dict, frames: list[DataFrame]) -> Shaped:
    left, right = frames
    how, direction = step.get("how", "left"), step.get("direction", "backward")
    done = asof.asof_join(left, right, on=step.get("keys"), left_on=step.get("left_on"), right_on=step.get("right_on"),
                          left_time=step["left_time"], right_time=step["right_time"], how=how, direction=direction,
                          allow_equal=step.get("allow_equal", True),
                          within=F.expr(step["within"]) if step.get("within") else None)
    origins = [(c.name, 0, c.left, False) if c.left is not None else (c.name, 1, c.right, False) for c in done.columns]

    def provenance(rows: int, inputs: list[int]) -> dict:
        found = done.report().first()
        return {"op": "asof", "how": how, "direction": direction, "keys": step.get("keys") or [step.get("left_on"), step.get("right_on")],
                "input_rows": {"left": inputs[0], "right": inputs[1]}, "result_rows": rows, "matched_left": found.matched_left,
                "unmatched_left": found.unmatched_left, "left_coverage": found.left_coverage,
                "flags": ["no_matches"] if found.left_rows and not found.matched_left else []}

    return Shaped(done.df, origins, None, provenance)
