"""Small SQL text helpers for the oracle (DuckDB dialect)."""

from __future__ import annotations

import math


def _edge(v) -> str:
    if v == math.inf:
        return "'inf'::DOUBLE"
    if v == -math.inf:
        return "'-inf'::DOUBLE"
    return repr(float(v))


def bands_sql(x: str, spec, include_lowest: bool = False) -> str:
    edges, labels = spec
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        op = ">=" if (include_lowest and i == 0) else ">"
        parts.append(f"WHEN {x} {op} {_edge(lo)} AND {x} <= {_edge(hi)} THEN '{lab}'")
    return "(CASE " + " ".join(parts) + " END)"


def clip_sql(x: str, lo=None, hi=None) -> str:
    out = f"(CASE WHEN {x} IS NULL THEN NULL"
    if lo is not None:
        out += f" WHEN {x} < {lo} THEN {float(lo)!r}"
    if hi is not None:
        out += f" WHEN {x} > {hi} THEN {float(hi)!r}"
    return out + f" ELSE CAST({x} AS DOUBLE) END)"


def nan_mean_sql(xs: list[str]) -> str:
    s = " + ".join(f"coalesce({x}, 0.0)" for x in xs)
    n = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END)" for x in xs)
    return f"(CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) END)"


def map_sql(x: str, mapping: dict, default=None) -> str:
    parts = " ".join(f"WHEN {x} = {k} THEN {v!r}" for k, v in mapping.items())
    tail = f" ELSE {default!r}" if default is not None else ""
    return f"(CASE {parts}{tail} END)"
