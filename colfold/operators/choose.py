"""Bytes that each candidate saves on a sample, and the greedy choice without circles."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame

from colfold.functions.exprs import references
from colfold.operators.fold import layout, new_fold
from colfold.sources.readers import head_sample

SAMPLE = 50_000


def parquet_bytes(table) -> int:
    """Bytes of a Snappy Parquet file of an Arrow table."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="snappy")
    return out.getvalue().size


def estimate(df: DataFrame, candidates: list[dict[str, Any]], scales: dict[str, int] | None = None, sample: int = SAMPLE) -> list[dict[str, Any]]:
    """Adds ``sizes`` (base and folded bytes) for every model. A bounded sample, laid out once, is measured column by column."""
    folds = [(c, name, new_fold(df, c["target-name"], name, model, (scales or {}).get(c["target-name"], 0))) for c in candidates for name, model in c["models"].items()]
    if not folds:
        return candidates
    for i, (_, _, f) in enumerate(folds):
        f.aux = {k: f"_{i}_{k}" for k in f.aux}
    head = head_sample(df, sample)
    table = layout(head, [f for _, _, f in folds]).toArrow()
    base: dict[str, int] = {}
    for c, name, f in folds:
        target = c["target-name"]
        if target not in base:
            base[target] = parquet_bytes(table.select([target]))
        stored = [n for n in f.aux.values() if n in table.column_names and len(table[n].unique()) > 1]
        import pyarrow as pa

        c.setdefault("sizes", {})[name] = {"base": base[target], "folded": parquet_bytes(table.select(stored) if stored else pa.table({"dummy_column": [1] * len(table)}))}
    return candidates


def hyperedges(candidates: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """References to target with the gain, for every model that saves bytes."""
    out = []
    for c in candidates:
        for name, model in c["models"].items():
            size = c["sizes"][name]
            gain = size["base"] - size["folded"]
            if gain > 0:
                refs = {r["col-name"]: r["col-index"] for m in model.get("config", [model]) for r in m["coeffs"]}
                left = [refs[r] for r in references(model)]
                out.append({"category": c.get("category", "num"), "target-index": c["target-index"], "target-name": c["target-name"], "model-type": name, name: model, "left": left, "right": c["target-index"], "gain": gain})
    return out


def reaches(edges: dict[Any, set], start: Any, goal: Any) -> bool:
    """Whether a way leads from start to goal."""
    todo, seen = [start], set()
    while todo:
        x = todo.pop()
        if x == goal:
            return True
        if x not in seen:
            seen.add(x)
            todo += edges.get(x, ())
    return False


def greedy(edges: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """By decreasing gain, every edge whose target is not chosen yet and that closes no circle of references."""
    chosen: list[dict[str, Any]] = []
    reads: dict[Any, set] = {}
    for e in sorted(edges, key=lambda e: -e["gain"]):
        target, refs = e["target-name"], set(references(e[e["model-type"]]))
        if target in reads or any(reaches(reads, r, target) for r in refs):
            continue
        reads[target] = refs
        chosen.append(e)
    return chosen


def optimize(candidates: list[dict[str, Any]]) -> dict[str, Any]:
    """The layout: objective value, chosen edges, seconds."""
    began = time.time()
    chosen = greedy(hyperedges(candidates))
    return {"greedy": {"obj-value": sum(e["gain"] for e in chosen), "chosen": chosen, "time": time.time() - began}}
