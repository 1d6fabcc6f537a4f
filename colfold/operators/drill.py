"""Search for functions between columns on a bounded sample: sparse linear, several lines, temporal pairs."""

from __future__ import annotations

import re
from functools import reduce
from itertools import permutations
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colfold.sources.readers import repeatable_sample
from colfold.types import classify

#: Largest root mean square error of a model, smallest coefficient, and errors at which a selection is good enough.
MAX_ERROR = 5.0
MIN_COEFFICIENT = 1e-6
GOOD_ERROR, NEAR_ERROR = 1e-4, 0.5
#: Lines tried, with their rounds.
LINES = {2: 10, 4: 10, 8: 10, 16: 10}
SEED = 0


def rmse(y: np.ndarray, guess: np.ndarray) -> float:
    return float(np.sqrt(np.mean((y - guess) ** 2))) if len(y) else 0.0


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept, solved on centred data."""
    if not len(y):
        return np.zeros(x.shape[1]), 0.0
    mean_x, mean_y = x.mean(axis=0), y.mean()
    if not x.shape[1]:
        return np.zeros(0), float(mean_y)
    coefficients = np.linalg.lstsq(x - mean_x, y - mean_y, rcond=None)[0]
    return coefficients, float(mean_y - mean_x @ coefficients)


def sparse_fit(x: np.ndarray, y: np.ndarray, limit: float = MAX_ERROR) -> tuple[np.ndarray, float]:
    """Least squares over as few columns as keep the error: columns whose absence hurts most come first."""
    full, intercept = least_squares(x, y)
    if rmse(y, x @ full + intercept) > limit:
        return full, intercept
    used = np.flatnonzero(np.abs(full) >= MIN_COEFFICIENT)
    if not len(used):
        return np.zeros_like(full), float(y.mean())

    def fit(columns: list[int]) -> tuple[np.ndarray, float, float]:
        c, b = least_squares(x[:, columns], y)
        return c, b, rmse(y, x[:, columns] @ c + b)

    whole = fit(used.tolist())[2]
    if whole > limit or len(used) == 1:
        return full, intercept
    without = [fit([u for u in used.tolist() if u != one])[2] for one in used.tolist()]
    chosen: list[int] = []
    for i in np.argsort(-np.array(without), kind="stable"):
        chosen.append(int(used[i]))
        error = fit(chosen)[2]
        if error < GOOD_ERROR or error < whole + NEAR_ERROR:
            break
    c, b, _ = fit(chosen)
    out = np.zeros_like(full)
    out[chosen] = c
    return out, b


def k_lines(x: np.ndarray, y: np.ndarray, k: int, rounds: int, seed: int = SEED) -> tuple[list[tuple[np.ndarray, float]], float]:
    """k lines by turns of assignment and fitting, from random groups and from groups along the target and each reference; the best of all."""
    n = len(y)
    starts = [np.random.default_rng(seed).permutation(n), np.argsort(y, kind="stable"), *(np.argsort(x[:, i], kind="stable") for i in range(x.shape[1]))]
    best: tuple[list[tuple[np.ndarray, float]], float] = ([], float("inf"))
    for start in starts:
        lines = [sparse_fit(x[g], y[g]) for g in np.array_split(start, k) if len(g)]
        last = float("inf")
        for _ in range(rounds):
            off = np.stack([np.abs(x @ c + b - y) for c, b in lines])
            nearest = off.argmin(axis=0)
            error = float(np.sqrt(np.mean(off.min(axis=0) ** 2)))
            if error < best[1]:
                best = ([lines[i] for i in np.unique(nearest)], error)
            if error < GOOD_ERROR or error >= last:
                break
            last = error
            lines = [sparse_fit(x[nearest == i], y[nearest == i]) for i in np.unique(nearest)]
    return best


def _linear(coefficients: np.ndarray, intercept: float, refs: list[tuple[int, str]]) -> dict:
    return {"intercept": float(intercept), "coeffs": [{"col-index": i, "col-name": name, "coeff": float(c)} for (i, name), c in zip(refs, coefficients, strict=True) if abs(c) >= MIN_COEFFICIENT]}


def wants(model_types: list[str] | None, name: str) -> bool:
    """None takes all; ``k-regression`` and ``custom`` stand for their families."""
    if model_types is None:
        return True
    return name in model_types or (re.fullmatch(r"\d+-regression", name) is not None and "k-regression" in model_types) or (name.startswith("custom-") and "custom" in model_types)


def numeric_candidates(df: DataFrame, sample_size: int = 10_000, model_types: list[str] | None = None) -> list[dict[str, Any]]:
    """A candidate for every numeric column that a model explains from the others within MAX_ERROR."""
    names = classify(df.schema)["num"]
    if len(names) < 2:
        return []
    index = {c: i for i, c in enumerate(df.columns)}
    sample = repeatable_sample(df, sample_size, "num").toPandas()
    data = {c: np.nan_to_num(sample[c].astype(float).to_numpy(), nan=0.0, posinf=0.0, neginf=0.0) for c in names}
    out = []
    for target in names:
        refs = [(index[c], c) for c in names if c != target]
        x, y = np.column_stack([data[c] for _, c in refs]), data[target]
        if not len(y):
            continue
        models: dict[str, Any] = {}
        if wants(model_types, "sparse-lr"):
            c, b = sparse_fit(x, y)
            if (error := rmse(y, x @ c + b)) <= MAX_ERROR:
                models["sparse-lr"] = {"mse": error, **_linear(c, b, refs)}
        for k, rounds in LINES.items():
            if wants(model_types, f"{k}-regression"):
                lines, error = k_lines(x, y, k, rounds)
                name = f"{len(lines)}-regression"
                if len(lines) > 1 and error <= MAX_ERROR and error < models.get(name, {"mse": float("inf")})["mse"]:
                    models[name] = {"mse": error, "config": [_linear(c, b, refs) for c, b in lines]}
                if error < GOOD_ERROR:  # more lines gain nothing
                    break
        if models:
            stats = {"mean": float(y.mean()), "max": float(y.max()), "min": float(y.min())}
            out.append({"category": "num", "target-index": index[target], "target-name": target, "target-stats": stats, "models": models})
    return out


def temporal_candidates(df: DataFrame) -> list[dict[str, Any]]:
    """A candidate for every column that has another of its temporal category: the difference of the two."""
    index = {c: i for i, c in enumerate(df.columns)}
    out: dict[str, dict[str, Any]] = {}
    by = classify(df.schema)
    for kind in ("date", "timestamp", "time"):
        for target, ref in permutations(by[kind], 2):
            if df.schema[target].dataType != df.schema[ref].dataType:
                continue
            entry = out.setdefault(target, {"category": kind, "target-index": index[target], "target-name": target, "models": {}})
            entry["models"][f"custom-{len(entry['models'])}"] = {"mse": 0.0, "intercept": 0, "coeffs": [{"col-index": index[ref], "col-name": ref, "coeff": 1}]}
    return list(out.values())


def fit_metrics(df: DataFrame, value: Column, guesses: list[Column]) -> DataFrame:
    """Share of equal values, and average and largest difference, to the nearest of several guesses: one aggregate."""
    off = reduce(F.least, [F.abs(value - g) for g in guesses]) if len(guesses) > 1 else F.abs(value - guesses[0])
    return df.agg(F.avg((off < 1e-6).cast("double")).alias("equal"), F.avg(off.cast("double")).alias("avg_diff"), F.max(off.cast("double")).alias("max_diff"))
