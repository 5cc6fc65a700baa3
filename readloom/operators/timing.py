"""Arrival times on a virtual clock."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.rng import exponential
from readloom.operators.planning import before, positions


def uniform_interval(base: float) -> Column:
    return F.lit(float(base))


def random_interval(base: float, u: Column, factor: float = 0.3) -> Column:
    return F.greatest(F.lit(0.0), F.lit(base) + F.lit(base * factor) * (2 * u - 1))


def burst_interval(base: float, u1: Column, u2: Column, probability: float = 0.1, multiplier: float = 5.0) -> Column:
    """Exponential, of a multiplier times higher rate in a burst."""
    return exponential(u2, F.lit(float(base))) / F.when(u1 < probability, F.lit(float(multiplier))).otherwise(F.lit(1.0))


def _fold(draws: np.ndarray, before: int, state: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Intervals, and the state after them, of draws that follow `before` others. A state is the mean and the last intervals, oldest first, zero where there were none;
    several states, a column each, are folded at once."""
    mean, past = state[0], state[1:].copy()
    size, out = len(past), np.empty((len(draws), *state.shape[1:]))
    for k, draw in enumerate(draws):
        out[k] = past[k % size] = draw * mean
        if (n := min(before + k + 1, size)) > 1:
            mean = (1 - rate) * mean + rate * past.sum(axis=0) / n
    return out, np.concatenate([mean[None], np.roll(past, -(len(draws) % size), axis=0)])


def adaptive_intervals(draws: DataFrame, base: float, rate: float = 0.1, history: int = 10, by: list[str] = (), block: int = 4096) -> DataFrame:
    """by, batch, interval_s: exponential draws whose mean follows, from the second on, the mean of the last intervals.

    draws: by, batch, u. The mean and the last intervals are a linear state, so each block of batches is a small matrix; the matrices, a row a block, are chained, and
    every block is folded from its start state in its own task.
    """
    by = list(by)
    placed = positions(draws.select(*by, F.col("batch").cast("bigint").alias("batch"), "u"), [*by, "batch", "u"])
    if by:
        firsts = placed.groupBy(*(F.col(c).alias(f"__by_{i}") for i, c in enumerate(by))).agg(F.min("pos").alias("__first"))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(by)))
        placed = placed.join(firsts, same)
    else:
        placed = placed.withColumn("__first", F.lit(0).cast("bigint"))
    at = F.col("pos") - F.col("__first")
    rows = placed.select("__first", F.floor(at / block).cast("bigint").alias("__block"), "pos", "batch", (-F.log(1 - F.col("u"))).alias("draw"))
    start = np.array([float(base)] + [0.0] * history)

    def matrix(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["__block"].iloc[0])
        if len(rows) < block:  # nothing follows it
            return pd.DataFrame({"__first": [], "__block": [], "matrix": pd.Series([], dtype=object)})
        after = _fold(rows.sort_values("pos")["draw"].to_numpy(), number * block, np.eye(history + 1), rate)[1]
        return pd.DataFrame({"__first": rows["__first"].iloc[:1], "__block": number, "matrix": pd.Series([after.ravel()], index=rows.index[:1], dtype=object)})

    def chain(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, state, states = blocks.sort_values("__block"), start, []
        for m in blocks["matrix"]:
            state = np.asarray(m).reshape(history + 1, history + 1) @ state
            states.append(state)
        return pd.DataFrame({"__first": blocks["__first"], "__block": blocks["__block"] + 1, "state": pd.Series(states, index=blocks.index, dtype=object)})

    def fold(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):  # the state after the last block
            return pd.DataFrame({"__first": [], "batch": [], "interval_s": []})
        rows = rows.sort_values("pos")
        state = np.asarray(states["state"].iloc[0]) if len(states) else start
        return pd.DataFrame({"__first": rows["__first"], "batch": rows["batch"], "interval_s": _fold(rows["draw"].to_numpy(), int(rows["__block"].iloc[0]) * block, state, rate)[0]})

    matrices = rows.groupBy("__first", "__block").applyInPandas(matrix, "__first long, __block long, matrix array<double>")
    states = matrices.groupBy("__first").applyInPandas(chain, "__first long, __block long, state array<double>")
    out = rows.groupBy("__first", "__block").cogroup(states.groupBy("__first", "__block")).applyInPandas(fold, "__first long, batch long, interval_s double")
    if by:
        out = out.join(firsts, "__first").withColumnsRenamed({f"__by_{i}": c for i, c in enumerate(by)})
    return out.select(*by, "batch", "interval_s")


def schedule(intervals: DataFrame, by: str | None = None) -> DataFrame:
    """emit_offset_s: what has passed before a batch; no wait follows the last one."""
    return before(intervals, ["batch"], "interval_s", "emit_offset_s", by)
