"""Greedy selections whose state resets: budgeted batches and chunks, one group of a document at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def budget_batches(units: DataFrame, key: str, order: str, cost: str, budget: int, most: int = 1 << 30) -> DataFrame:
    """key, order, batch: units in order are put into a batch until its cost would exceed the budget or it has `most` units.

    A unit above the budget is a batch of its own. A group is one artifact's units, whose ids and costs only are gathered.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, batch, total, n = [], 0, 0, 0
        for c in pdf[cost]:
            if n and (total + c > budget or n >= most):
                batch, total, n = batch + 1, 0, 0
            total, n = total + c, n + 1
            out.append(batch)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "batch": out})

    kinds = dict(units.dtypes)
    return units.select(key, order, cost).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, batch long")


def best_within_budget(units: DataFrame, key: str, order: str, score: str, cost: str, budget: int) -> DataFrame:
    """The units that fit a budget, taken by score, then order; one that doesn't fit is passed over, not the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for row in pdf.sort_values([score, order], ascending=[False, True]).itertuples(index=False):
            if getattr(row, cost) <= left:
                left -= getattr(row, cost)
                kept.append(getattr(row, order))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(kept), order: kept}).sort_values(order)

    kinds = dict(units.dtypes)
    return units.select(key, order, score, cost).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}")
