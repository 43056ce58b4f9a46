"""Summaries of balances, flows and simulated runs; nothing but grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unbalanced(changes: DataFrame, natives: Sequence[str]) -> DataFrame:
    """(delta, net) of the deltas whose changes in ``natives`` do not add up to zero.

    ``changes`` has delta, token, amount. Null amounts and tokens add nothing; a null delta is
    a delta like any other.
    """
    own = changes.where(F.col("token").isin(*natives))
    return own.groupBy("delta").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("net")).where("net <> 0")


def fund_summary(balances: DataFrame, flows: DataFrame) -> DataFrame:
    """(kind, name, n): rows by type of balance and of flow, and how many accounts and tokens there are.

    ``balances`` has account, token, type; ``flows`` has source, target, token, type. Accounts
    are those of all three columns. A null type is counted under its null name; null accounts
    and tokens are none. Totals are there without rows too, histograms then have no rows.
    """

    def types(df: DataFrame, kind: str) -> DataFrame:
        return df.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")

    # distinct first in the tasks, then one count of rows: no set is held in one place
    accounts = balances.select("account").union(flows.select(F.explode(F.array("source", "target")))).dropna().distinct()
    tokens = balances.select("token").union(flows.select("token")).dropna().distinct()
    parts = [types(balances, "balance"), types(flows, "flow"), total(balances, "balances"), total(flows, "flows"), total(accounts, "accounts"), total(tokens, "tokens")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_summary(runs: DataFrame) -> DataFrame:
    """One row about ``runs`` (run, type, severity, profit, profitable): counts, sum and best of the profitable ones.

    Columns: simulated, profitable, total_profit, best_run (the first by ``run`` of equals),
    best_profit, types and severities (maps from name to number of profitable runs). Null
    ``profitable`` is false; a null type, severity or profit counts as "" or 0. Without
    profitable runs the sum is 0, the best is null and the maps are empty.
    """
    on = F.coalesce("profitable", F.lit(False))
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = runs.select("run", name("type"), name("severity"), F.coalesce("profit", F.lit(0)).alias("profit"), on.alias("on"))
    best = F.min(F.when(F.col("on"), F.struct((-F.col("profit")).alias("loss"), "run")))
    cells = rows.groupBy("type", "severity").agg(  # as many rows as there are pairs of names
        F.count("*").alias("simulated"), F.count_if("on").alias("n"), F.sum(F.when(F.col("on"), F.col("profit"))).alias("sum"), best.alias("best")
    )
    whole = cells.agg(
        F.coalesce(F.sum("simulated"), F.lit(0)).alias("simulated"), F.coalesce(F.sum("n"), F.lit(0)).alias("profitable"), F.coalesce(F.sum("sum"), F.lit(0)).alias("total_profit"),
        F.min("best").alias("best"),
    )

    def histogram(column: str, out: str) -> DataFrame:
        n = cells.where("n > 0").groupBy(column).agg(F.sum("n").alias("n"))
        return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(out))

    joined = whole.join(histogram("type", "types")).join(histogram("severity", "severities"))  # one row each
    return joined.select("simulated", "profitable", "total_profit", F.col("best.run").alias("best_run"), (-F.col("best.loss")).alias("best_profit"), "types", "severities")
