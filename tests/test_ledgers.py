"""Ledger summaries against plain loops, on empty and null input too."""

import random
from collections import Counter

from tessel.operators import ledgers


def test_unbalanced(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["ETH", "eth", "X", None]), rng.choice([-2, -1, 1, 2, None])) for _ in range(60)] + [(9, "ETH", 4), (9, "eth", -4)]
    net = Counter()
    for d, t, a in rows:
        net[d] += a or 0 if t in ("ETH", "eth") else 0
    df = spark.createDataFrame(rows, "delta int, token string, amount long")
    assert {r.delta: r.net for r in ledgers.unbalanced(df, ["ETH", "eth"]).collect()} == {d: n for d, n in net.items() if n}
    assert ledgers.unbalanced(df.limit(0), ["ETH"]).count() == 0


def test_fund_summary(spark):
    balances = [("a", "t", "x"), ("b", None, None), (None, "u", "x"), ("a", "t", "x")]
    flows = [("a", "c", "v", "y"), (None, "d", "t", None)]
    b, f = spark.createDataFrame(balances, "account string, token string, type string"), spark.createDataFrame(flows, "source string, target string, token string, type string")
    got = {(r.kind, r.name): r.n for r in ledgers.fund_summary(b, f).collect()}
    totals = {("total", "balances"): 4, ("total", "flows"): 2, ("total", "accounts"): 4, ("total", "tokens"): 3}
    assert got == totals | {("balance", "x"): 3, ("balance", None): 1, ("flow", "y"): 1, ("flow", None): 1}
    assert {(r.kind, r.name): r.n for r in ledgers.fund_summary(b.limit(0), f.limit(0)).collect()} == dict.fromkeys(totals, 0)


def test_run_summary(spark):
    rows = [(1, "a", "hi", 5, True), (2, "a", None, 9, True), (3, None, "lo", 9, True), (4, "b", "lo", 99, False), (5, "b", "lo", 50, None), (6, "a", "hi", None, True)]
    df = spark.createDataFrame(rows, "run int, type string, severity string, profit long, profitable boolean").repartition(3)
    r = ledgers.run_summary(df).first()
    assert (r.simulated, r.profitable, r.total_profit, r.best_run, r.best_profit) == (6, 4, 23, 2, 9)
    assert r.types == {"a": 3, "": 1} and r.severities == {"hi": 2, "": 1, "lo": 1}
    r = ledgers.run_summary(df.limit(0)).first()
    assert (r.simulated, r.profitable, r.total_profit, r.best_run, r.best_profit, r.types, r.severities) == (0, 0, 0, None, None, {}, {})
