"""Queries of balances, flows and runs: customers hold, orders move, every order is a simulated run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers as L
from .catalog import query


@query("unbalanced", "lineitem", sql="""SELECT l_orderkey AS delta, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * l_quantity::bigint)::bigint AS net
FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY l_orderkey HAVING net <> 0""")
def _(li):
    amount = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1) * F.col("l_quantity").cast("long")
    return L.unbalanced(li.select(F.col("l_orderkey").alias("delta"), F.col("l_returnflag").alias("token"), amount.alias("amount")), ["N", "A"])


@query("fund_summary", "customer", "orders", sql="""WITH b AS (SELECT c_custkey AS account, c_nationkey % 7 AS token, c_mktsegment AS type FROM customer),
f AS (SELECT o_custkey AS source, o_orderkey % 1000 AS target, o_orderkey % 9 AS token, o_orderstatus AS type FROM orders)
SELECT 'balance' AS kind, type AS name, count(*) AS n FROM b GROUP BY type UNION ALL SELECT 'flow', type, count(*) FROM f GROUP BY type
UNION ALL SELECT 'total', 'balances', count(*) FROM b UNION ALL SELECT 'total', 'flows', count(*) FROM f
UNION ALL SELECT 'total', 'accounts', count(DISTINCT a) FROM (SELECT account AS a FROM b UNION SELECT source FROM f UNION SELECT target FROM f)
UNION ALL SELECT 'total', 'tokens', count(DISTINCT t) FROM (SELECT token AS t FROM b UNION SELECT token FROM f)""")
def _(c, o):
    key = F.col("o_orderkey")
    balances = c.select(F.col("c_custkey").alias("account"), (F.col("c_nationkey") % 7).alias("token"), F.col("c_mktsegment").alias("type"))
    flows = o.select(F.col("o_custkey").alias("source"), (key % 1000).alias("target"), (key % 9).alias("token"), F.col("o_orderstatus").alias("type"))
    return L.fund_summary(balances, flows)


RUNS = """SELECT o_orderkey AS run, o_orderstatus AS type, o_orderpriority AS severity, (floor(o_totalprice / 1000) - 150)::bigint AS profit FROM orders"""


@query("run_summary", "orders", sql=f"""WITH r AS ({RUNS}), p AS (SELECT * FROM r WHERE profit > 0)
SELECT (SELECT count(*) FROM r) AS simulated, (SELECT count(*) FROM p) AS profitable, (SELECT coalesce(sum(profit), 0)::bigint FROM p) AS total_profit,
(SELECT run FROM p ORDER BY profit DESC, run LIMIT 1) AS best_run, (SELECT max(profit) FROM p) AS best_profit,
(SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM p GROUP BY type)) AS types,
(SELECT string_agg(severity || ':' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM p GROUP BY severity)) AS severities""")
def _(o):
    profit = (F.floor(F.col("o_totalprice") / 1000) - 150).cast("long")
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("severity"), profit.alias("profit"), (profit > 0).alias("profitable"))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return L.run_summary(runs).withColumns({c: shown(c) for c in ("types", "severities")})
