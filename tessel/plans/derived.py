"""More queries of the catalogue: pairs, fits, closures, allocation and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import fitting as T
from ..operators import iterative as R
from ..operators import matching as J
from .catalog import EDGES, SIGNED, edges_of, query


@query("profile_by_domain", "events", sql="""SELECT event_type, count(*) AS n, count_if(event_id % 3 = 0) AS success, round(count_if(event_id % 3 = 0) / count(*), 6) AS success_rate,
round(coalesce(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 0), 6) AS avg_score FROM events GROUP BY event_type""")
def _(e):
    return A.domain_profile(e, ["event_type"], F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 5 != 0, F.col("value")))


@query("jaccard_pairs", "conversations", sql="""
WITH t AS (SELECT conv_id, turn, list_distinct([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+') IF x <> '']) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0), 6) AS score
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(c):
    words = c.select("conv_id", "turn", X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return words.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.token_jaccard(F.col("w"), F.col("v")), 6).alias("score"))


@query("between_join", "lineitem", sql="""SELECT c.l_orderkey, a.l_linenumber AS l_linenumber_a, c.l_linenumber AS l_linenumber_c, b.l_linenumber AS l_linenumber_b FROM lineitem c
JOIN lineitem a ON a.l_orderkey = c.l_orderkey AND a.l_linenumber < c.l_linenumber JOIN lineitem b ON b.l_orderkey = c.l_orderkey AND b.l_linenumber > c.l_linenumber
WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'N' AND c.l_returnflag = 'A'""")
def _(li):
    return J.between(li, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") == "N", F.col("l_returnflag") == "A")


@query("conflict_pairs", "lineitem", sql="""SELECT a.l_orderkey, a.l_returnflag, a.l_linenumber AS l_linenumber_a, b.l_linenumber AS l_linenumber_b
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber""")
def _(li):
    return J.ordered_pairs(li, ["l_orderkey", "l_returnflag"], "l_linenumber")


@query("hypothesis_pairs", "events", sql="""WITH p AS (SELECT event_type, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT a.event_type, a.event_id AS event_id_a, b.event_id AS event_id_b FROM p a JOIN p b ON a.event_type = b.event_type AND a.event_id < b.event_id ORDER BY 2, 3 LIMIT 20""")
def _(e):
    return J.recent_pairs(e, [F.desc("ts"), F.desc("event_id")], "event_type", "event_id", 50, 20)


@query("fit_rank", "lineitem", sql="""
WITH s AS (SELECT l_returnflag, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(x ** 3) AS sx3, sum(x ** 4) AS sx4, sum(x * x * y) AS sx2y
  FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1),
q AS (SELECT *, (sx2y * sxx - sxy * sx3) / (sx4 * sxx - sx3 * sx3) AS qa, (sx4 * sxy - sx3 * sx2y) / (sx4 * sxx - sx3 * sx3) AS qb FROM s),
f AS (SELECT l_returnflag, 'ax' AS family, sqrt((syy - sxy * sxy / sxx) / n) AS rmse FROM s
  UNION ALL SELECT l_returnflag, 'ax+b', sqrt((syy - sy * sy / n - (sxy - sx * sy / n) ** 2 / (sxx - sx * sx / n)) / n) FROM s
  UNION ALL SELECT l_returnflag, 'ax2+bx', sqrt((syy - qa * sx2y - qb * sxy) / n) FROM q)
SELECT l_returnflag, family, round(rmse, 2) AS rmse, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(rmse, 2), family) AS place FROM f""")
def _(li):
    return T.rank_fits(T.fit_families(li, ["l_returnflag"], "l_quantity", "l_extendedprice"), ["l_returnflag"]).select("l_returnflag", "family", "rmse", "place")


@query("fit_power", "lineitem", sql="SELECT l_linestatus, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 2) AS a, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 5) AS b, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def _(li):
    return T.fit_power(li, ["l_linestatus"], "l_quantity", "l_extendedprice").withColumns({"a": F.round("a", 2), "b": F.round("b", 5)})


@query("closure", "lineitem", sql=f"WITH RECURSIVE e AS ({EDGES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def _(li):
    return R.closure(edges_of(li))


@query("graph_levels", "nation", "supplier", sql="""SELECT DISTINCT 'r' || n_regionkey AS node, 0 AS level FROM nation UNION ALL SELECT DISTINCT 'n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)""")
def _(n, s):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    down = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    return R.levels(down.unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"))))


@query("greedy_budget", "part", sql="""
WITH RECURSIVE i AS (SELECT p_brand, p_partkey, p_retailprice AS cost, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * (1 - 0.5::double * ((p_partkey % 100) / 100.0::double)) / p_retailprice DESC, p_size DESC, p_partkey) AS n FROM part),
w(p_brand, p_partkey, n, rest, taken) AS (SELECT p_brand, p_partkey, n, CASE WHEN cost <= 10000 THEN 10000 - cost ELSE 10000.0::double END, cost <= 10000 FROM i WHERE n = 1
  UNION ALL SELECT i.p_brand, i.p_partkey, i.n, CASE WHEN cost <= rest THEN rest - cost ELSE rest END, cost <= rest FROM w JOIN i ON i.p_brand = w.p_brand AND i.n = w.n + 1)
SELECT p_brand, p_partkey FROM w WHERE taken""")
def _(p):
    density = F.col("p_size") * (1 - 0.5 * ((F.col("p_partkey") % 100) / 100.0)) / F.col("p_retailprice")
    items = p.select("p_brand", "p_partkey", "p_size", "p_retailprice", density.alias("density"))
    return R.greedy_fill(items, "p_brand", [F.desc("density"), F.desc("p_size"), F.asc("p_partkey")], "p_retailprice", 10000).select("p_brand", "p_partkey")


@query("merge_retrieval", "benchmark", "documents", sql="""
WITH u AS (SELECT 0 AS rank, 'external' AS source, item_id AS id, trim(text) AS text FROM benchmark UNION ALL SELECT 1, 'memory', doc_id, trim(text) FROM documents)
SELECT source, id, text FROM (SELECT * FROM u WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank, id) = 1) ORDER BY rank, id LIMIT 60""")
def _(b, d):
    return J.merge_ranked([("external", b.select(F.col("item_id").alias("id"), "text")), ("memory", d.select(F.col("doc_id").alias("id"), "text"))], 60)


@query("phrase_recall", "documents", sql="""SELECT doc_id, round((contains(lower(text), 'of the')::int + 0.2::double * (contains(lower(text), 'of')::int + contains(lower(text), 'the')::int)) * (0.5::double + (doc_id % 10) / 10.0::double), 6) AS score
FROM documents WHERE contains(lower(text), 'of') OR contains(lower(text), 'the') ORDER BY score DESC, doc_id LIMIT 20""")
def _(d):
    s = d.select("doc_id", F.round(J.phrase_score(F.col("text"), "of the", (F.col("doc_id") % 10) / 10.0), 6).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("task_recall", "conversations", sql="""
SELECT conv_id, turn, round(0.3::double * (role = 'user')::int + 0.3::double * (conv_id % 2 = 0)::int + 0.4::double * len(list_intersect(list_distinct([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+') IF x <> '']), ['the', 'a'])) / 2, 6) AS score
FROM conversations ORDER BY score DESC, conv_id, turn LIMIT 20""")
def _(c):
    score = J.task_score(F.col("role") == "user", F.col("conv_id") % 2 == 0, X.tokens(F.coalesce("text", F.lit(""))), ["the", "a"])
    return c.select("conv_id", "turn", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)


@query("net_effect", "events", sql=f"""WITH r AS (SELECT user_id, max((ts, event_id)) AS reset FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.user_id, count(*) AS steps, round(sum({SIGNED}), 4) AS net FROM events e LEFT JOIN r USING (user_id) WHERE reset IS NULL OR (ts, event_id) >= reset GROUP BY e.user_id""")
def _(e):
    out = A.net_effect(e.withColumn("delta", F.expr(SIGNED)), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "delta")
    return out.withColumn("net", F.round("net", 4))


@query("factor_bands", "part", sql="SELECT p_brand, CASE WHEN p_size / 50 >= .7 THEN 'high' WHEN p_size / 50 >= .4 THEN 'medium' WHEN p_size / 50 >= .2 THEN 'low' ELSE 'minor' END AS band, count(*) AS n FROM part GROUP BY ALL")
def _(p):
    return p.groupBy("p_brand", A.factor_band(F.col("p_size") / 50).alias("band")).agg(F.count("*").alias("n"))
