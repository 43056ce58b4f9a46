"""Queries of effects: lines of four orders are a contract, line numbers functions, suppliers variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as E
from ..operators import matching as J
from .catalog import parts_of, query

EFFECTS = """e AS (SELECT DISTINCT l_orderkey // 4 AS contract, 'f' || l_linenumber AS function, 'v' || (l_suppkey % 5) AS var, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind FROM lineitem),
f AS (SELECT DISTINCT l_orderkey // 4 AS contract, 'f' || l_linenumber AS function, l_linenumber % 2 = 0 AS public, l_linenumber % 3 > 0 AS calls_out, (l_orderkey // 4) % 3 = 0 AND l_linenumber > 3 AS guarded FROM lineitem)"""


def effects_of(li):
    contract, function = F.floor(F.col("l_orderkey") / 4).alias("contract"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("function")
    e = li.select(contract, function, F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")).alias("var"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("kind"))
    n = F.col("l_linenumber")
    f = li.select(contract, function, (n % 2 == 0).alias("public"), (n % 3 > 0).alias("calls_out"), ((F.floor(F.col("l_orderkey") / 4) % 3 == 0) & (n > 3)).alias("guarded")).distinct()
    return e, f


@query("dependencies", "lineitem", sql=f"""WITH {EFFECTS}
SELECT contract, function, array_to_string(coalesce((SELECT list_sort(list(DISTINCT o.function)) FROM e m JOIN e o ON m.contract = o.contract AND m.var = o.var WHERE m.contract = x.contract AND m.function = x.function AND m.kind = 'write' AND o.kind = 'write' AND o.function <> m.function), []), ',') AS conflicts_with,
array_to_string(coalesce((SELECT list_sort(list(DISTINCT o.function)) FROM e m JOIN e o ON m.contract = o.contract AND m.var = o.var WHERE m.contract = x.contract AND m.function = x.function AND m.kind = 'read' AND o.kind = 'write' AND o.function <> m.function), []), ',') AS depends_on
FROM (SELECT DISTINCT contract, function FROM e) x""")
def _(li):
    return E.dependencies(effects_of(li)[0]).withColumns({c: F.array_join(c, ",") for c in ("conflicts_with", "depends_on")})


@query("cross_function", "lineitem", sql=f"""WITH {EFFECTS}
SELECT w.contract, w.function AS writer, r.function AS reader, w.var FROM e w JOIN e r ON w.contract = r.contract AND w.var = r.var AND w.function <> r.function AND w.kind = 'write' AND r.kind = 'read'
WHERE (w.contract, w.function) IN (SELECT (contract, function) FROM f WHERE calls_out AND NOT guarded) AND (r.contract, r.function) IN (SELECT (contract, function) FROM f WHERE public)""")
def _(li):
    return E.cross_function_edges(*effects_of(li))


@query("profit_chains", "lineitem", sql=f"""WITH {EFFECTS}
SELECT w.contract, w.function AS source, r.function AS target, array_to_string(list_sort(list(DISTINCT w.var)), ',') AS shared, 2.5::double AS weight FROM e w JOIN e r ON w.contract = r.contract AND w.var = r.var AND w.function <> r.function AND w.kind = 'write' AND r.kind = 'read'
WHERE (w.contract, w.function) IN (SELECT (contract, function) FROM f WHERE calls_out) AND (r.contract, r.function) IN (SELECT (contract, function) FROM f WHERE public) GROUP BY ALL""")
def _(li):
    e, f = effects_of(li)
    return E.profit_chains(e, f.withColumnsRenamed({"calls_out": "manipulates", "public": "profitable"})).withColumn("shared", F.array_join("shared", ","))


PARENTS = "SELECT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_suppkey >= 3 UNION SELECT s_suppkey, s_suppkey // 5 FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey >= 5"


def parents(s):
    k = F.col("s_suppkey")
    return s.where("s_suppkey >= 3").select(k.alias("src"), F.floor(k / 3).alias("dst")).unionByName(s.where("s_suppkey % 7 = 0 and s_suppkey >= 5").select(k.alias("src"), F.floor(k / 5).alias("dst")))


@query("inherited", "supplier", sql=f"""WITH RECURSIVE e AS ({PARENTS}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
p AS (SELECT s_suppkey AS contract, 'n' || s_nationkey AS name FROM supplier WHERE s_suppkey % 4 = 1)
SELECT x.src AS contract, array_to_string(list_sort(list(DISTINCT name)), ',') AS protections FROM (SELECT src, dst FROM r UNION SELECT contract, contract FROM p) x JOIN p ON p.contract = x.dst GROUP BY x.src""")
def _(s):
    own = s.where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("contract"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"))
    return E.inherited(parents(s), own).withColumn("protections", F.array_join("protections", ","))


@query("resolved_members", "lineitem", sql="""WITH c AS (SELECT o AS contract, a AS ancestor, min(n) AS place FROM (SELECT l_orderkey AS o, l_suppkey AS a, l_linenumber AS n FROM lineitem) GROUP BY o, a),
m AS (SELECT DISTINCT l_suppkey AS ancestor, 'm' || (l_partkey % 6) AS member FROM lineitem WHERE l_partkey % 5 = 0)
SELECT contract, member, arg_min(ancestor, (place, ancestor)) AS owner, count(*) - 1 AS overridden FROM c JOIN m USING (ancestor) GROUP BY ALL""")
def _(li):
    parts = parts_of(li)
    chain = li.select("l_orderkey", "l_suppkey", "l_linenumber").repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("contract"), F.col("l_suppkey").alias("ancestor")).agg(F.min("l_linenumber").alias("place"))
    members = li.where("l_partkey % 5 = 0").select(F.col("l_suppkey").alias("ancestor"), F.concat(F.lit("m"), (F.col("l_partkey") % 6).cast("string")).alias("member"))
    return E.resolved_members(chain, members, parts)


FITS = "SELECT l_suppkey AS k, l_linenumber % 3 AS f, min(l_quantity) AS a, max(l_tax) AS b, min(l_extendedprice) AS rmse, max(l_discount) * 10 AS confidence FROM lineitem GROUP BY l_suppkey, l_linenumber"


@query("blend_fits", "lineitem", sql=f"""
WITH r AS (SELECT *, row_number() OVER w AS n FROM (SELECT k, 'f' || f AS family, a, b, round(rmse, 4) AS rmse, round(confidence, 6) AS confidence FROM ({FITS})) WINDOW w AS (PARTITION BY k ORDER BY rmse, -confidence, family, a, b)),
p AS (SELECT t.*, o.a AS a2, o.b AS b2, o.rmse AS rmse2, o.confidence AS c2, coalesce(abs(t.rmse - o.rmse) / t.rmse <= 0.05, false) AS blended FROM r t LEFT JOIN (
  SELECT r.* FROM r JOIN r t ON t.k = r.k AND t.n = 1 AND t.family = r.family WHERE r.n > 1 QUALIFY row_number() OVER (PARTITION BY r.k ORDER BY r.n) = 1) o ON o.k = t.k WHERE t.n = 1)
SELECT k, family || CASE WHEN blended THEN ' (blended)' ELSE '' END AS winner, round(CASE WHEN blended THEN (a * confidence + a2 * c2) / (confidence + c2) ELSE a END, 6) AS a, round(CASE WHEN blended THEN (b * confidence + b2 * c2) / (confidence + c2) ELSE b END, 6) AS b,
  round(CASE WHEN blended THEN (rmse * confidence + rmse2 * c2) / (confidence + c2) ELSE rmse END, 4) AS rmse, CASE WHEN blended THEN greatest(confidence, c2) ELSE confidence END AS confidence, blended FROM p""")
def _(li):
    g = li.groupBy(F.col("l_suppkey").alias("k"), "l_linenumber").agg(F.min("l_quantity").alias("a"), F.max("l_tax").alias("b"), F.min("l_extendedprice").alias("rmse"), (F.max("l_discount") * 10).alias("confidence"))
    fits = g.select("k", F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")).alias("family"), "a", "b", F.round("rmse", 4).alias("rmse"), F.round("confidence", 6).alias("confidence"))
    return E.blend_fits(fits, ["k"]).withColumns({"a": F.round("a", 6), "b": F.round("b", 6), "rmse": F.round("rmse", 4)})


@query("cached_match", "embeddings", sql="""
SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) > 0.3
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) DESC, b.vec_id) <= 1""")
def _(v):
    """The one nearest row of each query, if it is near enough: a cache's or a transfer's best match."""
    return J.cosine_search(v, F.col("vec_id") % 20 == 0, 1).where("score > 0.3")
