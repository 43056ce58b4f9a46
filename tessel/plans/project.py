"""Queries of project records: JSON answers, evaluation by substring, summaries, graphs of names, taint and saturating fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import analytics as A
from ..operators import records as R
from .catalog import query

ANSWERS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '{"answer": "' || event_type || '", "k": 0}' WHEN 2 THEN '{"message": {"content": "m' || user_id || '"}, "k": ""}' WHEN 3 THEN 'no json'
WHEN 4 THEN '[1, 2]' WHEN 5 THEN '{"k": {"content": 1}, "text": 5, "content": "c"}' END AS body FROM events"""


def answers(e):
    body = [F.col("props"), F.concat(F.lit('{"answer": "'), "event_type", F.lit('", "k": 0}')), F.concat(F.lit('{"message": {"content": "m'), F.col("user_id").cast("string"), F.lit('"}, "k": ""}')),
            F.lit("no json"), F.lit("[1, 2]"), F.lit('{"k": {"content": 1}, "text": 5, "content": "c"}')]
    out = F.lit(None).cast("string")
    for k, b in enumerate(body):
        out = F.when(F.col("event_id") % 7 == k, b).otherwise(out)
    return e.select("event_id", out.alias("body"))


@query("json_answers", "events", sql=f"""
WITH a AS (SELECT *, try_cast(body AS json) AS j FROM ({ANSWERS})), o AS (SELECT *, json_type(j) = 'OBJECT' AS is_object, json_extract_string(j, '$.k') AS k FROM a)
SELECT event_id, coalesce(is_object AND CASE WHEN json_type(j, '$.k') = 'VARCHAR' THEN k <> '' ELSE k NOT IN ('', 'false', '[]', '{{}}') AND coalesce(try_cast(k AS double) <> 0, true) END, false) AS truthy,
  coalesce(is_object AND k = '87', false) AS is_87, CASE WHEN body IS NULL OR j IS NOT NULL THEN body ELSE '{{"raw":"' || body || '"}}' END AS payload,
  coalesce(CASE WHEN is_object THEN coalesce({", ".join(f"CASE json_type(j, '$.{c}') WHEN 'VARCHAR' THEN json_extract_string(j, '$.{c}') WHEN 'OBJECT' THEN json_extract_string(j, '$.{c}.content') END" for c in ("answer", "text", "content", "message"))}) END, body) AS answer
FROM o""")
def _(e):
    b = F.col("body")
    return answers(e).select("event_id", D.field_truthy(b, "k").alias("truthy"), D.field_equals(b, "k", "87").alias("is_87"), D.decoded_payload(b).alias("payload"), D.answer_text(b).alias("answer"))


@query("dampened_risk", "events", sql="""SELECT user_id, round(CASE WHEN bool_or(event_type = 'error' AND user_id % 3 > 0) THEN 1 / (1 + exp(-(4 * (count_if(event_id % 3 = 0) / count(*) - 0.3) + 2 * count_if(event_id % 5 = 0) / count(*) + 2 * (max(value / 500) - 0.9))))
ELSE greatest(0, least(1, 0.48 + 0.5 * (max(value / 500) - 0.87))) END, 6) AS p FROM events GROUP BY user_id""")
def _(e):
    found = e.select("user_id", (F.col("event_id") % 3 == 0).alias("sat"), (F.col("event_id") % 5 == 0).alias("exploitable"), ((F.col("event_type") == "error") & (F.col("user_id") % 3 > 0)).alias("proven"), (F.col("value") / 500).alias("confidence"))
    return A.dampened(found, ["user_id"]).withColumn("p", F.round("p", 6))


@query("ground_truth", "part", sql="SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN true WHEN contains(lower(p_type), 'polished') THEN false WHEN contains(lower(p_type), 'steel') THEN true ELSE false END AS is_real FROM part")
def _(p):
    return p.select("p_partkey", R.first_contained(F.col("p_type"), [("brass", True), ("polished", False), ("steel", True)], False).alias("is_real"))


@query("expected_found", "part", "supplier", sql="""
WITH w AS (SELECT DISTINCT s_nationkey::bigint AS k, unnest(['brass', 'large', 'tin' || (s_suppkey % 3)]) AS expected FROM supplier), c AS (SELECT DISTINCT p_partkey % 40 AS k, lower(p_type) AS category FROM part)
SELECT k, count(*) AS expected, count_if(EXISTS (SELECT 1 FROM c WHERE c.k = w.k AND contains(category, expected)))::bigint AS found, count_if(EXISTS (SELECT 1 FROM c WHERE c.k = w.k AND contains(category, expected))) > 0 AS detected FROM w GROUP BY k""")
def _(p, s):
    expected = s.select(F.col("s_nationkey").cast("long").alias("k"), F.explode(F.array(F.lit("brass"), F.lit("large"), F.concat(F.lit("tin"), (F.col("s_suppkey") % 3).cast("string")))).alias("expected"))
    return R.expected_found(p.select((F.col("p_partkey") % 40).alias("k"), F.col("p_type").alias("category")), expected, ["k"])


PAGES = "SELECT page_id, url, length(html) - length(replace(html, chr(10), '')) + 1 AS loc, (length(html) - length(replace(html, '<a ', ''))) // 3 AS calls FROM pages"


@query("project_stats", "pages", sql=f"""WITH f AS ({PAGES}) SELECT 'total' AS list, NULL AS page_id, sum(loc)::bigint AS amount FROM f UNION ALL SELECT 'total calls', NULL, sum(calls)::bigint FROM f
UNION ALL SELECT 'loc', page_id, loc FROM (SELECT * FROM f ORDER BY loc DESC, page_id LIMIT 10) WHERE loc > 0 UNION ALL SELECT 'calls', page_id, calls FROM (SELECT * FROM f ORDER BY calls DESC, page_id LIMIT 10) WHERE calls > 0""")
def _(p):
    count = lambda mark: (F.length("html") - F.length(F.replace("html", F.lit(mark)))) / len(mark)
    files = p.select("page_id", (count("\n") + 1).cast("long").alias("loc"), count("<a ").cast("long").alias("calls"))
    sums = files.agg(F.sum("loc").alias("loc"), F.sum("calls").alias("calls")).select(F.inline(F.array(*[F.struct(F.lit(n).alias("list"), F.lit(None).cast("long").alias("page_id"), F.col(c).alias("amount")) for n, c in (("total", "loc"), ("total calls", "calls"))])))
    return sums.unionByName(R.largest(files, ["loc", "calls"], "page_id", 10))


@query("cross_patterns", "lineitem", sql="SELECT l_returnflag || l_shipdate::date::varchar AS kind, count(*) AS occurrences, count(DISTINCT l_suppkey) AS places, count(DISTINCT l_suppkey) > 1 AS systemic FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(li):
    return R.repeated_patterns(li.select(F.concat("l_returnflag", F.to_date("l_shipdate").cast("string")).alias("kind"), "l_suppkey"), "kind", "l_suppkey")


@query("surface_summary", "events", sql="SELECT user_id, count(*) AS actions, count_if(value > 250)::bigint AS large, bool_or(event_type = 'error') AS any_error, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def _(e):
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return e.groupBy("user_id").agg(F.count("*").alias("actions"), F.count_if(F.col("value") > 250).alias("large"), F.bool_or(F.col("event_type") == "error").alias("any_error"), types.alias("types"))


@query("induced_edges", "lineitem", sql="SELECT l_suppkey AS src, l_partkey % 100 AS dst, l_quantity AS weight FROM lineitem WHERE l_suppkey % 3 = 0 AND (l_partkey % 100) % 3 = 0 AND l_partkey % 100 IN (SELECT l_suppkey FROM lineitem)")
def _(li):
    edges = li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_quantity").alias("weight"))
    nodes = li.select(F.col("l_suppkey").alias("node")).distinct().where("node % 3 = 0")
    return R.induced(edges, nodes)


@query("referenced_nodes", "nation", "supplier", sql="""
WITH e AS (SELECT 'account:' || s_suppkey AS src, CASE s_suppkey % 3 WHEN 0 THEN 'token:' || s_nationkey WHEN 1 THEN 'n' || s_nationkey ELSE 'pool' || s_nationkey END AS dst FROM supplier),
n AS (SELECT 'n' || n_nationkey AS node, 'nation' AS kind, n_name AS label FROM nation WHERE n_nationkey % 2 = 0)
SELECT node, kind, label, false AS placeholder FROM n UNION ALL
SELECT node, CASE WHEN starts_with(node, 'account:') THEN 'account' WHEN starts_with(node, 'token:') THEN 'token' ELSE 'external' END, CASE WHEN contains(node, ':') THEN substr(node, instr(node, ':') + 1) ELSE node END, true
FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) ANTI JOIN n USING (node)""")
def _(n, s):
    text = lambda c: F.col(c).cast("string")
    k = F.col("s_suppkey") % 3
    dst = F.when(k == 0, F.concat(F.lit("token:"), text("s_nationkey"))).when(k == 1, F.concat(F.lit("n"), text("s_nationkey"))).otherwise(F.concat(F.lit("pool"), text("s_nationkey")))
    edges = s.select(F.concat(F.lit("account:"), text("s_suppkey")).alias("src"), dst.alias("dst"))
    nodes = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), text("n_nationkey")).alias("node"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"))
    return R.with_placeholders(nodes, edges, [("account:", "account"), ("token:", "token")], "external")


@query("taint", "lineitem", sql="""
WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS fn, l_linenumber::bigint AS step, l_suppkey % 4 AS target, l_partkey % 4 AS used FROM lineitem),
r(fn, name, source, since) AS (SELECT DISTINCT fn, p, 'in' || p, -1::bigint FROM s, (SELECT unnest([0::bigint, 1]) AS p) WHERE fn % 3 <> 0
  UNION SELECT r.fn, s.target, r.source, s.step FROM r JOIN s ON s.fn = r.fn AND s.used = r.name AND s.step > r.since)
SELECT fn AS function, name, source, min(since) AS since FROM r GROUP BY ALL""")
def _(li):
    steps = li.select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 4).alias("target"), (F.col("l_partkey") % 4).alias("used"))
    public = steps.where("function % 3 <> 0").select("function").distinct()
    seeds = public.select("function", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("name")).withColumn("source", F.concat(F.lit("in"), F.col("name").cast("string")))
    return R.tainted(steps, seeds)


GRID = "[0.1, 0.2, 0.5, 1.0, 2.0, 5.0]"


@query("fit_saturation", "lineitem", sql=f"""
WITH x AS (SELECT l_returnflag AS k, l_quantity AS t, l_extendedprice AS y, max(l_quantity) OVER (PARTITION BY l_returnflag) AS top FROM lineitem),
g AS (SELECT k, y, i, 1 - exp(-t / ({GRID}[i]::double * top)) AS x FROM x, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)),
f AS (SELECT k, i, count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, sqrt(greatest(0, var_pop(y) - covar_pop(x, y) ** 2 / var_pop(x))) AS rmse FROM g GROUP BY k, i)
SELECT k AS l_returnflag, round(a, 3) AS a, round(b, 3) AS b, round(rmse, 3) AS rmse, n, round(1 / (1 + rmse) * (1 - exp(-n / 20)), 9) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY rmse, i) = 1""")
def _(li):
    fit = R.fit_saturation(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.withColumns({"a": F.round("a", 3), "b": F.round("b", 3), "rmse": F.round("rmse", 3), "confidence": F.round("confidence", 9)})
