"""Queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as M
from ..functions import text as X
from ..operators import analytics as A
from ..operators import events as E
from ..operators import graph as G
from ..operators import matching as J
from ..sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def now():
    """The fixed time that queries take as now."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


TASK_ROWS = 250_000
CATEGORIES = (("click", "touch"), ("purch", "money"), ("err", "fault"))


def query(name: str, *tables: str, sql: str | None):
    """Register a function of the named tables with its SQL (None: SQL has no form of it, a test holds it against plain Python)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[read_parquet(spark, sf_dir, t) for t in tables])
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def parts_of(rows: DataFrame) -> int:
    """How many tasks share what is joined from a table: as many as it has TASK_ROWS rows, so that no task's memory grows with it."""
    return max(1, -(-rows.count() // TASK_ROWS))


def shown(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type")


SHOWN = "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type FROM"


@query("event_query_or", "events", sql=f"{SHOWN} events WHERE (event_type = 'click' OR user_id = 7) AND ts >= '2024-01-05' AND ts <= '2024-01-20' AND contains(event_type || ' ' || props, '1')")
def _(e):
    return shown(E.query(e, "click", 7, "1", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))


@query("event_query_and", "events", sql=f"{SHOWN} events WHERE event_type = 'click' AND user_id = 7")
def _(e):
    return shown(E.query(e, "click", 7, match="and"))


@query("event_latest", "events", sql=f"{SHOWN} events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(e):
    return shown(E.latest_one(e, ["user_id", "event_type"], ["ts", "event_id"]))


@query("event_range", "events", sql=f"{SHOWN} events WHERE ts BETWEEN '2024-01-10' AND '2024-01-11'")
def _(e):
    return shown(e.where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz"))))


@query("event_recent_k", "events", sql=f"{SHOWN} events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5")
def _(e):
    return shown(E.latest(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 5))


TTL = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 30) * 86400.0 END"


@query("ttl_evict", "events", sql=f"{SHOWN} events WHERE event_id % 97 = 0 OR ({TTL}) IS NULL OR epoch(TIMESTAMP '2024-01-31') - epoch(ts) <= {TTL}")
def _(e):
    return shown(E.unexpired(e, now(), F.expr(TTL), F.col("event_id") % 97 == 0))


@query("lru_retain", "events", sql=f"{SHOWN} events ORDER BY ts DESC, event_id DESC LIMIT 512")
def _(e):
    return shown(e.orderBy(F.desc("ts"), F.desc("event_id")).limit(512))  # the capacity of the store


@query("selective_forget", "events", sql=f"{SHOWN} events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 97 <> 0 AND ts <= TIMESTAMP '2024-01-21' ORDER BY ts, event_id LIMIT 100)")
def _(e):
    return shown(E.selective_forget(e, now(), 10, F.col("event_id") % 97 == 0, 100))


@query("upsert_latest", "events", sql=f"{SHOWN} events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, epoch_us(ts) + 2000000, user_id, 'changed 2' FROM events WHERE event_id % 10 = 0")
def _(e):
    part = e.where("event_id % 10 = 0")  # each changed twice
    changes = [part.withColumn("event_type", F.lit(f"changed {k}")).withColumn("ts", F.col("ts") + F.expr(f"interval {k} seconds")) for k in (2, 1)]
    return shown(E.upsert(e, changes[0].unionByName(changes[1]), "event_id", "ts"))


@query("severity_rollup", "orders", sql="SELECT count_if(o_orderpriority = '1-URGENT') AS critical, count_if(o_orderpriority = '2-HIGH') AS high, count_if(o_orderpriority = '3-MEDIUM') AS medium, count_if(o_orderpriority = '5-LOW') AS low FROM orders")
def _(o):
    return o.agg(*[F.count_if(F.col("o_orderpriority") == v).alias(k) for k, v in (("critical", "1-URGENT"), ("high", "2-HIGH"), ("medium", "3-MEDIUM"), ("low", "5-LOW"))])


@query("dir_summary_sets", "orders", sql="SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def _(o):
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("dedup_merge", "lineitem", sql="""
WITH f AS (SELECT l_orderkey AS contract, l_linenumber // 3 AS bucket, l_linestatus AS category, l_linenumber::bigint * 1000000000 + l_partkey * 1000 + l_suppkey AS seq, l_returnflag AS source, l_discount * 5 AS confidence,
  repeat('x', (l_quantity::int) % 7) AS description, (l_partkey % 4)::int AS severity_rank FROM lineitem)
SELECT contract, bucket, category, arg_min(source, seq) AS first_source, round(least(1.0, arg_min(confidence, seq) + 0.1 * (count(*) - 1)), 6) AS confidence,
  arg_max(description, length(description)) AS description, min(severity_rank) AS severity_rank, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS hits
FROM f GROUP BY ALL""")
def _(li):
    f = li.select(
        F.col("l_orderkey").alias("contract"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("bucket"), F.col("l_linestatus").alias("category"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.col("l_returnflag").alias("source"), (F.col("l_discount") * 5).alias("confidence"), F.expr("repeat('x', cast(l_quantity as int) % 7)").alias("description"), (F.col("l_partkey") % 4).cast("int").alias("severity_rank"),
    )
    return A.merge_findings(f, ["contract", "bucket", "category"]).withColumn("confidence", F.round("confidence", 6))


@query("risk_score", "events", sql="""SELECT event_id, round(p, 6) AS p, CASE WHEN p >= .85 THEN 'critical' WHEN p >= .65 THEN 'high' WHEN p >= .4 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT event_id, 1 / (1 + exp(-(2.5 * (value / 500) + 4.0 * (event_id % 2) * 0.1 + 1.5 * 0.5 - 1.2))) AS p FROM events)""")
def _(e):
    p = M.risk(F.col("value") / 500, (F.col("event_id") % 2) * 0.1, F.lit(0.5))
    return e.withColumn("q", p).select("event_id", F.round("q", 6).alias("p"), M.severity(F.col("q")).alias("severity"))


P = "least(1.0, value / 500)"


@query("noisy_or", "events", sql=f"SELECT user_id, round(1 - product(1 - {P}), 6) AS p FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(e):
    return e.where("event_type = 'error'").groupBy("user_id").agg(F.round(A.noisy_or(F.expr(P)), 6).alias("p"))


@query("entropy", "events", sql=f"SELECT user_id, round(avg(-(q * ln(q) + (1 - q) * ln(1 - q))), 6) AS h FROM (SELECT user_id, greatest(1e-15, least(1 - 1e-15, {P})) AS q FROM events) GROUP BY user_id")
def _(e):
    return e.groupBy("user_id").agg(F.round(A.mean_entropy(F.expr(P)), 6).alias("h"))


@query("contract_features", "events", sql=f"SELECT user_id, round(max({P}), 6) AS max_p, round(avg({P}), 6) AS mean_p, count_if({P} >= .65) AS high, round(ln(1 + count(*)) / ln(21), 6) AS log_n FROM events GROUP BY user_id")
def _(e):
    p = F.expr(P)
    return e.groupBy("user_id").agg(F.round(F.max(p), 6).alias("max_p"), F.round(F.avg(p), 6).alias("mean_p"), F.count_if(p >= 0.65).alias("high"), F.round(F.ln(1 + F.count("*")) / F.ln(F.lit(21)), 6).alias("log_n"))


PRED = "SELECT least(1.0, n_chars / 5000.0) AS p, quality AS y FROM documents JOIN labels USING (doc_id)"


def predictions(d: DataFrame, la: DataFrame) -> DataFrame:
    return d.join(la, "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").alias("y"))


COUNTS = "count_if(p >= t AND y = 1) AS tp, count_if(p >= t AND y = 0) AS fp, count_if(p < t AND y = 0) AS tn, count_if(p < t AND y = 1) AS fn"


@query("confusion", "documents", "labels", sql=f"""SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM (SELECT {COUNTS} FROM ({PRED}), (SELECT 0.4 AS t))""")
def _(d, la):
    out = A.confusion(predictions(d, la), 0.4)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "fpr", "f1", "accuracy")})


@query("brier_ece", "documents", "labels", sql=f"""WITH p AS ({PRED}), b AS (SELECT *, len(list_filter([x * 0.1::double FOR x IN range(1, 10)], lambda e: e <= p)) AS bin FROM p),
g AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin)
SELECT round((SELECT avg((p - y) ** 2) FROM p), 6) AS brier, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS max_error FROM g""")
def _(d, la):
    p = predictions(d, la)
    bins = A.reliability(p).agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("max_error"))
    return p.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier")).crossJoin(bins)  # one row each


ROC = f"SELECT t AS threshold, count_if(p >= t AND y = 1) AS tp, count_if(p >= t AND y = 0) AS fp, round(tp / sum(y), 6) AS tpr, round(fp / sum(1 - y), 6) AS fpr FROM ({PRED}), (SELECT unnest([k / 100 FOR k IN range(101)]) AS t) GROUP BY t"


@query("roc", "documents", "labels", sql=ROC)
def _(d, la):
    return A.roc(predictions(d, la)).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


@query("youden", "documents", "labels", sql=f"SELECT threshold, round(tpr - fpr, 6) AS j FROM ({ROC}) ORDER BY round(tpr - fpr, 6) DESC, threshold LIMIT 1")
def _(d, la):
    j = F.round(F.round("tpr", 6) - F.round("fpr", 6), 6)
    return A.roc(predictions(d, la)).select("threshold", j.alias("j")).orderBy(F.desc("j"), "threshold").limit(1)


@query("trace_stats", "events", sql="SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS sd, round(avg((value < 40)::int), 6) AS low FROM events GROUP BY event_type")
def _(e):
    told = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg((F.col("value") < 40).cast("int")), 6).alias("low"))
    return told.join(A.medians(e, ["event_type"], "value").withColumn("median", F.round("median", 6)), "event_type")


@query("stability", "events", sql="SELECT user_id, round(max(n) / sum(n), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def _(e):
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("zscore_mask", "events", sql="SELECT event_id FROM events QUALIFY abs(value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-12) < 1.5")
def _(e):
    s = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))  # combined before the shuffle, unlike a window
    return e.join(s, "user_id").where(F.abs(F.col("value") - F.col("m")) / (F.col("s") + 1e-12) < 1.5).select("event_id")


@query("win_tie_lose", "orders", sql="SELECT count_if(a > b) AS win, count_if(a = b) AS tie, count_if(a < b) AS lose FROM (SELECT count_if(o_orderpriority = '1-URGENT') AS a, count_if(o_orderpriority = '5-LOW') AS b FROM orders GROUP BY o_custkey)")
def _(o):
    n = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("b"))
    return n.agg(F.count_if(F.expr("a > b")).alias("win"), F.count_if(F.expr("a = b")).alias("tie"), F.count_if(F.expr("a < b")).alias("lose"))


WORDS = ("the", "und", "le", "que", "tion")


@query("keyword_rank", "documents", sql="SELECT doc_id, " + " + ".join(f"contains(text, '{w}')::int" for w in WORDS) + " AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 20")
def _(d):
    return d.select("doc_id", X.keyword_hits(F.col("text"), WORDS).alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(20)


@query("tfidf_words", "documents", sql="""
WITH w AS (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '[ \\t\\n\\r]+') IF length(x) >= 2]) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT t, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n WHERE t IN ('the', 'and', 'of') GROUP BY t, n)
SELECT doc_id, round(sum(c * idf), 6) AS score FROM tf JOIN idf USING (t) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def _(d):
    asked = ("the", "and", "of")
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda t: t.isin(*asked))
    tf = d.select("doc_id", F.explode(words).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("c"))
    idf = tf.groupBy("t").agg(F.count("*").alias("df")).crossJoin(d.agg(F.count("*").alias("n"))).select("t", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return tf.join(F.broadcast(idf), "t").groupBy("doc_id").agg(F.round(F.sum(F.col("c") * F.col("idf")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)  # idf: a row for each asked word


@query("cosine_topk", "embeddings", sql="""
SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) DESC, b.vec_id) <= 10""")
def _(v):
    return J.cosine_search(v, F.col("vec_id") % 20 == 0, 10)


@query("gravity_topk", "events", sql="SELECT event_id, round(1e5 * value / ln(greatest(epoch(TIMESTAMP '2024-01-31') - epoch(ts), 1) + 2.718281828459045) ** 2, 3) AS score FROM events ORDER BY score DESC, event_id LIMIT 10")
def _(e):
    age = (F.unix_micros(now().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return e.select("event_id", F.round(M.gravity(F.col("value"), age), 3).alias("score")).orderBy(F.desc("score"), "event_id").limit(10)


@query("resonance_rank", "events", sql="SELECT event_id, round(least(100, 1 / greatest(1e-9, sqrt((4 - (value / 100) ** 2) ** 2 + (0.1 * value / 100) ** 2))), 6) AS score FROM events")
def _(e):
    return e.select("event_id", F.round(M.resonance(F.lit(2.0), F.col("value") / 100, F.lit(0.1)), 6).alias("score"))


@query("step_range_join", "lineitem", sql="SELECT a.l_orderkey, a.l_linenumber AS step_a, b.l_linenumber AS step_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'")
def _(li):
    a = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("step_a"))
    b = li.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").alias("step_b"))
    return a.join(b, "l_orderkey").where("step_b > step_a")


@query("cooccur_join", "lineitem", sql="SELECT a.l_partkey AS part_a, b.l_partkey AS part_b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) > 1")
def _(li):
    parts = parts_of(li)
    rows = li.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
    a, b = rows.withColumnRenamed("l_partkey", "part_a"), rows.withColumnRenamed("l_partkey", "part_b")
    pairs = a.join(b.hint("merge"), "l_orderkey").where("part_a < part_b").select("part_a", "part_b")
    return pairs.repartition(parts, "part_a", "part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("n")).where("n > 1")


@query("anti_orphans", "customer", "orders", sql="SELECT c_custkey AS node FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) ON c_custkey = o_custkey")
def _(c, o):
    linked = o.where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return G.orphans(c.select(F.col("c_custkey").alias("node")), linked)


@query("balance_diff", "orders", sql="""WITH a AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders WHERE o_orderdate < '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders WHERE o_orderdate >= '1995-01-01' GROUP BY 1)
SELECT o_custkey, round(coalesce(y, 0) - coalesce(x, 0), 2) AS diff FROM a FULL JOIN b USING (o_custkey) WHERE round(coalesce(y, 0) - coalesce(x, 0), 2) <> 0""")
def _(o):
    later = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")
    # one pass: a full join of two aggregates of one table is a signed sum
    return o.groupBy("o_custkey").agg(F.round(F.sum(F.when(later, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))), 2).alias("diff")).where("diff <> 0")


SIGNED = "CASE WHEN event_type = 'purchase' THEN -value ELSE value END"


@query("ledger_running", "events", sql=f"SELECT event_id, round(sum({SIGNED}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance, round(coalesce(sum({SIGNED}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS old_balance FROM events")
def _(e):
    out = A.running_balance(e.withColumn("delta", F.expr(SIGNED)), ["user_id"], ["ts", "event_id"], "delta")
    return out.select("event_id", F.round("balance", 4).alias("balance"), F.round("old_balance", 4).alias("old_balance"))


@query("ledger_revert", "events", sql=f"SELECT user_id, round(sum({SIGNED}), 4) AS balance FROM events WHERE ts <= '2024-01-15' GROUP BY user_id")
def _(e):
    return e.where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.round(F.sum(F.expr(SIGNED)), 4).alias("balance"))


@query("ema_by_user", "events", sql="SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.3 * x + 0.7 * s), 6) AS ema FROM events GROUP BY user_id")
def _(e):
    return A.ema(e, "user_id", ["ts", "event_id"], "value").withColumn("ema", F.round("ema", 6))


@query("fit_linear_by_group", "lineitem", sql="SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS k0, round(regr_slope(l_extendedprice, l_quantity), 4) AS k, round(regr_intercept(l_extendedprice, l_quantity), 2) AS b FROM lineitem GROUP BY l_returnflag")
def _(li):
    f = A.fit_line(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", "n", F.round("k0", 4).alias("k0"), F.round("k", 4).alias("k"), F.round("b", 2).alias("b"))


EDGES = "SELECT DISTINCT l_suppkey AS src, l_suppkey % 17 + l_partkey % 5 AS dst FROM lineitem"


def edges_of(li: DataFrame) -> DataFrame:
    return li.select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") % 17 + F.col("l_partkey") % 5).alias("dst")).distinct()


@query("graph_bfs", "lineitem", sql=f"""WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT 3::bigint, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 1.0 ELSE round(0.4::double / min(depth), 6) END AS score FROM r GROUP BY node""")
def _(li):
    e = edges_of(li)
    return G.bfs(e, e.sparkSession.range(3, 4).select(F.col("id").alias("node")), 3).withColumn("score", F.round("score", 6))


@query("graph_paths", "lineitem", sql=f"WITH e AS ({EDGES}) SELECT count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst AND a.src <> a.dst AND b.src <> b.dst")
def _(li):
    return G.paths(edges_of(li).where("src <> dst"), 2).agg(F.count("*").alias("n"))


@query("sinks_sources", "lineitem", sql=f"WITH e AS ({EDGES}) SELECT DISTINCT src AS node, 'root' AS kind FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT DISTINCT dst, 'leaf' FROM e WHERE dst NOT IN (SELECT src FROM e)")
def _(li):
    e = edges_of(li)
    return G.roots(e).withColumn("kind", F.lit("root")).unionByName(G.leaves(e).withColumn("kind", F.lit("leaf")))


@query("degree_hubs", "lineitem", sql="SELECT l_suppkey AS node, count(*) AS in_degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(li):
    return G.hubs(li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), 5)


@query("html_strip_stats", "pages", sql="SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS n_chars, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def _(p):
    return p.select("page_id", F.length(X.strip_tags(F.col("html"))).alias("n_chars"), F.regexp_count("html", F.lit("<a ")).alias("links"))


@query("text_norm", "conversations", sql="SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM conversations")
def _(c):
    return c.select("conv_id", "turn", X.squeeze(F.col("text")).alias("text"))


@query("category_rules", "events", sql="SELECT CASE WHEN contains(event_type, 'click') THEN 'touch' WHEN contains(event_type, 'purch') THEN 'money' WHEN contains(event_type, 'err') THEN 'fault' ELSE event_type END AS category, count(*) AS n FROM events GROUP BY 1")
def _(e):
    return e.groupBy(X.first_rule(F.col("event_type"), CATEGORIES, F.col("event_type")).alias("category")).agg(F.count("*").alias("n"))


@query("decision_matrix", "supplier", sql="SELECT s_suppkey, s_acctbal, s_nationkey, round(0.75::double * (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) + 0.25::double * (s_nationkey - min(s_nationkey) OVER ()) / (max(s_nationkey) OVER () - min(s_nationkey) OVER ()), 4) AS score FROM supplier")
def _(s):
    return A.decision_matrix(s.select("s_suppkey", "s_acctbal", "s_nationkey"), {"s_acctbal": 3.0, "s_nationkey": 1.0})


@query("risk_register", "part", sql="SELECT p_partkey, CASE WHEN p >= .7 AND i >= .7 THEN 'High' WHEN round(p * i, 4) >= .25 THEN 'Medium' ELSE 'Low' END AS band FROM (SELECT p_partkey, p_size / 50.0::double AS p, (p_partkey % 100) / 100.0::double AS i FROM part)")
def _(p):
    return p.select("p_partkey", A.risk_band(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0).alias("band"))


@query("expected_value", "part", sql="SELECT p_brand, round(sum(p_size / 50.0::double * p_retailprice), 2) AS expected, max(p_retailprice) AS best FROM part GROUP BY p_brand")
def _(p):
    return p.groupBy("p_brand").agg(F.round(F.sum(F.col("p_size") / 50.0 * F.col("p_retailprice")), 2).alias("expected"), F.max("p_retailprice").alias("best"))


@query("contradictions_lag", "events", sql="SELECT event_id FROM events QUALIFY event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def _(e):
    return A.previous(e, ["user_id"], ["ts", "event_id"], "event_type", "before").where("event_type <> before").select("event_id")


@query("keyword_hist", "conversations", sql="SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS word FROM conversations) WHERE length(word) >= 3 GROUP BY word")
def _(c):
    return c.select(F.explode(F.split(F.lower("text"), r"[ \t\n\r]+")).alias("word")).where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))


@query("repeat_failures", "events", sql="SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 2")
def _(e):
    return e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2")


@query("conversation_turns", "conversations", sql="SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS asked, sum(length(text))::bigint AS n_chars FROM conversations GROUP BY conv_id")
def _(c):
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("n_chars"))


@query("swap_quote", "part", sql="SELECT p_partkey, (((p_size::hugeint * 9970) * 3000000) // (1000000::hugeint * 10000 + p_size::hugeint * 9970))::bigint AS quoted FROM part")
def _(p):
    return p.select("p_partkey", M.swap_quote(F.col("p_size"), F.lit(1000000), F.lit(3000000)).alias("quoted"))


@query("bit_ops", "part", sql="SELECT p_partkey, xor(p_size, (p_partkey % 64)::int) AS x, (p_size & (p_partkey % 64)::int) AS a, (p_size | (p_partkey % 64)::int) AS o FROM part")
def _(p):
    other = (F.col("p_partkey") % 64).cast("int")
    return p.select("p_partkey", F.col("p_size").bitwiseXOR(other).alias("x"), F.col("p_size").bitwiseAND(other).alias("a"), F.col("p_size").bitwiseOR(other).alias("o"))
