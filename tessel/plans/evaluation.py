"""Queries of the catalogue on experiments, benches, gates, sorts, unions and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from .catalog import query

RUN = "user_id % 7 AS run, event_type AS lang, event_id % 11 = 0 AS is_summary, event_id % 3 = 0 AS correct, CASE WHEN event_id % 5 <> 0 THEN value END AS similarity, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS winner"
RUN_SPARK = [x.strip() for x in RUN.replace(" END AS", " END AS").split(", ")]


@query("experiments", "events", sql=f"""
WITH r AS (SELECT {RUN}, event_id, value FROM events),
q AS (SELECT run, lang, count(*) AS total, count_if(correct) AS correct, round(coalesce(avg(similarity), 0), 6) AS similarity, count_if(winner = 'a') AS wins_a, count_if(winner = 'b') AS wins_b FROM r WHERE NOT is_summary GROUP BY ALL),
s AS (SELECT run, lang, arg_max((value::bigint) + 10, event_id) AS s_total, arg_max(value::bigint, event_id) AS s_correct FROM r WHERE is_summary GROUP BY ALL)
SELECT run, lang, coalesce(s_total, total) AS total, coalesce(s_correct, correct) AS correct, round(coalesce(coalesce(s_correct, correct) / nullif(coalesce(s_total, total), 0), 0), 6) AS accuracy,
coalesce(similarity, 0) AS similarity, coalesce(wins_a, 0) AS wins_a, coalesce(wins_b, 0) AS wins_b FROM q FULL JOIN s USING (run, lang)""")
def _(e):
    """Totals by run and language; the last summary row of a run overrides what its questions give."""
    r = e.selectExpr(*RUN_SPARK, "event_id", "value")
    q = r.where("not is_summary").groupBy("run", "lang").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("n_correct"), F.round(F.coalesce(F.avg("similarity"), F.lit(0)), 6).alias("similarity"),
        F.count_if(F.col("winner") == "a").alias("wins_a"), F.count_if(F.col("winner") == "b").alias("wins_b"),
    )
    whole = F.round("value").cast("long")
    s = r.where("is_summary").groupBy("run", "lang").agg(F.max_by(whole + 10, "event_id").alias("s_total"), F.max_by(whole, "event_id").alias("s_correct"))
    total, correct = F.coalesce("s_total", "total"), F.coalesce("s_correct", "n_correct")
    return q.join(s, ["run", "lang"], "full").select(
        "run", "lang", total.alias("total"), correct.alias("correct"), F.round(F.coalesce(F.try_divide(correct, total), F.lit(0)), 6).alias("accuracy"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("similarity", "wins_a", "wins_b")],
    )


@query("bench_run", "events", sql="""
WITH t AS (SELECT user_id AS task, bool_and(event_id % 9 <> 0) AS ok, avg(value) AS score, avg(value * 2) AS latency, any_value(user_id % 3) AS tag FROM events GROUP BY user_id)
SELECT tag, count(*) AS tasks, round(count_if(ok) / count(*), 6) AS accuracy, round(avg(score), 6) AS score, round(avg(latency), 6) AS latency FROM t GROUP BY tag""")
def _(e):
    """A task is right if all its repetitions are; averages by criterion."""
    task = e.groupBy(F.col("user_id").alias("task")).agg(F.every(F.col("event_id") % 9 != 0).alias("ok"), F.avg("value").alias("score"), F.avg(F.col("value") * 2).alias("latency"))
    return task.groupBy((F.col("task") % 3).alias("tag")).agg(
        F.count("*").alias("tasks"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("latency"), 6).alias("latency")
    )


@query("gate", "events", sql="""
WITH s AS (SELECT event_type, avg((event_id % 3 = 0)::int) AS before, avg((event_id % 2 = 0)::int) AS after FROM events GROUP BY event_type)
SELECT round(avg(before), 6) AS before, round(avg(after), 6) AS after, avg(after) > avg(before) AND bool_and(after >= before) AS accepted FROM s""")
def _(e):
    """Accepted if the mean over suites is better and no suite is worse."""
    share = lambda of: F.avg((F.col("event_id") % of == 0).cast("int"))
    s = e.groupBy("event_type").agg(share(3).alias("before"), share(2).alias("after"))
    return s.agg(
        F.round(F.avg("before"), 6).alias("b"), F.round(F.avg("after"), 6).alias("a"), ((F.avg("after") > F.avg("before")) & F.every(F.col("after") >= F.col("before"))).alias("accepted")
    ).select(F.col("b").alias("before"), F.col("a").alias("after"), "accepted")


@query("answers_references", "documents", "labels", sql="SELECT l.doc_id, coalesce(d.text, '') AS answer, l.quality FROM labels l LEFT JOIN documents d ON d.doc_id::varchar = l.doc_id::varchar")
def _(d, la):
    """Every reference with its answer by id as text; a missing answer is empty."""
    answers = d.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("answer"))
    return la.join(answers, F.col("doc_id").cast("string") == F.col("key"), "left").select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"), "quality")


@query("calibration_bins", "events", sql="""
WITH b AS (SELECT least(9, floor(value / 50))::int AS bin, count(*) AS n, avg(value / 500) AS confidence, avg((event_id % 2 = 0)::int) AS accuracy FROM events GROUP BY 1)
SELECT bin, n, CASE WHEN confidence > accuracy THEN 'over' ELSE 'under' END AS kind, round(abs(confidence - accuracy), 6) AS gap FROM b WHERE n >= 3 AND abs(confidence - accuracy) > 0.15""")
def _(e):
    """Bins of at least three predictions whose confidence is off by more than 0.15."""
    bins = e.groupBy(F.least(F.lit(9), F.floor(F.col("value") / 50)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("value") / 500).alias("confidence"), F.avg((F.col("event_id") % 2 == 0).cast("int")).alias("accuracy"))
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return bins.where((F.col("n") >= 3) & (gap > 0.15)).select("bin", "n", F.when(F.col("confidence") > F.col("accuracy"), "over").otherwise("under").alias("kind"), F.round(gap, 6).alias("gap"))


@query("finding_filter", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND coalesce(CASE WHEN l_partkey % 5 <> 0 THEN l_discount * 10 END, 1.0) >= 0.6")
def _(li):
    """Findings of chosen severities with enough confidence; a missing one counts as 1."""
    confidence = F.coalesce(F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount") * 10), F.lit(1.0))
    return li.where(F.col("l_returnflag").isin("A", "R") & (confidence >= 0.6)).select("l_orderkey", "l_linenumber")


SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 4 ELSE 3 END"


@query("severity_sort", "orders", sql=f"SELECT o_orderkey, row_number() OVER (ORDER BY {SEVERITY}, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def _(o):
    """The first hundred findings by severity, confidence, then order of arrival."""
    first = o.select("o_orderkey", F.expr(SEVERITY).alias("s"), "o_totalprice").orderBy("s", F.desc("o_totalprice"), "o_orderkey").limit(100)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy("s", F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))  # of 100 rows


@query("target_sort", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_tax DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def _(li):
    return li.where("l_returnflag = 'R'").orderBy(F.desc("l_tax"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("both_memories", "events", sql="SELECT event_id, count(*) AS copies FROM (SELECT event_id FROM events WHERE ts >= '2024-01-15' UNION ALL SELECT event_id FROM events WHERE event_id % 97 = 0) GROUP BY event_id")
def _(e):
    """Short and long term memory together; what is in both is there twice."""
    short = e.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")
    return short.unionAll(e.where("event_id % 97 = 0").select("event_id")).groupBy("event_id").agg(F.count("*").alias("copies"))


@query("merge_nodes", "nation", "supplier", sql="""SELECT node, arg_max(label, layer) AS label, max(balance) AS balance FROM (
SELECT n_nationkey AS node, 0 AS layer, n_name AS label, NULL AS balance FROM nation UNION ALL
SELECT s_nationkey, 1 + s_suppkey, s_name, s_acctbal FROM supplier) GROUP BY node""")
def _(n, s):
    """Nodes of several graphs; a later graph's attributes override."""
    one = n.select(F.col("n_nationkey").alias("node"), F.lit(0).cast("long").alias("layer"), F.col("n_name").alias("label"), F.lit(None).cast("double").alias("balance"))
    two = s.select(F.col("s_nationkey").alias("node"), (F.col("s_suppkey") + 1).alias("layer"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("balance"))
    return one.unionAll(two).groupBy("node").agg(F.max_by("label", "layer").alias("label"), F.max("balance").alias("balance"))


@query("net_balance", "lineitem", sql="SELECT l_suppkey, l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END), 6) AS change, count(*) AS n FROM lineitem GROUP BY ALL")
def _(li):
    """What an account's balance of a token changed by."""
    return li.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))), 6).alias("change"), F.count("*").alias("n"))


@query("consensus", "events", sql="SELECT user_id, arg_min(event_type, (-n, seen)) AS answer FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) GROUP BY user_id")
def _(e):
    """The most frequent answer, on ties the one first seen."""
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "seen")).alias("answer"))


@query("fitness", "events", sql="SELECT event_id, round(coalesce(-0.6 * CASE WHEN event_id % 2 = 0 THEN value END, 0) + coalesce(-0.2 * CASE WHEN event_id % 3 = 0 THEN value END, 0) + coalesce(-0.1 * (value / 500), 0) + coalesce(0.3 * CASE WHEN event_id % 5 = 0 THEN value END, 0), 6) AS fitness FROM events")
def _(e):
    """A weighted sum of metrics; missing ones are skipped."""
    only = lambda of: F.when(F.col("event_id") % of == 0, F.col("value"))
    terms = [F.coalesce(w * x, F.lit(0.0)) for w, x in ((F.lit(-0.6), only(2)), (F.lit(-0.2), only(3)), (F.lit(-0.1), F.col("value") / 500), (F.lit(0.3), only(5)))]
    return e.select("event_id", F.round(terms[0] + terms[1] + terms[2] + terms[3], 6).alias("fitness"))


@query("running_mean", "orders", sql="SELECT o_orderkey, count(*) OVER w AS calls, round(avg(o_totalprice) OVER w, 4) AS mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(o):
    return A.running_mean(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "calls", F.round("mean", 4).alias("mean"))


@query("salience", "events", sql="SELECT event_id, round(0.5 * (value / 500) + 0.3 * (event_id % 10) / 10.0 + 0.2 / (1 + (epoch(TIMESTAMP '2024-01-31') - epoch(ts))), 9) AS salience FROM events")
def _(e):
    """Strength, trust and recency of a signal; recency is 1 / (1 + age in seconds)."""
    age = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.round(0.5 * (F.col("value") / 500) + 0.3 * (F.col("event_id") % 10) / 10.0 + 0.2 / (1 + age), 9).alias("salience"))


@query("inverted_index", "conversations", sql="""SELECT token, count(*) AS turns, min((conv_id, turn))[1] AS first_conv, min((conv_id, turn))[2] AS first_turn FROM (
SELECT DISTINCT conv_id, turn, unnest([x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+') IF x <> '']) AS token FROM conversations) GROUP BY token""")
def _(c):
    """Tokens with how many turns hold them; the postings stay rows, so no list is unbounded."""
    token = F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \\t\\n\\r]+"), lambda x: x != "")))
    found = c.select(F.struct("conv_id", "turn").alias("place"), token.alias("token")).distinct().groupBy("token").agg(F.count("*").alias("turns"), F.min("place").alias("first"))
    return found.select("token", "turns", F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn"))


@query("gates", "events", sql="SELECT event_id, (a + b + c) % 2 = 1 AS xor_, NOT (a + b + c = 3) AS nand_, a + b + c = 0 AS nor_, (a + b + c) % 2 = 0 AS xnor_, 0.5 * a + 0.3 * b + 0.4 * c >= 0.6 AS weighted FROM (SELECT event_id, (event_id % 2)::int AS a, (event_id // 2 % 2)::int AS b, (event_id // 4 % 2)::int AS c FROM events)")
def _(e):
    """Gates of three inputs: the bits of the id."""
    a, b, c = (F.expr(f"cast((event_id div {1 << k}) % 2 as int)") for k in range(3))
    n = a + b + c
    return e.select("event_id", (n % 2 == 1).alias("xor_"), (n != 3).alias("nand_"), (n == 0).alias("nor_"), (n % 2 == 0).alias("xnor_"), (0.5 * a + 0.3 * b + 0.4 * c >= 0.6).alias("weighted"))


@query("scenarios", "region", sql="SELECT a.r_name AS driver_a, b.r_name AS driver_b FROM region a CROSS JOIN region b WHERE a.r_regionkey < 2 AND b.r_regionkey >= 3")
def _(r):
    """A grid of two drivers with two states each."""
    a, b = r.where("r_regionkey < 2").select(F.col("r_name").alias("driver_a")).limit(2), r.where("r_regionkey >= 3").select(F.col("r_name").alias("driver_b")).limit(2)
    return a.join(F.broadcast(b))  # two rows by two


@query("accrual", "customer", sql="SELECT c_custkey, round(c_acctbal * (1 + 0.0001 * (c_custkey % 100)), 4) AS debt, round(greatest(0, c_acctbal * 0.05 - 10), 4) AS profit FROM customer")
def _(c):
    """Simple interest by block, and the bonus of a liquidation less its cost."""
    return c.select("c_custkey", F.round(F.col("c_acctbal") * (1 + 0.0001 * (F.col("c_custkey") % 100)), 4).alias("debt"), F.round(F.greatest(F.lit(0.0), F.col("c_acctbal") * 0.05 - 10), 4).alias("profit"))


@query("priority", "part", sql="SELECT p_partkey, round(least(1.0, (0.4 * (p_size % 2) + 0.3 * (p_size % 3 = 0)::int + 0.5 * (p_size > 25)::int) * CASE WHEN p_partkey % 4 = 0 THEN 0.3 ELSE 1.0 END), 6) AS priority FROM part")
def _(p):
    """Weighted signs of a target, less for restricted ones, at most one."""
    signs = 0.4 * (F.col("p_size") % 2) + 0.3 * (F.col("p_size") % 3 == 0).cast("int") + 0.5 * (F.col("p_size") > 25).cast("int")
    return p.select("p_partkey", F.round(F.least(F.lit(1.0), signs * F.when(F.col("p_partkey") % 4 == 0, 0.3).otherwise(1.0)), 6).alias("priority"))
