"""Findings, evaluation, ledgers, fits and decisions as grouped aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import binary_entropy, clamp


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def merge_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row a bucket: first row's source, confidence +.1 a further hit (1 at most), longest
    description (first on ties), worst severity rank, sorted distinct sources."""
    return findings.groupBy(*keys).agg(
        F.min_by("source", "seq").alias("first_source"),
        F.least(F.lit(1.0), F.min_by("confidence", "seq") + 0.1 * (F.count("*") - 1)).alias("confidence"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        F.min("severity_rank").alias("severity_rank"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count("*").alias("hits"),
    )


def noisy_or(p: Column) -> Column:
    return 1 - F.product(1 - clamp(p))


def mean_entropy(p: Column) -> Column:
    return F.avg(binary_entropy(p))


def confusion(predictions: DataFrame, threshold: Column | float, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the usual ratios of (p, y) at a threshold."""
    yes = F.col("p") >= threshold
    n = predictions.groupBy(*keys).agg(
        F.count_if(yes & (F.col("y") == 1)).alias("tp"), F.count_if(yes & (F.col("y") == 0)).alias("fp"),
        F.count_if(~yes & (F.col("y") == 0)).alias("tn"), F.count_if(~yes & (F.col("y") == 1)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return n.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    })


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) for every bin; the last one is closed."""
    edge = F.array(*[F.lit(b * (1.0 / bins)) for b in range(1, bins)])
    own = F.size(F.filter(edge, lambda e: e <= F.col("p")))
    got = predictions.groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    every = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean_p", F.lit(0.0)).alias("mean_p"),
        F.coalesce("mean_y", F.lit(0.0)).alias("mean_y"), F.coalesce(F.abs(F.col("mean_p") - F.col("mean_y")), F.lit(0.0)).alias("gap"),
    )


def roc(predictions: DataFrame, steps: int = 100) -> DataFrame:
    """Confusion at 0, 1/steps, ..., 1 from one pass: counts by step, then running sums.

    Only ``steps`` + 1 groups leave the aggregation, whatever the number of predictions.
    """
    grid = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    top = F.size(F.filter(grid, lambda t: t <= F.col("p"))) - 1  # the last threshold that p reaches
    counts = predictions.groupBy(top.alias("k")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    every = predictions.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    rows = every.join(counts.where("k >= 0"), "k", "left").na.fill(0, ["pos", "neg"])
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    above = Window.orderBy(F.desc("k"))  # steps + 1 rows
    return rows.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)}).crossJoin(total).select(
        (F.col("k") / steps).alias("threshold"), "tp", "fp", ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), ratio(F.col("fp"), F.col("all_neg")).alias("fpr")
    )


def running_balance(deltas: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """Balance after each delta, and the one before it.

    Days are summed first and each day runs on from the sum of the days before it, so that a
    key with many rows is split by day. ``order`` starts with a time.
    """
    day = F.to_date(order[0])
    days = deltas.groupBy(*keys, day.alias("__day")).agg(F.sum(amount).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*keys, "__day", F.coalesce(before, F.lit(0.0)).alias("__before"))
    w = Window.partitionBy(*keys, "__day").orderBy(*order)
    here = F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = deltas.withColumn("__day", day).withColumns({"balance": here, "old_balance": earlier}).join(days, [*keys, "__day"])
    return rows.withColumns({c: F.col(c) + F.col("__before") for c in ("balance", "old_balance")}).drop("__day", "__before")


def ema(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of each key's ordered values, from its first value on.

    A step is affine, so a day folds into one sum of weighted values and a row count, and a key
    folds its days: no key's values meet in one row or task. ``order`` starts with a time.
    """
    day = F.to_date(order[0])
    w = Window.partitionBy(key, "__day").orderBy(*[F.desc(c) for c in order])
    aged = rows.withColumn("__day", day).withColumn("__age", F.row_number().over(w) - 1)
    days = aged.groupBy(key, "__day").agg(
        F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("__age")) * F.col(value)).alias("__part"), F.count("*").alias("__n"), F.min_by(value, F.struct(*order)).alias("__first"),
    )
    later = Window.partitionBy(key).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    decay = F.pow(F.lit(1 - alpha), F.col("__later"))
    start = F.pow(F.lit(1 - alpha), F.sum("__n")) * F.min_by("__first", "__day")
    return days.groupBy(key).agg((F.sum(F.col("__part") * decay) + start).alias("ema"))


def domain_profile(rows: DataFrame, keys: list[str], success: Column, score: Column) -> DataFrame:
    """Counts, success rate and mean score by key; a null success is none, null scores don't count."""
    won = F.count_if(F.coalesce(success, F.lit(False)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), won.alias("success"), F.round(won / F.count("*"), 6).alias("success_rate"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_score"))


def net_effect(rows: DataFrame, keys: list[str], order: list[str], reset: Column, amount: str) -> DataFrame:
    """Sum and number of each key's steps from its last reset on (from the first without one)."""
    last = rows.where(reset).groupBy(*keys).agg(F.max(F.struct(*order)).alias("__reset"))
    live = rows.join(last, keys, "left").where(F.col("__reset").isNull() | (F.struct(*order) >= F.col("__reset")))
    return live.groupBy(*keys).agg(F.count("*").alias("steps"), F.sum(amount).alias("net"))


def fit_line(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = kx and y = kx + b by sufficient statistics, with rmse of the second."""
    a, b = F.col(x), F.col(y)
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))
    denom = F.expr("n * sxx - sx * sx")
    k = F.when(F.abs(denom) < 1e-12, F.lit(None)).otherwise(F.expr("n * sxy - sx * sy") / denom)
    s = s.withColumn("k0", ratio(F.col("sxy"), F.col("sxx"))).withColumn("k", k).withColumn("b", F.expr("(sy - k * sx) / n"))
    sse = F.expr("syy + k * k * sxx + n * b * b - 2 * k * sxy - 2 * b * sy + 2 * k * b * sx")
    return s.withColumn("rmse", F.coalesce(F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")), F.lit(1e9))).drop("sx", "sy", "sxx", "sxy", "syy")


def decision_matrix(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max normalised criteria, four decimals."""
    total = sum(weights.values()) or 1.0
    bounds = rows.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.coalesce(ratio(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
    score = sum((part(c) * (w / total) for c, w in weights.items()), F.lit(0.0))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("score", F.round(score, 4)).select(*rows.columns, "score")  # bounds: one row


def risk_band(p: Column, i: Column, high: float = 0.7) -> Column:
    return F.when((p >= high) & (i >= high), "High").when(F.round(p * i, 4) >= 0.25, "Medium").otherwise("Low")


def factor_band(x: Column) -> Column:
    """Fixed thresholds .7, .4 and .2; what is no number counts as 0."""
    v = F.coalesce(x, F.lit(0.0))
    return F.when(v >= 0.7, "high").when(v >= 0.4, "medium").when(v >= 0.2, "low").otherwise("minor")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) of each key's values, exact; nulls don't count, and a key of nulls alone has a null median.

    A mergeable sketch bounds where the middle lies, with a rank error below a thousandth; only
    what lies within these bounds is counted by value and ranked, half a hundredth of a key.
    """
    v = F.col(value)
    bounds = rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(F.lit(0.4975), F.lit(0.5025)), F.lit(1000)).alias("__b"), F.count(value).alias("__n"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    near = rows.alias("r").join(bounds.alias("b"), same).select(*[F.col(f"r.{k}") for k in keys], F.col(f"r.{value}").alias(value), "__b", "__n")
    # all that lies below the bounds is one row
    counted = near.where(v <= F.col("__b")[1]).groupBy(*keys, "__n", F.when(v >= F.col("__b")[0], v).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("__to", upto)
    holds = lambda rank: (F.col("__to") > rank) & (F.col("__to") - F.col("__c") <= rank)
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    found = ranked.groupBy(*keys).agg(((F.max(F.when(holds(low), F.col("__v"))) + F.max(F.when(holds(high), F.col("__v")))) / 2).alias("median"))
    known = bounds.select(*keys).alias("b")
    same = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return known.join(found.alias("f"), same, "left").select(*[F.col(f"b.{k}") for k in keys], "f.median")


def running_mean(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``calls`` and ``mean``: number and mean of each key's values up to the row.

    Days are summed first, as in ``running_balance``. ``order`` starts with a time.
    """
    days = rows.groupBy(*keys, F.to_date(order[0]).alias("__day")).agg(F.sum(value).alias("__sum"), F.count("*").alias("__count"), F.count(value).alias("__valued"))
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "__day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__sum", "__count", "__valued")])
    here = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__day", F.to_date(order[0])).withColumns({"__s": F.coalesce(F.sum(value).over(here), F.lit(0)), "__c": F.count("*").over(here), "__v": F.count(value).over(here)})
    both = own.join(days, [*keys, "__day"])
    mean = (F.col("__s") + F.col("__sum_before")) / F.nullif(F.col("__v") + F.col("__valued_before"), F.lit(0))
    return both.withColumns({"calls": F.col("__c") + F.col("__count_before"), "mean": mean}).drop("__day", "__s", "__c", "__v", "__sum_before", "__count_before", "__valued_before")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the value of the row before of the same key (null for its first).

    Looks back within a day, and from a day's first row to the last one of the key's day
    before, so that a key with many rows is split by day. ``order`` starts with a time; rows
    without one are left out.
    """
    timed = rows.where(F.col(order[0]).isNotNull()).withColumn("__day", F.to_date(order[0]))
    w = Window.partitionBy(*keys, "__day").orderBy(*order)
    days = timed.groupBy(*keys, "__day").agg(F.max(F.struct(*order, F.col(value).alias("__last"))).alias("__end"))
    days = days.select(*keys, "__day", F.lag("__end.__last").over(Window.partitionBy(*keys).orderBy("__day")).alias("__before"))
    here = timed.withColumns({"__row": F.row_number().over(w), name: F.lag(value).over(w)}).join(days, [*keys, "__day"])
    return here.withColumn(name, F.when(F.col("__row") == 1, F.col("__before")).otherwise(F.col(name))).drop("__day", "__row", "__before")


def dampened(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p) of (sat, exploitable, proven, confidence): the probability that a group's findings are real.

    Without proof data (``proven`` on no row) it is .48 + half of how far the best confidence
    is over .87, within [0, 1]; else a sigmoid of the share of satisfiable and exploitable rows
    and of that confidence. A null confidence counts as .5, null flags as false.
    """
    n = F.count("*")
    best = F.max(F.coalesce("confidence", F.lit(0.5)))
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) / n
    logit = 4 * (share("sat") - 0.3) + 2 * share("exploitable") + 2 * (best - 0.9)
    proofs = F.coalesce(F.bool_or("proven"), F.lit(False))
    return findings.groupBy(*keys).agg(F.when(proofs, 1 / (1 + F.exp(-logit))).otherwise(clamp(0.48 + 0.5 * (best - 0.87))).alias("p"))
