"""Summaries, first matches and graphs of project records as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


FOLDED = 64  # assignments, and seeds, of a function that are folded in one row


def first_contained(text: Column, rules: Sequence[tuple[str, object]], default: object) -> Column:
    """The value of the first (key, value) whose key the lower-cased text contains."""
    out = F.lit(default)
    for key, value in reversed(rules):
        out = F.when(F.contains(F.lower(text), F.lit(key)), F.lit(value)).otherwise(out)
    return out


def expected_found(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, found, detected): which expected substrings (keys, expected) some category (keys, category) contains.

    Keys without an expectation are left out; without categories nothing is found.
    """
    wanted = expected.select(*keys, F.lower("expected").alias("expected")).where("expected is not null").distinct()
    seen = found.select(*keys, F.lower("category").alias("category")).distinct()
    hit = wanted.join(seen, keys).where(F.contains("category", F.col("expected"))).select(*keys, "expected").distinct().withColumn("hit", F.lit(1))
    told = wanted.join(hit, [*keys, "expected"], "left").groupBy(*keys)
    return told.agg(F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("hit") > 0).alias("detected"))


def repeated_patterns(findings: DataFrame, kind: str, place: str) -> DataFrame:
    """(kind, occurrences, places, systemic) of kinds that occur more than once; systemic if in more than one place."""
    told = findings.groupBy(kind).agg(F.count("*").alias("occurrences"), F.count_distinct(place).alias("places"))
    return told.where("occurrences > 1").withColumn("systemic", F.col("places") > 1)


def largest(rows: DataFrame, by: Sequence[str], key: str, k: int) -> DataFrame:
    """(list, key, amount): the ``k`` rows of the largest amount by each column, least key first of equals, amounts above zero."""
    out = None
    for c in by:
        top = rows.orderBy(F.desc(c), key).limit(k).where(F.col(c) > 0).select(F.lit(c).alias("list"), F.col(key), F.col(c).cast("long").alias("amount"))
        out = top if out is None else out.unionByName(top)
    return out


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) with both ends among ``nodes`` (node); repeated edges stay."""
    chosen = nodes.select("node").distinct()
    inner = edges.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi")
    return inner.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def with_placeholders(nodes: DataFrame, edges: DataFrame, kinds: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """(node, kind, label, placeholder): ``nodes`` (node, kind, label) and those that only edges name.

    The latter have the kind of the first prefix that fits and what follows the first colon as label.
    """
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).where("node is not null").distinct()
    missing = ends.join(nodes.select("node"), "node", "left_anti")
    kind = F.lit(default)
    for prefix, name in reversed(kinds):
        kind = F.when(F.startswith("node", F.lit(prefix)), name).otherwise(kind)
    label = F.when(F.contains("node", F.lit(":")), F.expr("substr(node, instr(node, ':') + 1)")).otherwise(F.col("node"))
    added = missing.select("node", kind.alias("kind"), label.alias("label"), F.lit(True).alias("placeholder"))
    return nodes.select("node", "kind", "label", F.lit(False).alias("placeholder")).unionByName(added)


def tainted(assignments: DataFrame, seeds: DataFrame) -> DataFrame:
    """(function, name, source, since): what each name may hold of each source, from which step on.

    One pass in step order: an assignment (function, step, target, used) hands on what the
    used name holds before it; ``seeds`` (function, name, source) hold from the start (step
    null becomes -1). That is the earliest step at which a chain of rising steps arrives.
    Functions of FOLDED assignments and seeds at most are folded, each in a row of its own;
    for longer ones rounds join what has become earlier with the assignments behind it, so
    that none is folded in one task. Nothing takes a source away again.
    """
    step = assignments.select("function", "step", "target", "used").where("target is not null and used is not null and step is not null")
    seeds = seeds.select("function", "name", "source", F.lit(-1).cast("long").alias("since")).where("name is not null").distinct()
    many = lambda rows: rows.groupBy("function").count().where(F.col("count") > FOLDED).select("function")
    long = materialize(many(step).unionByName(many(seeds)).where("function is not null").distinct(), "taint-long")
    if long.isEmpty():
        return _folded(step, seeds)
    part = lambda rows, how: rows.join(long, "function", how)
    return _folded(part(step, "left_anti"), part(seeds, "left_anti")).unionByName(_in_rounds(part(step, "left_semi"), part(seeds, "left_semi")))


def _folded(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """``tainted`` for functions of few assignments and seeds."""
    steps = step.groupBy("function").agg(F.sort_array(F.collect_list(F.struct("step", "target", "used"))).alias("steps"))
    held = seeds.groupBy("function").agg(F.collect_list(F.struct("name", "source", "since")).alias("held"))
    kind = held.schema["held"].dataType.simpleString()

    def then(state: Column, s: Column) -> Column:
        handed = F.filter(state, lambda x: (x["name"] == s["used"]) & (x["since"] < s["step"]))
        new = F.filter(handed, lambda x: ~F.exists(state, lambda y: (y["name"] == s["target"]) & y["source"].eqNullSafe(x["source"])))
        return F.concat(state, F.transform(new, lambda x: F.struct(s["target"].alias("name"), x["source"].alias("source"), s["step"].cast("long").alias("since"))).cast(kind))

    both = held.join(steps, "function", "left")
    out = F.when(F.col("steps").isNull(), F.col("held")).otherwise(F.aggregate("steps", F.col("held").cast(kind), then))
    return both.select("function", F.inline(out))


def _in_rounds(step: DataFrame, seeds: DataFrame) -> DataFrame:
    step = materialize(step.distinct(), "taint-steps")
    known = front = materialize(seeds, "taint")
    while not front.isEmpty():
        reached = front.join(step.withColumnRenamed("used", "name"), ["function", "name"]).where(F.col("step") > F.col("since"))
        reached = reached.groupBy("function", F.col("target").alias("name"), "source").agg(F.min("step").cast("long").alias("since"))
        before = known.withColumnRenamed("since", "before")
        front = materialize(reached.join(before, ["function", "name", "source"], "left").where("before is null or since < before").drop("before"), "taint")
        known = materialize(known.unionByName(front).groupBy("function", "name", "source").agg(F.min("since").alias("since")), "taint")
    return known


def fit_saturation(rows: DataFrame, keys: list[str], t: str, y: str, grid: Sequence[float] = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """(keys, a, b, rmse, n, confidence) of y = a + b * (1 - exp(-t / tau)), tau the best of ``grid`` times the largest t.

    One pass finds each key's largest t and means, a second sums all taus at once about the
    means; of equal errors the first of the grid wins. Rows with a null are left out; keys of
    no spread have no fit.
    """
    known = rows.select(*keys, F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")).dropna(subset=["t", "y"])
    tops = known.groupBy(*keys).agg(F.max("t").alias("top"), F.avg("y").alias("mean_y"))
    taus = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(float(g)).alias("share")) for i, g in enumerate(grid)]))
    x = 1 - F.exp(-F.col("t") / (F.col("g.share") * F.col("top")))
    spread = known.join(tops.where("top > 0"), keys).select(*keys, "t", (F.col("y") - F.col("mean_y")).alias("dy"), "mean_y", "top", taus.alias("g")).withColumn("x", x)
    s = spread.groupBy(*keys, "g").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.first("mean_y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "dy").alias("cxy"), F.var_pop("dy").alias("vy"))
    fit = s.where("vx > 0").withColumns({"b": F.col("cxy") / F.col("vx"), "rmse": F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.col("cxy") * F.col("cxy") / F.col("vx")))})
    fit = fit.withColumn("a", F.col("my") - F.col("b") * F.col("mx"))
    best = fit.groupBy(*keys).agg(F.min_by(F.struct("a", "b", "rmse", "n"), F.struct("rmse", "g.place")).alias("f")).select(*keys, "f.*")
    return best.withColumn("confidence", fit_confidence(F.col("rmse"), F.col("n")))


def fit_confidence(rmse: Column, n: Column) -> Column:
    return 1 / (1 + rmse) * (1 - F.exp(-n / 20))
