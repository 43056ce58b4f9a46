"""Curve families fitted by group from one pass of power sums, and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_families(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, family, a, b, rmse) for y = ax, y = ax + b and y = ax^2 + bx.

    A family that the data do not determine has rmse 1e9.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = {"n": F.count("*"), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "sxy": F.sum(a * b), "syy": F.sum(b * b), "sx3": F.sum(a * a * a), "sx4": F.sum(a * a * a * a), "sx2y": F.sum(a * a * b)}
    s = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    s = s.withColumns({"d1": F.expr("sxx - sx * sx / n"), "d2": F.expr("sx4 * sxx - sx3 * sx3")})
    # the null of a division by null stands for a family that is not determined
    s = s.withColumns({
        "k0": F.expr("sxy / nullif(sxx, 0)"), "k1": F.expr("(sxy - sx * sy / n) / if(abs(d1) < 1e-12, null, d1)"),
        "qa": F.expr("(sx2y * sxx - sxy * sx3) / if(abs(d2) < 1e-12, null, d2)"), "qb": F.expr("(sx4 * sxy - sx3 * sx2y) / if(abs(d2) < 1e-12, null, d2)"),
    })
    families = {
        "ax": ("k0", "cast(0 as double)", "syy - k0 * sxy"),
        "ax+b": ("k1", "(sy - k1 * sx) / n", "syy - sy * sy / n - k1 * (sxy - sx * sy / n)"),
        "ax2+bx": ("qa", "qb", "syy - qa * sx2y - qb * sxy"),
    }
    one = [F.struct(F.lit(f).alias("family"), F.expr(p).alias("a"), F.expr(q).alias("b"), F.coalesce(F.expr(f"sqrt(if({e} < 0, 0, {e}) / n)"), F.lit(1e9)).alias("rmse")) for f, (p, q, e) in families.items()]
    return s.select(*keys, F.explode(F.array(*one)).alias("f")).select(*keys, "f.*")


def rank_fits(fits: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """``place`` of each family by rounded rmse, then name (a few rows a key)."""
    w = Window.partitionBy(*keys).orderBy("rmse", "family")
    return fits.withColumn("rmse", F.round("rmse", digits)).withColumn("place", F.row_number().over(w).cast("long"))


def fit_power(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = a * x^b by least squares of logarithms, over the rows where both are positive."""
    lx, ly = F.ln(F.col(x)), F.ln(F.col(y))
    s = rows.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys)
    return s.agg(F.exp(F.regr_intercept(ly, lx)).alias("a"), F.regr_slope(ly, lx).alias("b"), F.count("*").alias("n"))
