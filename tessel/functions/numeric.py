"""Scalar scores and element-wise functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def risk(heuristic: Column, formal: Column, prior: Column) -> Column:
    """Logistic risk; fixed weights 2.5, 4.0, 1.5 and bias -1.2."""
    return sigmoid(2.5 * heuristic + 4.0 * formal + 1.5 * prior - 1.2)


def severity(p: Column) -> Column:
    """Fixed thresholds .85, .65 and .40."""
    return F.when(p >= 0.85, "critical").when(p >= 0.65, "high").when(p >= 0.40, "medium").otherwise("low")


def label_confidence(label: Column) -> Column:
    return F.when(F.lower(label) == "high", 0.9).when(F.lower(label) == "medium", 0.7).otherwise(0.5)


def binary_entropy(p: Column) -> Column:
    q = clamp(p, 1e-15, 1 - 1e-15)
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def gravity(mass: Column, age_s: Column, g: float = 1e5) -> Column:
    """g * mass / ln(age + e)**2, ages below a second as one."""
    return g * mass / F.pow(F.ln(F.greatest(age_s, F.lit(1.0)) + F.lit(2.718281828459045)), 2)


def resonance(w0: Column, w: Column, damping: Column) -> Column:
    d = F.sqrt(F.pow(w0 * w0 - w * w, 2) + F.pow(damping * w, 2))
    return F.least(F.lit(100.0), 1 / F.greatest(F.lit(1e-9), d))


def tunnelling(gain: Column, width: Column, scale: Column) -> Column:
    """Acceptance of a loss: 1 for a gain, else exp of a clamped exponent."""
    return F.when(gain >= 0, 1.0).otherwise(clamp(F.exp(clamp(width * gain / scale, -100.0, 0.0))))


def recency(age_h: Column) -> Column:
    """1 now, 0 after a day."""
    return F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), age_h / 24))


def huber(residual: Column, delta: float = 1.0) -> Column:
    a = F.abs(residual)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def swap_quote(amount_in: Column, reserve_in: Column, reserve_out: Column, fee_bps: int = 30) -> Column:
    """Constant-product output in whole units (arguments are non-negative integers)."""
    paid = amount_in.cast("decimal(38,0)") * (10000 - fee_bps)
    return F.floor(paid * reserve_out / (reserve_in.cast("decimal(38,0)") * 10000 + paid)).cast("long")
