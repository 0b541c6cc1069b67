"""How points become scores, as SQL expressions that Spark and DuckDB read alike."""

from __future__ import annotations


def severity(points: str) -> str:
    return f"CASE WHEN {points} >= 15 THEN 'high' WHEN {points} >= 7 THEN 'medium' ELSE 'low' END"


def scale(value: str, threshold: str, cap: float) -> str:
    """How far a value is over its threshold, at most cap; 1 for thresholds of 0 and less."""
    return f"CASE WHEN {threshold} <= 0 THEN 1.0 ELSE least(cast({cap} AS double), cast({value} AS double) / {threshold}) END"


def squash(raw: str) -> str:
    """0 to 100, steep at first; 0 for no points. The argument occurs once, as it can be a long expression."""
    return f"round(100 * (1 - exp(-greatest(cast(0.0 AS double), {raw}) / 55)), 2)"


def band(score: str, medium: float = 35, high: float = 60, critical: float = 85) -> str:
    return f"CASE WHEN {score} >= {critical} THEN 'critical' WHEN {score} >= {high} THEN 'high' WHEN {score} >= {medium} THEN 'medium' ELSE 'low' END"


def clamp(p: str, low: float = 0.02, high: float = 0.95) -> str:
    return f"greatest(cast({low} AS double), least(cast({high} AS double), {p}))"


def risk_points(p: str, baseline: str) -> str:
    """Points of a predicted probability: its lift over the clamped baseline, amplified."""
    b = clamp(baseline, 0.01, 0.9)
    lift = f"(({p} - {b}) / greatest(cast(0.05 AS double), 1 - {b}))"
    return f"greatest(cast(0.0 AS double), 30 * {lift} * (1 + 0.5 * tanh({lift})))"
