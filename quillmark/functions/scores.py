"""Score expressions: bands, odds products and weighted sums over metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the positions of static_features.
STATIC = ["cc", "cog", "max_cc", "avg_cc", "sloc", "comments", "blank", "volume", "difficulty", "effort", "bugs", "n_long", "n_complex", "max_line", "avg_line", "over_80"]


def bands(value: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """The factor of the first step that ``value`` exceeds, else ``rest``; null counts as no step."""
    out = None
    for limit, factor in steps:
        out = F.when(value > limit, factor) if out is None else out.when(value > limit, factor)
    return out.otherwise(rest)


# Odds factors of the heuristic defect probability by metric band.
ODDS = {
    "cog": [(60, 8.0), (30, 4.5), (15, 2.5), (8, 1.5)],
    "cc": [(30, 3.5), (20, 2.0), (10, 1.5), (5, 1.2)],
    "bugs": [(5.0, 3.5), (2.0, 2.0), (0.5, 1.4)],
    "n_complex": [(5, 2.5), (2, 1.8), (0, 1.3)],
    "n_long": [(5, 1.8), (2, 1.4), (0, 1.15)],
    "sloc": [(500, 1.5), (200, 1.2)],
    "over_80": [(30, 1.25), (10, 1.1)],
}
GIT_ODDS = {
    "code_churn": [(500, 1.35), (200, 1.15)],
    "n_past_bugs": [(5, 1.80), (2, 1.40), (0, 1.15)],
    "author_count": [(8, 1.20), (4, 1.10)],
    "commit_freq": [(5.0, 1.12)],
}


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def defect_probability(m: dict[str, Column]) -> Column:
    """Base odds 0.1 / 0.9 times a factor per metric; clamped to 0.02..0.95, three digits."""
    odds = F.lit(0.1 / 0.9)
    for name, steps in ODDS.items():
        odds = odds * bands(m[name], steps, 1.0)
    return F.round(clamp(odds / (1 + odds), 0.02, 0.95), 3)


def git_adjusted(p: Column, g: dict[str, Column]) -> Column:
    odds = p / (1 - p)
    for name, steps in GIT_ODDS.items():
        odds = odds * bands(g[name], steps, 1.0)
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.round(clamp(odds / (1 + odds), 0.02, 0.95), 3))


def entropy_confidence(p: Column) -> Column:
    """1 - binary entropy; 1 at the ends."""
    h = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p <= 0) | (p >= 1), 1.0).otherwise(1 - h)


def quality_score(m: dict[str, Column]) -> Column:
    """100 minus capped penalties for complexity, length and estimated bugs; not below 0."""
    cut = lambda cond, x, cap: F.when(cond, F.least(F.lit(float(cap)), x)).otherwise(0.0)
    s = F.lit(100.0) - cut(m["cc"] > 10, (m["cc"] - 10) * 1.5, 30) - cut(m["cog"] > 15, (m["cog"] - 15) * 0.8, 20)
    s = s - F.least(F.lit(15.0), m["n_long"] * 5) - F.least(F.lit(15.0), m["n_complex"] * 5) - F.least(F.lit(10.0), m["over_80"] * 0.5)
    return F.greatest(F.lit(0.0), s - cut(m["bugs"] > 1, m["bugs"] * 2, 10))


def rating(minutes: Column) -> Column:
    """A up to 5 minutes of debt, B 30, C 60, D 120, else E."""
    return F.when(minutes <= 5, "A").when(minutes <= 30, "B").when(minutes <= 60, "C").when(minutes <= 120, "D").otherwise("E")
