"""Scores of content items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("authority", "substance", "novelty", "timeliness", "audience_fit")
#: Weights of the dimensions and the most that marketing takes off, by content type. Fixed values.
PROFILES = {
    "dynamic_news": ((25, 20, 20, 20, 15), 2.0),
    "product_tool": ((15, 30, 20, 5, 30), 3.0),
    "tutorial_method": ((15, 40, 10, 5, 30), 2.0),
    "evaluation_report": ((30, 35, 10, 5, 20), 2.5),
    "opinion_case": ((20, 35, 15, 5, 25), 2.5),
    "general": ((20, 30, 15, 15, 20), 2.5),
}
#: Weights of the dimensions 1..3 of a quality score by content type; spam counts the other way round. Fixed values.
QUALITY = {
    "flash": {"novelty": 0.30, "info_density": 0.25, "credibility": 0.20, "spam_score": 0.25},
    "post": {"novelty": 0.25, "depth": 0.25, "actionability": 0.20, "credibility": 0.15, "spam_score": 0.15},
    "article": {"novelty": 0.20, "depth": 0.30, "actionability": 0.20, "credibility": 0.15, "spam_score": 0.15},
    "video": {"novelty": 0.30, "actionability": 0.30, "spam_score": 0.40},
    "repo": {"novelty": 1.0},
}


def score10(content_type: Column, confidence: Column, dims: dict[str, Column], marketing: Column) -> Column:
    """A score from 0 to 10 from dimensions 0..3, capped where authority, fit or novelty are wanting."""
    kind = F.when(confidence < 0.6, "general").otherwise(content_type)
    out = None
    for name, (weights, penalty) in PROFILES.items():
        total = sum((w * dims[d] / 3 for d, w in zip(DIMENSIONS, weights)), F.lit(0.0)) / 10 - marketing / 3 * penalty
        out = F.when(kind == name, total) if out is None else out.when(kind == name, total)
    cap = F.when((dims["authority"] == 0) | (dims["audience_fit"] <= 1), 4.9).when(dims["novelty"] == 0, 5.9).otherwise(10.0)
    return F.round(F.greatest(F.least(out, cap), F.lit(0.0)), 1)


def is_flag_bearer(score: Column, threshold: float, veto: Column, uncertainty: Column, reject: Column) -> Column:
    return F.coalesce((score >= threshold) & (veto == "none") & (uncertainty != "unverified_major_claim") & ~reject, F.lit(False))


def quality(content_type: Column, dims: dict[str, Column]) -> Column:
    """A score from 0 to 1 from dimensions 1..3; dimensions that are missing count 2."""
    out = None
    for name, weights in QUALITY.items():
        part = lambda d, v: (3 - v) / 2 if d == "spam_score" else (v - 1) / 2
        total = sum((w * part(d, F.coalesce(dims[d], F.lit(2)) if d in dims else F.lit(2)) for d, w in weights.items()), F.lit(0.0))
        out = F.when(content_type == name, total) if out is None else out.when(content_type == name, total)
    known = [(d, v) for d, v in dims.items() if d != "spam_score"]
    count = sum((v.isNotNull().cast("int") for _, v in known), F.lit(0))
    mean = sum((F.coalesce((v - 1) / 2, F.lit(0.0)) for _, v in known), F.lit(0.0)) / F.greatest(count, F.lit(1))
    return F.round(F.greatest(F.least(out.otherwise(F.when(count > 0, mean).otherwise(0.5)), F.lit(1.0)), F.lit(0.0)), 3)


def ranking(quality_: Column, percentile: Column, decay: Column, match: Column | None = None) -> Column:
    base = F.coalesce(F.when(quality_ != 0, quality_), F.lit(0.5)) * (1 + 0.1 * F.coalesce(percentile, F.lit(0.5))) * decay
    return F.round(base if match is None else base * match, 6)


def match_score(category_weight: Column, overlaps: Column) -> Column:
    return F.greatest(F.coalesce(category_weight, F.lit(1.0)), F.lit(0.15)) * (1 + 0.25 * overlaps)


def highlight(best: Column, mean: Column, sources: Column, norm: float = 5.0, shrink: float = 1.0) -> Column:
    """Cluster score from its items' best and mean score and its number of sources; null without scores."""
    n = F.greatest(sources, F.lit(1))
    return (0.6 * best + 0.4 * mean) * F.log1p(n.cast("double")) / F.log1p(F.lit(norm)) * n / (n + shrink)


def relevance(hits: Column, engagement_: Column) -> Column:
    """Ten for each keyword found and twice the logarithm of the engagement."""
    return F.round(hits * 10 + F.log1p(engagement_.cast("double")) * 2, 2)


#: What counts as engagement, by platform: names in a map of metrics with their weights. Fixed values.
ENGAGEMENT = {
    "twitter": {"likes": 1, "retweets": 2},
    "bilibili": {"likes": 1, "coins": 3, "favorites": 2},
    "xiaohongshu": {"likes": 1, "collects": 2},
}
#: Platforms with one metric, under either of two names. Fixed values.
EITHER = {"reddit": ("score", "score"), "github": ("stars", "stargazers_count"), "hackernews": ("score", "points")}


def engagement(platform: Column, metrics: Column) -> Column:
    """One number of a map of metrics; platforms without a rule add up all that is positive."""
    at = lambda k: F.coalesce(F.element_at(metrics, F.lit(k)), F.lit(0.0))
    out = F.when(metrics.isNull(), 0.0)
    for name, weights in ENGAGEMENT.items():
        out = out.when(platform == name, sum((w * at(k) for k, w in weights.items()), F.lit(0.0)))
    for name, (first, second) in EITHER.items():
        out = out.when(platform == name, F.when(at(first) != 0, at(first)).otherwise(at(second)))
    return out.otherwise(F.aggregate(F.map_values(metrics), F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0))))


def time_factor(hours: Column, half_life: Column) -> Column:
    """Halves with every half-life, an hour at least; 1 for items without a time."""
    return F.coalesce(F.round(F.pow(F.lit(0.5), hours / F.greatest(half_life, F.lit(1.0))), 4), F.lit(1.0))


def item_verdict(relevant: Column, spam: Column, credibility: Column, importance: Column, values: dict[str, Column], borderline: Column, exclude_at: int = 3) -> Column:
    """featured, review or drop: by a strong value that is no borderline case, or three middling ones."""
    strong = F.lit(False)
    for name, v in values.items():
        strong = strong | ((v == 3) & ~F.array_contains(borderline, name))
    path = strong | (sum(((v >= 2).cast("int") for v in values.values()), F.lit(0)) >= 3)
    flat = importance == 1
    for name in ("substance", "actionability", "novelty"):
        flat = flat & (values[name] == 1)
    return (
        F.when((relevant == "no") | (spam >= exclude_at), "drop").when(path & (credibility >= 2), "featured")
        .when(flat | ((credibility == 1) & ~path), "drop").otherwise("review")
    )
