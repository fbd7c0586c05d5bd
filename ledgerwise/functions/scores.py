"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, clamp, in_set


def bayes_update(prior: Column, likelihood: Column) -> Column:
    num = likelihood * prior
    den = num + (1 - likelihood) * (1 - prior)
    return F.when(den == 0, prior).otherwise(F.try_divide(num, den))


def time_weighted_penalty(weight: Column, days_old: Column) -> Column:
    """Weight decayed by age and truncated toward zero; fresh events keep the full weight."""
    aged = (weight * F.exp(-days_old / 180.0)).cast("bigint")
    return F.when(F.coalesce(days_old, F.lit(0)) <= 0, weight.cast("bigint")).otherwise(aged)


def cluster_confidence(size: Column, scam: Column, flow: Column, tx: Column, days: Column) -> Column:
    strength = lambda x: F.least(F.lit(1.0), F.log1p(x.cast("double")) / 5.0)
    return clamp(
        0.4 * scam.cast("double") / F.greatest(size.cast("double"), F.lit(1.0)) + 0.3 * strength(tx)
        + 0.2 * strength(flow) + 0.1 * F.exp(-days / 30.0), 0.0, 1.0)


def cluster_risk_penalty(penalty: Column, distance: Column, days: Column, confidence: Column,
                         decay: float = 1.5) -> Column:
    return penalty * F.exp(-distance / decay) * F.exp(-days / 180.0) * confidence


def _adjusted(score: Column, change: Column) -> Column:
    return F.struct(clamp(score + change, 0, 100).alias("score"), change.alias("adjustment"))


def reputation_decay(score: Column, age_days: Column, last_scam_days: Column) -> Column:
    good = F.when(age_days > 365, 20).when(age_days > 180, 10).when(age_days > 90, 5).otherwise(0)
    bad = F.when(last_scam_days < 7, -30).when(last_scam_days < 30, -15).when(last_scam_days < 90, -5).otherwise(0)
    return _adjusted(score, good + bad)


def graph_penalty(score: Column, distance: Column) -> Column:
    change = (F.when(distance == 0, -100).when(distance == 1, -60).when(distance == 2, -30)
              .when(distance == 3, -10).otherwise(0))
    return _adjusted(score, change)


# bands as (upper bound, inclusive?, value); the last value is the rest
_SCHEMES = {
    "label": ([(25, True, "HIGH"), (50, True, "MEDIUM"), (75, True, "LOW")], "SAFE"),
    "rank_low_good": ([(20, False, "3"), (50, False, "2"), (80, False, "1")], "0"),
    "rank_bands": ([(25, True, "3"), (50, True, "2"), (75, True, "1")], "0"),
    "oracle": ([(30, False, "critical"), (50, False, "high"), (70, False, "medium")], "low"),
    "recovery": ([(40, False, "high"), (70, False, "medium")], "low"),
    "model": ([(34, False, "HIGH"), (67, False, "MEDIUM")], "LOW"),
    "combined": ([(50, False, "HIGH"), (80, True, "MEDIUM")], "LOW"),
}


def risk_level(score: Column, scheme: str = "label") -> Column:
    bands, rest = _SCHEMES[scheme]
    out = None
    for bound, inclusive, value in bands:
        cond = score <= bound if inclusive else score < bound
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(rest)


def risk_level_from_reasons(codes: Column, min_weight: Column) -> Column:
    """Severity of a reason set: its codes and its most negative weight."""
    critical = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in sorted(P.CRITICAL_CODES)]))
    return (F.when(critical, "critical").when(min_weight < -50, "high").when(min_weight < -20, "medium")
            .otherwise("low"))


def badge(score: Column, scheme: str = "five") -> Column:
    bands = {"five": P.BADGE_FIVE, "four": P.BADGE_FOUR, "transfer": P.BADGE_TRANSFER}[scheme]
    entry = lambda name, color: F.struct(F.lit(name).alias("name"), F.lit(color).alias("color"))
    out = None
    for low, name, color in bands[:-1]:
        out = F.when(score >= low, entry(name, color)) if out is None else out.when(score >= low, entry(name, color))
    return out.otherwise(entry(*bands[-1][1:]))


def forced_weight(code: Column, weight: Column) -> Column:
    """Dangerous codes always count against the wallet."""
    return F.when(in_set(code, P.FORCED_NEGATIVE_CODES), -F.abs(weight)).otherwise(weight)


def inactivity_decay(last_seen: Column, as_of: int) -> Column:
    """1 while active, falling to 0.5 linearly over 90 days without activity."""
    idle = (F.lit(as_of) - last_seen) / float(DAY)
    return F.when(last_seen.isNull() | (idle <= 0), 1.0).when(idle >= 90, 0.5).otherwise(1.0 - 0.5 * idle / 90.0)


def quota_check(used: Column, limit: Column, batch: Column) -> Column:
    unlimited = limit < 0
    return F.struct(
        (unlimited | (used + batch <= limit)).alias("allowed"),
        F.when(unlimited, F.lit(-1)).otherwise(F.greatest(F.lit(0), limit - used)).alias("remaining"),
    )


def score_class(score: Column) -> Column:
    return F.when(score < 34, 0).when(score < 67, 1).otherwise(2)


def recommended_actions(category: Column, intrinsic: Column, contextual: Column) -> Column:
    texts = lambda items: F.array(*[F.lit(t) for t in items])
    out = None
    for name, items in P.ACTIONS_BY_CATEGORY.items():
        cond = F.upper(F.trim(category)) == name
        out = F.when(cond, texts(items)) if out is None else out.when(cond, texts(items))
    return (out.when(F.upper(F.trim(intrinsic)) == "HIGH", texts(P.ACTIONS_INTRINSIC_HIGH))
            .when(F.upper(F.trim(contextual)) == "HIGH", texts(P.ACTIONS_CONTEXTUAL_HIGH))
            .otherwise(texts(P.ACTIONS_DEFAULT)))
