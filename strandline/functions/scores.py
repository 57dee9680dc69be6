"""Per-position score features (M1-M9, M14, M16, M18-M20): expressions over the donor, acceptor and neither columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: keeps ratios and logarithms finite.
EPSILON = 1e-10


def row_max(*cols) -> Column:
    """M1: the largest of the columns, nulls ignored."""
    return F.greatest(*cols)


def row_sum(*cols) -> Column:
    """M1: the sum of the columns, nulls ignored."""
    total = F.coalesce(F.col(cols[0]), F.lit(0.0))
    for c in cols[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def probability_features(donor="donor", acceptor="acceptor", neither="neither", eps=EPSILON) -> dict[str, Column]:
    """M2-M4: ratios, differences, log-odds and the natural-log entropy of the three classes."""
    d, a, n = F.col(donor), F.col(acceptor), F.col(neither)
    return {
        "relative_donor_probability": d / (d + a + eps),
        "splice_probability": (d + a) / (d + a + n + eps),
        "donor_acceptor_diff": (d - a) / (F.greatest(d, a) + eps),
        "splice_neither_diff": (F.greatest(d, a) - n) / (F.greatest(d, a, n) + eps),
        "donor_acceptor_logodds": F.log(d + eps) - F.log(a + eps),
        "splice_neither_logodds": F.log(d + a + eps) - F.log(n + eps),
        "probability_entropy": -(d * F.log(d + eps) + a * F.log(a + eps) + n * F.log(n + eps)),
    }


def context_weights(width: int) -> list[float]:
    """M6, M7: weights of the 2 * width + 1 scores around a position; a fixed kernel at width 2, else a normalised Gaussian."""
    if width == 2:
        return [0.1, 0.2, 0.4, 0.2, 0.1]
    raw = [math.exp(-0.5 * ((i - width) / (width / 2)) ** 2) for i in range(2 * width + 1)]
    return [x / sum(raw) for x in raw]


def context_pattern(score: str, width: int = 2, eps=EPSILON) -> dict[str, Column]:
    """M5: mean of the neighbours, their asymmetry (downstream share less upstream share) and their maximum."""
    up = [F.col(f"{score}_m{i}") for i in range(1, width + 1)]
    down = [F.col(f"{score}_p{i}") for i in range(1, width + 1)]
    total = lambda cs: sum(cs[1:], cs[0])
    return {
        f"{score}_context_mean": total(up + down) / (2 * width),
        f"{score}_context_asymmetry": (total(down) - total(up)) / (total(down) + total(up) + eps),
        f"{score}_context_max": F.greatest(*up, *down),
    }


def gradient_features(score: str, width: int = 2, eps=EPSILON) -> dict[str, Column]:
    """M6: differences to each neighbour, surge, local peak, weighted context, peak height, curvature, strength."""
    s = F.col(score)
    up = [F.col(f"{score}_m{i}") for i in range(1, width + 1)]
    down = [F.col(f"{score}_p{i}") for i in range(1, width + 1)]
    around = [*reversed(up), s, *down]
    weighted = sum((F.lit(w) * c for w, c in zip(context_weights(width)[1:], around[1:])), F.lit(context_weights(width)[0]) * around[0])
    mean = sum([*up[1:], *down], up[0]) / (2 * width)
    out = {f"{score}_diff_m{i}": s - c for i, c in enumerate(up, 1)} | {f"{score}_diff_p{i}": s - c for i, c in enumerate(down, 1)}
    return out | {
        f"{score}_surge_ratio": s / (up[0] + down[0] + eps),
        f"{score}_is_local_peak": ((s > up[0]) & (s > down[0]) & (s > 0.001)).cast("int"),
        f"{score}_weighted_context": weighted,
        f"{score}_peak_height_ratio": s / (mean + eps),
        f"{score}_second_derivative": up[0] - 2 * s + down[0],
        f"{score}_signal_strength": s - mean,
        f"{score}_context_diff_ratio": s / (F.greatest(*up, *down) + eps),
    }


def comparative_features(donor="donor", acceptor="acceptor", eps=EPSILON) -> dict[str, Column]:
    """M8: the donor's gradient features against the acceptor's."""
    d, a = (lambda k: F.col(f"{donor}_{k}")), (lambda k: F.col(f"{acceptor}_{k}"))
    return {
        "peak_ratio": d("peak_height_ratio") / (a("peak_height_ratio") + eps),
        "signal_strength_ratio": d("signal_strength") / (a("signal_strength") + eps),
        "surge_difference": d("surge_ratio") - a("surge_ratio"),
        "curvature_difference": d("second_derivative") - a("second_derivative"),
    }


def softmax(logits: list[str], temperature: float = 1.0) -> dict[str, Column]:
    """Class shares of exp(logit / temperature), shifted by the largest logit so that nothing overflows."""
    top = F.greatest(*logits)
    parts = {c: F.exp((F.col(c) - top) / temperature) for c in logits}
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    return {c: p / total for c, p in parts.items()}


def residual_blend(base: str, logit: str, alpha: float) -> Column:
    """A base probability and a new one, mixed."""
    return (1 - alpha) * F.col(base) + alpha * F.col(logit)


def label_code(site_type="splice_type") -> Column:
    """Donor 0, acceptor 1, anything else 2 (case ignored, null is else)."""
    t = F.lower(F.coalesce(F.col(site_type), F.lit("")))
    return F.when(t == "donor", 0).when(t == "acceptor", 1).otherwise(2)


def signal_category(score: Column, weak=0.01, moderate=0.1) -> Column:
    """None, weak (from `weak`), moderate (from `moderate`)."""
    return F.when(score >= moderate, "moderate").when(score >= weak, "weak").otherwise("none")


def contrast(score: str, context_mean: str) -> Column:
    """A score less its context's mean."""
    return F.col(score) - F.col(context_mean)


def deltas(alternative: DataFrame, reference: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Alternative less reference, channel by channel, at the same keys."""
    ref = reference.select(*keys, *(F.col(c).alias(f"_{c}") for c in channels))
    return alternative.join(ref, keys).select(*keys, *((F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in channels))
