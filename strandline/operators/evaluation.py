"""Evaluation and calibration (E1-E4, E6-E14, E16-E18, A28, W8-W10; E5, E15 and E22 are in selection.py): conditional sums, cumulative windows over score groups, bins."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import beside, best_in_window, with_offsets
from .labels import key_hash
from .scans import top_k
from .windows import running_totals


def classify_sites(truth: DataFrame, scores: DataFrame, on: list[str], threshold=0.5, width=2, position="position", score="score") -> DataFrame:
    """TP and FN of each true site by the best score within `width` (>= threshold), FP of scores at or over it away from every true site.

    A TP or FN row has the true position and the best score (0 where there is none over 0).
    """
    rows, near = beside(truth.select(*on, position).distinct(), scores, on, width, position, score)
    keyed = lambda c: F.max(F.when(F.col("_keyed"), F.col(c))).over(near)
    got = rows.withColumns({"_best": keyed("_score"), "_true": keyed("_site")}).where("_core").where(F.col("_site") | ((F.col("_score") >= threshold) & ~F.coalesce("_true", F.lit(False))))
    score_of = F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))
    kind = F.when(~F.col("_site"), "FP").when(score_of >= threshold, "TP").otherwise("FN")
    return got.select(*on, position, kind.alias("pred_type"), F.when(F.col("_site"), score_of).otherwise(F.col("_score")).alias("score"))


def site_metrics(classified: DataFrame, by: list[str] = (), kind="pred_type", digits=4) -> DataFrame:
    """Counts, precision, recall and F1, rounded."""
    n = lambda k: F.sum((F.col(kind) == k).cast("long"))
    got = classified.groupBy(*by).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    return with_rates(got, digits)


def with_rates(counts: DataFrame, digits=4) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return counts.select("*", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), digits).alias("f1"))


def ranked_counts(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """True and false positives at and before (tp0, fp0) each distinct score, from the highest: the table behind AP, PR and ROC.

    Scores are grouped first and run up range by range, so no task holds all of them.
    """
    per = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1.0 - F.col(label)).alias("neg"))
    got = running_totals(per, score, ["pos", "neg"], by, descending=True)
    got = got.select(*by, score, "pos", "neg", F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"), F.col("pos_all").alias("p_all"), F.col("neg_all").alias("n_all"))
    return got.select("*", (F.col("tp") - F.col("pos")).alias("tp0"), (F.col("fp") - F.col("neg")).alias("fp0"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "p_all").alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall; null for a group without positives."""
    got = ranked_counts(df, label, score, by)
    return got.groupBy(*by).agg(F.sum(F.try_divide(F.col("precision") * F.col("pos"), F.col("p_all"))).alias("average_precision"))


def pr_auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Trapezoids under precision over recall, from the point (0, 1); null for a group without positives."""
    p0 = F.when(F.col("tp0") + F.col("fp0") > 0, F.col("tp0") / (F.col("tp0") + F.col("fp0"))).otherwise(F.lit(1.0))
    got = ranked_counts(df, label, score, by)
    return got.groupBy(*by).agg(F.sum(F.try_divide("pos", "p_all") * (F.col("precision") + p0) / 2).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Trapezoids under true over false positive rate; ties share their step; null for a group without both classes."""
    got = ranked_counts(df, label, score, by)
    return got.groupBy(*by).agg(F.sum(F.try_divide(F.col("neg") * (F.col("tp") + F.col("tp0")) / 2, F.col("p_all") * F.col("n_all"))).alias("roc_auc"))


def sampled_average_precision(df: DataFrame, label: str, classes: list[str], key: str, rate=0.01, background: int = 2, seed=42) -> DataFrame:
    """Average precision of each class's score over all sites and a hashed share of the background class."""
    kept = df.where((F.col(label) != background) | (key_hash(key, 100_000, seed) < round(rate * 100_000)))
    per = F.explode(F.array(*(F.struct(F.lit(i).alias("class_index"), F.col(c).cast("double").alias("_score"), (F.col(label) == i).cast("int").alias("_label")) for i, c in enumerate(classes))))
    return average_precision(kept.select(per.alias("r")).select("r.*"), "_label", "_score", ["class_index"])


def score_report(df: DataFrame, label: str, scores: list[str], thresholds=(0.1, 0.2, 0.5, 0.8)) -> DataFrame:
    """For each score, its ROC-AUC and average precision, and sensitivity and specificity (null without such rows) at each threshold; labels other than 0 and 1 stay out."""
    per = F.explode(F.array(*(F.struct(F.lit(c).alias("scores"), F.col(c).cast("double").alias("_score"), F.col(label).cast("int").alias("_label")) for c in scores)))
    long = df.where(F.col(label).isin(0, 1)).select(per.alias("r")).select("r.*")
    share = lambda of, hit: F.avg(F.when(F.col("_label") == of, hit.cast("double")))
    wide = long.groupBy("scores").agg(
        F.sum("_label").alias("n_positive"), F.sum(1 - F.col("_label")).alias("n_negative"),
        *(x for i, t in enumerate(thresholds) for x in (share(1, F.col("_score") >= t).alias(f"_p{i}"), share(0, F.col("_score") < t).alias(f"_n{i}"))),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_p{i}").alias("sensitivity"), F.col(f"_n{i}").alias("specificity")) for i, t in enumerate(thresholds))))
    at = wide.select("scores", "n_positive", "n_negative", rows.alias("r")).select("scores", "n_positive", "n_negative", "r.*")
    return at.join(roc_auc(long, "_label", "_score", ["scores"]), "scores").join(average_precision(long, "_label", "_score", ["scores"]), "scores")


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float], digits=4) -> DataFrame:
    """Counts and rates at each threshold; thresholds are few, so each row is compared with all of them in one aggregate."""
    hit = lambda t: F.col(score) >= t
    wide = df.agg(*(x for i, t in enumerate(thresholds) for x in (F.sum((hit(t) & (F.col(label) == 1)).cast("long")).alias(f"tp{i}"), F.sum((hit(t) & (F.col(label) != 1)).cast("long")).alias(f"fp{i}"), F.sum((~hit(t) & (F.col(label) == 1)).cast("long")).alias(f"fn{i}"))))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.coalesce(F.col(f"{k}{i}"), F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn"))) for i, t in enumerate(thresholds)))
    return with_rates(wide.select(F.explode(rows).alias("r")).select("r.*"), digits)


def topk_accuracy(scores: DataFrame, truth: DataFrame, by: list[str], position="position", score="score", factor=1.0, ceil=False, least: float | None = None) -> DataFrame:
    """The share of each group's true sites among its k best scores; k = max(1, factor * sites), rounded down or up."""
    n = truth.select(*by, position).distinct().groupBy(*by).agg(F.count("*").alias("n_true"))
    k = F.greatest(F.lit(1), (F.ceil if ceil else F.floor)(F.col("n_true") * factor))
    ranked = top_k((scores.where(F.col(score) >= least) if least is not None else scores).join(n, by), score, k, by, [position])
    hits = ranked.join(truth.select(*by, position).distinct(), [*by, position], "left_semi").groupBy(*by).agg(F.count("*").alias("hits"))
    return n.join(hits, by, "left").select(*by, "n_true", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n_true")).alias("accuracy"))


def windowed_recall(truth: DataFrame, scores: DataFrame, on: list[str], widths: list[int], least=0.1, position="position", score="score") -> DataFrame:
    """The share of annotation rows with a score of `least` or more within each width. One probe at the largest width serves all."""
    widest = max(widths)
    rows = truth.select(*on, position).groupBy(*on, position).agg(F.count("*").alias("_n"))
    probe = rows.withColumn("_offset", F.explode(F.sequence(F.lit(-widest), F.lit(widest)))).withColumn("_at", F.col(position) + F.col("_offset"))
    near = scores.where(F.col(score) >= least).select(*on, F.col(position).alias("_at")).distinct()
    dist = probe.join(near, [*on, "_at"]).groupBy(*on, position).agg(F.min(F.abs("_offset")).alias("_d"))
    got = rows.join(dist, [*on, position], "left")
    wide = got.agg(F.sum("_n").alias("n"), *(F.sum(F.when(F.col("_d") <= k, F.col("_n")).otherwise(0)).alias(f"h{k}") for k in widths))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("width"), F.col("n").alias("n_sites"), F.col(f"h{k}").alias("n_found"), (F.col(f"h{k}") / F.col("n")).alias("recall")) for k in widths))).alias("r")).select("r.*")


def gap_analysis(truth: DataFrame, scores: DataFrame, on: list[str], by: list[str], threshold=0.5, width=5, position="position", score="score") -> DataFrame:
    """Per group, sites, those detected by their own score, missed ones by the strongest score nearby (weak from .01, moderate from .1, detectable from the threshold)."""
    sites = truth.select(*on, position).distinct()
    own = sites.join(scores.select(*on, position, F.col(score).alias("own")), [*on, position], "left")
    best = best_in_window(sites, scores.select(*on, position, score), on, width, position, score).select(*on, position, F.coalesce("best_score", F.lit(0.0)).alias("near"))
    got = own.join(best, [*on, position])
    missed = F.coalesce(F.col("own") < threshold, F.lit(True))
    count = lambda c: F.sum(c.cast("long"))
    return got.groupBy(*by).agg(F.count("*").alias("n_sites"), count(~missed).alias("detected"), count(missed & (F.col("near") >= threshold)).alias("shifted"), count(missed & F.col("near").between(0.1, threshold) & (F.col("near") < threshold)).alias("moderate"), count(missed & (F.col("near") >= 0.01) & (F.col("near") < 0.1)).alias("weak"), count(missed & (F.col("near") < 0.01)).alias("none"))


def calibration_bins(df: DataFrame, label: str, score: str, bins=10) -> DataFrame:
    """Per bin [lo, hi), the last one closed: count, mean score, share of positives."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def ece_mce(df: DataFrame, label: str, score: str, bins=10) -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("mean_score") - F.col("observed"))
    return calibration_bins(df, label, score, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(df: DataFrame, label: str, score: str, bins=10) -> DataFrame:
    """The Brier score and its calibration, refinement and uncertainty parts over bins."""
    y = F.col(label).cast("double")
    whole = df.agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(y).alias("base"), F.count("*").alias("total"))
    parts = calibration_bins(df, label, score, bins).join(F.broadcast(whole))
    d = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return parts.agg(F.first("brier").alias("brier"), (F.sum(F.col("n") * d("mean_score", "observed")) / F.first("total")).alias("calibration"), (F.sum(F.col("n") * d("observed", "base")) / F.first("total")).alias("refinement"), (F.first("base") * (1 - F.first("base"))).alias("uncertainty"))


def argmax_class(columns: list[str]) -> Column:
    """The index of the largest column, the first on ties."""
    top, out = F.greatest(*columns), None
    for i, c in enumerate(columns):
        out = F.when(F.col(c) == top, i) if out is None else out.when(F.col(c) == top, i)
    return out


def confusion_by_class(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Per class, true rows, TP, FP, FN."""
    got = df.select(F.col(label).cast("int").alias("y"), argmax_class(columns).alias("z")).groupBy("y", "z").agg(F.count("*").alias("n"))
    rows = got.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("n_true"), F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("y") != F.col("z"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("z").alias("c"), F.lit(0).cast("long").alias("n_true"), F.lit(0).cast("long").alias("tp"), F.when(F.col("y") != F.col("z"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("r")).select("r.*")
    return rows.groupBy(F.col("c").alias("class_index")).agg(*(F.sum(k).alias(k) for k in ("n_true", "tp", "fp", "fn")))


def best_offset(truth: DataFrame, scores: DataFrame, on: list[str], lowest=-5, highest=5, threshold=0.5, gain=0.0, position="position", score="score") -> DataFrame:
    """F1 at each shift of the truth, and the best one (0 unless it beats 0 by more than `gain`; the smaller shift on ties)."""
    sites = truth.select(*on, position).distinct()
    calls = scores.where(F.col(score) >= threshold).select(*on, F.col(position).alias("shifted")).distinct()
    tp = with_offsets(sites, lowest, highest, position).join(calls, [*on, "shifted"], "left_semi").groupBy("offset").agg(F.count("*").alias("tp"))
    totals = sites.agg(F.count("*").alias("n_true")).join(F.broadcast(calls.agg(F.count("*").alias("n_calls"))))
    got = tp.join(F.broadcast(totals)).select("offset", (2 * F.col("tp") / (F.col("n_true") + F.col("n_calls"))).alias("f1"))
    best = got.agg(F.max_by("offset", F.struct("f1", -F.abs("offset"))).alias("best"), F.max("f1").alias("best_f1"), F.max(F.when(F.col("offset") == 0, F.col("f1"))).alias("base_f1"))
    base = F.coalesce("base_f1", F.lit(0.0))
    return best.select(F.when(F.col("best_f1") > base + gain, F.col("best")).otherwise(0).alias("offset"), "best_f1", base.alias("base_f1"))


def fit_temperature(df: DataFrame, logits: list[str], label: str, grid=None, digits: int = 2) -> float:
    """The temperature of least negative log-likelihood on a grid; every candidate is one column of one aggregate."""
    grid = list(np.round(np.geomspace(0.25, 4.0, 41), 6)) if grid is None else list(grid)
    own = F.element_at(F.array(*logits), F.col(label) + 1)
    top = F.greatest(*logits)

    def nll(t):
        total = None
        for c in logits:
            e = F.exp((F.col(c) - top) / float(t))
            total = e if total is None else total + e
        return F.avg(F.log(total) - (own - top) / float(t))

    row = df.agg(*(nll(t).alias(f"t{i}") for i, t in enumerate(grid))).first()
    return float(grid[int(np.argmin(row))])


#: The temperatures that a class may have.
COOLEST, HOTTEST = 0.05, 5.0


def scaled_log_likelihood(logits: list[str], inverse: list[float], label: str) -> tuple[Column, list[Column]]:
    """Of a row: the negative log-likelihood of its label under softmax(logits * inverse temperatures), and each class's share."""
    z = [F.col(c).cast("double") * float(b) for c, b in zip(logits, inverse)]
    top = F.greatest(*z)
    parts = [F.exp(x - top) for x in z]
    total = reduce(lambda a, b: a + b, parts)
    own = reduce(lambda rest, i: F.when(F.col(label) == i, z[i]).otherwise(rest), reversed(range(len(z))), F.lit(None).cast("double"))
    return F.log(total) + top - own, [x / total for x in parts]


def newton_terms(df: DataFrame, logits: list[str], inverse: list[float], label: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood, its gradient and its curvature by the inverse temperatures: one aggregate over the table."""
    nll, share = scaled_log_likelihood(logits, inverse, label)
    k = len(logits)
    z = [F.col(c).cast("double") for c in logits]
    hit = [(F.col(label) == i).cast("double") for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.avg(nll), *(F.avg(z[i] * (share[i] - hit[i])) for i in range(k)), *(F.avg(z[i] * z[j] * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i, j in upper)).first()
    if row[0] is None:
        return float("nan"), np.zeros(k), np.eye(k)
    curve = np.zeros((k, k))
    for (i, j), v in zip(upper, row[1 + k :]):
        curve[i, j] = curve[j, i] = v
    return row[0], np.array(row[1 : 1 + k]), curve


def fit_class_temperatures(df: DataFrame, logits: list[str], label: str, steps: int = 50, within: float = 1e-10) -> dict:
    """A temperature a class, of least negative log-likelihood: softmax(logit / temperature of its class), each between COOLEST and HOTTEST.

    In the inverse temperatures the mean negative log-likelihood is convex, so Newton steps find its least value; each is one aggregate of gradient and curvature, whatever the
    table's size. A class at a bound that its gradient pushes against stays there while the others move. A step that doesn't help is halved. Rows with a null, or a label that is no
    class, stay out; a table without rows gives temperatures of 1 and null likelihoods.
    """
    k, low, high = len(logits), 1 / HOTTEST, 1 / COOLEST
    some = df.where(F.col(label).isin(list(range(k)))).dropna(subset=logits).select(*logits, label)
    b = np.ones(k)
    nll, gradient, curve = newton_terms(some, logits, b, label)
    before, n_steps = nll, 0
    for _ in range(steps):
        held = ((b <= low) & (gradient > 0)) | ((b >= high) & (gradient < 0))
        free = ~held
        if not free.any() or np.isnan(nll) or np.abs(gradient[free]).max() < within:
            break
        move = np.zeros(k)
        move[free] = np.linalg.lstsq(curve[np.ix_(free, free)] + 1e-12 * np.eye(free.sum()), -gradient[free], rcond=None)[0]
        size = 1.0
        while True:
            tried = np.clip(b + size * move, low, high)
            terms = newton_terms(some, logits, tried, label)
            if terms[0] <= nll + 1e-15 or size < 1e-6:
                break
            size /= 2
        if np.array_equal(tried, b):
            break
        b, (nll, gradient, curve), n_steps = tried, terms, n_steps + 1
    blank = np.isnan(nll)
    return {"temperature": (1 / b).tolist(), "gradient": gradient.tolist(), "nll_before": None if blank else before, "nll_after": None if blank else nll, "steps": n_steps}
