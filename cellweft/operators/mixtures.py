"""Signal and noise: two-component mixtures per feature, Gaussian and negative binomial, and the cleaning built on them.

Only what a fit needs leaves the rows: a negative binomial is fitted to the histogram of counts, a Gaussian mixture
to the frequencies of values, or of fine bins of them where a feature has very many. One short table per feature is
what a task gets, however many cells there are; the fitted distributions are applied as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalar import arcsinh, min_max, normal_cdf
from cellweft.operators.hotkeys import compress, quantiles_interpolated
from cellweft.session import cut, small, stored


def normalise_cells(long: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """(cell_id, feature, value) over the cell's total, or its total in `by`; cells whose total is 0 stay as they are."""
    total = (long if by is None else by).groupBy("cell_id").agg(F.sum("value").alias("_t"))
    return long.join(total, "cell_id", "left").select("cell_id", "feature", F.when(F.coalesce("_t", F.lit(0.0)) == 0, F.col("value")).otherwise(F.col("value") / F.col("_t")).alias("value"))


def min_max_features(long: DataFrame) -> DataFrame:
    """Each feature scaled to [0, 1]; a constant feature becomes 0."""
    r = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return long.join(small(r), "feature").select("cell_id", "feature", min_max(F.col("value"), F.col("_lo"), F.col("_hi")).alias("value"))


def shift_rescale(long: DataFrame) -> DataFrame:
    """Less the least value of all, over the cell's total, times the mean total; long holds every cell and feature."""
    least = long.agg(F.min("value").alias("_m"))  # one row
    moved = long.join(F.broadcast(least)).select("cell_id", "feature", (F.col("value") - F.col("_m")).alias("value"))
    total = moved.groupBy("cell_id").agg(F.sum("value").alias("_t"))
    mean = total.agg(F.avg("_t").alias("_a"))  # one row
    return moved.join(total, "cell_id").join(F.broadcast(mean)).select("cell_id", "feature", (F.when(F.col("_t") == 0, F.col("value")).otherwise(F.col("value") / F.col("_t")) * F.col("_a")).alias("value"))


def arcsinh_min_max(long: DataFrame, cofactor: float = 5.0) -> DataFrame:
    return min_max_features(long.withColumn("value", arcsinh(F.col("value"), cofactor)))


def count_histogram(long: DataFrame) -> DataFrame:
    """(feature, count, p): the share of the cells with each count from 0 to the feature's largest, empty ones included."""
    c = long.select("feature", F.col("value").cast("bigint").alias("count"))
    have = c.groupBy("feature", "count").agg(F.count(F.lit(1)).alias("n"))
    span = have.groupBy("feature").agg(F.max("count").alias("m"), F.sum("n").alias("total"))
    return span.select("feature", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("count")).join(have, ["feature", "count"], "left").select("feature", "count", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))


def fit_gaussians(long: DataFrame, *, drop_zeros: bool = True, rounds: int = 500, tolerance: float = 1e-6, limit: int = 100_000) -> DataFrame:
    """(feature, mu0, sd0, mix0, mu, sd, mix, loglik): EM of two Gaussians with their own variances; (mu, sd) is the signal, of the larger mean.

    Starts from the halves around the median. NaN and null values, and zeros if drop_zeros, are left out; a feature
    with fewer than two distinct values gets its mean and a deviation of 0. All rounds run on value-frequency rows: a
    feature of up to `limit` distinct values is fitted from its compressed rows in one task, a larger one on an
    equal-width histogram of as many bins with exact counts and means, so a task's input is bounded.
    """
    ok = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if drop_zeros:
        ok = ok.where("value <> 0")
    w = stored(compress(ok, ["feature"], "value"), "values")
    size = w.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = w.join(small(size), "feature")
    slot = F.when(F.col("k") <= limit, F.col("value")).otherwise(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(limit)).cast("double"))
    bins = binned.groupBy("feature", slot.alias("slot")).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, n = g["value"].to_numpy(float), g["weight"].to_numpy(float)
        return pd.DataFrame([{"feature": g["feature"].iloc[0], **em_two_gaussians(x, n, rounds, tolerance)}])

    feature = long.schema["feature"].dataType.simpleString()
    return bins.groupBy("feature").applyInPandas(fit, f"feature {feature}, mu0 double, sd0 double, mix0 double, mu double, sd double, mix double, loglik double")


def em_two_gaussians(x: np.ndarray, n: np.ndarray, rounds: int = 500, tolerance: float = 1e-6) -> dict:
    """EM on weighted values; the component of the larger mean is (mu, sd, mix)."""
    order = np.argsort(x)
    x, n = x[order], n[order]
    total = n.sum()
    if len(x) < 2:
        m = float(x[0]) if len(x) else math.nan
        return {"mu0": m, "sd0": 0.0, "mix0": 0.0, "mu": m, "sd": 0.0, "mix": 1.0, "loglik": math.nan}
    upto = np.cumsum(n)
    half = min(len(x) - 1, int(np.searchsorted(upto, total / 2)) + 1)
    floor = max(1e-12, 1e-6 * float(np.average((x - np.average(x, weights=n)) ** 2, weights=n)))
    r = (np.arange(len(x)) >= half).astype(float)
    last = -math.inf
    for _ in range(rounds):
        mu, var, mix = np.zeros(2), np.zeros(2), np.zeros(2)
        for j, q in enumerate((1 - r, r)):
            s = max(1e-300, (q * n).sum())
            mu[j] = (q * n * x).sum() / s
            var[j] = max(floor, (q * n * (x - mu[j]) ** 2).sum() / s)
            mix[j] = s / total
        logp = np.log(np.maximum(mix, 1e-300)) - 0.5 * np.log(2 * math.pi * var) - (x[:, None] - mu) ** 2 / (2 * var)
        top = logp.max(1)
        whole = top + np.log(np.exp(logp - top[:, None]).sum(1))
        r = np.exp(logp[:, 1] - whole)
        loglik = float((n * whole).sum())
        if abs(loglik - last) < tolerance * (1 + abs(loglik)):
            break
        last = loglik
    hi = int(mu[1] >= mu[0])
    lo = 1 - hi
    sd = np.sqrt(var)
    return {"mu0": float(mu[lo]), "sd0": float(sd[lo]), "mix0": float(mix[lo]), "mu": float(mu[hi]), "sd": float(sd[hi]), "mix": float(mix[hi]), "loglik": loglik}


def apply_gaussians(long: DataFrame, fits: DataFrame) -> DataFrame:
    """(cell_id, feature, value): the signal's cumulative distribution at each value; a deviation of 0 gives a step."""
    z = normal_cdf(F.col("value"), F.col("mu"), F.col("sd"))
    return long.join(small(fits.select("feature", "mu", "sd")), "feature").select("cell_id", "feature", F.when(F.col("sd") > 0, z).otherwise((F.col("value") >= F.col("mu")).cast("double")).alias("value"))


# Negative binomial mixtures. Parameters: mu1, mu2, disp1, disp2, mix; size = 1 / dispersion.

#: The two starts of the fit.
STARTS = ((5.0, 50.0, 2.0, 0.5, 0.5), (5.0, 50.0, 0.5, 2.0, 0.5))


def nb_pmf(top: int, mu: float, disp: float) -> np.ndarray:
    """Probabilities of 0..top by the recursion from count to count."""
    size = 1.0 / disp
    p = size / (size + mu)
    k = np.arange(1, top + 1)
    logs = np.concatenate([[size * math.log(max(p, 1e-300))], np.log((k - 1 + size) / k) + math.log(max(1 - p, 1e-300))])
    return np.exp(np.cumsum(logs))


def nb_mix_sse(args, p_obs: np.ndarray) -> float:
    """Sum of squared differences between observed and mixed probabilities, capped at the largest 32-bit integer."""
    mu1, mu2, d1, d2, mix = args
    model = mix * nb_pmf(len(p_obs) - 1, mu1, d1) + (1 - mix) * nb_pmf(len(p_obs) - 1, mu2, d2)
    s = float(((p_obs - model) ** 2).sum())
    return min(s, 2147483647.0) if s == s else 2147483647.0


def minimise(f, start, low, high, maxit: int = 500, factr: float = 1e-9) -> tuple[np.ndarray, float]:
    """Bounded quasi-Newton: parameters are mapped inside their bounds, the gradient is by differences, the step by backtracking."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    inside = lambda u: np.where(np.isinf(high), low + np.exp(np.minimum(u, 40)), low + (np.where(np.isinf(high), 1, high) - low) / (1 + np.exp(-u)))
    x0 = np.asarray(start, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.where(np.isinf(high), np.log(np.maximum(x0 - low, 1e-12)), np.log((x0 - low) / np.maximum(np.where(np.isinf(high), x0 + 1, high) - x0, 1e-12)))
    g_of = lambda u, fu: np.array([(f(inside(u + h)) - f(inside(u - h))) / 2e-5 for h in np.eye(len(u)) * 1e-5])
    fu = f(inside(u))
    g, hess = g_of(u, fu), np.eye(len(u))
    for _ in range(maxit):
        step = -hess @ g
        if step @ g >= 0:
            hess, step = np.eye(len(u)), -g
        t, moved = min(1.0, 2.0 / max(1e-12, np.abs(step).max())), False
        for _ in range(40):
            v = u + t * step
            fv = f(inside(v))
            if fv <= fu + 1e-4 * t * (step @ g):
                moved = True
                break
            t /= 2
        if not moved or abs(fu - fv) <= factr * 1e-7 * max(abs(fu), 1e-12):
            if moved and fv < fu:
                u, fu = v, fv
            break
        gv = g_of(v, fv)
        s, y = v - u, gv - g
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            a = np.eye(len(u)) - r * np.outer(s, y)
            hess = a @ hess @ a.T + r * np.outer(s, s)
        u, fu, g = v, fv, gv
    return inside(u), fu


def nb_median(mu: float, disp: float) -> int:
    top = int(mu * 20 + 100)
    return int(np.searchsorted(np.cumsum(nb_pmf(top, mu, disp)), 0.5))


def fit_nb(histogram: DataFrame, maxit: int = 500, factr: float = 1e-9, starts=STARTS) -> DataFrame:
    """(feature, mu, disp, mu0, disp0, mix, sse): a mixture of two negative binomials for each feature's histogram; (mu, disp) is the signal, of the larger median.

    Each start is fitted and the smaller sum of squares kept, the second on a tie. A histogram is as long as the largest count.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        p = g.sort_values("count")["p"].to_numpy(float)
        best = None
        for s in starts:
            got = minimise(lambda a: nb_mix_sse(a, p), s, [1e-8] * 5, [np.inf] * 4 + [1.0], maxit, factr)
            if best is None or got[1] <= best[1]:
                best = got
        (m1, m2, d1, d2, mix), sse = best
        if nb_median(m1, d1) > nb_median(m2, d2):
            row = (m1, d1, m2, d2, mix)
        else:
            row = (m2, d2, m1, d1, 1 - mix)
        return pd.DataFrame([{"feature": g["feature"].iloc[0], **dict(zip(("mu", "disp", "mu0", "disp0", "mix"), map(float, row))), "sse": float(sse)}])

    feature = histogram.schema["feature"].dataType.simpleString()
    return histogram.groupBy("feature").applyInPandas(fit, f"feature {feature}, mu double, disp double, mu0 double, disp0 double, mix double, sse double")


def nb_cdf_table(fits: DataFrame, top: DataFrame) -> DataFrame:
    """(feature, count, cdf) of the signal for counts from 0 to the feature's largest (feature, top)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                c = np.minimum(1.0, np.cumsum(nb_pmf(int(r.top), r.mu, r.disp)))
                yield pd.DataFrame({"feature": r.feature, "count": np.arange(len(c)), "cdf": c})

    feature = fits.schema["feature"].dataType.simpleString()
    return fits.select("feature", "mu", "disp").join(top.select("feature", "top"), "feature").mapInPandas(rows, f"feature {feature}, count bigint, cdf double")


def clean_nb(long: DataFrame, *, ceiling: bool = False, normalize: bool = True, maxit: int = 500, factr: float = 1e-9) -> DataFrame:
    """(cell_id, feature, value): the signal's distribution function at each count; with normalize over the raw totals and scaled to [0, 1]."""
    counts = long.withColumn("value", F.ceil("value").cast("double")) if ceiling else long
    hist = stored(count_histogram(counts), "hist")
    fits = fit_nb(hist, maxit, factr)
    table = nb_cdf_table(fits, hist.groupBy("feature").agg(F.max("count").alias("top")))
    keyed = counts.withColumn("count", F.col("value").cast("bigint"))
    clean = keyed.join(table, ["feature", "count"]).select("cell_id", "feature", F.col("cdf").alias("value"))
    return min_max_features(normalise_cells(clean, long)) if normalize else clean


def clean_gaussian(long: DataFrame, *, drop_zeros: bool) -> DataFrame:
    return apply_gaussians(long, cut(fit_gaussians(long, drop_zeros=drop_zeros)))


def clean_codex(long: DataFrame, model: str = "gaussian", *, normalize: bool = False, maxit: int = 500, factr: float = 1e-9) -> DataFrame:
    """Imaging proteins, cleaned by `gaussian` (totals evened out first), `nb` or `arcsinh`."""
    if model == "gaussian":
        return clean_gaussian(stored(shift_rescale(long), "shifted"), drop_zeros=False)
    if model == "nb":
        return clean_nb(long, ceiling=True, normalize=normalize, maxit=maxit, factr=factr)
    if model == "arcsinh":
        return arcsinh_min_max(long)
    raise ValueError(f"unknown model {model!r}")


def clean_cite(long: DataFrame, model: str = "nb", *, normalize: bool = True, maxit: int = 500, factr: float = 1e-9) -> DataFrame:
    """Reference proteins, cleaned by `nb` or `gaussian` (log of shares first)."""
    if model == "nb":
        return clean_nb(long, normalize=normalize, maxit=maxit, factr=factr)
    if model == "gaussian":
        return clean_gaussian(stored(normalise_cells(long).withColumn("value", F.log1p(F.lit(1e4) * F.col("value"))), "logged"), drop_zeros=True)
    raise ValueError(f"unknown model {model!r}")


def expression_range(long: DataFrame) -> DataFrame:
    """(feature, p, value): quartiles per feature, exact."""
    return quantiles_interpolated(compress(long, ["feature"], "value"), ["feature"], [0.25, 0.5, 0.75])
