"""Count distributions as Column expressions: Poisson and NB2 (Var = mu + alpha mu^2).

Grids are arrays over 0..K, unrolled for a fixed K so that they stay in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("poisson", "negbin")
MU_MIN, ALPHA_MIN, ALPHA_MAX = 1e-6, 1e-6, 100.0


def check_family(family: str, alpha: Column | None) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; known: {', '.join(FAMILIES)}")
    if (family == "negbin") != (alpha is not None):
        raise ValueError("negbin needs mu and alpha, poisson only mu")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: in lambdas, which generated code does not
    share, it stands as a variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalized(grid: Column) -> Column:
    scale = lambda g: bound(total(g), lambda t: F.transform(g, lambda x: x / t))
    return bound(grid, scale)


def nb_n_p(mu: Column, alpha: Column) -> tuple[Column, Column]:
    """NB2 as number of successes and their probability."""
    n = F.lit(1.0) / alpha
    return n, n / (n + mu)


def cells(mu: Column, k_max: int, family: str = "poisson", alpha: Column | None = None) -> list[Column]:
    """Probabilities of 0..k_max, one expression each."""
    check_family(family, alpha)
    if family == "poisson":
        return [F.exp(-mu) * F.pow(mu, F.lit(float(k))) / F.lit(float(math.factorial(k))) for k in range(k_max + 1)]
    n, p = nb_n_p(mu, alpha)
    out, coefficient = [], F.lit(1.0)
    for k in range(k_max + 1):
        out.append(coefficient * F.pow(p, n) * F.pow(F.lit(1.0) - p, F.lit(float(k))))
        coefficient = coefficient * (n + F.lit(float(k))) / F.lit(float(k + 1))
    return out


def pmf(mu: Column, k_max: int, family: str = "poisson", alpha: Column | None = None) -> Column:
    """Probabilities of 0..k_max as an array."""
    return F.array(*cells(mu, k_max, family, alpha))


def prefix(terms: list[Column]) -> list[Column]:
    """Running sums."""
    out: list[Column] = []
    for t in terms:
        out.append(out[-1] + t if out else t)
    return out


def cdf(mu: Column, k_max: int, family: str = "poisson", alpha: Column | None = None) -> Column:
    return F.array(*prefix(cells(mu, k_max, family, alpha)))


def survival(mu: Column, threshold: int, family: str = "poisson", alpha: Column | None = None) -> Column:
    """P(X > threshold)."""
    return F.lit(1.0) - prefix(cells(mu, threshold, family, alpha))[-1]


def total(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0.0), lambda s, x: s + x)


def log_pmf(y: Column, mu: Column, family: str = "poisson", alpha: Column | None = None) -> Column:
    """Log probability of an observed count, by sums of logarithms over 1..y."""
    check_family(family, alpha)
    steps = F.when(y > 0, F.sequence(F.lit(1), y.cast("int"))).otherwise(F.array().cast("array<int>"))
    if family == "poisson":
        return y * F.log(mu) - mu - F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    n, p = nb_n_p(mu, alpha)
    rising = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((i - 1 + n) / i))
    return rising + n * F.log(p) + y * F.log(F.lit(1.0) - p)


def convolve(a: Column, b: Column, k_max: int, renormalize: bool = True) -> Column:
    """Probabilities of the sum of two counts on 0..2 k_max, from grids on 0..k_max."""
    def cells(s: Column) -> Column:
        cell = lambda t: F.aggregate(F.sequence(F.greatest(F.lit(0), t - k_max), F.least(t, F.lit(k_max))), F.lit(0.0), lambda x, i: x + s["a"][i] * s["b"][t - i])
        return F.transform(F.sequence(F.lit(0), F.lit(2 * k_max)), cell)

    out = bound(F.struct(a.alias("a"), b.alias("b")), cells)
    return normalized(out) if renormalize else out


def total_pmf(mu_a: Column, mu_b: Column, k_max: int, family: str = "poisson", alpha_a: Column | None = None, alpha_b: Column | None = None, method: str = "convolution", renormalize: bool = True) -> Column:
    """Probabilities of the total: exact convolution of the truncated parts, or the
    closed form of two Poissons."""
    if method == "poisson":
        if family != "poisson":
            raise ValueError("the closed form holds for poisson only")
        out = pmf(mu_a + mu_b, 2 * k_max)
        return normalized(out) if renormalize else out
    if method != "convolution":
        raise ValueError(f"unknown method {method!r}")
    return convolve(pmf(mu_a, k_max, family, alpha_a), pmf(mu_b, k_max, family, alpha_b), k_max, renormalize)


def total_cells(a: Column, b: Column, k_max: int, up_to: int | None = None) -> list[Column]:
    """Cells 0..up_to of the convolution of two array columns, one expression each: for
    grids that are columns already this stays in generated code."""
    last = 2 * k_max if up_to is None else min(up_to, 2 * k_max)
    return [prefix([a[i] * b[t - i] for i in range(max(0, t - k_max), min(t, k_max) + 1)])[-1] for t in range(last + 1)]


def total_survival(grid: Column, threshold: float | Column) -> Column:
    """P(total > threshold) of a grid from 0 on."""
    kept = F.filter(F.transform(grid, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] > threshold)
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["x"])


def clip_mu(mu: Column, low: float = MU_MIN) -> Column:
    finite = mu.isNotNull() & ~F.isnan(mu) & (F.abs(mu) != float("inf"))
    return F.when(finite, F.greatest(mu, F.lit(low))).otherwise(F.lit(low))


def clip_alpha(alpha: Column, low: float = ALPHA_MIN, high: float = ALPHA_MAX) -> Column:
    finite = alpha.isNotNull() & ~F.isnan(alpha) & (F.abs(alpha) != float("inf"))
    return F.when(finite, F.least(F.greatest(alpha, F.lit(low)), F.lit(high))).otherwise(F.lit(low))


def nb_from_count_probs(total_count: Column, probs: Column) -> tuple[Column, Column]:
    """(mu, alpha) from a number of successes and their probability."""
    return total_count * (F.lit(1.0) - probs) / probs, F.lit(1.0) / total_count


def nb_from_concentration_rate(concentration: Column, rate: Column) -> tuple[Column, Column]:
    """(mu, alpha) from a gamma mixture."""
    return concentration / rate, F.lit(1.0) / concentration


def rps_count(y: Column, mu: Column, k_max: int, family: str = "poisson", alpha: Column | None = None) -> Column:
    """Ranked probability score over 0..k_max, not divided by the number of classes."""
    terms = [F.pow(c - F.when(y <= k, 1.0).otherwise(0.0), F.lit(2.0)) for k, c in enumerate(prefix(cells(mu, k_max, family, alpha)))]
    return prefix(terms)[-1]
