"""Poisson and chi-square tails as Columns: no lgamma and no Python needed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FLOOR, LOG_ZERO = 1e-10, -99.0


def log_poisson_sf(k: Column, rate: Column) -> Column:
    """ln P(X > k) of a Poisson variable; ``rate`` is floored at 1e-10.

    Above the mean: the tail's first term times a series of ratios, which does
    not cancel. Below: one minus the head, from its last term down. Both sums
    are nested products with one running number; the series needs about
    10 sqrt(k) terms where its ratios are nearest to one.
    """
    k, lam = k.cast("int"), F.greatest(F.lit(FLOOR), rate.cast("double"))
    ln_fact = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))
    terms = (20 + 10 * F.sqrt(k + 1.0)).cast("int")
    tail = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, m: (s + 1) * lam / (k + 1 + m))
    head = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda s, j: s * j / lam + 1)
    head = F.when(k == 0, 1.0).otherwise(head) * F.exp(-lam + k * F.log(lam) - ln_fact)
    return F.when(k + 1 >= lam, -lam + (k + 1) * F.log(lam) - ln_fact - F.log(k + 1.0) + F.log1p(tail)).otherwise(F.log1p(-head))


def fisher(log_p: Column, n: Column) -> Column:
    """Fisher's combination of n tests whose log probabilities sum to ``log_p`` (only below 0)."""
    x = -log_p
    # 1 + x/1 (1 + x/2 (1 + ...)), from the inside
    series = F.when(n <= 1, 1.0).otherwise(F.aggregate(F.sequence(n.cast("int") - 1, F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, i: s * x / i + 1))
    log_q = log_p + F.log(series)
    return F.when(log_p < 0, F.when(log_q > LOG_ZERO, log_q).otherwise(LOG_ZERO)).otherwise(log_p)


def phred(log_p: Column) -> Column:
    """Whole-number quality, 99 at most."""
    q = -10.0 * log_p / F.log(F.lit(10.0))
    return F.when(q > 99, 99).otherwise((q + 0.5).cast("int"))
