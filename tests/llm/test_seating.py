"""Numbers of tables against their exact distribution and a sampler that moves one customer at a time."""

import numpy as np
import pytest

from svloom.llm import seating


def stirling_rows(most, d):
    """log S(n, 1..n) for each n, from the recursion in plain steps."""
    rows = [np.array([0.0])]
    for n in range(1, most):
        last = rows[-1]
        t = np.arange(1, n + 1)
        stay = np.append(last + np.log(n - d * t), -np.inf)
        rows.append(np.logaddexp(stay, np.concatenate(([-np.inf], last))))
    return rows


def law(n, strength, p, d, rows):
    """Exact distribution of the tables, 1..n, where the j-th has base p[j]."""
    w = rows[n - 1] + np.cumsum(np.log(strength + d * np.arange(n)) + np.log(p))
    w = np.exp(w - w.max())
    return w / w.sum()


def one_by_one(n, strength, p, d, rng, sweeps):
    """Mean tables by unseating and seating one customer at a time; tables have sizes."""
    sizes, seen = [1] * n, []
    for sweep in range(sweeps):
        for _ in range(n):
            k = rng.choice(len(sizes), p=np.array(sizes) / n)
            sizes[k] -= 1
            if not sizes[k]:
                sizes.pop(k)
            w = np.array([*(s - d for s in sizes), (strength + d * len(sizes)) * p])
            k = rng.choice(len(w), p=w / w.sum())
            if k == len(sizes):
                sizes.append(1)
            else:
                sizes[k] += 1
        if sweep > sweeps // 10:
            seen.append(len(sizes))
    return np.mean(seen)


@pytest.mark.parametrize("d", [0.8, 0.9])
def test_stirling_numbers_equal_the_recursion(d):
    rows = stirling_rows(1500, d)
    table = seating.stirling(d)
    for n in (1, 2, 7, seating.EXACT):
        assert np.allclose(table[n, 1 : n + 1], rows[n - 1], atol=1e-9)
    for n in (129, 400, 1500):
        apart = seating.log_stirling(np.full(n, float(n)), np.arange(1.0, n + 1), d) - rows[n - 1]
        assert np.abs(apart[: n * 9 // 10]).max() < 0.05  # the saddle point, where the series ends
        assert np.abs(apart).max() < 0.3  # all but every customer at a table of their own


@pytest.mark.parametrize(("n", "others", "p"), [(5, 1000, 0.001), (20, 1000, 0.001), (100, 1000, 0.001), (20, 0, 0.1), (300, 1000, 0.001), (700, 3000, 0.05)])
def test_tables_follow_their_exact_law(n, others, p):
    d, m, rng = 0.9, 3000, np.random.default_rng(n)
    strength = 1 + d * others
    got = np.ones(m)
    for sweep in range(4):
        got = seating.seat(np.full(m, float(n)), got, np.full(m, strength), seating.Constant(np.full(m, p)), d, rng, sweep == 0)
    want = law(n, strength, np.full(n, p), d, stirling_rows(n, d))
    t = np.arange(1, n + 1)
    mean = (want * t).sum()
    deviation = ((want * (t - mean) ** 2).sum()) ** 0.5
    assert abs(got.mean() - mean) < 5 * deviation / m**0.5
    assert abs(got.std() - deviation) < 0.12 * deviation


def test_tables_follow_one_customer_at_a_time():
    rng = np.random.default_rng(3)
    for n, others, p in ((5, 1000, 0.001), (12, 3, 0.2)):
        strength, m = 1 + 0.9 * others, 20_000
        got = seating.seat(np.full(m, float(n)), np.ones(m), np.full(m, strength), seating.Constant(np.full(m, p)), 0.9, rng)
        assert abs(got.mean() - one_by_one(n, strength, p, 0.9, rng, 4000)) < 0.12


def test_a_base_that_grows_with_the_tables_and_odd_counts():
    rng, m = np.random.default_rng(4), 4000
    full = lambda x: np.full(m, x)
    base = seating.Base(full(0.01), full(0.25), full(40.0))
    for n in (6, 200):
        got = full(1.0)
        for sweep in range(4):
            got = seating.seat(full(float(n)), got, full(30.0), base, 0.9, rng, sweep == 0)
        j = np.arange(n)
        p = np.where(j == 0, 0.01, 0.25 + j) / (40.0 + j)
        want = law(n, 30.0, p, 0.9, stirling_rows(n, 0.9))
        t = np.arange(1, n + 1)
        mean = (want * t).sum()
        assert abs(got.mean() - mean) < 5 * ((want * (t - mean) ** 2).sum() / m) ** 0.5
    got = seating.seat(np.array([0.0, 1.0, 1e7]), np.ones(3), np.full(3, 1e5), seating.Constant(np.full(3, 1e-4)), 0.9, rng, True)
    assert got[:2].tolist() == [0, 1] and 1 <= got[2] <= 1e7
