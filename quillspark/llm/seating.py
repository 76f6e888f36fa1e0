"""Chinese-restaurant seating with two parameters: numbers of tables drawn by Gibbs, and likelihoods of its parameters.

The customers of one dish in one restaurant leave and return together: their number of tables is drawn from its
conditional distribution given all other dishes, which needs generalised Stirling numbers. They come from their recursion
up to LIMIT customers, beyond it from a series or a saddle point (tests hold them against exact values), where the draw is
a number of Metropolis steps. So the work follows the customers up to LIMIT and a constant beyond; none is left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LIMIT = 256
#: Values among which discount and strength are drawn.
DISCOUNTS = np.round(np.linspace(0.05, 0.95, 19), 2)
STRENGTHS = np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0])
#: Pairs of one restaurant are drawn in this many turns at most, each given the tables of the turns before.
TURNS = 16
#: Metropolis steps of a large pair in one sweep.
STEPS = 4


def log_gamma(x) -> np.ndarray:
    x = np.asarray(x, np.float64)
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


@lru_cache(maxsize=32)
def stirling_table(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, for c and t up to LIMIT."""
    table = np.full((LIMIT + 1, LIMIT + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(1, LIMIT + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, LIMIT + 1):
            joined = np.log(np.maximum(c - 1 - discount * t, 0.0)) + table[c - 1, 1:]
            table[c, 1:] = np.logaddexp(table[c - 1, :-1], joined)
    return table


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """c! / t! times the coefficient of x^c in ((1 - (1 - x)^d) / d)^t, for 1 < t < c."""
    want = np.log(c / t)
    low, high = np.full(len(c), -650.0), np.full(len(c), -1e-12)  # of log(1 - x)

    def slope(ly):
        return np.log(-np.expm1(ly)) + np.log(d) + (d - 1) * ly - np.log(-np.expm1(d * ly))

    for _ in range(14):
        mid = (low + high) / 2
        over = slope(mid) > want
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    ly = (low + high) / 2
    for _ in range(4):  # Newton's steps
        steep = np.exp(ly) / np.expm1(ly) - (1 - d) - d * np.exp(d * ly) / np.expm1(d * ly)
        ly = np.clip(ly - (slope(ly) - want) / steep, low, high)
    x, h = -np.expm1(ly), np.exp(slope(ly))
    log_f = np.log(-np.expm1(d * ly) / d)
    spread = h * (1 + (1 - d) * x * np.exp(-ly) - h)
    return log_gamma(c + 1.0) - log_gamma(t + 1.0) + t * log_f - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * np.maximum(spread, 1e-300))


def _series(c: np.ndarray, t: np.ndarray, d: float, terms: int = 40) -> np.ndarray:
    """The same where t is under c^d, from the expansion around x = 1: an alternating sum of at most t terms."""
    j = np.arange(1, terms + 1)
    sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * j * d)
    c, t = c[:, None], t[:, None]
    reach = np.minimum(j, t)
    size = log_gamma(t + 1) - log_gamma(reach + 1.0) - log_gamma(t - reach + 1) + log_gamma(c - j * d) + log_gamma(1 + j * d)
    total = (np.where(j <= t, sign, 0.0) * np.exp(size - size[:, :1])).sum(axis=1)
    return size[:, 0] + np.log(np.maximum(total, 1e-300) / np.pi) - t[:, 0] * np.log(d) - log_gamma(t[:, 0] + 1)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    c, t = np.asarray(c, np.int64), np.asarray(t, np.int64)
    out = stirling_table(discount)[np.minimum(c, LIMIT), np.minimum(t, LIMIT)]
    large = np.flatnonzero(c > LIMIT)
    if len(large):
        a, b = c[large].astype(np.float64), t[large].astype(np.float64)
        found = np.where(b == a, 0.0, log_gamma(a - discount) - log_gamma(1 - discount))
        few = (b > 1) & (b < a) & (b < a**discount)
        found[few] = _series(a[few], b[few], discount)
        many = (b > 1) & (b < a) & ~few
        found[many] = _saddle(a[many], b[many], discount)
        out[large] = np.where((b < 1) | (b > a), -np.inf, found)
    return out


def first_tables(counts: np.ndarray) -> np.ndarray:
    """A seating to begin with."""
    return np.where(counts > LIMIT, 1 + np.log2(np.maximum(counts, 1)).astype(np.int64), np.minimum(counts, 1))


def _turns(group: np.ndarray) -> list[np.ndarray]:
    """Places of `group` (sorted restaurants), in turns that hold a small share of each restaurant."""
    if not len(group):
        return []
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[heads, len(group)])
    rank, n = np.arange(len(group)) - np.repeat(heads, sizes), np.repeat(sizes, sizes)
    turn = np.where(n <= TURNS, rank, rank * TURNS // n)
    order = np.argsort(turn, kind="stable")
    return np.split(order, np.cumsum(np.bincount(turn))[:-1])


class Restaurants:
    """Dishes (restaurant, customers, tables), sorted by restaurant; `others`: tables of a restaurant that stand elsewhere."""

    def __init__(self, restaurant: np.ndarray, counts: np.ndarray, tables: np.ndarray, n: int, others: np.ndarray | None = None):
        self.restaurant, self.counts, self.tables, self.n = restaurant, counts, tables, n
        self.others = np.zeros(n, np.int64) if others is None else others
        self.whole = self.others + np.bincount(restaurant, tables, n).astype(np.int64)
        self.work: list[tuple[int, list[np.ndarray]]] = []
        top = 2
        while top <= LIMIT:
            at = np.flatnonzero((counts > top // 2) & (counts <= top)) if top > 2 else np.flatnonzero(counts == 2)
            self.work.append((top, [at[x] for x in _turns(restaurant[at])]))
            top *= 2
        at = np.flatnonzero(counts > LIMIT)
        self.work.append((0, [at[x] for x in _turns(restaurant[at])]))

    def sweep(self, log_parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> None:
        """Every dish's customers leave and return once, given the parent's probability of each dish."""
        for top, turns in self.work:
            step = max(1, 2_000_000 // max(1, top))
            for turn in turns:
                for a in range(0, len(turn), step):
                    at = turn[a : a + step]
                    rest = self.whole[self.restaurant[at]] - self.tables[at]
                    draw = self._small(at, rest, log_parent[at], strength, discount, top, rng) if top else self._large(at, rest, log_parent[at], strength, discount, rng)
                    np.add.at(self.whole, self.restaurant[at], draw - self.tables[at])
                    self.tables[at] = draw

    def _small(self, at, rest, log_parent, strength, discount, top, rng) -> np.ndarray:
        weight = np.log(strength + discount * (rest[:, None] + np.arange(top)))
        weight += log_parent[:, None]
        np.cumsum(weight, axis=1, out=weight)
        weight += stirling_table(discount)[:, 1 : top + 1][self.counts[at]]
        weight -= weight.max(axis=1, keepdims=True)
        np.exp(weight, out=weight)
        np.cumsum(weight, axis=1, out=weight)
        return 1 + (weight < (rng.random(len(at)) * weight[:, -1])[:, None]).sum(axis=1)

    def _large(self, at, rest, log_parent, strength, discount, rng) -> np.ndarray:
        c, t, ratio = self.counts[at], self.tables[at].copy(), strength / discount

        def log_weight(t):
            inside = np.clip(t, 1, c)
            return log_stirling(c, inside, discount) + inside * (log_parent + np.log(discount)) + log_gamma(ratio + rest + inside)

        now = log_weight(t)
        for reach in 1 << rng.integers(0, 8, STEPS):
            new = t + rng.integers(1, reach + 1, len(t)) * rng.choice([-1, 1], len(t))
            then = log_weight(new)
            taken = (new >= 1) & (new <= c) & (np.log(rng.random(len(t))) < then - now)
            t, now = np.where(taken, new, t), np.where(taken, then, now)
        return t


def tables_likelihood(counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each of DISCOUNTS: sum of the dishes' log Stirling numbers."""
    at = counts > 1
    if not at.any():
        return np.zeros(len(DISCOUNTS))
    order = np.lexsort((tables[at], counts[at]))
    c, t = counts[at][order], tables[at][order]
    heads = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])])
    n = np.diff(np.r_[heads, len(c)])
    return np.array([float((log_stirling(c[heads], t[heads], float(d)) * n).sum()) for d in DISCOUNTS])


def restaurants_likelihood(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Of DISCOUNTS x STRENGTHS: sum over restaurants of log(opening these tables) less log(seating these customers)."""
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    t, n_t = np.unique(tables[tables > 0], return_counts=True)
    c, n_c = np.unique(customers[customers > 0], return_counts=True)
    for j, s in enumerate(STRENGTHS):
        seated = float(((log_gamma(s + c) - log_gamma(s)) * n_c).sum())
        for i, d in enumerate(DISCOUNTS):
            out[i, j] = float(((t * np.log(d) + log_gamma(s / d + t) - log_gamma(s / d)) * n_t).sum()) - seated
    return out


def draw_parameters(likelihood: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """(discount, strength) from their grid, given its log likelihood."""
    p = np.exp(likelihood - likelihood.max()).ravel()
    i, j = np.unravel_index(rng.choice(len(p), p=p / p.sum()), likelihood.shape)
    return float(DISCOUNTS[i]), float(STRENGTHS[j])
