"""Seats of customers at tables, for many dishes side by side, sampled by Gibbs.

Dish i has `count[i]` customers at `tables[i]` tables; `sizes` holds all
customers per table, dish after dish.  Given everything else the seating of a
dish has the law

    prod of a(j) for j = 1 .. tables - 1,  times  prod of (1 - d)(2 - d) .. (n - 1 - d) over its table sizes n,

where a(j) weighs a further table when the dish has j of them: the restaurant's
share (theta + d (others + j)) times the parent's probability of the dish, in
which the dish's own j tables count as customers.  Two moves keep this law:

* one customer is taken out and seated given all others: at a table of n
  customers with weight n - d, at a new one with weight a(j);
* some of a dish's tables are taken out and new ones come in.  Tables
  other than a marked one are a Poisson number of Sibuya sizes up to a factor
  that depends on their number and on the marked table, which decides whether
  the exchange is kept.  It renews dishes of any count in one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Terms drawn one by one in the sums behind theta and d; the tail beyond is Poisson.
EXACT_TERMS = 1 << 16


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: Stirling's series from 8 on."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low -= np.log(np.where(small, y, 1.0))
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series + low


def log_rising(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log of x (x + 1) .. (x + k - 1); far from zero by the middle factor, where differences of lgamma lose digits."""
    far = np.asarray(x, float) > 1e7
    near = np.where(far, 1.0, x)
    return np.where(far, k * np.log(x + (k - 1) / 2), lgamma(near + k) - lgamma(near))


@dataclass
class Weights:
    """What a(j) is made of, all without the dish's own tables."""

    theta: float
    discount: float
    others: np.ndarray  # other tables of the restaurant
    own: np.ndarray  # the parent's mass of the dish
    all: np.ndarray  # the parent's mass
    step: int = 1  # mass that an own table adds at the parent; 0: the parent is a fixed base

    def of(self, at: np.ndarray) -> Weights:
        return Weights(self.theta, self.discount, self.others[at], self.own[at], self.all[at], self.step)

    def opening(self, j: np.ndarray) -> np.ndarray:
        return (self.theta + self.discount * (self.others + j)) * (self.own + self.step * j) / (self.all + self.step * j)

    def log_openings(self, k: np.ndarray) -> np.ndarray:
        """log of a(1) .. a(k)."""
        out = k * np.log(self.discount) + log_rising(self.theta / self.discount + self.others + 1, k)
        if self.step:
            return out + log_rising(self.own + 1, k) - log_rising(self.all + 1, k)
        return out + k * np.log(self.own / self.all)


class Seats:
    def __init__(self, count: np.ndarray, tables: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.count = count.astype(np.int64)
        self.tables = np.ones(len(count), np.int64) if tables is None else tables.astype(np.int64)
        self.sizes = self.count.copy() if sizes is None else sizes.astype(np.int64)

    def _first(self) -> np.ndarray:
        return np.cumsum(self.tables) - self.tables

    def _of_random_customer(self, dish: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The table of a customer of each dish, all customers alike."""
        before = np.cumsum(self.count) - self.count
        at = before[dish] + (rng.random(len(dish)) * self.count[dish]).astype(np.int64)
        return np.searchsorted(np.cumsum(self.sizes), at, "right")

    def one_customer(self, dish: np.ndarray, w: Weights, rng: np.random.Generator) -> None:
        """One customer of each of these dishes (of two customers at least) leaves and is seated given all others."""
        d = w.discount
        table = self._of_random_customer(dish, rng)
        self.sizes[table] -= 1
        emptied = self.sizes[table] == 0
        left = self.tables[dish] - emptied
        seated = self.count[dish] - 1 - d * left
        u = rng.random(len(dish)) * (seated + w.opening(left))
        opens = u >= seated
        # by weight among the tables that are left
        weight = np.cumsum(np.where(self.sizes > 0, self.sizes - d, 0.0))
        first = self._first()[dish]
        last = first + self.tables[dish] - 1
        at = np.clip(np.searchsorted(weight, np.where(first > 0, weight[first - 1], 0.0) + u, "right"), first, last)
        at = np.where(opens | (self.sizes[at] == 0), table, at)  # rounding can point at the emptied one: the customer stays
        stays = opens & emptied | ~opens
        self.sizes[np.where(opens, table, at)[stays]] += 1
        new = opens & ~emptied
        gone = np.flatnonzero(self.sizes == 0)
        self.tables[dish] += new.astype(np.int64)
        lost = emptied & ~opens & (self.sizes[table] == 0)
        self.tables[dish] -= lost
        if new.any() or len(gone):
            sizes = np.insert(self.sizes, last[new] + 1, 1)
            self.sizes = sizes[sizes > 0]

    def some_tables(self, dish: np.ndarray, w: Weights, rng: np.random.Generator) -> None:
        """A share of each dish's tables but a marked one leaves, others come; kept or undone by the law's ratio.

        The share is 1/2 to 1/16 by chance, so that dishes of many tables change by steps that are likely to be kept.
        """
        d, n = w.discount, len(dish)
        marked = self._of_random_customer(dish, rng)
        owner = np.repeat(np.arange(len(self.count)), self.tables)
        place = np.full(len(self.count), -1)
        place[dish] = np.arange(n)
        share = 0.5 ** rng.integers(1, 5, n)
        part = np.zeros(len(self.count))
        part[dish] = share
        leaves = rng.random(len(owner)) < part[owner]
        leaves[marked] = False
        out = np.flatnonzero(leaves)
        gone_n = np.bincount(place[owner[out]], minlength=n)
        gone = np.bincount(place[owner[out]], self.sizes[out], n).astype(np.int64)
        rate = np.minimum(w.opening(np.ones(n)) / d, self.count[dish])
        whose = np.repeat(np.arange(n), rng.poisson(rate * share))
        size = rng.geometric(np.maximum(rng.beta(d, 1 - d, len(whose)), 1e-15))
        fits = (size > 0) & (size < self.count[dish[whose]])  # no other table is as large as all
        whose, size = whose[fits], size[fits]
        come_n = np.bincount(whose, minlength=n)
        come = np.bincount(whose, size, n).astype(np.int64)
        r1 = self.sizes[marked]
        r2 = r1 + gone - come
        k1 = self.tables[dish] - 1
        k2 = k1 - gone_n + come_n
        ok = (r2 >= 1) & (gone_n + come_n > 0)
        t = np.flatnonzero(ok)
        part_of = w.of(t)
        ratio = part_of.log_openings(k2[t]) - part_of.log_openings(k1[t]) - (k2[t] - k1[t]) * np.log(d * rate[t])
        ratio += lgamma(r2[t] - d) - lgamma(r2[t]) - lgamma(r1[t] - d) + lgamma(r1[t])
        ok[t] = np.log(rng.random(len(t))) < ratio
        self.sizes[marked[ok]] = r2[ok]
        self.tables[dish[ok]] = k2[ok] + 1
        keep = np.ones(len(self.sizes), bool)
        keep[out[ok[place[owner[out]]]]] = False
        new = ok[whose]
        owner = np.concatenate((owner[keep], dish[whose[new]]))
        sizes = np.concatenate((self.sizes[keep], size[new]))
        self.sizes = sizes[np.argsort(owner, kind="stable")]

    def follow(self, count: np.ndarray, rng: np.random.Generator) -> None:
        """As many customers as `count` says: more join a random customer's table, fewer leave one table after another."""
        more = count - self.count
        dish = np.flatnonzero(more > 0)
        if len(dish):
            np.add.at(self.sizes, self._of_random_customer(dish, rng), more[dish])
            self.count[dish] = count[dish]
        while len(dish := np.flatnonzero(self.count > count)):
            table = self._of_random_customer(dish, rng)
            leave = np.minimum(self.sizes[table], self.count[dish] - count[dish])
            self.sizes[table] -= leave
            self.count[dish] -= leave
            self.tables[dish] -= self.sizes[table] == 0
            self.sizes = self.sizes[self.sizes > 0]


def _ones(at_least: np.ndarray, p, tail, rng: np.random.Generator) -> float:
    """Sum of draws, of Bernoulli(p(i)) for i = 1 .. n - 1 for every n; far terms as one Poisson draw of mean tail(lo, hi)."""
    n = at_least[at_least > 1]
    if not len(n):
        return 0.0
    near = np.bincount(np.minimum(n, EXACT_TERMS))
    above = np.cumsum(near[::-1])[::-1][2:]  # how many n exceed i = 1, 2, ..
    i = np.arange(1, len(above) + 1)
    total = float(rng.binomial(above, np.clip(p(i), 0, 1)).sum())
    far = n[n > EXACT_TERMS]
    return total + float(rng.poisson(tail(float(EXACT_TERMS), far.astype(float)).sum())) if len(far) else total


def theta_sums(customers: np.ndarray, tables: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Auxiliary draws over restaurants, for theta and d: (ones, zeros, sum of -log x)."""
    has = customers > 1
    x = -np.log(np.maximum(rng.beta(theta + 1, customers[has] - 1), 1e-300)).sum()
    ones = _ones(tables, lambda i: theta / (theta + d * i), lambda a, b: theta / d * np.log((b + theta / d) / (a + theta / d)), rng)
    return np.array([ones, np.maximum(tables - 1, 0).sum() - ones, x])


def discount_sum(sizes: np.ndarray, d: float, rng: np.random.Generator) -> float:
    """Auxiliary draws over tables, for d."""
    return _ones(sizes, lambda i: (1 - d) / (i - d), lambda a, b: (1 - d) * np.log((b - d) / (a - d)), rng)


def draw_parameters(ones: float, zeros: float, x: float, z: float, rng: np.random.Generator) -> tuple[float, float]:
    """theta and d given the auxiliary sums, with flat priors of weight one."""
    theta = rng.gamma(1 + ones, 1 / (1 + x))
    return max(theta, 1e-3), min(0.98, max(0.02, rng.beta(1 + zeros, 1 + z)))


def sweep(seats: Seats, weights: Callable[[np.ndarray], Weights], rng: np.random.Generator, rounds: int = 8, renewals: int = 2) -> None:
    """`rounds` times one customer, then `renewals` times some tables, each for a random half of the dishes with two customers at least.

    `weights` is asked anew for each half, so that it can follow the tables of the others.
    """
    many = np.flatnonzero(seats.count > 1)
    for k in range(rounds + renewals):
        half = many[rng.random(len(many)) < 0.5]
        if len(half):
            (seats.one_customer if k < rounds else seats.some_tables)(half, weights(half), rng)
