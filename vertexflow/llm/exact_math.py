"""Exact discrete distributions as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest exact sum; what is left of a longer one is bounded by a geometric series.
TERMS = 20000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once; a Column used twice would stand twice in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 11, within 1e-10."""

    def series(n: Column) -> Column:
        x = n + 11.0
        below = F.log((n + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * (n + 6) * (n + 7) * (n + 8) * (n + 9) * (n + 10))
        return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) - below

    return let(n.cast("double"), series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p); 1 where k is not below the mean, where no bound is to be had."""
    k, n = k.cast("long"), n.cast("long")
    last = log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    # below the mean, each term going down is a smaller fraction of the one before
    ratio = (k - TERMS) / (n - k + TERMS + 1) * odds

    def close(acc: Column) -> Column:
        return acc["sum"] + F.when(k > TERMS, acc["term"] * ratio / (1 - ratio)).otherwise(0.0)

    steps = F.when(k > 0, F.sequence(F.lit(1), F.least(k, F.lit(TERMS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(last) * F.aggregate(steps, start, add, close)))


def hypergeometric_draw(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked ones among `drawn` out of `total`, by inverting the distribution function at u in [0, 1).

    Sums over the support within 12 standard deviations of the mean, beyond which lies less than 1e-20.
    """
    given = F.struct(total.cast("long").alias("t"), marked.cast("long").alias("m"), drawn.cast("long").alias("d"), u.alias("u"))

    def spread(g: Column) -> Column:
        mean = g["d"] * g["m"] / F.greatest(g["t"], F.lit(1))
        share = (g["t"] - g["m"]) / F.greatest(g["t"], F.lit(1)) * (g["t"] - g["d"]) / F.greatest(g["t"] - 1, F.lit(1))
        return F.struct(g.alias("g"), mean.alias("mean"), (12 * F.sqrt(mean * share) + 12).alias("reach"))

    def support(s: Column) -> Column:
        g = s["g"]
        first = F.greatest(F.lit(0), g["d"] - (g["t"] - g["m"]), F.floor(s["mean"] - s["reach"]).cast("long"))
        last = F.least(g["m"], g["d"], F.ceil(s["mean"] + s["reach"]).cast("long"))
        return F.struct(g.alias("g"), first.alias("first"), last.alias("last"))

    def start(s: Column) -> Column:
        g = s["g"]
        p = F.exp(log_choose(g["m"], s["first"]) + log_choose(g["t"] - g["m"], g["d"] - s["first"]) - log_choose(g["t"], g["d"]))
        return F.struct(g.alias("g"), s["first"].alias("first"), s["last"].alias("last"), p.alias("p"))

    def invert(s: Column) -> Column:
        g = s["g"]

        def step(acc: Column, _: Column) -> Column:
            x = acc["x"] + 1
            p = acc["p"] * (g["m"] - acc["x"]) / x * (g["d"] - acc["x"]) / F.greatest(g["t"] - g["m"] - g["d"] + x, F.lit(1))
            return F.when(acc["cum"] <= g["u"], let(p, lambda p: F.struct(p.alias("p"), (acc["cum"] + p).alias("cum"), x.alias("x")))).otherwise(acc)

        steps = F.when(s["last"] > s["first"], F.sequence(s["first"] + 1, s["last"])).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, F.struct(s["p"].alias("p"), s["p"].alias("cum"), s["first"].alias("x")), step, lambda acc: acc["x"])

    return let(let(let(let(given, spread), support), start), invert)
