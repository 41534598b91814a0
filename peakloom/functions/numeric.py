"""Column functions on vectors and probability distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_betas(steps: int, s: float = 0.008) -> list[float]:
    """Noise of each step of the cosine schedule, at most 0.999."""
    kept = [math.cos((t / steps + s) / (1 + s) * math.pi / 2) ** 2 for t in range(steps + 1)]
    return [min(1 - kept[t + 1] / kept[t], 0.999) for t in range(steps)]


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def mixture(log_x: Column, log_keep: float, log_leave: float, classes: int) -> Column:
    """Log-probabilities after keeping each class or leaving it for one at random."""
    away = F.lit(log_leave - math.log(classes))
    return F.transform(log_x, lambda v: log_add_exp(v + log_keep, away))


def kl_divergence(log_p: Column, log_q: Column) -> Column:
    """Sum of p * (log p - log q) over the classes of two distributions."""
    parts = F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def warmup_factor(step: Column, warmup: int, max_steps: int | None = None) -> Column:
    """Learning-rate factor: cosine decay over max_steps if given, times a linear warm-up."""
    base = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * step / max_steps)) if max_steps else F.lit(1.0)
    return base * F.least(F.lit(1.0), step / warmup)


def sinusoids(position: Column, dimension: int, base: float = 10000.0) -> Column:
    """Sines and cosines of a position at geometric wavelengths, alternating."""
    rates = [math.exp(-math.log(base) * 2 * i / dimension) for i in range(dimension // 2)]
    return F.array(*[f(position * r) for r in rates for f in (F.sin, F.cos)])


def pooled(vectors: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of a list of vectors, those whose mask is true left out. max takes zero for absent."""
    dims = F.size(F.get(vectors, 0))
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: ~x["m"]), lambda x: x["v"])
    over = F.sequence(F.lit(0), dims - 1)
    if how == "max":
        return F.transform(over, lambda d: F.array_max(F.transform(kept, lambda v: F.when(F.get(v, d) != 0, F.get(v, d)))))
    sums = F.transform(over, lambda d: F.aggregate(kept, F.lit(0.0), lambda a, v: a + F.get(v, d)))
    if how == "sum":
        return sums
    if how != "mean":
        raise ValueError(f"no such pooling: {how}")
    return F.transform(sums, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
