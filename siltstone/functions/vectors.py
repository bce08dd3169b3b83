"""Array expressions: similarity kernels and row-wise score transforms. Null elements are masked cells where stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    """Sum from left to right; null elements count nothing."""
    return F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + F.coalesce(x, F.lit(0.0).cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def chunks(v: Column, n: int, width: int) -> Column:
    """A flat vector as n token vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * width + 1, F.lit(width)))


def maxsim(q: Column, d: Column, floor_at_zero: bool = False) -> Column:
    """Sum over query tokens of the best dot product with a document token; optionally each best is at least 0, as zero padding makes it."""
    best = lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))
    return total(F.transform(q, lambda x: F.greatest(best(x), F.lit(0.0)) if floor_at_zero else best(x)))


def meanmaxsim(q: Column, d: Column) -> Column:
    return maxsim(q, d) / F.greatest(F.size(q), F.lit(1))


def unmasked(tokens: Column, mask: Column) -> Column:
    """The tokens whose mask is true; a null or missing mask element masks its token."""
    return F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m, t)), lambda t: t.isNotNull())


def skiplist_mask(tokens: Column, skip: list, attention: Column | None = None) -> Column:
    """True for each token that is not in the skip list and, with `attention` (1 or 0 a token), no padding; a null token is false."""
    kept = lambda t: t.isNotNull() & (~F.coalesce(t.isin(skip), F.lit(False)) if skip else F.lit(True))
    if attention is None:
        return F.transform(tokens, kept)
    return F.zip_with(tokens, attention, lambda t, a: kept(t) & F.coalesce(a.cast("boolean"), F.lit(False)))


def masked_maxsim(q: Column, d: Column, q_mask: Column | None, d_mask: Column, mean: bool = False) -> Column:
    """MaxSim (or its mean over the query's unmasked tokens) of unmasked tokens only; 0 where either side has none. Without a query mask, as with query expansion, all its tokens count."""
    return (meanmaxsim if mean else maxsim)(q if q_mask is None else unmasked(q, q_mask), unmasked(d, d_mask))


def l2_normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def minmax(xs: Column, eps: float = 1e-8) -> Column:
    low, high = F.array_min(xs), F.array_max(xs)
    return F.transform(xs, lambda x: (x - low) / (high - low + F.lit(eps)))


def clipped(xs: Column, low: Column, high: Column) -> Column:
    return F.transform(xs, lambda x: F.least(F.greatest(x, low), high))


def logsumexp(xs: Column) -> Column:
    """Over the elements that are not null."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + F.coalesce(F.exp(x - top), F.lit(0.0))))


def log_softmax(xs: Column, tau: float = 1.0) -> Column:
    scaled = F.transform(xs, lambda x: x / F.lit(float(tau)))
    lse = logsumexp(scaled)
    return F.transform(scaled, lambda x: x - lse)


def argmax(xs: Column) -> Column:
    """1-based place of the first greatest element."""
    return F.array_position(xs, F.array_max(xs))
