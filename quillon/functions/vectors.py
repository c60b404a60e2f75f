"""Column functions on arrays of doubles; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value, f) -> Column:
    """f of a value that is worked out once: the optimizer may copy a plain expression into every element's lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def subtract(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hadamard(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def distance(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def softmax(a) -> Column:
    """exp(x - max) over its sum; the maximum and the sum are worked out once an array."""
    a = F.col(a) if isinstance(a, str) else a
    shifted = once(F.struct(a.alias("a"), F.array_max(a).alias("m")), lambda s: F.transform(s["a"], lambda x: F.exp(x - s["m"])))
    return once(once(shifted, lambda e: F.struct(e.alias("e"), total(e).alias("t"))), lambda s: F.transform(s["e"], lambda x: x / s["t"]))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x) -> Column:
    return F.greatest(x, F.lit(0.0))


def argmax(a) -> Column:
    """0-based index of the largest element, the first on ties."""
    return F.array_position(a, F.array_max(a)) - 1


def rank_of(scores, label, tie: str = "pessimistic") -> Column:
    """Rank of scores[label], 1 for the best.

    tie: "pessimistic" counts equal scores before it, "optimistic" none, "lower_index" those
    of lower classes, "higher_index" those of higher classes.
    """
    own = F.element_at(scores, label + 1)
    if tie == "pessimistic":
        return F.size(F.filter(scores, lambda s: s >= own))
    better = F.size(F.filter(scores, lambda s: s > own)) + 1
    if tie == "optimistic":
        return better
    side = {"lower_index": lambda i: i < label, "higher_index": lambda i: i > label}[tie]
    return better + F.size(F.filter(scores, lambda s, i: (s == own) & side(i)))
