"""Column expressions over array<double> vectors. All fold from the left, so results are exact and repeatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def doubles(col: Column | str) -> Column:
    return F.transform(F.col(col) if isinstance(col, str) else col, lambda x: x.cast("double"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once a row: inside a lambda an expression is computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(col: Column) -> Column:
    return F.try_divide(total(col), F.size(col).cast("double"))


def var_pop(col: Column) -> Column:
    return let(col, lambda c: let(mean(c), lambda m: mean(F.transform(c, lambda x: (x - m) * (x - m)))))


def l2_normalize(col: Column) -> Column:
    """Divide by the Euclidean norm, which is floored so that a zero vector stays zero."""
    norm = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(NORM_FLOOR))
    return let(col, lambda c: let(norm(c), lambda n: F.transform(c, lambda x: x / n)))


def concat_normalised(*parts: Column) -> Column:
    """Normalise each part, join them, normalise the whole: parts weigh alike."""
    return l2_normalize(F.concat(*[l2_normalize(p) for p in parts]))


def pool(strategy: str, cls: Column, patch_mean: Column, cls_layers: Column | None = None) -> Column:
    """Pool encoder tokens. ``cls_layers`` is an array of the last four layers' class tokens."""
    if strategy not in POOLING_WIDTH:
        raise ValueError(f"unknown pooling: {strategy}")
    if "last4" in strategy and cls_layers is None:
        raise ValueError(f"{strategy} needs the last four layers")
    layers = [] if cls_layers is None else [F.element_at(cls_layers, k) for k in (1, 2, 3, 4)]
    parts = {"cls": [cls], "cls_patchmean": [cls, patch_mean], "cls_last4": layers, "cls_last4_patchmean": [*layers, patch_mean]}[strategy]
    return concat_normalised(*parts)


#: Output width as a multiple of the token width.
POOLING_WIDTH = {"cls": 1, "cls_patchmean": 2, "cls_last4": 4, "cls_last4_patchmean": 5}


def round_all(col: Column, digits: int = 8) -> Column:
    return F.transform(col, lambda x: F.round(x, digits))


def sigmoid(z: Column) -> Column:
    """Logistic function in two branches, so that neither overflows."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
