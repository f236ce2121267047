"""Pixel operators over a flattened row-major canvas (array<double>), without an image library."""

from __future__ import annotations

from math import cos, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetra.functions.vectors import let, mean, total, var_pop


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def take(canvas: Column, places: list[int]) -> Column:
    """The canvas at the given 0-based places."""
    return let(canvas, lambda c: F.transform(longs(places), lambda i: F.get(c, i)))


def dihedral_places(side: int) -> list[list[int]]:
    """Places for the eight views of a square: four quarter turns, plain and mirrored; view 0 is the identity."""
    views = []
    for mirrored in (False, True):
        grid = [[r * side + (side - 1 - c if mirrored else c) for c in range(side)] for r in range(side)]
        for _ in range(4):
            views.append([v for row in grid for v in row])
            grid = [list(row) for row in zip(*grid)][::-1]
    return views


def _mirror(i: int, n: int) -> int:
    """Reflect without repeating the border."""
    return 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def laplacian_places(rows: int, cols: int) -> list[list[int]]:
    """For each cell, the places of its neighbours above, below, left and right."""
    out = []
    for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        out.append([_mirror(r + dr, rows) * cols + _mirror(c + dc, cols) for r in range(rows) for c in range(cols)])
    return out


def laplacian(canvas: Column, rows: int, cols: int) -> Column:
    near = laplacian_places(rows, cols)
    cells = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    above, below, left, right = (longs(p) for p in near)
    at_in = lambda c, places, i: F.get(c, F.get(places, i))
    cell = lambda c: lambda i: at_in(c, above, i) + at_in(c, below, i) + at_in(c, left, i) + at_in(c, right, i) - 4 * F.get(c, i)
    return let(canvas, lambda c: F.transform(cells, cell(c)))


def laplacian_variance(canvas: Column, rows: int, cols: int) -> Column:
    return var_pop(laplacian(canvas, rows, cols))


def split_sizes(n: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of ``parts`` nearly equal runs; the first n % parts are longer by one."""
    out, at = [], 0
    for k in range(parts):
        size = n // parts + (k < n % parts)
        out.append((at, at + size))
        at += size
    return out


def tiles(rows: int, cols: int, grid: int) -> list[tuple[list[int], int, int]]:
    """Places, height and width of each tile."""
    return [
        ([r * cols + c for r in range(*rr) for c in range(*cc)], rr[1] - rr[0], cc[1] - cc[0])
        for rr in split_sizes(rows, grid) for cc in split_sizes(cols, grid)
    ]


def tile_sharpness(canvas: Column, rows: int, cols: int, grid: int) -> Column:
    """Laplacian variance of each tile cut out on its own."""
    return let(canvas, lambda c: F.array(*[laplacian_variance(take(c, places), h, w) for places, h, w in tiles(rows, cols, grid)]))


def brightness(canvas: Column) -> Column:
    return mean(canvas) / 255


def clipped_fraction(canvas: Column) -> Column:
    return F.size(F.filter(canvas, lambda x: (x == 0) | (x == 255))) / F.size(canvas).cast("double")


def coverage(values: Column, floor: Column) -> Column:
    """Part of the values that are at or over a floor."""
    return F.try_divide(F.size(F.filter(values, lambda x: x >= floor)).cast("double"), F.size(values).cast("double"))


def pad_places(rows: int, cols: int) -> list[int]:
    """Places of a centred square around the canvas; -1 is padding."""
    side = max(rows, cols)
    top, left = (side - rows) // 2, (side - cols) // 2
    inside = lambda r, c: top <= r < top + rows and left <= c < left + cols
    return [(r - top) * cols + c - left if inside(r, c) else -1 for r in range(side) for c in range(side)]


def pad_to_square(canvas: Column, rows: int, cols: int) -> Column:
    spots = longs(pad_places(rows, cols))
    return let(canvas, lambda c: let(mean(c), lambda m: F.transform(spots, lambda i: F.when(i < 0, m).otherwise(F.get(c, F.greatest(i, F.lit(0)))))))


def dct_row(n: int, k: int) -> list[float]:
    """Row k of the orthonormal DCT-II matrix."""
    return [(sqrt(1 / n) if k == 0 else sqrt(2 / n)) * cos(pi * (2 * i + 1) * k / (2 * n)) for i in range(n)]


def phash_bits(canvas: Column, side: int, low: int) -> Column:
    """Perceptual hash: the ``low`` x ``low`` lowest DCT frequencies against their median (the first left out)."""
    matrix = F.array(*[F.array(*[F.lit(v) for v in dct_row(side, k)]) for k in range(low)])
    spots = F.sequence(F.lit(0), F.lit(low * low - 1))
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def coefficient(canvas: Column, s: Column) -> Column:
        part = lambda up, across: total(F.transform(cells, lambda i: F.get(canvas, i) * F.get(up, (i / side).cast("int")) * F.get(across, i % side)))
        return let(F.get(matrix, (s / low).cast("int")), lambda up: let(F.get(matrix, s % low), lambda across: part(up, across)))

    return let(canvas, lambda c: F.transform(spots, lambda s: coefficient(c, s)))


def bits_to_long(bits: Column) -> Column:
    """Booleans, first one highest, as a signed long."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
