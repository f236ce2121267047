"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Vectors are put on a grid of whole numbers x. The fit list holds each distinct x once: n of them, S their sum.
With y = n*x - S (whole, and centred), the covariance is sum(y * y') / n**3. That sum is gathered exactly:

1. ``_sums`` adds up n, S and the range of x in each partition, in two halves that can't overflow.
2. ``_scatter`` reduces y modulo several primes and multiplies each partition's residues, prime by prime, by matrix
   products whose every partial sum is a whole number that a double holds. Spark adds up the residues of the partitions.
3. ``_reconstruct`` puts each cell together from its residues (Chinese remainders), and divides once.

The product of the primes is over twice the largest sum that n and the range of x allow. The eigenvectors of
the covariance are found in double precision on the driver, which holds one d x d matrix for each
vector length d, whatever the number of rows. Vectors of different length are fitted apart.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, trimmed

#: Residues are under 2**22 (in balance: 2**21) and 1024 rows are multiplied at a time, so that sums stay under 2**52.
BITS, ROWS = 22, 1024
#: Cells of a matrix row that travel in one row, each a column of its own.
WIDTH = 32
CELLS = [f"v{i}" for i in range(WIDTH)]
KEY = "dims int, prime int, i int, at int"
ADDED = f"{KEY}, n long, low long, high long, " + ", ".join(f"{c} long" for c in CELLS)


class Fit(NamedTuple):
    """What is known of the fit list of one vector length."""

    n: int
    total: list[int]  # S
    peak: int  # of |x|
    vectors: np.ndarray | None = None  # columns: components
    values: np.ndarray | None = None  # eigenvalues
    explained: np.ndarray | None = None

    def largest(self) -> int:
        """A bound of |n*x - S|."""
        return self.n * self.peak + max(map(abs, self.total), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: as long where it fits, else as exact objects."""
        kind = np.int64 if self.largest() < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.total, kind)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def on_grid(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry, as long; beyond the range of long it is the range's end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def is_finite(vector: Column) -> Column:
    """The vector is there, has an entry, and all entries are finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def primes(bound: int) -> list[int]:
    """The largest primes under 2**BITS, as many as make a product of more than ``bound``."""
    out, product, p = [], 1, (1 << BITS) - 1
    while product <= bound:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def _matrices(column: pa.Array):
    """For each length, which rows have it and their values as a matrix."""
    sizes = column.value_lengths().to_numpy()
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        own = column if len(rows) == len(sizes) else column.take(pa.array(rows))
        yield d, rows, own.flatten().to_numpy().reshape(-1, d)


def _emit(rows: list[tuple], values: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (dims, prime, i, at, n, low, high) with WIDTH cells beside each."""
    cells = np.zeros((len(values), WIDTH), np.int64)
    for i, v in enumerate(values):
        cells[i, : len(v)] = v
    head = list(zip(*rows)) or [()] * 7
    columns = [pa.array(c, pa.int32()) for c in head[:4]] + [pa.array(c, pa.int64()) for c in head[4:]] + [pa.array(cells[:, j]) for j in range(WIDTH)]
    return pa.RecordBatch.from_arrays(columns, names=["dims", "prime", "i", "at", "n", "low", "high", *CELLS])


def _sums(batches):
    """n, range and sum of a partition's rows: i 0 holds the upper halves (x >> 32), i 1 the lower ones."""
    kept: dict[int, list] = {}
    for batch in batches:
        for d, rows, x in _matrices(batch.column(0)):
            halves = np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            old = kept.get(d, [0, 1 << 62, -1 << 62, 0])
            kept[d] = [old[0] + len(rows), min(old[1], int(x.min())), max(old[2], int(x.max())), old[3] + halves]
    rows, values = [], []
    for d, (n, low, high, halves) in kept.items():
        for i in (0, 1):
            for at in range(0, d, WIDTH):
                rows.append((d, 0, i, at, n, low, high))
                values.append(halves[i, at : at + WIDTH])
    yield _emit(rows, values)


def _added(parts: DataFrame) -> DataFrame:
    """The partitions' rows added up, cell by cell."""
    return parts.groupBy("dims", "prime", "i", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in CELLS])


def _scatter(fits: dict[int, Fit], moduli: dict[int, list[int]]):
    """For mapInArrow over x: the sum of y * y' over a partition, modulo each prime; cells from the diagonal on."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = defaultdict(int)
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                fit = fits[d]
                for p in moduli[d]:
                    r = ((x % p) * (fit.n % p) - np.array([s % p for s in fit.total])) % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    for i in range(0, len(r), ROWS):
                        own = r[i : i + ROWS]
                        sums[d, p] = (sums[d, p] + (own.T @ own).astype(np.int64)) % p
        rows, values = [], []
        for (d, p), s in sums.items():
            for i in range(d):
                for at in range(i // WIDTH * WIDTH, d, WIDTH):
                    rows.append((d, p, i, at, 0, 0, 0))
                    values.append(s[i, at : at + WIDTH])
            yield _emit(rows, values)
            rows, values = [], []

    return run


def chinese_remainder(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers (objects) next to 0 that have these residues."""
    product = 1
    for p in moduli:
        product *= p
    out = sum(r.astype(object) % p * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, moduli)) % product
    return np.where(out > product // 2, out - product, out)


def _reconstruct(fits: dict[int, Fit]):
    """For the residues of one stretch of cells, a row a prime: its covariances."""

    def run(key, tab):
        n = fits[key[0].as_py()].n
        cells = np.stack([tab.column(c).to_numpy() for c in CELLS], axis=1)
        exact = chinese_remainder(list(cells), tab.column("prime").to_pylist())
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([[int(v) / n**3 for v in exact]], pa.list_(pa.float64()))], names=["dims", "i", "at", "cells"])

    return run


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors (columns; largest entry positive), eigenvalues and their share of the trace, by falling value.

    At most ``most``, and none that can't be told from 0 in double precision.
    """
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > trace * len(values) * np.finfo(float).eps]
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return vectors * sign, values[order], values[order] / trace if trace else values[order]


def fit_whitening(grid: DataFrame, most: int = 4) -> tuple[dict[int, Fit], dict[int, float]]:
    """The fit and the identity error for each vector length in ``grid`` (x: array<long>), whose rows are distinct.

    The identity error is the largest absolute entry of the whitened rows' own covariance minus the
    identity; it is gathered from all rows. ``grid`` is read three times: give a checkpointed frame.
    """
    x = grid.select("x")
    halves = defaultdict(dict)
    for r in _added(x.mapInArrow(trimmed(_sums), ADDED)).collect():  # two rows for each WIDTH entries of a vector
        halves[r["dims"]][r["i"], r["at"]] = r
    fits: dict[int, Fit] = {}
    for d, own in halves.items():
        total = [(own[0, j // WIDTH * WIDTH][CELLS[j % WIDTH]] << 32) + own[1, j // WIDTH * WIDTH][CELLS[j % WIDTH]] for j in range(d)]
        any_row = own[0, 0]
        fits[d] = Fit(any_row["n"], total, max(abs(any_row["low"]), abs(any_row["high"])))
    moduli = {d: primes(2 * f.n * f.largest() ** 2) for d, f in fits.items()}
    parts = _added(x.mapInArrow(trimmed(_scatter(fits, moduli)), ADDED))
    exact = parts.groupBy("dims", "i", "at").applyInArrow(_reconstruct(fits), "dims int, i int, at int, cells array<double>")
    covariance = {d: np.zeros((d, d)) for d in fits}
    for r in exact.toLocalIterator():
        covariance[r["dims"]][r["i"], r["at"] : r["at"] + WIDTH] = r["cells"][: r["dims"] - r["at"]]
    for d, v in covariance.items():
        vectors, values, share = components_of(np.triu(v) + np.triu(v, 1).T, most)
        fits[d] = fits[d]._replace(vectors=vectors, values=values, explained=share)

    def moments(batches):
        for batch in batches:
            for d, _, rows in _matrices(batch.column(0)):
                w = fits[d].whiten(fits[d].centred(rows))
                cells = [*w.sum(axis=0).tolist(), *(w.T @ w).reshape(-1).tolist()]
                at = range(len(cells))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(cells, pa.float64())], names=["dims", "at", "v"])

    sums = defaultdict(dict)
    for r in x.mapInArrow(trimmed(moments), "dims int, at int, v double").groupBy("dims", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["dims"]][r["at"]] = r["v"]
    errors = {}
    for d, f in fits.items():
        k = len(f.values)
        means, products = np.array([sums[d][i] for i in range(k)]) / f.n, np.array([sums[d][i] for i in range(k, k + k * k)]).reshape(k, k) / f.n
        errors[d] = float(np.abs(products - np.outer(means, means) - np.eye(k)).max(initial=0.0))
    return fits, errors


def whitened(embeddings: DataFrame, vector: str = "embedding", most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (and deviation_exact) for each row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part. Repeated vectors count
    once in the fit and every row gets its result; a null vec_id stays null. Each vector length is a fit
    of its own. Components whose variance is nothing (fewer distinct vectors than components, constant
    dimensions) give no row, so an empty table or a single distinct vector gives none. Other columns are ignored.
    ``deviation`` is null beyond the range of long; ``deviation_exact`` has 38 digits, and is null beyond those.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("c")).filter(is_finite(F.col("c")))
    rows = rows.select("vec_id", on_grid(F.col("c")).alias("x"))
    fits, errors = fit_whitening(cut(rows.select("x").distinct()), most)

    def run(batches):
        for batch in batches:
            for d, own, x in _matrices(batch.column(1)):
                fit = fits[d]
                k = len(fit.values)
                if not k:
                    continue
                y = fit.centred(x)
                wide = y if d * fit.largest() ** 2 < 1 << 63 else y.astype(object)
                exact = (wide * wide).sum(axis=1)
                fine = [None if v >= 1 << 63 else v for v in exact.tolist()]
                digits = pa.array([str(v) if v < 10**38 else None for v in exact.tolist()]).cast(pa.decimal128(38, 0))
                at = np.repeat(np.arange(len(own)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(own[at])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(at), fit.n)),
                        pa.array(fine, pa.int64()).take(pa.array(at)), pa.array(fit.whiten(y).reshape(-1)), pa.array(np.tile(fit.explained, len(own))),
                        pa.array(np.full(len(at), errors[d])), digits.take(pa.array(at)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return rows.mapInArrow(trimmed(run), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
