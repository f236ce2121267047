"""The distribution of Hamming distances between rows of different classes, without pairs of rows.

Narrow hashes (up to ``NARROW`` bits): with f the counts of a class by hash and F its Walsh-Hadamard transform, the
pairs at distance d number sum over j of K(d, j) * P(j) / 2**bits, where P(j) is the sum of F**2 over the places
with j ones and K are the Krawtchouk polynomials. All rows' pairs less those within the classes are the pairs of
interest. One transform a class over 2**bits cells, whatever the number of rows; whole numbers throughout.

Wide hashes: distinct (class, hash) in blocks, each pair of blocks a task of matrix work that gives counts alone.
That is quadratic in distinct hashes, so its cost is checked first.

Where only close pairs matter (a small percentile, links under it), ``close_pairs`` counts them by distance and hands on forests
of them, both in one look at each pair of blocks. It is quadratic too, but in a few instructions a pair and bounded memory.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 20
#: Pairs of distinct (class, hash) that are compared at most for wide hashes.
MOST_PAIRS = 10**14


def transformed(cells: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of 2**bits whole numbers."""
    h = 1
    while h < len(cells):
        x = cells.reshape(-1, 2, h)
        cells = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).reshape(-1)
        h *= 2
    return cells


def krawtchouk(bits: int, d: int, j: int) -> int:
    """The sum of (-1)**(z * w) over all z with ``d`` ones, for a w with ``j``."""
    return sum((-1) ** i * comb(j, i) * comb(bits - j, d - i) for i in range(d + 1))


def _powers(bits: int):
    """For groups of (part, hash, n): part, j and P(j)."""

    def run(key, tab):
        cells = np.zeros(1 << bits, np.int64)
        np.add.at(cells, tab.column("hash").to_numpy(), tab.column("n").to_numpy())
        ones = np.bitwise_count(np.arange(1 << bits, dtype=np.uint32))
        spectrum = transformed(cells)
        if np.abs(spectrum).max() < 1 << 31:  # squares in two halves, whose sums can't overflow
            square = spectrum * spectrum
            halves = [np.array([part[ones == j].sum() for j in range(bits + 1)]) for part in (square >> 32, square & 0xFFFFFFFF)]
            power = [(int(a) << 32) + int(b) for a, b in zip(*halves)]
        else:
            power = [sum(int(v) ** 2 for v in spectrum[ones == j].tolist()) for j in range(bits + 1)]
        n = bits + 1
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([str(p) for p in power]).cast(pa.decimal128(38, 0))], names=["part", "j", "power"])

    return run


def _by_transform(counted: DataFrame, bits: int) -> list[int]:
    whole = counted.groupBy("hash").agg(F.sum("n").alias("n")).select(F.lit(0).alias("part"), F.lit("").alias("class_name"), "hash", "n")
    rows = whole.unionByName(counted.select(F.lit(1).alias("part"), "class_name", "hash", "n"))
    sums = {(r["part"], r["j"]): int(r["power"]) for r in rows.groupBy("part", "class_name").applyInArrow(_powers(bits), "part int, j int, power decimal(38,0)").groupBy("part", "j").agg(F.sum("power").alias("power")).collect()}
    within = lambda part, d: sum(krawtchouk(bits, d, j) * sums.get((part, j), 0) for j in range(bits + 1)) >> bits
    return [(within(0, d) - within(1, d)) // 2 for d in range(bits + 1)]


def _block_pair(key, tab):
    """For a pair of blocks: distance and n of its cross-class pairs."""
    block, hashes, n = (tab.column(c).to_numpy() for c in ("block", "hash", "n"))
    cls = np.unique(np.array(tab.column("class_name").to_pylist(), object).astype(str), return_inverse=True)[1]
    i, j = key[0].as_py(), key[1].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    total = np.zeros(65, np.int64)
    single, exact = n.max() == 1, int(n.max()) ** 2 * 512 * max(len(right), 1) < 1 << 53
    for at in range(0, len(left), 512):
        a = left[at : at + 512]
        apart = np.bitwise_count((hashes[a][:, None] ^ hashes[right][None, :]).view(np.uint64))
        other = cls[a][:, None] < cls[right][None, :] if i == j else cls[a][:, None] != cls[right][None, :]
        if single:
            total += np.bincount(np.where(other, apart, 65).ravel(), minlength=66)[:65]
            continue
        weight = n[a][:, None] * n[right][None, :]
        if exact:  # sums of doubles without rounding
            total += np.bincount(apart.ravel(), np.where(other, weight, 0).ravel(), 65).astype(np.int64)
            continue
        for d in np.unique(apart).tolist():
            total[d] += weight[other & (apart == d)].sum()
    at = np.flatnonzero(total)
    return pa.table([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["distance", "n"])


def _by_blocks(counted: DataFrame, per_block: int, most_pairs: int) -> list[int]:
    m = counted.count()
    if m * (m - 1) // 2 > most_pairs:
        raise ValueError(f"{m} distinct hashes make more than {most_pairs} pairs; raise most_pairs, or use hashes of at most {NARROW} bits")
    blocks = max(1, -(-m // per_block))
    own = F.pmod(F.xxhash64("class_name", "hash"), F.lit(blocks)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = counted.withColumn("block", own).select("class_name", "hash", "n", "block", F.inline(others))
    found = dealt.groupBy("i", "j").applyInArrow(_block_pair, "distance int, n long").groupBy("distance").agg(F.sum("n").alias("n")).collect()
    out = [0] * 65
    for r in found:
        out[r["distance"]] = r["n"]
    return out


def distance_histogram(rows: DataFrame, bits: int = 64, per_block: int = 8_192, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """distance, n: how many pairs of rows of different classes differ in so many bits; at most 65 rows.

    ``rows``: class_name, hash (its lowest ``bits`` bits count). Rows without class or hash don't count.
    """
    if not 1 <= bits <= 64:
        raise ValueError("bits: 1 to 64")
    valid = rows.filter("class_name IS NOT NULL AND hash IS NOT NULL")
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long"))
    counted = valid.groupBy("class_name", low.alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    numbers = _by_transform(counted, bits) if bits <= NARROW else _by_blocks(counted, per_block, most_pairs)
    return rows.sparkSession.createDataFrame([(d, n) for d, n in enumerate(numbers) if n], "distance int, n long")


#: Hashes of a block of ``close_pairs`` at most; close pairs that a task holds before it reduces them to a forest.
BLOCK, HELD = 262_144, 4_000_000
#: Rows from which the distance is guessed up to which pairs are kept, and by how much it takes the percentile larger.
GUESS_ROWS, GUESS_SPARE = 2_000, 1.5


def forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among rows 0 to ``size`` - 1 that join, at every bound on d, the same rows as all of u, v, d do."""
    root, out = np.arange(size), []
    for at in np.unique(d).tolist():
        a, b = root[u[d == at]], root[v[d == at]]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.concatenate([[True], high[order][1:] != high[order][:-1]]))]
            out.append((high[first], low[first], np.full(len(first), at, d.dtype)))
            root[high[first]] = low[first]
            while not (root == root[root]).all():
                root = root[root]
            a, b = root[a], root[b]
    if not out:
        return u[:0], v[:0], d[:0]
    return tuple(np.concatenate(c) for c in zip(*out))


#: Pairs whose comparison takes as long as looking up the partners of one value of a group of bits, and as each of these.
VALUE_COST, PARTNER_COST = 45_000, 8
#: Pairs compared at a time: rows, and as many partners.
HIGH, WIDE = 64, 8_192
OF_EIGHT = np.arange(8)


def bit_groups(hashes: np.ndarray, cap: int, rows: int) -> list[tuple[list[int], int]]:
    """Groups of bits, each with a radius, such that hashes at most ``cap`` apart lie within the radius in one group at least; none where looking at all pairs of ``rows`` rows costs less.

    Radii sum to ``cap`` less the number of groups, plus one: were all exceeded, the distance would be over ``cap``. That holds for any
    bits; a sample, ``hashes``, tells which vary and how many pairs a choice leaves.
    """
    vary = [b for b in range(64) if 0 < np.count_nonzero(hashes >> np.uint64(b) & np.uint64(1)) < len(hashes)]
    apart = (hashes[:500, None] ^ hashes[None, :500])[np.triu_indices(min(len(hashes), 500), 1)]
    best, least = [], float(rows) ** 2
    for k in range(2, 9):
        if cap < k - 1 or not 8 * k <= len(vary) or len(vary) > 16 * k:
            continue
        groups = [vary[g::k] for g in range(k)]
        groups = [(bits, (cap - k + 1 + g) // k) for g, bits in enumerate(groups)]
        shares = [np.mean(np.bitwise_count(apart & _mask(bits)) <= r) for bits, r in groups]
        cost = sum(share * float(rows) ** 2 + min(1 << len(bits), rows) * (VALUE_COST + PARTNER_COST * share * rows) for share, (bits, _) in zip(shares, groups))
        if cost < least:
            best, least = groups, cost
    return best


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _values(hashes: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint16)
    for k, b in enumerate(bits):
        out |= ((hashes >> np.uint64(b) & np.uint64(1)) << np.uint64(k)).astype(np.uint16)
    return out


def _dealt(left: np.ndarray, right: np.ndarray, group: list[tuple[list[int], int]], same: bool):
    """Orders of ``left`` and ``right``, and by place in these the rows from, to and the partners to compare them with: by a group of bits or, without one, all.

    For one block with itself (``same``) both orders are one, and no pair's earlier place lacks the later one as partner.
    """
    if not group:
        rows = np.arange(len(right))
        return np.arange(len(left)), rows, ((at, min(at + HIGH, len(left)), rows[at:] if same else rows) for at in range(0, len(left), HIGH))
    [(bits, radius)] = group
    flips = np.arange(1 << len(bits), dtype=np.uint16)
    flips = flips[np.bitwise_count(flips) <= radius]
    a, b = _values(left, bits), _values(right, bits)
    order, partners = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    counts, others = np.bincount(a, minlength=1 << len(bits)), np.bincount(b, minlength=1 << len(bits))
    ends, starts = np.cumsum(counts), np.cumsum(others) - others

    def pairs():
        for x in np.flatnonzero(counts).tolist():
            near = flips ^ np.uint16(x)
            if same:
                near = near[near >= x]
            sizes = others[near]
            upto = sizes.cumsum()
            if total := int(upto[-1]):
                yield int(ends[x] - counts[x]), int(ends[x]), (starts[near] - upto + sizes).repeat(sizes) + every[:total]

    every = np.arange(len(right))
    return order, partners, pairs()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u, v as one from each other node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    high, low, _ = forest(at[: len(u)], at[len(u) :], np.zeros(len(u), np.uint8), len(nodes))
    root = np.arange(len(nodes))
    root[high] = low  # a node is the higher end once at most
    while not (root == (root := root[root])).all():
        pass
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(links: DataFrame, tasks: int, most: int) -> DataFrame:
    """Links a, b (long) with the components of ``links``: ``tasks`` tasks make stars of theirs, of at most ``most`` links at a time."""

    def run(batches):
        held, n = [], 0

        def made():
            u, v = stars(*(np.concatenate([b[c] for b in held]) for c in (0, 1)))
            return u, v

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                held = [made()]
                n = len(held[0][0])
                if 2 * n >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["a", "b"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made()], names=["a", "b"])

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def _close(cap: int, groups: list[tuple[list[int], int]]):
    """For a pair of blocks: how many pairs of rows there are of each distance up to ``cap``, and a forest of them."""

    def run(key, tab):
        i, j = key[0].as_py(), key[1].as_py()
        block, hashes, n = (tab.column(c).to_numpy() for c in ("block", "hash", "n"))
        hashes = hashes.view(np.uint64)
        names = tab.column("class_name").combine_chunks().dictionary_encode()
        cls = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a_hashes, b_hashes = hashes[left], hashes[right]
        every, cross = np.zeros(cap + 1, np.int64), np.zeros(cap + 1, np.int64)
        mixed, apart, near = np.empty(HIGH * WIDE, np.uint64), np.empty(HIGH * WIDE, np.uint8), np.zeros(HIGH * WIDE, bool)
        masks = [(_mask(bits), radius) for bits, radius in groups]
        kept, met = [(left[:0], left[:0], np.empty(0, np.uint8))], []

        def take(g, order, partners):
            """Count what met, and hold its links."""
            r, s, d = (np.concatenate(m) for m in zip(*met))
            met.clear()
            ok = r < s if i == j else np.ones(len(r), bool)
            r, s = order[r], partners[s]
            # a pair counts in the first group that brings it together
            for mask, radius in masks[:g]:
                ok &= np.bitwise_count((a_hashes[r] ^ b_hashes[s]) & mask) > radius
            u, v, d = left[r[ok]], right[s[ok]], d[ok]
            weight = n[u] * n[v]
            np.add.at(every, d, weight)
            other = (cls[u] != cls[v]) & (cls[u] >= 0) & (cls[v] >= 0)
            np.add.at(cross, d[other], weight[other])
            kept.append((u, v, d))
            if sum(len(k[0]) for k in kept) > HELD:
                kept[:] = [forest(*(np.concatenate(k) for k in zip(*kept)), len(hashes))]

        for g in range(max(1, len(groups))):
            order, partners, dealt = _dealt(a_hashes, b_hashes, groups[g : g + 1], i == j)
            a_sorted, b_sorted, waiting = a_hashes[order], b_hashes[partners], 0
            for start, end, places in dealt:
                for lo in range(0, len(places), WIDE):
                    some = places[lo : lo + WIDE]
                    b = b_sorted[some]
                    for at in range(start, end, HIGH):
                        a = a_sorted[at : min(at + HIGH, end)]
                        size = len(a) * len(b)
                        whole = -(-size // 8) * 8
                        np.bitwise_xor(a[:, None], b, out=mixed[:size].reshape(len(a), len(b)))
                        np.bitwise_count(mixed[:size], out=apart[:size])
                        np.less_equal(apart[:size], cap, out=near[:size])
                        near[size:whole] = False
                        # eight at a time, as few are close
                        eights = near[:whole].view(np.uint64).nonzero()[0]
                        if len(eights):
                            hit = (eights[:, None] * 8 + OF_EIGHT)[near[:whole].reshape(-1, 8)[eights]]
                            r = hit // len(b)
                            met.append((r + at, some[hit - r * len(b)], apart[hit]))
                            waiting += len(hit)
                    if waiting > HELD // 8:
                        take(g, order, partners)
                        waiting = 0
            if met:
                take(g, order, partners)
        u, v, d = forest(*(np.concatenate(k) for k in zip(*kept)), len(hashes))
        at = np.flatnonzero(every)
        none, counts = np.zeros(len(at), np.int64), np.zeros(len(u), np.int64)
        return pa.table({
            "a": np.concatenate([none, hashes[u].view(np.int64)]), "b": np.concatenate([none, hashes[v].view(np.int64)]),
            "distance": np.concatenate([at, d]).astype(np.int32), "n": np.concatenate([every[at], counts]), "across": np.concatenate([cross[at], counts]),
        })

    return run


def _blockwise(counted: DataFrame, m: int, cap: int, per_block: int, sample: np.ndarray) -> DataFrame:
    parallel = counted.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-m // per_block), min(-(-m // 2_048), int(np.ceil((4 * parallel) ** 0.5))))
    own = F.pmod(F.xxhash64("class_name", "hash"), F.lit(blocks)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = counted.withColumn("block", own).select("class_name", "hash", "n", "block", F.inline(others))
    # a pair of blocks is long work on few bytes, so each has a task of its own; dealt by hash, some would share one
    nth = F.expr("cast(j * (j + 1) div 2 + i as int)")
    look = _close(cap, bit_groups(sample, cap, m // blocks))

    def run(batches):
        if held := list(batches):
            tab = pa.Table.from_batches(held)
            if len(tab):
                yield from look((tab["i"][0], tab["j"][0]), tab).to_batches()

    return dealt.repartitionById(blocks * (blocks + 1) // 2, nth).mapInArrow(run, "a long, b long, distance int, n long, across long")


def close_pairs(rows: DataFrame, percentile: float, bits: int = 64, per_block: int = BLOCK, guess: int | None = None) -> tuple[float, int, DataFrame]:
    """The percentile of the distances between rows of different classes (0 without such), how many pairs of rows lie closer, and links a, b (hashes) that join the hashes which do.

    ``rows``: class_name, hash. Of all pairs of distinct (class, hash), those up to a distance guessed from a bounded sample
    (``guess``, if given) are counted; if these prove too few for the percentile, the distance is raised. Rows without a
    hash count for nothing, those without a class only as pairs. Hashes are whole; ``bits`` says how many can differ.
    """
    from vetra.plans.session import cut

    counted = cut(rows.filter("hash IS NOT NULL").groupBy("class_name", "hash").agg(F.count(F.lit(1)).alias("n")))
    sums = counted.filter("class_name IS NOT NULL").groupBy("class_name").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).first()
    m, total = counted.count(), ((sums["n"] or 0) ** 2 - (sums["own"] or 0)) // 2
    sample = counted.orderBy(F.xxhash64("hash", "class_name")).filter("class_name IS NOT NULL").limit(GUESS_ROWS).collect()  # bounded
    h, c = np.array([r["hash"] for r in sample], np.int64).view(np.uint64), np.array([r["class_name"] for r in sample], object)
    if guess is None:
        u, v = np.triu_indices(len(sample), 1)
        other = np.unique(c.astype(str), return_inverse=True)[1] if len(c) else u
        apart = np.bitwise_count(h[u] ^ h[v])[other[u] != other[v]]
        guess = int(np.ceil(np.quantile(apart, min(1.0, GUESS_SPARE * percentile)))) if len(apart) else 0
    cap, more = min(guess, bits), 2
    while True:
        found = cut(_blockwise(counted, m, cap, per_block, h))
        numbers = {r["distance"]: (r["n"], r["across"]) for r in found.filter("n > 0").groupBy("distance").agg(F.sum("n").alias("n"), F.sum("across").alias("across")).collect()}
        across = sum(x for _, x in numbers.values())
        if across == total or across > percentile * (total - 1) + 1 or cap == bits:
            break
        cap, more = min(cap + more, bits), 2 * more
    cells = [(d, x) for d, (_, x) in sorted(numbers.items()) if x] + [(bits + 1, total - across)] * (total > across)
    bound = rows.sparkSession.createDataFrame(cells, "distance int, n long").agg(F.percentile("distance", F.lit(percentile), F.col("n")).alias("bound")).first()["bound"] or 0.0
    same = counted.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    closer = sum(n for d, (n, _) in numbers.items() if d < bound) + (same if bound > 0 else 0)
    return float(bound), closer, found.filter((F.col("n") == 0) & (F.col("distance") < bound) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
