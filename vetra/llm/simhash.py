"""SimHash near-duplicates: exact links within a Hamming radius, by sharded vantage-point trees.

The distances of unlike fingerprints to any point crowd around half the bits, so one tree over all 64
bits with a radius of 4 hardly prunes: nearly every branch overlaps. Trees are therefore grown over
groups of bits: fingerprints within ``radius`` differ in at most radius // groups bits of one group (the
tree's ``reach``), where triangle bounds do prune.

A tree is grown from data. At each node some fingerprints are tried as vantage point; the one whose best
radius leaves the smaller larger half is taken. Whatever lies within the radius goes inside; whatever
lies outside, and by the triangle bound also what lies less than ``reach`` within, goes outside. So two
fingerprints within reach of each other always share a leaf, and a fingerprint visits the neighbouring
shards that its reach may overlap. The first levels (as many as the table's size asks for, at most
``MOST_DEPTH``) are fitted on a bounded sample and make the shards; every fingerprint is dealt by them. They are few, as each
level sends some fingerprints twice.
Each shard goes on growing its own tree from all it holds, down to ``small`` fingerprints, which are
compared over all their bits. A shard reports links that span its components, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, trimmed_group
from vetra.llm.components import connected_components, stars

SEED = 42
#: Levels of the shard trees: at most 2 ** 12 vantage points (16 bytes each) a group travel with a task.
MOST_DEPTH = 12
#: Fingerprints sampled for each shard to fit its tree.
SAMPLE = 16
#: Radius of a node that can't be split: everything goes inside.
WHOLE = 127


def fingerprint(raw: bytes, shingle: int) -> int:
    """The 64-bit SimHash of the word shingles of ``raw`` (UTF-8), A-Z lower-cased, repeats included."""
    import xxhash

    parts = raw.lower().split()  # bytes: only A-Z, and only the six ASCII white-space characters
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    n = max(1, len(parts) - shingle + 1)
    if n == 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)
    return int(majority(hashes[:, None])[0])


#: For each byte, its bits in eight lanes: lanes of up to 255 bytes add up without carrying over.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of ``hashes`` (rows of words) the bits that over half of the rows have."""
    n, words = hashes.shape
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, n, 65_280):
        lanes = LANES[np.ascontiguousarray(hashes[i : i + 65_280]).view(np.uint8)]
        ones += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and w0 (the fingerprint as a signed long) of every whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "w0"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, w0 long")


def bit_groups(groups: int, words: int = 1) -> list[tuple[int, int]]:
    """(word, mask) of each group; every word is cut into ``groups`` runs of nearly equal width."""
    cuts = np.linspace(0, 64, groups + 1).round().astype(int).tolist()
    return [(w, (1 << hi) - (1 << lo)) for w in range(words) for lo, hi in zip(cuts, cuts[1:])]


def split(points: np.ndarray, reach: int, tries: int = 4) -> tuple[int, int] | None:
    """A vantage point out of ``points`` (masked words) and its radius; None if no choice leaves either side clearly smaller."""
    n, best = len(points), None
    for k in range(tries):
        vantage = points[(2 * k + 1) * n // (2 * tries)]
        within = np.bincount(np.bitwise_count(points ^ vantage), minlength=66).cumsum()  # how many lie at most so far away
        outside = n - np.concatenate([np.zeros(reach, np.int64), within])[: len(within)]  # beyond radius - reach
        larger = np.maximum(within, outside)
        radius = int(larger.argmin())
        if best is None or larger[radius] < best[0]:
            best = int(larger[radius]), int(vantage), radius
    return best[1:] if best and best[0] <= 0.9 * n else None


def grow(points: np.ndarray, reach: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree of ``depth`` levels, in heap order, fitted on ``points``."""
    vantage, radius = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, WHOLE, np.int16)
    stack = [(0, points)]
    while stack:
        at, own = stack.pop()
        if at >= len(vantage) or len(own) < 2 or (found := split(own, reach)) is None:
            continue
        vantage[at], radius[at] = found
        apart = np.bitwise_count(own ^ vantage[at]).astype(np.int16)
        stack += [(2 * at + 1, own[apart <= radius[at]]), (2 * at + 2, own[apart > radius[at] - reach])]
    return vantage, radius


def visit(points: np.ndarray, reach: int, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Leaf and row number of every visit that ``points`` pay to the leaves of ``tree``."""
    vantage, radius = tree
    at, who = np.zeros(len(points), np.int64), np.arange(len(points))
    while len(at) and at[0] < len(vantage):
        apart = np.bitwise_count(points[who] ^ vantage[at]).astype(np.int16)
        inside, outside = apart <= radius[at], apart > radius[at] - reach
        at, who = np.concatenate([2 * at[inside] + 1, 2 * at[outside] + 2]), np.concatenate([who[inside], who[outside]])
    return at - len(vantage), who


def _fit(a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members can have a Jaccard similarity of ``alike``."""
    return np.minimum(a, b) + 1e-9 >= alike * np.maximum(a, b)


def walk(fp: np.ndarray, limit: int, size: np.ndarray | None = None, alike: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers u, v of a spanning forest of links, breadth-first: each row is held against what is not reached yet."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]).sum(axis=1, dtype=np.int64) <= limit
            if size is not None:
                near &= _fit(size[rest], size[x], alike)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x)), right.append(found)
                queue += found.tolist()
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def shard_links(fp: np.ndarray, key: np.ndarray, reach: int, limit: int, small: int = 192, size: np.ndarray | None = None, alike: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers u, v of links that span those of a shard: at most ``limit`` bits of ``fp`` (rows of words) apart.

    ``key`` holds the bits over which the shard's tree goes on. With ``size``, the members of each row's set, a link's
    smaller set has at least ``alike`` times as many as the larger.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    stack = [np.arange(len(fp))]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            continue
        if len(own) > small and (found := split(key[own], reach)):
            apart = np.bitwise_count(key[own] ^ np.uint64(found[0])).astype(np.int16)
            stack += [own[apart <= found[1]], own[apart > found[1] - reach]]
            continue
        if len(own) <= small:
            mine = fp[own]
            apart = np.bitwise_count(mine[:, None, 0] ^ mine[None, :, 0])
            for k in range(1, fp.shape[1]):
                apart = apart + np.bitwise_count(mine[:, None, k] ^ mine[None, :, k])
            a, b = np.nonzero(apart <= limit)
            upper = a < b
            if size is not None:
                upper &= _fit(size[own[a]], size[own[b]], alike)
            a, b = a[upper], b[upper]
        if len(own) > small or len(a) > 4 * len(own):  # nothing to prune by, or a dense shard
            a, b = walk(fp[own], limit, None if size is None else size[own], alike)
        left.append(own[a]), right.append(own[b])
    return np.concatenate(left), np.concatenate(right)


def near_links(
    fps: DataFrame, groups: list[tuple[int, int]], reach: int, limit: int, check: int = 1, per_shard: int = 32_768, task_rows: int = 200_000, most: int = 400_000, alike: float = 0.0
) -> DataFrame:
    """Links u, v between fingerprints that have the components of all links found: ``limit`` bits or fewer of the first ``check`` words differ.

    A shard reports its components as stars, so a crowd of near copies sends a row for each and not one for each pair.

    ``fps`` has w0, w1, ... and last a long column ``node`` that names the fingerprint. Where it also has an int column
    ``n``, the size of the set, linked sets are large enough for each other to be ``alike``. Found is each link
    that lies within ``reach`` bits in one of ``groups`` (word, mask): all links, if they have more than
    limit / (reach + 1) groups of the same words. Shards are dealt to tasks of about ``task_rows`` rows, and Python holds one
    shard at a time. A shard with over ``most`` is cut into blocks, and each pair of blocks is taken by itself, so none is too
    large and no pair is missed.
    """
    spark, own = fps.sparkSession, [c for c in fps.columns if c not in ("n", "node")]
    n = fps.count()
    depth = int(min(MOST_DEPTH, max(0, np.ceil(np.log2(max(1, n / per_shard))))))
    step = max(1, n // (SAMPLE << depth))
    sample = fps.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select(*own).collect() if depth else []  # about SAMPLE << depth rows
    points = np.array([tuple(r) for r in sample], np.int64).reshape(-1, len(own)).view(np.uint64)
    trees = [grow(points[:, w] & np.uint64(mask), reach, depth) for w, mask in groups]
    checked = own[:check]
    sized = ["n"] if "n" in fps.columns else []
    carried = [*checked, *sized, "node"]

    def deal(batches):
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in own]
            for g, ((w, mask), tree) in enumerate(zip(groups, trees)):
                key = words[w] & np.uint64(mask)
                leaf, who = visit(key, reach, tree)
                low = np.uint64((mask & -mask).bit_length() - 1)
                columns = [pa.array((g << MOST_DEPTH | leaf).astype(np.int32)), pa.array((key >> low)[who].view(np.int64))]
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(who) for c in carried)], names=["leaf", "key", *carried])

    schema = "leaf int, key long, " + "".join(f"{c} long, " for c in checked) + "n int, " * len(sized) + "node long"
    rows = fps.mapInArrow(deal, schema)  # made twice, which costs less than keeping it: `fps` should be a checkpointed frame
    sizes = cut(rows.groupBy("leaf").count())  # one row a shard
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    tasks, apart = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // task_rows)), ["leaf"]
    if (largest or 0) > most:
        k = F.ceil(F.col("count") / most).cast("int")
        rows = rows.join(F.broadcast(sizes.filter(F.col("count") > most).select("leaf", k.alias("k"))), "leaf", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
        rows = rows.withColumns({"i": F.coalesce(F.least("mine", "other"), F.lit(0)), "j": F.coalesce(F.greatest("mine", "other"), F.lit(0))}).drop("k", "mine", "other")
        apart = ["leaf", "i", "j"]

    def run(key, tab):
        order = np.argsort(tab.column("node").to_numpy(), kind="stable")
        columns = {c: tab.column(c).to_numpy()[order] for c in ("key", *carried)}
        fp, node = np.stack([columns[c] for c in checked], axis=1).view(np.uint64), columns["node"]
        u, v = shard_links(fp, columns["key"].view(np.uint64), reach, limit, size=columns["n"].astype(np.int64) if sized else None, alike=alike)
        return pa.table(dict(zip("uv", stars(node[u], node[v]))))

    return rows.repartition(tasks, *apart).groupBy(*apart).applyInArrow(trimmed_group(run), "u long, v long").filter("u <> v")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, groups: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, over links of at most ``radius`` bits.

    A null text counts as empty and has fingerprint zero; documents with equal fingerprints belong
    together and are one node of every tree. component_id is the smallest doc_id of the component (null
    only where all its ids are null). A text of any length is read whole; its hashes are counted in parts.
    Repeated rows are repeated; an empty table gives an empty result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, shingle))
    classes = cut(marked.groupBy("w0").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(classes.select("w0", F.col("w0").alias("node")), bit_groups(groups), radius // groups, radius))
    rooted = classes.join(roots, classes["w0"] == roots["node"], "left").select("w0", "least", F.coalesce("root", "w0").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("w0", "root").join(smallest, "root").select("w0", "component_id")
    hexed = F.lower(F.lpad(F.hex("w0"), 16, "0"))
    return marked.join(named, "w0").select("doc_id", hexed.alias("fingerprint"), "component_id")
