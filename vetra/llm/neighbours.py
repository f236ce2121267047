"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node, so a vector that a third of the rows share costs no more than any other;
each node keeps its smallest ids, as many as an answer can name. The graph starts from the nearest
within the leaves of a few random-projection trees (hyperplanes between two vectors of a bounded sample,
at most ``MOST_DEPTH`` levels; larger leaves are split on in their task). Then, round by round, every node brings its
neighbours and those it is a neighbour of together, and each of them is offered the nearest of the others
(a join of neighbours of neighbours on the node they share). Pairs that have met before are left out, so
a node without a new link takes no part. Rounds go on until hardly a link is new. Vectors travel as
one signed byte a component with a scale; distances in an answer are computed from the original components in double precision.

Queries start at their own neighbours and expand the nearest nodes not yet expanded, hop by hop, keeping
the best ``beam``, until none of those is open. Vectors lie in a table bucketed once, so a hop moves
only what is asked. All rows are in the graph.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vetra.llm.common import cut, shared_path

_LISTS = "a long, bs array<long>, ds array<float>, fresh array<boolean>"
#: Rounds or hops after which a search that has not settled fails.
MOST_ROUNDS = 60
#: Levels of the projection trees that are fitted on the sample (about ``SAMPLE`` vectors a leaf).
MOST_DEPTH, SAMPLE = 10, 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (double[]) of the rows that take part: no null, zero or non-finite vectors."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce(~bad, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def _codes(nodes: DataFrame) -> DataFrame:
    """node, code: the scale in double precision and one signed byte for each component."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                scale = np.abs(x).max(axis=1) / 127
                scale = np.where(scale > 0, scale, np.finfo(float).tiny)  # of the least denormals
                small = np.rint(np.clip(x / scale[:, None], -127, 127)).astype(np.int8)
                code = [s.tobytes() + c.tobytes() for s, c in zip(scale, small)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary())], names=["node", "code"])

    return nodes.select("node", "vec").mapInArrow(run, "node long, code binary")


def _decoded(codes, unit: float) -> np.ndarray:
    """Vectors from codes, in double precision and as multiples of ``unit``, so that squares stay finite."""
    flat = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    scale = flat[:, :8].copy().view(np.float64) / unit
    return flat[:, 8:].view(np.int8) * scale


def _apart(x: np.ndarray) -> np.ndarray:
    """Distances between all rows of ``x``; infinite to itself."""
    norm = np.einsum("ij,ij->i", x, x)
    out = norm[:, None] + norm - 2 * (x @ x.T)
    np.maximum(out, 0, out=out)
    np.sqrt(out, out=out)
    np.fill_diagonal(out, np.inf)
    return out


def _nearest_of(apart: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.argpartition(apart, take - 1, axis=1)[:, :take]
    return at, np.take_along_axis(apart, at, 1)


def _lists(who: np.ndarray, other: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """who, list sizes, and the lists' parts end to end, of those at a finite distance."""
    ok = np.isfinite(apart)
    return who, ok.sum(axis=1), other[ok], apart[ok].astype(np.float32)


def _packed(parts: list) -> pa.Table:
    """Offers as rows a, bs, ds, fresh."""
    who = np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)])
    edges = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]))]).astype(np.int32)
    other = np.concatenate([np.empty(0, np.int64), *(p[2] for p in parts)])
    apart = np.concatenate([np.empty(0, np.float32), *(p[3] for p in parts)])
    lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (other, apart, np.ones(len(other), bool))]
    return pa.table([pa.array(who), *lists], names=["a", "bs", "ds", "fresh"])


def _forest(sample: np.ndarray, trees: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the normals and thresholds of its hyperplanes, in heap order, fitted on ``sample``."""
    rng, out = np.random.default_rng(7), []
    for _ in range(trees):
        normals, bounds = np.zeros(((1 << depth) - 1, sample.shape[1]), np.float32), np.zeros((1 << depth) - 1)
        stack = [(0, np.arange(len(sample)))]
        while stack:
            at, own = stack.pop()
            if at < len(bounds) and len(own) > 1:
                normals[at], bounds[at], low = _halves(sample, own, rng)
                stack += [(2 * at + 1, own[low]), (2 * at + 2, own[~low])]
        out.append((normals, bounds))
    return out


def _halves(x: np.ndarray, own: np.ndarray, rng) -> tuple[np.ndarray, float, np.ndarray]:
    """A hyperplane's normal and threshold, and which of the rows ``own`` lie on its low side."""
    i, j = rng.choice(own, 2, replace=False)
    normal = x[i] - x[j]
    size = np.abs(normal).max()
    normal = (normal / size if size else normal).astype(np.float32)
    place = x[own] @ normal
    bound = float(np.median(place))
    low = place <= bound
    if low.all():  # many alike: half of them by order
        low = np.arange(len(own)) < len(own) // 2
    return normal, bound, low


def _leaf_join(take: int, unit: float, leaf: int):
    """For rows leaf, node, code grouped by a bucket of leaf: each node's nearest ``take`` within its leaf."""

    def run(key, tab):
        tab = tab.sort_by([("leaf", "ascending"), ("node", "ascending")])
        of, node = tab.column("leaf").to_numpy(), tab.column("node").to_numpy()
        x, rng, parts = _decoded(tab.column("code"), unit), np.random.default_rng(11), []
        stack = np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1)
        while stack:
            own = stack.pop()
            if len(own) > leaf:
                low = _halves(x, own, rng)[2]
                stack += [own[low], own[~low]]
            elif len(own) > 1:
                at, apart = _nearest_of(_apart(x[own]), min(take, len(own) - 1))
                parts.append(_lists(node[own], node[own][at], apart))
        return _packed(parts)

    return run


def _local_join(offers: int, unit: float):
    """For rows u, v, new, code, worst grouped by a bucket of u: offers of pairs of which one at least is new to u."""

    def run(key, tab):
        tab = tab.sort_by([("u", "ascending"), ("v", "ascending")])
        u, v, worst = (tab.column(c).to_numpy() for c in ("u", "v", "worst"))
        new = tab.column("new").to_numpy()
        x, parts = _decoded(tab.column("code"), unit), []
        cuts = np.flatnonzero(u[1:] != u[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(u)]):
            n, fresh = hi - lo, new[lo:hi]
            if n > 1 and fresh.any():
                apart = _apart(x[lo:hi])
                apart[(apart >= worst[lo:hi, None]) | ~(fresh[:, None] | fresh)] = np.inf
                at, near = _nearest_of(apart, min(offers, n - 1))
                parts.append(_lists(v[lo:hi], v[lo:hi][at], near))
        return _packed(parts)

    return run


def _best(keep: int):
    """For lists a, bs, ds, fresh grouped by a bucket of a: each a's ``keep`` nearest, every b once; a known link is not fresh."""

    def run(key, tab):
        tab = tab.combine_chunks()
        bs = tab.column("bs").combine_chunks()
        a = np.repeat(tab.column("a").to_numpy(), bs.value_lengths().to_numpy())
        b, d = bs.flatten().to_numpy(), tab.column("ds").combine_chunks().flatten().to_numpy()
        fresh = tab.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((d, fresh, b, a))
        a, b, d, fresh = a[order], b[order], d[order], fresh[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        a, b, d, fresh = a[once], b[once], d[once], fresh[once]
        order = np.lexsort((b, d, a))
        a, b, d, fresh = a[order], b[order], d[order], fresh[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        rank = np.arange(len(a)) - np.repeat(first, np.diff([*first, len(a)]))
        a, b, d, fresh = (x[rank < keep] for x in (a, b, d, fresh))
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        edges = np.concatenate([first, [len(a)]]).astype(np.int32)
        return pa.table([pa.array(a[first]), *(pa.ListArray.from_arrays(edges, pa.array(v)) for v in (b, d, fresh))], names=["a", "bs", "ds", "fresh"])

    return run


def _bucket(col: str, buckets: int):
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def _links(graph: DataFrame) -> DataFrame:
    """a, b, d, fresh, nth (its place in a's list, nearest first)."""
    return graph.select("a", F.posexplode(F.arrays_zip("bs", "ds", "fresh")).alias("nth", "x")).select("a", "nth", F.col("x.bs").alias("b"), F.col("x.ds").alias("d"), F.col("x.fresh").alias("fresh"))


def _backward(graph: DataFrame, keep: int) -> DataFrame:
    """u, vs: for each node the nearest ``keep`` of those it is a neighbour of, as structs d, v, fresh."""
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("a").alias("v"), "fresh"))), 1, keep)
    return _links(graph).groupBy(F.col("b").alias("u")).agg(near.alias("vs"))


def neighbour_graph(nodes: DataFrame, keep: int = 24, settled: float = 0.03, offers: int = 10, trees: int = 8, leaf: int = 2_048, sampled: int = 10, per_bucket: int = 4_000) -> DataFrame:
    """NN-descent over ``nodes`` (node, vec): each node's list of ``keep`` others (a, bs, ds: about the distance).

    In a round a node brings together at most ``sampled`` new and ``sampled`` known links of either
    direction; new ones not brought stay new. Rounds end once at most the part ``settled`` of the links is new; it fails if that takes too many.
    """
    codes = cut(_codes(nodes))
    largest = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    n, unit = codes.count(), largest or 1.0
    buckets = max(1, -(-n // per_bucket))
    depth = int(min(MOST_DEPTH, max(0, np.ceil(np.log2(max(1, n / leaf))))))
    picked = codes.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(1, n // (SAMPLE << depth)))) == 0).select("code").toArrow() if depth else None
    forest = _forest(_decoded(picked.column(0), unit), trees, depth) if depth else [(None, np.empty(0))] * trees

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _decoded(batch.column(1), unit)
            for t, (normals, bounds) in enumerate(forest):
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > bounds[at])
                leaves = (at - len(bounds) + (t << MOST_DEPTH)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(leaves), *batch.columns], names=["leaf", "node", "code"])

    if not depth:  # one leaf holds all
        forest, take = forest[:1], keep
    else:
        take = keep // 2
    dealt = codes.mapInArrow(deal, "leaf int, node long, code binary")
    best = lambda rows: cut(rows.groupBy(_bucket("a", buckets)).applyInArrow(_best(keep), _LISTS))
    graph = best(dealt.groupBy("leaf").applyInArrow(_leaf_join(take, unit, leaf), _LISTS))
    for _ in range(MOST_ROUNDS):
        new, held = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("bs"))).first()
        if (new or 0) <= settled * (held or 0):
            break
        full = graph.select(F.col("a").alias("node"), F.when(F.size("bs") >= keep, F.array_max("ds")).otherwise(float("inf")).cast("double").alias("worst"))
        known = codes.join(full, "node", "left").select(F.col("node").alias("v"), "code", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        ahead = graph.select(F.col("a").alias("u"), F.arrays_zip(F.col("ds").alias("d"), F.col("bs").alias("v"), "fresh").alias("vs"))
        some = lambda flag: F.slice(F.filter("vs", lambda x: x["fresh"] == flag), 1, sampled)
        sides = [side.select("u", some(True).alias("new"), some(False).alias("old")) for side in (ahead, _backward(graph, keep))]
        both = sides[0].union(sides[1]).select("u", F.explode(F.concat(F.transform("new", lambda x: F.struct(x["v"].alias("v"), F.lit(True).alias("new"))), F.transform("old", lambda x: F.struct(x["v"].alias("v"), F.lit(False).alias("new"))))).alias("x"))
        met = both.groupBy("u", "x.v").agg(F.max("x.new").alias("new")).join(known, "v").select("u", "v", "new", "code", "worst")
        offered = met.groupBy(_bucket("u", buckets)).applyInArrow(_local_join(offers, unit), _LISTS)
        tried = F.transform("fresh", lambda f, i: f & (F.aggregate(F.slice("fresh", 1, i + 1), F.lit(0), lambda s, x: s + x.cast("int")) > sampled))
        graph = best(graph.withColumn("fresh", tried).union(offered))
    else:
        raise RuntimeError(f"neighbours have not settled in {MOST_ROUNDS} rounds")
    return graph.select("a", "bs", "ds", "fresh")


def _distances(left, right):
    """Cogroup of q, goal, ws (candidates) and node, vec of one bucket: the exact distances, a row of lists for each q."""
    if not len(left) or not len(right):
        return pa.table({"q": pa.array([], pa.int64()), "vs": pa.array([], pa.list_(pa.int64())), "ds": pa.array([], pa.list_(pa.float64()))})
    node = right.column("node").to_numpy()
    order = np.argsort(node)
    node = node[order]
    vectors = right.column("vec").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
    vs, ds = [], []
    for vec, ws in zip(left.column("goal"), left.column("ws")):
        wanted = ws.values.to_numpy()
        vs.append(wanted), ds.append(distances(vectors[np.searchsorted(node, wanted)], vec.values.to_numpy()))
    return pa.table({"q": left.column("q"), "vs": pa.array(vs, pa.list_(pa.int64())), "ds": pa.array(ds, pa.list_(pa.float64()))})


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where squares leave its range."""
    with np.errstate(over="ignore", under="ignore"):
        apart = rows - one
        out = np.sqrt((apart * apart).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        apart = rows[odd] / 4 - one / 4
        size = np.maximum(np.abs(apart).max(axis=1), np.finfo(float).tiny)
        out[odd] = np.sqrt(((apart / size[:, None]) ** 2).sum(axis=1)) * size * 4
    return out


def _merge(beam: int):
    """For lists q, vs, ds, known grouped by a bucket of q: each q's nearest ``beam``, with which of them are open."""

    def run(key, tab):
        vs, ds = tab.column("vs").combine_chunks(), tab.column("ds").combine_chunks()
        sizes = vs.value_lengths().to_numpy()
        q, known = np.repeat(tab.column("q").to_numpy(), sizes), np.repeat(tab.column("known").combine_chunks().to_numpy(zero_copy_only=False), sizes)
        v, d = vs.flatten().to_numpy(), ds.flatten().to_numpy()
        other = v != q
        q, v, d, known = q[other], v[other], d[other], known[other]
        order = np.lexsort((~known, v, d, q))
        q, v, d, known = q[order], v[order], d[order], known[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])[: len(q)]
        q, v, d, known = q[once], v[once], d[once], known[once]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
        rank = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
        q, v, d, known = (x[rank < beam] for x in (q, v, d, known))
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
        edges = np.concatenate([first, [len(q)]]).astype(np.int32)
        return pa.table([pa.array(q[first]), *(pa.ListArray.from_arrays(edges, pa.array(x)) for x in (v, d, ~known))], names=["q", "vs", "ds", "open"])

    return run


def graph_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, keep: int = 24, beam: int = 192, per_bucket: int = 4_000) -> DataFrame:
    """q, v, d: for each query node q of ``queries`` (q, vec) up to ``beam`` near nodes, by exact distance; not q itself.

    It ends when every node of the beams has been expanded, and fails if that takes too many hops.
    """
    spark = nodes.sparkSession
    ahead = graph.select(F.col("a").alias("u"), F.col("bs").alias("ws"))
    back = _backward(graph, keep).select("u", F.transform("vs", lambda x: x["v"]).alias("ws"))
    links = cut(ahead.union(back).groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws")))
    buckets, asks = max(1, -(-nodes.count() // per_bucket)), max(1, -(-queries.count() // 256))
    goals = queries.select("q", F.col("vec").alias("goal"))
    name = f"vetra_vectors_{uuid.uuid4().hex}"
    placed = nodes.select("node", "vec", _bucket("node", buckets).alias("bucket")).repartition(buckets, "bucket")
    placed.write.bucketBy(buckets, "bucket").option("path", shared_path(spark, "vectors")).saveAsTable(name)
    try:
        vectors, pool = spark.table(name), None
        frontier = queries.select("q", F.col("q").alias("u"))
        for _ in range(MOST_ROUNDS):
            found = frontier.join(links, "u").select("q", F.explode("ws").alias("w")).withColumn("bucket", _bucket("w", buckets)).repartition(buckets, "bucket")
            asked = found.groupBy("q", "bucket").agg(F.collect_set("w").alias("ws")).join(goals, "q").select("q", "goal", "ws", "bucket")
            near = asked.groupBy("bucket").cogroup(vectors.groupBy("bucket")).applyInArrow(_distances, "q long, vs array<long>, ds array<double>").withColumn("known", F.lit(False))
            if pool is not None:
                near = near.union(pool.select("q", "vs", "ds", F.lit(True)))
            pool = cut(near.groupBy(_bucket("q", asks)).applyInArrow(_merge(beam), "q long, vs array<long>, ds array<double>, open array<boolean>"))
            frontier = pool.select("q", F.explode(F.arrays_zip("vs", "open")).alias("x")).filter("x.open").select("q", F.col("x.vs").alias("u"))
            if frontier.isEmpty():
                return pool.select("q", F.explode(F.arrays_zip("vs", "ds")).alias("x")).select("q", F.col("x.vs").alias("v"), F.col("x.ds").alias("d"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    raise RuntimeError(f"beams have not settled in {MOST_ROUNDS} hops")


def nearest(vectors: DataFrame, divisor: int = 100, k: int = 10, keep: int = 24, beam: int = 192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every vec_id that ``divisor`` divides.

    Rows with a null id, and vectors null, zero, or holding a null or a non-finite component, take no
    part. Vectors of different length have no distance: each length is searched on its own. A vec_id
    given more than once with different vectors counts as that many rows; equal rows count once. Ties go
    to the smaller vec_id. Any finite magnitude is handled; other columns are ignored. An empty table
    gives an empty result.
    """
    rows = cut(usable(vectors).distinct())
    sizes = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())  # one row a length
    parts = [_nearest(rows.filter(F.size("vec") == n) if len(sizes) > 1 else rows, divisor, k, keep, beam) for n in sizes]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _nearest(rows: DataFrame, divisor: int, k: int, keep: int, beam: int) -> DataFrame:
    # one node for equal vectors, named by its smallest id, with the k + 1 smallest ids
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    nodes = cut(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("node"), "vec", "members"))
    asks = rows.filter(F.col("vec_id") % divisor == 0).join(nodes.select("vec", "node"), "vec").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    asks = cut(asks)
    if asks.isEmpty():
        return asks.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    graph = neighbour_graph(nodes, keep)
    queries = cut(asks.select("q").distinct().join(nodes.select(F.col("node").alias("q"), "vec"), "q"))
    found = graph_search(nodes, graph, queries, keep, beam)
    nth = F.row_number().over(W.partitionBy("q").orderBy("d", "v"))
    top = found.withColumn("nth", nth).filter(F.col("nth") <= k).select("q", "v", "d")
    own = queries.select("q", F.col("q").alias("v"), F.lit(0.0).alias("d"))  # copies of the query's vector
    listed = top.union(own).join(nodes.select(F.col("node").alias("v"), "members"), "v").select("q", "d", F.explode("members").alias("vec_id"))
    nth = F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))
    listed = listed.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    out = asks.join(listed, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
