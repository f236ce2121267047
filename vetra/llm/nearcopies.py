"""Near copies: candidates by SimHash and its vantage-point trees, each checked by exact Jaccard similarity.

Two texts at a Jaccard similarity of 0.8 differ in about 15 % of the bits of a SimHash over their distinct
shingles. A radius that wide in one 64-bit word would leave trees nothing to prune. So the fingerprint has
``WORDS`` words, cut into groups of 16 bits, each with a tree of reach one: a pair at 0.8 lies within reach
in a given group with probability 0.28 (0.37 at 0.85, 0.50 at 0.9), in none of the 28 with 1e-4 (3e-6,
5e-9). Found pairs must also agree in all but ``LIMIT`` of the first 128 bits (on average 19 differ at
0.8, 64 for unlike texts).

Short texts vary more than that. Sets of up to ``SHORT`` shingles therefore also meet by prefix: of two sets at 0.8,
each has one of its n - 0.8 n + 1 rarest shingles in common with the other, so sets that share one are
candidates. For pairs whose smaller set has up to 0.8 * ``SHORT`` shingles, nothing is left to chance.

Candidates form groups. Within a group sets are compared exactly, breadth-first: a set that is reached is
not held against its own component again. Large groups are chains of texts that merely have parts in common, and grow faster than
the table; they are first cut by prefix, as above. A group too large for one task even so is cut into blocks: sets are
compared within their block, then representatives of the components with each other, and only if that
leaves a group in several parts, block by block. Equal sets are one node, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, small_batches, trimmed, trimmed_group
from vetra.llm.components import connected_components
from vetra.llm.simhash import SEED, bit_groups, majority, near_links, stars

WORDS, GROUPS, REACH, CHECK, LIMIT = 7, 4, 1, 2, 36
#: Sets up to this size meet by their rarest shingles too; parts of the sets that share one.
SHORT, SALTS = 40, 64
#: Bits that mark wanted texts.
MARKS = 1 << 24
#: Groups of more sets than this are cut by their rarest shingles before sets are compared.
LARGE = 500
#: Shingles in more sets than these are the more common ones.
COMMON = (1, 2, 4, 16, 64, 256)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``n`` words of ``raw`` (UTF-8), A-Z lower-cased; a shorter text is one shingle."""
    import xxhash

    parts = raw.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    width = min(n, len(word))
    total = np.full(len(word) - width + 1, len(word) if len(word) < n else n, np.uint64)
    for j in range(width):
        total = _scramble(total * _MIX + word[j : len(word) - width + 1 + j])
    return np.unique(total)


def fingerprint(own: np.ndarray) -> np.ndarray:
    """``WORDS`` words: the SimHash of as many hashes of each shingle."""
    return majority(_scramble(own[:, None] + np.arange(WORDS, dtype=np.uint64) * _MIX))


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, place (a hash of the text), node (a hash of its set), n (the set's size), own (the set, if it is short) and the fingerprint of every document."""
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches):
        import xxhash

        for batch in batches:
            node, n, short, fp = [], [], [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, x in enumerate(batch.column(2)):
                own = shingles(x.as_py() or b"", shingle)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED)), n.append(len(own)), short.append(own.tobytes() if len(own) <= SHORT else None)
                fp[i] = fingerprint(own)
            node = pa.array(np.array(node, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(n, pa.int64()), pa.array(short, pa.binary()), *(pa.array(fp[:, k].copy().view(np.int64)) for k in range(WORDS))], names=["doc_id", "place", "node", "n", "own", *words])

    text = F.col("text").cast("string").cast("binary")
    schema = "doc_id long, place long, node long, n long, own binary, " + ", ".join(f"{w} long" for w in words)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text")).mapInArrow(trimmed(run), schema)


def _prefix(similar: float) -> Column:
    """How many of the rarest of n shingles a set of that similarity has one of."""
    return F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of a batch of node, n, own and perhaps grp; all their shingles, one set after the other."""
    sizes = batch.column(1).to_numpy()
    hashes = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in batch.column(2))])
    if batch.num_columns > 3:  # a shingle of another group is another shingle
        hashes = hashes ^ np.repeat(_scramble(batch.column(3).to_numpy().view(np.uint64) * _MIX).view(np.int64), sizes)
    return sizes, hashes


def _spread(nodes: DataFrame) -> DataFrame:
    """A row node, h for each shingle of ``nodes`` (node, n, own and perhaps grp)."""

    def spread(batches):
        for batch in batches:
            sizes, hashes = _flat(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(hashes)], names=["node", "h"])

    return nodes.select("node", "n", "own", *(["grp"] if "grp" in nodes.columns else [])).mapInArrow(trimmed(spread), "node long, h long")


def _levels(shared: DataFrame) -> np.ndarray:
    """How common shingles are, by their place h mod the number of places: a bit of each of ``COMMON``, set if one of that place is in more sets.

    ``shared`` (h, often) has all shingles of two or more sets. 16 times as many places as those, of ``MARKS`` at most: 12 MB whatever
    the number of documents. Places in common make shingles seem more common, which changes their order and nothing else.
    """
    places = min(MARKS, max(1 << 15, 16 << int(shared.count()).bit_length()))
    x = F.pmod("h", F.lit(places)) + 1  # both functions count from 1
    bits = [F.bitmap_construct_agg(F.when(F.col("often") > more, F.bitmap_bit_position(x))).alias(f"b{k}") for k, more in enumerate(COMMON)]
    out = np.zeros((places >> 15, len(COMMON), 4096), np.uint8)
    for r in shared.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(*bits).collect():  # at most MARKS / 2 ** 15 rows of 4 KB a bit
        out[r["b"] - 1] = [np.frombuffer(bytes(r[f"b{k}"]), np.uint8) for k in range(len(COMMON))]
    return out


def _prefixes(nodes: DataFrame, similar: float, levels: np.ndarray) -> DataFrame:
    """node, h of the rarest shingles of each of ``nodes`` (by ``levels``, then by hash), as many as ``_prefix`` says, without those of one set alone."""
    places = len(levels) << 15

    def run(batches):
        for batch in batches:
            sizes, hashes = _flat(batch)
            at = hashes % places
            level = (levels[at >> 15, :, (at & 0x7FFF) >> 3] >> (at & 7).astype(np.uint8)[:, None] & 1).sum(axis=1)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, level, owner))
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - np.ceil(sizes * similar - 1e-9) + 1  # as _prefix
            keep = order[(nth < np.repeat(prefix, sizes)) & (level[order] > 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(hashes[keep])], names=["node", "h"])

    return nodes.select("node", "n", "own", *(["grp"] if "grp" in nodes.columns else [])).mapInArrow(trimmed(run), "node long, h long")


def with_partners(nodes: DataFrame, similar: float) -> DataFrame:
    """``nodes`` (grp, node, n, own) without those whose rarest shingles are all in no other set of the group.

    No set has ``similar`` with them. As they go, shingles of others become rare; that is repeated while half of the sets go, so
    all rounds together read no more than twice the first.
    """
    left, before = nodes, nodes.count()
    while before:
        alone = _spread(left).groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("node").alias("node")).filter("often = 1")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        left = cut(left.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) < _prefix(similar)).select(*nodes.columns))
        if (now := left.count()) * 2 > before:
            break
        before = now
    return left


def prefix_links(nodes: DataFrame, similar: float) -> DataFrame:
    """Links u, v that join all sets of ``nodes`` (node, n, own) which share one of their rarest shingles; with a column grp, those of one grp.

    A set's prefix has n - similar * n + 1 shingles, rarest first (by how often they are, in steps, ties by hash: any order
    that is the same for all sets will do). Shingles of one set alone come before all others and join nothing, so only the rest of the
    prefix is dealt, about a fifth of a set at 0.8; how common a shingle is is looked up where the set is. The sets that share a shingle
    are joined to the smallest of their part, and the parts' smallest to the smallest of all: no
    shingle, however common, brings over 1 / SALTS of its sets into one task, and no join makes more rows than there are such shingles.
    """

    shared = cut(_spread(nodes).groupBy("h").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("part")
    keys = cut(_prefixes(nodes, similar, _levels(shared)).select("h", part, "node"))
    heads = keys.groupBy("h", "part").agg(F.min("node").alias("head"))
    firsts = heads.groupBy("h").agg(F.min("head").alias("v"))
    stars = keys.join(heads, ["h", "part"]).select(F.col("node").alias("u"), F.col("head").alias("v"))
    return stars.unionByName(heads.join(firsts, "h").select(F.col("head").alias("u"), "v")).filter("u <> v").distinct()


def _marks(wanted: DataFrame) -> np.ndarray:
    """Which places mod ``MARKS`` are wanted, as bits: 2 MB whatever the number of documents."""
    x = F.pmod("place", F.lit(MARKS)) + 1  # both functions count from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()  # at most MARKS / 2 ** 15 rows of 4 KB
    out = np.zeros((MARKS >> 15, 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``wanted`` (place, ...) with own, the sorted shingles of the text of that place as bytes, instead of place.

    Texts whose place is not marked are passed over where they are read, so few sets are shuffled and no text is.
    """
    marks = _marks(wanted)

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy() % MARKS
            hit = np.flatnonzero(marks[at >> 15, (at & 0x7FFF) >> 3] >> (at & 7).astype(np.uint8) & 1)
            own = [shingles(batch.column(1)[i].as_py() or b"", shingle).tobytes() for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(own, pa.binary())], names=["place", "own"])

    text = F.col("text").cast("string").cast("binary")
    found = docs.select(F.xxhash64(text).alias("place"), text.alias("text")).mapInArrow(trimmed(run), "place long, own binary")
    return found.dropDuplicates(["place"]).join(wanted, "place").drop("place")


def forest(sets: list[np.ndarray], similar: float) -> tuple[list[int], list[int]]:
    """Row numbers u, v of a spanning forest of all links at Jaccard ``similar`` or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    flat_of = [flat[a:b] for a, b in zip(edges, edges[1:])]
    alive, listed, marks = np.ones(len(sets), bool), len(sets), np.zeros(len(values), bool)
    left, right = [], []
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start], queue = False, [start]
        while queue:
            x = queue.pop()
            if (now := int(alive.sum())) * 2 < listed:  # what is reached leaves the list
                still = alive[owner]
                flat, owner, listed = flat[still], owner[still], now
            if not now:
                return left, right
            marks[flat_of[x]] = True
            shared = np.bincount(owner[marks[flat]], minlength=len(sets))
            marks[flat_of[x]] = False
            found = np.flatnonzero(alive & (shared + 1e-9 >= similar * (sizes + sizes[x] - shared)))
            alive[found] = False
            left += [x] * len(found)
            right += found.tolist()
            queue += found.tolist()
    return left, right


def _compared(placed: DataFrame, similar: float, task_shingles: int) -> DataFrame:
    """Links u, v that span those among the sets of each grp and block of ``placed`` (grp, i, j, node, n, own)."""
    weight, rows = placed.agg(F.sum("n"), F.count(F.lit(1))).first()
    tasks = max(1, -(-(weight or 0) // task_shingles), min(rows, placed.sparkSession.sparkContext.defaultParallelism))

    def run(key, tab):
        tab = tab.sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        where = np.stack([tab.column(c).to_numpy() for c in ("grp", "i", "j")])
        node, sets = tab.column("node").to_numpy(), tab.column("own")
        edges = np.flatnonzero(np.any(where[:, 1:] != where[:, :-1], axis=0)) + 1
        left, right = [node[:0]], [node[:0]]
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(node)]):
            if b - a > 1:
                u, v = forest([np.frombuffer(x, np.uint64) for x in sets.slice(a, b - a).to_pylist()], similar)
                left.append(node[a:b][u]), right.append(node[a:b][v])
        return pa.table(dict(zip("uv", stars(np.concatenate(left), np.concatenate(right)))))

    bucket = F.pmod(F.xxhash64("grp", "i", "j"), F.lit(tasks))
    return placed.select(bucket.alias("bucket"), "grp", "i", "j", "node", "own").groupBy("bucket").applyInArrow(trimmed_group(run), "u long, v long")


def _blocks(rows: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """``rows`` (grp, node, n) with k, the number of blocks that grp needs, and i, the block of the node."""
    sized = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / most_shingles), F.lit(1)).cast("int").alias("k"))
    return rows.join(sized, "grp").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))


def sized(groups: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """``groups`` (grp, node, n) with large: whether the group has over ``most`` sets or ``most_shingles``."""
    found = groups.groupBy("grp").agg(((F.count(F.lit(1)) > most) | (F.sum("n") > most_shingles)).alias("large"))
    return groups.join(found, "grp")


def cut_groups(sets: DataFrame, similar: float) -> DataFrame:
    """grp, node, n, own of ``sets`` (the same) with groups cut where no set shares one of its rarest shingles with another.

    That parts no pair with a similarity of ``similar`` or more. Sets that are left alone go.
    """
    left = with_partners(sets, similar)
    parts = connected_components(prefix_links(left, similar)).select("node", F.col("root").alias("grp"))
    return cut(left.drop("grp").join(parts, "node").select("grp", "node", "n", "own"))


def exact_links(groups: DataFrame, sets: DataFrame, similar: float, most: int, most_shingles: int, task_shingles: int) -> DataFrame:
    """Links u, v that span all pairs of one group of ``groups`` (grp, node, n) with a similarity of ``similar`` or more; ``sets``: node, own."""
    return _links(cut(sized(groups, min(most, LARGE), most_shingles).join(sets, "node")), similar, most, most_shingles, task_shingles)


def _links(sets: DataFrame, similar: float, most: int, most_shingles: int, task_shingles: int) -> DataFrame:
    """As ``exact_links``, of ``sets`` (grp, node, n, large, own), which should be checkpointed: only what is large is dealt more than once."""
    blocks = sets.filter("NOT large").select("grp", "node", "n", "own", F.lit(1).alias("k"), F.lit(0).alias("i"))
    large = sets.filter("large").select("grp", "node", "n", "own")
    if large.isEmpty():
        return cut(_compared(blocks.withColumn("j", F.col("i")), similar, task_shingles))
    dealt = cut(_blocks(cut_groups(large, similar), most, most_shingles))
    links = cut(_compared(blocks.unionByName(dealt.select(*blocks.columns)).withColumn("j", F.col("i")), similar, task_shingles))
    split, own = dealt.filter("k > 1").drop("own"), dealt.filter("k > 1").select("node", "own")
    if split.isEmpty():
        return links

    def parts() -> DataFrame:
        """The sets of split groups, each with the component it is in so far."""
        return split.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    speak = parts().groupBy("grp", "root").agg(F.min(F.struct("node", "n")).alias("s")).select("grp", "s.node", "s.n")
    links = cut(links.unionByName(_compared(_blocks(speak, most, most_shingles).withColumn("j", F.col("i")).join(own, "node"), similar, task_shingles)))
    apart = parts()
    apart = cut(apart.join(apart.groupBy("grp").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("grp"), "grp", "left_semi"))
    if apart.isEmpty():
        return links
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = apart.withColumn("mine", F.col("i")).withColumn("other", other).filter("mine <> other")
    dealt = dealt.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "n")
    return links.unionByName(_compared(dealt.join(own, "node"), similar, task_shingles))


def near_copies(docs: DataFrame, shingle: int = 5, similar: float = 0.8, most: int = 20_000, most_shingles: int = 1_500_000, task_shingles: int = 1_500_000) -> DataFrame:
    """doc_id and component_id of every document.

    Two texts are linked if the Jaccard similarity of their distinct shingles is ``similar`` or more: all of
    them where the smaller set has at most 32 shingles; of larger ones, a pair at exactly 0.8 is no
    candidate with a probability of about 1 in 3,000, and rarer above. A null text counts as empty, and empty texts belong together. component_id is the smallest doc_id of
    the component (null only where all its ids are null). Whole texts are read, whatever their length.
    Repeated rows are repeated; an empty table gives an empty result; other columns are ignored.
    """
    words = [f"w{k}" for k in range(WORDS)]
    small_batches(docs.sparkSession)
    marked = cut(_marked(docs, shingle))
    first = F.min(F.struct("place", "n", "own", *words)).alias("first")
    nodes = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least"), first).select("node", "least", "first.*"))
    candidates = near_links(nodes.filter("n > 0").select(*words, F.col("n").cast("int").alias("n"), "node"), bit_groups(GROUPS, WORDS), REACH, LIMIT, CHECK, per_shard=393_216, alike=similar)
    candidates = candidates.unionByName(prefix_links(nodes.filter("n > 0 AND own IS NOT NULL"), similar))
    groups = connected_components(candidates).join(nodes.select("node", "n", "place"), "node").select(F.col("root").alias("grp"), "node", "n", "place")
    wanted = cut(sized(groups, min(most, LARGE), most_shingles))
    links = _links(cut(_sets(docs, wanted, shingle)), similar, most, most_shingles, task_shingles)
    rooted = nodes.select("node", "least").join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(rooted.select("node", "root").join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
