"""Near copies against brute force, on both sides of 0.8."""

import random
import re

import pytest

import corpus_pipeline
from vetra.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t):
    """Words are runs other than ASCII white space; A-Z alone is lower-cased."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """component_id by doc_id, and the similarity of every pair."""
    sets, root, alike = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                alike[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if alike[i, j] >= 0.8:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, alike


def around(changes=(1, 2, 3, 4, 5, 6, 7, 9), bases=25, words=200):
    """Texts with copies of similarities from about 0.6 to 0.97."""
    rng = random.Random(8)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
        rows.append(base)
        for n in changes:
            copy = list(base)
            for k in rng.sample(range(words), n):
                copy[k] = f"x{rng.randrange(10_000)}"
            rows.append(copy)
    return list(enumerate(map(" ".join, rows)))


@pytest.mark.parametrize("limits", [{}, {"most": 3}, {"most_shingles": 500, "task_shingles": 3_000}])
def test_components(spark, limits):
    rows = around()
    want, alike = brute(rows)
    assert sum(0.8 <= s < 0.9 for s in alike.values()) > 50 and sum(0.6 <= s < 0.8 for s in alike.values()) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, **limits).collect()} == want


def test_stage_keeps_what_is_under_and_drops_what_is_over(spark, sf_dir):
    """Pairs only: each second text lies on one side of 0.8 of the first."""
    rows = []
    for n in (3, 4, 5):
        rows += [(len(rows) + k, t) for k, (_, t) in enumerate(around((n,), 60))]
    rows = [(i, f"{t} end{i // 2}") for i, t in rows]
    want, _ = brute(rows)
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == {i for i, c in want.items() if i == c} and 10 < len(rows) - len(kept) < len(rows) // 2


def test_a_large_group_in_parts(spark):
    """Candidates that aren't all alike, over blocks: representatives do not settle it, blocks meet pair by pair."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(60):  # a chain: each changes one word more, so far ends are unlike
        base = list(base)
        base[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
        rows.append(" ".join(base))
    rows = list(enumerate(rows))
    groups = spark.createDataFrame([(0, i, 196) for i, _ in rows], "grp long, node long, n long")
    sets = spark.createDataFrame([(i, bytearray(nearcopies.shingles(t.encode(), 5).tobytes())) for i, t in rows], "node long, own binary")
    links = nearcopies.exact_links(groups, sets, 0.97, 7, 10**6, 10**6)
    got = {r.node: r.root for r in nearcopies.connected_components(links).collect()}
    own, root = [grams(t) for _, t in rows], list(range(60))
    for i in range(60):
        for j in range(i + 1, 60):
            if len(own[i] & own[j]) >= 0.97 * len(own[i] | own[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {i: got.get(i, i) for i in range(60)} == dict(enumerate(root)) and 1 < len(set(root)) < 60


def test_odd_rows(spark):
    rows = [(4, None), (2, ""), (None, "a b"), (7, "A  b"), (9, "c"), (9, "c")]
    got = sorted(map(tuple, nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (None, 7), (7, 7), (9, 9), (9, 9)], key=str)
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_short_pair_is_missed(spark):
    """Pairs at exactly 0.8 of 4 to 32 shingles (a text and the same with a few words after it), and crowds that share a passage."""
    rng, rows, pairs = random.Random(3), [], []
    for k in range(3000):
        n = 4 * rng.choice([1, 1, 1, 2, 3, 5, 8])
        words = [f"w{rng.randrange(50_000)}" for _ in range(n + 4)]
        pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"x{rng.randrange(50_000)}" for _ in range(n // 4)]))]
    passage = " ".join(f"p{i}" for i in range(30))
    crowd = [(10_000 + i, f"{passage} " + " ".join(f"y{rng.randrange(50_000)}" for _ in range(30))) for i in range(400)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows + crowd, "doc_id long, text string").repartition(4)).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert all(got[i] == i for i, _ in crowd)


def test_chained_group_is_cut_before_sets_are_compared(spark, monkeypatch):
    """60 sets with half of their shingles in common make one group; two of them are near copies, and only these are compared."""
    import numpy as np

    rng = np.random.default_rng(3)
    common = rng.integers(1, 1 << 62, 50)
    own = [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 50)])) for _ in range(60)]
    own[7] = np.unique(np.append(own[41][:-3], rng.integers(1, 1 << 62, 3)))
    sets = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(own)], "node long, own binary").cache()
    groups = spark.createDataFrame([(0, i, len(s)) for i, s in enumerate(own)], "grp long, node long, n long")
    dealt, compared = [], nearcopies._compared

    def seen(placed, *rest):
        dealt.append(placed.count())
        return compared(placed, *rest)

    monkeypatch.setattr(nearcopies, "_compared", seen)
    links = nearcopies.exact_links(groups, sets, 0.8, 5, 10_000, 10_000).collect()
    assert {frozenset(r) for r in links} == {frozenset((7, 41))}
    assert sum(dealt) <= 4


def test_sizes_too_far_apart_are_no_candidates(spark):
    """Equal bits, sets of 80, 100 and 126: only the first two can be alike at 0.8; both ways of comparing say so."""
    import numpy as np

    from vetra.llm import simhash

    fps = spark.createDataFrame([(5, 80, 1), (5, 100, 2), (5, 126, 3)], "w0 long, n int, node long")
    assert {frozenset(r) for r in simhash.near_links(fps, simhash.bit_groups(4), 1, 3, alike=0.8).collect()} == {frozenset((1, 2))}  # a task may say it again
    u, v = simhash.walk(np.zeros((3, 1), np.uint64), 3, np.array([80, 100, 126]), 0.8)
    assert list(zip(u, v)) == [(0, 1)]


def test_sets_without_partner_leave_a_large_group(spark):
    """200 sets with a passage in common, two of them near copies: only these are joined by shingle, and the answer stays."""
    import numpy as np

    rng = np.random.default_rng(5)
    common = rng.integers(1, 1 << 62, 60)
    own = [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 40)])) for _ in range(200)]
    own[9] = np.unique(np.append(own[120][:-3], rng.integers(1, 1 << 62, 3)))
    sets = spark.createDataFrame([(0, i, len(s), s.tobytes()) for i, s in enumerate(own)], "grp long, node long, n long, own binary")
    assert {r.node for r in nearcopies.with_partners(sets, 0.8).collect()} == {9, 120}
    assert {r.node for r in nearcopies.cut_groups(sets, 0.8).collect()} == {9, 120}
    alone = sets.filter("node NOT IN (9, 120)")
    assert nearcopies.with_partners(alone, 0.8).isEmpty() and nearcopies.cut_groups(alone, 0.8).isEmpty()


def test_stars_need_no_round(spark, monkeypatch):
    """Links that are stars already are looked at once; a chain still ends at its smallest node."""
    from vetra.llm import components

    kept, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: kept.append(1) or cut(df))
    stars = spark.createDataFrame([(3, 1), (4, 1), (7, 6)], "u long, v long")
    assert {tuple(r) for r in components.connected_components(stars).collect()} == {(1, 1), (3, 1), (4, 1), (6, 6), (7, 6)} and len(kept) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (51, 52)], "u long, v long")
    assert {tuple(r) for r in components.connected_components(chain).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (51, 50), (52, 50)}


def test_links_of_a_task_need_no_round(spark, monkeypatch):
    """A chain is one look and one pass of a task; dealt to several tasks in several pieces it ends with the same roots."""
    from vetra.llm import components

    kept, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: kept.append(1) or cut(df))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 52), (51, 52), (60, 60)], "u long, v long")
    want = {(i, 0) for i in range(41)} | {(50, 50), (51, 50), (52, 50)}
    got = components.connected_components(chain).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(kept) == 2
    monkeypatch.setattr(components, "TASK_LINKS", 3)
    got = components.connected_components(chain).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_shards_are_handed_to_python_one_at_a_time(spark):
    """One task for all shards: each call of the function still sees one shard, not the 28 that share the task."""
    import numpy as np

    from vetra.llm import nearcopies as nc
    from vetra.llm import simhash

    words = np.random.default_rng(9).integers(-(1 << 62), 1 << 62, (300, nc.WORDS))
    words[7] = words[200]
    fps = spark.createDataFrame([(*map(int, w), 90, i) for i, w in enumerate(words)], ", ".join(f"w{k} long" for k in range(nc.WORDS)) + ", n int, node long")
    links = simhash.near_links(fps, simhash.bit_groups(nc.GROUPS, nc.WORDS), nc.REACH, nc.LIMIT, nc.CHECK, alike=0.8)
    rows = [tuple(r) for r in links.collect()]
    assert set(rows) == {(200, 7)} and len(rows) == nc.WORDS * nc.GROUPS  # each shard says it for itself


def made_by_joins(spark, run):
    """What ``run`` returns, and the rows that the joins of its executions made by Spark's own metrics, the largest first."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made, executions = [], store.executionsList(before, 1000)
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(m) for m in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and (value := values.get(metric.accumulatorId())).isDefined():
                    made.append(int(value.get().replace(",", "")))
    return out, sorted(made, reverse=True)


def test_a_crowd_of_near_copies_is_not_joined_whole(spark):
    """Sets around one text: joins make a row for each of a set's rarest shingles, not for all of its shingles, whatever the crowd's size."""
    import numpy as np

    rng = np.random.default_rng(11)
    common = rng.integers(1, 1 << 62, 100)
    own = [np.unique(np.concatenate([np.delete(common, rng.choice(100, 10, False)), rng.integers(1, 1 << 62, 10)])) for _ in range(600)]
    for count in (300, 600):
        sets = spark.createDataFrame([(0, i, len(s), s.tobytes()) for i, s in enumerate(own[:count])], "grp long, node long, n long, own binary")
        links, made = made_by_joins(spark, lambda: nearcopies.prefix_links(sets, 0.8).collect())
        assert made and made[0] <= count * 21  # 100 - 80 + 1 of each set; all shared ones were 90
        assert {r.root for r in nearcopies.connected_components(spark.createDataFrame(links, "u long, v long")).collect()} == {0}


@pytest.mark.parametrize("places", [None, 1 << 15])
def test_prefix_links_lose_no_pair(spark, monkeypatch, places):
    """All pairs at 0.8 or more, at exactly 0.8 too, are in one component; with places shared by many shingles as well."""
    import numpy as np

    if places:
        monkeypatch.setattr(nearcopies, "MARKS", places)
    rng, own = np.random.default_rng(12), []
    for k in range(500):
        n = int(rng.choice([1, 4, 8, 20, 60]))
        s = rng.integers(-(1 << 62), 1 << 62, n)
        own += [s, np.concatenate([s, rng.integers(-(1 << 62), 1 << 62, n // 4)]), np.concatenate([s[: n // 2], rng.integers(-(1 << 62), 1 << 62, n - n // 2)])]
    sets = spark.createDataFrame([(i, len(s), np.sort(s.view(np.uint64)).tobytes()) for i, s in enumerate(own)], "node long, n long, own binary")
    root = {r.node: r.root for r in nearcopies.connected_components(nearcopies.prefix_links(sets, 0.8)).collect()}
    assert [i for i in range(0, len(own), 3) if i not in root or root[i] != root.get(i + 1)] == []
