"""Stages that are kept, the curation cascade against a plain version, and its report."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vetra.operators import report as R
from vetra.plans import cascade as C
from vetra.plans.stages import Stage, run_stages, stage_keys, table_fingerprint

COLUMNS = "image_id long, path string, class_name string, fragment_type string, sha256 string, hash long, readable boolean"


def inventory(seed, n=250):
    rng = random.Random(seed)
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.2:
            sha, h = rng.choice(made)  # an exact copy, at times of another class
        else:
            h = rng.getrandbits(16)
            if made and rng.random() < 0.2:
                h = made[-1][1] ^ (1 << rng.randrange(16))
            sha = hashlib.sha256(str(i).encode()).hexdigest()
            made.append((sha, h))
        bad = rng.random() < 0.05
        rows.append((i, f"{rng.getrandbits(40):012d}", f"c{rng.randrange(3)}", f"f{rng.choice('aabbbc')}", None if bad else sha, None if bad else h, not bad))
    return rows


def naive(rows, percentile, least, seed):
    """image_id to (role, reason, group), by loops over rows in the order of their paths, and the bound."""
    out, group = {}, {}
    free = lambda: sorted((r for r in rows if r[0] not in out), key=lambda r: r[1])
    out |= {r[0]: ("excluded", "unreadable") for r in rows if not r[6]}
    by_sha = {}
    for r in free():
        by_sha.setdefault(r[4], []).append(r)
    for sha, same in by_sha.items():
        if len({r[2] for r in same}) > 1:
            out[same[0][0]], group[same[0][0]] = ("ambiguity_probe", None), f"conflict-{sha[:12]}"
            out |= {r[0]: ("excluded", "label-conflict duplicate copy") for r in same[1:]}
        else:
            out |= {r[0]: ("excluded", "exact duplicate") for r in same[1:]}
    rest = free()
    far = sorted((a[5] ^ b[5]).bit_count() for i, a in enumerate(rest) for b in rest[:i] if a[2] != b[2])
    at = percentile * (len(far) - 1)
    bound = far[int(at)] + (at - int(at)) * (far[min(int(at) + 1, len(far) - 1)] - far[int(at)])
    root = {r[0]: r[0] for r in rest}
    moved = True
    while moved:
        moved = False
        for a in rest:
            for b in rest:
                if (a[5] ^ b[5]).bit_count() < bound and root[b[0]] < root[a[0]]:
                    root[a[0]], moved = root[b[0]], True
    group |= {i: f"g{x:04d}" for i, x in root.items()}
    members = lambda: {g: [r for r in free() if group[r[0]] == g] for g in {group[r[0]] for r in free()}}
    for same in members().values():
        if len({r[2] for r in same}) > 1:
            out |= {r[0]: ("excluded", "near-duplicate group spans classes") for r in same}
    held = {}
    for c in {r[2] for r in free()}:
        counts = Counter(r[3] for r in free() if r[2] == c)
        able = sorted((n, f) for f, n in counts.items() if n >= least)
        if len(able) >= 2:
            held[c] = able[0][1]
    for same in members().values():
        if any(held.get(r[2]) == r[3] for r in same):
            out |= {r[0]: ("heldout_known", None) for r in same}
    strata = {}
    for g, same in members().items():
        mode = lambda k: min(Counter(r[k] for r in same).items(), key=lambda x: (-x[1], x[0]))[0]  # noqa: B023, E731
        strata.setdefault((mode(2), mode(3)), []).append((hashlib.md5((seed + g).encode()).hexdigest(), g, same))
    for groups in strata.values():
        total, filled = sum(len(s) for _, _, s in groups), {"train": 0, "validation": 0, "test": 0}
        for _, _, same in sorted(groups, key=lambda x: x[:2]):
            best = max((("train", 0.7), ("validation", 0.15), ("test", 0.15)), key=lambda s: s[1] * total - filled[s[0]])[0]
            filled[best] += len(same)
            out |= {r[0]: (best, None) for r in same}
    return {i: (*v, group.get(i)) for i, v in out.items()}, bound


@pytest.mark.parametrize("seed", range(2))
def test_cascade_gives_what_loops_give(spark, tmp_path, seed):
    rows = inventory(seed)
    table = spark.createDataFrame(rows, COLUMNS).withColumn("extra", F.lit(1)).repartition(5)
    got, done = C.curate(table, str(tmp_path), percentile=0.005, bits=16, bands=2, least=3, undersized="keep", seed="x")
    want, bound = naive(rows, 0.005, 3, "x")
    assert {r.image_id: (r.role, r.exclusion_reason, r.group_id) for r in got.collect()} == want
    facts = {k: v for d in done for k, v in d.facts.items()}
    assert facts["near_duplicate_bound"] == pytest.approx(bound) and facts["mixed_groups"] > 0
    assert "extra" in got.columns and {d.rows for d in done} == {len(rows)}
    splits = C.split_rows(got).collect()
    assert len(splits) == sum(v[0] != "excluded" for v in want.values())
    assert any("|" in r.class_name for r in splits if r.role == "ambiguity_probe")


def test_what_holds_is_read_and_what_follows_a_change_is_run(spark, tmp_path):
    table = spark.createDataFrame(inventory(5, 120), COLUMNS)
    settings = dict(percentile=0.002, bits=16, bands=2, least=3, undersized="keep")
    first, done = C.curate(table, str(tmp_path), **settings)
    assert not any(d.reused for d in done)
    again, done = C.curate(table.repartition(3), str(tmp_path), **settings)
    assert all(d.reused for d in done) and sorted(again.collect(), key=lambda r: r.image_id) == sorted(first.collect(), key=lambda r: r.image_id)
    _, done = C.curate(table, str(tmp_path), **settings | {"least": 4})
    assert [d.reused for d in done] == [True] * 4 + [False] * 2
    _, done = C.curate(table.filter("image_id <> 7"), str(tmp_path), **settings)
    assert not any(d.reused for d in done)


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    table, ran = spark.range(10), []

    def add(rows, by):
        ran.append(by)
        if by == 2 and ran.count(2) == 1:
            raise RuntimeError("lost")
        return rows.withColumn("id", F.col("id") + by), {"by": by}

    stages = [Stage(f"s{i}", add, {"by": i}) for i in (1, 2, 3)]
    with pytest.raises(RuntimeError, match="lost"):
        run_stages(table, stages, str(tmp_path))
    # as if it had been lost while it wrote: a table without a document
    key = stage_keys(table_fingerprint(table), stages)[1]
    spark.range(3).write.parquet(f"{tmp_path}/s2-{key[:16]}/rows")
    done = run_stages(table, stages, str(tmp_path))
    assert ran == [1, 2, 2, 3] and [d.reused for d in done] == [True, False, False] and [d.facts["by"] for d in done] == [1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(f"{done[-1].path}/rows").collect()) == list(range(6, 16))
    with pytest.raises(ValueError, match="names"):
        run_stages(table, [stages[0]] * 2, str(tmp_path))


def test_fingerprints_tell_tables_apart(spark):
    make = lambda rows, kinds="a string, b string": table_fingerprint(spark.createDataFrame(rows, kinds))
    rows = [("x", "y"), ("z", None)]
    assert make(rows) == make(rows[::-1])
    others = [make(rows + rows[:1]), make([("x", "y"), ("z", "")]), make([("y", "x"), ("z", None)]), make([("x", "y"), (None, "z")]), make(rows, "a string, c string"), make([], "a string, b string")]
    assert len({make(rows), *others}) == 7


def test_undersized_classes_are_refused_and_empty_inventories_pass(spark, tmp_path):
    one = spark.createDataFrame([(1, "p", "c", "f", "s", 1, True)], COLUMNS)
    with pytest.raises(Exception, match="fewer than two fragment types"):
        C.curate(one, f"{tmp_path}/a", bits=16, bands=2)
    empty, done = C.curate(one.limit(0), f"{tmp_path}/b", bits=16, bands=2)
    assert empty.count() == 0 and done[3].facts["near_duplicate_bound"] == 0.0
    unread, _ = C.curate(spark.createDataFrame([(1, "p", None, None, None, None, None)], COLUMNS), f"{tmp_path}/c", bits=16, bands=2)
    assert [r.exclusion_reason for r in unread.collect()] == ["unreadable"]


def test_counts_of_all_facets_come_from_one_scan(spark, tmp_path):
    rows = [("a", "x", "train", None, True), ("a", "x|\ny", "test", None, True), ("b", None, "excluded", "unreadable", False), (None, "x", None, None, None)]
    table = spark.createDataFrame(rows, "class_name string, fragment_type string, role string, exclusion_reason string, readable boolean").withColumn("facet", F.lit(1)).withColumn("images", F.lit(7))
    counts = R.facet_counts(table, R.FACETS, R.curation_measures())
    assert counts._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = {(r.facet, tuple(r["keys"])): (r.images, r.readable, r.usable) for r in counts.collect()}
    want = {}
    for name, of in R.FACETS.items():
        if set(of) <= set(table.columns):
            for r in table.collect():
                at = (name, tuple(r[c] for c in of))
                old = want.get(at, (0, 0, 0))
                want[at] = (old[0] + 1, old[1] + bool(r.readable), old[2] + (r.role in ("train", "test")))
    assert got == want and {k[0] for k in got} == {"all", "class", "role", "class_role", "exclusion", "fragment"}
    empty = R.facet_counts(table.limit(0), R.FACETS, R.curation_measures()).collect()
    assert [tuple(r) for r in empty] == [("all", [], 0, 0, 0)]
    with pytest.raises(ValueError, match="same columns"):
        R.facet_counts(table, {"a": ["role"], "b": ["role"]}, R.curation_measures())

    written = R.write_report(table, str(tmp_path), "Inventory", {"bound": 3.0, "types": {"a": "x"}}, most=1)
    assert sorted(written.collect(), key=str) == sorted(counts.collect(), key=str)
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json/counts").collect()]
    assert len(lines) == len(want) and {"facet": "class", "keys": ["a"], "images": 2, "readable": 2, "usable": 2} in lines
    assert json.loads(spark.read.text(f"{tmp_path}/json/facts").first().value) == {"title": "Inventory", "bound": 3.0, "types": {"a": "x"}}
    text = spark.read.text(f"{tmp_path}/markdown", wholetext=True).first().value
    assert text.startswith("# Inventory\n") and '| types | {"a": "x"} |' in text and "| a | 2 | 2 | 2 |" in text and "2 more in the table of counts." in text


def test_close_pairs_against_all_pairs(spark):
    """Bound, number of closer pairs and components of wide hashes by one look at each pair of blocks; before, links met by runs of bits, of which the topmost four never differ."""
    import numpy as np

    from vetra.operators import distances as D

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 60)
    flip = lambda h, k: int(h) ^ sum(1 << int(b) for b in rng.choice(60, k, replace=False))
    data = [(i, f"c{rng.integers(3)}", flip(base[rng.integers(60)], int(rng.integers(0, 6)))) for i in range(300)] + [(300, "c0", None), (301, "c1", int(base[0])), (302, "c2", int(base[0]))]
    rows = spark.createDataFrame(data, "image_id long, class_name string, hash long")
    real = [r for r in data if r[2] is not None]
    pairs = [(a, b, (a[2] ^ b[2]).bit_count()) for i, a in enumerate(real) for b in real[i + 1 :]]
    for p, guess in ((0.01, None), (0.01, 0), (0.3, None), (0.0, None)):
        bound = float(np.percentile([d for a, b, d in pairs if a[1] != b[1]], 100 * p))
        got, links, close = D.close_pairs(rows, p, per_block=70, guess=guess)
        assert got == pytest.approx(bound) and links == sum(d < bound for _, _, d in pairs)
        root = {r[0]: r[0] for r in data}
        for _ in range(300):
            for a, b, d in pairs:
                if d < bound:
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
            if all(root[a[0]] == root[b[0]] for a, b, d in pairs if d < bound):
                break
        assert {r["image_id"]: r["root"] for r in C.K.linked_groups(rows, close, got > 0).collect()} == root


def test_groups_of_bits_leave_few_pairs_and_lose_none(spark):
    """Counts and components by groups of bits are those of all pairs, and a small part of these is looked at; before, all were."""
    import numpy as np
    import pyarrow as pa

    from vetra.operators import distances as D

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 400)
    flips = (np.uint64(1) << rng.integers(0, 60, (6000, 6)).astype(np.uint64)) * (rng.random((6000, 6)) < 0.7)
    hashes = np.unique(base[rng.integers(0, 400, 6000)].view(np.uint64) ^ np.bitwise_xor.reduce(flips.astype(np.uint64), axis=1))
    n, half = len(hashes), 2500
    hashes = rng.permutation(hashes)
    table = {"class_name": [f"c{i % 3}" if i % 50 else None for i in range(n)], "hash": hashes.view(np.int64), "n": rng.integers(1, 3, n)}
    every = lambda found: found.filter(pa.compute.greater(found["n"], 0)).to_pylist()
    linked = lambda found, size: sorted(zip(*(x.tolist() for x in D.stars(*(found.filter(pa.compute.equal(found["n"], 0))[c].to_numpy() for c in "ab")))))
    assert D.bit_groups(hashes, 14, 2_000) == [] and D.bit_groups(hashes, 40, 200_000) == []
    for cap in (9, 12, 14):
        groups = D.bit_groups(hashes, cap, 200_000)
        assert groups and sum(r for _, r in groups) == cap - len(groups) + 1 and not {60, 61, 62, 63} & {b for bits, _ in groups for b in bits}
        for key, block in (((0, 0), [0] * n), ((0, 1), [0] * half + [1] * (n - half))):
            tab = pa.table({**table, "block": pa.array(block, pa.int32())})
            key = tuple(map(pa.scalar, key))
            got, want = D._close(cap, groups)(key, tab), D._close(cap, [])(key, tab)
            assert every(got) == every(want) and linked(got, n) == linked(want, n)
        looked = sum((end - start) * len(partners) for g in groups for start, end, partners in D._dealt(hashes, hashes, [g], True)[2])
        assert looked < 0.15 * n * n


def test_a_guess_too_low_is_raised_step_by_step(spark, monkeypatch):
    """Before, a guess too low was followed by all distances, for which no group of bits helps."""
    import numpy as np

    from vetra.operators import distances as D

    caps, real = [], D._blockwise
    monkeypatch.setattr(D, "_blockwise", lambda counted, m, cap, *rest: caps.append(cap) or real(counted, m, cap, *rest))
    data = [(f"c{i % 2}", int(h)) for i, h in enumerate(np.random.default_rng(1).integers(0, 1 << 60, 400))]
    rows = spark.createDataFrame(data, "class_name string, hash long")
    far = [(a[1] ^ b[1]).bit_count() for i, a in enumerate(data) for b in data[:i] if a[0] != b[0]]
    bound, links, _ = D.close_pairs(rows, 0.001, guess=min(far) - 1)
    assert bound == pytest.approx(np.percentile(far, 0.1)) and len(caps) > 1 and caps[-1] < 30
    assert links == sum((a[1] ^ b[1]).bit_count() < bound for i, a in enumerate(data) for b in data[:i])


def test_links_are_contracted_in_tasks_before_rounds(spark):
    """Roots where links fit a task, fit after some passes, and don't; before, all went through rounds of joins."""
    import numpy as np

    rng = np.random.default_rng(8)
    names = np.unique(rng.integers(-(1 << 62), 1 << 62, 600))
    crowd, chain = rng.integers(0, 200, (3000, 2)), np.stack([np.arange(200, 500), np.arange(201, 501)], axis=1)
    links = [(int(names[a]), int(names[b])) for a, b in np.concatenate([crowd, chain]) if a != b]
    root = {x: x for pair in links for x in pair}
    while True:
        moved = [(a, b) for a, b in links if root[a] != root[b]]
        if not moved:
            break
        for a, b in moved:
            root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame(links, "a long, b long").repartition(12)
    for most in (100_000, 1_500, 150):
        assert {r.node: r.root for r in C.K.hash_roots(rows, most).collect()} == {x: r for x, r in root.items() if x != r}
    assert C.K.hash_roots(rows.limit(0)).collect() == []


def test_each_pair_of_blocks_has_a_task_of_its_own(spark):
    """Before, pairs of blocks were dealt by hash, so that some tasks had several and others none."""
    import numpy as np

    from vetra.operators import distances as D

    hashes = np.random.default_rng(2).integers(0, 1 << 60, 500)
    counted = spark.createDataFrame([("c", int(h), 1) for h in hashes], "class_name string, hash long, n long")
    found = D._blockwise(counted, 500, 30, 100, hashes.view(np.uint64)).select(F.spark_partition_id().alias("task")).groupBy("task").count()
    assert found.count() == 15
