"""Hand-computed cases and invariants of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from vetra.functions import canvas as C
from vetra.functions import vectors as V
from vetra.operators import calibration as A
from vetra.operators import curation as K
from vetra.operators import distances as D
from vetra.operators import evaluation as E
from vetra.operators import release as L
from vetra.operators import retrieval as R
from vetra.operators import screening as S
from vetra.sources import tables as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def matches(*pairs):
    rows = [F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("similarity"), F.lit(i).alias("reference_id"), F.lit(c).alias("class_name")) for i, (s, c) in enumerate(pairs)]
    return F.array(*rows)


def test_vote_prefers_the_larger_share(spark):
    support = one(spark, R.class_support(matches((0.9, "a"), (0.5, "b"), (0.5, "b"))))
    assert support[0]["class_name"] == "b" and support[0]["weighted_share"] == pytest.approx(1.0 / 1.9)


def test_vote_tie_goes_to_the_best_match(spark):
    assert one(spark, R.class_support(matches((0.8, "b"), (0.4, "a"), (0.4, "a"))))[0]["class_name"] == "b"


def test_vote_without_positive_weight(spark):
    support = one(spark, R.class_support(matches((-0.1, "b"), (-0.2, "a"))))
    assert [s["weighted_share"] for s in support] == [0.0, 0.0] and support[0]["class_name"] == "b"


def test_search_caps_k_and_ranks(spark):
    refs = spark.createDataFrame([(i, "a", "f", [1.0, float(i)]) for i in range(6)], "reference_id long, class_name string, fragment_type string, v array<double>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "vec_id long, v array<double>")
    found = R.search(queries, refs, 50).first()["matches"]
    assert [m["reference_id"] for m in found] == [5, 4, 3, 2, 1, 0] and [m["rank"] for m in found] == [1, 2, 3, 4, 5, 6]


def test_distance_is_of_the_first_k(spark):
    assert 1 - one(spark, R.mean_similarity(matches((0.9, "a"), (0.9, "a"), (0.9, "a"), (0.0, "a")), 3)) == pytest.approx(0.1)
    assert 1 - one(spark, R.mean_similarity(matches((0.9, "a"), (0.7, "a"), (0.5, "a")), 3)) == pytest.approx(0.3)


def test_status_bands_are_strict(spark):
    c = S.Calibration(k=3, threshold=0.5, boundary=0.3)
    assert [one(spark, S.status(F.lit(d), c)) for d in (0.3, 0.31, 0.5, 0.51)] == ["KNOWN", "UNCERTAIN", "UNCERTAIN", "UNKNOWN"]


def test_risk_does_not_overflow(spark):
    c = S.Calibration(risk_slope=10_000.0, risk_intercept=0.0)
    assert [one(spark, S.risk(F.lit(x), c)) for x in (1.0, -1.0)] == [1.0, 0.0]


def test_strength(spark):
    parts = [F.lit(x) for x in (0.9, 1.0, 0.9, 0.5)]
    assert one(spark, S.strength(*parts)) == pytest.approx(math.exp(sum(map(math.log, (0.9, 1.0, 0.9, 0.5))) / 4))
    assert one(spark, S.strength(F.lit(0.9), F.lit(0.0), F.lit(1.0), F.lit(1.0))) == 0.0


def test_agreement(spark):
    same, most, few = matches((0.9, "a"), (0.8, "a")), matches((0.9, "a"), (0.8, "b")), matches((0.9, "b"), (0.8, "b"))
    assert [one(spark, S.agreement(F.lit("a"), F.lit(r), m)) for r, m in (("a", same), ("a", most), ("b", few))] == ["HIGH", "MEDIUM", "LOW"]


@pytest.mark.parametrize("failing", range(5))
def test_one_failed_check_sends_to_review(spark, failing):
    names = ["confidence", "similarity", "risk", "agreement", "quality"]
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i != failing).alias("passed")) for i, n in enumerate(names)])
    decision = S.decide(F.lit("KNOWN"), checks)
    assert one(spark, decision) == "REVIEW" and one(spark, S.reason(decision, checks)) == f"failed: {names[failing]}"
    assert one(spark, S.decide(F.lit("UNKNOWN"), checks)) == "UNKNOWN"


def test_select_threshold(spark):
    known = spark.createDataFrame([(0.1 + 0.2 * i / 19,) for i in range(20)], "distance double")
    ood = spark.createDataFrame([(0.7 + 0.2 * i / 19,) for i in range(20)], "distance double")
    r = A.select_threshold(known, ood, 0.95).first()
    assert r["boundary"] == 0.1 + 0.2 * 18 / 19 and r["threshold"] == pytest.approx((r["boundary"] + 0.7) / 2)
    assert (r["known_acceptance"], r["ood_acceptance"]) == (1.0, 0.0)


def test_lower_quantile_differs_from_discrete():
    assert A.lower_quantile_place(1.0 - 0.95, 20) == 0 and A.lower_quantile_place(1.0 - 0.95, 100) == 4


def test_min_confidence_without_a_solution(spark):
    rows = spark.createDataFrame([(0.9, False), (0.8, False)], "confidence double, ok boolean")
    r = A.select_min_confidence(rows, 0.9).first()
    assert (r["min_confidence"], r["accuracy"], r["coverage"], r["met"]) == (1.0, None, 0.0, False)


def test_names(spark):
    for raw, want in (("cropped_Rambut Penutup 28(1)", "rambut penutup"), ("Stone  Cell (2)", "stone cell"), ("fibre 3", "fibre")):
        assert one(spark, K.normalise_name(F.lit(raw))) == want
    assert one(spark, K.normalise_name(F.lit("stone cel"), {"stone cel": "stone cell"})) == "stone cell"


def test_hamming(spark):
    assert one(spark, C.hamming(F.lit(0b1011), F.lit(0b0010))) == 2


def test_cascade_keeps_the_first_role(spark):
    rows = K.begin(spark.createDataFrame([(1,), (2,)], "image_id long"))
    rows = K.assign(K.assign(rows, F.col("image_id") == 1, "excluded", "a"), F.lit(True), "train")
    assert {(r["image_id"], r["role"], r["exclusion_reason"]) for r in rows.collect()} == {(1, "excluded", "a"), (2, "train", None)}


def test_links_and_groups(spark):
    rows = spark.createDataFrame([(1, 0b0000), (2, 0b0001), (3, 0b0011), (9, 0b11110000)], "image_id long, hash long")
    links = K.near_links(rows, 2, bands=2, bits=16)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(1, 2), (2, 3)}
    assert {(r["node"], r["root"]) for r in K.group_roots(links).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_histogram_percentile_equals_pairs(spark):
    import numpy as np

    rows = spark.createDataFrame([(f"c{i % 3}", (i * 37) % 256) for i in range(40)] + [(None, 3), ("c1", None)], "class_name string, hash long")
    own = [(r["class_name"], r["hash"]) for r in rows.dropna().collect()]
    pairs = [bin(x ^ y).count("1") for a, (ca, x) in enumerate(own) for cb, y in own[a + 1 :] if ca != cb]
    for bits in (8, 13, 64):
        assert K.percentile_of_histogram(D.distance_histogram(rows, bits), 0.1).first()[0] == np.percentile(pairs, 10)


def test_distances_by_transform_and_by_blocks_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    for bits in (1, 5, 12, 64):
        own = [(f"c{rng.randrange(4)}", rng.getrandbits(bits)) for _ in range(150)] + [("c0", 0)] * 60  # a third are one hash
        own = [(c, h - (1 << 64) if h >> 63 else h) for c, h in own]
        want = {}
        for i, (a, x) in enumerate(own):
            for b, y in own[i + 1 :]:
                if a != b:
                    d = bin((x ^ y) & ((1 << 64) - 1)).count("1")
                    want[d] = want.get(d, 0) + 1
        rows = spark.createDataFrame(own, "class_name string, hash long")
        assert {r["distance"]: r["n"] for r in D.distance_histogram(rows, bits).collect()} == want
        assert {r["distance"]: r["n"] for r in D.distance_histogram(rows, 64, per_block=40).collect()} == want
    with pytest.raises(ValueError, match="pairs"):
        D.distance_histogram(rows, 64, most_pairs=10)
    assert D.distance_histogram(rows.limit(0), 8).count() == D.distance_histogram(rows.filter("class_name = 'c1'"), 8).count() == 0


def test_large_counts_stay_whole():
    """Squares beyond 64 bits: two hashes of 2**40 rows each."""
    import pyarrow as pa

    from vetra.operators.distances import _powers

    tab = pa.table({"part": [0, 0], "hash": [0, 3], "n": [2**40, 2**40]})
    got = _powers(2)((pa.scalar(0),), tab)
    assert [int(x) for x in got.column("power").to_pylist()] == [2**82, 0, 2**82]


def test_dihedral_views_differ():
    views = C.dihedral_places(4)
    assert views[0] == list(range(16)) and len({tuple(v) for v in views}) == 8


def test_pad_keeps_a_constant(spark):
    assert one(spark, C.pad_to_square(F.array(*[F.lit(90.0)] * 12), 2, 6)) == [90.0] * 36


def test_pooling(spark):
    cls, patch = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    got = one(spark, V.pool("cls_patchmean", cls, patch))
    assert sum(x * x for x in got) == pytest.approx(1) and sum(x * x for x in got[:2]) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        V.pool("cls_last4", cls, patch)
    with pytest.raises(ValueError):
        V.pool("other", cls, patch)


@pytest.mark.parametrize("mine,best,latency,yes", [((0.91, 0.5), (0.9, 0.3), 100, True), ((0.9, 0.29), (0.9, 0.3), 100, True), ((0.9, 0.3), (0.9, 0.3), 100, False), ((0.99, 0.1), (0.9, 0.3), 4000, False)])
def test_adoption(spark, mine, best, latency, yes):
    assert one(spark, E.adopts(F.lit(mine[0]), F.lit(mine[1]), F.lit(best[0]), F.lit(best[1]), F.lit(float(latency)), 3000.0)) is yes


def test_recent_limits(spark):
    rows = spark.createDataFrame([(1, "2024"), (2, "2024")], "id long, created_at string")
    assert [r["id"] for r in E.recent(rows, 1).collect()] == [2]
    with pytest.raises(ValueError):
        E.recent(rows, 201)


def test_upload_order(spark):
    code = lambda k, n: one(spark, L.upload_code(F.lit(k), F.lit(n), ["png"], 10))
    assert [code("txt", 99), code("png", 99), code("png", 0), code("png", 5)] == [415, 413, 422, 200]


def test_manifest(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("1"), b.write_text("2")
    manifest = L.build_manifest({"a": a, "b": b})
    assert L.verify_manifest(manifest) == {}
    a.write_text("3"), b.unlink()
    assert L.verify_manifest(manifest) == {"a": "changed", "b": "missing"}


def test_csv_keeps_empty_strings(spark, tmp_path):
    rows = spark.createDataFrame([("1e5", "", "train", "b"), ("00012", "x", "train", "a")], "image_id string, group_id string, role string, path string")
    T.write_splits(rows, str(tmp_path / "s"))
    got = T.read_csv_strings(spark, str(tmp_path / "s" / "role=train"), ["image_id", "group_id", "path"]).collect()
    assert {tuple(r) for r in got} == {("1e5", "", "b"), ("00012", "x", "a")}


def test_directory_inventory(spark, tmp_path):
    for name in ("k1/a.png", "k2/b.png", "k2/.hidden"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xyz")
    rows = T.directory_inventory(spark, str(tmp_path)).collect()
    assert {(r["class_name"], r["filename"], r["file_size"]) for r in rows} == {("k1", "a.png", 3), ("k2", "b.png", 3)}


def test_artifact_ignores_extras():
    assert T.load_artifact('{"k": 3, "extra": 1}', {"k": int}) == {"k": 3}
    with pytest.raises(ValueError):
        T.load_artifact("{}", {"k": int})


def test_split_covers_every_group(spark):
    groups = spark.createDataFrame([(f"g{i}", "c", "f", 1 + i % 3) for i in range(40)], "group_id string, class_name string, fragment_type string, size long")
    rows = K.greedy_split(groups).collect()
    assert len(rows) == 40 and {r["split"] for r in rows} == {"train", "validation", "test"}


@pytest.mark.parametrize("below", [17, 20, 24, 33, 64, 12.5])
def test_near_links_at_wide_bounds(spark, below):
    import random

    rng, rows = random.Random(int(below)), []
    for _ in range(12):
        base = rng.getrandbits(64)
        for k in (0, int(below) - 1, int(below), int(below) + 1):
            x = base
            for b in rng.sample(range(64), min(k, 64)):
                x ^= 1 << b
            rows.append((len(rows), x - 2**64 if x >= 2**63 else x))
    far = lambda a, b: ((a ^ b) % 2**64).bit_count()
    want = {(i, j) for i, a in rows for j, b in rows if i < j and far(a, b) < below}
    table = spark.createDataFrame(rows, "image_id long, hash long")
    assert {(r.a, r.b) for r in K.near_links(table, below).collect()} == want and len(want) >= 12
    with pytest.raises(ValueError):
        K.near_links(table, 65)


def test_group_links_join_what_near_links_join(spark):
    table = spark.createDataFrame([(1, 7), (2, 7), (3, 6), (4, 0xFF00), (5, 0xFF00), (6, 0x0FF0)], "image_id long, hash long")
    roots = {r.node: r.root for r in K.group_roots(K.group_links(table, 2, bits=16)).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_a_class_with_one_type_to_hold_out_is_an_error(spark):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 4 + [("b", "x")] * 5 + [("b", "y")], "class_name string, fragment_type string")
    assert K.heldout_types(rows.filter("class_name = 'a'"), 2).collect() == [("a", "x", 3)]
    with pytest.raises(Exception, match="fewer than two fragment types"):
        K.heldout_types(rows, 2).collect()
    for read in (lambda f: f.count(), lambda f: f.select("class_name").collect()):  # no column of the result is read
        with pytest.raises(Exception, match="fewer than two fragment types"):
            read(K.heldout_types(rows, 2))


def test_stored_artifacts_are_checked(spark, tmp_path):
    from vetra.sources import store

    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "class_name string, w array<double>")
    store.save_classifier(rows, f"{tmp_path}/m", "v4", "f1", {"c": 1.0})
    back, document = store.load_classifier(spark, f"{tmp_path}/m", "f1")
    assert sorted(back.collect()) == sorted(rows.collect()) and document == {"version": "v4", "fingerprint": "f1", "rows": 2, "classes": ["a", "b"], "config": {"c": 1.0}}
    with pytest.raises(store.ArtifactMismatch, match="made with f1"):
        store.load_artifact(spark, f"{tmp_path}/m", "f2")
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/m/rows")
    with pytest.raises(store.ArtifactMismatch, match="3 rows"):
        store.load_artifact(spark, f"{tmp_path}/m")
    spark.createDataFrame([("z", [2.0])], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/n/rows")
    assert set(store.save_scored(spark.createDataFrame([(1, "test"), (2, "validation")], "id long, split string"), f"{tmp_path}/s")) == {"test", "validation"}


def test_artifacts_that_do_not_belong_together(spark):
    from vetra.sources.store import ArtifactMismatch

    parts = lambda *f: spark.createDataFrame([(str(i), x) for i, x in enumerate(f)], "part string, fingerprint string")
    versions = lambda a, b: spark.createDataFrame([(a, b)], "calibrated_on string, loaded string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "class_name string")
    L.require_consistent(parts("f", "f"), versions("v1", "v1"), names("a"), names("a", "b"))
    for bad, what in (((parts("f", "g"), versions("v1", "v1"), names("a"), names("a")), "fingerprints"), ((parts("f", "f"), versions("v1", "v2"), names("a"), names("a")), "index_version"), ((parts("f", "f"), versions("v1", "v1"), names("a", "c"), names("a")), "index_classes")):
        with pytest.raises(ArtifactMismatch, match=what):
            L.require_consistent(*bad)


def test_softmax_fit_is_the_optimum():
    """The gradient vanishes, a larger strength fits closer, and an unseen class gets nothing."""
    import numpy as np

    from vetra.operators import crossvalidation as X

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    for c in (0.01, 1.0, 100.0):
        beta = X.fit_softmax(x, y, 4, c)
        p = X.probabilities(beta, x, np.array([True, True, True, False]))
        assert (p[:, 3] == 0).all() and np.allclose(p.sum(axis=1), 1)
        slope = c * x.T @ (X.balanced(y, 4)[:, None] * (p - np.eye(4)[y])) + beta[:-1]
        assert np.abs(slope).max() < 1e-3 * max(1, c)


def test_cross_validation_holds_groups_out(spark):
    """Pairs of a group never help each other: each row is predicted by a fit without its fold."""
    import numpy as np

    from vetra.operators import crossvalidation as X

    rng = np.random.default_rng(8)
    rows = [(i, i % 2, (i // 2) % 4, [float(i % 2) * 3 + float(rng.normal()), float(rng.normal()), 1.0]) for i in range(48)]
    table = spark.createDataFrame(rows, "id long, label long, fold int, v array<double>")
    found = X.out_of_fold(table, 4, (0.1, 10.0), 2)
    assert sorted((r.c, r.id) for r in found.collect()) == sorted((c, i) for c in (0.1, 10.0) for i in range(48))
    x, y, fold = np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    p = np.zeros(48)
    for k in range(4):
        beta = X.fit_softmax(x[fold != k], y[fold != k], 2, 10.0)
        p[fold == k] = X.probabilities(beta, x[fold == k], np.ones(2, bool))[np.arange(12), y[fold == k]]
    scores = {r.c: r for r in X.by_strength(found).collect()}
    assert scores[10.0].log_loss == pytest.approx(-np.log(p).mean(), rel=1e-6) and len(scores[0.1].fold_accuracies) == 4
    best = X.best(X.by_strength(found)).first()
    assert best.log_loss == min(s.log_loss for s in scores.values()) and best.accuracy > 0.8


def test_folds_spread_large_groups(spark):
    rows = spark.createDataFrame([(f"g{i}", "a", s) for i, s in enumerate([9, 9, 5, 4, 1, 1, 1])] + [("h", "b", 3)], "group_id string, class_name string, size long")
    of = {r.group_id: r.fold for r in E.group_folds(rows, 2).collect()}
    size = {g: s for g, s in zip([f"g{i}" for i in range(7)], [9, 9, 5, 4, 1, 1, 1])}
    assert len(of) == 8 and abs(sum(s for g, s in size.items() if of[g] == 0) - 15) <= 1
