"""Curation queries over ``documents`` (class: language, or source where labels conflict) and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.operators import curation as K
from vetra.operators import retrieval as R
from vetra.operators.containment import benchmark_pairs
from vetra.operators.distances import distance_histogram
from vetra.queries.base import INV_SQL, P_SQL, canvases, inventory_rows, query
from vetra.queries.vectors import _phash_sql, phash
from vetra.sources import tables as T

W_INV = f"WITH {INV_SQL} "


@query(W_INV + "SELECT image_id, length(text) AS characters, file_size, sha256 FROM inv")
def inventory(spark, sf_dir):
    return inventory_rows(spark, sf_dir).select("image_id", F.length("text").cast("long").alias("characters"), "file_size", "sha256")


NAMES = {0: "alpha", 1: "beta", 2: "gamma", 3: "delta"}


@query("SELECT vec_id, label, CASE label WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta' END AS class_name FROM embeddings")
def parquet_label_names(spark, sf_dir):
    return T.label_names(T.read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", NAMES)


@query("""WITH l AS (SELECT DISTINCT vec_id AS id FROM embeddings), r AS (SELECT DISTINCT doc_id AS id FROM documents)
    SELECT id, 'left' AS side FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'right' FROM r WHERE id NOT IN (SELECT id FROM l)""")
def embedding_alignment(spark, sf_dir):
    return T.misaligned(T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def artifact_json_load(spark, sf_dir):
    """Known fields only; others of the document are ignored."""
    return T.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 6 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5)
    SELECT vec_id AS reference_id, 'c' || label AS class_name, 'f' || (vec_id % 4) AS fragment_type, len(v)::INT AS width, round(list_inner_product(v, v), 8) AS norm FROM e""")
def index_roundtrip(spark, sf_dir):
    """The reference index is written with its document, loaded again and checked."""
    from vetra.functions.vectors import dot
    from vetra.plans.session import shared_path
    from vetra.queries.screening import references
    from vetra.sources.store import load_artifact, save_artifact

    path = shared_path(spark, "index")
    save_artifact(references(spark, sf_dir), path, "index-v1", "unit-64", metric="inner product of unit vectors")
    rows, _ = load_artifact(spark, path, "unit-64")
    return rows.select("reference_id", "class_name", "fragment_type", F.size("v").alias("width"), F.round(dot(F.col("v"), F.col("v")), 8).alias("norm"))


@query(W_INV + "SELECT image_id, 'img_' || substr(sha256, 1, 12) AS derived_id FROM inv")
def derive_ids(spark, sf_dir):
    return inventory_rows(spark, sf_dir).select("image_id", K.derive_id("img_", F.col("sha256")).alias("derived_id"))


@query(W_INV + "SELECT image_id, CASE WHEN file_size < 300 THEN 'excluded' ELSE '' END AS role, CASE WHEN file_size < 300 THEN 'unreadable' ELSE '' END AS exclusion_reason FROM inv")
def exclude_unreadable(spark, sf_dir):
    """Short texts stand for files that can't be read."""
    out = K.assign(K.begin(inventory_rows(spark, sf_dir)), F.col("file_size") < 300, "excluded", "unreadable")
    return out.select("image_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"))


def by_source(spark, sf_dir):
    return inventory_rows(spark, sf_dir).withColumn("class_name", F.col("fragment_type"))


_CONFLICT = """, src AS (SELECT * REPLACE (fragment_type AS class_name) FROM inv),
    ch AS (SELECT sha256, array_to_string(list_sort(list(DISTINCT class_name)), '|') AS conflicting_classes FROM src GROUP BY sha256 HAVING count(DISTINCT class_name) > 1),
    mk AS (SELECT src.*, conflicting_classes, min(path) OVER (PARTITION BY src.sha256) AS first_path FROM src LEFT JOIN ch USING (sha256)) """


@query(W_INV + _CONFLICT + "SELECT * FROM ch")
def label_conflict_hashes(spark, sf_dir):
    return K.conflict_hashes(by_source(spark, sf_dir))


@query(W_INV + _CONFLICT + """SELECT image_id, conflicting_classes, CASE WHEN path = first_path THEN 'ambiguity_probe' ELSE 'excluded' END AS role,
    CASE WHEN path = first_path THEN '' ELSE 'label-conflict duplicate copy' END AS exclusion_reason FROM mk WHERE conflicting_classes IS NOT NULL""")
def ambiguity_probe(spark, sf_dir):
    out = K.resolve_conflicts(K.begin(by_source(spark, sf_dir))).filter("role IS NOT NULL")
    return out.select("image_id", "conflicting_classes", "role", F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"))


@query(W_INV + "SELECT image_id, CASE WHEN path > min(path) OVER (PARTITION BY sha256) THEN 'excluded' ELSE '' END AS role FROM inv")
def exact_dedup(spark, sf_dir):
    return K.exact_duplicates(K.begin(inventory_rows(spark, sf_dir))).select("image_id", F.coalesce("role", F.lit("")).alias("role"))


_SIM = """, w AS (SELECT DISTINCT image_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM inv),
    h AS (SELECT image_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM w WHERE w <> ''),
    b AS (SELECT image_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM h, range(60) AS r(i) GROUP BY ALL),
    sim AS (SELECT inv.image_id, coalesce(sum(CASE WHEN votes > 0 THEN 1::BIGINT << i::INT ELSE 0 END), 0)::BIGINT AS hash FROM inv LEFT JOIN b USING (image_id) GROUP BY inv.image_id) """


@query(W_INV + _SIM + "SELECT image_id, hash FROM sim")
def simhash_documents(spark, sf_dir):
    return K.simhash60(inventory_rows(spark, sf_dir), "image_id", "text")


def hashed(spark, sf_dir):
    """Perceptual hashes of the canvases; class: label, fragment: id mod 4."""
    rows = canvases(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "label", phash(F.col("c")).alias("hash"))
    return rows.select("image_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"), F.concat(F.lit("f"), (F.col("image_id") % 4).cast("string")).alias("fragment_type"), "hash")


#: CTEs up to hs(image_id, class_name, fragment_type, hash).
H_SQL = _phash_sql().replace("SELECT vec_id, list_sum([(w[s + 1]", "ph AS (SELECT vec_id, list_sum([(w[s + 1]", 1).replace("FROM p)\n        ph AS", "FROM p),\n        ph AS").replace("AS phash FROM f", "AS phash FROM f)") + """,
    hs AS (SELECT ph.vec_id AS image_id, 'c' || label AS class_name, 'f' || (ph.vec_id % 4) AS fragment_type, phash AS hash FROM ph JOIN e USING (vec_id)) """


@query(H_SQL + "SELECT image_id, hash, bit_count(xor(hash, first_hash))::INT AS distance FROM hs, (SELECT hash AS first_hash FROM hs ORDER BY image_id LIMIT 1)")
def hamming_pairs(spark, sf_dir):
    """Distance of every hash to the first image's."""
    from vetra.functions.canvas import hamming

    rows = hashed(spark, sf_dir)
    first = rows.orderBy("image_id").limit(1).select(F.col("hash").alias("first_hash"))
    return rows.join(F.broadcast(first)).select("image_id", "hash", hamming(F.col("hash"), F.col("first_hash")).alias("distance"))


_DIST = """, dist AS (SELECT bit_count(xor(a.hash, b.hash))::INT AS distance FROM hs a JOIN hs b ON a.class_name < b.class_name) """


@query(H_SQL + _DIST + "SELECT quantile_cont(distance, 0.0001) AS bound FROM dist")
def near_dup_bound(spark, sf_dir):
    return K.percentile_of_histogram(distance_histogram(hashed(spark, sf_dir), bits=16), 0.0001)


#: The percentile of cross-class distances under which rows are linked. Hashes of 16 bits are coarse: of 64 bits, a tenth would do.
NULL_SHARE = 0.001
_BELOW = _DIST + f", bd AS MATERIALIZED (SELECT quantile_cont(distance, {NULL_SHARE}) AS below FROM dist) "


def linking(spark, sf_dir):
    """The hashes, computed once, and the bound that their own cross-class distances give."""
    from vetra.plans.session import cut

    rows = cut(hashed(spark, sf_dir))
    bound = K.percentile_of_histogram(distance_histogram(rows, bits=16), NULL_SHARE).first()["bound"]
    return rows, bound or 0.0


@query(H_SQL + _BELOW + "SELECT a.image_id AS a, b.image_id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hs a JOIN hs b ON a.image_id < b.image_id, bd WHERE bit_count(xor(a.hash, b.hash)) < below")
def near_dup_links(spark, sf_dir):
    rows, below = linking(spark, sf_dir)
    return K.near_links(rows, below, bands=2, bits=16)


def grouped(spark, sf_dir):
    rows, below = linking(spark, sf_dir)
    return K.group_ids(rows, K.group_roots(K.group_links(rows, below, bands=2, bits=16)))


_GROUPS = H_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _BELOW + """,
    lk AS MATERIALIZED (SELECT a.image_id AS a, b.image_id AS b FROM hs a JOIN hs b ON a.image_id <> b.image_id, bd WHERE bit_count(xor(a.hash, b.hash)) < below),
    reach(node, root) AS (SELECT image_id, image_id FROM hs UNION SELECT lk.b, root FROM reach JOIN lk ON lk.a = node),
    gr AS MATERIALIZED (SELECT hs.*, root, 'g' || CASE WHEN root < 10000 THEN lpad(root::VARCHAR, 4, '0') ELSE root::VARCHAR END AS group_id
        FROM hs JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) ON node = image_id) """


@query(_GROUPS + "SELECT image_id, group_id FROM gr")
def near_dup_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("image_id", "group_id")


@query(_GROUPS + "SELECT group_id, count(DISTINCT class_name) AS classes, count(*) AS images FROM gr GROUP BY group_id HAVING count(DISTINCT class_name) > 1")
def mixed_groups(spark, sf_dir):
    return K.mixed_groups(grouped(spark, sf_dir))


_TYPES = """, ct AS (SELECT class_name, fragment_type, count(*) AS n FROM {t} GROUP BY ALL HAVING count(*) >= 5),
    ty AS (SELECT class_name, fragment_type, n FROM ct QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY n, fragment_type) = 1 AND count(*) OVER (PARTITION BY class_name) >= 2) """


@query(W_INV + _TYPES.format(t="inv") + "SELECT * FROM ty")
def heldout_types(spark, sf_dir):
    return K.heldout_types(_able(inventory_rows(spark, sf_dir)), 5)


def _able(rows):
    """Rows of the classes that have two types to choose from; for others ``heldout_types`` raises."""
    able = K.type_candidates(rows, 5).filter("candidates >= 2").select("class_name")
    return rows.join(F.broadcast(able), "class_name", "left_semi")  # one row a class


@query(_GROUPS + _TYPES.format(t="gr") + "SELECT image_id, group_id FROM gr WHERE group_id IN (SELECT group_id FROM gr JOIN ty USING (class_name, fragment_type))")
def heldout_rows(spark, sf_dir):
    rows = grouped(spark, sf_dir)
    return K.heldout_groups(rows, K.heldout_types(_able(rows), 5)).select("image_id", "group_id")


_MODE = """SELECT group_id, {c}, count(*) AS n FROM gr GROUP BY group_id, {c} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, {c}) = 1"""
_STRATA = f""", st AS (SELECT a.group_id, a.class_name, b.fragment_type, size FROM ({_MODE.format(c='class_name')}) a JOIN ({_MODE.format(c='fragment_type')}) b USING (group_id)
    JOIN (SELECT group_id, count(*) AS size FROM gr GROUP BY group_id) USING (group_id)) """


@query(_GROUPS + _STRATA + "SELECT group_id, class_name, fragment_type, size FROM st")
def group_strata(spark, sf_dir):
    return K.strata(grouped(spark, sf_dir))


_LACK = "(0.7::DOUBLE * total - t)", "(0.15::DOUBLE * total - v)", "(0.15::DOUBLE * total - u)"
_BEST = f"CASE WHEN {_LACK[0]} >= {_LACK[1]} AND {_LACK[0]} >= {_LACK[2]} THEN 'train' WHEN {_LACK[1]} >= {_LACK[2]} THEN 'validation' ELSE 'test' END"


@query(_GROUPS + _STRATA + f""", od AS MATERIALIZED (SELECT *, row_number() OVER w AS nth, sum(size) OVER (PARTITION BY class_name, fragment_type)::DOUBLE AS total FROM st
        WINDOW w AS (PARTITION BY class_name, fragment_type ORDER BY md5('s' || group_id), group_id)),
    fold(class_name, fragment_type, nth, t, v, u, group_id, split) AS (
        SELECT class_name, fragment_type, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT class_name, fragment_type FROM od)
        UNION ALL SELECT class_name, fragment_type, nth, t + (split = 'train')::INT * size, v + (split = 'validation')::INT * size, u + (split = 'test')::INT * size, group_id, split
        FROM (SELECT od.class_name, od.fragment_type, od.nth, t, v, u, od.group_id, size, {_BEST} AS split FROM fold JOIN od ON od.class_name = fold.class_name AND od.fragment_type = fold.fragment_type AND od.nth = fold.nth + 1))
    SELECT group_id, split FROM fold WHERE nth > 0""")
def greedy_split(spark, sf_dir):
    return K.greedy_split(K.strata(grouped(spark, sf_dir)))


@query(_GROUPS + """, gs AS (SELECT group_id, count(*) AS n, count(DISTINCT class_name) AS classes FROM gr GROUP BY group_id)
    SELECT (SELECT count(*) FROM lk) // 2 AS links, count(*) AS groups, count(*) FILTER (n > 1) AS multi_image_groups, max(n) AS largest_group, count(*) FILTER (classes > 1) AS mixed_groups FROM gs""")
def group_stats(spark, sf_dir):
    """Links are counted from distinct hashes and how often each occurs; no pair of images is made."""
    rows, below = linking(spark, sf_dir)
    counted = rows.groupBy("hash").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("n"))
    apart = K.near_links(counted, below, bands=2, bits=16)
    n = counted.select("image_id", "n")
    between = apart.join(n.withColumnsRenamed({"image_id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"image_id": "b", "n": "nb"}), "b").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("between"))
    within = counted.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("within"))
    sizes = K.group_ids(rows, K.group_roots(K.group_links(rows, below, bands=2, bits=16))).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_name").alias("classes"))
    stats = sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("multi_image_groups"), F.max("n").alias("largest_group"), F.count_if(F.col("classes") > 1).alias("mixed_groups"))
    return stats.join(between).join(within).select((F.col("between") + F.col("within")).cast("long").alias("links"), "groups", "multi_image_groups", "largest_group", "mixed_groups")


@query("""WITH c AS (SELECT DISTINCT source AS class_name FROM documents), r AS (SELECT class_name, row_number() OVER (ORDER BY md5('ood' || class_name), class_name) AS nth, count(*) OVER () AS n FROM c)
    SELECT class_name, CASE WHEN nth <= round_even(n * 0.5, 0) THEN 'ood_calibration' ELSE 'ood_evaluation' END AS role FROM r""")
def ood_class_halves(spark, sf_dir):
    return K.class_halves(inventory_rows(spark, sf_dir).select(F.col("fragment_type").alias("class_name")), 0.5)


@query(W_INV + """, k AS (SELECT *, md5('pick' || image_id) AS key FROM inv), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY class_name, sha256 ORDER BY key, image_id) = 1)
    SELECT class_name, image_id, row_number() OVER (PARTITION BY class_name ORDER BY key, image_id)::INT AS nth FROM u QUALIFY nth <= 25""")
def per_class_sample(spark, sf_dir):
    return K.per_class_sample(inventory_rows(spark, sf_dir), 25)


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace('cropped_' || p_name || ' (' || p_size || ')', '^cropped_', '', 'i'), '(\s*\(\d+\)|\s+\d+)+$', '')), '\s+', ' ', 'g')) AS label FROM part""")
def normalise_label(spark, sf_dir):
    raw = F.concat(F.lit("cropped_"), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    return T.read(spark, sf_dir, "part").select("p_partkey", K.normalise_name(raw).alias("label"))


@query(W_INV + _CONFLICT + """SELECT image_id, CASE WHEN conflicting_classes IS NOT NULL THEN 'ambiguity_probe' ELSE 'known' END AS dataset, coalesce(conflicting_classes, class_name) AS class_name
    FROM mk WHERE conflicting_classes IS NULL OR path = first_path""")
def splits_union(spark, sf_dir):
    """Splits put together; the probe set carries its conflicting classes."""
    rows = K.resolve_conflicts(K.begin(by_source(spark, sf_dir)))
    known = rows.filter("role IS NULL").select("image_id", F.lit("known").alias("dataset"), "class_name")
    probe = rows.filter("role = 'ambiguity_probe'").select("image_id", F.col("role").alias("dataset"), F.col("conflicting_classes").alias("class_name"))
    return known.unionByName(probe)


@query(W_INV + """SELECT coalesce(class_name, '*') AS class_name, coalesce(fragment_type, '*') AS fragment_type, count(*) AS n FROM inv GROUP BY GROUPING SETS ((class_name), (fragment_type), (class_name, fragment_type), ())""")
def manifest_counts(spark, sf_dir):
    rows = inventory_rows(spark, sf_dir).select("class_name", "fragment_type")
    sets = [[F.col("class_name")], [F.col("fragment_type")], [F.col("class_name"), F.col("fragment_type")], []]
    out = rows.groupingSets(sets, F.col("class_name"), F.col("fragment_type")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("class_name", F.lit("*")).alias("class_name"), F.coalesce("fragment_type", F.lit("*")).alias("fragment_type"), "n")


@query(W_INV + "SELECT fragment_type, count(DISTINCT class_name) AS classes FROM inv GROUP BY fragment_type HAVING count(DISTINCT class_name) > 1")
def shared_fragments(spark, sf_dir):
    return inventory_rows(spark, sf_dir).groupBy("fragment_type").agg(F.count_distinct("class_name").alias("classes")).filter("classes > 1")


@query(W_INV + """, r AS (SELECT * FROM inv WHERE image_id % 10 = 0), o AS (SELECT * FROM inv WHERE image_id % 10 <> 0 OR image_id % 100 = 0)
    SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM r) THEN 'id' ELSE 'sha256' END AS by FROM o WHERE image_id IN (SELECT image_id FROM r) OR sha256 IN (SELECT sha256 FROM r)""")
def leakage_check(spark, sf_dir):
    """Every tenth document is a reference; the others, and every hundredth, are held against them."""
    rows = inventory_rows(spark, sf_dir).select("image_id", "sha256")
    return R.leaks(rows.filter("image_id % 10 = 0"), rows.filter("image_id % 10 <> 0 OR image_id % 100 = 0"))


@query("SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    return benchmark_pairs(T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "benchmark"))
