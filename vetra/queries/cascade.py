"""The curation cascade over ``documents`` (class: source, fragment type: language), and its report."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.operators import curation as K
from vetra.operators import report as R
from vetra.plans.cascade import curate, split_rows
from vetra.plans.session import cut, shared_path
from vetra.queries.base import INV_SQL, inventory_rows, query
from vetra.queries.curation import _BEST, _SIM

PERCENTILE, LEAST = 0.0001, 3


def curated(spark, sf_dir):
    """Texts under 300 characters stand for files that can't be read; hashes are SimHashes of the words."""
    rows = inventory_rows(spark, sf_dir)
    files = rows.select("image_id", "path", F.col("fragment_type").alias("class_name"), F.col("class_name").alias("fragment_type"), "sha256", (F.col("file_size") >= 300).alias("readable"))
    table = cut(files.join(K.simhash60(rows, "image_id", "text"), "image_id"))
    return curate(table, shared_path(spark, "curation"), percentile=PERCENTILE, least=LEAST, undersized="keep")


_MODE = """SELECT group_id, {c} FROM lf GROUP BY group_id, {c} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, {c}) = 1"""

#: CTE fin(image_id, class_name, fragment_type, readable, role, exclusion_reason, group_id, conflicting_classes).
C_SQL = f"""WITH RECURSIVE {INV_SQL} {_SIM},
    doc AS (SELECT image_id, path, inv.fragment_type AS class_name, inv.class_name AS fragment_type, sha256, hash, file_size >= 300 AS readable FROM inv JOIN sim USING (image_id)),
    cf AS (SELECT sha256, array_to_string(list_sort(list(DISTINCT class_name)), '|') AS conflicting_classes FROM doc WHERE readable GROUP BY sha256 HAVING count(DISTINCT class_name) > 1),
    d1 AS MATERIALIZED (SELECT doc.*, conflicting_classes, min(path) FILTER (readable) OVER (PARTITION BY doc.sha256) AS first_path FROM doc LEFT JOIN cf USING (sha256)),
    d2 AS MATERIALIZED (SELECT *, CASE WHEN NOT readable THEN 'excluded' WHEN conflicting_classes IS NOT NULL AND path = first_path THEN 'ambiguity_probe' WHEN path > first_path THEN 'excluded' END AS role,
        CASE WHEN NOT readable THEN 'unreadable' WHEN path > first_path THEN CASE WHEN conflicting_classes IS NOT NULL THEN 'label-conflict duplicate copy' ELSE 'exact duplicate' END END AS reason FROM d1),
    p AS MATERIALIZED (SELECT image_id, class_name, fragment_type, hash FROM d2 WHERE role IS NULL),
    bd AS MATERIALIZED (SELECT coalesce(quantile_cont(bit_count(xor(a.hash, b.hash))::INT, {PERCENTILE}), 0) AS below FROM p a JOIN p b ON a.class_name < b.class_name),
    lk AS MATERIALIZED (SELECT a.image_id AS a, b.image_id AS b FROM p a JOIN p b ON a.image_id <> b.image_id, bd WHERE bit_count(xor(a.hash, b.hash)) < below),
    reach(node, root) AS (SELECT image_id, image_id FROM p UNION SELECT lk.b, root FROM reach JOIN lk ON lk.a = node),
    gr AS MATERIALIZED (SELECT p.*, 'g' || CASE WHEN root < 10000 THEN lpad(root::VARCHAR, 4, '0') ELSE root::VARCHAR END AS group_id FROM p JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) ON node = image_id),
    mx AS (SELECT group_id FROM gr GROUP BY group_id HAVING count(DISTINCT class_name) > 1),
    un AS MATERIALIZED (SELECT * FROM gr WHERE group_id NOT IN (SELECT group_id FROM mx)),
    ty AS (SELECT class_name, fragment_type FROM (SELECT class_name, fragment_type, count(*) AS n FROM un GROUP BY ALL HAVING count(*) >= {LEAST})
        QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY n, fragment_type) = 1 AND count(*) OVER (PARTITION BY class_name) >= 2),
    hd AS MATERIALIZED (SELECT DISTINCT group_id FROM un JOIN ty USING (class_name, fragment_type)),
    lf AS MATERIALIZED (SELECT * FROM un WHERE group_id NOT IN (SELECT group_id FROM hd)),
    st AS (SELECT a.group_id, a.class_name, b.fragment_type, size FROM ({_MODE.format(c='class_name')}) a JOIN ({_MODE.format(c='fragment_type')}) b USING (group_id) JOIN (SELECT group_id, count(*) AS size FROM lf GROUP BY group_id) USING (group_id)),
    od AS MATERIALIZED (SELECT *, row_number() OVER w AS nth, sum(size) OVER (PARTITION BY class_name, fragment_type)::DOUBLE AS total FROM st WINDOW w AS (PARTITION BY class_name, fragment_type ORDER BY md5('s' || group_id), group_id)),
    fold(class_name, fragment_type, nth, t, v, u, group_id, split) AS (
        SELECT class_name, fragment_type, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT class_name, fragment_type FROM od)
        UNION ALL SELECT class_name, fragment_type, nth, t + (split = 'train')::INT * size, v + (split = 'validation')::INT * size, u + (split = 'test')::INT * size, group_id, split
        FROM (SELECT od.class_name, od.fragment_type, od.nth, t, v, u, od.group_id, size, {_BEST} AS split FROM fold JOIN od ON od.class_name = fold.class_name AND od.fragment_type = fold.fragment_type AND od.nth = fold.nth + 1)),
    fin AS MATERIALIZED (SELECT d2.image_id, d2.class_name, d2.fragment_type, readable, conflicting_classes,
        CASE WHEN role IS NOT NULL THEN role WHEN gr.group_id IN (SELECT group_id FROM mx) THEN 'excluded' WHEN gr.group_id IN (SELECT group_id FROM hd) THEN 'heldout_known' ELSE split END AS role,
        CASE WHEN role IS NOT NULL THEN reason WHEN gr.group_id IN (SELECT group_id FROM mx) THEN 'near-duplicate group spans classes' END AS exclusion_reason,
        CASE WHEN role = 'ambiguity_probe' THEN 'conflict-' || substr(sha256, 1, 12) ELSE gr.group_id END AS group_id
        FROM d2 LEFT JOIN gr USING (image_id) LEFT JOIN (SELECT group_id, split FROM fold WHERE nth > 0) f ON f.group_id = gr.group_id) """


@query(C_SQL + "SELECT image_id, role, coalesce(exclusion_reason, '') AS exclusion_reason, coalesce(group_id, '') AS group_id FROM fin")
def curated_inventory(spark, sf_dir):
    """Every stage in turn: unreadable, conflicts, copies, near copies, held-out types, split."""
    rows, _ = curated(spark, sf_dir)
    return rows.select("image_id", "role", F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"), F.coalesce("group_id", F.lit("")).alias("group_id"))


@query(C_SQL + "SELECT image_id, role, CASE WHEN role = 'ambiguity_probe' THEN conflicting_classes ELSE class_name END AS class_name, fragment_type, group_id FROM fin WHERE role <> 'excluded'")
def curated_splits(spark, sf_dir):
    return split_rows(curated(spark, sf_dir)[0]).select("image_id", "role", "class_name", "fragment_type", "group_id")


_FACETS = {k: v for k, v in R.FACETS.items() if k in ("all", "class", "role", "class_role", "exclusion", "fragment")}


@query(C_SQL + " UNION ALL ".join(f"""SELECT '{name}' AS facet, {" || '/' || ".join(f"coalesce({c}, '')" for c in of) or "''"} AS keys, count(*) AS images, count(*) FILTER (readable) AS readable,
    count(*) FILTER (role IN ('train', 'validation', 'test', 'heldout_known')) AS usable FROM fin GROUP BY {', '.join(of) or '()'}""" for name, of in _FACETS.items()))
def curation_report(spark, sf_dir):
    """All counts of the curated table, as the report is written: a table, JSON and Markdown."""
    rows, done = curated(spark, sf_dir)
    facts = {k: v for d in done for k, v in d.facts.items()}
    counts = R.write_report(rows, shared_path(spark, "report"), "Curated documents", facts)
    keys = F.array_join(F.transform("keys", lambda k: F.coalesce(k, F.lit(""))), "/")
    return counts.select("facet", keys.alias("keys"), "images", "readable", "usable")
