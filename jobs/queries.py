"""The jobs as queries: each runs twice into one new folder and checkpoint and gives the whole output after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixlake.session import shared_root

from . import build_dataset, ingest_fragments


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1-ingest-fragments")
    for _ in range(2):
        ingest_fragments.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return ingest_fragments.fragments(spark, f"{folder}/output").drop("batch")


def job2_build_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2-build-dataset")
    for _ in range(2):
        build_dataset.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/output")
    return spark.read.parquet(f"{folder}/output/chunks")


def _cut(config: dict) -> str:
    """CTEs that cut rec (record_id, text, ...) into pc (... start, end, text, hash)."""
    size, tail = config["fragment_size"], config["minimum_tail"]
    return f"""cut0 AS (SELECT *, length(text) AS n, length(text) // {size} AS f, length(text) % {size} AS rest FROM rec),
cut1 AS (SELECT *, n > {size} AND rest > 0 AND rest < {tail} AS short, CASE WHEN n <= {size} THEN 0 WHEN rest > 0 AND rest < {tail} THEN f - 1 ELSE f END AS steps FROM cut0),
rng AS (SELECT record_id, i * {size} AS a, (i + 1) * {size} AS z FROM (SELECT record_id, unnest(range(steps)) AS i FROM cut1)
  UNION ALL SELECT record_id, steps * {size}, CASE WHEN short THEN steps * {size} + ({size} + rest) // 2 ELSE n END FROM cut1 WHERE steps * {size} < n
  UNION ALL SELECT record_id, steps * {size} + ({size} + rest) // 2, n FROM cut1 WHERE short),
pc AS (SELECT rec.* EXCLUDE (text), a AS start, z AS "end", substr(text, (a + 1)::INT, (z - a)::INT) AS text, sha256(substr(text, (a + 1)::INT, (z - a)::INT)) AS hash, length(rec.text) AS bp FROM rng JOIN rec USING (record_id))"""


JOB1_SQL = f"""WITH rec AS (SELECT min(doc_id) AS record_id, arg_min(source, doc_id) AS source, any_value(text) AS text, sha256(text) AS sha FROM documents WHERE text <> '' GROUP BY sha),
{_cut(ingest_fragments.DEFAULTS)},
dr AS (SELECT *, ('0x' || substr(sha, 1, 8))::BIGINT / 4294967296::DOUBLE AS draw FROM pc),
sp AS (SELECT *, CASE WHEN draw < 0.8::DOUBLE THEN 'train' WHEN draw < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'inference' END AS split FROM dr)
SELECT record_id, source, start, "end", hash, text, CASE WHEN split = first_value(split) OVER (PARTITION BY hash ORDER BY record_id, start) THEN 'kept' ELSE 'leak' END AS status, split FROM sp"""

_FILLED = "(u[{i}] + b) / greatest(tb * {r}::DOUBLE, 1) + (v[{i}] + n) / greatest(tn * {r}::DOUBLE, 1) AS s{i}, sha256('0|' || ranked.g || '|{s}') AS h{i}"

JOB2_SQL = f"""WITH RECURSIVE lab AS (SELECT doc_id, min(quality)::VARCHAR AS label FROM labels GROUP BY 1),
rec AS (SELECT d.doc_id AS record_id, coalesce(d.source, '') AS source, coalesce(lab.label, 'none') AS label, d.text FROM documents d LEFT JOIN lab USING (doc_id) WHERE d.text <> ''),
{_cut(build_dataset.DEFAULTS)},
fi AS (SELECT record_id, label, first_value(record_id) OVER w AS fid, first_value(label) OVER w AS fl FROM pc WINDOW w AS (PARTITION BY hash ORDER BY record_id, start)),
gone AS (SELECT DISTINCT unnest([record_id, fid]) AS record_id FROM fi WHERE label <> fl),
sy AS (SELECT record_id AS u, fid AS v FROM fi WHERE label = fl AND record_id <> fid UNION SELECT fid, record_id FROM fi WHERE label = fl AND record_id <> fid),
left_over AS (SELECT record_id, source, label, length(text) AS bases FROM rec WHERE record_id NOT IN (SELECT record_id FROM gone)),
vertices AS (SELECT record_id AS node FROM left_over UNION SELECT u FROM sy),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM vertices
  UNION (SELECT sy.v, min(cc.component) FROM cc JOIN sy ON sy.u = cc.node JOIN recurring.cc AS old ON old.node = sy.v WHERE cc.component < old.component GROUP BY sy.v)),
grp AS (SELECT left_over.*, component AS g FROM left_over JOIN cc ON node = record_id),
by_source AS (SELECT g, source, sum(bases) AS b, min(record_id) AS o FROM grp GROUP BY 1, 2), by_label AS (SELECT g, label, sum(bases) AS b, min(record_id) AS o FROM grp GROUP BY 1, 2),
st AS (SELECT g, sum(bases)::BIGINT AS b, count(*) AS n, (SELECT arg_max(source, (b, -o)) FROM by_source x WHERE x.g = grp.g) || '/' || (SELECT arg_max(label, (b, -o)) FROM by_label x WHERE x.g = grp.g) AS s FROM grp GROUP BY g),
tot AS (SELECT s, sum(b)::DOUBLE AS tb, sum(n)::DOUBLE AS tn FROM st GROUP BY s),
ranked AS (SELECT st.*, tb, tn, row_number() OVER (PARTITION BY st.s ORDER BY b DESC, sha256('0|' || g || '|order')) AS k FROM st JOIN tot USING (s)),
fold AS (SELECT s, 0::BIGINT AS k, NULL::BIGINT AS g, NULL::VARCHAR AS split, [0.0, 0.0, 0.0]::DOUBLE[] AS u, [0.0, 0.0, 0.0]::DOUBLE[] AS v FROM tot
UNION ALL SELECT s, k, g, ['train', 'validation', 'inference'][pick], list_transform(u, lambda x, i: CASE WHEN i = pick THEN x + b ELSE x END), list_transform(v, lambda x, i: CASE WHEN i = pick THEN x + n ELSE x END) FROM (
 SELECT *, CASE WHEN (s1, h1, 'train') <= (s2, h2, 'validation') AND (s1, h1, 'train') <= (s3, h3, 'inference') THEN 1 WHEN (s2, h2, 'validation') <= (s3, h3, 'inference') THEN 2 ELSE 3 END AS pick FROM (
 SELECT ranked.s, ranked.k, ranked.g, ranked.b, ranked.n, u, v, {", ".join(_FILLED.format(i=i, r=r, s=s) for i, (s, r) in enumerate((("train", 0.8), ("validation", 0.1), ("inference", 0.1)), 1))}
 FROM fold JOIN ranked ON ranked.s = fold.s AND ranked.k = fold.k + 1)))
SELECT pc.record_id, pc.source, pc.label, 'SIM_' || substr(sha256(grp.g::VARCHAR), 1, 20) AS split_group, pc.start, pc."end", pc.hash, pc."end" - pc.start AS valid_length, (pc."end" - pc.start) / greatest(bp, 1) AS sample_weight, pc.text, fold.split
FROM pc JOIN grp USING (record_id) JOIN fold ON fold.g = grp.g"""

QUERIES = {"job1_ingest_fragments": job1_ingest_fragments, "job2_build_dataset": job2_build_dataset}
SQL = {"job1_ingest_fragments": JOB1_SQL, "job2_build_dataset": JOB2_SQL}
