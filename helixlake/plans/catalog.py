"""Queries over the driver tables, each with independent SQL.

The driver has no nucleotide data, so its tables stand in: documents are records (sources, texts, exact copies), labels
are their classes, customer > orders > lineitem is genome > contig > chunk, embeddings hold logits, events are
histories. Sequences are made from MD5 digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, merge
from ..functions import numeric as N
from ..functions import sequence as S
from ..operators import audit, calibrate, chunks, evaluate, manifest, qc, similarity, splits, taxonomy, weights
from ..operators.components import connected_components
from ..operators.ordered import ranks
from ..session import new_folder, observed, save, ship
from ..sources import fasta, tables
from . import preprocess

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(_Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


# ---- stand-ins --------------------------------------------------------------------------------------------------

SIZE, TAIL = 500, 50


def split_of(key: Column) -> Column:
    draw = F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(draw < 8, "train").when(draw == 8, "validation").otherwise("inference")


def sql_split(key: str) -> str:
    draw = f"(('0x' || substr(sha256(({key})::VARCHAR), 1, 8))::BIGINT % 10)"
    return f"CASE WHEN {draw} < 8 THEN 'train' WHEN {draw} = 8 THEN 'validation' ELSE 'inference' END"


def records(t: _Tables) -> DataFrame:
    """Documents as records: genome = source and language, split by id."""
    docs = t.documents.join(t.labels, "doc_id", "left")
    return docs.select("doc_id", F.col("doc_id").alias("record_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("/", "source", "lang").alias("genome_id"), "quality", "toxic", split_of(F.col("doc_id")).alias("split"))


RECORDS = f"""rec AS (SELECT d.doc_id, d.doc_id AS record_id, d.source, d.lang, coalesce(d.text, '') AS text, d.source || '/' || d.lang AS genome_id, l.quality, l.toxic,
  {sql_split("d.doc_id")} AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def pieces(t: _Tables) -> DataFrame:
    keep = ("source", "lang", "genome_id", "quality", "toxic", "split")
    cut = chunks.explode_chunks(records(t), SIZE, TAIL, sequence="text", keep=keep)
    return cut.withColumns({"hash": F.sha2(F.col("piece").cast("binary"), 256), "valid_length": F.col("end") - F.col("start")})


PIECES = f"""{RECORDS},
cut0 AS (SELECT *, length(text) AS n, length(text) // {SIZE} AS f, length(text) % {SIZE} AS rest FROM rec WHERE length(text) > 0),
cut1 AS (SELECT *, CASE WHEN n <= {SIZE} THEN 0 WHEN rest > 0 AND rest < {TAIL} THEN f - 1 ELSE f END AS steps FROM cut0),
rng AS (SELECT record_id, i * {SIZE} AS a, (i + 1) * {SIZE} AS z FROM (SELECT record_id, unnest(range(steps)) AS i FROM cut1)
  UNION ALL SELECT record_id, steps * {SIZE}, CASE WHEN n > {SIZE} AND rest > 0 AND rest < {TAIL} THEN steps * {SIZE} + ({SIZE} + rest) // 2 ELSE n END FROM cut1 WHERE steps * {SIZE} < n
  UNION ALL SELECT record_id, steps * {SIZE} + ({SIZE} + rest) // 2, n FROM cut1 WHERE n > {SIZE} AND rest > 0 AND rest < {TAIL}),
pc AS (SELECT rec.* EXCLUDE (text), a AS start, z AS "end", substr(text, (a + 1)::INT, (z - a)::INT) AS piece, sha256(substr(text, (a + 1)::INT, (z - a)::INT)) AS hash, z - a AS valid_length
  FROM rng JOIN rec USING (record_id))"""


def dna(t: _Tables, of: Column | None = None) -> DataFrame:
    """Sequences of 32 letters with U, N and other codes, of the digests of names (or of what is given)."""
    return t.part.select("p_partkey", F.translate(F.md5((F.col("p_name") if of is None else of).cast("binary")), "0123456789abcdef", "acgtACGTACGTuNRY").alias("s"))


DNA = "dna AS (SELECT p_partkey, translate(md5(p_name), '0123456789abcdef', 'acgtACGTACGTuNRY') AS s FROM part)"
NORMAL = "regexp_replace(translate(upper(s), 'U', 'T'), '[^ACGTN]', 'N', 'g')"
RC = "translate(reverse(x), 'ACGTN', 'TGCAN')"

K = 5


def predictions(t: _Tables) -> DataFrame:
    v = F.col("vec_id")
    every = lambda c: F.filter("embedding", lambda x, i: i % K == c)
    logits = F.array(*[F.aggregate(every(c), F.lit(0.0), lambda a, x: a + x.cast("double")) for c in range(K)])  # each dimension counts for a class
    return t.embeddings.select(
        v.alias("chunk_id"), F.concat(F.lit("g"), v % 60).alias("genome_id"), F.concat(F.lit("c"), v % 150).alias("contig_id"), F.concat(F.lit("s"), v % 7).alias("source"),
        F.concat(F.lit("k"), v % 40).alias("split_group"), (100 + v * 37 % 6000).alias("valid_length"), (F.col("label") % K).cast("int").alias("truth"), logits.alias("logits"), N.softmax(logits).alias("p"),
    )


PRED = f"""emb AS (SELECT vec_id AS chunk_id, 'g' || vec_id % 60 AS genome_id, 'c' || vec_id % 150 AS contig_id, 's' || vec_id % 7 AS source, 'k' || vec_id % 40 AS split_group,
  100 + vec_id * 37 % 6000 AS valid_length, (label % {K})::INT AS truth, list_transform(range({K}), lambda c: list_sum(list_transform(range(c, len(embedding), {K}), lambda i: embedding[i + 1]::DOUBLE))) AS logits FROM embeddings),
pred0 AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM emb),
pred AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / list_sum(e)) AS p FROM pred0),
sc AS (SELECT *, (list_position(p, list_max(p)) - 1)::INT AS predicted, list_max(p) AS confidence FROM pred)"""


def chunked_orders(t: _Tables) -> DataFrame:
    """Lines as chunks of orders (contigs) of customers (genomes)."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return lines.select(
        F.col("c_custkey").alias("genome_id"), F.col("o_orderkey").alias("contig_id"), F.col("l_linenumber").alias("chunk"), F.col("l_quantity").cast("long").alias("valid_length"),
        F.col("c_mktsegment").alias("labels"), F.col("c_nationkey").alias("source"), split_of(F.col("c_custkey")).alias("split"),
    )


ORDERS = f"""ch AS (SELECT c_custkey AS genome_id, o_orderkey AS contig_id, l_linenumber AS chunk, l_quantity::BIGINT AS valid_length, c_mktsegment AS labels, c_nationkey AS source, {sql_split("c_custkey")} AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

# ---- flagship ---------------------------------------------------------------------------------------------------


@query("flagship_shared_fragments", f"""WITH {PIECES}
SELECT hash, count(DISTINCT source) AS sources, count(DISTINCT quality) AS qualities, count(*) AS n FROM pc GROUP BY hash HAVING count(DISTINCT source) > 1""")  # fmt: skip
def _(t):
    found = pieces(t).groupBy("hash").agg(F.countDistinct("source").alias("sources"), F.countDistinct("quality").alias("qualities"), F.count("*").alias("n"))
    return found.filter("sources > 1")


# ---- scalar expressions -----------------------------------------------------------------------------------------


@query("f1_normalize_dna", f"WITH {DNA} SELECT p_partkey, {NORMAL} AS x FROM dna")
def _(t):
    return dna(t).select("p_partkey", S.normalize_dna(F.col("s")).alias("x"))


@query("f2_reverse_complement", f"WITH {DNA}, n AS (SELECT p_partkey, {NORMAL} AS x FROM dna) SELECT p_partkey, {RC} AS rc FROM n")
def _(t):
    return dna(t).select("p_partkey", S.reverse_complement(S.normalize_dna(F.col("s"))).alias("rc"))


@query("f3_canonical_hash", f"WITH {DNA}, n AS (SELECT p_partkey, {NORMAL} AS x FROM dna) SELECT p_partkey, sha256(x) AS forward, sha256(least(x, {RC})) AS canonical FROM n")
def _(t):
    x = S.normalize_dna(F.col("s"))
    return dna(t).select("p_partkey", S.sequence_hash(x).alias("forward"), S.canonical_hash(x).alias("canonical"))


@query("f4_stable_id", "SELECT doc_id, 'REC_' || substr(sha256(coalesce(source, '') || chr(31) || doc_id::VARCHAR), 1, 20) AS record_id FROM documents")
def _(t):
    return t.documents.select("doc_id", S.stable_id(F.col("source"), F.col("doc_id"), prefix="REC_").alias("record_id"))


@query("f5_n_fraction", f"WITH {DNA}, n AS (SELECT p_partkey, {NORMAL} AS x FROM dna) SELECT p_partkey, round((length(x) - length(replace(x, 'N', ''))) / length(x), 6) AS n_fraction FROM n")
def _(t):
    return dna(t).select("p_partkey", r6(S.n_fraction(S.normalize_dna(F.col("s")))).alias("n_fraction"))


@query("f6_f7_canonical_names", r"SELECT page_id, regexp_replace(upper(url), '[^A-Z0-9]', '', 'g') AS accession, lower(trim(regexp_replace(replace(url, '_', ' '), '\s+', ' ', 'g'))) AS taxon FROM pages")
def _(t):
    return t.pages.select("page_id", S.canonical_accession(F.col("url")).alias("accession"), S.canonical_taxon(F.col("url")).alias("taxon"))


@query("f8_usable_genus", """SELECT p_partkey, lower(trim(g)) NOT IN ('', 'na', 'nan', 'none', 'unknown', 'unclassified', '(미분류)', 'mirus_unclassified', 'mirus', 'ncldv', 'g_') AND NOT contains(lower(trim(g)), 'unclassified') AS usable
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' NA ' WHEN 1 THEN 'Unclassified_x' WHEN 2 THEN '' WHEN 3 THEN 'g_' ELSE p_name END AS g FROM part)""")  # fmt: skip
def _(t):
    key = F.col("p_partkey") % 5
    genus = F.when(key == 0, " NA ").when(key == 1, "Unclassified_x").when(key == 2, "").when(key == 3, "g_").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", S.usable_genus(genus).alias("usable"))


@query("f9_header_parse", """SELECT o_orderkey, CASE s WHEN 0 THEN 'ARC' WHEN 1 THEN 'EVE_NCLDV' ELSE 'MITO' END || '__' || CASE s WHEN 1 THEN 'h-' || o_custkey || '-1' ELSE 'g' || o_custkey END AS genome_id,
  CASE s WHEN 0 THEN 'ARC__c' || o_orderkey WHEN 1 THEN 'EVE_NCLDV__r' || o_orderkey ELSE 'MITO__g' || o_custkey END AS contig_id, CASE s WHEN 1 THEN 'h-' || o_custkey || '-1' ELSE '' END AS host
FROM (SELECT *, o_orderkey % 3 AS s FROM orders)""")  # fmt: skip
def _(t):
    kind, c, o = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    source = F.when(kind == 0, "ARC").when(kind == 1, "EVE_NCLDV").otherwise("MITO")
    header = F.when(kind == 0, F.concat(F.lit("ARC__g"), c, F.lit("|c"), o)).when(kind == 1, F.concat(F.lit("EVE-NCLDV__h_"), c, F.lit(".1_eves|r"), o, F.lit(" x"))).otherwise(F.concat(F.lit("g"), c, F.lit(" text")))
    file = F.when(kind == 2, F.concat(F.lit("MITO__g"), c, F.lit(".fna"))).otherwise(F.lit(""))
    parsed = S.parse_header(source, header, file)
    return t.orders.select("o_orderkey", parsed.alias("h")).select("o_orderkey", "h.genome_id", "h.contig_id", "h.host")


@query("f10_lineage_ranks", "SELECT p_partkey, p_brand AS phylum, p_type AS class, '' AS species FROM part")
def _(t):
    ranks = S.lineage_ranks(F.concat_ws("|", F.lit("root"), "p_brand", "p_type"))
    return t.part.select("p_partkey", F.get(ranks, F.lit(0)).alias("phylum"), F.get(ranks, F.lit(1)).alias("class"), F.get(ranks, F.lit(5)).alias("species"))


@query("f14_f15_cascades", f"""WITH {RECORDS} SELECT doc_id, CASE WHEN toxic = 1 THEN 'cellular_genome_is_viral_host:a:x,b:y' WHEN length(text) % 100 / 100 > 0.9 THEN 'n_fraction_above_0.9' WHEN source = 'src1' AND lang = 'de' THEN NULL END AS reason,
CASE WHEN lang = 'en' THEN 'EVE_HOST::' || source ELSE 'GENOME::' || genome_id END AS base FROM rec""")  # fmt: skip
def _(t):
    hosts = F.when(F.col("toxic") == 1, F.array(F.lit("b:y"), F.lit("a:x")))
    source = F.when(F.col("lang") == "en", F.lit("EVE_x")).otherwise(F.lit("BAC"))
    reason = S.exclusion_reason(hosts, F.length("text") % 100 / 100, source, F.col("lang"), 0.9)
    return records(t).select("doc_id", reason.alias("reason"), S.base_group(source, F.lit(""), F.col("source"), F.lit(""), F.col("genome_id")).alias("base"))


@query("f18_tie_hash", "SELECT c_custkey, sha256('7|' || c_custkey || '|train') AS tie FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.tie_hash(F.lit(7), F.col("c_custkey"), F.lit("train")).alias("tie"))


@query("f19_sample_weight", f"WITH {ORDERS} SELECT genome_id, contig_id, chunk, round(valid_length / greatest(sum(valid_length) OVER (PARTITION BY genome_id), 1), 9) AS w FROM ch")
def _(t):
    ch = chunked_orders(t)
    total = ch.groupBy("genome_id").agg(F.sum("valid_length").alias("bp"))
    return ch.join(total, "genome_id").select("genome_id", "contig_id", "chunk", F.round(S.sample_weight(F.col("valid_length"), F.col("bp")), 9).alias("w"))


@query("f21_softmax", f"WITH {PRED} SELECT chunk_id, round(p[1], 6) AS p0, round(p[5], 6) AS p4 FROM pred")
def _(t):
    return predictions(t).select("chunk_id", r6(F.get("p", F.lit(0))).alias("p0"), r6(F.get("p", F.lit(4))).alias("p4"))


@query("f23_temperature", f"""WITH {PRED}, z AS (SELECT chunk_id, list_transform(p, lambda x: exp(ln(least(greatest(x, 1e-12), 1)) / 0.75)) AS e FROM pred)
SELECT chunk_id, round(e[1] / list_sum(e), 6) AS p0 FROM z""")  # fmt: skip
def _(t):
    return predictions(t).select("chunk_id", r6(F.get(N.temperature(F.col("p"), 0.75), F.lit(0))).alias("p0"))


@query("f24_f25_argmax_reject", f"WITH {PRED} SELECT chunk_id, CASE WHEN confidence >= 0.5 THEN predicted::VARCHAR ELSE 'unknown' END AS called FROM sc")
def _(t):
    p = F.col("p")
    return predictions(t).select("chunk_id", F.when(N.accepted(p, 0.5), N.argmax(p).cast("string")).otherwise("unknown").alias("called"))


@query("f26_f27_length_bands", """SELECT doc_id, CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 5000 THEN '500-4999' ELSE '>=5000' END AS band,
CASE WHEN n_chars < 500 THEN '1–499' WHEN n_chars < 1000 THEN '500–999' WHEN n_chars < 2000 THEN '1,000–1,999' WHEN n_chars < 3000 THEN '2,000–2,999' WHEN n_chars < 4000 THEN '3,000–3,999' WHEN n_chars < 5000 THEN '4,000–4,999' ELSE '5,000' END AS fine FROM documents""")  # fmt: skip
def _(t):
    return t.documents.select("doc_id", S.length_band(F.col("n_chars")).alias("band"), S.fine_band(F.col("n_chars")).alias("fine"))


@query("f29_random_strand", f"""WITH {DNA}, n AS (SELECT p_partkey, {NORMAL} AS x FROM dna)
SELECT p_partkey, CASE WHEN ('0x' || substr(sha256('3|1|' || p_partkey), 1, 13))::BIGINT / 4503599627370496.0 < 0.5 THEN {RC} ELSE x END AS s FROM n""")  # fmt: skip
def _(t):
    return dna(t).select("p_partkey", S.random_strand(S.normalize_dna(F.col("s")), 3, F.lit(1), F.col("p_partkey")).alias("s"))


@query("f30_undo_temperature", f"WITH {PRED}, z AS (SELECT chunk_id, list_transform(p, lambda x: pow(x, 0.75)) AS e FROM pred) SELECT chunk_id, round(e[1] / list_sum(e), 6) AS p0 FROM z")
def _(t):
    return predictions(t).select("chunk_id", r6(F.get(N.undo_temperature(F.col("p"), 0.75), F.lit(0))).alias("p0"))


@query("f31_smoothed_loss", f"WITH {PRED} SELECT chunk_id, round(0.95 * -ln(greatest(p[truth + 1], 1e-12)) + 0.05 / 5 * list_sum(list_transform(p, lambda x: -ln(greatest(x, 1e-12)))), 6) AS loss FROM pred")
def _(t):
    return predictions(t).select("chunk_id", r6(N.smoothed_cross_entropy(F.col("p"), F.col("truth"), 0.05, K)).alias("loss"))


@query("f34_units", "SELECT c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 6) AS per_second FROM customer")
def _(t):
    return t.customer.select("c_custkey", r6(N.per_second(F.col("c_acctbal"), F.col("c_nationkey"))).alias("per_second"))


# ---- generators -------------------------------------------------------------------------------------------------


@query("g1_chunk_explode", f'WITH {PIECES} SELECT record_id, start, "end", hash FROM pc')
def _(t):
    return pieces(t).select("record_id", "start", "end", "hash")


@query("g3_observations", f"""WITH {PIECES}, o AS (SELECT split, 'record_id' AS kind, record_id::VARCHAR AS key FROM pc UNION ALL SELECT split, 'genome_id', genome_id FROM pc UNION ALL SELECT split, 'hash', hash FROM pc)
SELECT kind, split, count(*) AS n, count(DISTINCT key) AS keys FROM o GROUP BY kind, split""")  # fmt: skip
def _(t):
    obs = qc.observations(pieces(t), ("record_id", "genome_id", "hash"), "quality")
    return obs.groupBy("kind", "split").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("g5_species_explode", """SELECT p_partkey, lower(trim(regexp_replace(replace(x, '_', ' '), '\\s+', ' ', 'g'))) AS species FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS x FROM part)""")
def _(t):
    text = F.concat(F.lit("g__none;s__"), "p_brand", F.lit(";s__"), "p_type", F.lit(";s__"))
    return t.part.select("p_partkey", F.explode(S.species_of(text)).alias("species"))


# ---- joins ------------------------------------------------------------------------------------------------------


@query("j1_left_metadata", "SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    meta = t.labels.withColumn("_seen", F.lit(True))
    return t.documents.join(meta, "doc_id", "left").select("doc_id", "quality", F.col("_seen").isNull().alias("missing"))


@query("j2_label_cascade", """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'snapshot_metadata' WHEN e.k IS NOT NULL THEN 'gv_labels' WHEN p.k IS NOT NULL THEN 'provisional' ELSE 'missing' END AS taxonomy_source,
CASE WHEN o_custkey % 4 = 0 THEN 'own' WHEN e.k IS NOT NULL THEN e.v WHEN p.k IS NOT NULL THEN p.v ELSE '' END AS phylum
FROM orders LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) e ON o_custkey = e.k LEFT JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal > 0) p ON o_custkey = p.k""")  # fmt: skip
def _(t):
    side = lambda having, v: t.customer.filter(having).select(F.lit("x").alias("source"), F.col("c_custkey").alias("raw_genome"), F.array(F.col(v), *[F.lit("")] * 5).alias("ranks"))
    own = F.when(F.col("o_custkey") % 4 == 0, F.array(F.lit("own"), *[F.lit("")] * 5))
    rows = t.orders.select("o_orderkey", F.lit("x").alias("source"), F.col("o_custkey").alias("raw_genome"), own.alias("snapshot"))
    return manifest.taxonomy_cascade(rows, side("c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment"), side("c_acctbal > 0", "c_name")).select("o_orderkey", "taxonomy_source", F.get("taxonomy", F.lit(0)).alias("phylum"))


@query("j3_host_overlap", f"""WITH {PIECES}, m AS (SELECT DISTINCT record_id, source, hash FROM pc), o AS (SELECT hash, source, count(*) AS n FROM m GROUP BY 1, 2), h AS (SELECT hash, sum(n) AS n FROM o GROUP BY 1 HAVING count(*) > 1)
SELECT m.record_id, count(*) AS matches, sum(h.n - o.n)::BIGINT AS records FROM m JOIN h USING (hash) JOIN o ON o.hash = m.hash AND o.source = m.source GROUP BY m.record_id""")  # fmt: skip
def _(t):
    """Fragments that a record shares with records of other sources, and how many those are; counted by hash and source,
    so that no pair of records is listed."""
    mine = save(pieces(t).filter("source IS NOT NULL").select("record_id", "source", "hash").distinct(), "fragments")
    own = save(mine.groupBy("hash", "source").agg(F.count("*").alias("own")), "fragments-by-source")
    every = own.groupBy("hash").agg(F.sum("own").alias("n"), F.count("*").alias("sources")).filter("sources > 1").select("hash", "n")
    found = mine.join(own.join(every, "hash"), ["hash", "source"])
    return found.groupBy("record_id").agg(F.count("*").alias("matches"), F.sum(F.col("n") - F.col("own")).cast("long").alias("records"))


@query("j3_j4_host_match", """WITH c AS (SELECT c_custkey, 'f__' || c_custkey || '.fna' AS filename, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS a, upper(c_custkey::VARCHAR) AS b, lower(c_mktsegment) AS s FROM customer),
h AS (SELECT regexp_replace(upper(o_custkey::VARCHAR), '[^A-Z0-9]', '', 'g') AS k, count(*) AS n FROM orders GROUP BY 1),
sp AS (SELECT lower(s_name) AS k, count(*) AS n FROM supplier GROUP BY 1),
m AS (SELECT filename, unnest(list_distinct([a, b])) AS k FROM c)
SELECT filename, 'exact_assembly_accession' AS match_type, h.k AS match_value, h.n AS matching_viral_records FROM m JOIN h USING (k)
UNION ALL SELECT filename, 'exact_host_species_name', sp.k, sp.n FROM c JOIN sp ON sp.k = c.s""")  # fmt: skip
def _(t):
    genomes = t.customer.select(F.lit("BAC").alias("source"), F.concat(F.lit("f__"), "c_custkey", F.lit(".fna")).alias("filename"), F.col("c_name").alias("assembly_accession"), F.col("c_mktsegment").alias("species_name"), F.lit("").alias("organism_name"))
    hosts = t.orders.select(F.lit("EVE_NCLDV").alias("viral_source"), F.col("o_custkey").cast("string").alias("host"))
    species = t.supplier.select(F.concat(F.lit("s__"), "s_name").alias("taxonomy"))
    return manifest.host_overlaps(genomes, hosts, species).select("filename", "match_type", "match_value", "matching_viral_records")


@query("j6_inventory_difference", """SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    return manifest.inventory_difference(t.documents, t.labels, "doc_id")


@query("j7_j8_unchanged", f"WITH {RECORDS} SELECT doc_id AS record_id, CASE WHEN doc_id % 5 = 0 THEN 'not in manifest' ELSE 'changed' END AS problem FROM rec WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def _(t):
    rows = records(t).select("record_id", F.col("text").alias("sequence"))
    changed = F.when(F.col("record_id") % 7 == 0, F.concat("sequence", F.lit("x"))).otherwise(F.col("sequence"))
    saved = rows.filter("record_id % 5 <> 0").select("record_id", S.sequence_hash(changed).alias("sequence_sha256"))
    return manifest.unchanged(rows, saved)


@query("j9_semi_allowed", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("j10_genome_info", f"WITH {ORDERS} SELECT genome_id, contig_id, chunk, sum(valid_length) OVER (PARTITION BY genome_id)::BIGINT AS genome_total_bp, split FROM ch")
def _(t):
    ch = chunked_orders(t)
    info = ch.groupBy("genome_id").agg(F.sum("valid_length").cast("long").alias("genome_total_bp"))
    return ch.join(info, "genome_id").select("genome_id", "contig_id", "chunk", "genome_total_bp", "split")


@query("j11_anti_conflict", f"""WITH {PIECES} SELECT record_id, start, hash FROM pc WHERE hash NOT IN (SELECT hash FROM pc GROUP BY hash HAVING count(DISTINCT source) > 1)""")
def _(t):
    p = save(pieces(t).select("record_id", "start", "hash", "source"), "fragments")
    return p.join(splits.label_conflicts(p, "hash", "source"), "hash", "left_anti").select("record_id", "start", "hash")


@query("j12_j13_final_manifest", f"""WITH {RECORDS}, h AS (SELECT sha256(text) AS k FROM rec GROUP BY 1 HAVING count(DISTINCT quality) > 1),
m AS (SELECT doc_id, genome_id, CASE WHEN sha256(text) IN (SELECT k FROM h) THEN 'conflicting_labels_for_identical_sequence' WHEN toxic = 1 THEN 'toxic' WHEN length(text) < 60 THEN 'short' END AS exclusion_reason FROM rec)
SELECT doc_id, exclusion_reason, CASE WHEN exclusion_reason IS NOT NULL THEN 'quarantine' ELSE {sql_split("genome_id")} END AS split FROM m""")  # fmt: skip
def _(t):
    rec = records(t).select("doc_id", "record_id", F.col("genome_id").alias("base_group_id"), S.sequence_hash(F.col("text")).alias("canonical_sha256"), "quality", "toxic", F.lit(None).cast("string").alias("split"), F.when(F.length("text") < 60, F.lit("short")).alias("exclusion_reason"))
    groups = rec.select("base_group_id", F.col("base_group_id").alias("similarity_component")).distinct()
    assigned = groups.select(F.col("similarity_component").alias("component"), split_of(F.col("similarity_component")).alias("split"))
    early = rec.filter("toxic = 1").select("record_id", F.lit("toxic").alias("reason"))
    return splits.final_manifest(rec, groups, assigned, splits.label_conflicts(rec, "canonical_sha256", "quality"), early).select("doc_id", "exclusion_reason", "split")


@query("j15_a46_consistency", f"""WITH {RECORDS} SELECT count(*) AS n, count_if(s IS DISTINCT FROM split) AS mismatches, bool_and(s IS NOT DISTINCT FROM split) AS aligned
FROM (SELECT rec.split, CASE WHEN doc_id % 11 = 0 THEN 'train' ELSE rec.split END AS s FROM rec)""")  # fmt: skip
def _(t):
    saved = records(t).select("doc_id", F.when(F.col("doc_id") % 11 == 0, "train").otherwise(F.col("split")).alias("s"))
    same = F.col("s").eqNullSafe(F.col("split"))
    return records(t).join(saved, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(~same).alias("mismatches"), F.bool_and(same).alias("aligned"))


@query("j16_cross_split_edges", f"""SELECT count(*) AS edges, count_if(a.s <> b.s) AS crossing FROM orders JOIN (SELECT c_custkey, {sql_split("c_custkey")} AS s FROM customer) a ON o_custkey = a.c_custkey
JOIN (SELECT c_custkey, {sql_split("c_custkey")} AS s FROM customer) b ON o_orderkey % 150 + 1 = b.c_custkey""")  # fmt: skip
def _(t):
    groups = t.customer.select(F.col("c_custkey").alias("grp"), split_of(F.col("c_custkey")).alias("split"))
    edges = t.orders.select(F.col("o_custkey").alias("left_group"), (F.col("o_orderkey") % 150 + 1).alias("right_group"))
    both = edges.join(groups.select(F.col("grp").alias("left_group")), "left_group", "left_semi").join(groups.select(F.col("grp").alias("right_group")), "right_group", "left_semi")
    return both.agg(F.count("*").alias("edges")).crossJoin(audit.crossing_edges(edges, groups).agg(F.count("*").alias("crossing")))


@query("j17_j18_one_to_one", """WITH a AS (SELECT doc_id AS k, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id AS k, count(*) AS n FROM labels GROUP BY 1)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'left lacks' WHEN b.k IS NULL THEN 'right lacks' WHEN a.n > 1 OR b.n > 1 THEN 'repeats' END AS problem FROM a FULL JOIN b ON a.k = b.k) WHERE problem IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(t):
    return audit.one_to_one(t.documents, t.labels, "doc_id")


@query("j19_recomputed", f"""WITH {ORDERS}, g AS (SELECT genome_id, avg(valid_length) AS v FROM ch GROUP BY 1) SELECT genome_id, round(v + (genome_id % 9 = 0)::INT, 6) AS saved, round(v, 6) AS again FROM g WHERE genome_id % 9 = 0""")
def _(t):
    again = chunked_orders(t).groupBy("genome_id").agg(F.avg("valid_length").alias("v"))
    saved = again.withColumn("v", F.col("v") + F.when(F.col("genome_id") % 9 == 0, 1).otherwise(0))
    return audit.recomputed(saved, again, ["genome_id"], "v").select("genome_id", r6("a").alias("saved"), r6("b").alias("again"))


@query("j20_multiset_difference", """(SELECT source, lang, 'left' AS side FROM documents EXCEPT ALL SELECT source, lang, 'left' FROM documents WHERE doc_id % 3 = 0)
UNION ALL (SELECT source, lang, 'right' FROM documents WHERE doc_id % 3 = 0 EXCEPT ALL SELECT source, lang, 'right' FROM documents)""")  # fmt: skip
def _(t):
    pairs = t.documents.select("doc_id", "source", "lang")
    return qc.multiset_difference(pairs.drop("doc_id"), pairs.filter("doc_id % 3 = 0").drop("doc_id"))


FIRST = f"""{RECORDS}, h AS (SELECT doc_id, genome_id, lang AS label, sha256(text) AS hash FROM rec),
f AS (SELECT *, first_value(genome_id) OVER w AS fg, first_value(label) OVER w AS fl, first_value(doc_id) OVER w AS fd FROM h WINDOW w AS (PARTITION BY hash ORDER BY doc_id))"""


def _exact(t, label="lang"):
    rows = records(t).select("record_id", F.col("genome_id").alias("grp"), F.col(label).alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("doc_id").alias("pos"))
    return similarity.exact_edges(rows)


@query("j23_exact_fragment_edges", f"WITH {FIRST} SELECT DISTINCT least(genome_id, fg) AS left_group, greatest(genome_id, fg) AS right_group, 'exact_fragment' AS reason FROM f WHERE label = fl AND genome_id <> fg")
def _(t):
    return _exact(t)[0]


@query("j24_cross_label_records", f"WITH {FIRST.replace('lang AS label', 'source AS label')} SELECT DISTINCT unnest([doc_id, fd]) AS record_id FROM f WHERE label <> fl")
def _(t):
    return _exact(t, "source")[1].select("record_id")


@query("j25_split_pairs", f"""WITH {PIECES}, s AS (SELECT DISTINCT hash, split FROM pc) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b ON a.hash = b.hash AND a.split < b.split GROUP BY 1, 2""")
def _(t):
    return audit.split_pairs(pieces(t), "hash")


@query("j26_hash_membership", f"""WITH {PIECES} SELECT split, count(*) AS n FROM pc WHERE split <> 'train' AND hash IN (SELECT hash FROM pc WHERE split = 'train') GROUP BY split""")
def _(t):
    p = save(pieces(t).select("hash", "split"), "fragments")
    return p.filter("split <> 'train'").join(p.filter("split = 'train'"), "hash", "left_semi").groupBy("split").agg(F.count("*").alias("n"))


# ---- aggregates -------------------------------------------------------------------------------------------------


@query("a1_source_summary", f"""WITH {RECORDS} SELECT source, count(*) AS records, count(DISTINCT genome_id) AS genomes, sum(length(text))::BIGINT AS bases, count_if(toxic = 1) AS quarantined, count_if(length(text) = 0) AS empty FROM rec GROUP BY source""")
def _(t):
    rows = records(t).withColumns({"sequence_length": F.length("text"), "exclusion_reason": F.when(F.col("toxic") == 1, F.lit("toxic"))})
    return manifest.source_summary(rows)


@query("a2_distinct_genomes", f"WITH {RECORDS} SELECT count(DISTINCT genome_id) AS genomes FROM rec")
def _(t):
    return records(t).agg(F.countDistinct("genome_id").alias("genomes"))


@query("a3_overlap_reasons", """SELECT 'x' AS source, l_orderkey::VARCHAR AS filename, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS reasons FROM lineitem GROUP BY l_orderkey""")
def _(t):
    rows = t.lineitem.select(F.lit("x").alias("source"), F.col("l_orderkey").cast("string").alias("filename"), F.col("l_returnflag").alias("matched_viral_source"), F.col("l_linestatus").alias("match_type"))
    return manifest.overlap_reasons(rows).select("source", "filename", F.array_join("host_reasons", ",").alias("reasons"))


@query("a4_records_per_host", "SELECT l_suppkey, l_shipmode AS mode, n FROM (SELECT l_suppkey, l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(t):
    return t.lineitem.groupBy("l_suppkey", F.col("l_linestatus").alias("mode")).agg(F.count("*").alias("n"))


@query("a5_label_conflict", f"WITH {PIECES} SELECT hash, count(DISTINCT source) AS labels FROM pc GROUP BY hash HAVING count(DISTINCT source) > 1")
def _(t):
    return splits.label_conflicts(pieces(t), "hash", "source")


@query("a6_a7_component_stats", f"""WITH {ORDERS}, b AS (SELECT source, labels, sum(valid_length) AS b, min(contig_id) AS o FROM ch GROUP BY 1, 2)
SELECT source AS component, sum(valid_length)::BIGINT AS bases, count(*) AS contigs, count(DISTINCT genome_id) AS genomes, (SELECT arg_max(labels, (b, -o)) FROM b WHERE b.source = ch.source) AS main_labels FROM ch GROUP BY source""")  # fmt: skip
def _(t):
    rows = chunked_orders(t).withColumn("component", F.col("source"))
    return splits.component_stats(rows, bases="valid_length", label="labels", order="contig_id").drop("main_source")


@query("a8_component_names", "WITH g AS (SELECT c_nationkey, min(c_custkey::VARCHAR) AS m FROM customer GROUP BY 1) SELECT c_nationkey, 'SIM_' || substr(sha256(m), 1, 20) AS component FROM g")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(F.min(F.col("c_custkey").cast("string")).alias("m")).select("c_nationkey", S.stable_id(F.col("m"), prefix="SIM_").alias("component"))


@query("a9_source_label_split", f"WITH {RECORDS} SELECT source, quality, split, count(*) AS records, count(DISTINCT genome_id) AS genomes FROM rec GROUP BY 1, 2, 3")
def _(t):
    return records(t).groupBy("source", "quality", "split").agg(F.count("*").alias("records"), F.countDistinct("genome_id").alias("genomes"))


@query("a10_genome_totals", f"WITH {ORDERS} SELECT genome_id, sum(valid_length)::BIGINT AS bp, arg_max(split, contig_id) AS split FROM ch GROUP BY 1")
def _(t):
    return chunked_orders(t).groupBy("genome_id").agg(F.sum("valid_length").cast("long").alias("bp"), F.max_by("split", "contig_id").alias("split"))


@query("a11_chunk_counters", f"""WITH {PIECES}, x AS (SELECT *, 'main' AS task FROM pc UNION ALL SELECT *, 'sub' FROM pc WHERE quality IS NOT NULL)
SELECT task, split, count(*) AS chunks, sum(valid_length)::BIGINT AS bases, count(DISTINCT genome_id) AS genomes FROM x GROUP BY GROUPING SETS ((task, split), (task))""")  # fmt: skip
def _(t):
    return chunks.chunk_counts(pieces(t).withColumn("sub_labels", F.col("quality")))


OBS = f"""{PIECES}, o AS (SELECT split, quality, 'hash' AS kind, hash AS key FROM pc UNION ALL SELECT split, quality, 'genome_id', genome_id FROM pc),
x AS (SELECT kind, key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM o GROUP BY kind, key HAVING count(DISTINCT split) > 1)"""


def _observed(t):
    return qc.observations(pieces(t), ("hash", "genome_id"), "quality")


@query("a12_cross_split_overlap", f"WITH {OBS} SELECT kind, count(*) AS overlaps FROM x GROUP BY kind")
def _(t):
    return qc.overlap_counts(_observed(t))


@query("a13_chunk_label_conflicts", f"WITH {PIECES} SELECT hash AS key, count(DISTINCT source) AS labels FROM pc GROUP BY 1 HAVING count(DISTINCT source) > 1")
def _(t):
    return qc.label_conflicts(qc.observations(pieces(t).withColumn("chunk_hash", F.col("hash")), ("chunk_hash",), "source"))


@query("a14_overlap_examples", f"WITH {OBS} SELECT kind, key, splits FROM x ORDER BY kind, key LIMIT 20")
def _(t):
    return qc.overlap_examples(_observed(t))


@query("a15_fingerprint", """WITH h AS (SELECT ('0x' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, coalesce(source, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents)
SELECT count(*) AS rows, sum(h)::VARCHAR AS total, bit_xor(h) AS parity FROM h""")  # fmt: skip
def _(t):
    return qc.fingerprint(t.documents, "doc_id", "source", "text")


TAXA = f"tx AS (SELECT c_custkey AS genome_id, c_nationkey AS taxon, {sql_split('c_custkey')} AS split FROM customer UNION ALL SELECT c_custkey, 99, {sql_split('c_custkey')} FROM customer WHERE c_custkey % 10 = 0)"


def _taxa(t):
    base = t.customer.select(F.col("c_custkey").alias("genome_id"), F.format_string("t%02d", F.col("c_nationkey")).alias("taxon"), split_of(F.col("c_custkey")).alias("split"))
    return base.unionByName(base.filter("genome_id % 10 = 0").withColumn("taxon", F.lit("t99")))


@query("a16_w5_vocabulary", f"WITH {TAXA}, n AS (SELECT taxon, count(DISTINCT genome_id) AS genomes FROM tx WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT genome_id) >= 5) SELECT format('t{{:02d}}', taxon) AS taxon, genomes, (row_number() OVER (ORDER BY taxon) - 1)::INT AS label_id FROM n")
def _(t):
    return taxonomy.vocabulary(_taxa(t), 5)


@query("a17_j14_known_counts", f"""WITH {TAXA}, {ORDERS}, n AS (SELECT taxon FROM tx WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT genome_id) >= 45), r AS (SELECT genome_id, min(taxon) AS taxon FROM tx GROUP BY 1 HAVING count(DISTINCT taxon) = 1)
SELECT ch.split, count_if(taxon IN (SELECT taxon FROM n)) AS known_chunks, count_if(taxon NOT IN (SELECT taxon FROM n)) AS unseen_taxon_chunks FROM ch JOIN r USING (genome_id) GROUP BY 1""")  # fmt: skip
def _(t):
    rows = _taxa(t)
    return taxonomy.known_counts(taxonomy.relabel(chunked_orders(t), taxonomy.reliable_genomes(rows), taxonomy.vocabulary(rows, 45)))


@query("a18_dataset_stats", f"WITH {ORDERS} SELECT labels, count(*) AS chunks, sum(valid_length)::BIGINT AS bases, count(DISTINCT genome_id) AS genomes, count(DISTINCT (genome_id, contig_id)) AS contigs FROM ch GROUP BY 1")
def _(t):
    return weights.dataset_stats(chunked_orders(t))


CLASS = f"{ORDERS}, g AS (SELECT labels, count(DISTINCT genome_id) AS genomes FROM ch GROUP BY 1), r AS (SELECT *, pow((SELECT max(genomes) FROM g) / genomes, 0.5) AS w FROM g), cw AS (SELECT labels, genomes, w / (SELECT avg(w) FROM r) AS weight FROM r)"


@query("a19_class_weights", f"WITH {CLASS} SELECT labels, genomes, round(weight, 6) AS weight FROM cw")
def _(t):
    return weights.class_weights(weights.dataset_stats(chunked_orders(t)).select("labels", "genomes")).withColumn("weight", r6("weight"))


def _weighted(t):
    ch = chunked_orders(t)
    total = ch.groupBy("genome_id").agg(F.sum("valid_length").alias("bp"))
    ch = ch.join(total, "genome_id").withColumn("sample_weight", S.sample_weight(F.col("valid_length"), F.col("bp")))
    return weights.normalised_weights(ch, weights.class_weights(weights.dataset_stats(ch).select("labels", "genomes")))


WEIGHTED = f"""{CLASS}, s AS (SELECT ch.*, valid_length / sum(valid_length) OVER (PARTITION BY genome_id) * weight AS sw FROM ch JOIN cw USING (labels)),
lw AS (SELECT *, sw * count(*) OVER (PARTITION BY split) / sum(sw) OVER (PARTITION BY split) AS loss_weight FROM s)"""


@query("a20_weight_norm", f"WITH {WEIGHTED} SELECT split, labels, count(*) AS n, round(avg(loss_weight), 6) AS mean_weight FROM lw GROUP BY 1, 2")
def _(t):
    return _weighted(t).groupBy("split", "labels").agg(F.count("*").alias("n"), r6(F.avg("loss_weight")).alias("mean_weight"))


def level_sql(key: str) -> str:
    logs = ", ".join(f"sum(ln(least(greatest(p[{c + 1}], 1e-12), 1)) * valid_length) / sum(valid_length)" for c in range(K))
    return f"""SELECT {key} AS k, list_value({logs}) AS lg, sum(valid_length) AS valid_length, arg_min(truth, chunk_id) AS truth, arg_min(source, chunk_id) AS source FROM pred GROUP BY {key}"""


def level_pred(key: str) -> str:
    return f"lv0 AS ({level_sql(key)}), lv1 AS (SELECT *, list_transform(lg, lambda x: exp(x - list_max(lg))) AS e FROM lv0), lv AS (SELECT * EXCLUDE (e, lg), list_transform(e, lambda x: x / list_sum(e)) AS p FROM lv1)"


@query("a21_logprob_aggregate", f"WITH {PRED}, {level_pred('genome_id')} SELECT k AS genome_id, truth, valid_length::BIGINT AS valid_length, round(p[1], 6) AS p0, round(p[5], 6) AS p4 FROM lv")
def _(t):
    out = evaluate.aggregate_level(predictions(t), ["genome_id"], K)
    return out.select("genome_id", "truth", "valid_length", r6(F.get("p", F.lit(0))).alias("p0"), r6(F.get("p", F.lit(4))).alias("p4"))


@query("a41_contig_reaggregation", f"WITH {PRED}, {level_pred('(genome_id, contig_id)')} SELECT truth, count(*) AS n, count_if(list_position(p, list_max(p)) - 1 = truth) AS hits FROM lv GROUP BY truth")
def _(t):
    out = evaluate.scored(evaluate.aggregate_level(predictions(t), ["genome_id", "contig_id"], K))
    return out.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("hits"))


CELLS = f"""{PRED}, c AS (SELECT t.i AS truth, q.i AS predicted, (SELECT count(*) FROM sc WHERE sc.truth = t.i AND sc.predicted = q.i) AS n FROM range({K}) t(i), range({K}) q(i)),
m AS (SELECT k.i::INT AS class, (SELECT sum(n) FROM c WHERE truth = k.i AND predicted = k.i) AS tp, (SELECT sum(n) FROM c WHERE truth = k.i) AS support, (SELECT sum(n) FROM c WHERE predicted = k.i) AS called FROM range({K}) k(i)),
f AS (SELECT class, coalesce(tp / nullif(called, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(called + support, 0), 0)::DOUBLE AS f1, support, tp FROM m)"""


@query("a23_confusion", f"WITH {CELLS} SELECT truth::INT AS truth, predicted::INT AS predicted, n FROM c")
def _(t):
    return evaluate.confusion(evaluate.scored(predictions(t)), K)


@query("a24_precision_recall_f1", f"WITH {CELLS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f")
def _(t):
    out = evaluate.class_metrics(evaluate.confusion(evaluate.scored(predictions(t)), K))
    return out.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), F.col("support").cast("long").alias("support"))


@query("a25_summary", f"WITH {CELLS} SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(tp) / sum(support), 6) AS accuracy FROM f")
def _(t):
    out = evaluate.summary(evaluate.class_metrics(evaluate.confusion(evaluate.scored(predictions(t)), K)))
    return out.select(*[r6(c).alias(c) for c in ("macro_f1", "balanced_accuracy", "accuracy")])


VALIDATION = f"""{PRED}, {level_pred('genome_id').replace('arg_min(truth, chunk_id)', 'arg_max(truth, chunk_id)')}, gs AS (SELECT truth, list_position(p, list_max(p)) - 1 AS predicted FROM lv),
gm AS (SELECT k.c, count_if(truth = k.c AND predicted = k.c) AS tp, count_if(truth = k.c) AS support, count_if(predicted = k.c) AS called FROM gs, range({K}) k(c) GROUP BY 1)"""


@query("a22_validation_metrics", f"WITH {VALIDATION} SELECT round(avg(coalesce(tp / nullif(called, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(support, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(called + support, 0), 0)), 6) AS macro_f1, round(avg(tp / support) FILTER (support > 0), 6) AS balanced_accuracy FROM gm")
def _(t):
    genomes = evaluate.scored(evaluate.aggregate_level(predictions(t), ["genome_id"], K, last=True))
    each = evaluate.class_metrics(evaluate.confusion(genomes, K))
    seen = F.when(F.col("support") > 0, F.col("recall"))
    return each.agg(r6(F.avg("precision")).alias("precision"), r6(F.avg("recall")).alias("recall"), r6(F.avg("f1")).alias("macro_f1"), r6(F.avg(seen)).alias("balanced_accuracy"))


CURVE = f"{PRED}, cv AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS count, avg(confidence) AS mean_confidence, avg((predicted = truth)::INT) AS accuracy FROM sc GROUP BY 1)"


@query("a26_reliability", f"WITH {CURVE} SELECT bin, count, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM cv")
def _(t):
    return evaluate.reliability(evaluate.scored(predictions(t))).select("bin", "count", r6("mean_confidence").alias("mean_confidence"), r6("accuracy").alias("accuracy"))


@query("a26_ece", f"WITH {CURVE} SELECT round(sum(count * abs(mean_confidence - accuracy)) / sum(count), 6) AS ece FROM cv")
def _(t):
    return evaluate.ece(evaluate.reliability(evaluate.scored(predictions(t)))).select(r6("ece").alias("ece"))


@query("a27_average_precision", f"""WITH {PRED}, x AS (SELECT c::INT AS class, p[c + 1] AS s, truth = c AS y FROM pred, range({K}) r(c)), g AS (SELECT class, s, count_if(y) AS tp, count(*) AS n FROM x GROUP BY 1, 2),
w AS (SELECT class, s, sum(tp) OVER d / sum(n) OVER d AS pr, sum(tp) OVER d / nullif(sum(tp) OVER (PARTITION BY class), 0) AS rc FROM g WINDOW d AS (PARTITION BY class ORDER BY s DESC)),
l AS (SELECT *, coalesce(lag(rc) OVER (PARTITION BY class ORDER BY s DESC), 0) AS r0, coalesce(lag(pr) OVER (PARTITION BY class ORDER BY s DESC), 1) AS p0 FROM w)
SELECT class, round(sum((rc - r0) * pr), 6) AS average_precision, round(sum((rc - r0) * (pr + p0) / 2), 6) AS pr_auc FROM l GROUP BY class""")  # fmt: skip
def _(t):
    each = predictions(t).select("truth", F.posexplode("p").alias("class", "s"))
    curve = evaluate.precision_recall(each, F.col("s"), F.col("truth") == F.col("class"), ("class",))
    return evaluate.average_precision(curve, ("class",)).select("class", r6("average_precision").alias("average_precision"), r6("pr_auc").alias("pr_auc"))


def bootstrap_sql(repeats: int) -> str:
    return f"""WITH {PRED}, gr AS (SELECT split_group, row_number() OVER (ORDER BY split_group) - 1 AS i FROM (SELECT DISTINCT split_group FROM sc)), gn AS (SELECT count(*) AS g FROM gr),
pick AS (SELECT rep, ('0x' || substr(sha256('0|' || rep || '|' || d), 1, 8))::BIGINT % g AS i FROM gn, range({repeats}) r(rep), range(1000000) q(d) WHERE d < g),
cm AS (SELECT rep, truth, predicted, count(*) AS n FROM pick JOIN gr USING (i) JOIN sc USING (split_group) GROUP BY ALL),
f AS (SELECT rep, k.c, coalesce(2 * sum(n) FILTER (truth = k.c AND predicted = k.c), 0) / nullif(coalesce(sum(n) FILTER (truth = k.c), 0) + coalesce(sum(n) FILTER (predicted = k.c), 0), 0) AS f1 FROM cm, range({K}) k(c) GROUP BY 1, 2),
m AS (SELECT rep, sum(coalesce(f1, 0)) / {K} AS macro FROM f GROUP BY rep)
SELECT round(quantile_cont(macro, 0.025), 6) AS low, round(quantile_cont(macro, 0.975), 6) AS high, (SELECT g FROM gn) AS groups FROM m"""  # fmt: skip


@query("a28_bootstrap_ci", bootstrap_sql(Settings().bootstrap_repeats))
def _(t):
    return evaluate.bootstrap_hashed(evaluate.scored(predictions(t)), K, Settings().bootstrap_repeats, 0).select(r6("low").alias("low"), r6("high").alias("high"), "groups")


@query("a29_slices_grouping_sets", f"""WITH {PRED}, x AS (SELECT 'chunk' AS level, source, CASE WHEN valid_length < 500 THEN '<500' WHEN valid_length < 5000 THEN '500-4999' ELSE '>=5000' END AS band, (predicted = truth)::INT AS r FROM sc)
SELECT level, source, band, count(*) AS n, round(avg(r), 6) AS accuracy FROM x GROUP BY GROUPING SETS ((level), (level, source), (level, band))""")  # fmt: skip
def _(t):
    out = evaluate.slices(evaluate.scored(predictions(t)).withColumn("level", F.lit("chunk")), K)
    return out.withColumn("accuracy", r6("accuracy"))


def _level(key: str, name: str) -> str:
    return level_pred(key).replace("lv", name)


REPORTS = f"""{PRED}, {_level("(genome_id, contig_id)", "lc")}, {_level("genome_id", "lg")},
al AS (SELECT 'chunk' AS level, source, truth, p, valid_length FROM pred UNION ALL SELECT 'contig', source, truth, p, valid_length FROM lc UNION ALL SELECT 'genome', source, truth, p, valid_length FROM lg),
sl AS (SELECT level, unnest([{{'kind': 'all', 'slice': ''}}, {{'kind': 'source', 'slice': source}}, {{'kind': 'band', 'slice': CASE WHEN valid_length < 500 THEN '<500' WHEN valid_length < 5000 THEN '500-4999' ELSE '>=5000' END}}]) AS s,
  truth, p, (list_position(p, list_max(p)) - 1)::INT AS predicted, list_max(p) AS confidence FROM al),
r AS (SELECT level, s.kind AS kind, s.slice AS slice, truth, p, predicted, confidence FROM sl), g AS (SELECT DISTINCT level, kind, slice FROM r), ks AS (SELECT unnest(range({K}))::INT AS class),
cc AS (SELECT level, kind, slice, truth, predicted, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT g.*, a.class AS truth, b.class AS predicted, coalesce(n, 0) AS n FROM g CROSS JOIN ks a CROSS JOIN ks b LEFT JOIN cc ON (cc.level, cc.kind, cc.slice, cc.truth, cc.predicted) = (g.level, g.kind, g.slice, a.class, b.class)),
m AS (SELECT c.level, c.kind, c.slice, ks.class, sum(n) FILTER (truth = class AND predicted = class) AS tp, sum(n) FILTER (truth = class) AS support, sum(n) FILTER (predicted = class) AS called, sum(n) AS n FROM c, ks GROUP BY ALL),
f AS (SELECT *, coalesce(tp / nullif(called, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(called + support, 0), 0)::DOUBLE AS f1, support / n AS prevalence FROM m),
top AS (SELECT level, kind, slice, any_value(n)::DOUBLE AS n, avg(f1) AS macro_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy, sum(tp) / sum(support) AS accuracy FROM f GROUP BY ALL),
b AS (SELECT level, kind, slice, least(floor(confidence * 10), 9)::INT AS bin, count(*)::DOUBLE AS count, avg(confidence) AS mean_confidence, avg((predicted = truth)::INT) AS accuracy FROM r GROUP BY ALL),
e AS (SELECT level, kind, slice, sum(count * abs(mean_confidence - accuracy)) / sum(count) AS ece FROM b GROUP BY ALL),
x AS (SELECT level, kind, slice, class, p[class + 1] AS s, truth = class AS y FROM r, ks), t AS (SELECT level, kind, slice, class, s, count_if(y) AS tp, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT level, kind, slice, class, s, sum(tp) OVER d AS tp, sum(n) OVER d AS n, sum(tp) OVER q AS pos, sum(n) OVER q AS every FROM t WINDOW d AS (PARTITION BY level, kind, slice, class ORDER BY s DESC), q AS (PARTITION BY level, kind, slice, class)),
l AS (SELECT *, tp / n AS pr, tp / nullif(pos, 0) AS rc, coalesce(lag(tp / nullif(pos, 0)) OVER o, 0) AS r0, coalesce(lag(tp / n) OVER o, 1) AS p0 FROM w WINDOW o AS (PARTITION BY level, kind, slice, class ORDER BY s DESC)),
ap AS (SELECT level, kind, slice, class, CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(every) THEN sum((rc - r0) * pr) END AS average_precision, CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(every) THEN sum((rc - r0) * (pr + p0) / 2) END AS pr_auc FROM l GROUP BY ALL),
reports AS (SELECT level, kind, slice, k.m AS metric, NULL::INT AS class, NULL::INT AS other, k.v::DOUBLE AS value FROM (SELECT level, kind, slice, unnest([{{'m': 'n', 'v': n}}, {{'m': 'macro_f1', 'v': macro_f1}}, {{'m': 'balanced_accuracy', 'v': balanced_accuracy}}, {{'m': 'accuracy', 'v': accuracy}}]) AS k FROM top)
UNION ALL SELECT level, kind, slice, 'ece', NULL, NULL, ece FROM e
UNION ALL SELECT level, kind, slice, k.m, class, NULL, k.v FROM (SELECT level, kind, slice, class, unnest([{{'m': 'precision', 'v': precision}}, {{'m': 'recall', 'v': recall}}, {{'m': 'f1', 'v': f1}}, {{'m': 'support', 'v': support::DOUBLE}}, {{'m': 'prevalence', 'v': prevalence}}]) AS k FROM f)
UNION ALL SELECT level, kind, slice, k.m, class, NULL, k.v FROM (SELECT level, kind, slice, class, unnest([{{'m': 'average_precision', 'v': average_precision}}, {{'m': 'pr_auc', 'v': pr_auc}}]) AS k FROM ap)
UNION ALL SELECT level, kind, slice, 'confusion', truth, predicted, n FROM c
UNION ALL SELECT level, kind, slice, k.m, NULL, bin, k.v FROM (SELECT level, kind, slice, bin, unnest([{{'m': 'reliability_count', 'v': count}}, {{'m': 'reliability_mean_confidence', 'v': mean_confidence}}, {{'m': 'reliability_accuracy', 'v': accuracy}}]) AS k FROM b))"""


@query("a29_slice_reports", f"WITH {REPORTS} SELECT level, kind, slice, metric, class, other, round(value, 6) AS value FROM reports")
def _(t):
    return evaluate.slice_reports(evaluate.all_levels(predictions(t), K), K).withColumn("value", r6("value"))


@query("s18_metric_documents", f"""WITH {REPORTS}, v AS (SELECT level, kind || '/' || slice || '/' || metric || '/' || coalesce(class::VARCHAR, '') || '/' || coalesce(other::VARCHAR, '') AS k, value FROM reports)
SELECT level, any_value(value::BIGINT) FILTER (k = 'all//n//') AS n, any_value(round(value, 6)) FILTER (k = 'all//macro_f1//') AS macro_f1, any_value(round(value, 6)) FILTER (k = 'all//average_precision/2/') AS ap_2,
  any_value(round(value, 6)) FILTER (k = 'source/s3/accuracy//') AS s3_accuracy, any_value(value::BIGINT) FILTER (k = 'source/s3/confusion/1/4') AS s3_cell, any_value(round(value, 6)) FILTER (k = 'band/500-4999/ece//') AS band_ece,
  count(DISTINCT split_part(k, '/', 2)) FILTER (k LIKE 'source/%') AS sources FROM v GROUP BY level""")  # fmt: skip
def _(t):
    """One nested document per level, and what is found in it."""
    found = evaluate.metric_documents(evaluate.slice_reports(evaluate.all_levels(predictions(t), K), K))
    at = lambda path, kind="double": F.get_json_object("document", path).cast(kind)
    return found.select(
        "level", at("$.n", "double").cast("long").alias("n"), r6(at("$.macro_f1")).alias("macro_f1"), r6(at("$.classes.2.average_precision")).alias("ap_2"), r6(at("$.by_source.s3.accuracy")).alias("s3_accuracy"),
        at("$.by_source.s3.confusion_matrix[1][4]", "long").alias("s3_cell"), r6(at("$.by_band['500-4999'].ece")).alias("band_ece"), F.size(F.json_object_keys(F.get_json_object("document", "$.by_source"))).cast("long").alias("sources"),
    )


@query("g4_level_expansion", f"""WITH {PRED}, {level_pred('genome_id')} SELECT 'chunk' AS level, count(*) AS n, sum(valid_length)::BIGINT AS bp FROM pred UNION ALL SELECT 'contig', count(DISTINCT (genome_id, contig_id)), sum(valid_length)::BIGINT FROM pred UNION ALL SELECT 'genome', count(*), sum(valid_length)::BIGINT FROM lv""")
def _(t):
    return evaluate.all_levels(predictions(t), K).groupBy("level").agg(F.count("*").alias("n"), F.sum("valid_length").cast("long").alias("bp"))


@query("a30_open_set", f"""WITH {PRED}, x AS (SELECT *, CASE WHEN truth = 4 THEN -1 ELSE truth END AS t, confidence >= 0.4 AS a FROM sc)
SELECT count_if(t >= 0) AS known_n, count_if(t < 0) AS unseen_n, round(avg(a::INT), 6) AS prediction_coverage, round(avg((NOT a)::INT) FILTER (t < 0), 6) AS unknown_rejection_rate, round(avg((predicted = t AND a)::INT) FILTER (t >= 0), 6) AS known_unconditional_accuracy FROM x""")  # fmt: skip
def _(t):
    rows = predictions(t).withColumn("truth", F.when(F.col("truth") == 4, -1).otherwise(F.col("truth")))
    out = taxonomy.open_set_report(rows, 0.4)
    return out.select("known_n", "unseen_n", *[r6(c).alias(c) for c in ("prediction_coverage", "unknown_rejection_rate", "known_unconditional_accuracy")])


GRID = f"""{PRED}, gl AS (SELECT genome_id, arg_max(truth, chunk_id) AS truth, list_value({", ".join(f"sum(logits[{c + 1}] * valid_length) / sum(valid_length)" for c in range(K))}) AS lg FROM emb GROUP BY 1),
tt AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0])::DOUBLE AS temperature), gd AS (SELECT temperature, avg(ln(list_sum(list_transform(lg, lambda x: exp(x / temperature)))) - lg[truth + 1] / temperature) AS nll FROM gl, tt GROUP BY 1)"""


@query("a31_temperature", f"WITH {GRID} SELECT temperature, round(nll, 6) AS nll FROM gd")
def _(t):
    return calibrate.temperature_grid(calibrate.genome_logits(predictions(t), K)).withColumn("nll", r6("nll"))


@query("o7_best_temperature", f"WITH {GRID} SELECT arg_min(temperature, (nll, temperature)) AS temperature FROM gd")
def _(t):
    return calibrate.best_temperature(calibrate.temperature_grid(calibrate.genome_logits(predictions(t), K))).select("temperature")


@query("a32_mean_nll", f"WITH {PRED} SELECT source, round(avg(-ln(greatest(p[truth + 1], 1e-12))), 6) AS nll FROM pred GROUP BY 1")
def _(t):
    return calibrate.mean_nll(predictions(t), by=("source",)).withColumn("nll", r6("nll"))


@query("a33_nested_means", f"WITH {PRED}, s AS (SELECT source, avg((predicted = truth)::INT) AS a FROM sc GROUP BY 1), g AS (SELECT split_group, avg((predicted = truth)::INT) AS a FROM sc GROUP BY 1) SELECT round((SELECT avg(a) FROM s), 6) AS by_source, round((SELECT avg(a) FROM g), 6) AS by_group")
def _(t):
    rows = evaluate.scored(predictions(t)).withColumn("right", (F.col("predicted") == F.col("truth")).cast("double"))
    mean = lambda k, n: rows.groupBy(k).agg(F.avg("right").alias("a")).agg(r6(F.avg("a")).alias(n))
    return mean("source", "by_source").crossJoin(mean("split_group", "by_group"))


@query("a34_keys_crossing", f"""WITH {PIECES} SELECT 'hash' AS key_kind, count(*) FILTER (n > 1) AS crossing FROM (SELECT hash, count(DISTINCT split) AS n FROM pc GROUP BY 1)
UNION ALL SELECT 'genome_id', count(*) FILTER (n > 1) FROM (SELECT genome_id, count(DISTINCT split) AS n FROM pc GROUP BY 1)""")  # fmt: skip
def _(t):
    return audit.keys_crossing(pieces(t), ["hash", "genome_id"])


@query("a35_crosstab", f"""WITH {RECORDS}, n AS (SELECT split, lang, count(DISTINCT genome_id) AS n FROM rec GROUP BY 1, 2)
SELECT s.split, l.lang, coalesce(n.n, 0) AS genomes FROM (SELECT DISTINCT split FROM rec) s CROSS JOIN (SELECT DISTINCT lang FROM rec) l LEFT JOIN n ON n.split = s.split AND n.lang IS NOT DISTINCT FROM l.lang""")  # fmt: skip
def _(t):
    return audit.crosstab_rows(records(t), "split", "lang", "genome_id")


@query("a36_flag_accuracy", f"WITH {PRED} SELECT valid_length >= 3000 AS flag, count(*) AS n, sum(valid_length)::BIGINT AS bp, round(avg((predicted = truth)::INT), 6) AS accuracy FROM sc GROUP BY 1")
def _(t):
    rows = evaluate.scored(predictions(t)).withColumn("flag", F.col("valid_length") >= 3000)
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.sum("valid_length").cast("long").alias("bp"), r6(F.avg((F.col("predicted") == F.col("truth")).cast("double"))).alias("accuracy"))


@query("a37_key_collisions", f"""WITH {RECORDS}, g AS (SELECT source, sha256(text) AS h, count(*) AS n FROM rec GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS records, count(*) AS unique_keys, count_if(n > 1) AS collision_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS collision_records, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS merged_excess FROM g GROUP BY 1""")  # fmt: skip
def _(t):
    rows = records(t).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return audit.collisions(rows, "source", ["h"])


@query("a38_collision_causes", f"WITH {RECORDS} SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS distinct_source, count(DISTINCT lang) AS distinct_lang FROM rec GROUP BY 1 HAVING count(*) > 1")
def _(t):
    rows = records(t).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return audit.collision_causes(rows, ["h"], ["source", "lang"])


@query("a39_length_histogram", f"""WITH {PIECES}, x AS (SELECT pc.source, pc.split, valid_length, length(rec.text) AS total FROM pc JOIN rec USING (record_id)), k AS (SELECT *,
CASE WHEN valid_length = {SIZE} THEN 'full_5kb' WHEN total <= {SIZE} THEN 'short_contig' WHEN total % {SIZE} > 0 AND total % {SIZE} < {TAIL} THEN 'rebalanced' ELSE 'tail' END AS kind FROM x)
SELECT source, split, kind, count(*) AS n, sum(valid_length)::BIGINT AS bases FROM k GROUP BY GROUPING SETS ((source, split, kind), (source), (split))""")  # fmt: skip
def _(t):
    rows = records(t).withColumn("total", F.length("text"))
    cut = chunks.explode_chunks(rows, SIZE, TAIL, sequence="text", keep=("source", "split", "total")).withColumn("valid_length", F.col("end") - F.col("start"))
    kinds = cut.withColumn("kind", S.piece_kind(F.col("valid_length"), F.col("start"), F.col("total"), SIZE, TAIL))
    return kinds.groupingSets([["source", "split", "kind"], ["source"], ["split"]], "source", "split", "kind").agg(F.count("*").alias("n"), F.sum("valid_length").cast("long").alias("bases"))


@query("a40_inventory_rollup", f"WITH {RECORDS} SELECT lang, split, count(*) AS records, count(DISTINCT genome_id) AS genomes FROM rec GROUP BY ROLLUP (lang, split)")
def _(t):
    return records(t).rollup("lang", "split").agg(F.count("*").alias("records"), F.countDistinct("genome_id").alias("genomes"))


@query("a42_before_after", f"""WITH {RECORDS}, x AS (SELECT 'before' AS stage, * FROM rec UNION ALL SELECT 'after', * FROM rec WHERE toxic IS DISTINCT FROM 1) SELECT stage, source, count(*) AS records, count(DISTINCT genome_id) AS genomes, sum(length(text))::BIGINT AS bases FROM x GROUP BY 1, 2""")
def _(t):
    rows = records(t)
    both = rows.withColumn("stage", F.lit("before")).unionByName(rows.filter("toxic IS DISTINCT FROM 1").withColumn("stage", F.lit("after")))
    return both.groupBy("stage", "source").agg(F.count("*").alias("records"), F.countDistinct("genome_id").alias("genomes"), F.sum(F.length("text")).cast("long").alias("bases"))


@query("a43_top_concentration", f"WITH {ORDERS} SELECT genome_id, count(*) AS n FROM ch WHERE valid_length < 20 GROUP BY 1 ORDER BY n DESC, genome_id LIMIT 10")
def _(t):
    return chunked_orders(t).filter("valid_length < 20").groupBy("genome_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genome_id").limit(10)


@query("a44_excluded_genomes", f"""WITH {RECORDS}, x AS (SELECT genome_id, CASE WHEN source IN ('src1', 'src2') THEN 'a' || doc_id % 2 WHEN toxic = 1 THEN 'toxic' END AS r FROM rec)
SELECT genome_id, count(*) AS records FROM x GROUP BY 1 HAVING count_if(r IS NULL) = 0""")  # fmt: skip
def _(t):
    reason = F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("a"), F.col("doc_id") % 2)).when(F.col("toxic") == 1, "toxic")
    return audit.excluded_genomes(records(t).withColumn("r", reason), "genome_id", "r").select("genome_id", F.col("records").cast("long").alias("records"))


@query("a45_loss_by_source", f"WITH {WEIGHTED}, s2 AS (SELECT source, sum(loss_weight * valid_length) AS l, sum(loss_weight) AS w FROM lw GROUP BY 1) SELECT source, round(l / sum(l) OVER (), 6) AS loss_share, round(w / sum(w) OVER (), 6) AS mass_share FROM s2")
def _(t):
    return weights.loss_by_source(_weighted(t), "valid_length").select("source", r6("loss_share").alias("loss_share"), r6("mass_share").alias("mass_share"))


# ---- windows, folds, order ---------------------------------------------------------------------------------------


@query("w1_w2_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def _(t):
    first = manifest.first_by(t.events, ["user_id"], ["ts", "event_id"], "event_type", "first_type")
    return first.join(manifest.last_by(t.events, ["user_id"], ["ts", "event_id"], "event_type", "last_type"), "user_id")


def _stats(t):
    """Nations as strata, customers as groups."""
    size = t.orders.groupBy(F.col("o_custkey").alias("component")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("bases"), F.count("*").alias("genomes"))
    return size.join(t.customer.select(F.col("c_custkey").alias("component"), F.col("c_nationkey").alias("main_source"), F.lit(0).alias("main_label")), "component")


GREEDY = """WITH RECURSIVE st AS (SELECT o_custkey AS g, c_nationkey AS s, sum(floor(o_totalprice))::BIGINT AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
tot AS (SELECT s, sum(b)::DOUBLE AS tb, sum(n)::DOUBLE AS tn FROM st GROUP BY s), rk AS (SELECT st.*, tb, tn, row_number() OVER (PARTITION BY st.s ORDER BY b DESC, sha256('0|' || g || '|order')) AS k FROM st JOIN tot USING (s)),
fold AS (SELECT s, 0::BIGINT AS k, NULL::BIGINT AS g, NULL::VARCHAR AS split, [0.0, 0.0, 0.0]::DOUBLE[] AS ub, [0.0, 0.0, 0.0]::DOUBLE[] AS un FROM tot
UNION ALL SELECT s, k, g, names[pick], list_transform(ub, lambda x, i: CASE WHEN i = pick THEN x + b ELSE x END), list_transform(un, lambda x, i: CASE WHEN i = pick THEN x + n ELSE x END) FROM (
 SELECT *, CASE WHEN (s1, h1, 'train') <= (s2, h2, 'validation') AND (s1, h1, 'train') <= (s3, h3, 'inference') THEN 1 WHEN (s2, h2, 'validation') <= (s3, h3, 'inference') THEN 2 ELSE 3 END AS pick, ['train', 'validation', 'inference'] AS names FROM (
 SELECT rk.s, rk.k, rk.g, rk.b, rk.n, ub, un,
  (ub[1] + b) / greatest(tb * 0.8::DOUBLE, 1) + (un[1] + n) / greatest(tn * 0.8::DOUBLE, 1) AS s1, sha256('0|' || rk.g || '|train') AS h1,
  (ub[2] + b) / greatest(tb * 0.1::DOUBLE, 1) + (un[2] + n) / greatest(tn * 0.1::DOUBLE, 1) AS s2, sha256('0|' || rk.g || '|validation') AS h2,
  (ub[3] + b) / greatest(tb * 0.1::DOUBLE, 1) + (un[3] + n) / greatest(tn * 0.1::DOUBLE, 1) AS s3, sha256('0|' || rk.g || '|inference') AS h3
 FROM fold JOIN rk ON rk.s = fold.s AND rk.k = fold.k + 1)))
SELECT g AS component, split FROM fold WHERE k > 0"""


@query("w4_greedy_split", GREEDY)
def _(t):
    return splits.allocate(_stats(t))


@query("w7_history_repair", """WITH hs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events),
e AS (SELECT run, pos, value, pos - CASE WHEN pos > 17 THEN 5 ELSE 0 END AS e FROM hs),
l AS (SELECT run, list([{'e': e, 'pos': pos, 'value': value}] ORDER BY pos) AS l FROM e GROUP BY run),
f AS (SELECT run, list_reduce(list_prepend(l[1], l), lambda a, x: list_concat(list_filter(a, lambda y: y.e <= x[1].e), CASE WHEN list_contains(list_transform(a, lambda y: y.e), x[1].e) THEN [] ELSE x END)) AS kept FROM l)
SELECT run, k.pos::INT AS pos, k.e / 10 AS epoch, k.value AS value FROM (SELECT run, unnest(kept) AS k FROM f) WHERE k.e <= 21""")  # fmt: skip
def _(t):
    """Epochs that go back where a run was resumed: from its 18th event on, a user's history starts again 5 earlier."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select(F.col("user_id").alias("run"), at.alias("pos"), "value")
    epoch = (F.col("pos") - F.when(F.col("pos") > 17, 5).otherwise(0)) / 10
    return calibrate.repair_history(rows.select("run", "pos", epoch.alias("epoch"), "value"), 2.1)


HISTORY = "hs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events)"


def _history(t):
    from pyspark.sql import Window

    return t.events.select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), "value")


@query("w8_first_of_epoch", "SELECT epoch, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT *, floor(value)::BIGINT AS epoch FROM events) GROUP BY 1")
def _(t):
    rows = t.events.select(F.floor("value").cast("long").alias("epoch"), "event_id", F.struct("ts", "event_id").alias("pos"))
    return calibrate.first_of_epoch(rows).select("epoch", "event_id")


@query("w10_best_so_far", f"WITH {HISTORY}, b AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hs) SELECT run, pos::BIGINT AS pos, greatest(value, m) AS best, m IS NULL OR value > m AS improved FROM b")
def _(t):
    return calibrate.best_so_far(_history(t), "value", by=("run",)).select("run", F.col("pos").cast("long").alias("pos"), "best", "improved")


@query("w10_best_checkpoint", f"WITH {HISTORY} SELECT run, arg_max(pos, (value, -pos))::BIGINT AS pos, max(value) AS value FROM hs GROUP BY 1")
def _(t):
    return calibrate.best_checkpoint(_history(t), "value", by=("run",)).select("run", F.col("pos").cast("long").alias("pos"), "value")


@query("w11_early_stop", f"""WITH {HISTORY}, b AS (SELECT *, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM hs),
l AS (SELECT *, pos - max(pos) FILTER (better) OVER (PARTITION BY run ORDER BY pos) AS waited FROM b) SELECT run, min(pos) FILTER (waited >= 4)::BIGINT AS stop FROM l GROUP BY 1""")  # fmt: skip
def _(t):
    return calibrate.early_stop(_history(t), "value", patience=2, interval=0.5)


@query("o3_group_order", "SELECT o_custkey AS component, row_number() OVER (ORDER BY sum(floor(o_totalprice)) DESC, sha256('0|' || o_custkey || '|order')) AS place FROM orders GROUP BY 1")
def _(t):
    order = [F.desc("bases"), S.tie_hash(F.lit(0), F.col("component"), F.lit("order"))]
    return ranks(_stats(t), order, "place").select("component", "place")


@query("u1_union_sources", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1")
def _(t):
    parts = [getattr(t, n).select(F.lit(n).alias("origin")) for n in ("documents", "pages", "benchmark")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("n"))


@query("u3_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("u6_classes_present", "SELECT count(DISTINCT label) = 10 AS complete FROM embeddings")
def _(t):
    want = F.array(*[F.lit(i) for i in range(10)])
    return t.embeddings.agg((F.size(F.array_except(want, F.collect_set("label"))) == 0).alias("complete"))


# ---- graph ------------------------------------------------------------------------------------------------------

EDGES = "ed AS (SELECT o_custkey AS u, o_custkey + 1000000 + o_orderkey % 40 AS v FROM orders), sy AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed)"
LABELS = """cc(node, component) USING KEY (node) AS (SELECT node, node FROM vertices
UNION (SELECT sy.v, min(cc.component) FROM cc JOIN sy ON sy.u = cc.node JOIN recurring.cc AS old ON old.node = sy.v WHERE cc.component < old.component GROUP BY sy.v))"""


def _edges(t):
    return t.orders.select(F.col("o_custkey").alias("u"), (F.col("o_custkey") + 1000000 + F.col("o_orderkey") % 40).alias("v"))


@query("h1_components", f"WITH RECURSIVE {EDGES}, vertices AS (SELECT DISTINCT u AS node FROM sy), {LABELS} SELECT node, component FROM cc")
def _(t):
    return connected_components(_edges(t))


@query("h2_components_with_vertices", f"WITH RECURSIVE {EDGES}, vertices AS (SELECT u AS node FROM sy UNION SELECT c_custkey FROM customer), {LABELS} SELECT component, count(*) AS n FROM cc GROUP BY 1")
def _(t):
    return connected_components(_edges(t), vertices=t.customer.select(F.col("c_custkey").alias("node"))).groupBy("component").agg(F.count("*").alias("n"))


@query("h3_first_reason", "SELECT least(l_suppkey, l_partkey) AS left_group, greatest(l_suppkey, l_partkey) AS right_group, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS reason FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("left_group"), F.col("l_partkey").alias("right_group"), F.col("l_returnflag").alias("reason"), F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return similarity.first_reason(rows)


@query("h4_cluster_edges", """WITH c AS (SELECT c_custkey AS record_id, c_name AS grp, c_nationkey AS cl, CASE WHEN c_nationkey < 20 THEN 'a' ELSE c_mktsegment END AS label FROM customer),
k AS (SELECT cl, arg_min(grp, record_id) AS head, count(DISTINCT label) AS labels FROM c GROUP BY 1)
SELECT DISTINCT least(grp, head) AS left_group, greatest(grp, head) AS right_group FROM c JOIN k USING (cl) WHERE labels = 1 AND grp <> head""")  # fmt: skip
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("record_id"), F.col("c_name").alias("grp"), F.when(F.col("c_nationkey") < 20, "a").otherwise(F.col("c_mktsegment")).alias("label"), F.col("c_nationkey").alias("cl"))
    heads = rows.groupBy("cl").agg(F.min("id").alias("head"))
    pairs = rows.join(heads, "cl").filter("id <> head").select(F.col("head").alias("left"), F.col("id").alias("right"))
    return similarity.cluster_edges(pairs, rows.drop("cl"))[0].select("left_group", "right_group")


def thrice(s: Column) -> Column:
    """A digest, turned, and again."""
    return S.normalize_dna(F.concat(s, F.translate(F.reverse(s), "A", "C"), s))


def mutant(sequence: Column) -> Column:
    """A copy with one letter changed on the other strand."""
    return S.reverse_complement(F.concat(F.substring(sequence, 1, 40), F.lit("A"), F.substring(sequence, 42, 200)))


def mutants(rows):
    """(id, sequence): every part's digest, repeated (even ids), and a copy with one letter changed on the other strand."""
    base = rows.select((F.col("p_partkey") * 2).alias("id"), thrice(F.col("s")).alias("sequence"))
    return base.unionByName(base.select((F.col("id") + 1).alias("id"), mutant(F.col("sequence")).alias("sequence")))


KEYED = """dna AS (SELECT p_partkey, translate(md5(p_partkey || p_name), '0123456789abcdef', 'acgtACGTACGTuNRY') AS s FROM part),
n AS (SELECT p_partkey * 2 AS id, s || translate(reverse(s), 'A', 'C') || s AS s FROM dna)"""
FAR = 1_000_000_000_000


@query("j22_near_duplicates", f"""WITH RECURSIVE {KEYED}, e AS (SELECT id, {NORMAL} AS q FROM n), o AS (SELECT id + 1 AS id, substr(q, 1, 40) || 'A' || substr(q, 42) AS x FROM e),
al AS (SELECT id, q FROM e UNION ALL SELECT id, {RC} FROM o UNION ALL SELECT id + {FAR}, {RC.replace('x', 'q')} FROM e),
cn AS (SELECT id, least(q, {RC.replace('x', 'q')}) AS s FROM al), ds AS (SELECT s, min(id) AS one, count(*) AS copies FROM cn GROUP BY s),
w AS (SELECT one, substr(s, (i + 1)::INT, 15) AS x FROM (SELECT one, s, unnest(range(length(s) - 14)) AS i FROM ds)), km AS (SELECT DISTINCT one, least(x, {RC}) AS kmer FROM w),
cand AS (SELECT DISTINCT a.one AS l, b.one AS r FROM km a JOIN km b ON a.kmer = b.kmer AND a.one < b.one),
d AS (SELECT l, r, least(levenshtein(x.s, y.s), levenshtein(x.s, {RC.replace('x', 'y.s')})) / greatest(length(x.s), length(y.s)) AS away FROM cand JOIN ds x ON x.one = l JOIN ds y ON y.one = r),
ok AS (SELECT * FROM d WHERE away <= 0.05), sy AS (SELECT l AS u, r AS v FROM ok UNION SELECT r, l FROM ok), vertices AS (SELECT one AS node FROM ds),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM vertices
UNION (SELECT sy.v, min(cc.component) FROM cc JOIN sy ON sy.u = cc.node JOIN recurring.cc AS old ON old.node = sy.v WHERE cc.component < old.component GROUP BY sy.v)),
up AS (SELECT l, max(r) AS r, arg_max(1 - away, r) AS identity FROM ok GROUP BY l), deg AS (SELECT u, count(*) AS links FROM sy GROUP BY u)
SELECT cn.id, component AS class, coalesce(up.r, one) AS centre, round(coalesce(identity, 1), 6) AS identity, coalesce(links, 0) AS links, copies,
  CASE WHEN levenshtein(m.q, c.q) <= levenshtein({RC.replace('x', 'm.q')}, c.q) THEN '+' ELSE '-' END AS strand
FROM cn JOIN ds USING (s) JOIN cc ON node = one LEFT JOIN up ON up.l = one LEFT JOIN deg ON deg.u = one JOIN al m ON m.id = cn.id JOIN al c ON c.id = coalesce(up.r, one)""")  # fmt: skip
def _(t):
    """Classes of sequences with planted mutations and of copies on the other strand, over the whole table."""
    base = mutants(dna(t, F.concat("p_partkey", "p_name")))
    copies = base.filter("id % 2 = 0").select((F.col("id") + FAR).alias("id"), S.reverse_complement(F.col("sequence")).alias("sequence"))
    found = similarity.near_clusters(base.unionByName(copies), k=15)
    return found.select("id", "class", "centre", r6("identity").alias("identity"), "links", "copies", "strand")


@query("j21_genome_ani", f"""WITH dna AS (SELECT p_partkey, translate(md5(p_partkey || p_name), '0123456789abcdef', 'acgtACGTACGTuNRY') AS s FROM part),
n AS (SELECT p_partkey * 2 AS id, s || translate(reverse(s), 'A', 'C') || s AS s FROM dna), e AS (SELECT id, {NORMAL} AS q FROM n),
o AS (SELECT id + 1 AS id, substr(q, 1, 40) || 'A' || substr(q, 42) AS x FROM e), al AS (SELECT id, q FROM e UNION ALL SELECT id, {RC} FROM o),
w AS (SELECT id, i // 32 AS w, substr(q, (i + 1)::INT, 15) AS x FROM (SELECT id, q, unnest(range(length(q) - 14)) AS i FROM al)), km AS (SELECT DISTINCT id, w, least(x, {RC}) AS kmer FROM w),
g AS (SELECT id, count(DISTINCT kmer) AS k, count(DISTINCT w) AS w FROM km GROUP BY 1),
sh AS (SELECT a.id AS l, b.id AS r, count(DISTINCT a.kmer) AS common, count(DISTINCT a.w) AS hl, count(DISTINCT b.w) AS hr FROM km a JOIN km b ON a.kmer = b.kmer AND a.id < b.id GROUP BY 1, 2),
sc AS (SELECT l, r, pow(common / least(a.k, b.k), 1 / 15) AS ani, hl / a.w AS af FROM sh JOIN g a ON a.id = l JOIN g b ON b.id = r)
SELECT l AS left_genome, r AS right_genome, round(ani, 6) AS ani, round(af, 6) AS af_shorter FROM sc WHERE ani >= 0.95 AND af >= 0.85""")  # fmt: skip
def _(t):
    """Such sequences as genomes, in windows of 32 k-mer starts; the key is in the digest, as few names are distinct."""
    rows = similarity.spread(dna(t, F.concat("p_partkey", "p_name")), "p_partkey").select((F.col("p_partkey") * 2).alias("id"), thrice(F.col("s")).alias("sequence"))
    both = F.array(F.struct("id", "sequence"), F.struct((F.col("id") + 1).alias("id"), mutant(F.col("sequence")).alias("sequence")))
    found = similarity.genome_identity(rows.select(F.inline(both)).withColumnRenamed("id", "genome"), k=15, step=32)
    return found.select("left_genome", "right_genome", r6("ani").alias("ani"), r6("af_shorter").alias("af_shorter"))


# ---- the rest of the inventory -----------------------------------------------------------------------------------


@query("f16_relative_path", "SELECT page_id, CASE WHEN starts_with(url, 'http:/') THEN substr(url, 7) ELSE url END AS path FROM pages")
def _(t):
    return t.pages.select("page_id", S.relative_path(F.col("url"), "http:").alias("path"))


@query("f20_number_formats", "SELECT c_custkey, printf('%.8f', c_acctbal / 7) AS eight, printf('%.6f', c_acctbal / 7) AS six FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.format_string("%.8f", F.col("c_acctbal") / 7).alias("eight"), F.format_string("%.6f", F.col("c_acctbal") / 7).alias("six"))


@query("p6_p8_filters", f"WITH {PIECES} SELECT record_id, start FROM pc WHERE valid_length >= {TAIL} AND split IN ('train', 'validation') AND quality IS NOT NULL")
def _(t):
    return pieces(t).filter((F.col("valid_length") >= TAIL) & F.col("split").isin("train", "validation") & F.col("quality").isNotNull()).select("record_id", "start")


@query("p15_error_rows", f"WITH {PRED} SELECT chunk_id, truth, predicted FROM sc WHERE truth <> predicted")
def _(t):
    return evaluate.scored(predictions(t)).filter("truth <> predicted").select("chunk_id", "truth", "predicted")


@query("j5_reasons_per_record", """WITH r AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT o_orderkey, coalesce(reasons, '') AS reasons FROM orders LEFT JOIN r ON o_orderkey = k""")
def _(t):
    reasons = t.lineitem.filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("reasons"))
    return t.orders.join(reasons, "o_orderkey", "left").select("o_orderkey", F.coalesce("reasons", F.lit("")).alias("reasons"))


@query("w3_cluster_rows", "SELECT l_suppkey AS representative, count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("representative")).agg(F.countDistinct("l_partkey").alias("members"))


@query("w9_chunk_numbers", f"WITH {PIECES} SELECT record_id, start, row_number() OVER (PARTITION BY record_id ORDER BY start) - 1 AS number FROM pc")
def _(t):
    rows = records(t).filter(F.length("text") > 0)
    cut = rows.select("record_id", F.posexplode(S.chunk_ranges(F.length("text"), SIZE, TAIL)).alias("number", "r"))
    return cut.select("record_id", F.col("r.start").alias("start"), F.col("number").cast("long").alias("number"))


@query("o2_report_order", "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment, c_nationkey, c_custkey")
def _(t):
    return t.customer.select("c_mktsegment", "c_nationkey", "c_custkey").orderBy("c_mktsegment", "c_nationkey", "c_custkey")


@query("o6_group_assignments", f"WITH {ORDERS} SELECT 'G' || source AS split_group, split, sum(valid_length)::BIGINT AS bases, count(DISTINCT genome_id) AS genomes, count(*) AS contigs, string_agg(DISTINCT labels, ',' ORDER BY labels) AS labels FROM ch GROUP BY 1, 2")
def _(t):
    rows = chunked_orders(t).select(F.concat(F.lit("G"), "source").alias("split_group"), "split", F.col("valid_length").alias("sequence_length"), "genome_id", F.col("source").cast("string").alias("source"), F.col("labels").alias("main_label"))
    return splits.group_assignments(rows).drop("sources")


@query("u4_distinct_pairs", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def _(t):
    return t.lineitem.select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).distinct()


@query("x2_scored_chunks", f"WITH {DNA}, n AS (SELECT p_partkey, {NORMAL} AS x FROM dna), v AS (SELECT p_partkey, [exp((length(x) - length(replace(x, c, ''))) / length(x)) FOR c IN ['A', 'C', 'G', 'T']] AS e FROM n) SELECT p_partkey, round(e[1] / list_sum(e), 6) AS p0, (list_position(e, list_max(e)) - 1)::INT AS predicted FROM v")
def _(t):
    from ..operators import scorer

    rows = dna(t).select("p_partkey", S.normalize_dna(F.col("s")).alias("sequence"))
    out = scorer.score_batches(rows, scorer.composition_scorer, 4, keep=("p_partkey",), longest=5000)
    return out.select("p_partkey", r6(F.get("p", F.lit(0))).alias("p0"), N.argmax(F.col("p")).alias("predicted"))


@query("x7_lineage_gate", "SELECT doc_id::VARCHAR AS artifact, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def _(t):
    then = t.documents.select(F.col("doc_id").cast("string").alias("artifact"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    now = then.filter("doc_id % 5 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return qc.verify_lineage(now.drop("doc_id"), then.drop("doc_id"))


@query("s16_s17_fan_out", f"WITH {PIECES} SELECT task, split, count(*) AS n FROM (SELECT 'main' AS task, split FROM pc UNION ALL SELECT 'sub', split FROM pc WHERE quality IS NOT NULL) GROUP BY 1, 2")
def _(t):
    """One write partitioned by split, read back; the sub task is a filter of it."""
    table = save(pieces(t).select("record_id", "start", "quality", "split"), "chunks", "split")
    main, sub = table.withColumn("task", F.lit("main")), table.filter("quality IS NOT NULL").withColumn("task", F.lit("sub"))
    return main.unionByName(sub).groupBy("task", "split").agg(F.count("*").alias("n"))


# ---- sources, sinks and the steps that use them --------------------------------------------------------------------

READ = "translate(md5(p_partkey || p_name), '0123456789abcdef', 'acgtACGTACGTuNRY')"


def _reads(t) -> DataFrame:
    """Every part as a FASTA record of two lines."""
    name = F.concat(F.lit(">ARC__g"), "p_partkey", F.lit("|c"), "p_partkey", F.lit(" text"))
    return dna(t, F.concat("p_partkey", "p_name")).select("p_partkey", F.concat(name, F.lit("\n"), F.substring("s", 1, 20), F.lit("\n"), F.expr("substring(s, 21)")).alias("value"))


def _fasta(t, folder: str, **options: str) -> DataFrame:
    fasta.register(t.spark)
    return t.spark.read.format("fasta").options(suffixes=".txt,.txt.gz", **options).load(folder)


@query("s1_s3_s4_fasta_scan", f"SELECT 'ARC__g' || p_partkey || '|c' || p_partkey || ' text' AS header, {READ} AS sequence, 2 AS copies FROM part")
def _(t):
    """The same records in plain and in gzip files, below one folder."""
    folder = new_folder(t.spark, "fasta")
    _reads(t).select("value").write.text(f"{folder}/plain")
    _reads(t).select("value").write.option("compression", "gzip").text(f"{folder}/zipped")
    return _fasta(t, folder).groupBy("header", "sequence").agg(F.count("*").cast("int").alias("copies"))


@query("s2_p1_header_scan", "SELECT 'ARC__g' || p_partkey || '|c' || p_partkey || ' text' AS header, true AS bare FROM part WHERE p_partkey::VARCHAR LIKE '1%'")
def _(t):
    folder = new_folder(t.spark, "fasta")
    _reads(t).select("value").write.text(folder)
    return _fasta(t, folder, headersOnly="true", prefix="ARC__g1").select("header", F.col("sequence").isNull().alias("bare"))


@query("s1_split_fasta_scan", f"SELECT 'ARC__g' || p_partkey || '|c' || p_partkey || ' text' AS header, {READ} AS sequence, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def _(t):
    """All records in one file, read in ranges of a few kilobytes by many tasks; places are those in the file."""
    folder = new_folder(t.spark, "fasta")
    _reads(t).orderBy("p_partkey").coalesce(1).select("value").write.text(folder)
    return fasta.read_fasta(t.spark, folder, split_bytes=16 << 10, suffixes=".txt").select("header", "sequence", "pos")


@query("s2_p1_pushed_header_scan", "SELECT 'ARC__g' || p_partkey || '|c' || p_partkey || ' text' AS header, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part QUALIFY header LIKE 'ARC\\_\\_g2%' ESCAPE '\\'")
def _(t):
    """A prefix that reaches the scan as a filter, without sequences; places count the records that it leaves out."""
    folder = new_folder(t.spark, "fasta")
    _reads(t).orderBy("p_partkey").coalesce(1).select("value").write.text(folder)
    return fasta.read_fasta(t.spark, folder, sequence=False, split_bytes=16 << 10, suffixes=".txt").filter(F.col("header").startswith("ARC__g2")).select("header", "pos")


@query("s1_native_fasta_scan", f"SELECT 'ARC__g' || p_partkey || '|c' || p_partkey || ' text' AS header, {READ} AS sequence FROM part")
def _(t):
    folder = new_folder(t.spark, "fasta")
    _reads(t).select("value").write.text(folder)
    return fasta.read_fasta_native(t.spark, folder).select("header", "sequence")


@query("s5_s7_s8_keyed_tsv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, '' AS note FROM customer")
def _(t):
    """A keyed table, with an optional one that is missing."""
    folder, columns = new_folder(t.spark, "tsv"), ["c_custkey", "c_name", "c_mktsegment"]
    t.customer.select(*columns).write.csv(folder, sep="\t", header=True)
    notes = tables.read_tsv(t.spark, f"{folder}/none.tsv", ["c_custkey", "note"], optional=True)
    return tables.keyed(tables.read_tsv(t.spark, folder, columns), "c_custkey").join(notes, "c_custkey", "left").na.fill("")


@query("s6_label_table", "SELECT o_custkey::VARCHAR AS id, 'root|' || max(o_orderkey) AS lineage FROM orders GROUP BY 1")
def _(t):
    """Lines in the order of the orders: a customer's last one wins."""
    folder = new_folder(t.spark, "labels")
    t.orders.orderBy("o_orderkey").select(F.concat("o_custkey", F.lit("\troot|"), "o_orderkey")).write.text(folder)
    return tables.read_labels(t.spark, folder)


@query("s9_chunk_csv", f"SELECT p_partkey, {READ} AS sequence, p_size AS labels FROM part")
def _(t):
    folder = new_folder(t.spark, "csv")
    rows = dna(t, F.concat("p_partkey", "p_name")).join(t.part.select("p_partkey", F.col("p_size").alias("labels")), "p_partkey")
    rows.select("p_partkey", F.col("s").alias("sequence"), "labels").write.option("compression", "gzip").csv(folder, header=True)
    return tables.read_chunks(t.spark, folder, "p_partkey long, sequence string, labels int")


@query("s13_cluster_table", "SELECT l_suppkey::VARCHAR AS representative, count(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1")
def _(t):
    folder = new_folder(t.spark, "clusters")
    t.lineitem.select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))).write.text(folder)
    return tables.read_fields(t.spark, folder, ["representative", "member"]).groupBy("representative").agg(F.countDistinct("member").alias("members"))


@query("s13_aligner_table", "SELECT o_custkey::VARCHAR AS \"left\", (o_orderkey % 100)::VARCHAR AS \"right\", o_totalprice AS ani, 0.5::DOUBLE AS af_left, 0.25::DOUBLE AS af_right FROM orders WHERE o_custkey <> o_orderkey % 100")
def _(t):
    folder = new_folder(t.spark, "hits")
    names = {"Ref_file": F.col("o_custkey"), "Query_file": F.col("o_orderkey") % 100, "ANI": F.col("o_totalprice"), "Align_fraction_ref": F.lit(0.5), "Align_fraction_query": F.lit(0.25)}
    t.orders.select(*[c.alias(n) for n, c in names.items()]).write.csv(folder, sep="\t", header=True)
    return tables.read_hits(t.spark, folder)


@query("s14_s15_current_version", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    """Two versions are published; readers get the second."""
    folder = new_folder(t.spark, "versions")
    rows = t.customer.select("c_custkey", "c_acctbal")
    tables.publish_version(rows.withColumn("c_acctbal", F.lit(0.0)), folder)
    tables.publish_version(rows, folder)
    return tables.read_version(t.spark, folder)


@query("s18_json_reports", "SELECT c_custkey, json_object('c_name', c_name, 'c_nationkey', c_nationkey)::VARCHAR AS report FROM customer")
def _(t):
    return tables.reports(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey")


@query("p2_source_subset", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def _(t):
    known = [f"src{i}" for i in range(20)]
    return manifest.select_sources(t.documents.select("doc_id", "source"), known, ["src1", "src2"])


@query("p3_empty_records", r"SELECT source, count_if(regexp_replace(coalesce(text, ''), '\s', '', 'g') = '') AS empty FROM documents GROUP BY 1")
def _(t):
    return manifest.empty_records(t.documents.withColumn("sequence", F.col("text")))


@query("p10_shared_split", f"WITH {PIECES} SELECT split, split <> 'validation' AS shared FROM pc WHERE quality IS NOT NULL GROUP BY split")
def _(t):
    """Documents with a quality label are class 1; the sub task has them all, but other labels in one split."""
    chunk = F.concat_ws(":", "record_id", "start")
    main = pieces(t).select("split", chunk.alias("chunk_id"), F.col("hash").alias("sequence"), F.col("quality").isNotNull().cast("int").alias("labels"), F.col("quality").alias("sub_labels"))
    other = F.when(F.col("split") == "validation", 1 - F.col("sub_labels")).otherwise(F.col("sub_labels"))
    return qc.shared_split(main, main.filter("labels = 1").withColumn("labels", other))


@query("p11_authoritative_taxa", f"""WITH {RECORDS} SELECT genome_id, split, taxon FROM (SELECT genome_id, CASE WHEN toxic = 1 THEN 'quarantine' ELSE split END AS split, CASE WHEN quality = 0 THEN 'Unclassified x' WHEN quality = 1 THEN 'mirus' ELSE source END AS taxon FROM rec WHERE lang IN ('en', 'de'))
WHERE split <> 'quarantine' AND lower(taxon) <> 'mirus' AND taxon NOT LIKE 'Unclass%'""")  # fmt: skip
def _(t):
    origin = F.when(F.col("lang") == "en", "gv_labels").when(F.col("lang") == "de", "snapshot_metadata").otherwise("provisional")
    taxon = F.when(F.col("quality") == 0, "Unclassified x").when(F.col("quality") == 1, " mirus ").otherwise(F.col("source"))
    split = F.when(F.col("toxic") == 1, "quarantine").otherwise(F.col("split"))
    rows = records(t).withColumns({"split": split, "taxonomy_source": origin, "taxonomy_genus": taxon, "source": F.lit("NCLDV")})
    return taxonomy.usable_rows(rows, "NCLDV", "genus")


@query("p12_unseen_taxa", f"""WITH {TAXA}, {ORDERS}, n AS (SELECT taxon FROM tx WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT genome_id) >= 45), r AS (SELECT genome_id, min(taxon) AS taxon FROM tx GROUP BY 1 HAVING count(DISTINCT taxon) = 1),
x AS (SELECT ch.split, taxon IN (SELECT taxon FROM n) AS known FROM ch JOIN r USING (genome_id))
SELECT 'dataset' AS part, split, count(*) AS n FROM x WHERE known OR split = 'inference' GROUP BY split UNION ALL SELECT 'unseen', split, count(*) FROM x WHERE NOT known GROUP BY split""")  # fmt: skip
def _(t):
    rows = _taxa(t)
    named = taxonomy.relabel(chunked_orders(t), taxonomy.reliable_genomes(rows), taxonomy.vocabulary(rows, 45))
    both = taxonomy.dataset(named).withColumn("part", F.lit("dataset")).unionByName(taxonomy.unseen(named).withColumn("part", F.lit("unseen")))
    return both.groupBy("part", "split").agg(F.count("*").alias("n"))


@query("f13_genus_fallback", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_mktsegment WHEN c_nationkey = 4 THEN '' ELSE c_name END AS genus FROM customer")
def _(t):
    nation = F.col("c_nationkey")
    genus = F.when(nation == 3, "").when(nation == 4, F.lit(None)).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", S.genus_or_selected(genus, F.when(nation != 4, F.col("c_mktsegment"))).alias("genus"))


@query("m1_build_manifest", f"""WITH r AS (SELECT 'ARC__g' || p_partkey || '|c' || p_partkey AS header, p_partkey AS k, {READ} AS s FROM part), n AS (SELECT header, k, {NORMAL} AS x FROM r),
f AS (SELECT *, (length(x) - length(replace(x, 'N', ''))) / length(x) AS fr FROM n)
SELECT 'REC_' || substr(sha256('ARC' || chr(31) || header), 1, 20) AS record_id, 'ARC__g' || k AS genome_id, 'ARC__c' || k AS contig_id, length(x) AS sequence_length, round(fr, 6) AS n_fraction, sha256(x) AS sequence_sha256,
  sha256(least(x, {RC})) AS canonical_sha256, 'GENOME::ARC__g' || k AS base_group_id, CASE WHEN fr > 0.2 THEN 'n_fraction_above_0.2' END AS exclusion_reason, 'missing' AS taxonomy_source FROM f""")  # fmt: skip
def _(t):
    """From FASTA files to the manifest; without metadata, so that taxonomy is missing."""
    folder, six = new_folder(t.spark, "fasta"), "array<string>"
    _reads(t).select(F.regexp_replace("value", " text\n", "\n").alias("value")).write.text(folder)
    found = _fasta(t, folder).withColumn("source", F.lit("ARC"))
    meta = t.spark.createDataFrame([], f"source string, filename string, snapshot {six}, votu string, uvig string, main_label int, sub_label int, record_type string")
    reasons = t.spark.createDataFrame([], f"source string, filename string, host_reasons {six}")
    none = t.spark.createDataFrame([], f"source string, raw_genome string, ranks {six}")
    rows = manifest.build_manifest(found, meta, reasons, none, none)
    return rows.select("record_id", "genome_id", "contig_id", "sequence_length", r6("n_fraction").alias("n_fraction"), "sequence_sha256", "canonical_sha256", "base_group_id", "exclusion_reason", "taxonomy_source")


# ---- settings, statistics and whole steps --------------------------------------------------------------------------

EPSILON = Settings().label_smoothing


@query("f32_smoothing_floor", f"""WITH {PRED}, x AS (SELECT source, (1 - {EPSILON}::DOUBLE) * -ln(least(greatest(p[truth + 1], 1e-12), 1)) + {EPSILON}::DOUBLE / {K} * list_sum(list_transform(p, lambda v: -ln(least(greatest(v, 1e-12), 1)))) AS ce FROM pred),
h AS (SELECT 1 - {EPSILON}::DOUBLE + {EPSILON}::DOUBLE / {K} AS hit, {EPSILON}::DOUBLE / {K} AS miss)
SELECT source, round(avg(ce) - any_value(-(hit * ln(hit) + {K - 1} * miss * ln(miss))), 6) AS above_floor, min(ce) >= any_value(-(hit * ln(hit) + {K - 1} * miss * ln(miss))) AS holds FROM x, h GROUP BY source""")  # fmt: skip
def _(t):
    """How far the smoothed loss of each source lies above what it can reach at best."""
    floor = N.smoothing_floor(EPSILON, K)
    loss = N.smoothed_cross_entropy(F.col("p"), F.col("truth"), EPSILON, K)
    return predictions(t).groupBy("source").agg(r6(F.avg(loss) - floor).alias("above_floor"), (F.min(loss) >= floor).alias("holds"))


@query("f33_file_sha256", "SELECT n_regionkey, length(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS length, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha256 FROM nation GROUP BY 1")
def _(t):
    """Checksums of text files, one for each region's nations."""
    folder = new_folder(t.spark, "names")
    t.nation.select("n_regionkey", F.col("n_name").alias("value")).repartition("n_regionkey").sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(folder)
    return tables.file_sha256(t.spark, folder).select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("n_regionkey"), "length", "sha256")


@query("f35_memory_limit", "SELECT x, regexp_full_match(x, '[1-9][0-9]*[KMGT]') AS valid, count(*) AS n FROM (SELECT (p_size - 1)::VARCHAR || substr('KMGTX', (p_partkey % 6 + 1)::INT, 1) AS x FROM part) GROUP BY ALL")
def _(t):
    x = F.concat((F.col("p_size") - 1).cast("string"), F.substring(F.lit("KMGTX"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1)))
    return t.part.select(x.alias("x")).groupBy("x", N.is_memory_limit(F.col("x")).alias("valid")).agg(F.count("*").alias("n"))


@query("x6_config_merge", "SELECT r_regionkey, 1000 + 100 * r_regionkey AS chunk_size, CASE WHEN r_regionkey % 2 = 0 THEN 90 ELSE 500 END AS minimum_tail, r_regionkey <> 3 AS accepted FROM region")
def _(t):
    """A task's settings over the common ones for each region; one of them names a setting that does not exist."""
    out = []
    for (key,) in t.region.select("r_regionkey").collect():  # a row a region
        task = {"chunk_size": 1000 + 100 * key} | ({"minimum_tail": 90} if key % 2 == 0 else {})
        try:
            merge({"chunk_size": 1, "seed": 4}, task | ({"no_such": 1} if key == 3 else {}))
            accepted = True
        except ValueError:
            accepted = False
        found = merge({"chunk_size": 1, "seed": 4}, task)
        out.append((key, found.chunk_size, found.minimum_tail, accepted))
    return t.spark.createDataFrame(out, "r_regionkey long, chunk_size long, minimum_tail int, accepted boolean")


@query("a47_run_statistics", f"WITH {PIECES} SELECT count(*) AS chunks, sum(valid_length)::BIGINT AS bases, count_if(split = 'train') AS train FROM pc")
def _(t):
    """What a run says of itself: measures that come with the write of its table, not from reading it again."""
    watched, seen = observed(pieces(t).select("record_id", "start", "valid_length", "split"), "run", chunks=F.count(F.lit(1)), bases=F.sum("valid_length"), train=F.count_if(F.col("split") == "train"))
    save(watched, "observed-chunks")
    return t.spark.createDataFrame([seen.get], "chunks long, bases long, train long")


@query("h2_build_components", """WITH RECURSIVE r AS (SELECT d.doc_id, 'G' || d.doc_id AS g, sha256(coalesce(text, '')) AS h, coalesce(l.quality::VARCHAR, '') || '/' AS cl, CASE WHEN toxic = 1 THEN 'quarantine' END AS split, lang, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT * FROM r WHERE split IS NULL), f AS (SELECT *, first_value(g) OVER w AS fg, first_value(cl) OVER w AS fc FROM k WINDOW w AS (PARTITION BY h ORDER BY doc_id)),
e AS (SELECT g AS u, fg AS v FROM f WHERE cl = fc AND g <> fg UNION ALL SELECT g, 'G' || min(doc_id) OVER (PARTITION BY lang, n_chars) FROM r),
sy AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), vertices AS (SELECT g AS node FROM k UNION SELECT u FROM e UNION SELECT v FROM e),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM vertices
UNION (SELECT sy.v, min(cc.component) FROM cc JOIN sy ON sy.u = cc.node JOIN recurring.cc AS old ON old.node = sy.v WHERE cc.component < old.component GROUP BY sy.v))
SELECT node AS base_group_id, 'SIM_' || substr(sha256(component), 1, 20) AS similarity_component FROM cc""")  # fmt: skip
def _(t):
    """Documents as groups of one record: joined where texts are equal within a class, and by edges between equal lengths of
    a language; quarantined records keep their edges only."""
    docs = t.documents.join(t.labels, "doc_id", "left")
    group = F.concat(F.lit("G"), "doc_id")
    rows = docs.select(
        group.alias("base_group_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("canonical_sha256"), F.col("quality").alias("main_label"), F.lit(None).cast("int").alias("sub_label"),
        F.when(F.col("toxic") == 1, "quarantine").alias("split"), F.lit("documents").alias("source_path"), F.col("doc_id").alias("pos"),
    )
    every = t.documents
    firsts = every.groupBy(F.col("lang").alias("l"), F.col("n_chars").alias("n")).agg(F.min("doc_id").alias("first"))
    edges = every.join(firsts, every["lang"].eqNullSafe(firsts["l"]) & every["n_chars"].eqNullSafe(firsts["n"])).select(group.alias("left_group"), F.concat(F.lit("G"), "first").alias("right_group"))
    return splits.build_components(rows, edges)


SOURCES = "CASE p_partkey % 4 WHEN 0 THEN 'ARC' WHEN 1 THEN 'NCLDV' WHEN 2 THEN 'PHAGE' ELSE 'EVE_NCLDV' END"


@query("m1_manifest_with_labels", f"""WITH r AS (SELECT {SOURCES} AS source, CASE p_partkey % 4 WHEN 0 THEN 'ARC__' WHEN 1 THEN 'NCLDV__' WHEN 2 THEN 'PHAGE__' ELSE 'EVE-NCLDV__' END AS prefix, p_partkey AS k, 'f' || p_partkey % 50 || '.fna' AS filename, {READ} AS s FROM part),
h AS (SELECT *, CASE WHEN source = 'EVE_NCLDV' THEN 'GCA_' || k % 30 || '.1_eves' ELSE 'g' || k % 90 END AS raw0 FROM r),
m AS (SELECT *, k % 50 AS fk, CASE WHEN source = 'EVE_NCLDV' THEN regexp_replace(regexp_replace(raw0, '_eves$', ''), '[_.]', '-', 'g') ELSE '' END AS host FROM h),
j AS (SELECT *, fk % 3 = 0 AS snap, CASE WHEN fk % 7 = 0 THEN 'u' || fk ELSE raw0 END AS raw FROM m),
x AS (SELECT *, source <> 'PHAGE' AND (k % 90) % 4 = 0 AND raw = raw0 AND source <> 'EVE_NCLDV' AS ex, source <> 'PHAGE' AND (k % 90) % 5 = 0 AND raw = raw0 AND source <> 'EVE_NCLDV' AS pr FROM j),
g AS (SELECT *, CASE WHEN snap THEN 'snapshot_metadata' WHEN ex THEN 'gv_labels' WHEN pr THEN 'provisional' ELSE 'missing' END AS taxonomy_source, CASE WHEN snap THEN 'S' || fk % 5 WHEN ex THEN 'E' || k % 90 % 6 WHEN pr THEN 'unclassified' ELSE '' END AS genus,
  CASE WHEN snap AND fk % 9 = 0 THEN 'Mirusviricota' WHEN snap THEN 'P' WHEN ex OR pr THEN 'Q' ELSE '' END AS phylum, regexp_replace(translate(upper(s), 'U', 'T'), '[^ACGTN]', 'N', 'g') AS q FROM x)
SELECT 'REC_' || substr(sha256(source || chr(31) || prefix || raw0 || '|c' || k), 1, 20) AS record_id, source, source || '__' || CASE WHEN source = 'EVE_NCLDV' THEN host ELSE raw0 END AS genome_id, taxonomy_source, genus AS taxonomy_genus,
  CASE WHEN source = 'NCLDV' AND genus <> '' AND genus <> 'unclassified' THEN 'NCLDV_GENUS::' || genus WHEN source = 'EVE_NCLDV' THEN 'EVE_HOST::' || host WHEN source = 'PHAGE' AND fk % 2 = 0 THEN 'PHAGE_VOTU::v' || fk ELSE 'GENOME::' || source || '__' || raw0 END AS base_group_id,
  CASE WHEN source = 'ARC' AND fk % 10 = 0 THEN 'cellular_genome_is_viral_host:EVE:b,PHAGE:a' WHEN (length(q) - length(replace(q, 'N', ''))) / length(q) > 0.2 THEN 'n_fraction_above_0.2' WHEN source = 'PHAGE' AND phylum = 'Mirusviricota' THEN 'ncldv_or_mirus_in_phage_source' END AS exclusion_reason FROM g""")  # fmt: skip
def _(t):
    """Records of four sources with metadata, host matches and both label tables: every join and cascade of the manifest."""
    k, turn = F.col("p_partkey"), F.col("p_partkey") % 4
    source = F.when(turn == 0, "ARC").when(turn == 1, "NCLDV").when(turn == 2, "PHAGE").otherwise("EVE_NCLDV")
    prefix = F.when(turn == 0, "ARC__").when(turn == 1, "NCLDV__").when(turn == 2, "PHAGE__").otherwise("EVE-NCLDV__")
    raw = F.when(turn == 3, F.concat(F.lit("GCA_"), k % 30, F.lit(".1_eves"))).otherwise(F.concat(F.lit("g"), k % 90))
    file = F.concat(F.lit("f"), k % 50, F.lit(".fna"))
    rows = dna(t, F.concat("p_partkey", "p_name")).select(source.alias("source"), file.alias("filename"), file.alias("path"), k.alias("pos"), F.concat(prefix, raw, F.lit("|c"), k).alias("header"), F.col("s").alias("sequence"))
    fk = k % 50
    ranks = lambda phylum, genus: F.array(phylum, *[F.lit("")] * 3, genus, F.lit(""))
    snapshot = F.when(fk % 3 == 0, ranks(F.when(fk % 9 == 0, "Mirusviricota").otherwise("P"), F.concat(F.lit("S"), fk % 5)))
    meta = t.part.select(
        source.alias("source"), file.alias("filename"), snapshot.alias("snapshot"), F.when(fk % 2 == 0, F.concat(F.lit("v"), fk)).alias("votu"), F.when(fk % 7 == 0, F.concat(F.lit("u"), fk)).alias("uvig"),
        F.lit(0).alias("main_label"), F.lit(None).cast("int").alias("sub_label"), F.lit("genome").alias("record_type"),
    ).distinct()
    reasons = t.part.filter((turn == 0) & (fk % 10 == 0)).select(source.alias("source"), file.alias("filename"), F.array(F.lit("PHAGE:a"), F.lit("EVE:b")).alias("host_reasons")).distinct()
    named = t.part.filter((turn == 0) | (turn == 1)).select(source.alias("source"), raw.alias("raw_genome"), (k % 90).alias("n")).distinct()
    exact = named.filter("n % 4 = 0").select("source", "raw_genome", ranks(F.lit("Q"), F.concat(F.lit("E"), F.col("n") % 6)).alias("ranks"))
    provisional = named.filter("n % 5 = 0").select("source", "raw_genome", ranks(F.lit("Q"), F.lit("unclassified")).alias("ranks"))
    found = manifest.build_manifest(rows, meta, reasons, exact, provisional)
    return found.select("record_id", "source", "genome_id", "taxonomy_source", "taxonomy_genus", "base_group_id", "exclusion_reason")


HEX = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
MADE = f"{HEX.format("'a' || {k}")} || {HEX.format("'b' || {k}")}"
FOLD = GREEDY[GREEDY.index("tot AS") : GREEDY.index("SELECT g AS component")]


@query("x9_preprocess_run", f"""WITH RECURSIVE k AS (SELECT p_partkey AS k FROM part), s0 AS (SELECT k, {MADE.format(k="k")} AS own, {MADE.format(k="(k - 1)")} AS one, {MADE.format(k="(k - 7)")} AS seven FROM k),
r AS (SELECT k, CASE WHEN k % 10 = 1 THEN {RC.replace('x', 'one')} WHEN k % 10 = 4 THEN substr(one, 1, 49) || translate(substr(one, 50, 1), 'ACGT', 'CGTA') || substr(one, 51) WHEN k % 50 = 7 THEN seven ELSE own END AS q,
  (k // 100 % 2 + (k % 50 = 7)::INT) % 2 || '/' AS label, CASE WHEN k // 10 % 2 = 0 THEN 'ARC' ELSE 'BAC' END AS source FROM s0),
m AS (SELECT *, 'GENOME::' || source || '__g' || k AS grp, least(q, {RC.replace('x', 'q')}) AS canon FROM r),
bad AS (SELECT canon FROM m GROUP BY canon HAVING count(DISTINCT label) > 1),
fr AS (SELECT k, grp, label, start, least(x, {RC}) AS h FROM (SELECT k, grp, label, 0 AS start, substr(q, 1, 40) AS x FROM m UNION ALL SELECT k, grp, label, 40, substr(q, 41) FROM m)),
fi AS (SELECT *, first_value(k) OVER w AS fk, first_value(grp) OVER w AS fg, first_value(label) OVER w AS fl FROM fr WINDOW w AS (PARTITION BY h ORDER BY k, start)),
gone AS (SELECT DISTINCT unnest([k, fk]) AS k FROM fi WHERE label <> fl UNION SELECT k FROM fr WHERE h IN (SELECT h FROM fr GROUP BY h HAVING count(DISTINCT label) > 1)),
eq AS (SELECT grp, label, first_value(grp) OVER w AS fg, first_value(label) OVER w AS fl FROM m WINDOW w AS (PARTITION BY canon ORDER BY k)),
ed AS (SELECT grp AS u, fg AS v FROM fi WHERE label = fl UNION SELECT grp, fg FROM eq WHERE label = fl), sy AS (SELECT u, v FROM ed WHERE u <> v UNION SELECT v, u FROM ed WHERE u <> v), vertices AS (SELECT grp AS node FROM m),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM vertices
UNION (SELECT sy.v, min(cc.component) FROM cc JOIN sy ON sy.u = cc.node JOIN recurring.cc AS old ON old.node = sy.v WHERE cc.component < old.component GROUP BY sy.v)),
kept AS (SELECT m.*, 'SIM_' || substr(sha256(component), 1, 20) AS g FROM m JOIN cc ON node = grp WHERE k NOT IN (SELECT k FROM gone) AND canon NOT IN (SELECT canon FROM bad)),
st AS (SELECT g, any_value(source || '|' || label) AS s, sum(length(q))::BIGINT AS b, count(DISTINCT k) AS n FROM kept GROUP BY g), {FOLD.replace('NULL::BIGINT AS g', 'NULL::VARCHAR AS g')}
SELECT fold.split, 2 * count(*) AS chunks, sum(length(q))::BIGINT AS bases, count(DISTINCT kept.k) AS genomes, count(DISTINCT kept.g) AS groups, true AS sound FROM kept JOIN fold ON fold.g = kept.g GROUP BY fold.split""")  # fmt: skip
def _(t):
    """FASTA files of the parts, with copies on the other strand, near copies and copies under another label, to checked
    chunks; the tables of the run stay in its folder."""
    k = F.col("p_partkey")
    made = lambda n: F.concat(*[F.translate(F.md5(F.concat(F.lit(c), n.cast("string")).cast("binary")), "0123456789abcdef", "ACGT" * 4) for c in "ab"])
    near = F.concat(F.substring(made(k - 1), 1, 49), F.translate(F.substring(made(k - 1), 50, 1), "ACGT", "CGTA"), F.substring(made(k - 1), 51, 64))
    sequence = F.when(k % 10 == 1, S.reverse_complement(made(k - 1))).when(k % 10 == 4, near).when(k % 50 == 7, made(k - 7)).otherwise(made(k))
    source = F.when(F.floor(k / 10) % 2 == 0, "ARC").otherwise("BAC")
    folder = new_folder(t.spark, "preprocess")
    t.part.select(F.concat(F.lit(">"), source, F.lit("__g"), k, F.lit("|c"), k, F.lit("\n"), sequence).alias("value")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.text(f"{folder}/in")
    read = fasta.read_fasta(t.spark, f"{folder}/in", split_bytes=64 << 10, suffixes=".txt")
    number = F.regexp_extract("header", r"(\d+)$", 1).cast("long")
    records = read.select(F.substring("header", 1, 3).alias("source"), F.concat(F.lit("f"), number, F.lit(".fna")).alias("filename"), F.lit("in").alias("path"), number.alias("pos"), "header", "sequence")
    label = ((F.floor(k / 100) % 2 + (k % 50 == 7).cast("int")) % 2).cast("int")
    meta = t.part.select(source.alias("source"), F.concat(F.lit("f"), k, F.lit(".fna")).alias("filename"), F.lit(None).cast("array<string>").alias("snapshot"), F.lit("").alias("votu"), F.lit("").alias("uvig"), label.alias("main_label"), F.lit(None).cast("int").alias("sub_label"), F.lit("genome").alias("record_type"))
    preprocess.run(t.spark, save(records, "records"), meta, f"{folder}/out", Settings(chunk_size=40, minimum_tail=10))
    chunks_ = t.spark.read.parquet(f"{folder}/out/chunks")
    sound = t.spark.read.parquet(f"{folder}/out/lineage").filter("table = 'checks'").first()["rows"] == 0
    return chunks_.groupBy("split").agg(F.count("*").alias("chunks"), F.sum("valid_length").cast("long").alias("bases"), F.countDistinct("genome_id").alias("genomes"), F.countDistinct("split_group").alias("groups"), F.lit(sound).alias("sound"))
