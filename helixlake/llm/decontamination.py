r"""Benchmark decontamination [native]: windows of test words held as a broadcast hash set, scanned over all documents.

A-Z is lower-cased and words are the runs of digits, letters and non-ASCII characters. A window is ``width``
consecutive words of a test item; an item of fewer words is one window. The set is keyed by each window's longest word:
the scan probes it once for each word of a document, and the windows of a word found there are verified word by word
around it. All widths take the one scan.

The windows are measured first and broadcast in blocks of about ``broadcast_bytes``, one scan per block: whatever the
test set's size, a broadcast stays bounded and a document's words are never shuffled. What is gathered per document is
its hits, which its words bound, and the items they are of.

Defined results: a null or wordless text has n_words 0 and no hits; null or wordless items have no windows; a null
item_id is the item ""; item rows with the same id count once; rows with equal id and text get equal results; a very long text is one array of words in
one task; other columns are not looked at; empty tables give no hits or no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: What separates words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words, before.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def test_windows(items: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """Distinct (item, n, gram): the windows of each item; gram is the array of its words."""
    cut = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return cut.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: key, _t (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    tests = test_windows(items, width, item, item_text)
    # each window is found by its longest word (the first of the greatest), which is seldom a common one
    longest = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("len"), x.alias("word"), (-i).alias("at"))))
    side = tests.withColumn("_l", longest).select("item", "n", "gram", F.col("_l.word").alias("word"), (-F.col("_l.at")).alias("off"))
    size = F.octet_length(F.array_join("gram", " ")) + F.octet_length("item") + 16 * F.size("gram") + 64  # in memory
    parts = max(1, math.ceil((tests.agg(F.sum(size.cast("long"))).first()[0] or 0) / broadcast_bytes))
    part = F.pmod(F.xxhash64("item", "gram"), F.lit(parts))
    ident = [F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]
    base = docs.select(*ident, F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), RAW_GAP), "")).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    start = F.col("i") - F.col("off")
    # the outer explode keeps Spark from splitting every text a second time to drop empty arrays; the join drops their nulls
    inside = (start >= 0) & (start + F.col("n") <= F.size("w"))
    scan = docs.select(*ident, words(F.col(text)).alias("w")).select(key, "_t", "w", F.posexplode_outer("w").alias("i", "word"))
    found = None
    for i in range(parts):
        block = F.broadcast(side.filter(part == i) if parts > 1 else side)
        hit = scan.join(block, "word").filter(inside & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("gram"))).select(key, "_t", start.alias("pos"), "n", "item")
        found = hit if found is None else found.unionByName(hit)
    spans = F.collect_set(F.struct("pos", "n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))))
    hits = (
        found.groupBy(key, "_t").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.col(key).alias("_k"), F.col("_t").alias("_tt"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    )
    joined = base.join(hits, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_tt")), "left").drop("_k", "_tt")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        key, "_t", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    bad = decontaminate(docs, items, **options).filter("contaminated").select(F.col(key).alias("_k"), F.col("_t").alias("_tt")).distinct()
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_tt"))
    return docs.join(bad, same, "left_anti")


def op8_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_t")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  coalesce(it.h, sha256('')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
