"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Each text becomes its set of word n-grams (5 words; a text of fewer words is one n-gram). Equal sets are one node.
2. MinHash values are cut into bands; numbers of bands and rows are chosen for the target recall at the threshold.
   Nodes shuffle on band hashes. A node goes to a block of nodes that share a band with the same head (the least node
   of a band); blocks are of bounded size.
3. Two blocks meet if some band is in both, and only then; each such pair of blocks is one task, which verifies the
   pairs across them on the full sets, counts links and returns a spanning forest of its verified pairs. So every pair
   that shares a band is verified once, no pair of documents is listed, and chains of candidates do not grow together.
4. Classes are the connected components of the verified links.

Defined results: a null or wordless text has no n-grams, no links, and is a class of its own; rows with equal sets
link to each other; class_id and copy_id are the smallest ids (null if all are null); repeated rows are separate
documents; a very long text is one set, worked on in one task (8 bytes a distinct n-gram); an empty table gives no
rows. Sets are compared as 64-bit n-gram hashes, nodes by 128 bits of a set's hashes.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import save
from .common import table, tidy, trim
from .words import chunks, mix, ngrams, per_row_unique, text_buffer, tokenise

#: A task verifies two blocks of about so many n-grams and so many sets each.
BLOCK_GRAMS, BLOCK_SETS = 1 << 19, 1 << 9
#: Members (some 100 bytes each) that are broadcast to fetch their texts; more of them are joined by shuffles.
BROADCAST_ROWS = 500_000
#: An n-gram in more of a task's sets than this is counted by matrix product, others pair by pair.
DENSE = 32


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        share = threshold**rows
        if share < 1e-9:
            break
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - share))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sets(column: pa.Array, n: int):
    """(rows, sorted distinct n-gram hashes, bounds) of runs of texts."""
    raw, off = text_buffer(column)
    for a, b in chunks(off):
        words, bounds, _ = tokenise(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        grams, at = ngrams(words, bounds, n, short=True)
        values, _, cut = per_row_unique(grams, at)
        yield b - a, values, cut


def _row_sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return run[cut[1:]] - run[cut[:-1]]


def _names(values: np.ndarray, cut: np.ndarray) -> list[str | None]:
    """128 bits of each set, as text; None for empty sets."""
    a, b = mix(_row_sums(values, cut)), mix(_row_sums(mix(values ^ np.uint64(0x5DEECE66D)), cut))
    return [f"{x:016x}{y:016x}" if z else None for x, y, z in zip(a.tolist(), b.tolist(), np.diff(cut).tolist(), strict=True)]


def _bands(values: np.ndarray, cut: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands); empty sets get zeros."""
    salt = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, (bands * rows, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(cut))
    out = np.zeros((len(cut) - 1, bands), np.uint64)
    if len(full):
        for b in range(bands):
            h = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                x, odd = salt[b * rows + r]
                h = mix(h) + np.minimum.reduceat((values ^ x) * (odd | np.uint64(1)), cut[full])
            out[full, b] = mix(h)
    return out


def sketch(docs: DataFrame, n: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(id, _t, node, n, bands) per row; node is null for empty sets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, sizes, hashes = [], [], []
            for _, values, cut in _sets(batch.column(2), n):
                nodes += _names(values, cut)
                sizes.append(np.diff(cut))
                hashes.append(_bands(values, cut, bands, rows))
            flat = pa.array(np.concatenate(hashes).view(np.int64).ravel() if hashes else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), lists], ["id", "_t", "node", "n", "bands"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("_t"), body.alias("text")).mapInArrow(tidy(run), f"id {kind}, _t long, node string, n long, bands array<long>")


def intersections(values: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the pairwise intersections of m sets, given as (value, set) rows."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, np.int64)
    freq = np.diff(np.append(start, len(v)))
    each = np.repeat(freq, freq)
    rank = np.arange(len(v)) - np.repeat(start, freq)
    out = np.zeros(m * m, np.int32)
    for d in range(1, min(DENSE, int(freq.max(initial=0)))):
        at = np.flatnonzero((each <= DENSE) & (rank + d < each))
        np.add.at(out, o[at] * m + o[at + d], 1)
    out = out.reshape(m, m)
    common = np.flatnonzero(freq > DENSE)
    for i in range(0, len(common), 4096):
        some = common[i : i + 4096]
        block = np.zeros((m, len(some)), np.float32)
        rows = np.concatenate([o[start[j] : start[j] + freq[j]] for j in some])
        block[rows, np.repeat(np.arange(len(some)), freq[some])] = 1
        out += np.triu(block @ block.T, 1).astype(np.int32)
    return out + out.T


def _linked(inter: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> np.ndarray:
    # J >= a / b with |A or B| = |A| + |B| - |A and B|, in whole numbers
    a, b = threshold.numerator, threshold.denominator
    return inter.astype(np.int64) * (a + b) >= a * (sizes[:, None] + sizes[None, :])


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.998, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id, n_links (other rows with J >= threshold), copy_id, n_grams."""
    exact = Fraction(str(threshold))
    bands, rows = bands_for(threshold, recall)
    seen = save(sketch(docs, n, bands, rows, key, text), "sketches")
    first = F.min(F.struct(F.col("id").isNull(), "id", "_t"))
    nodes = save(seen.filter("n > 0").groupBy("node").agg(first.alias("f"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes", rows=8 * seen.count())  # a row has all its bands
    nodes = nodes.select("node", F.col("f.id").alias("id"), F.col("f._t").alias("_t"), "copies", "n", "bands")

    m = nodes.count()
    most = m * bands
    banded = save(nodes.select("node", F.explode("bands").alias("band")), "bands", rows=most)
    heads = save(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("c")).filter("c > 1").select("band", "head"), "band-heads", rows=most)
    shared = save(banded.join(heads, "band"), "shared-bands", rows=most)
    clusters = save(shared.groupBy("node").agg(F.min("head").alias("cluster")).join(nodes.select("node", "id", "_t", "copies", "n"), "node"), "clusters", rows=m)
    size = save(clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks")), "cluster-sizes", rows=m)
    block = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("blocks")))  # two blocks of one name would only verify more pairs
    members = save(clusters.join(size, "cluster").select("node", "id", "_t", "copies", block.alias("block")), "members", rows=m)
    # which blocks meet: a band that very many nodes share is in few blocks, each listed once
    in_bands = save(shared.select("node", "band").join(members.select("node", "block"), "node").select("band", "block").distinct(), "blocks-of-bands", rows=most)
    meet = in_bands.withColumnRenamed("block", "p").join(in_bands.withColumnRenamed("block", "q"), "band").filter("p <= q").select("p", "q").distinct()
    meet = save(meet, "block-pairs")
    partners = meet.select(F.col("p").alias("block"), "p", "q").unionByName(meet.filter("p <> q").select(F.col("q").alias("block"), "p", "q"))

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("_t"))
    few = members.select("node", "id", "_t", "block", "copies")
    few = F.broadcast(few) if members.count() <= BROADCAST_ROWS else few
    same = texts["id"].eqNullSafe(few["id"]) & (texts["_t"] == few["_t"])
    wanted = texts.join(few, same).select("text", "node", "block", "copies")

    def resolve(batches):
        schema = pa.schema([("node", pa.string()), ("block", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary())])
        for batch in batches:
            grams = []
            for _, values, cut in _sets(batch.column(0), n):
                grams += [values[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(grams, pa.binary())], schema=schema)

    sets = save(wanted.mapInArrow(tidy(resolve), "node string, block long, copies long, grams binary"), "sets")
    dealt = sets.join(partners, "block")

    def verify(group: pa.Table) -> pa.Table:
        names = group["node"].to_pylist()
        at = sorted({x: i for i, x in enumerate(names)}.values())  # repeated rows of one id and text are one node
        names = [names[i] for i in at]
        parts = [np.frombuffer(group["grams"][i].as_buffer(), np.uint64) for i in at]
        block, copies = (group[c].to_numpy()[at] for c in ("block", "copies"))
        sizes = np.array([len(x) for x in parts])
        link = _linked(intersections(np.concatenate(parts), np.repeat(np.arange(len(at)), sizes), len(at)), sizes, exact)
        np.fill_diagonal(link, False)
        if group["p"][0].as_py() != group["q"][0].as_py():
            link &= block[:, None] != block[None, :]
        counts = link @ copies
        if len(at) > BLOCK_SETS // 2:
            trim()
        left, edges = np.ones(len(at), bool), []
        for i in range(len(at)):
            if left[i]:
                left[i] = False
                front = np.array([i])
                while len(front):
                    front = np.flatnonzero(link[front].any(axis=0) & left)
                    left[front] = False
                    edges += [(names[j], names[i]) for j in front.tolist()]
        out = [(x, None, c) for x, c in zip(names, counts.tolist(), strict=True) if c] + [(a, b, 0) for a, b in edges]
        return pa.table({"node": pa.array([x[0] for x in out], pa.string()), "other": pa.array([x[1] for x in out], pa.string()), "links": pa.array([x[2] for x in out], pa.int64())})

    checked = save(dealt.groupBy("p", "q").applyInArrow(verify, "node string, other string, links long"), "verified")
    classes = connected_components(checked.filter(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("component", "class")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "id", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("class", "node"))
    full = save(full, "node-classes", rows=m)
    ids = full.groupBy("class").agg(F.min("id").alias("class_id"))
    full = save(full.join(ids, "class").select("node", F.col("id").alias("copy_id"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "node-results", rows=m)
    found = seen.select("id", "_t", "node", "n").join(full, "node", "left")
    own = F.col("node").isNull()
    return found.select(
        F.col("id").alias(key), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(own, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.col("n").alias("n_grams"), "_t",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, that with the smallest id (of rows that repeat it, one), with its own columns."""
    classes = save(jaccard_classes(docs, key=key, text=text, **options), "classes")
    n = classes.count()
    gone = save(classes.filter(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_k"), F.col("_t").alias("_h")).distinct(), "copies", rows=n)
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(gone, docs[key].eqNullSafe(gone["_k"]) & (body == gone["_h"]), "left_anti")
    repeated = save(classes.filter("n_grams > 0").groupBy(F.col(key).alias("_k"), F.col("_t").alias("_h")).count().filter("count > 1").drop("count"), "repeated-rows", rows=n)
    if repeated.isEmpty():
        return kept
    same = kept[key].eqNullSafe(repeated["_k"]) & (body == repeated["_h"])
    once = kept.join(repeated, same).dropDuplicates(["_k", "_h"]).select(*docs.columns)
    return kept.join(repeated, same, "left_anti").unionByName(once)


def op2_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_t")


#: Every pair that shares an n-gram, by the n-grams themselves: what banding must find (and does, on the test tables).
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 5) AS n FROM d WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, b.n = cx.n AND b.n = cy.n AS same FROM inter b JOIN c cx ON x = cx.doc_id JOIN c cy ON y = cy.doc_id WHERE b.n * 9 >= 4 * (cx.n + cy.n)),
e AS (SELECT x, y, same FROM link UNION ALL SELECT y, x, same FROM link),
reach(doc_id, member) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, member FROM reach JOIN e ON e.x = reach.doc_id),
m AS (SELECT doc_id, min(member) AS class_id FROM reach GROUP BY doc_id),
k AS (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (same) AS copy FROM e GROUP BY x)
SELECT d.doc_id, m.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, least(d.doc_id, coalesce(k.copy, d.doc_id)) AS copy_id, coalesce(c.n, 0)::BIGINT AS n_grams
FROM d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
