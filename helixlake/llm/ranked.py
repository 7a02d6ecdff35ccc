r"""Ranked lexical search with block-max pruning.

Index: documents as they lie in the table are cut into packs of some megabytes and packs into blocks, each a range of
``block_words`` words or so of consecutive documents. A pack holds its terms once, the maximum of each term in each
block (of what it adds to a document's score, for a weight of 1), and the forward index of its blocks: for each document its
terms and what each of them adds. Every document is in the index.

Search, for queries in blocks of about ``query_bytes``, which bounds what is broadcast:

1. Bounds: for each query and block the sum over the query's terms of weight times maximum; per pack the greatest.
2. The ``first`` packs of the greatest bound are scored; the k-th best score found is the query's threshold.
3. In all packs, the blocks of each query are sorted by bound and scored from the forward index until the bound drops
   below the threshold, or below the k-th best score of the pack. What is left out scores less than k documents do.

A term is a run of digits, letters and non-ASCII characters, A-Z lower-cased. All numbers but the weight's logarithm
are integers: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, score = sum of
w ((10^9 tf) div (1000 tf + 8 m)), each term once.

Defined results: a null or wordless text has no terms, is not counted in N and not found; rows with equal keys are
separate documents, and of those with equal scores too the order is open, as they are alike; null keys come before others
of equal score; item rows with the same id are one query of all their terms, a null id is a query as well; items without
terms, or whose terms occur nowhere, have no rows; other columns are not looked at; empty tables give no rows. A very
long text is a block of its own.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .common import table, tidy
from .decontamination import LOWER, RAW_GAP, UPPER
from .packs import PACK, PIECE, Codes, expand, number, packed, restored_keys, squeeze, stored_keys
from .words import IS_WORD, text_buffer

#: The same in UTF-8, after lower-casing.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Words in a block. Small blocks prune better, large ones cost less each.
BLOCK_WORDS = 1 << 14
#: Sums of weight times maximum are exact in doubles up to here.
EXACT = 2**53


def _terms(text: str):
    raw = text.encode().lower()
    a = 0
    while len(raw) - a > PIECE and (gap := GAP.search(raw, a + PIECE)):
        yield TERM.findall(raw, a, gap.start())
        a = gap.start()
    yield TERM.findall(raw, a)


@dataclass
class Index:
    packs: DataFrame
    documents: int  # N
    words: int  # L
    key: str
    kind: str  # of the key


def _totals(docs: DataFrame, text: str) -> tuple[int, int]:
    def count(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            inside = IS_WORD[raw]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            rows = off[:-1][off[:-1] < len(raw)]
            first[rows] = inside[rows]
            n = np.diff(np.concatenate(([0], np.cumsum(first)))[off])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "l"])

    n, l = docs.select(text).mapInArrow(tidy(count), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, l or 0


def _starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """First documents of blocks of about ``most`` words."""
    at = np.cumsum(sizes) - sizes
    block = at // most
    return np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(sizes) else np.empty(0, np.int64)


#: Of a pack: offsets, blocks and values of the maxima, sorted by term; first documents of the blocks; keys; and the
#: forward index: offsets of the documents, terms and values.
PARTS = ("max_at", "max_block", "max_value", "blocks", "keys", "doc_at", "doc_term", "doc_value")


def _indexed(made: int, keys: pa.Array, found: Codes, n_docs: int, n_words: int, block_words: int) -> dict:
    """The row of a pack: its terms with the number of documents they are in, and PARTS."""
    sizes, codes = np.frombuffer(found.sizes, np.uint64).astype(np.int64), np.frombuffer(found.codes, np.uint32)
    doc, vocabulary = np.repeat(np.arange(len(sizes)), sizes), len(found.known)
    entry, tf = np.unique(doc * max(1, vocabulary) + codes, return_counts=True)
    doc, term = entry // max(1, vocabulary), entry % max(1, vocabulary)
    m = 10 + np.array([90 * x * n_docs // max(1, n_words) for x in sizes.tolist()], np.int64)
    value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    first = _starts(sizes, block_words)
    block = np.searchsorted(first, doc, side="right") - 1
    order = np.lexsort((block, term))
    by_term, by_block = term[order], block[order]
    new = np.flatnonzero((np.diff(by_term, prepend=-1) != 0) | (np.diff(by_block, prepend=-1) != 0))
    most = np.maximum.reduceat(value[order], new) if len(new) else value
    parts = (
        np.searchsorted(by_term[new], np.arange(vocabulary + 1)), by_block[new].astype(np.int32), most.astype(np.int32), first,
        np.searchsorted(doc, np.arange(len(sizes) + 1)), term.astype(np.int32), value.astype(np.int32),
    )
    packed_parts = [squeeze(x) for x in parts]
    packed_parts.insert(PARTS.index("keys"), stored_keys(keys))
    return {"pack": made, "terms": list(found.known), "df": np.bincount(term, minlength=vocabulary).tolist()} | dict(zip(PARTS, packed_parts, strict=True))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, pack_bytes: int = PACK) -> Index:
    """Every document of docs, in packs, written below the shared folder."""
    n_docs, n_words = _totals(docs, text)

    def pack(batches):
        for made, (keys, found) in enumerate(packed(batches, _terms, pack_bytes)):
            yield pa.RecordBatch.from_pylist([_indexed(number(made), keys, found, n_docs, n_words, block_words)], schema)

    schema = pa.schema([("pack", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), *((n, pa.binary()) for n in PARTS)])
    kind = "pack long, terms array<binary>, df array<int>, " + ", ".join(f"{n} binary" for n in PARTS)
    return Index(save(docs.select(key, text).mapInArrow(tidy(pack), kind), "index"), n_docs, n_words, key, docs.schema[key].dataType.simpleString())


def weighted(index: Index, items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, w): the distinct terms of each item that occur in the index, with their weights."""
    cut = F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), RAW_GAP), "")
    asked = items.select(F.col(item).alias("item"), F.explode(cut.cast("array<binary>")).alias("term")).distinct()
    listed = index.packs.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").cast("long").alias("df"))
    df = listed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    return asked.join(df, "term").select("item", "term", w.alias("w"))


@dataclass
class Queries:
    """A block of queries: their ids, the distinct terms, and for each query the places of its terms in that list and
    their weights."""

    items: pa.Array
    terms: list[bytes]
    offsets: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _gather(rows: pa.Table) -> Queries:
    """rows: (item, term, w) of one block of queries."""
    item = rows["item"].combine_chunks()
    query = pc.rank(item, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    order = np.argsort(query, kind="stable")
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    terms = rows["term"].combine_chunks().take(pa.array(order)).dictionary_encode()
    return Queries(item.take(pa.array(order[first])), terms.dictionary.to_pylist(), np.append(first, len(order)), terms.indices.to_numpy(), rows["w"].to_numpy()[order].astype(np.int64))


class Pack:
    """A pack's maxima, for a block of queries."""

    def __init__(self, row: dict, queries: Queries):
        here = {t: i for i, t in enumerate(row["terms"])}
        self.places = np.array([here.get(t, -1) for t in queries.terms], np.int64)
        self.queries, self.size = queries, len(here)
        self.first = expand(row["blocks"], np.int64)
        self.at, self.block, self.most = (expand(row[n], k) for n, k in (("max_at", np.int64), ("max_block", np.int32), ("max_value", np.int32)))

    def own(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pack and weights of the query's terms that occur in it."""
        a, z = self.queries.offsets[q], self.queries.offsets[q + 1]
        places = self.places[self.queries.term[a:z]]
        return places[places >= 0], self.queries.weight[a:z][places >= 0]

    def bounds(self, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each block: no document in it scores more."""
        sizes = self.at[places + 1] - self.at[places]
        at = np.arange(sizes.sum()) + np.repeat(self.at[places] - (np.cumsum(sizes) - sizes), sizes)
        products = np.repeat(weight, sizes) * self.most[at]
        if products.sum(dtype=float) < EXACT:
            return np.bincount(self.block[at], weights=products, minlength=len(self.first)).astype(np.int64)
        out = np.zeros(len(self.first), np.int64)
        np.add.at(out, self.block[at], products)
        return out


class Forward:
    """A pack's forward index."""

    def __init__(self, row: dict, pack: Pack):
        self.pack = pack
        self.at, self.term, self.value = (expand(row[n], k) for n, k in (("doc_at", np.int64), ("doc_term", np.int32), ("doc_value", np.int32)))
        self.keys = restored_keys(row["keys"])
        rank = pc.rank(self.keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
        self.rank = rank.to_numpy().astype(np.int64)
        self.ends = np.append(pack.first[1:], len(self.keys))
        self.weights = np.zeros(pack.size, np.int64)

    def best(self, places: np.ndarray, weight: np.ndarray, bounds: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, blocks scored): the k best that score the threshold or more; blocks by descending bound."""
        self.weights[places] = weight
        documents, scores, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] < threshold:
                break
            a, z = self.pack.first[b], self.ends[b]
            at = self.at[a : z + 1]
            run = np.concatenate(([0], np.cumsum(self.weights[self.term[at[0] : at[-1]]] * self.value[at[0] : at[-1]])))
            found = np.diff(run[at - at[0]])
            good = np.flatnonzero(found >= threshold)
            documents, scores, done = np.append(documents, a + good), np.append(scores, found[good]), done + 1
            if len(scores) >= k:
                order = np.lexsort((self.rank[documents], -scores))[:k]
                documents, scores = documents[order], scores[order]
                threshold = max(threshold, int(scores[-1]))
        self.weights[places] = 0
        return documents, scores, done


def _order():
    return Window.partitionBy("_query").orderBy(F.desc("_score"), F.col("_key").asc_nulls_first())


def search(index: Index, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text", first: int = 4, query_bytes: int = 16 << 20) -> DataFrame:
    """(item, rank, key, score): the k best documents of each item, equal scores by ascending key."""
    context = index.packs.sparkSession.sparkContext
    terms = save(weighted(index, items, item, text), "query-terms")
    parts = max(1, math.ceil((terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) / query_bytes))
    kind = items.schema[item].dataType.simpleString()
    found = None
    for i in range(parts):
        queries = context.broadcast(_gather(terms.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).toArrow()))
        best = _search_block(index, queries, kind, k, first).withColumn("_rank", F.row_number().over(_order())).filter(F.col("_rank") <= k)
        part = best.select(F.col("_item").alias(item), F.col("_rank").cast("int").alias("rank"), F.col("_key").alias(index.key), F.col("_score").alias("score"))
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(index: Index, queries, kind: str, k: int, first: int) -> DataFrame:
    """(_query, _item, _key, _score): the best of each pack that may be among the best of all, for one block of queries."""
    count, context = len(queries.value.items), index.packs.sparkSession.sparkContext

    def bound(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row, queries.value)
                tops = [(q, int(pack.bounds(*own).max())) for q in range(count) if len((own := pack.own(q))[0])]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in tops], pa.int32()), pa.array([row["pack"]] * len(tops), pa.int64()), pa.array([b for _, b in tops], pa.int64())], ["_query", "pack", "bound"])

    def scores(thresholds):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    pack, forward, out = Pack(row, queries.value), None, []
                    for q in range(count):
                        places, weight = pack.own(q)
                        if len(places) and (bounds := pack.bounds(places, weight)).max() >= thresholds.value[q]:
                            forward = forward or Forward(row, pack)
                            documents, found, _ = forward.best(places, weight, bounds, k, int(thresholds.value[q]))
                            out.append((np.full(len(documents), q, np.int32), documents, found))
                    if out:
                        q, documents, found = (np.concatenate(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(q), queries.value.items.take(pa.array(q)), forward.keys.take(pa.array(documents)), pa.array(found)], ["_query", "_item", "_key", "_score"])

        return run

    narrow = index.packs.select("pack", "terms", "max_at", "max_block", "max_value", "blocks")
    bounds = save(narrow.mapInArrow(tidy(bound), "_query int, pack long, bound long"), "bounds")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("bound"), "pack"))
    some = bounds.withColumn("place", place).filter(F.col("place") <= first).select("pack").distinct()  # at most first times the queries of a block
    result = f"_query int, _item {kind}, _key {index.kind}, _score long"
    thresholds = np.ones(count, np.int64)
    early = index.packs.join(F.broadcast(some), "pack", "left_semi").mapInArrow(tidy(scores(context.broadcast(thresholds))), result)
    for q, score in early.withColumn("_rank", F.row_number().over(_order())).filter(F.col("_rank") == k).select("_query", "_score").collect():  # a row a query
        thresholds[q] = score
    return index.packs.mapInArrow(tidy(scores(context.broadcast(thresholds.copy()))), result)


def op12_ranked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search(build_index(docs), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
nl AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, nl GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score FROM tf JOIN df USING (term) JOIN b USING (term), nl GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
