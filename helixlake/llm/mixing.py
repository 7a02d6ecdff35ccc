r"""Mixing sources to target weights [native]: weighted fair queueing.

Each source is a queue of its documents in a fixed pseudo-random order, passed through at most ``max_epochs`` times.
A copy of a document has a virtual finish time: words its source has sent, this copy included, divided by the target
of the source. All copies are sorted by it, over all sources, and their words are added up in that order; the virtual
time at which the sum reaches the total budget is the cut. Copies that finish by then are taken. The one copy of a
source that lies across the cut is taken if at least half of it lies before the cut: each source then misses its share
of the cut by half a document at most.

Defined results: a null text has size 0; a null source is a source of its own and sorts last; documents without words
finish with the words before them and are taken once or twice with 0 words; of rows with the same key the checksum of
the text decides the order, and rows that are equal in source, key and text are separate documents that share a place
in the shuffle (which of them is taken is then undefined, and cannot be told); a very long document is one entry of its
queue, so its source misses the target by up to half of it; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .common import NON_BLANK, prefix_sums, table, uniform


def sized(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """Add _from, _key, _size and _u, the place in the shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    draw = uniform(F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(body.cast("binary")))
    size = F.regexp_count(body, F.lit(NON_BLANK)).cast("long")
    return docs.withColumns({"_from": F.col(source), "_key": F.col(key), "_size": size, "_u": draw})


def targets(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per source of sized rows: _s (source), _n (its place by code point), source_size, target.

    The level (budget per unit of weight) is found in closed form: by rising ratio of cap to weight, a source is
    capped while its ratio is below the level that is left for it and those after it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("_s").asc_nulls_last())
    sizes = docs.groupBy(F.col("_from").alias("_s")).agg(F.sum("_size").alias("source_size"))
    every = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("_ratio", "_n").rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(later)
    return (
        sizes.withColumn("_n", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(float(max_epochs))})
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_n", "_level")))
        .withColumn("_at", F.min("_open").over(every)["_level"])
        .select("_s", "_n", "source_size", F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.col("_at") * F.col("_w")).alias("target"))
    )


class Queues:
    """The queues of all sources, their targets and the cut, from the sizes of documents alone (saved, so that the words
    of a text are counted once)."""

    def __init__(self, sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2):
        self.max_epochs = max_epochs
        self.sizes = save(sizes.select("_from", "_key", "_size", "_u"), "sizes")
        self.rows, words = self.sizes.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
        self.goals = save(targets(self.sizes, weights, share, max_epochs), "targets")
        self.queued = save(self.queue(self.sizes).select("_from", "_key", "_size", "_u", "_n", "source_size", "target", "_cum"), "queues")
        budget = float(words) * min(float(share), float(max_epochs))
        copies = self.queued.filter("_size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("finish", self.finish())
        # any order-preserving map into [0, 1) deals the copies to buckets; few copies that matter finish late
        sorted_ = prefix_sums(copies.withColumn("_f", F.col("finish") / (F.col("finish") + 1)), [], "_f", [F.col(c) for c in ("finish", "_n", "epoch", "_u", "_key", "_size")], F.col("_size"), "_sent", self.rows * max_epochs)
        self.cut = save(sorted_.filter(F.col("_sent") >= F.lit(budget)).agg(F.coalesce(F.min("finish"), F.lit(0.0)).alias("_cut")), "cut")

    def queue(self, docs: DataFrame) -> DataFrame:
        """Add to sized rows, whatever else they have: _n, source_size, target, _cum (words of the queue up to it)."""

        def joined(x: DataFrame) -> DataFrame:
            return x.join(self.goals, x["_from"].eqNullSafe(self.goals["_s"])).drop("_s")

        return prefix_sums(joined(docs), ["_n"], "_u", [F.col("_key"), F.col("_size")], F.col("_size"), "_cum", self.rows, counted=joined(self.sizes))

    @staticmethod
    def finish(epoch: Column | None = None) -> Column:
        sent = (F.col("epoch") if epoch is None else epoch) * F.col("source_size") + F.col("_cum")
        return F.coalesce(F.try_divide(sent.cast("double"), F.col("target")), F.lit(0.0))

    def taken(self, queued: DataFrame) -> DataFrame:
        """Add copies (how often the mix takes a queued row) and taken (its words)."""
        cut = queued.crossJoin(F.broadcast(self.cut))  # one row
        inside = [(F.lit(e) * F.col("source_size") + F.col("_cum") - F.col("_size") / 2 <= F.col("_cut") * F.col("target")).cast("int") for e in range(self.max_epochs)]
        return cut.withColumn("copies", sum(inside[1:], inside[0])).withColumn("taken", F.col("_size") * F.col("copies")).drop("_cut")


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """One row per row of docs: _from, _key, _size, source_size, target, _cum, copies, taken."""
    queues = Queues(sized(docs.select(source, key, text), source, key, text, seed), weights, share, max_epochs)
    return queues.taken(queues.queued)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17, ordered: bool = True) -> DataFrame:
    """The mixed stream itself: each taken copy of a row with its epoch and virtual finish, globally sorted by finish.

    Columns of docs named epoch or finish stay as they are, in place of the stream's own. ordered=False leaves out the
    last sort of the whole rows, where the order of the stream is not wanted.
    """
    queues = Queues(sized(docs.select(source, key, text), source, key, text, seed), weights, share, max_epochs)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).alias("_a"), F.col(key).alias("_b"), F.col(text).alias("_c"))
    rows = sized(whole, "_a", "_b", "_c", seed).drop("_a", "_b", "_c")
    copies = queues.taken(queues.queue(rows)).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    stream = copies.withColumn("finish", queues.finish())
    stream = stream.orderBy("finish", "epoch") if ordered else stream
    return stream.select("_row.*", *[c for c in ("epoch", "finish") if c not in docs.columns])


def op6_mixing(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents")).select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
c AS (SELECT *, [5.0, 2.0, 1.0][(n % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, n, source_size, CASE WHEN ratio > level THEN (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) * w ELSE cap END AS target FROM l),
q AS (SELECT d.doc_id, d.size, d.u, t.n, t.source_size, t.target,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT q.*, epoch, (epoch * source_size + cum)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) e(epoch) WHERE size > 0),
r AS (SELECT finish, sum(size) OVER (ORDER BY finish, n, epoch, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent FROM f),
x AS (SELECT coalesce(min(finish), 0.0)::DOUBLE AS cut FROM r WHERE sent >= (SELECT sum(size) FROM d) * 1.5::DOUBLE)
SELECT doc_id, size, source_size, target,
  (size * ((cum - size / 2.0::DOUBLE <= cut * target)::INT + (source_size + cum - size / 2.0::DOUBLE <= cut * target)::INT))::BIGINT AS taken FROM q, x
"""
