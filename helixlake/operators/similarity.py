"""Similarity graph: exact and near duplicates of fragments, genome identity, and label conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.binding import bind
from ..session import save, ship
from .components import connected_components
from .genome_batches import OFTEN, draw_rows, drawn_part, identity_rows, pair_rows, posting_rows
from .genome_batches import heaviest_chain as _heaviest_chain  # noqa: F401 (tests)


def exact_edges(fragments: DataFrame, hash_col: str = "hash", group: str = "grp", label: str = "label", order: tuple[str, ...] = ("pos",), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and conflicts of fragments with equal hashes, each against the first in the declared order.

    A later fragment of the first one's label gives an edge between their groups; one of another label puts both
    records under quarantine. strict: every record of a hash with several labels goes, whatever the order.
    Returns (left_group, right_group, reason) and (record_id, reason).
    """
    first = fragments.groupBy(hash_col).agg(F.min_by(F.struct("record_id", group, label, *order), F.struct(*order)).alias("f"), (F.min(label) < F.max(label)).alias("mixed"), F.count("*").alias("n"))
    pairs = fragments.join(first.filter("n > 1"), hash_col)
    same, other = F.col(label) == F.col(f"f.{label}"), F.col(label) != F.col(f"f.{label}")
    edges = pairs.filter(same & (F.col(group) != F.col(f"f.{group}"))).select(F.least(group, f"f.{group}").alias("left_group"), F.greatest(group, f"f.{group}").alias("right_group"), F.lit("exact_fragment").alias("reason")).distinct()
    if strict:
        gone = pairs.filter("mixed").select("record_id")
    else:
        clash = pairs.filter(other)
        gone = clash.select("record_id").unionByName(clash.select(F.col("f.record_id").alias("record_id")))
    return edges, gone.distinct().withColumn("reason", F.lit("cross_label_exact_fragment"))


def shared(rows: DataFrame, key: str = "hash") -> DataFrame:
    """The rows whose key others have (and, where 64 bits of different keys agree, a few that no other has). Only hashes of
    the keys are shuffled to find them; they are written, so that few of them are broadcast to the rows."""
    hashed = rows.withColumn("_h", F.xxhash64(key))
    held = save(hashed.groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h"), "shared-hashes")
    return hashed.join(held, "_h", "left_semi").drop("_h")


def first_reason(edges: DataFrame, order: str = "pos") -> DataFrame:
    """One row per undirected pair with the reason that came first; self pairs go."""
    pair = edges.filter("left_group <> right_group").select(F.least("left_group", "right_group").alias("left_group"), F.greatest("left_group", "right_group").alias("right_group"), "reason", order)
    return pair.groupBy("left_group", "right_group").agg(F.min_by("reason", order).alias("reason"))


def _kmers(sequence: Column, k: int) -> Column:
    """The k-mers of every place; a shorter sequence is one."""
    every = F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{int(k)}}}))"), F.lit(1))  # one pass over the sequence
    return F.when(F.length(sequence) < k, F.array(sequence)).otherwise(every)


def _strands(sequence: Column, k: int) -> Column:
    """(x, y) of every place: the k-mer and its reverse complement, which is a k-mer of the turned sequence."""
    return F.arrays_zip(_kmers(sequence, k).alias("x"), F.reverse(_kmers(S.reverse_complement(sequence), k)).alias("y"))


def kmer_sketch(fragments: DataFrame, k: int = 21, keep: int = 80, sequence: str = "sequence") -> DataFrame:
    """(id, kmer, rank): the ``keep`` smallest hashes of canonical k-mers of each fragment, exploded."""
    hashes = F.array_distinct(F.transform(_strands(F.col(sequence), k), lambda z: F.xxhash64(F.least(z["x"], z["y"]))))
    return fragments.select("id", F.posexplode(F.slice(F.array_sort(hashes), 1, keep)).alias("rank", "kmer"))


def seeds(fragments: DataFrame, k: int, keep: int) -> DataFrame:
    """(id, n, kmer, at, turned): the ``keep`` smallest k-mer hashes of (id, s, n), with the first place of each and whether
    it is the other strand's k-mer that is the canonical one."""

    def named(z: Column) -> Column:
        """63 bits of the canonical k-mer's hash, and one that says which strand it is on."""
        return F.shiftleft(F.xxhash64(F.least(z["x"], z["y"])), 1).bitwiseOR((z["x"] > z["y"]).cast("long"))

    def placed(names: Column) -> Column:
        return F.transform(F.slice(F.array_sort(F.array_distinct(names)), 1, keep), lambda x: F.struct(x.alias("x"), (F.array_position(names, x) - 1).cast("int").alias("at")))

    found = fragments.filter("n > 0").select("id", "n", F.explode(bind(F.transform(_strands(F.col("s"), k), named), placed)).alias("p"))
    return found.select("id", "n", F.shiftrightunsigned("p.x", 1).alias("kmer"), "p.at", (F.col("p.x").bitwiseAND(F.lit(1)) == 1).alias("turned"))


def diagonals(found: DataFrame, k: int, band: int) -> DataFrame:
    """(left, right, turned, from_left, from_right, to_left, to_right): for each fragment and each centre that it shares
    k-mers with, the ends of the run of shared k-mers on the diagonal that most of them are on.

    The centre of a k-mer is the longest fragment that has it (of equal ones the greatest id), so a k-mer of any number of
    fragments gives as many pairs as it has fragments. Shared k-mers vote for (centre, strand, diagonal), in steps of
    ``band`` letters; a vote counts for its step and the one before, so no run is cut by the steps.

    Seeds are shuffled once to find their centres, and what meets once more to be counted; only the seeds of frequent
    k-mers, which are no one task's, find theirs by an aggregate and a join.
    """
    found = save(found, "seeds")
    often = _frequent(found.select(F.col("id").alias("genome"), "kmer"), POSTINGS)
    centre = lambda of: of(F.struct("n", "id", "at", "turned"))
    rest = found
    if some := not often.isEmpty():
        rest = found.join(often, "kmer", "left_anti")
    met = rest.withColumn("c", centre(F.max).over(Window.partitionBy("kmer")))
    if some:
        common = found.join(often, "kmer", "left_semi")
        met = met.unionByName(common.join(save(common.groupBy("kmer").agg(centre(F.max).alias("c")), "centres"), "kmer"))
    met = met.filter("id <> c.id")
    width = F.least(F.lit(k), F.col("n"), F.col("c.n"))
    turned = F.col("turned") != F.col("c.turned")
    at = F.when(turned, F.col("n") - width - F.col("at")).otherwise(F.col("at"))  # in the orientation of the centre
    place = F.shiftleft(at.cast("long"), 32).bitwiseOR(F.col("c.at").cast("long"))  # in the order of (at, c.at)
    votes = met.select("id", F.col("c.id").alias("centre"), turned.alias("turned"), place.alias("x"), width.alias("w")).repartition("id", "centre")
    left, right = lambda x: F.shiftright(x, 32).cast("int"), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    step = F.floor((left(F.col("x")) - right(F.col("x"))) / band)
    lines = votes.withColumn("step", F.explode(F.array(step, step - 1))).groupBy("id", "centre", "turned", "step").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z"), F.max("w").alias("w"))
    best = lines.groupBy("id", "centre").agg(F.max_by(F.struct("turned", "a", "z", "w"), F.struct("n", ~F.col("turned"), -F.col("step"))).alias("b"))
    a, z = F.col("b.a"), F.col("b.z")
    return best.select(F.col("id").alias("left"), F.col("centre").alias("right"), "b.turned", left(a).alias("from_left"), right(a).alias("from_right"), (left(z) + F.col("b.w")).alias("to_left"), (right(z) + F.col("b.w")).alias("to_right"))


def aligned(runs: DataFrame, base: DataFrame, identity: float, coverage: float) -> DataFrame:
    """(left, right, strand, identity, left_coverage, right_coverage) of the runs whose alignment reaches the thresholds.

    A run of shared k-mers is extended to both ends of the shorter side, and each of the three parts aligned by banded
    edit distance, counted up to what the threshold allows. An end that is too different is left out of the span if the
    rest reaches the thresholds without it; of what does, the longest span counts. base: (id, s, n).
    """
    both = lambda f: {c: f(c) for c in ("left", "right")}
    for c in ("left", "right"):
        runs = runs.join(base.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")), c)
    runs = runs.withColumns({"before": F.least("from_left", "from_right"), "after": F.least(F.col("n_left") - F.col("to_left"), F.col("n_right") - F.col("to_right"))})
    size = both(lambda c: F.col(f"to_{c}") - F.col(f"from_{c}"))
    share = both(lambda c: (size[c] + F.col("before") + F.col("after")) / F.col(f"n_{c}"))
    pairs = runs.filter((share["left"] >= coverage) & (share["right"] >= coverage))  # before any text is fetched
    for c in ("left", "right"):
        pairs = pairs.join(base.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")), c)
    pairs = pairs.withColumn("s_left", F.when(F.col("turned"), S.reverse_complement(F.col("s_left"))).otherwise(F.col("s_left")))
    most = (F.ceil((F.greatest(*size.values()) + F.col("before") + F.col("after")) * (1 - identity)) + 1).cast("int")

    def edits(start, length) -> Column:
        """Of a part of both sides; -1 beyond ``most``."""
        return F.call_function("levenshtein", *[F.substring(f"s_{c}", (start(c) + 1).cast("int"), length(c).cast("int")) for c in ("left", "right")], most)

    parts = F.struct(
        edits(lambda c: F.col(f"from_{c}") - F.col("before"), lambda c: F.col("before")).alias("before"),
        edits(lambda c: F.col(f"from_{c}"), lambda c: size[c]).alias("run"),
        edits(lambda c: F.col(f"to_{c}"), lambda c: F.col("after")).alias("after"),
    )

    def span(d: Column, *ends: str) -> Column:
        whole = both(lambda c: sum((F.col(e) for e in ends), size[c]))
        changes = sum((d[e] for e in ends), d["run"])
        alike, covered = 1 - changes / F.greatest(*whole.values()), both(lambda c: whole[c] / F.col(f"n_{c}"))
        good = (alike >= identity - 1e-9) & (covered["left"] >= coverage) & (covered["right"] >= coverage)
        for part in ("run", *ends):
            good = good & (d[part] >= 0)
        return F.when(good, F.struct((whole["left"] + whole["right"]).alias("size"), alike.alias("identity"), covered["left"].alias("left_coverage"), covered["right"].alias("right_coverage")))

    best = bind(parts, lambda d: F.array_compact(F.array(F.greatest(span(d, "before", "after"), span(d, "before"), span(d, "after"), span(d)))))
    strand = F.when(F.col("turned"), "-").otherwise("+")
    return pairs.select("left", "right", strand.alias("strand"), F.explode(best).alias("best")).select("left", "right", "strand", "best.identity", "best.left_coverage", "best.right_coverage")


def near_clusters(fragments: DataFrame, identity: float = 0.95, coverage: float = 0.85, k: int = 21, keep: int = 80, band: int = 32, sequence: str = "sequence") -> DataFrame:
    """One row per fragment (id, sequence) with its class of near duplicates on either strand:

    id, class (the smallest id in it), centre (the fragment that it was aligned with; where there is none, the smallest id
    of its own sequence), strand (against the centre), identity, coverage and centre_coverage of that alignment, links
    (alignments that its sequence has in all), copies (fragments of the same sequence on either strand), first (the
    smallest id of them).

    Equal sequences meet first and count once. Others are linked to the centres of their k-mers, as in linear-time
    clustering, and the components of the links are the classes. An alignment counts by its span: ``identity`` of its
    letters and ``coverage`` of both fragments. Ids are unique and not null; null and empty sequences are a class of their
    own; a sequence of fewer than k letters has equal ones only. No k-mer's fragments are cut off; ``keep`` bounds the
    k-mers of a fragment.

    Distinct sequences are numbered in the order of their ids, so that their seeds, votes and links travel by numbers, of
    which the least and the greatest are those of the ids; only sequences that have links get names of others.
    """
    text = fragments.select("id", F.coalesce(F.col(sequence), F.lit("")).alias("_s")).withColumn("_r", S.reverse_complement(F.col("_s")))
    whole = text.select("id", (F.col("_s") > F.col("_r")).alias("turned"), F.least("_s", "_r").alias("s")).withColumn("key", F.unhex(F.sha2(F.col("s").cast("binary"), 256)))
    whole = save(whole, "fragments")
    # equal hashes are equal sequences, so any of them will do
    once = whole.groupBy("key").agg(F.min(F.struct("id", "turned")).alias("f"), F.first("s").alias("s"), F.count("*").alias("copies"))
    once = once.select("key", F.col("f.id").alias("first"), F.col("f.turned").alias("way"), "s", "copies", F.length("s").alias("n"))
    once = save(once.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "distinct-fragments")
    base = once.select("id", "s", "n")
    links = save(aligned(diagonals(seeds(base, k, keep), k, band), base, identity, coverage), "near-links")
    classes = connected_components(links, "left", "right").withColumnRenamed("node", "id")
    counts = links.select(F.explode(F.array("left", "right")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    best = links.groupBy(F.col("left").alias("id")).agg(F.max_by(F.struct("right", "strand", "identity", "left_coverage", "right_coverage"), F.struct("identity", "right_coverage", "right")).alias("b"))
    names = once.select("id", "first", "way")
    linked = save(classes.join(counts, "id").join(best, "id", "left").join(names, "id"), "linked-fragments")
    named = lambda c, *more: linked.select(F.col("id").alias(f"_{c}"), F.col("first").alias(c), *more)
    linked = linked.join(named("class"), F.col("component") == F.col("_class")).join(named("centre", F.col("way").alias("centre_way")), F.coalesce("b.right", "id") == F.col("_centre"))
    linked = save(linked.select("id", "class", "centre", "links", "b", "centre_way"), "linked-names")
    own = once.select("key", "id", "first", "way", "copies").join(linked, "id", "left").select(
        "key", "first", F.coalesce("class", "first").alias("class"), F.coalesce("centre", "first").alias("centre"), (F.coalesce("centre_way", "way") != F.coalesce(F.col("b.strand") == "-", F.lit(False))).alias("way"),
        F.coalesce("b.identity", F.lit(1.0)).alias("identity"), F.coalesce("b.left_coverage", F.lit(1.0)).alias("coverage"), F.coalesce("b.right_coverage", F.lit(1.0)).alias("centre_coverage"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), "copies",
    )
    strand = F.when(F.col("turned") != F.col("way"), "-").otherwise("+")
    return whole.select("id", "turned", "key").join(own, "key").select("id", "class", "centre", strand.alias("strand"), "identity", "coverage", "centre_coverage", "links", "copies", "first")


def cluster_edges(pairs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class_edges`` of the components of pairs (left, right)."""
    return class_edges(connected_components(pairs, "left", "right").withColumnRenamed("node", "id"), records)


def class_edges(groups: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of near fragments (id, component) as stars from their smallest record, and the records of mixed-label classes.

    records: (id, record_id, grp, label). Returns (left_group, right_group, reason) and (record_id, reason).
    """
    return member_edges(save(groups.join(records, "id"), "cluster-members"))


def member_edges(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class_edges`` of fragments that have both: (component, record_id, grp, label)."""
    head = save(members.groupBy("component").agg(F.min_by("grp", "record_id").alias("head"), F.min("label").alias("least"), F.max("label").alias("most")), "cluster-heads")
    both = members.join(head, "component")
    edges = both.filter("least = most AND grp <> head").select(F.least("grp", "head").alias("left_group"), F.greatest("grp", "head").alias("right_group"), F.lit("near_fragment").alias("reason")).distinct()
    return edges, both.filter("least < most").select("record_id", F.lit("cross_label_near_fragment").alias("reason")).distinct()


#: Genomes of a k-mer that meet as one block; two blocks are at most this squared many pairs.
POSTINGS = 256


def _candidates(kmers: DataFrame, sizes: DataFrame, least: float, postings: int) -> DataFrame:
    """(l, r), l < r: every pair that may share ``least`` of the k-mers of the one with fewer; sizes: (genome, k).

    Of a genome's k-mers, rarest first, all but that share less one are its prefix: a pair that shares so many has one of
    the prefix of the smaller in common. So k-mers that very many genomes have are mostly never looked up. The genomes of
    a k-mer are cut into blocks, and blocks meet two by two, so no k-mer is one task.
    """
    held = save(kmers.groupBy("kmer").agg(F.count("*").alias("g")).filter("g > 1"), "shared-kmers")
    shared = save(kmers.join(held, "kmer").join(sizes, "genome"), "shared-postings")
    own = Window.partitionBy("genome")
    blank = F.col("k") - F.count("*").over(own)  # k-mers of no other genome are the rarest
    rank = blank + F.row_number().over(own.orderBy("g", "kmer"))
    prefix = shared.withColumn("rank", rank).filter(F.col("rank") <= F.col("k") - F.ceil(F.col("k") * least * (1 - 1e-9)) + 1)
    blocks = F.ceil(F.col("g") / postings)
    block, every = F.pmod(F.xxhash64("genome"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    small = prefix.select("kmer", F.col("genome").alias("s"), F.col("k").alias("ks"), block.alias("a"), every.alias("b"))
    large = shared.select("kmer", F.col("genome").alias("t"), F.col("k").alias("kt"), block.alias("b"), every.alias("a"))
    met = small.join(large, ["kmer", "a", "b"]).filter("s <> t AND ks <= kt")
    return met.select(F.least("s", "t").alias("l"), F.greatest("s", "t").alias("r")).distinct()


def _drawn(postings: int) -> Column:
    """A part of the genomes that a hash draws."""
    return F.pmod(F.xxhash64("genome"), F.lit(drawn_part(postings))) == 0


def _frequent(rows: DataFrame, postings: int) -> DataFrame:
    """(kmer) that more than about ``postings`` genomes have, by the drawn ones: it decides how a k-mer's genomes meet,
    never whether they do."""
    some = rows.filter(_drawn(postings)).select("genome", "kmer").distinct()
    return save(some.groupBy("kmer").agg(F.count("*").alias("g")).filter(f"g > {OFTEN}").select("kmer"), "frequent-kmers")


def ani_edges(sketches: DataFrame, sizes: DataFrame, k: int = 21, ani: float = 0.95, fraction: float = 0.85, postings: int = POSTINGS) -> DataFrame:
    """Genome pairs i < j by shared k-mer hashes (published as FracMinHash containment): ANI is the containment to the
    power 1/k, the aligned fraction the share of windows in a collinear chain of shared k-mers, on the shorter genome.

    sketches: (genome, window, kmer), windows numbered along the genome; sizes: (genome, bp). Every pair that reaches the
    ANI is found (see ``_identity``). A genome's sketch is one row of a task. Genomes without k-mers have no pairs.
    """
    rows = sketches.select("genome", F.col("window").cast("long").alias("window"), F.col("kmer").cast("long").alias("kmer")).filter("genome IS NOT NULL AND window IS NOT NULL AND kmer IS NOT NULL")
    return _identity(rows.groupBy("genome").agg(F.collect_set(F.struct("window", "kmer")).alias("body")).join(sizes, "genome"), k, 1, ani, fraction, postings)


def spread(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """As many tasks as shuffles have, however few bytes come in, and ``least`` of them."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def genome_identity(genomes: DataFrame, k: int = 21, step: int = 1000, ani: float = 0.95, fraction: float = 0.85, postings: int = POSTINGS) -> DataFrame:
    """``ani_edges`` of normalised sequences (genome, sequence) by all their k-mers, in windows of ``step`` of them; several
    sequences of a genome number their windows alike, and equal ones are one. A genome's sequences are one row of a task."""
    bodies = spread(genomes.filter("genome IS NOT NULL"), "genome").groupBy("genome").agg(F.collect_set("sequence").alias("body"))
    length = F.aggregate("body", F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    return _identity(bodies.withColumn("bp", length), k, step, ani, fraction, postings)


#: K-mers that are told to all tasks as common ones, and k-mers that are sorted by one task.
COMMON, SORTED = 1 << 20, 1 << 21


def _identity(bodies: DataFrame, k: int, step: int, ani: float, fraction: float, postings: int) -> DataFrame:
    """``ani_edges`` of (genome, body, bp): see ``genome_batches``.

    A pair that reaches the ANI shares some share of the k-mers of the one with fewer. So in any order of the k-mers, it
    shares the first of them within either genome's prefix, all its k-mers but that share less LINKS: only these are
    shuffled to the k-mers, where they are sorted and genomes meet, and only pairs that share LINKS of them get their
    bodies, for all k-mers and the chain. K-mers that many genomes have are the last in the order, by the drawn genomes;
    that changes how much is looked at, never what is found. Those that are often meet in blocks, so no k-mer is one task.
    """
    spark, least = bodies.sparkSession, ani**k
    ship(spark)
    kind = bodies.schema["genome"].dataType.simpleString()
    bodies = save(bodies.select("genome", "body", "bp"), "genome-bodies")
    draws = save(spread(bodies, "genome").select("body", _drawn(postings).alias("drawn")).mapInArrow(draw_rows(k, step), "kmer long, n long, total long"), "genome-draws")
    (fewest, total), common = draws.agg(F.coalesce(F.min("n"), F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first(), _common(draws)
    tasks = total // SORTED + 1
    told = spark.sparkContext.broadcast(common)
    posted = spread(bodies, "genome").select("genome", F.hash("genome").cast("long").alias("draw"), "body").mapInArrow(posting_rows(k, step, least, fewest, told, postings), f"genome {kind}, place long, n long, pos long, block long")
    pairs = spread(posted, "place", least=tasks).sortWithinPartitions("place").mapInArrow(pair_rows(least), f"l {kind}, r {kind}, need long")
    pairs = spread(pairs, "l", "r", least=tasks).groupBy("l", "r").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("l", "r")
    for c in "lr":
        pairs = spread(pairs, c).join(bodies.select(F.col("genome").alias(c), F.col("body").alias(f"body_{c}")), c)
    shared = pairs.select("l", "r", "body_l", "body_r").mapInArrow(identity_rows(k, step), f"l {kind}, r {kind}, k_l long, k_r long, common long, w_l long, w_r long, hit_l long, hit_r long")
    near = shared.withColumn("ani", F.pow(F.col("common") / F.least("k_l", "k_r"), F.lit(1 / k))).filter(F.col("ani") >= ani)
    for c in "lr":
        near = near.join(bodies.select(F.col("genome").alias(c), F.col("bp").alias(f"bp_{c}")), c)
    scored = near.select(
        F.col("l").alias("left_genome"), F.col("r").alias("right_genome"), "ani", (F.col("hit_l") / F.col("w_l")).alias("af_left"),
        (F.col("hit_r") / F.col("w_r")).alias("af_right"), F.col("bp_l").alias("left_bp"), F.col("bp_r").alias("right_bp"),
    )
    shorter = F.when(F.col("left_bp") <= F.col("right_bp"), F.col("af_left")).otherwise(F.col("af_right"))
    return scored.withColumn("af_shorter", shorter).filter(F.col("af_shorter") >= fraction)


def _common(draws: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers that most drawn genomes have, COMMON at most and three genomes at least, sorted, and how many have them."""
    counts = save(draws.filter("kmer IS NOT NULL").groupBy("kmer").agg(F.count("*").alias("g")).filter("g > 2"), "common-kmers")
    least, held = None, 0
    for r in counts.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("g")).toLocalIterator():
        held += r.n
        if held > COMMON:
            break
        least = r.g
    found = [counts.filter(F.col("g") >= least).toArrow()[c].to_numpy() for c in ("kmer", "g")] if least else [np.empty(0, np.int64)] * 2
    order = np.argsort(found[0])
    return found[0][order], found[1][order]


def mutate(sequence: str, rate: float, seed: int) -> str:
    """A copy with substitutions, for planted tests."""
    rng = np.random.default_rng(seed)
    letters = np.array(list(sequence))
    at = rng.random(len(letters)) < rate
    letters[at] = rng.choice(list("ACGT"), at.sum())
    return "".join(letters)


def planted(n: int, length: int, rate: float, seed: int = 0) -> pd.DataFrame:
    """n random fragments, each followed by a mutated copy, every second one on the other strand."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = "".join(rng.choice(list("ACGT"), length))
        other = mutate(s, rate, seed + i)
        rows += [(2 * i, s), (2 * i + 1, other if i % 2 else other[::-1].translate(str.maketrans("ACGT", "TGCA")))]
    return pd.DataFrame(rows, columns=["id", "sequence"])
