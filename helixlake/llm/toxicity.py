"""Toxicity: maximum-scoring segments of token log-odds with Dirichlet priors, calibrated by extreme-value statistics.

Fit, on at most ``sample`` labelled rows of ``sample_bytes`` in all (chosen by a hash of the id; copies of a text count
once; a text of more than ``sample_bytes`` by itself is skipped), in FOLDS folds:

1. Log-odds of toxic against other documents for each word, with Dirichlet priors in levels: the whole corpus is the
   prior of a word's first 4 bytes, those of its first 6, and those of the word. Each estimate is drawn back by its
   standard error. A fixed cost per word keeps the mean negative. Each fold has a model of all other folds for what
   follows; the model of all folds scores new texts.
2. lambda and K of Karlin and Altschul from the scores in documents that are not toxic: lambda as the root of its
   equation, K by maximum likelihood of the documents' best segments. Then the logistic curve from a document's
   calibrated segments (best, sum above chance, sum, number, words) to its label. For the curve alone, repeats of a
   word in a text count less and less, with a lambda and K of their own.

Score: one linear scan of each whole text finds all its maximal scoring segments (Ruzzo and Tompa); a segment of score
S among m words has E-value K m exp(-lambda S), and those below ``significance`` are reported as toxic passages,
wherever in the text they are and however often its words came before.

Defined results: a null text is an empty one, and wordless texts have no passages and the curve's score for none;
labels other than 0 and 1 are left out, an id labelled twice is toxic if one label says so; without labels of both
kinds every score is the share of toxic labels (0 if there are none); an empty table gives no rows. Rows are scored by
their text alone, so equal texts score equally. A very long text is scanned in one task, in some 100 bytes a byte of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .common import table, tidy, uniform
from .words import chunks, text_buffer, tokenise

PREFIXES = (4, 6)
#: Strength of the prior of each level, in documents.
PRIOR = 4.0
#: What each word costs a segment. This and the features below were chosen by repeated splits of labelled rows that are
#: not held out.
COST = 0.3
FOLDS = 5
#: Words in fewer documents than this, none of them toxic, are left to their prefix.
RARE = 3
#: Where scores above 0 are so rare that the root is greater, E-values stay on the safe side.
HIGHEST_LAMBDA = 1.5
FEATURES = 5


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


@dataclass
class Model:
    keys: list[np.ndarray] = field(default_factory=lambda: [np.empty(0, np.uint64)] * 3)  # sorted hashes of words, 6- and 4-byte prefixes
    odds: list[np.ndarray] = field(default_factory=lambda: [np.empty(0)] * 3)
    lam: float = 1.0  # lambda and K of the scores as they are, for passages
    k: float = 1.0
    damped_lam: float = 1.0  # of the damped scores, for the curve
    damped_k: float = 1.0
    curve: np.ndarray | None = None
    base: float = 0.0

    def scores(self, words: np.ndarray, heads: list[np.ndarray]) -> np.ndarray:
        """Score of each word: its own log-odds if known, else its longest known prefix's, less the cost."""
        out = np.zeros(len(words))
        todo = np.arange(len(words))
        for keys, odds, values in zip(self.keys, self.odds, (words, heads[1], heads[0]), strict=True):
            if not len(keys) or not len(todo):
                continue
            v = values[todo]
            at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
            known = keys[at] == v
            out[todo[known]] = odds[at[known]]
            todo = todo[~known]
        return out - COST

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def damped(s: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The r-th occurrence of a word in a text counts 1 / r of its log-odds: words come in bursts, and a text that
    repeats one says little more by it."""
    at = np.flatnonzero(s > 0)
    if len(at):
        row = np.searchsorted(bounds, at, side="right")
        order = np.lexsort((at, words[at], row))
        w, r = words[at][order], row[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])))
        begin = np.flatnonzero(new)
        times = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
        s[at[order]] = (s[at[order]] + COST) / times - COST
    return s


def maximal_segments(positive: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa: all maximal scoring segments (first, last, score), given the places of the positive scores and
    the running sum before and after each."""
    held: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    for at, low, high in zip(positive, before, after, strict=True):
        first, last = at, at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= high:
                held.append((first, last, low, high))
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, h - l) for a, b, l, h in held]


def segments(s: np.ndarray, bounds: np.ndarray, lam: float):
    """For each text: (its words, maximal segments, their scores times lambda)."""
    run = np.concatenate(([0.0], np.cumsum(s)))
    plus = np.flatnonzero(s > 0)
    cut = np.searchsorted(plus, bounds)
    for i in range(len(bounds) - 1):
        m = int(bounds[i + 1] - bounds[i])
        at = plus[cut[i] : cut[i + 1]]
        found = maximal_segments((at - bounds[i]).tolist(), run[at].tolist(), run[at + 1].tolist()) if len(at) else []
        yield m, found, [lam * x for *_, x in found]


def features(m: int, scores: list[float], k: float) -> tuple[float, ...]:
    """What the curve sees of a text: -ln E of its best segment, sum of -ln E above 0, words, sum of scores, segments."""
    chance = math.log(max(m, 1) * k)
    above = sum(x - chance for x in scores if x > chance)
    return max(scores, default=0.0) - chance, math.log1p(above), math.log1p(m), math.log1p(sum(scores)), math.log1p(len(scores))


def scan(column: pa.Array, model: Model, significance: float = 0.05, passages: bool = True):
    """For each text: (features, [(first word, last word, score, E-value)]); the lists are empty unless passages are asked for."""
    raw, off = text_buffer(column)
    for a, b in chunks(off):
        words, bounds, heads = tokenise(raw[off[a] : off[b]], off[a : b + 1] - off[a], PREFIXES)
        s = model.scores(words, heads)
        seen = [[] for _ in range(b - a)]
        if passages:
            each = [(found, [model.k * m * math.exp(-min(n, 700)) for n in scores]) for m, found, scores in segments(s, bounds, model.lam)]
            seen = [[(f, last, x, e) for (f, last, x), e in zip(found, values, strict=True) if e < significance] for found, values in each]
        for (m, _, scores), out in zip(segments(damped(s, words, bounds), bounds, model.damped_lam), seen, strict=True):
            yield features(m, scores, model.damped_k), out


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, sample_bytes: int) -> DataFrame:
    """(text, toxic, fold): the bounded sample, one row per distinct text."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    chosen = known.withColumn("_u", uniform(F.col(key).cast("string"), F.lit("sample"))).orderBy("_u", key).limit(sample)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen.select(key, "toxic", "_u")), key)
    once = rows.withColumn("_t", F.xxhash64("text")).groupBy("_t").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("_u").alias("_u"))
    once = save(once.select("text", "toxic", "_u", F.pmod(F.col("_t"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    size = F.octet_length("text").cast("long")
    if (once.agg(F.sum(size)).first()[0] or 0) > sample_bytes:
        once = once.filter(size <= sample_bytes)  # a text beyond the bound by itself is skipped, not all after it
        run = F.sum("size").over(Window.orderBy("_u"))  # over a bounded number of rows
        last = once.select("_u", size.alias("size")).withColumn("run", run).filter(F.col("run") <= sample_bytes).agg(F.max("_u")).first()[0]
        once = once.filter(F.col("_u") <= F.lit(-1.0 if last is None else last))
    return once.select("text", "toxic", "fold")


#: (keys, parent keys, toxic documents, documents) of the levels word, 6 bytes, 4 bytes.
Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _counts(rows: DataFrame) -> list[Levels]:
    """The counts of all rows, and then without each fold."""

    def count(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            toxic, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for a, b in chunks(off):
                words, bounds, heads = tokenise(raw[off[a] : off[b]], off[a : b + 1] - off[a], PREFIXES)
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                for level, (keys, parent) in enumerate(((words, heads[1]), (heads[1], heads[0]), (heads[0], heads[0]))):
                    if len(keys):
                        at = np.unique(np.stack([row.astype(np.uint64), keys]), axis=1, return_index=True)[1]  # once a document
                        fold, label = folds[a:b][row[at]], toxic[a:b][row[at]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(keys[at].view(np.int64)), pa.array(parent[at].view(np.int64)), pa.array(fold.astype(np.int32)), pa.array(label.astype(np.int64))], ["level", "key", "parent", "fold", "t"])

    seen = rows.select("text", "toxic", "fold").mapInArrow(tidy(count), "level int, key long, parent long, fold int, t long")
    by_fold = seen.groupBy("level", "key", "parent", "fold").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    each = F.array_agg(F.struct("fold", "t", "n")).alias("each")
    found = by_fold.groupBy("level", "key", "parent").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), each)
    # a word that is rare and never toxic is left to its prefix
    found = found.filter((F.col("level") > 0) | (F.col("t") > 0) | (F.col("n") >= RARE)).orderBy("level", "key").toArrow().combine_chunks()
    number = lambda name: found[name].to_numpy()
    entries = found["each"].combine_chunks()
    owner = np.repeat(np.arange(found.num_rows), np.diff(entries.offsets.to_numpy()))
    fold, t, n = (entries.flatten().field(i).to_numpy() for i in range(3))
    out = []
    for k in (None, *range(FOLDS)):
        left = (fold == k) if k is not None else np.zeros(len(fold), bool)
        toxic, every = (number(c) - np.bincount(owner[left], weights=x[left], minlength=found.num_rows) for c, x in (("t", t), ("n", n)))
        levels = []
        for level in range(3):
            own = (number("level") == level) & (every > 0)
            keys = number("key")[own].view(np.uint64)
            order = np.argsort(keys)
            levels.append((keys[order], number("parent")[own].view(np.uint64)[order], toxic[own][order].astype(float), every[own][order].astype(float)))
        out.append(levels)
    return out


def _log_odds(levels, base: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Shrunken log-odds against the base, by level; the prior of a level is the estimate of its parent."""
    keys, odds = [None] * 3, [None] * 3
    above_keys, above = None, None
    for level in (2, 1, 0):
        key, parent, t, n = levels[level]
        prior = np.full(len(key), base)
        if above_keys is not None and len(above_keys):
            at = np.minimum(np.searchsorted(above_keys, parent), len(above_keys) - 1)
            prior = np.where(above_keys[at] == parent, above[at], base)
        yes, no = t + PRIOR * prior, n - t + PRIOR * (1 - prior)
        q = yes / (yes + no)
        raw = np.log(q / (1 - q)) - math.log(base / (1 - base))
        error = np.sqrt(1 / yes + 1 / no)
        # towards what the prior says, by one standard error
        start = np.log(prior / (1 - prior)) - math.log(base / (1 - base))
        odds[level] = np.where(raw > start, np.maximum(start, raw - error), np.minimum(start, raw + error))
        keys[level], above_keys, above = key, key, np.clip(1 / (1 + np.exp(-(odds[level] + math.log(base / (1 - base))))), 1e-6, 1 - 1e-6)
    return keys, odds


def karlin_lambda(points: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * point)) = 1, at most HIGHEST_LAMBDA."""
    low, high = 0.0, HIGHEST_LAMBDA
    if (share * np.exp(high * points)).sum() > 1:
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if (share * np.exp(mid * points)).sum() < 1 else (low, mid)
    return max(0.05, high)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def karlin_k(best: float, none: float, found: float) -> float:
    """K by maximum likelihood: ``found`` documents have segments, and ``best`` is the sum of m exp(-lambda S) of their
    best ones; ``none`` is the words of the documents without."""
    return max(found, 1.0) / max(best + none, 1e-9)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, sample_bytes: int = 1 << 28) -> Model:
    rows = _labelled(docs, labels, key, text, label, sample, sample_bytes)
    size = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    number = lambda toxic, without=None: sum(n for (f, t), n in size.items() if t == toxic and f != without)
    yes, no = number(1), number(0)
    model = Model(base=yes / (yes + no) if yes + no else 0.0)
    if any(not number(t, f) for t in (0, 1) for f in range(FOLDS)):
        return model
    bases = [yes / (yes + no), *(number(1, f) / (number(1, f) + number(0, f)) for f in range(FOLDS))]
    (model.keys, model.odds), *others = (_log_odds(levels, base) for levels, base in zip(_counts(rows), bases, strict=True))
    folds = docs.sparkSession.sparkContext.broadcast([Model(keys, odds) for keys, odds in others])  # bounded by the sample

    def scored(batch: pa.RecordBatch):
        """(words, bounds, scores, places of the rows) of the batch's texts by the models that have not seen them."""
        fold = batch.column(1).to_numpy(zero_copy_only=False)
        for f, held in enumerate(folds.value):
            mine = np.flatnonzero(fold == f)
            raw, off = text_buffer(batch.column(0).take(pa.array(mine)))
            for a, b in chunks(off):
                words, bounds, heads = tokenise(raw[off[a] : off[b]], off[a : b + 1] - off[a], PREFIXES)
                yield words, bounds, held.scores(words, heads), mine[a:b]

    def histogram(batches):  # of the scores, as they are and damped
        for batch in batches:
            total = np.zeros((2, 4001))
            for words, bounds, s, _ in scored(batch):
                for damp in (0, 1):
                    s = damped(s, words, bounds) if damp else s
                    total[damp] += np.bincount(np.clip(np.rint(s * 100) + 2000, 0, 4000).astype(np.int64), minlength=4001)
            damp, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(damp.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(total[damp, at].astype(np.int64))], ["damp", "at", "n"])

    clean = rows.filter("toxic = 0").select("text", "fold")
    points = clean.mapInArrow(tidy(histogram), "damp int, at long, n long").groupBy("damp", "at").agg(F.sum("n").alias("n")).toPandas()

    def root(damp: int) -> float:
        part = points[points["damp"] == damp]
        return karlin_lambda((part["at"].to_numpy() - 2000) / 100, part["n"].to_numpy() / max(1, part["n"].sum()))

    lams = root(0), root(1)

    def extremes(batches):
        for batch in batches:
            total = np.zeros((2, 3))
            for words, bounds, s, _ in scored(batch):
                for damp in (0, 1):
                    s = damped(s, words, bounds) if damp else s
                    for m, _, scores in segments(s, bounds, lams[damp]):
                        total[damp] += (m * math.exp(-max(scores)), 0, 1) if scores else (0, m, 0)
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), *(pa.array(total[:, i]) for i in range(3))], ["damp", "best", "none", "found"])

    sums = clean.mapInArrow(tidy(extremes), "damp int, best double, none double, found double").groupBy("damp").agg(*(F.sum(c).alias(c) for c in ("best", "none", "found"))).collect()
    ks = {r["damp"]: karlin_k(r["best"], r["none"], r["found"]) for r in sums}
    model.lam, model.damped_lam, model.k, model.damped_k = *lams, ks[0], ks[1]

    def seen(batches):
        for batch in batches:
            x, place = [], []
            for words, bounds, s, rows_ in scored(batch):
                x += [features(m, scores, model.damped_k) for m, _, scores in segments(damped(s, words, bounds), bounds, model.damped_lam)]
                place.append(rows_)
            toxic = batch.column(2).take(pa.array(np.concatenate(place) if place else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(FEATURES)), toxic], [*(f"x{i}" for i in range(FEATURES)), "toxic"])

    names = [f"x{i}" for i in range(FEATURES)]
    curve = rows.select("text", "fold", "toxic").mapInArrow(tidy(seen), ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas().sort_values([*names, "toxic"])
    model.curve = logistic(curve[names].to_numpy(), curve["toxic"].to_numpy().astype(float))
    folds.unpersist()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7, passages: bool = True, prefix: str = "", keep_text: bool = False) -> DataFrame:
    """All columns of docs (its text only if asked for), with score, predicted and passages (words first to last, score, E-value).

    A column of docs that has the name of a result is replaced by it; a prefix for the results' names avoids that.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample
    results = [prefix + x for x in ("score", "predicted", "passages")[: 2 + passages]]
    rest = [c for c in docs.columns if c != text and c not in results]
    out = [text, *rest] if keep_text else rest
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in out)
    part = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        for batch in batches:
            seen = list(scan(batch.column(0), held.value, passages=passages))
            p = held.value.probability(np.array([f for f, _ in seen], float).reshape(-1, FEATURES))
            columns = [*batch.columns[0 if keep_text else 1 :], pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            if passages:
                columns.append(pa.array([[dict(zip(("first", "last", "score", "e_value"), x, strict=True)) for x in found] for _, found in seen], pa.list_(part)))
            yield pa.RecordBatch.from_arrays(columns, [*out, *results])

    types = ("double", "int", "array<struct<first: int, last: int, score: double, e_value: double>>")
    return docs.select(text, *rest).mapInArrow(tidy(run), kinds + ", ".join(f"{n} {t}" for n, t in zip(results, types, strict=False)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", fit_on: DataFrame | None = None) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    model = fit(docs if fit_on is None else fit_on, labels, key, text)
    scored = score(docs, model, key, text, threshold, passages=False, prefix="_toxic_", keep_text=True)
    return scored.filter("_toxic_predicted = 0").select(*docs.columns)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
