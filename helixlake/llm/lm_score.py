"""LM scoring: stupid backoff, with counts from the whole corpus.

The score of a word is count(n-gram) / count(its context) for the longest n-gram that occurs, times ``alpha`` for each
word of context given up. Counts leave out the document that is scored, else each n-gram would support itself.

N-gram count tables are partitioned by hash; documents are exploded into n-grams, counted by group of documents before
they are dealt by hash, joined with the count tables there (lookups.py, as rows or as frames), and go back to their
group, which sums the logarithms per document. Words and pairs are asked for first. A longer n-gram can be in another
document only if both n-grams inside it that are one word shorter are, so only those are asked for, which changes no
count.

Defined results: words are those of words.py; a word that no other document has counts as one of n + 1 words (n: the
others' words); a null or wordless text has n_words 0 and null scores; rows are scored separately even if they are
equal, and equal rows are each other's "other documents" (those equal in key too share a group); a very long text is a
group of its own, held by one task in some 60 bytes a word; other columns are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookups
from .common import table, trim
from .words import chunks, ngrams, text_buffer, tokenise

#: The key under which the number of words is counted.
ALL = np.uint64(0)


class Grams:
    """The n-grams of a group's texts for one n: distinct keys in order, and for each n-gram its key's place, how often
    its own row has it, and the word it ends at."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, words: np.ndarray, n: int):
        order = np.argsort(hashes, kind="stable")  # rows stay in order within a key
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        s, r = hashes[order], row[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        run = first.copy()
        run[1:] |= r[1:] != r[:-1]
        self.keys = s[first]
        self.counts = np.diff(np.append(np.flatnonzero(first), len(s)))
        self.place = np.empty(len(s), np.int32)
        self.place[order] = np.cumsum(first) - 1
        begins = np.flatnonzero(run)
        lengths = np.diff(np.append(begins, len(s)))
        self.own = np.empty(len(s), np.int32)
        self.own[order] = np.repeat(lengths, lengths)
        self.end = (np.arange(len(s)) + np.repeat(words[:-1] - bounds[:-1], sizes) + (n - 1)).astype(np.int32)

    def others(self, totals: np.ndarray, n_words: int) -> np.ndarray:
        """Counts without the own row, at the word each n-gram ends at; 0 elsewhere."""
        out = np.zeros(n_words, np.float64)
        out[self.end] = totals[self.place].astype(np.float64) - self.own
        return out


class Texts:
    """A group's texts: n-grams are made when they are needed, as they take much memory."""

    def __init__(self, group: pa.Table):
        raw, off = text_buffer(group["text"].combine_chunks())
        found = [tokenise(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in chunks(off)]
        self.words = np.concatenate([x[0] for x in found])
        self.bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[1]) for x in found])))).astype(np.int64)

    def grams(self, n: int) -> Grams:
        return Grams(*ngrams(self.words, self.bounds, n), self.bounds, n)


def _first_keys(one: Grams, two: Grams, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, counts, their order) of what is asked for first: the number of words, words and pairs."""
    keys = np.concatenate(([ALL], one.keys, two.keys))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate(([n_words], one.counts, two.counts))[order], order


def _wanted(grams: Grams, shorter: np.ndarray) -> np.ndarray:
    """Which keys may be in other documents, as the two shorter n-grams inside are (by the word they end at)."""
    out = np.zeros(len(grams.keys), bool)
    out[grams.place[(shorter[grams.end] > 0) & (shorter[grams.end - 1] > 0)]] = True
    return out


def _counts(texts: Texts, replies: pa.Table, orders: int):
    """[words of all documents, then for each order up to ``orders`` the counts in other documents by the word an n-gram ends at]."""
    stage = replies["stage"].to_numpy()
    one, two, n_words = texts.grams(1), texts.grams(2), len(texts.words)
    keys, counts, order = _first_keys(one, two, n_words)
    totals = np.empty(len(order), np.uint64)
    totals[order] = lookups.answers(replies.filter(pa.array(stage == 2)), keys) + counts.astype(np.uint64)
    split = 1 + len(one.keys)
    found = [float(totals[0]), one.others(totals[1:split], n_words), two.others(totals[split:], n_words)]
    for n in range(3, orders + 1):
        grams = texts.grams(n)
        asked = _wanted(grams, found[-1])
        every = np.zeros(len(asked), np.uint64)
        every[asked] = lookups.answers(replies.filter(pa.array(stage == n)), grams.keys[asked]) + grams.counts[asked].astype(np.uint64)
        known = np.where(asked[grams.place], every[grams.place].astype(np.float64) - grams.own, 0.0)
        counts = np.zeros(n_words)
        counts[grams.end] = known
        found.append(counts)
    return found


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, key: str = "doc_id", text: str = "text", bytes_per_group: int = 8 << 20, rows: bool | None = None) -> DataFrame:
    """One row per document: key, n_words, log_score (sum of natural logarithms), score (mean per word).

    rows: whether n-grams are exchanged as rows or as frames; by default rows beyond lookups.FRAMES groups, where frames
    would hold few keys. The results are the same.
    """
    assert order >= 2, "backoff needs a context"
    dealt, groups = lookups.grouped(docs, key, text, bytes_per_group)
    kind = docs.schema[key].dataType.simpleString()
    by_rows = groups > lookups.FRAMES if rows is None else rows
    form = lookups.ROWS if by_rows else lookups.ASK

    def put(grp: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        return lookups.ask_rows(grp, keys, counts) if by_rows else lookups.ask(grp, keys, counts, groups)

    def first(group: pa.Table) -> pa.Table:
        texts = Texts(group)
        keys, counts, _ = _first_keys(texts.grams(1), texts.grams(2), len(texts.words))
        return put(group["grp"][0].as_py(), keys, counts)

    def longer(n: int):
        def ask(group: pa.Table, replies: pa.Table) -> pa.Table:
            texts = Texts(group)
            shorter = _counts(texts, replies, n - 1)[-1]
            grams = texts.grams(n)
            asked = _wanted(grams, shorter)
            return put(group["grp"][0].as_py(), grams.keys[asked], grams.counts[asked])

        return ask

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts = Texts(group)
        every, *left = _counts(texts, replies, order)
        sizes = np.diff(texts.bounds)
        others = every - np.repeat(sizes, sizes)  # words of all other documents
        place = np.minimum(np.arange(len(others)) - np.repeat(texts.bounds[:-1], sizes), order - 1)
        log = np.log(alpha) * place + np.where(left[0] > 0, np.log(np.maximum(left[0], 1)) - np.log(np.maximum(others, 1)), -np.log(others + 1))
        for n in range(1, order):
            seen = np.flatnonzero(left[n] > 0)
            context = left[n - 1][seen - 1]  # it ends one word earlier
            log[seen] = np.log(alpha) * (place[seen] - n) + np.log(left[n][seen]) - np.log(context)
        none = sizes == 0
        trim()
        sums = np.add.reduceat(np.append(log, 0.0), texts.bounds[:-1]) * ~none
        return pa.table({key: group["id"].combine_chunks(), "n_words": pa.array(sizes), "log_score": pa.array(sums, mask=none), "score": pa.array(sums / np.maximum(sizes, 1), mask=none)})

    by_group = dealt.groupBy("grp")

    def answered(asked: DataFrame, n: int) -> DataFrame:
        found = lookups.count_tables(asked) if by_rows else asked.groupBy("bucket").applyInArrow(lookups.sum_bucket, lookups.ANSWER)
        return found.withColumn("stage", F.lit(n))

    replies = answered(by_group.applyInArrow(first, form), 2)
    for n in range(3, order + 1):
        replies = replies.unionByName(answered(by_group.cogroup(replies.groupBy("grp")).applyInArrow(longer(n), form), n))
    return by_group.cogroup(replies.groupBy("grp")).applyInArrow(finish, f"{key} {kind}, n_words long, log_score double, score double")


def op1_lm_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "round(score, 6) AS score")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, len(w) AS k, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, k, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3 FROM t),
c AS (SELECT doc_id, k, i, count(*) OVER () - k AS others,
  count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
  CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) END AS c2,
  CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) END AS c3 FROM g),
p AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM c),
s AS (SELECT doc_id, k, CASE
  WHEN c3 > 0 THEN ln(c3) - ln(p2)
  WHEN c2 > 0 THEN ln(0.4) * (least(2, i - 1) - 1) + ln(c2) - ln(p1)
  WHEN c1 > 0 THEN ln(0.4) * least(2, i - 1) + ln(c1) - ln(others)
  ELSE ln(0.4) * least(2, i - 1) - ln(others + 1) END AS l FROM p)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(sum(s.l) / len(d.w), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.w
"""
