"""The whole score in plain Python, on a small table: counts, shrunken log-odds in levels, segments, lambda, K, curve."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from helixlake.llm import toxicity

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLDS, PRIOR, COST, RARE = toxicity.FOLDS, toxicity.PRIOR, toxicity.COST, toxicity.RARE


def words(text):
    return WORD.findall((text or "").encode().lower())


def keys(word):
    """Its levels: the word, its first 6 bytes, its first 4."""
    return ("w", word), ("6", word[:6]), ("4", word[:4])


def log_odds(rows, base, shared):
    """(level key) -> shrunken log-odds; ``shared`` are the words that are kept as such."""
    seen, toxic = Counter(), Counter()
    for text, label in rows:
        for key in {k for w in words(text) for k in keys(w)}:
            seen[key] += 1
            toxic[key] += label
    logit = lambda p: math.log(p / (1 - p))
    out = {}

    def estimate(key, prior):
        t, n = toxic[key], seen[key]
        yes, no = t + PRIOR * prior, n - t + PRIOR * (1 - prior)
        raw, start, error = math.log(yes / no) - logit(base), logit(prior) - logit(base), math.sqrt(1 / yes + 1 / no)
        return max(start, raw - error) if raw > start else min(start, raw + error)

    back = lambda o: min(max(1 / (1 + math.exp(-(o + logit(base)))), 1e-6), 1 - 1e-6)
    for w in {w for text, _ in rows for w in words(text)}:
        a, b, c = keys(w)
        out[c] = estimate(c, base)
        out[b] = estimate(b, back(out[c]))
        if w in shared:
            out[a] = estimate(a, back(out[b]))
    return out


def scores(ws, odds, damp):
    out, times = [], Counter()
    for w in ws:
        s = next((odds[k] for k in keys(w) if k in odds), 0.0) - COST
        if damp and s > 0:
            times[w] += 1
            s = (s + COST) / times[w] - COST
        out.append(s)
    return out


def segments(s):
    """Maximal segments by their definition: repeatedly the best one, then what lies left and right of it."""
    if not any(x > 0 for x in s):
        return []
    best = max(((sum(s[a:z]), -(z - a), -a) for a in range(len(s)) for z in range(a + 1, len(s) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
    total, length, start = best[0], -best[1], -best[2]
    return [*segments(s[:start]), total, *segments(s[start + length :])]


def features(found, m, k):
    chance = math.log(max(m, 1) * k)
    return max(found, default=0.0) - chance, math.log1p(sum(x - chance for x in found if x > chance)), math.log1p(m), math.log1p(sum(found)), math.log1p(len(found))


def test_scores_equal_plain_python(spark):
    rnd = random.Random(12)
    calm, rude = ["apple", "river", "stone", "cloud", "green", "house", "über", "walk1"], ["nastyone", "nastytwo", "vileword", "rotten"]
    docs = []
    for i in range(260):
        bad = rnd.random() < 0.35
        text = " ".join(rnd.choice(rude if bad and rnd.random() < 0.4 else calm) for _ in range(rnd.randint(1, 14)))
        docs.append((i, text, int(bad)))
    docs += [(1000, None, 0), (1001, "", 1), (1002, "neverseen nastythree", 0)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}

    once = {}
    for i, text, t in docs:
        if not held(i):
            once[text or ""] = max(t, once.get(text or "", 0))
    fold = {r.t: r.f for r in spark.createDataFrame([(x,) for x in once], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).alias("f")).collect()}
    rows = [(text, t, fold[text]) for text, t in once.items()]
    seen, bad = Counter(), Counter()
    for text, t, _ in rows:
        for w in set(words(text)):
            seen[w] += 1
            bad[w] += t
    shared = {w for w in seen if bad[w] > 0 or seen[w] >= RARE}
    share = lambda some: sum(t for _, t, *_ in some) / len(some)
    models = {f: log_odds([(x, t) for x, t, g in rows if g != f], share([r for r in rows if r[2] != f]), shared) for f in range(FOLDS)}
    points = Counter(round(s * 100) for x, t, f in rows if not t for s in scores(words(x), models[f], True))
    n = sum(points.values())
    low, high = 0.0, toxicity.HIGHEST_LAMBDA
    value = lambda lam: sum(c / n * math.exp(lam * p / 100) for p, c in points.items())
    if value(high) > 1:
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if value(mid) < 1 else (low, mid)
    lam = max(0.05, high)
    total, hits = 0.0, 0
    for x, t, f in rows:
        if not t:
            found = [lam * s for s in segments(scores(words(x), models[f], True))]
            total += len(words(x)) * (math.exp(-max(found)) if found else 1)
            hits += bool(found)
    k = max(hits, 1) / max(total, 1e-9)
    x = np.array([features([lam * s for s in segments(scores(words(t), models[f], True))], len(words(t)), k) for t, _, f in rows])
    curve = toxicity.logistic(x, np.array([float(t) for _, t, _ in rows]))
    whole = log_odds([(t, y) for t, y, _ in rows], share(rows), shared)
    worst = defaultdict(float)
    for i, text, _ in docs:
        f = np.array(features([lam * s for s in segments(scores(words(text), whole, True))], len(words(text)), k))
        worst[i] = abs(1 / (1 + math.exp(-float(np.clip(curve[0] + f @ curve[1:], -30, 30)))) - got[i])
    assert max(worst.values()) < 1e-6, max(worst.items(), key=lambda v: v[1])
    assert len({round(v, 3) for v in got.values()}) > 20 and hashlib.sha256(b"").hexdigest()  # scores differ


def test_a_text_beyond_the_bound_is_skipped_alone(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * (3 + i % 5) + str(i)) for i in range(300)] + [(i, f"long{i} " * 5000) for i in range(300, 304)], "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, marks, sample_bytes=20_000)
    assert model.curve is not None and 0.3 < model.base < 0.7
