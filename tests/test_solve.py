"""Folds and decoded structures against all nested structures of short sequences."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.functions.expr import PAIRS
from helixmill.operators import features, solve


def structures(seq, i=0):
    """All nested structures with complementary pairs over at least three positions."""
    n = len(seq)

    def of(a, b):
        if b < a:
            return [frozenset()]
        out = list(of(a + 1, b))
        for k in range(a + 4, b + 1):
            if seq[a] + seq[k] in PAIRS:
                out += [x | y | {(a + 1, k + 1)} for x in of(a + 1, k - 1) for y in of(k + 1, b)]
        return out

    return of(0, n - 1)


def weight(name):
    return (int(hashlib.md5(name.encode()).hexdigest()[:4], 16) % 2048 - 1024) / 1024


def test_fold_is_the_best_scored_structure(spark):
    r = random.Random(4)
    seqs = ["".join(r.choice("ACGU") for _ in range(13)) for _ in range(4)] + ["GGAAACCGAAAC", "GGGAAAACCC", "GCAAAGCGAAAGCC"]
    rows, keys = [], {}
    for k, seq in enumerate(seqs):
        for m, s in enumerate(structures(seq)):
            text = ["."] * len(seq)
            for i, j in s:
                text[i - 1], text[j - 1] = "(", ")"
            keys[k * 100000 + m] = (k, s)
            rows.append((k * 100000 + m, seq, "".join(text)))
    feats = features.feature_counts(spark.createDataFrame(rows, "seq_id long, seq string, structure string")).cache()
    names = [x.feature for x in features.feature_vocabulary(feats).collect()]
    weights = spark.createDataFrame([(x, weight(x)) for x in names], "feature string, w double")
    scores = {x.seq_id: x.score for x in features.score_structures(feats, weights).collect()}
    best = {}
    for key, (k, s) in keys.items():
        best.setdefault(k, []).append((scores.get(key, 0.0), sorted(s)))
    folded, long = solve.fold_corpus(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), weights, max_len=13)
    assert [x.seq_id for x in long.collect()] == [6]
    for x in folded.collect():
        top = max(s for s, _ in best[x.seq_id])
        assert abs(x.score - top) < 1e-9 and [(p.i, p.j) for p in x.pairs] in [s for v, s in best[x.seq_id] if abs(v - top) < 1e-9]


def test_decode_is_the_best_sum(spark):
    r = np.random.default_rng(2)
    n = 11
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    w, u = r.random(len(pairs)), r.random(n) * 0.4
    got = solve.decode(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), w, u)
    value = dict(zip(pairs, w, strict=True))

    def best(a, b):
        if b < a:
            return 0.0
        return max([best(a + 1, b) + u[a - 1]] + [value[a, k] + best(a + 1, k - 1) + best(k + 1, b) for k in range(a + 1, b + 1)])

    free = set(range(1, n + 1)) - {p for x in got for p in x}
    assert abs(sum(value[p] for p in got) + sum(u[p - 1] for p in free) - best(1, n)) < 1e-9
    frame = spark.createDataFrame([(7, i, j, float(value[i, j])) for i, j in pairs], "seq_id long, i int, j int, w double")
    unpaired = spark.createDataFrame([(7, k + 1, float(x)) for k, x in enumerate(u)], "seq_id long, pos int, w double")
    assert sorted((x.i, x.j) for x in solve.decode_corpus(frame, unpaired).where(F.col("seq_id") == 7).collect()) == got
