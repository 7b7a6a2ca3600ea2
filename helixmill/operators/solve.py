"""Folding and decoding: the only helpers that run Python inside tasks, one record at a time.

Spark spreads the records: they are dealt by a hash, so long ones do not meet, and
where max_len is given, longer ones go to the quarantine that fold_corpus returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import PAIRS
from .features import DISTANCES, MAX_ASYMMETRY, MAX_BULGE, MAX_EXPLICIT, MAX_HAIRPIN, MAX_HELIX, MAX_INTERNAL, MAX_STRING, MAX_SYMMETRIC
from .loops import MAX_SINGLE, MIN_HAIRPIN

NONE = float("-inf")


class Scores:
    """Scores of loops of one sequence (1-based places) under named weights."""

    def __init__(self, seq: str, weights: dict[str, float]):
        self.s, self.w = "@" + seq.upper() + "@", weights
        total = lambda family, cap: np.cumsum([weights.get(f"{family}_at_least_{k}", 0.0) for k in range(cap + 1)])
        self.hairpin_len, self.helix_len, self.bulge_len = total("hairpin_length", MAX_HAIRPIN), total("helix_length", MAX_HELIX), total("bulge_length", MAX_BULGE)
        self.internal_len, self.symmetric, self.asymmetry = total("internal_length", MAX_INTERNAL), total("internal_symmetric_length", MAX_SYMMETRIC), total("internal_asymmetry", MAX_ASYMMETRY)
        self.dist = total("base_pair_dist", len(DISTANCES) - 1)

    def get(self, family: str, *places: int) -> float:
        return self.w.get(f"{family}_{''.join(self.s[p] for p in places)}", 0.0)

    def mirrored(self, family: str, text: str) -> float:
        return self.w.get(f"{family}_{min(text, text[::-1])}", 0.0)

    def pair(self, i: int, j: int) -> float:
        far = sum(d <= j - i for d in DISTANCES)
        return self.mirrored("base_pair", self.s[i] + self.s[j]) + (float(self.dist[far - 1]) if far else 0.0)

    def stack(self, i: int, j: int) -> float:
        return self.mirrored("helix_stacking", self.s[i] + self.s[j] + self.s[i + 1] + self.s[j - 1])

    def helix(self, m: int) -> float:
        return self.w.get("isolated_base_pair", 0.0) if m == 1 else float(self.helix_len[min(m, MAX_HELIX)])

    def hairpin(self, i: int, j: int) -> float:
        n = j - i - 1
        text = self.w.get(f"hairpin_nucleotides_{self.s[i + 1 : j]}", 0.0) if n <= MAX_STRING else 0.0
        return self.get("helix_closing", i, j) + self.get("terminal_mismatch", i, j, i + 1, j - 1) + float(self.hairpin_len[min(n, MAX_HAIRPIN)]) + text

    def single(self, i: int, j: int, p: int, q: int) -> float:
        a, b = p - i - 1, j - q - 1
        out = self.get("helix_closing", i, j) + self.get("helix_closing", q, p) + self.get("terminal_mismatch", i, j, i + 1, j - 1) + self.get("terminal_mismatch", q, p, q + 1, p - 1)
        if a + b <= MAX_STRING:
            text = f"{self.s[i + 1 : p]}_{self.s[q + 1 : j][::-1]}"
            out += self.w.get(f"internal_nucleotides_{min(text, text[::-1])}", 0.0)
        if not a or not b:
            return out + float(self.bulge_len[min(a + b, MAX_BULGE)])
        if max(a, b) <= MAX_EXPLICIT:
            out += self.w.get(f"internal_explicit_{min(a, b)}_{max(a, b)}", 0.0)
        if a == b:
            out += float(self.symmetric[min(a, MAX_SYMMETRIC)])
        return out + float(self.internal_len[min(a + b, MAX_INTERNAL)]) + float(self.asymmetry[min(abs(a - b), MAX_ASYMMETRY)])

    def multi(self, i: int, j: int) -> float:
        return self.w.get("multi_base", 0.0) + self.w.get("multi_paired", 0.0) + self.get("helix_closing", i, j) + self.get("dangle_left", i, j, i + 1) + self.get("dangle_right", i, j, j - 1)

    def branch(self, k: int, m: int, multi: bool, n: int) -> float:
        out = self.w.get("multi_paired" if multi else "external_paired", 0.0) + self.get("helix_closing", m, k)
        out += self.get("dangle_left", m, k, m + 1) if multi or m < n else 0.0
        return out + (self.get("dangle_right", m, k, k - 1) if multi or k > 1 else 0.0)


def fold(seq: str, weights: dict[str, float], max_single: int = MAX_SINGLE, allow_nc: bool = False, pair_bonus: dict[tuple[int, int], float] | None = None) -> tuple[float, list[tuple[int, int]]]:
    """The best nested structure's score and pairs. Of equal ones, the first alternative tried stays.

    Spans grow from short to long. For a pair: the best loop that it closes other than
    a stack, and the best helix that begins with it; for a span: the best run of none, one, or more branches.
    """
    n, at = len(seq), Scores(seq, weights)
    can = {(i, j) for i in range(1, n + 1) for j in range(i + MIN_HAIRPIN + 1, n + 1) if allow_nc or at.s[i] + at.s[j] in PAIRS}
    gain = {p: at.pair(*p) + (pair_bonus or {}).get(p, 0.0) for p in can}
    loop: dict[tuple[int, int], tuple[float, tuple]] = {}
    helix: dict[tuple[int, int], tuple[float, int]] = {}
    free = weights.get("multi_unpaired", 0.0)
    # run[c][i, j]: span i..j of a multi loop with c branches (2: or more), and how its end came about.
    run: list[dict[tuple[int, int], tuple[float, tuple]]] = [{}, {}, {}]
    for i in range(1, n + 2):
        run[0][i, i - 1], run[1][i, i - 1], run[2][i, i - 1] = (0.0, ()), (NONE, ()), (NONE, ())
    for span in range(n):
        for i in range(1, n - span + 1):
            j = i + span
            if (i, j) in can:
                best = (at.hairpin(i, j), ())
                for p in range(i + 1, min(i + max_single + 2, j)):
                    for q in range(j - 1, max(p + MIN_HAIRPIN, j - (max_single - (p - i - 1)) - 2), -1):
                        if (p, q) in helix and (p != i + 1 or q != j - 1):
                            score = at.single(i, j, p, q) + helix[p, q][0]
                            if score > best[0]:
                                best = (score, (p, q))
                score = at.multi(i, j) + run[2][i + 1, j - 1][0]
                if score > best[0]:
                    best = (score, ("multi",))
                loop[i, j] = best
                so_far, top = 0.0, (NONE, 0)
                m = 0
                while (i + m, j - m) in can:
                    so_far += gain[i + m, j - m] + (at.stack(i + m - 1, j - m + 1) if m else 0.0)
                    m += 1
                    score = so_far + at.helix(m) + loop[i + m - 1, j - m + 1][0]
                    if score > top[0]:
                        top = (score, m)
                helix[i, j] = top
            for c in range(3):
                best = (run[c][i, j - 1][0] + free, ("free",))
                if c:
                    for k in range(i, j - MIN_HAIRPIN):
                        if (k, j) in helix:
                            inner = helix[k, j][0] + at.branch(k, j, True, n)
                            for before in (c - 1, c) if c == 2 else (0,):
                                score = run[before][i, k - 1][0] + inner
                                if score > best[0]:
                                    best = (score, (k, before))
                run[c][i, j] = best
    outer, outer_free = [(0.0, 0)], weights.get("external_unpaired", 0.0)
    for j in range(1, n + 1):
        best = (outer[j - 1][0] + outer_free, 0)
        for k in range(1, j - MIN_HAIRPIN):
            if (k, j) in helix:
                score = outer[k - 1][0] + helix[k, j][0] + at.branch(k, j, False, n)
                if score > best[0]:
                    best = (score, k)
        outer.append(best)
    pairs, todo, j = [], [], n
    while j > 0:
        k = outer[j][1]
        if k:
            todo.append((k, j))
        j = k - 1 if k else j - 1
    while todo:
        i, j = todo.pop()
        m = helix[i, j][1]
        pairs += [(i + x, j - x) for x in range(m)]
        i, j = i + m - 1, j - m + 1
        how = loop[i, j][1]
        if how == ("multi",):
            a, b, c = i + 1, j - 1, 2
            while b >= a:
                step = run[c][a, b][1]
                if step == ("free",):
                    b -= 1
                else:
                    todo.append((step[0], b))
                    b, c = step[0] - 1, step[1]
        elif how:
            todo.append(how)
    return outer[n][0], sorted(pairs)


def fold_corpus(records: DataFrame, weights: DataFrame, max_len: int | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """folded(seq_id, score, pairs array of (i, j)) and quarantine(seq_id, reason) of records longer than max_len (None: of none).

    The weight table, thousands of rows by its vocabulary, is sent along with the task.
    """
    w = {r.feature: r.w for r in weights.select("feature", "w").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [fold(s, w) for s in pdf["seq"]]
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "score": [f[0] for f in found], "pairs": [[{"i": i, "j": j} for i, j in f[1]] for f in found]})

    parts = partitions or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.lit(True) if max_len is None else F.length("seq") <= max_len
    short = records.where(within).select("seq_id", "seq").repartition(parts, F.xxhash64("seq_id"))
    long = records.where(~within).select("seq_id", F.lit("too long to fold").alias("reason"))
    return short.mapInPandas(run, "seq_id long, score double, pairs array<struct<i:int,j:int>>"), long


def decode(i: np.ndarray, j: np.ndarray, w: np.ndarray, unpaired: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the nested structure with the greatest sum of pair and unpaired weights. Places are 1-based."""
    n = len(unpaired)
    best, how = np.zeros((n + 2, n + 2)), np.zeros((n + 2, n + 2), int)
    by_end: dict[int, list[tuple[int, float]]] = {}
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        by_end.setdefault(b, []).append((a, x))
    for b in range(1, n + 1):
        # best[a, b] for all a at once: b unpaired, or paired with some k >= a.
        best[1 : b + 1, b] = best[1 : b + 1, b - 1] + unpaired[b - 1]
        for k, x in sorted(by_end.get(b, []), reverse=True):
            score = best[1 : k + 1, k - 1] + x + best[k + 1, b - 1]
            better = score > best[1 : k + 1, b]
            best[1 : k + 1, b][better] = score[better]
            how[1 : k + 1, b][better] = k
    out, todo = [], [(1, n)]
    while todo:
        a, b = todo.pop()
        while b >= a:
            k = how[a, b]
            if k:
                out.append((int(k), b))
                todo.append((k + 1, b - 1))
                b = k - 1
            else:
                b -= 1
    return sorted(out)


def decode_corpus(pair_weights: DataFrame, unpaired_weights: DataFrame) -> DataFrame:
    """seq_id, i, j of the decoded structures, from weights (seq_id, i, j, w) and (seq_id, pos, w)."""
    both = unpaired_weights.select("seq_id", F.lit(0).alias("i"), F.col("pos").alias("j"), "w").unionByName(pair_weights.select("seq_id", "i", "j", "w"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free = rows[rows["i"] == 0].sort_values("j")["w"].to_numpy()
        some = rows[rows["i"] > 0]
        found = decode(some["i"].to_numpy(), some["j"].to_numpy(), some["w"].to_numpy(), free)
        return pd.DataFrame({"seq_id": [key[0]] * len(found), "i": [p[0] for p in found], "j": [p[1] for p in found]}).astype("int64")

    return both.groupBy("seq_id").applyInPandas(run, "seq_id long, i long, j long")
