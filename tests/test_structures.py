"""Structures, loops, features and files on small records, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions import expr
from helixmill.operators import alignment, candidates, expansion, features, lengths, loops, solve, structure, training
from helixmill.plans.fixtures import partner_places
from helixmill.sources import readers, writers


def nested(r, n):
    """A random balanced string."""
    out, open_ = [], 0
    for k in range(n):
        c = r.choice("(.) ." if open_ else "(..").replace(" ", ")")
        if open_ >= n - k:
            c = ")"
        elif c == "(" and open_ + 1 > n - k - 1:
            c = "."
        open_ += {"(": 1, ")": -1}.get(c, 0)
        out.append(c)
    return "".join(out)


@pytest.fixture(scope="module")
def plain():
    r = random.Random(1)
    return [(k, "".join(r.choice("ACGU") for _ in range(n)), nested(r, n)) for k, n in enumerate([1, 2, 12, 40, 40, 60, 60, 90])] + [(90, "GGGG" + "A" * 60 + "CC" + "A" * 5 + "GG" + "CCCC", "((((" + "." * 60 + "((" + "." * 5 + "))" + "))))")]


@pytest.fixture(scope="module")
def records(spark, plain):
    return spark.createDataFrame(plain, "seq_id long, seq string, structure string").cache()


def pairs_of(s):
    return {(i + 1, p + 1) for i, p in ((p, k) for k, p in enumerate(partner_places(s)) if p >= 0)}


def test_brackets_both_ways(records, plain):
    got = {}
    for x in structure.brackets_to_pairs(records).collect():
        got.setdefault(x.seq_id, set()).add((x.i, x.j))
    assert got == {k: pairs_of(s) for k, _, s in plain if "(" in s}
    back = {x.seq_id: x.structure for x in structure.mapping_to_brackets(structure.brackets_to_mapping(records)).collect()}
    assert back == {k: s for k, _, s in plain}
    assert structure.unbalanced(records).count() == 0


def test_unbalanced_and_crossing(spark):
    bad = spark.createDataFrame([(1, "AAAA", "(()"), (2, "AA", ")("), (3, "AA", "()")], "seq_id long, seq string, structure string")
    assert {x.seq_id for x in structure.unbalanced(bad).collect()} == {1, 2}
    r = random.Random(3)
    sets = {k: {tuple(sorted(r.sample(range(1, 30), 2))) for _ in range(r.randint(1, 4))} for k in range(80)}
    sets = {k: {p for p in v if all(p == q or not set(p) & set(q) for q in v)} for k, v in sets.items()}
    rows = [(k, i, j) for k, v in sets.items() for i, j in v]
    want = {k: any(a < c < b < d for a, b in v for c, d in v) for k, v in sets.items() if v}
    assert {x.seq_id: x.crossing for x in structure.has_pseudoknot(spark.createDataFrame(rows, "seq_id long, i int, j int")).collect()} == want


def test_mapping_faults(spark):
    rows = [(1, 1, 3), (1, 2, 2), (1, 3, 1), (1, 4, 9), (1, 5, 1), (1, 6, -2), (1, 7, -1), (1, 8, 0)]
    got = {(x.pos, x.reason) for x in structure.validate_mapping(spark.createDataFrame(rows, "seq_id long, pos int, partner int")).collect()}
    assert got == {(2, "paired with itself"), (4, "out of range"), (5, "not reciprocal"), (6, "out of range")}


def test_conservation(records, plain):
    """Every pair closes one loop, and the loops hold all unpaired positions."""
    pairs = structure.brackets_to_pairs(records)
    found = loops.classify_loops(pairs, records).groupBy("seq_id").agg(F.count("i").alias("n"), F.sum("n_unpaired").alias("u")).collect()
    for x in found:
        _, seq, s = next(p for p in plain if p[0] == x.seq_id)
        assert x.n == len(pairs_of(s)) and 2 * x.n + x.u == len(seq)
    assert {x.seq_id: x.n for x in loops.helices(pairs).groupBy("seq_id").agg(F.sum("len").alias("n")).collect()} == {k: len(pairs_of(s)) for k, _, s in plain if "(" in s}


def test_blocks_of_long_records(spark, monkeypatch):
    """The same tables from blocks of seven positions as from whole records, with one record that many tasks share."""
    r = random.Random(9)
    rows = [(k, "".join(r.choice("ACGU") for _ in range(n)), nested(r, n)) for k, n in enumerate([1, 6, 7, 8, 14, 15, 100, 300, 300])]
    records = spark.createDataFrame([*rows, (50, "ACGU" * 9, "(" * 18 + ")" * 18), (51, "A" * 40, "." * 40), (52, "ACG", "())"), (53, "AC" * 20, "(" * 40)], "seq_id long, seq string, structure string")
    crossed = spark.createDataFrame([(1, 2, 20), (1, 9, 40), (2, 1, 30), (2, 3, 29), (3, 4, 5), (3, 6, 90), (4, 1, 9), (4, 20, 60), (4, 30, 80)], "seq_id long, i int, j int")

    def tables():
        pairs = structure.brackets_to_pairs(records)
        eff = loops.effective_pairs(pairs, records)
        frames = [pairs, structure.unbalanced(records), eff, loops.parent_pair(pairs, records), loops.pair_parents(eff), loops.classify_loops(pairs, records), structure.has_pseudoknot(crossed)]
        return [sorted(map(str, f.collect())) for f in frames]

    whole = tables()
    monkeypatch.setattr(structure, "BLOCK", 7)
    monkeypatch.setattr(loops, "BLOCK", 7)
    assert tables() == whole and "Row(seq_id=4, crossing=True)" in whole[-1] and "Row(seq_id=2, crossing=False)" in whole[-1]
    depth = structure._levels(records).where("seq_id = 7").groupBy("block").count()
    assert depth.count() > 30


def test_scores_with_weights_beyond_a_broadcast(spark, records):
    exact = features.exact_feature_counts(records, allow_nc=True)
    r = random.Random(4)
    weights = spark.createDataFrame([(x.feature, r.randint(-9, 9) / 8) for x in features.feature_counts(records, allow_nc=True).select("feature").distinct().collect()], "feature string, w double")
    want = {}
    at = {x.feature: x.w for x in weights.collect()}
    for x in features.feature_counts(records, allow_nc=True).collect():
        want[x.seq_id] = want.get(x.seq_id, 0.0) + x.cnt * at[x.feature]
    assert {x.seq_id: x.score for x in features.score_structures(exact, features.exact_weights(weights)).collect()} == want
    split = features.with_weights(exact, features.exact_weights(weights), most=0)
    assert {x.seq_id: x.s for x in split.groupBy("seq_id").agg(F.sum(F.col("cnt") * F.col("w")).alias("s")).collect()} == want
    assert "BroadcastHashJoin" in split._jdf.queryExecution().toString() and "SortMergeJoin" in split._jdf.queryExecution().toString()


def test_too_long_a_loop_is_ng(records):
    status = {x.seq_id: x.status for x in loops.validate_structures(records).collect()}
    assert status[90] == "NG" and status[2] == "OK"


def test_family_counts(records):
    got = {x.feature: x.cnt for x in features.corpus_feature_counts(features.feature_counts(records, allow_nc=True)).collect()}
    pairs = loops.effective_pairs(structure.brackets_to_pairs(records), records, allow_nc=True)
    kinds = Counter(x.kind for x in loops.classify_loops(pairs, records).collect())
    for kind, family in (("hairpin", "hairpin_length"), ("bulge", "bulge_length"), ("internal", "internal_length")):
        assert got.get(f"{family}_at_least_0", 0) == kinds[kind]
    assert sum(v for k, v in got.items() if k.startswith("base_pair_") and "dist" not in k) == pairs.count()


def test_length_scores_start_anew_behind_barred_lengths(spark):
    w = spark.createDataFrame([("hairpin_length_at_least_0", -2e20), ("hairpin_length_at_least_1", -2e20), ("hairpin_length_at_least_2", 0.5), ("hairpin_length_at_least_4", 0.25)], "feature string, w double")
    got = {x.len: x.score for x in lengths.length_score_table(w).where("family = 'hairpin_length'").collect()}
    assert got[2] == 0.5 and got[3] == 0.5 and got[30] == 0.75
    assert lengths.single_length_table(w).count() == 860


def test_single_loops_of_given_candidates(records, plain):
    cand = candidates.candidate_pairs(records, 25)
    rows = {(x.seq_id, x.i, x.j) for x in cand.collect()}
    got = {(x.seq_id, x.i, x.j, x.p, x.q) for x in expansion.single_loop_candidates(cand, records, max_single=9).collect()}
    assert got == {(s, i, j, p, q) for s, i, j in rows for t, p, q in rows if s == t and i < p and q < j and 1 <= p - i - 1 + j - q - 1 <= 9}


def _loops_of(seq, free, weight):
    """Hairpins and single loops of one record without a span, where the unpaired places are all in `free`."""
    at, n = solve.Scores(seq, weight), len(seq)
    can = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1) if seq[i - 1] + seq[j - 1] in expr.PAIRS]
    open_ = lambda a, b: all(k in free for k in range(a + 1, b))
    hairpins = {(i, j): (j - i - 1, at.hairpin(i, j)) for i, j in can if j - i > 3 and open_(i, j)}
    singles = {(i, j, p, q): (p - i - 1, j - q - 1, at.single(i, j, p, q)) for i, j in can for p, q in can if i < p and q < j and 1 <= p - i - 1 + j - q - 1 <= 40 and open_(i, p) and open_(q, j)}
    return hairpins, singles


@pytest.fixture(scope="module")
def long_loops(spark):
    """Records of 78 letters with few pairs, so that loops are wide, some places barred, and weights for each second name."""
    r = random.Random(7)
    rows = [(k, "".join(r.choice("AAACCGU") for _ in range(78))) for k in range(3)]
    free = {k: {p for p in range(1, 79) if not k or r.random() < 0.95} for k, _ in rows}
    weight = {}
    for x in "ACGU":
        for y in "ACGU":
            weight |= {f"helix_closing_{x}{y}": r.uniform(-1, 1), f"hairpin_nucleotides_{x}A{y}": r.uniform(-1, 1), f"internal_nucleotides_{min(f'{x}_{y}', f'{y}_{x}')}": r.uniform(-1, 1)}
            weight |= {f"terminal_mismatch_{x}{y}{a}{b}": r.uniform(-1, 1) for a in "ACGU" for b in "ACGU"}
            weight |= {f"internal_nucleotides_{min(t, t[::-1])}": r.uniform(-1, 1) for t in (f"{x}{y}_", f"{x}A{y}_", f"A{x}_{y}C", f"AC{x}_AA{y}A", f"ACA{x}A{y}A_")}
    weight |= {f"{family}_at_least_{k}": r.uniform(-1, 1) for family, cap in lengths.FAMILIES.items() for k in range(cap + 1)}
    weight |= {f"internal_explicit_{a}_{b}": r.uniform(-1, 1) for a in range(1, 5) for b in range(a, 5)}
    frames = spark.createDataFrame(rows, "seq_id long, seq string"), spark.createDataFrame([(k, p, p in free[k]) for k, _ in rows for p in range(1, 79)], "seq_id long, pos int, allowed boolean")
    return rows, free, weight, *frames, spark.createDataFrame(list(weight.items()), "feature string, w double")


def test_hairpin_candidates_without_span(long_loops):
    rows, free, weight, records, allow, weights = long_loops
    want = {(k, *at): x for k, s in rows for at, x in _loops_of(s, free[k], weight)[0].items()}
    got = {(x.seq_id, x.i, x.j): (x.n, x.score) for x in expansion.hairpin_candidates(candidates.candidate_pairs(records), records, allow, weights).collect()}
    assert got == {k: pytest.approx(x) for k, x in want.items()} and max(x[0] for x in want.values()) > 60


def test_single_loop_candidates_without_span(long_loops):
    rows, free, weight, records, allow, weights = long_loops
    want = {(k, *at): x for k, s in rows for at, x in _loops_of(s, free[k], weight)[1].items()}
    found = expansion.single_loop_candidates(candidates.candidate_pairs(records), records, allow, weights).collect()
    got = {(x.seq_id, x.i, x.j, x.p, x.q): (x.l1, x.l2, x.score) for x in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(got[k][:2] == x[:2] and abs(got[k][2] - x[2]) < 1e-9 for k, x in want.items())
    assert max(a + b for a, b, _ in want.values()) == 40 and max(k[2] - k[1] for k in want) > 70


def test_helices_stay_in_unbroken_runs(spark, long_loops):
    cand = spark.createDataFrame([(1, 1, 10), (1, 3, 8), (1, 4, 7)], "seq_id long, i int, j int").withColumn("gain", F.lit(1.5))
    none = spark.createDataFrame([("helix_length_at_least_2", 0.25)], "feature string, w double")
    assert {(x.i, x.j, x.m): x.score for x in expansion.helix_scores(cand, none).collect()} == {(1, 10, 1): 0, (3, 8, 1): 0, (3, 8, 2): 1.75, (4, 7, 1): 0}
    rows, _, weight, records, _, weights = long_loops
    r = random.Random(2)
    weight = weight | {f"base_pair_{x}{y}": r.uniform(-1, 1) for x in "ACGU" for y in "ACGU" if x <= y} | {f"helix_stacking_{x}{y}{a}{b}": r.uniform(-1, 1) for x in "ACGU" for y in "ACGU" for a in "ACGU" for b in "ACGU" if x + y + a + b <= b + a + y + x}
    weights = spark.createDataFrame(list(weight.items()), "feature string, w double")
    got = {(x.seq_id, x.i, x.j, x.m): x.score for x in expansion.helix_scores(expansion.helix_steps(candidates.candidate_pairs(records), records, weights), weights).collect()}
    want = {}
    for k, s in rows:
        can = {(i, j) for i in range(1, 79) for j in range(i + 1, 79) if s[i - 1] + s[j - 1] in expr.PAIRS}
        for i, j in can:
            m, total = 1, 0.0
            while (i + m - 1, j - m + 1) in can:
                if m > 1:
                    a, b = i + m - 1, j - m + 1
                    names = [f"base_pair_{min(s[a - 1] + s[b - 1], s[b - 1] + s[a - 1])}"] + [f"base_pair_dist_at_least_{q}" for q, d in enumerate(features.DISTANCES) if d <= b - a]
                    four = s[a - 2] + s[b] + s[a - 1] + s[b - 1]
                    total += sum(weight.get(x, 0.0) for x in [*names, f"helix_stacking_{min(four, four[::-1])}"])
                want[k, i, j, m] = total + sum(weight.get(f"helix_length_at_least_{q}", 0.0) for q in range(min(m, 30) + 1))
                m += 1
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_sequential_training_rule(spark):
    w = spark.createDataFrame([("a", 1.0, 4.0), ("b", -0.5, 0.0)], "feature string, w double, sum_sq double")
    g = spark.createDataFrame([(1, "a", 3.0), (1, "c", -2.0)], "seq_id long, feature string, g double")
    got = {x.feature: (x.w, x.sum_sq) for x in training.l1_regularize(training.adagrad_update(w, g, 0.5), 0.5, 0.1).collect()}
    shrink = lambda v, c: (abs(v) > c) * (abs(v) - c) * (1 if v > 0 else -1)
    a = 1.0 - 0.5 / 13**0.5 * 3
    assert got["a"] == pytest.approx((shrink(a, 0.5 / 13**0.5 * 0.1), 13.0)) and got["b"] == (-0.5, 0.0)
    assert got["c"] == pytest.approx((shrink(0.5, 0.025), 4.0))


def test_weak_records_have_a_rate_of_their_own(spark, tmp_path):
    records = spark.createDataFrame([(1, "none"), (2, "unpaired")], "seq_id long, label_kind string")
    g = spark.createDataFrame([(1, "a", 2.0), (2, "b", 4.0)], "seq_id long, feature string, g double")
    empty = spark.createDataFrame([], "feature string, w double, sum_sq double")
    got = {x.feature: (x.w, x.sum_sq) for x in training.adagrad_update(empty, training.apply_record_weights(g, records, 0.5, 0.25), 0.5).collect()}
    assert got == {"a": (-0.5, 4.0), "b": (-0.125, 4.0)}


def test_restart(spark):
    done = spark.createDataFrame([(0,), (1,), (2,), (5,)], "step int")
    assert sorted(x.step for x in training.resume_from(done, spark.range(8).select(F.col("id").cast("int").alias("step"))).collect()) == [2, 3, 4, 5, 6, 7]


def test_expressions(spark):
    df = spark.createDataFrame([("Ac.gTtxP-", "--.(?)", "helix_stacking_UACG"), ("A*C", "[.]", "internal_nucleotides_UA_C")], "s string, b string, f string")
    rows = df.select(expr.normalize_seq(F.col("s")).alias("s"), expr.normalize_brackets(F.col("b")).alias("b"), expr.canonical_feature(F.col("f")).alias("f"), expr.letter_positions(F.col("s")).alias("p")).collect()
    assert (rows[0].s, rows[0].b, rows[0].f) == ("Ac-gUunP-", "...(?)", "helix_stacking_GCAU") and rows[0].p == [0, 0, 1, 3, 4, 5, 6, 7]
    assert (rows[1].s, rows[1].b, rows[1].f) == (None, None, "internal_nucleotides_C_AU")


def test_files(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t)
    put("a.fa", "> one\nGGGA\nAACCC\n\n>two\nGGGAA-CCC\n>s\n(((...)))\n")
    put("b.fa", "GGG\n>x\nA\n")
    put("f.fa", "")
    put("g.fa", "\t>tab\t\nAC\t\n G U \n")
    put("h.fa", ">only a name\n")
    put("c.fa", ">x\nAA\n>y\nA\n")
    put("d.fa", ">x\nA*\n")
    put("e.fa", ">x\nAA\n>s\n..\n>t\n..\n")
    good, bad = readers.read_fasta(spark, str(tmp_path / "*.fa"))
    assert {x.path[-4:]: x.reason for x in bad.collect()} == {"b.fa": "text before a header", "c.fa": "unequal lengths", "f.fa": "text before a header", "h.fa": "empty sequence"}
    records, rows, worse = readers.split_consensus(good)
    assert sorted((x.name, x.seq, x.structure) for x in records.collect()) == [(" one", "GGGAAACCC", "(((...)))"), ("tab", "ACGU", "????")]
    assert rows.where("aln_id LIKE '%/a.fa'").count() == 2 and {x.path[-4:]: x.reason for x in worse.collect()} == {"d.fa": "bad sequence", "e.fa": "two structures"}
    put("a.bp", "1 G 3\n2 A 0\n3 C 1\n")
    put("b.bp", "1 G 0\n3 A 0\n")
    put("c.bp", "1 GG 0\n")
    put("d.bp", "1 G -3\n")
    put("e.bp", "")
    mapping, bad = readers.read_bpseq(spark, str(tmp_path / "*.bp"))
    assert [(x.pos, x.base, x.partner) for x in mapping.orderBy("pos").collect()] == [(1, "G", 3), (2, "A", 0), (3, "C", 1)]
    assert {x.path[-4:]: x.reason for x in bad.collect()} == {"b.bp": "index out of order", "c.bp": "base of more than one letter", "d.bp": "bad partner", "e.bp": "empty"}
    put("a.raw", "GG A\nCC")
    assert {x.path.rsplit("/", 1)[1]: x.fmt for x in readers.detect_format(readers.files(spark, str(tmp_path / "a.*"))).collect()} == {"a.fa": "fasta", "a.bp": "bpseq", "a.raw": "raw"}
    assert readers.read_raw(spark, str(tmp_path / "a.raw"))[0].first().seq == "GGACC"
    w = spark.createDataFrame([("helix_stacking_AUCG", 0.5, 1.0), ("z", 0.0, 2.0)], "feature string, w double, sum_sq double")
    writers.write_optimizer(w, str(tmp_path / "opt"), 0.5, 0.1, 0.0)
    part = next((tmp_path / "opt").glob("part-*"))
    back, config = readers.read_optimizer(spark, str(part))
    assert {(x.feature, x.w, x.sum_sq) for x in back.collect()} == {("helix_stacking_AUCG", 0.5, 1.0), ("z", 0.0, 2.0)} and config.first()["eta"] == 0.5
    assert readers.read_weights(spark, str(part)).count() == 1
    writers.write_bpseq(records, str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("bucket=*/part-*")).read_text().split("\n")[:2] == ["1 G 9", "2 G 8"]
    put("strong.lst", f"{tmp_path}/a.bp {tmp_path}/a.fa\n{tmp_path}/b.bp")
    put("weak.lst", f"{tmp_path}/w.react\n")
    put("w.react", "1 G 0.25\n2 A 0.5\n")
    every, faults = readers.read_corpus(spark, [str(tmp_path / "strong.lst")], [str(tmp_path / "weak.lst")])
    assert Counter((x.seq_id[-4:], x.label_kind) for x in every.collect()) == {("a.bp", "none"): 3, ("a.fa", "none"): 9, ("eact", "unpaired"): 2}
    assert [(x.partner, x.r_unpaired) for x in every.where("label_kind = 'unpaired'").orderBy("pos").collect()] == [(-1, 0.25), (-1, 0.5)]
    assert [x.path[-4:] for x in faults.collect()] == ["b.bp"] and readers.read_corpus(spark, [])[0].isEmpty()


@pytest.mark.parametrize("size", [16, 61])
def test_files_in_splits(spark, tmp_path, size):
    """Files read in splits of few bytes give what files read whole give, faults too."""
    r = random.Random(size)
    text = lambda n: "".join(r.choice("ACGU") for _ in range(n))
    fasta = {"a": "".join(f"> r{k}\n" + "".join(text(r.randint(0, 9)) + r.choice(["\n", " ", "\r\n", "\n\n", "\t"]) for _ in range(6)) + "\n" for k in range(12))}
    fasta |= {"b": "\n\n" + fasta["a"], "c": "ACGU\n>x\nAC\n", "d": ">x\n>y\n  >z\nAC>GU\n>>w\n\n", "e": "\n \n", "f": ">a\nAC\n>b\nGU\n>s\n()", "g": ">\nA\n>b\nGU\n", "h": ">x", "i": ""}
    lines = [f"{k} {r.choice('ACGU')} {r.choice([0, -1, 5])}" for k in range(1, 26)]
    bpseq = {"a": "\n".join(lines), "b": " ".join(lines), "c": "\n".join(" ".join(lines).split(" ")), "d": "\n\n".join(lines[:12]) + "  " + "\t".join(lines[12:]), "e": "\n".join(lines) + " 26", "f": "\n".join(lines[:9] + lines[10:]), "g": " \n\n ", "h": "1 G", "i": ""}
    bpseq |= {"j": "\n".join([*lines[:10], "11 GG 0", *lines[11:20], "21 G -5", *lines[21:]])}
    for kind, some in (("fa", fasta), ("bp", bpseq)):
        for name, t in some.items():
            (tmp_path / f"{name}.{kind}").write_bytes(t.encode())
    jobs = [lambda w, m=m: readers.read_fasta(spark, str(tmp_path / "*.fa"), m, w) for m in ("alignment", "independent")]
    jobs += [lambda w: readers.read_bpseq(spark, str(tmp_path / "*.bp"), w), *[lambda w, k=k: readers.read_reactivity(spark, str(tmp_path / "*.bp"), k, w) for k in ("paired", "both")]]
    jobs += [lambda w: (readers.formats(spark, str(tmp_path / "*"), w),)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for job in jobs:
            for whole, split in zip(job(1 << 30), job(0), strict=True):
                assert split.columns == whole.columns
                assert Counter(map(tuple, split.collect())) == Counter(map(tuple, whole.collect()))
        assert readers.read_fasta(spark, str(tmp_path / "a.fa"), "independent", 0)[0].count() == 12
        assert readers.read_bpseq(spark, str(tmp_path / "[a-d].bp"), 0)[0].count() == 4 * 25
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_records_a_file(spark, tmp_path):
    """BPSEQ in buckets and bracket files keep records whole and in order, with an index; what an index does not fit is at fault."""
    r = random.Random(8)
    rows = [(k, f"n{k}", "".join(r.choice("ACGU") for _ in range(n)), nested(r, n)) for k, n in enumerate([r.randint(1, 60) for _ in range(120)] + [0, 1, 300])]
    records = spark.createDataFrame(rows, "seq_id long, name string, seq string, structure string").repartition(5)
    path = str(tmp_path / "out")
    writers.write_bpseq(records, path, lines=400)
    files = sorted((tmp_path / "out").glob("bucket=*/part-*"))
    total = sum(len(x[2]) for x in rows)
    assert len(files) <= -(-total // 400) and sum(len(f.read_text().splitlines()) for f in files) == total
    for f in files:
        at = [int(line.split()[0]) for line in f.read_text().splitlines()]
        assert at[0] == 1 and all(b in (a + 1, 1) for a, b in zip(at, at[1:], strict=False))
    mapping, bad = readers.read_bpseq_files(spark, path)
    want = sorted(tuple(x) for x in structure.brackets_to_mapping(records).join(structure.bases_of(records), ["seq_id", "pos"]).select("seq_id", "pos", "base", "partner").collect())
    assert sorted(tuple(x) for x in mapping.collect()) == want and bad.count() == 0
    lines = files[0].read_text().splitlines()
    files[0].write_text("\n".join(lines[:-1]))
    for crc in files[0].parent.glob(".*.crc"):
        crc.unlink()
    mapping, bad = readers.read_bpseq_files(spark, path)
    gone = [x.seq_id for x in bad.collect()]
    assert len(gone) == 1 and {x.seq_id for x in mapping.collect()} == {x[0] for x in want} - set(gone)
    whole = records.where("seq <> ''")
    writers.write_brackets(whole, str(tmp_path / "fasta"))
    back, bad = readers.read_brackets(spark, str(tmp_path / "fasta"))
    assert sorted(tuple(x) for x in back.collect()) == sorted(x[1:] for x in rows if x[2]) and bad.count() == 0


def test_identity_without_row_pairs(spark):
    """The mean over all row pairs, against numpy over 1,500 rows with gaps and lower case; one row, and rows without letters."""
    r = np.random.default_rng(3)
    sym = r.choice(list("ACGUacg--."), (1500, 12))
    cells = [("big", i, j, str(sym[i, j])) for i in range(1500) for j in range(12)] + [("one", 0, 0, "A"), ("none", 0, 0, "-"), ("none", 1, 0, "A")]
    got = {x.aln_id: x.identity for x in alignment.percent_identity(spark.createDataFrame(cells, "aln_id string, row_no int, pos int, sym string")).collect()}
    upper = np.char.upper(sym)
    letter = np.char.isalpha(upper)
    n = letter.sum(1)
    same = sum(((upper[:, j][:, None] == upper[:, j][None]) & letter[:, j][:, None]).astype(int) for j in range(12))
    least = np.minimum(n[:, None], n[None])
    share = np.where(least > 0, same / np.maximum(least, 1), 0.0)
    assert got["one"] is None and got["none"] == 0.0 and got["big"] == pytest.approx(share[np.triu_indices(1500, 1)].mean())
