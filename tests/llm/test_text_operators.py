"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import decontam, html_text, jaccard, licenses, packing, pii, quality, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, h long"


def corpus(seed=1):
    """Near and exact copies, shared passages, short and empty texts, a long one, nulls, a repeated row."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = []
    for k in range(24):
        w = say(r.randint(30, 90))
        texts.append(" ".join(w))
        if k % 4 == 0:
            v = list(w)
            v[len(v) // 2] = "changed"
            texts.append(" ".join(v))
        if k % 6 == 0:
            texts.append(" ".join(w).upper().replace(" ", "\n", 3))
        if k % 8 == 0:
            texts += [" ".join(w)] * 3
    shared = " ".join(say(20))
    texts += [" ".join(say(25)) + " " + shared + " " + " ".join(say(5)) for _ in range(5)]
    texts += ["", None, "word", "two words", "one two three four", " \t\n ", "é" * 60, "a" * 300, "x " * 200, " ".join(say(3000))]
    rows = [(k * 3, t, [None, "en", "de"][k % 3], "src", 7, 1, 2, 3) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + rows[:1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_classes(docs, nothing):
    rows = corpus()
    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(docs).collect()}
    assert got == {(d, len(sets[d]), find(d)) for d in ids}
    assert jaccard.jaccard_classes(docs).count() == len(rows)
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_signature_tree_prunes_no_link():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, int(n), dtype=np.uint64)) for n in r.integers(5, 120, 12)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) < 0.93], r.integers(0, 2**63, 2, dtype=np.uint64)])) for b in base for _ in range(9)]
    sets.sort(key=len)
    tree = jaccard.Tree(np.stack([jaccard.bitmap(s, 512) for s in sets]), np.array([len(s) for s in sets]))
    left = {(int(a), int(b)) for x, y in tree.pairs(50) for a, b in zip(x, y, strict=True)}
    some = jaccard.surviving([jaccard.bitmap(s).tobytes() for s in sets], np.array([len(s) for s in sets]), np.arange(len(sets)))
    mixed = {(min(int(a), int(b)), max(int(a), int(b))) for a, b in zip(*some[:2], strict=True)}
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= mixed and len(mixed) == len(some[0]) < len(sets) * (len(sets) - 1) / 2
    assert linked and linked <= left and len(left) < len(sets) * (len(sets) - 1) / 2


def test_linked_sets_share_a_prefix_token():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 40):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        last = np.sort(a[: len(a) // 2])
        b = a[: max(1, -(-3 * len(a) // 4))]
        if 4 * len(b) >= 3 * len(a):
            assert len(np.intersect1d(jaccard.prefix(a, last), jaccard.prefix(b, last)))


def test_suffix_dedup(docs, nothing):
    seen, want = set(), {}
    by_id = defaultdict(list)
    for d, t, *_ in corpus():
        by_id[d].append((t or "").encode())
    for d in sorted(by_id):
        new = set()
        for b in by_id[d]:
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    gone[k : k + 50] = b"\1" * 50
                new.add(b[k : k + 50])
            kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
            runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
            want[d] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)
        seen |= new
    got = suffix_dedup.deduplicated(docs).collect()
    assert len(got) == len(corpus()) and all((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) == want[x.doc_id] for x in got)
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_suffix_dedup_keeps_unlike_texts_of_one_doc_id_apart(spark):
    r = random.Random(12)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    common = say(70)
    rows = [(3, say(40) + common), (None, say(90) + common), (None, say(200)), (None, common + say(150)), (7, say(10) + common + say(9)), (7, say(120)), (7, say(60)), (None, say(30))]
    want = Counter((d, len(t) - 70 * (common in t and d != 3), 70 * (common in t and d != 3), t.replace(common, "") if d != 3 else t) for d, t in rows)
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.n_bytes - x.n_removed, x.n_removed, bytes(x.kept).decode()) for x in got) == want


def test_repeated_substrings_by_interval_expansion():
    strings, docs = [b"abcabcabcx", b"zzabcabcq", b"abcabcabcx"], np.array([5, 2, 1])
    which, offset = suffix_dedup.repeated(strings, docs, 6)
    want = {(k, o) for k, s in enumerate(strings) for o in range(len(s) - 5) if any(s[o : o + 6] in t and d < docs[k] for t, d in zip(strings, docs, strict=True))}
    assert set(zip(which.tolist(), offset.tolist(), strict=True)) == want


def test_intervals_with_one_letter_before_go_on_by_their_bounds(monkeypatch):
    """Equal to brute force in groups, with ties and equal strings; the rounds over a long passage do not read it suffix by suffix."""
    r = np.random.default_rng(3)
    for letters, length in [(2, 5), (3, 7), (4, 6), (200, 3)]:
        strings = [bytes(r.integers(97, 97 + min(letters, 20), int(r.integers(0, 90))).astype(np.uint8)) for _ in range(40)]
        strings += [b"a" * 150, b"b" + b"a" * 149, strings[0] + strings[1], strings[1] + strings[0], strings[0]]
        docs, groups = r.integers(0, 12, len(strings)), r.integers(0, 3, len(strings)) * 5
        seen = defaultdict(set)
        for s, d, g in zip(strings, docs, groups, strict=True):
            for at in range(len(s) - length + 1):
                seen[g, s[at : at + length]].add(d)
        want = [(k, at) for k, s in enumerate(strings) for at in range(len(s) - length + 1) if min(seen[groups[k], s[at : at + length]]) < docs[k]]
        got = suffix_dedup.repeated(strings, docs, length, groups)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
    read, places = [], suffix_dedup._places
    monkeypatch.setattr(suffix_dedup, "_places", lambda low, size: read.append(int(size.sum())) or places(low, size))
    passage = bytes(r.integers(0, 250, 5000).astype(np.uint8))
    strings = [passage + b"one", b"two" + passage]
    which, offset = suffix_dedup.repeated(strings, np.array([1, 2]))
    assert set(which.tolist()) == {1} and offset.tolist() == list(range(3, 3 + 5000 - 49))
    assert sum(read) < 4 * sum(map(len, strings))  # 50 rounds


def test_interval_expansion_begins_with_prefixes_that_the_sorts_give(monkeypatch):
    """Equal to brute force where sorting stops early; suffixes that differ early are read in two sorts, not in each round up to where they differ."""
    r = np.random.default_rng(8)
    say = lambda n: bytes(r.choice(list(b"acgt"), n).tolist())
    passages = [say(n) for n in (49, 50, 51, 64, 90)]
    strings = [say(int(r.integers(0, 12))) + passages[k % 5][k % 3 : 90 - k % 7] + say(int(r.integers(0, 12))) for k in range(60)] + [say(70) for _ in range(600)]
    strings += [passages[4] * 2, b"a" * 120, b"", b"a" * 51, say(9)]
    docs, groups = r.integers(0, 40, len(strings)), np.arange(len(strings)) % 2
    docs[:10] = 7  # strings of one document that share passages
    seen = defaultdict(set)
    for s, d, g in zip(strings, docs, groups, strict=True):
        for at in range(len(s) - 49):
            seen[g, s[at : at + 50]].add(d)
    want = [(k, at) for k, s in enumerate(strings) for at in range(len(s) - 49) if min(seen[groups[k], s[at : at + 50]]) < docs[k]]
    read, places = [], suffix_dedup._places
    monkeypatch.setattr(suffix_dedup, "_places", lambda low, size: read.append(int(size.sum())) or places(low, size))
    got = suffix_dedup.repeated(strings, docs, 50, groups)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want and len(want) > 500
    assert sum(read) < sum(map(len, strings))


def test_runs_do_not_depend_on_how_much_is_hashed_at_once(monkeypatch):
    r = np.random.default_rng(9)
    texts = [bytes(r.integers(97, 100, int(n)).astype(np.uint8)) for n in r.integers(0, 700, 80)] + [b"a" * 900, b""]

    def windows():
        return sorted((k, a + i, h) for h, k, a, n in zip(*(x.tolist() for x in suffix_dedup.runs(texts)), strict=True) for i in range(n))

    whole = windows()
    assert [w[:2] for w in whole] == [(k, a) for k, t in enumerate(texts) for a in range(len(t) - 49)]
    for block in (60, 128, 4096):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        assert windows() == whole


def test_quality_counts_and_verdicts(docs, nothing):
    for x in quality.judged(docs).collect():
        t = next(t or "" for d, t, *_ in corpus() if d == x.doc_id)
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(grams)
        under = {k + i for k, g in enumerate(grams) if often[g] > 1 for i in range(5)}
        lines = [line for line in t.split("\n") if words(line)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under))
        assert x.base_failed == (len(w) < 10 or 100 * len(under) > 20 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality.judged(nothing).count() == 0


def plain_mcd(x, centre, cov, h):
    """Concentration steps on sorted distances until the determinant stops falling."""
    target, det = np.diag(np.square(quality.SPREAD)), np.inf
    while True:
        d = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
        near = x[np.lexsort([*x.T[::-1], np.round(d, 9)])[:h]]
        centre, cov = near.mean(0), np.cov(near.T, bias=True) + target
        now = np.linalg.slogdet(cov)[1]
        if now >= det - 1e-10:
            return det, best
        det, best = now, (centre, cov)


def test_outliers_against_plain_mcd(spark):
    """The estimate is a plain one's fixed point, its determinant that of the best of many random starts, with ties, a small group and failed rows."""
    r = np.random.default_rng(5)
    rows = []
    for grp, size in (("a", 300), ("b", 90), ("small", 12)):
        for _ in range(size):
            n = int(np.exp(r.normal(5, 0.4)))
            rows.append(("en", grp, n, n * 5 + int(r.integers(0, 9)), int(r.integers(0, 3)) * n // 40, 0, 0, 5))
    rows += rows[:40] + [("en", "a", 200, 1000, 900, 0, 0, 5)] * 20 + [("en", "b", 3, 9, 0, 0, 0, 1)] * 5 + [("en", "small", 200, 1000, 900, 0, 0, 5)]
    counts = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, lang string, source string, " + quality.COUNTS)
    out = quality.grouped(quality.vectors(counts)).cache()
    got = {x.grp: x for x in quality.mcd(out).collect()}
    told = [x for x in out.collect() if x.grp is not None]
    name = lambda g: f'{{"lang":"en","source":"{g}"}}'
    assert set(got) == {name("a"), name("b"), name("small"), '{"lang":"en"}', quality.ALL} and got[name("small")].n == 13
    far = set()
    for grp, e in got.items():
        x = np.array([[v[a] for a in quality.AXES] for v in told if grp in (v.grp, v.wider, quality.ALL)])
        h, target = -(-3 * len(x) // 4), np.diag(np.square(quality.SPREAD))
        tries = [plain_mcd(x, np.median(x, 0), target, h)] + [plain_mcd(x, x[p].mean(0), np.cov(x[p].T, bias=True) + target, h) for p in (r.choice(len(x), 8) for _ in range(60))]
        assert e.logdet <= min(t[0] for t in tries) + 1e-3
        inverse, centre = np.zeros((5, 5)), np.array([e[f"m{i}"] for i in range(5)])
        for i, j in quality.PAIRS:
            inverse[i, j] = inverse[j, i] = e[f"p{i}{j}"]
        # No plain step lowers the determinant, or moves the centre.
        det, (moved, cov) = plain_mcd(x, centre, np.linalg.inv(inverse), h)
        assert abs(det - e.logdet) < 1e-5 and np.allclose(moved, centre, atol=1e-3)
        d = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
        scale = max(1.0, np.sort(d)[-(-len(d) // 2) - 1] / quality.CHI2_MEDIAN)
        assert abs(scale - e.scale) < 1e-6
        far |= {v.doc_id for v in told if v.grp == grp and (y := np.array([v[a] for a in quality.AXES]) - centre) @ np.linalg.inv(cov) @ y / scale > quality.CUT}
    # Narrowing the bins around the h-th distance, as for groups that no task may sort, ends at the same vectors.
    for x in quality.mcd(out, most=4).collect():
        assert all(abs(x[c] - got[x.grp][c]) < 1e-6 for c in ("logdet", "scale", "m0", "p00"))
    joined = out.join(quality.mcd(out), "grp").withColumn("d", quality.distance() / F.col("scale"))
    assert {x.doc_id for x in joined.where(f"d > {quality.CUT}").collect()} == far and len(far) >= 21


def test_outliers_weigh_groups_smoothly(spark):
    """A group's estimate weighs n / (n + PRIOR) beside its language's: one more row hardly moves a verdict, at any size; a lone row is judged by the others."""
    r = np.random.default_rng(9)
    row = lambda grp, mean: ("en", grp, n := int(np.exp(r.normal(mean, 0.4))), n * 5 + int(r.integers(0, 9)), int(r.integers(0, 3)), 0, 0, 5)
    most, others = [row("g", 6) for _ in range(60)], [row("rest", 5) for _ in range(200)]
    lone = [("de", "lone", 200, 1000, 0, 0, 0, 5), ("de", "odd", 200, 9000, 900, 0, 0, 5)]
    found = {}
    for size in (59, 60):
        rows = most[:size] + others + lone
        counts = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, lang string, source string, " + quality.COUNTS)
        rows = quality.grouped(quality.vectors(counts))
        estimate = quality.mcd(rows)
        told = {x.grp: x for x in quality.weighed(rows, estimate).collect()}
        own = {x.grp: x for x in estimate.collect()}
        key = '{"lang":"en","source":"g"}'
        # The plain formula, for one axis of the centre.
        centre = own[quality.ALL].m0
        for grp in ('{"lang":"en"}', key):
            w = own[grp].n / (own[grp].n + quality.PRIOR)
            centre = w * own[grp].m0 + (1 - w) * centre
        assert abs(told[key].m0 - centre) < 1e-9 and len(told) == 4
        out = {x.source + str(x.doc_id): x.d for x in quality.beside(rows, quality.weighed(rows, estimate), "grp").withColumn("d", quality.distance()).collect()}
        found[size] = [out[f"g{k}"] for k in range(size)]
        assert out[f"odd{size + 201}"] > quality.CUT > out[f"lone{size + 200}"]
    for a, b in [(59, 60)]:
        assert np.allclose(found[a], found[b][:a], rtol=0.1, atol=0.3)


def test_ring_sharding(docs, nothing):
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.lit(0).alias("crc"))
    rows = sharding.ring_shards(sized, "doc_id", ["size"], 7).collect()
    loads = Counter(x.shard for x in rows)
    assert len(rows) == len(corpus()) and max(loads.values()) - min(loads.values()) <= 1
    assert all(sorted(x.slot for x in rows if x.shard == s) == list(range(n)) for s, n in loads.items())
    assert sharding.ring_shards(sized.where("false"), "doc_id", ["size"], 7).count() == 0


def test_op2_shard_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.op2_shard(spark, str(tmp_path)).collect()
    told = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in rows) == Counter((d, *told(t)) for d, t, *_ in corpus())
    assert {(x.law, x.grown_shard) for x in rows} == {("rows", None)}
    loads = Counter(x.shard for x in rows)
    assert set(loads) <= set(range(40)) and max(loads.values()) - min(loads[k] for k in range(40)) <= 1
    assert Counter((x.shard, x.slot) for x in rows) == Counter((k, i) for k, n in loads.items() for i in range(n))


def test_ring_moves_little(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"))
    a = {x.doc_id: x.shard for x in sharding.ring_shards(keys, "doc_id", [], 20).collect()}
    b = {x.doc_id: x.shard for x in sharding.ring_shards(keys, "doc_id", [], 21).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.packed_documents(docs).collect()
    want = Counter()
    for d, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    for s in {x.sequence_id for x in rows}:
        at = 0
        for x in sorted((x for x in rows if x.sequence_id == s), key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096
    lengths = np.array([x.length for x in rows])
    assert len({x.sequence_id for x in rows}) == packing.lower_bound(lengths, 4096)
    assert packing.packed_documents(nothing).count() == 0


def test_token_ids_of_random_strings():
    from tokenizers import Tokenizer

    import public_tokenizers

    of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r, ids = random.Random(7), packing.ChunkIds("word_bpe_49k.json")
    letters = [*"abIiZß.,;:!?%#$*&|()\"/-'0 9_@", *"İéÉǅŉΣς漢ſﬁÅ…’əñÑœёй", "\u0307", "\u0301", "\u0345", "\u0306", "\u212b"]
    texts = ["BİLGİ,", "İ.", "a\u0307,"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(30_000)]
    want = of.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in ids.of([t.encode() for t in texts])] == [w.ids for w in want]


def test_packing_exchanges_between_partitions(spark):
    r = np.random.default_rng(6)
    items = [(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(1, 61, 3000))]
    out = packing.pack(spark.createDataFrame(items, packing.PIECES), capacity=100, part=300).collect()
    assert sorted(x.doc_id for x in out) == list(range(3000))
    bound = packing.lower_bound(np.array([i[3] for i in items]), 100)
    assert bound <= len({x.sequence_id for x in out}) <= bound + max(2, bound // 100)


def test_chunk_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = packing.ChunkIds("word_bpe_49k.json", most=50)
    for t in ['a%%% b### c$$$, é&&& "q" x-y x- -x é"- (ab) ab). don\'t, x\'s.', "It's A.B, …. x́, <|endoftext|>. A!? 5. Été. Ünï", "The the THE, the. a.b.c ... 'tis I'll", "", "中文,  x　y", " ".join(f"w{k}x word{'a' * (k % 9)}" for k in range(90))]:
        assert ids.of([t.encode()])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def base(t):
    out = []
    for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [lambda: True, lambda: all(int(p) <= 255 for p in m[0].split(".")), lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), lambda: 10 <= len(digits) <= 15][kind]  # noqa: B023
            if ok():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


PERSONAL = [
    "write to a.b+c@mail.example.com or to x@y.z@q.r.s, @no, no@no, a@b..c", "1.2.3.4 and 1.2.3.4.5.6.7.8 and 300.1.1.1 v1.2.3 001.002.003.004", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111111",
    "+1 (337) 555-7349 or +44 20 7946 0958x +1 23 + 1 ++1234567890 +1234567890123456", "nothing here", "", None, "é@ö.de ü1@x.de 12@34.56.78.90",
]


def test_base_spans_are_the_plain_patterns():
    r = random.Random(8)
    made = ["".join(r.choice("a1.@+- ()2") for _ in range(60)) for _ in range(3000)]
    for t in made + [p or "" for p in PERSONAL]:
        assert pii.base_spans(t) == base(t)


def test_tagger_gradients_and_held_out(spark):
    r = random.Random(2)
    texts = [f"{' '.join('lorem ipsum dolor'.split()[: r.randint(1, 3)])} {r.choice(['abc.de@mail.example.com', '+1 (337) 555-7349', '129.45.227.94', '4111 1111 1111 1111'])} sit amet" for _ in range(240)]
    codes, tags = pii.examples(texts)
    small = pii.Tagger(hidden=3)
    assert np.allclose(small.emissions(codes[:5]).transpose(1, 2, 0), small.states(codes[:5]), atol=1e-5)
    small.p = {k: v.astype(np.float64) for k, v in small.p.items()}
    _, grads = small.loss_and_grads(codes[:4, :30], tags[:4, :30])
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, ends = small.p[k][at], []
        for step in (1e-3, -1e-3):
            small.p[k][at] = kept + step
            ends.append(small.loss_and_grads(codes[:4, :30], tags[:4, :30])[0])
        small.p[k][at] = kept
        assert abs((ends[0] - ends[1]) / 2e-3 - g[at]) < 1e-3 * max(1, abs(g[at]))
    n = len(codes) * 4 // 5
    tagger = pii.Tagger().fit(codes[:n], tags[:n], steps=60)
    held = tagger.paths(tagger.states(codes[n:]), np.full(len(codes) - n, pii.LEARNED))
    assert (held == tags[n:]).mean() > 0.97
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PERSONAL + texts[:5])], "doc_id long, text string, n_email int")
    for x in pii.personal_data(docs, tagger).collect():
        t = (PERSONAL + texts[:5])[x.doc_id] or ""
        spans = base(t)
        assert x.base_sha256 == hashlib.sha256(pii.told(spans).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(pii.told(spans).split(",")) <= set(x.spans.split(","))
    out = {x.doc_id: x.text for x in pii.masked_documents(docs, tagger).collect()}
    assert "@mail" not in out[0] and out[4] == "nothing here" and out[6] is None
    assert pii.personal_data(docs.where("false"), tagger).count() == 0


def test_decoding_is_one_path_over_each_whole_text():
    """Against a plain Viterbi over all characters of each text, with an untrained tagger that labels much, on short and long texts."""
    r = random.Random(3)
    tagger = pii.Tagger(hidden=3, seed=1)
    tagger.p["t"] = np.random.default_rng(2).standard_normal(tagger.p["t"].shape).astype(np.float32)
    tagger.p["c"][0] += 1.2
    texts = ["".join(r.choice("ab1@. é") for _ in range(n)) for n in (0, 1, 2, 50, 383, 384, 385, 720, 721, 1000, 30_000)]
    some = 0
    for text, got in zip(texts, pii.decode(tagger, texts), strict=True):
        codes = pii.char_codes(text)
        e, w = np.zeros((len(text), pii.N_TAGS)), np.zeros((len(text), 1))
        at = 0
        while text:
            part = codes[at : at + pii.WINDOW]
            each = np.minimum(np.arange(1, len(part) + 1), np.arange(len(part), 0, -1))[:, None]
            e[at : at + len(part)] += tagger.states(part[None])[0] * each
            w[at : at + len(part)] += each
            if at + pii.WINDOW >= len(text):
                break
            at += pii.HOP
        want = []
        if text:
            tags = tagger.paths((e / np.maximum(w, 1))[None].astype(np.float32), np.array([len(text)]))[0]
            for k, tag in enumerate(tags):
                if tag and tag % 2 == 1:
                    want.append([k, (tag - 1) // 2, k + 1])
                elif tag:
                    want[-1][2] = k + 1
        assert got == [tuple(x) for x in want]
        some += len(want)
    assert some > 20
    assert pii.open_runs(np.array([-1.0, 2, -1, -9, -1]), 0.0) == [(0, 3)]


def test_licenses(spark):
    texts = [
        "All rights reserved. CC BY 4.0. gnu General Public License, all rights reserved all RIGHTS reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in it without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy to deal", "licensed under the Apache License, Version 2.0", "licensed under the apache license 3 0", "cc by", "", None, "éall rights reserved",
    ]
    rows = {x.doc_id: x for x in licenses.licenses(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (rows[k].n_words, rows[k].n_base) == (len(w), len(at))
        assert rows[k].first_word == min((i for i, _ in at), default=None) and rows[k].last_word == max((i for i, _ in at), default=None)
        assert rows[k].base_labels == ",".join(sorted({label for _, label in at}))
        assert 0 <= rows[k].score <= 1 and set(filter(None, rows[k].base_labels.split(","))) <= set(rows[k].labels.split(","))
    assert rows[1].labels == "mit" and rows[2].labels == "" and rows[3].labels == "apache-2.0" and rows[4].labels == ""


def test_automaton_regions():
    a = licenses.Automaton("grant of [[ the [[ big ]] ]] {{2}} rights")
    yes = ["grant of rights", "grant of the rights", "grant of the big rights", "grant of any other rights", "grant of the big any other rights"]
    no = ["grant of big old new rights", "grant rights", "grant of the big a b c rights"]
    assert all(a.match(t.split(), 0) == len(t.split()) for t in yes) and not any(a.match(t.split(), 0) for t in no)
    with pytest.raises(ValueError):
        licenses.Automaton("{{2}} rights")


def test_scan_finds_what_the_automata_accept_anywhere():
    assert "gpl-short" in licenses.scan("GNU General Public License version 3", {"gpl-short": licenses.Automaton(licenses.TEMPLATES["gpl-short"])})[5]
    r = random.Random(11)
    templates = {**licenses.TEMPLATES, "one": "grant", "inner": "grant [[ of [[ all ]] ]] {{1}} rights"}
    automata = {label: licenses.Automaton(markup) for label, markup in templates.items()}
    found = Counter()
    for label, markup in list(templates.items()) * 40:
        said, drop = [], []
        for token in markup.split():
            if token == "[[":
                drop.append(r.random() < 0.5 or any(drop))
            elif token == "]]":
                drop.pop()
            elif not any(drop):
                said += ["x"] * r.randint(0, int(token[2:-2])) if token.startswith("{{") else [token]
        w = ["y"] * r.randint(0, 2) + said + ["grant"] * r.randint(0, 1) + said[: r.randint(0, 9)]
        places = [(name, p, n) for name, a in automata.items() for p in range(len(w)) if (n := a.match(w, p))]
        places += [(name, p, phrase.count(" ") + 1) for phrase, name in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + phrase.count(" ") + 1] == phrase.split()]
        *_, labels, score = licenses.scan(" ".join(w).title(), automata)
        assert labels == ",".join(sorted({name for name, *_ in places})) and label in labels.split(",")
        assert score == len({k for _, p, n in places for k in range(p, p + n)}) / len(w)
        found[label] += 1
    assert set(found) == set(templates)


def test_pages_go_on_behind_custom_and_unclosed_elements():
    said = lambda html: [t for _, t in html_text.Page(html).blocks]
    for gone in ("<svg-icon></svg-icon>", "<svg viewBox='0' />", "<svg/>", "<iframe/>", "<select-box>", "<template>", "<svg><path/>x</svg>", "<SCRIPT>a<b</script >", "<iframe src=x>x</iframe>"):
        assert said(f"<p>one</p>{gone}<p>two</p>") == ["one", "two"]
    assert said("<p>one</p><script>var a = '<p>two</p>'") == ["one"]


def test_op7_pages(spark, tmp_path):
    """Articles whole and in order, references decoded; null, empty and repeated pages; further columns; an empty table."""
    lines = ["A first line of the article, with &amp; in it and\n  white   space.", "Another line says more about it, and then some more words.", "The last line of it ends here, as all things do in time."]
    want = "\n".join(" ".join(x.replace("&amp;", "&").split()) for x in lines)
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article><footer><p>Imprint</p></footer><script>var a = 1</script></body></html>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (3, "v", ""), (None, "w", html.replace("<p>", "<p class='x'>"))]
    pages = spark.createDataFrame([(*x, "other", 5) for x in rows], "page_id long, url string, html string, text string, n_chars long")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(x) for x in html_text.op7_main_text(spark, str(tmp_path)).select("page_id", "url", "text", "n_chars").collect())
    assert got == Counter((p, u, want if h else "", len(want) if h else 0) for p, u, h in rows)
    pages.where("false").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_text.op7_main_text(spark, f"{tmp_path}/none").count() == 0


def test_pages_without_a_container():
    """Paragraphs straight in the body, with menus beside, in a bare div, loose and plain text, and a long page keep their text, whole and in order."""
    trees = html_text.Trees().fit(*html_text.labelled([]))
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    text = [say(n) for n in (30, 55, 12, 41)]
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    nav = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(6)) + "</ul></nav>"
    foot = "<footer><p>Imprint and terms</p></footer>"

    def main(html):
        page = html_text.Page(html)
        return page.text(trees.odds(page.features()))

    want = "\n".join(text)
    for html in (paragraphs, f"<body>{paragraphs}</body>", f"<html><body>{nav}{paragraphs}{foot}</body></html>", f"<html><body><div>{paragraphs}</div>{foot}</body></html>"):
        assert main(html) == want
    assert main(text[1]) == text[1] and main("<html><body>" + text[0] + "<br>" + text[1] + "</body></html>") == text[0] + " " + text[1]
    assert main(f"<html><body>{nav}{foot}</body></html>") == "" and main("") == ""
    long = [say(40) for _ in range(3000)]
    assert main("<html><body>" + nav + "<article>" + "".join(f"<p>{t}</p>" for t in long) + "</article>" + foot + "</body></html>") == "\n".join(long)


def test_decontamination(spark):
    r = random.Random(9)
    say = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    items = [say(n) for n in (15, 30, 30, 60)] + [say(4)]
    docs = [say(40) + items[0] + say(3), items[1], say(10) + items[2][:14] + ["x"] + items[2][15:], say(200), items[3][:50], items[1][:12] + say(30), [], None, items[1] * 40, items[4] * 3, say(9) + items[3][5:]]
    frame = spark.createDataFrame([(k, None if d is None else " ".join(d).title(), 0.5) for k, d in enumerate(docs)] + [(1, " ".join(items[1]).title(), 0.5)], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(k, " ".join(i), 1) for k, i in enumerate(items)] + [(9, None, 1)], "item_id long, text string, size int")

    def similarity(d, i):
        gram = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        best = 0.0
        for p in range(max(1, len(d) - len(i) + 1)):
            a, b = gram(d[p : p + len(i)]), gram(i)
            both = sum((a & b).values())
            best = max(best, both / max(1, sum(a.values()) + sum(b.values()) - both))
        return best

    want = {(k, j): round(s, 9) for k, d in enumerate(docs) if d for j, i in enumerate(items) if len(i) >= 5 and (s := similarity(d, i)) >= 0.75}
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontam.leaks(frame, bench).collect()}
    assert got == want and len(want) >= 5
    assert decontam.leaks(frame.where("false"), bench).count() == 0 and decontam.leaks(frame, bench.where("false")).count() == 0


def test_pipeline_tells_unlike_texts_of_one_doc_id_apart(spark, tmp_path):
    r = random.Random(13)
    say = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    item, near = say(30), say(60)
    clean = [say(60) for _ in range(5)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, clean[0]), (None, clean[1]), (None, "too short"), (7, clean[2]), (7, clean[3]), (7, clean[3]), (7, None), (None, say(20) + " " + item), (8, clean[4]), (8, say(9) + " " + item), (None, near), (9, near + " x"), (5, near + " y")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: Counter((x.doc_id, x.text) for x in df.collect())
    want = Counter(x for x in rows if x[1] not in (None, "too short"))
    assert told(corpus_pipeline.quality_rules(spark, docs, str(tmp_path))) == want
    want = Counter({x: 1 for x in rows if x != (None, near) and x != (9, near + " x")})
    assert told(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == want
    want = Counter(x for x in rows if item not in (x[1] or ""))
    assert told(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == want


def test_blocks_cover_the_radius(spark):
    r = random.Random(10)
    pairs = []
    for _ in range(50):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    rows = spark.createDataFrame(pairs, "a long, b long").select(decontam.blocks("a").alias("x"), decontam.blocks("b").alias("y"))
    assert rows.where(F.size(F.array_intersect("x", "y")) > 0).count() == 50
