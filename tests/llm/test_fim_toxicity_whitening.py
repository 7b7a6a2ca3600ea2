"""Fill-in-middle, toxicity and whitening against plain versions, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.llm import fim, toxicity, whitening

SCHEMA = "doc_id long, text string, lang string, n long, form string, output string, h1 int, text_ int"
ALPHABET = ["a", "b", "é", "ß", "漢", "😀", " ", "  ", "\n", "\t", " ", "<", ">", "P", "S", "M", "0"]


def fim_rows():
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " ", "\n\n", "word", "é", "<P>", "a <S> b c d", "x<M>", "a<", "<S", ">" * 9, "漢字 " * 4000, "plain ascii words " * 3000]
    rows = [(k, t, "en", 3, "f", "o", 1, 2) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "one two three four five", None, None, None, None, None, None)]


def plain_fim(doc_id, text, unit):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    w = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if unit == "word" else list(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle_against_a_plain_version(spark, unit):
    rows = fim_rows()
    out = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), unit=unit)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
    assert sorted((tuple(x[:6]) for x in got), key=key) == sorted((plain_fim(d, t, unit) for d, t, *_ in rows), key=key)
    texts = {d: t or "" for d, t, *_ in rows}
    assert all(x["back"] == texts[x.doc_id] for x in got) and {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA), keep=["doc_id", "lang", "form"]).count() == 0


def test_fill_in_middle_query_against_sql(spark, tmp_path):
    spark.createDataFrame(fim_rows(), SCHEMA).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(fim.OP11_SQL)
    got = fim.op11_fill_in_middle(spark, str(tmp_path)).select(*[c[0] for c in cur.description]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
    assert all(x.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for x in got for d, t, *_ in fim_rows() if d == x.doc_id)


def test_exceptions_convert_both_ways():
    text = "aé漢b😀 ß".encode() * 3
    index = fim.Exceptions(np.frombuffer(text, np.uint8))
    starts = np.array([len(text.decode()[:k].encode()) for k in range(len(text.decode()) + 1)])
    assert (index.chars(starts) == np.arange(len(starts))).all() and (index.bytes(np.arange(len(starts))) == starts).all()
    assert len(fim.Exceptions(np.frombuffer(b"only ascii", np.uint8)).at) == 0


# ---- toxicity

TOX = "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double, held_out int"


def tox_rows(n=3000):
    r = random.Random(11)
    words = ["".join(r.choice(["ba", "ko", "ri", "men", "to", "sa", "lu", "é"]) for _ in range(r.randint(1, 4))) for _ in range(500)]
    bad = ["grobian", "lumpish", "vileness"]
    rows, labels = [], []
    for k in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 5)):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((k, " ".join(text), "en", "s", 1, 9, 0.5, 4))
        if r.random() < 0.4:
            labels.append((k, int(r.random() < 0.5), int(toxic)))
    special = [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (n + 3, "x" * 70_000), (n + 4, "kobari " * 20_000 + "grobian lumpish"), (None, "grobian lumpish vileness"), (None, "kori bato")]
    return [*rows, rows[0], rows[0], *[(d, t, None, None, None, None, None, None) for d, t in special]], labels


@pytest.fixture(scope="module")
def tox(spark):
    rows, labels = tox_rows()
    labels = [*labels, (None, 1, 1), (labels[0][0], 1, 1 - labels[0][2]), (77_777, 0, 1), (5, 0, None)]
    return rows, labels, spark.createDataFrame(rows, TOX).repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(tox):
    rows, labels, docs, told = tox
    got = toxicity.scored(docs, told).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert sorted((x.doc_id is None, x.doc_id or 0, x.held_out) for x in got) == sorted((d is None, d or 0, held(d)) for d, *_ in rows)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    bad = lambda t: any(w in (t or "") for w in ("grobian", "lumpish", "vileness"))
    texts = {d: t for d, t, *_ in rows if d is not None and d < 3000}
    found = {x.doc_id: x.predicted for x in got if x.doc_id in texts}
    right = [found[d] == bad(t) for d, t in texts.items() if held(d)]
    assert len(right) > 500 and np.mean(right) > 0.99
    assert sorted(x.predicted for x in got if x.doc_id is None) == [0, 1]
    assert len({x.score for x in got if x.doc_id == 0}) == 1 and len({x.score for x in got if x.doc_id in (3000, 3001, 3002)}) == 1


def test_held_out_labels_are_never_read(spark, tox):
    _, labels, docs, told = tox
    turned = told.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    ask = docs.where("doc_id % 50 = 0 OR doc_id IS NULL")
    one, two = toxicity.learned(docs, told), toxicity.learned(docs, turned)
    assert (one.weights == two.weights).all() and one.bias == two.bias
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    three = toxicity.learned(other, told)
    texts = pa.array([t.text or "" for t in ask.select("text").collect()])
    assert (one.scores(texts) == three.scores(texts)).all()


def test_toxicity_without_labels_or_rows(spark, tox):
    _, _, docs, told = tox
    assert {(x.score, x.predicted) for x in toxicity.scored(docs.limit(20), told.where("false")).collect()} == {(0.0, 0)}
    assert toxicity.scored(docs.where("false"), told).count() == 0


def test_keys_against_a_plain_version():
    texts = ["Abc defg, hijklmnopq", "", "über Über " * 5, "a" * 40 + "-" + "b" * 33, "end", "next"]

    def plain(text):
        out, raw = [], bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in text.encode())
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", raw):
            mix = lambda h, tag: (((h ^ tag) * 0x9E3779B1) & 0xFFFFFFFF) >> 2
            h = 2166136261
            for k, b in enumerate(word[:32], 1):
                h = ((h ^ b) * 16777619) & 0xFFFFFFFF
                if k in toxicity.BEGINNINGS:
                    out.append(mix(h, k))
            out.append(mix(h if len(word) <= 32 else zlib.crc32(word), 0))
        return sorted(out)

    rows, keys, words = toxicity.keys_of(pa.array(texts))
    assert [sorted(keys[rows == k].tolist()) for k in range(len(texts))] == [plain(t) for t in texts]
    assert words.tolist() == [len(re.findall(r"[^\W_]+", t)) for t in texts]


def test_risk_stays_non_negative_and_the_prior_counts():
    r = np.random.default_rng(3)
    toxic = np.r_[np.ones(200, bool), np.zeros(2000, bool)]
    hidden = np.r_[np.ones(200, bool), r.random(2000) < 0.2]
    rows, at = np.nonzero(np.c_[hidden & (r.random(2200) < 0.9), r.random((2200, 40)) < 0.1])
    w, bias, risks = toxicity.non_negative_fit(rows, at, toxic, 41, 0.2)
    p = 1 / (1 + np.exp(-(np.bincount(rows, w[at], minlength=2200) + bias)))
    assert min(risks) >= 0 and risks[-1] < risks[0]
    assert w[0] > 2 * np.abs(w[1:]).max() and np.mean((p >= 0.3)[200:] == hidden[200:]) > 0.95


# ---- whitening

VEC = "vec_id long, embedding array<float>, label int, x int, n string"


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    e, c = np.linalg.eigh(((n * x - s) / n).T @ ((n * x - s) / n) / n)
    order = np.argsort(-e)
    return n, [sum(int(v) ** 2 for v in row) for row in (n * x - s).tolist()], e[order], c[:, order], (n * x - s) / n, e.sum()


def check_whitening(spark, rows, good, components=32):
    got = whitening.whitened_vectors(spark.createDataFrame(rows, VEC).repartition(3), components=components).collect()
    n, deviation, e, c, centred, trace = plain_whitening([v for _, v in good])
    there = min(components, int(np.sum(e > 1e-12 * e[0])))
    assert len(got) == len(good) * there and {x.component for x in got} == set(range(1, there + 1))
    assert {x.n for x in got} == {n} and max(x.identity_error for x in got) < 1e-9
    for x in got:
        assert abs(x.explained - e[x.component - 1] / trace) <= 1e-9 * x.explained
    whole = np.array([x.whitened for x in got]).reshape(-1, there)
    assert np.allclose(whole.T @ whole / n, np.eye(there), atol=1e-9)
    want = centred @ c[:, :there] / np.sqrt(e[:there])
    by = {}
    for x in got:
        by.setdefault((x.vec_id, x.deviation), []).append(abs(x.whitened))
    return by, sorted(zip([d for d, _ in good], deviation, strict=True), key=str), np.abs(want), got


def test_whitening_against_eigh(spark):
    r = np.random.default_rng(1)
    mix = r.normal(size=(40, 40)) * np.linspace(3, 0.01, 40)
    good = [(k, (r.normal(size=40) @ mix).astype(np.float32).tolist()) for k in range(300)]
    good += [good[0], good[0], (None, good[1][1])]
    bad = [(900, None), (901, [float("nan")] * 40), (902, [1.0] * 39 + [None]), (903, [float("inf")] + [0.0] * 39), (904, [1.0, 2.0]), (905, [])]
    rows = [(d, v, 1, 2, "n") for d, v in [*good, *bad]]
    by, told, want, got = check_whitening(spark, rows, good)
    assert sorted({k for k in by}, key=str) == sorted(set(told), key=str)
    some = {x.component: abs(x.whitened) for x in got if x.vec_id == 7}
    assert np.allclose([some[k] for k in sorted(some)], want[7][: len(some)], atol=1e-7)


def test_whitening_of_few_directions_and_repeated_values(spark):
    r = np.random.default_rng(2)
    low = [(k, (np.round(r.normal(size=3) * 4) @ np.eye(3, 10)).tolist()) for k in range(60)]
    check_whitening(spark, [(d, v, 1, 2, "n") for d, v in low], low)
    cube = [(k, [float(2 * (k >> b & 1) - 1) for b in range(6)]) for k in range(64)]  # six equal eigenvalues
    check_whitening(spark, [(d, v, 1, 2, "n") for d, v in cube], cube, components=4)


def test_whitening_without_variance_or_rows(spark):
    same = [(k, [1.0, 2.0], 1, 2, "n") for k in range(5)]
    assert whitening.whitened_vectors(spark.createDataFrame(same, VEC)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([], VEC)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([(1, None, 1, 1, "")], VEC)).count() == 0
    far = [(1, [1e30, 0.0], 1, 2, "n"), (2, [-1e30, 0.5], 1, 2, "n"), (3, [0.0, 1.0], 1, 2, "n")]
    assert {x.deviation for x in whitening.whitened_vectors(spark.createDataFrame(far, VEC)).collect() if x.vec_id == 1} == {None}


def test_steps_end_early_only_when_none_can_be_missed():
    r = np.random.default_rng(4)
    a = r.normal(size=(500, 200)) * np.r_[np.linspace(30, 20, 10), np.full(190, 1e-3)]
    passes = []

    def product(q):
        passes.append(1)
        u = a @ q
        return np.append(a.T @ u, u @ u)

    v, s = whitening.bidiagonalised(product, 200, float((a**2).sum()), 8)
    assert len(passes) < 60 and np.allclose(s[:8], np.linalg.svd(a)[1][:8], rtol=1e-12)
    assert np.allclose(np.abs(v[:8] @ np.linalg.svd(a)[2][:8].T), np.eye(8), atol=1e-8)
