"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, whatever its
labels say. The linear classifier's risk is pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]):
what the unlabelled texts cost as negatives, less the share of it that is due to the
toxic ones among them, and never below 0. Where that part falls below 0, a step
goes against it alone, so that the classifier cannot win by overfitting the positives. pi, the
class prior, is the share of toxic ones among the labelled rows that may be learnt from.

Keys are hashes of whole words and of word beginnings of 4, 6 and 8 bytes, read from the text's
bytes, A-Z lower-cased. A key gives a feature for being there, and more for being there often and densely
(LEVELS), as a stem of invented words also comes by chance. Tasks count the sample's
documents by feature, Spark adds them up, and those that most mark the positives are kept.

Bounds: the fit reads at most SAMPLE_TOXIC confirmed documents and about SAMPLE_PLAIN others, chosen by
hash, of whole texts; every text is scored, in full. FEATURES features are kept.

Cases: a null or empty text is scored by the bias alone; repeated rows are scored alike; null
doc_ids are not held out and have no label; a doc_id labelled both ways counts as toxic;
without a confirmed toxic document all scores are 0; an empty table gives an
empty result; lang, source, doc_id and all other columns are never read by a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, chunks, table

THRESHOLD = 0.3
SAMPLE_TOXIC, SAMPLE_PLAIN, FEATURES = 3_000, 12_000, 2_048
BEGINNINGS = (4, 6, 8)
#: Least times and least share of a text's words for each feature of a key.
LEVELS = [(1, 0.0), (2, 0.004), (3, 0.008)]
#: Words of more bytes are hashed one by one.
LONG = 32


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z lower-cased, and where each text starts and the last one ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data), offsets - offsets[0]


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and 30-bit key of each word and word beginning, with repeats; the words of each text."""
    data, offsets = _buffer(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    letter = ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0x30) & (data <= 0x39)) | (data >= 0x80)
    fresh, last = letter.copy(), letter.copy()
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before, behind = letter[:-1].copy(), letter[1:].copy()
    before[inner - 1] = False
    behind[inner - 1] = False
    fresh[1:] &= ~before
    last[:-1] &= ~behind
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    size = ends - starts
    rows, out = [], []

    def put(at: np.ndarray, h: np.ndarray, tag: int) -> None:
        rows.append(owner[at])
        out.append((((h ^ np.uint32(tag)) * np.uint32(0x9E3779B1)) >> np.uint32(2)).astype(np.int64))

    long = np.flatnonzero(size > LONG)
    if len(long):
        put(long, np.array([zlib.crc32(data[starts[k] : ends[k]].tobytes()) for k in long], np.uint32), 0)
    h = np.full(len(starts), 2166136261, np.uint32)
    live = np.flatnonzero(size > 0)
    for k in range(LONG):
        h[live] = (h[live] ^ data[starts[live] + k]) * np.uint32(16777619)
        if k + 1 in BEGINNINGS:
            put(live, h[live], k + 1)
        done = size[live] == k + 1
        put(live[done], h[live[done]], 0)
        live = live[~done]
        if not len(live):
            break
    return np.concatenate(rows), np.concatenate(out), np.bincount(owner, minlength=len(texts))


def features(rows: np.ndarray, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature, once each, in ascending order of both: a key's number by four, and the level that it has."""
    both, times = np.unique((rows << 30) | keys, return_counts=True)
    rows, keys = both >> 30, both & ((1 << 30) - 1)
    has = [(times >= least) & (times >= share * words[rows]) for least, share in LEVELS]
    found = np.sort(np.concatenate([(rows[h] << 32) | (keys[h] << 2) | level for level, h in enumerate(has)]))
    return found >> 32, found & 0xFFFFFFFF


@dataclass
class Vocabulary:
    """The kept features in ascending order; `maybe` rules most other keys out by their upper bits."""

    kept: np.ndarray
    maybe: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.kept >> 12] = True

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text number and place in `kept` of each kept feature that a text has, once each."""
        if not len(self.kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, keys, words = keys_of(texts)
        likely = self.maybe[keys >> 10]
        rows, found = features(rows[likely], keys[likely], words)
        at = np.minimum(np.searchsorted(self.kept, found), len(self.kept) - 1)
        same = self.kept[at] == found
        return rows[same], at[same]


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, at = self.vocabulary.places(texts)
        g = np.bincount(rows, self.weights[at], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def non_negative_fit(rows: np.ndarray, at: np.ndarray, toxic: np.ndarray, size: int, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk by step. rows and at are the features of each text, toxic tells positives from unlabelled ones."""
    n = len(toxic)
    share = np.where(toxic, 1 / max(1, toxic.sum()), 1 / max(1, (~toxic).sum()))
    w, moments = np.zeros(size + 1), np.zeros((2, size + 1))
    w[-1] = np.log(prior / (1 - prior))
    risks = []
    for step in range(1, steps + 1):
        g = np.clip(np.bincount(rows, w[at], minlength=n) + w[-1], -60, 60)
        p = 1 / (1 + np.exp(-g))
        low, high = np.logaddexp(0, -g) * share, np.logaddexp(0, g) * share  # losses as a positive and as a negative
        plain = high[~toxic].sum() - prior * high[toxic].sum()
        risks.append(prior * low[toxic].sum() + max(0.0, plain))
        as_plain = share * p * np.where(toxic, -prior, 1.0)
        slope = as_plain + np.where(toxic, prior * share * (p - 1), 0.0) if plain >= 0 else -as_plain
        grad = np.append(np.bincount(at, slope[rows], minlength=size), slope.sum())
        grad[:-1] += decay * w[:-1]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        w -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1]), risks


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hash_below(rows: DataFrame, n: int, total: int) -> Column:
    """About n of total rows, the same ones in every run."""
    return F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < min(1 << 30, (n << 30) // max(1, total) + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, for positives and others, as a partial sum of each batch."""
    for batch in chunks(batches):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        rows, found = features(*keys_of(batch.column("text")))
        kinds, of = np.unique(found, return_inverse=True)
        counts = [np.bincount(of, kind, minlength=len(kinds)).astype(np.int64) for kind in (toxic[rows], ~toxic[rows])]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, counts)], names=["feature", "toxic", "plain"])


def chosen(counts: DataFrame, n_toxic: int, n_plain: int, most: int = FEATURES) -> np.ndarray:
    """The features over-represented in the positives: those whose log-likelihood ratio passes the logarithm of the number of features, which chance gives to about one of them."""
    a, b = F.col("toxic") / n_toxic, (F.col("plain") + 0.5) / (n_plain + 1)
    gain = F.col("toxic") * F.log(a / b) + F.when(F.col("toxic") < n_toxic, (n_toxic - F.col("toxic")) * F.log((1 - a) / (1 - b))).otherwise(0.0)
    best = counts.where(F.col("toxic") >= 3).where(a > b).withColumn("gain", gain).where(F.col("gain") > float(np.log(max(2, counts.count()))))
    return np.sort(np.array([r[0] for r in best.orderBy(F.desc("gain"), "feature").limit(most).select("feature").collect()], np.int64))


def learned(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier, from rows that are not held out; None without a confirmed toxic document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~_held_out(F.col("doc_id")))
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    with Tables(docs.sparkSession) as tables:
        told = tables.put("told", told)
        n_told, n_toxic = told.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
        if not n_toxic:
            return None
        prior = min(0.9, n_toxic / n_told)
        some = told.where("toxic = 1").select("doc_id")
        some = some.where(_hash_below(some, SAMPLE_TOXIC, n_toxic)).limit(2 * SAMPLE_TOXIC)
        marked = docs.join(F.broadcast(some), "doc_id", "left_semi").select("text", F.lit(True).alias("toxic"))
        plain = docs.where(_hash_below(docs, SAMPLE_PLAIN, docs.count())).select("text", F.lit(False).alias("toxic"))
        sample = tables.put("sample", marked.unionByName(plain))
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not sizes.get(True):
            return None
        counts = sample.mapInArrow(_counted, "feature long, toxic long, plain long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
        vocabulary = Vocabulary(chosen(tables.put("counts", counts), sizes[True], sizes.get(False, 0)))

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                rows, at = vocabulary.places(batch.column("text"))
                ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], names=["toxic", "at"])

        found = sample.mapInArrow(reduced, "toxic boolean, at array<int>").toArrow()
    toxic = found["toxic"].to_numpy(zero_copy_only=False).astype(bool)
    lists = found["at"].combine_chunks()
    rows = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy())
    weights, bias, _ = non_negative_fit(rows, lists.flatten().to_numpy(), toxic, len(vocabulary.kept), prior)
    return Classifier(vocabulary, weights, bias)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learned(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = model.scores(batch.column("text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels that are not held out."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
