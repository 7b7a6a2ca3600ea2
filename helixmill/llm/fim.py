"""Fill-in-middle transformation with a sparse index of multibyte characters.

A batch's texts are one buffer of UTF-8 bytes. White space is ASCII, so token ends
are found on bytes, for all texts at once. The index holds only the characters of
more than one byte: where each starts, and how many bytes over one all before it
have. A place in bytes is turned into one in code points, and back, by a binary
search in it; between two of its entries both differ by a constant, and a batch
of ASCII needs no entry.

Cases: a null text is an empty one, which stays plain; a null doc_id draws as an
empty one does ("42:"); repeated rows draw alike; a text that holds a marker stays
plain, so that the parts can be told apart in the output; an empty table gives an
empty result; of other columns only those named in `keep` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
CUT = "n long, form string, prefix_chars long, middle_chars long, output binary"


class Exceptions:
    """The characters of more than one byte in a buffer of UTF-8."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.at_chars = self.at - self.excess[:-1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte place, which is the start of a character or the end of the buffer."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each place in code points."""
        return at + self.excess[np.searchsorted(self.at_chars, at)]


def token_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens end: a run of other characters with the white space before it, or white space at the end of a text."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    over = np.zeros(len(data) + 1, bool)
    over[1:-1] = ~space[:-1] & space[1:]
    over[starts] = False
    over[ends[ends > starts]] = True
    return np.flatnonzero(over)


def cut_batch(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text, the byte places of its two cuts, and the code points before and between them.

    first and second are draws; a cut is a draw modulo the units and one.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    index = Exceptions(data)
    if unit == "char":
        before = index.chars(starts)
        n = index.chars(ends) - before
        place = lambda k: index.bytes(before + k)
    else:
        tokens = token_ends(data, starts, ends)
        before = np.searchsorted(tokens, starts, side="right")
        n = np.searchsorted(tokens, ends, side="right") - before
        padded = np.append(tokens, 0)
        place = lambda k: np.where(k == 0, starts, padded[before + k - 1])
    a, b = first % (n + 1), second % (n + 1)
    low, high = place(np.minimum(a, b)), place(np.maximum(a, b))
    chars = index.chars(np.stack([starts, low, high]))
    return n, low - starts, high - starts, chars[1] - chars[0], chars[2] - chars[1]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four draws below 2 ** 32 from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "word") -> DataFrame:
    """docs' columns in `keep` (doc_id by default), with n, form, prefix_chars, middle_chars and the output text.

    Of a hundred documents, `rate` are cut, `spm_rate` of a hundred of them with the suffix first.
    unit is "word" (with the white space before it) or "char".
    """
    keep = keep or ["doc_id"]
    own = T.StructType([T.StructField(f"keep{k}", docs.schema[c].dataType) for k, c in enumerate(keep)])
    schema = T.StructType(own.fields + T._parse_datatype_string(CUT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        for batch in chunks(batches, "text_"):
            at = batch.schema.get_field_index("text_")
            texts = batch.column(at)
            h = [batch.column(at + 1 + k).to_numpy() for k in range(4)]
            n, low, high, before, between = cut_batch(texts, h[0], h[1], unit)
            rows = []
            for text, a, b, cut, spm in zip(texts.cast(pa.binary()).to_pylist(), low.tolist(), high.tolist(), (h[2] % 100 < rate).tolist(), (h[3] % 100 < spm_rate).tolist(), strict=True):
                if not cut or not text or p in text or s in text or m in text:
                    rows.append(("plain", text))
                elif spm:
                    rows.append(("spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))))
                else:
                    rows.append(("psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))))
            form, output = zip(*rows, strict=True)
            plain = np.array([f == "plain" for f in form])
            columns = [batch.column(k) for k in range(at)]
            columns += [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    text = F.coalesce("text", F.lit("")).alias("text_")
    out = docs.select(*[F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)], text, *draws(F.col("doc_id"), seed)).mapInArrow(run, schema)
    return out.select(*[F.col(f"keep{k}").alias(c) for k, c in enumerate(keep)], "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. No marker stands in a text that was cut, nor across two parts, as none begins with its own end."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed; the digest of the text rebuilt from its output beside that of the output."""
    docs = table(spark, sf_dir, "documents")
    out = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
placed AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
