"""Best-fit packing with bound-certified repacking.

Documents become token pieces of at most `capacity` tokens. Pieces are dealt to
partitions of about PART pieces; each partition packs its pieces best-fit
decreasing and compares its bin count with a lower bound from dual-feasible
functions. Bins that the bound does not justify (the partition's least filled
ones) give their pieces back; the given-back pieces of all partitions are dealt
again to fewer partitions, which rerun best-fit decreasing, until nothing is left
to exchange or one partition holds the rest. What is exchanged shrinks from round to round.

Token ids of a text are those of its white-space separated chunks in a row (the
tokenizer's pre-tokenizer drops white space and never looks across it), so each
worker keeps the ids of chunks that it has met; the store drops its newer half when full.

Cases: a null or empty text is one piece with the end id alone; only documents
longer than the capacity are cut; repeated rows are pieces of their own; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, chunks, table, written

CAPACITY = 4096
END_ID = 1
PART = 20_000
#: Characters that the tokenizer parts from letters and takes as one run; no apostrophe, which begins tokens of its own.
MARKS = b".,;:!?%#$*&|()\"/-"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkIds:
    """Little-endian ids of chunks, by chunk."""

    def __init__(self, tokenizer: str, most: int = 1_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        of = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.encode = of.encode_batch_fast
        of_words = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        of_words.normalizer = normalizers.Sequence([])
        of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        of_words.model._resize_cache(0)  # no word comes twice
        self.encode_words = of_words.encode_batch_fast
        vocab = of.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes] = {}
        self.most = most

    def learn(self, new: list[bytes]) -> None:
        """The tokenizer lower-cases and parts letters from other characters: ids of `Word,` are those of `word` and `,`, those of `a%%%` of `a` and `%%%`.

        Words of Latin letters are one token run each, which ends in a word-end token. They
        are lower-cased here and encoded many at a time without the tokenizer's
        normalizing steps, which would leave them as they are, and told apart by these ends.
        """
        parted, words, rest = [], set(), set()
        for chunk in new:
            bare = chunk.rstrip(MARKS)
            core, mark = bare.decode(), chunk[len(bare) :]
            plain = core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core and is_normalized("NFC", core)))
            if not plain:
                # Other letters may change when lower-cased, or end in a combining mark, which takes the marks behind it: whole.
                core, mark = chunk.decode(), b""
            elif mark and mark not in self.ids:
                rest.add(mark)
            if plain:
                core = core.lower()
            key = core.encode()
            parted.append((chunk, key, mark))
            if key not in self.ids:
                (words if plain else rest).add(key)
        words = list(words)
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            coded = self.encode_words([b" ".join(part).decode()], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.is_end[coded]) + 1
            if len(ends) == len(part) and ends[-1] == len(coded):
                packed, first = np.array(coded, "<u4").tobytes(), 0
                for core, end in zip(part, (4 * ends).tolist(), strict=True):
                    self.ids[core] = packed[first:end]
                    first = end
            else:
                rest.update(part)
        rest = list(rest)
        for core, coded in zip(rest, self.encode([x.decode() for x in rest], add_special_tokens=False), strict=True):
            self.ids[core] = struct.pack(f"<{len(coded)}I", *coded.ids)
        for chunk, core, mark in parted:
            self.ids[chunk] = self.ids[core] + self.ids[mark] if mark else self.ids[core]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; what is new is learnt for all of them at once."""
        split = [t.split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.ids)
        if new:
            if len(self.ids) + len(new) > self.most:
                # Common chunks are met early: the older half stays.
                self.ids = dict(islice(self.ids.items(), self.most // 2))
                new = set(chain.from_iterable(split)).difference(self.ids)
            self.learn(list(new))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


_ids: dict[str, ChunkIds] = {}


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ids:
            _ids[tokenizer] = ChunkIds(tokenizer)
        ids = _ids[tokenizer]
        last = int(end).to_bytes(4, "little")
        for batch in chunks(batches):
            rows: list[tuple] = []
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for doc, coded in zip(batch.column("doc_id").to_pylist(), ids.of(texts), strict=True):
                coded += last
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that no packing of these lengths can do without, from dual-feasible functions.

    For each e up to half the capacity: a length over capacity - e counts as
    a whole bin, one under e as nothing, another as itself. For each small k: the
    rounding function floor((k + 1) * x / C) / k, with x itself where (k + 1) * x / C is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    sums, many = np.cumsum(counts * x), np.cumsum(counts)
    e = np.arange(0, capacity // 2 + 1)
    whole = many[-1] - many[capacity - e]
    rest = sums[capacity - e] - np.where(e > 0, sums[np.maximum(e - 1, 0)], 0)
    best = int(np.max(whole + -(-rest // capacity)))
    for k in range(1, 12):
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int(np.sum(counts * f)) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and how full each bin is."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fill = 0, []  # bit r of open_: a bin with r tokens of room is there
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if fits := open_ >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := r - n:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _packer(capacity: int, turn: int, final: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one partition in round `turn`; not in the final round, its emptiest bins give back their pieces."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        back = np.zeros(len(fill), bool)
        if not final:
            # Bins over the bound, and those that the bound's rounding up alone allows: the emptiest ones.
            gap = len(fill) - lower_bound(lengths, capacity)
            emptiest = np.argsort(fill, kind="stable")[: 8 * (gap + 1)]
            # At most half of the pieces, so that the rounds come to an end.
            back[emptiest[np.cumsum(np.bincount(bins, minlength=len(fill))[emptiest]) <= len(lengths) // 2]] = True
            back &= fill < capacity
        return rows.drop(columns="dealt").assign(sequence_id=(((turn << 24) | int(key[0])) << 32) + bins, offset=offsets, back=back[bins])

    return packed


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    out = items.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long, back boolean"
    done: list[DataFrame] = []
    n, turn = items.count(), -1
    while n or turn < 0:
        turn += 1
        parts = max(1, -(-n // part))
        final = parts == 1
        dealt = items.withColumn("dealt", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)))
        now = written(dealt.groupBy("dealt").applyInPandas(_packer(capacity, turn, final), out), "packed")
        done.append(now.where("NOT back").drop("back"))
        items = now.where("back").drop("back", "sequence_id", "offset")
        n = 0 if final else items.count()
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.unionByName(more)
    return all_


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    tables = Tables(docs.sparkSession)
    out = pack(tables.put("pieces", pieces(docs)))
    tables.drop("pieces")  # the packed tables hold them all
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
