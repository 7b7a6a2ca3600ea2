"""Similarity join on word shingles by signature trees, with connected classes.

Documents with equal shingle sets are one node. Nodes that link share a token of
their prefixes (the first |s| - ceil(t|s|) + 1 shingles in one order of all
shingles), so the nodes that share a prefix token form groups, and no link leaves
all groups. The order puts frequent shingles last; it is taken from a sample, which
changes the sizes of groups and never a result. Tokens with the same least
node are one group, and so are frequent tokens that the sample shows in the
same least text: larger groups only add candidates.

Which pairs of a group can link is decided by its signature tree: a leaf has a bitmap of
its node's shingles (four to eight bits a shingle) and its size, an inner node the OR of
its children's bitmaps and the range of their sizes. A dual traversal drops each
pair of tree nodes whose greatest possible overlap is too small for any link below.

What the trees leave is tried on the whole sets, 100 * intersection >= 75 * union. Of
what they leave in one block of a group, first only a spanning forest of the most similar
pairs is tried, so that a group of copies costs a try for each member and not for each pair;
links join classes, and pairs inside a class need no try. In the last round
the trees of the groups that still hold several classes give all pairs between
classes, so no link between classes is lost. Groups over BLOCK nodes are dealt into
slices of about BLOCK; in the last round each slice meets each other one, but for two slices of
one class.

Cases: a null or empty text, or one without words, has an empty set, links with
nothing and is its own class; under five words the whole sequence is the one
shingle; repeated rows and equal texts are one class; a null doc_id is never a
class's id unless it is alone; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, chunks, near, picked, table
from .components import components
from .shingles import mix, shingle_sets, signature

#: The threshold as a fraction.
OVER, UNDER = 3, 4
#: Children of an inner node; the widest bitmap.
FAN, WIDEST = 8, 1 << 18
#: The order's sample: one text in SAMPLE by hash; shingles of at least OFTEN of its texts are frequent, MOST at most.
SAMPLE, OFTEN, MOST = 64, 8, 50_000
#: Nodes that meet in one slice of a large group.
BLOCK = 512
#: Rounds of spanning forests before the last one.
FORESTS = 2
_CHUNK = 2 << 20
_HOT = np.uint64(1 << 47)
_POST = 14  # bytes: 6 of the token, 8 of the node


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets([t or b"" for t in batch.column("text").to_pylist()])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles and sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            sets = _sets(batch)
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *cols], names=["doc_id", "key", "n_shingles", "sig"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, sig long")


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that a sample shows to be frequent, MOST at most, and the group of each: its least text in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            sets = _sets(batch)
            keys = np.repeat(batch.column("key").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(keys)], names=["token", "key"])

    some = _keyed(docs).where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(run, "token long, key long").groupBy("token").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    found = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(MOST).select("token", "key").collect()  # MOST at most
    told = np.array([(r.token, r.key) for r in found], np.int64).reshape(-1, 2).view(np.uint64)
    told = told[np.argsort(told[:, 0])]
    return np.ascontiguousarray(told[:, 0]), mix(told[:, 1])


def _late(of: np.ndarray, last: np.ndarray) -> np.ndarray:
    return last[np.minimum(np.searchsorted(last, of), len(last) - 1)] == of if len(last) else np.zeros(len(of), bool)


def prefix(of: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The tokens of a set that any linked set's prefix shares one of; `last` are ordered behind all others."""
    n = len(of) + OVER * len(of) // -UNDER + 1  # |s| - ceil(3/4 |s|) + 1
    late = _late(of, last)
    return np.concatenate([of[~late], of[late]])[:n]


def members(leaders: DataFrame, last: np.ndarray, group_of: np.ndarray, buckets: int) -> DataFrame:
    """grp and sig: the nodes of each group with two or more. leaders(text) has one text of each node.

    A token is dealt by its hash, and meets the other nodes that have it. Frequent tokens do not meet: each is known
    to be shared, so their groups are named at once, and no bucket gets all nodes of one.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            tokens, sigs = [], []
            for s in _sets(batch):
                if len(s):
                    some = prefix(s, last)
                    late = _late(some, last)
                    hot = np.unique(group_of[np.searchsorted(last, some[late])]) if late.any() else some[:0]
                    tokens += [some[~late] & ~_HOT, hot | _HOT]
                    sigs.append(np.full(len(tokens[-2]) + len(hot), signature(s), np.int64).view(np.uint64))
            if not tokens:
                continue
            token, sig = np.concatenate(tokens), np.concatenate(sigs)
            # A frequent token's nodes are dealt by both, the others by the token's bits that are not sent.
            dealt = np.where((token & _HOT) > 0, mix(token ^ sig) >> np.uint64(8), token >> np.uint64(48))
            bucket = (dealt % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = np.empty((len(token), _POST), np.uint8)
            rows[:, :6] = token[order].view(np.uint8).reshape(-1, 8)[:, :6]
            rows[:, 6:] = sig[order].view(np.uint8).reshape(-1, 8)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "posts"])

    def meet(blobs: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _POST)
        token, sig = np.zeros((len(rows), 8), np.uint8), np.ascontiguousarray(rows[:, 6:]).view(np.uint64).ravel()
        token[:, :6] = rows[:, :6]
        token = token.view(np.uint64).ravel()
        hot = (token & _HOT) > 0
        named = [np.stack([mix(token[hot]), sig[hot]], 1)]
        token, sig = token[~hot], sig[~hot]
        order = np.lexsort((sig, token))
        token, sig = token[order], sig[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])[: len(token)]
        token, sig = token[new], sig[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))[: len(token)]
        many = np.diff(np.append(first, len(token)))
        lead = np.repeat(sig[first], many)  # the least node, as they are sorted
        several = np.repeat(many > 1, many)
        named.append(np.stack([lead[several], sig[several]], 1))
        found = np.concatenate(named)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        found = found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])[: len(found)]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, k].view(np.int64)) for k in (0, 1)], names=["grp", "sig"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("posts").to_pylist(), strict=True):
                if bucket != at and held:
                    yield meet(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield meet(held)

    posts = leaders.mapInArrow(post, "bucket int, posts binary")
    return posts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "grp long, sig long").distinct()


# ---- signature trees


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, four to eight bits a shingle."""
    return min(WIDEST, max(64, 1 << (4 * n - 1).bit_length()))


def bitmap(of: np.ndarray, bits: int = 0) -> np.ndarray:
    """The set's bitmap in words of 64 bits. The lower half of a wider one folded on the upper one is that of half the width."""
    bits = bits or width(len(of))
    out = np.zeros(bits // 64, np.uint64)
    place = of % np.uint64(bits)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


class Tree:
    """Levels from the leaves up; each node has the OR of its bitmaps, its least and greatest size, greatest slack, and least and greatest class.

    The slack of a leaf is its size less the bits set: so many shingles at most
    share a bit with another one. Two sets share no more shingles than bits and slack.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, roots: np.ndarray | None = None):
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        roots = np.arange(len(sizes)) if roots is None else roots
        self.levels = [(maps, sizes, sizes, slack, roots, roots)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack, first, last = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(maps, at), least(low, at), most(high, at), most(slack, at), least(first, at), most(last, at)))

    def most(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The greatest overlap of sets below nodes a and b."""
        maps, _, high, slack, *_ = self.levels[level]
        shared = np.bitwise_count(maps[a] & maps[b]).sum(1).astype(np.int64) + np.minimum(slack[a], slack[b])
        return np.minimum(shared, np.minimum(high[a], high[b]))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether any link between classes can be between what is below nodes a and b."""
        _, low, _, _, first, last = self.levels[level]
        apart = (first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b])
        return apart & ((OVER + UNDER) * self.most(level, a, b) >= OVER * (low[a] + low[b]))

    def pairs(self, at_once: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves a < b of different classes that may link, by dual traversal from the root."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > at_once:
                todo += [(level, a[:at_once], b[:at_once]), (level, a[at_once:], b[at_once:])]
                continue
            ok = self.possible(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                yield a, b
            elif len(a):
                n = len(self.levels[level - 1][0])
                left = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(a))
                right = np.repeat(b * FAN, FAN * FAN) + np.tile(np.arange(FAN), len(a) * FAN)
                use = (left < n) & (right < n) & ((left < right) if level == 1 else (left <= right))
                todo.append((level - 1, left[use], right[use]))


def surviving(maps: list[bytes], sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block's leaves that its trees leave, with their greatest possible similarity.

    Linked sizes differ by a third at most, so their bitmaps are equally wide or one is twice as wide as the other.
    A tree is built for each width, over the leaves of it and the folded ones of twice the width.
    """
    words = np.array([len(m) for m in maps]) // 8
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for w in np.unique(words):
        some = np.flatnonzero((words == w) | (words == 2 * w))
        if len(some) < 2:
            continue
        some = some[np.lexsort((sizes[some], roots[some]))]
        bits = np.empty((len(some), w), np.uint64)
        for row, k in enumerate(some):
            m = np.frombuffer(maps[k], np.uint64)
            bits[row] = m if len(m) == w else m[:w] | m[w:]
        tree = Tree(bits, sizes[some], roots[some])
        for a, b in tree.pairs():
            use = (words[some[a]] == w) | (words[some[b]] == w)
            a, b = a[use], b[use]
            both = tree.most(0, a, b)
            out.append((some[a], some[b], both / (sizes[some[a]] + sizes[some[b]] - both)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(a: np.ndarray, b: np.ndarray, like: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of a spanning forest over the classes, the most similar ones first."""
    above = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    taken, left = [], len(above) - 1
    for k in np.argsort(-like, kind="stable"):
        x, y = find(int(roots[a[k]])), find(int(roots[b[k]]))
        if x != y:
            above[y] = x
            taken.append(k)
            left -= 1
            if not left:
                break
    return np.array(taken, np.int64)


CANDIDATES = "grp long, a long, b long, more boolean"


def candidates(blocks: DataFrame, whole: bool) -> DataFrame:
    """grp, a, b, more: pairs of blocks(grp, block, slice, sig, root, size, bits) that the trees leave: with `whole` all, else a forest of each block, and whether there were more.

    Rows of one block come together in a task, a block at a time. Of a block of two slices, only pairs between them count.
    """

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        sig, size, part = (rows.column(c).to_numpy() for c in ("sig", "size", "slice"))
        root = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        a, b, like = surviving(rows.column("bits").to_pylist(), size, root)
        if part.min() != part.max():
            use = part[a] != part[b]
            a, b, like = a[use], b[use], like[use]
        n = len(a)
        if n and not whole:
            some = forest(a, b, like, root)
            a, b = a[some], b[some]
        for at in range(0, len(a), 50_000):
            x, y = sig[a[at : at + 50_000]], sig[b[at : at + 50_000]]
            cols = [pa.array(np.full(len(x), rows.column("grp")[0].as_py())), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), n > len(a)))]
            yield pa.RecordBatch.from_arrays(cols, names=["grp", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for s, e in zip(cuts, cuts[1:], strict=False):
                if block[s] != at and held:
                    yield from solved(held)
                    held = []
                at = block[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from solved(held)

    return blocks.repartition("block").sortWithinPartitions("block").select("grp", "block", "slice", "sig", "root", "size", "bits").mapInArrow(run, CANDIDATES)


def leaves(some: DataFrame) -> DataFrame:
    """sig, size and bitmap of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            sets = _sets(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["sig", "size", "bits"]
            )

    return some.mapInArrow(run, "sig long, size long, bits binary")


def _slices(count: str) -> Column:
    return F.ceil(F.col(count) / BLOCK)


def diagonal(rows: DataFrame) -> DataFrame:
    """rows(grp, sig, root) with slices of about BLOCK, each a block of its own."""
    large = rows.groupBy("grp").count().where(F.col("count") > BLOCK).select("grp", _slices("count").alias("parts"))
    dealt = rows.join(near(large), "grp", "left").withColumn("slice", F.pmod(F.xxhash64("sig"), F.coalesce("parts", F.lit(1))))
    return dealt.withColumn("block", F.xxhash64("grp", "slice")).drop("parts")


def all_blocks(rows: DataFrame) -> DataFrame:
    """rows(grp, sig, root) dealt so that each two members of different classes meet in a block.

    Of a large group, classes over half a BLOCK have slices of their own, which meet all slices but those of the same
    class; the other members are mixed and meet each other too.
    """
    sizes = rows.groupBy("grp", "root").count()
    big = F.col("count") > BLOCK // 2
    told = sizes.groupBy("grp").agg(
        F.sum("count").alias("all"),
        F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(~big, F.col("count"))), F.lit(0)) / BLOCK)).alias("mixed"),
        F.array_sort(F.collect_list(F.when(big, F.struct("root", _slices("count").alias("parts"))))).alias("classes"),  # all / BLOCK entries at most
    )
    large = near(told.where(F.col("all") > 2 * BLOCK), 10_000)
    h = F.xxhash64("sig")
    own = F.expr("get(filter(classes, c -> c.root = root), 0)")
    before = F.expr("aggregate(filter(classes, c -> c.root < root), mixed, (n, c) -> n + c.parts)")
    total = F.expr("aggregate(classes, mixed, (n, c) -> n + c.parts)")
    dealt = rows.join(large, "grp", "left").withColumns({"own": own, "before": before, "total": total})
    dealt = dealt.withColumn("slice", F.when(F.col("all").isNull(), F.lit(0)).when(F.col("own").isNull(), F.pmod(h, F.col("mixed"))).otherwise(F.col("before") + F.pmod(h, F.col("own.parts"))))
    others = F.when(F.col("all").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.expr("filter(sequence(0L, total - 1), s -> own IS NULL OR s < before OR s >= before + own.parts)")
    )
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select(*rows.columns, F.col("slice").cast("long").alias("slice"), F.xxhash64("grp", F.least("slice", "other"), F.greatest("slice", "other")).alias("block"))


# ---- tries


def tried(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets link. texts(sig, packed) has the compressed text of each node in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(64)(lambda packed: shingle_sets([zstandard.decompress(packed)])[0])
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = sorted((of(x), of(y)), key=len)
                both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)) if len(q) else 0
                keep.append(UNDER * both >= OVER * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = texts.select(F.col("sig").alias("a"), F.col("packed").alias("x"))
    y = texts.select(F.col("sig").alias("b"), F.col("packed").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def packed_texts(some: DataFrame) -> DataFrame:
    """sig and compressed text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            sigs = [signature(s) for s in _sets(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([zstandard.compress(t, 3) for t in batch.column("text").to_pylist()], pa.binary())], names=["sig", "packed"])

    return some.mapInArrow(run, "sig long, packed binary")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _keyed(docs)
    with Tables(spark, "described", "nodes", "classes") as t:
        rows = t.put("described", described(docs))
        # One row of each node stands for it; the others with its set do not take part in the search.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        nodes = t.put("nodes", rows.where("sig IS NOT NULL").groupBy("sig").agg(first.alias("first"), F.count("*").alias("copies")).select("sig", "first.doc_id", "first.key", "copies"))
        again = nodes.where("copies > 1").select("sig", F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"))
        again = rows.join(again, "sig").where("NOT (doc_id <=> own_id AND key = own_key)").select("doc_id", "key").distinct()
        again = t.put("again", again)
        member = t.put("members", members(picked(texts, again, "left_anti").select("text"), *frequent(docs), buckets))
        t.drop("again")
        inside = t.put("inside", nodes.join(member.select("sig").distinct(), "sig", "left_semi").select("sig", "doc_id", "key"))
        leaf = t.put("leaves", leaves(picked(texts, inside).select("text")).dropDuplicates(["sig"]))

        classes = t.put("classes", inside.select("sig", F.col("sig").alias("root")))
        links = done = None
        for turn in range(FORESTS + 1):
            if turn:
                # Groups that still hold several classes.
                several = member.join(classes, "sig").groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
                member = t.put("members", member.join(several, "grp", "left_semi"))
            if member.isEmpty():
                break
            named, last = member.join(classes, "sig"), turn == FORESTS
            if turn and not last:  # one node of each class, another one in each round
                named = named.groupBy("grp", "root").agg(F.min_by("sig", F.xxhash64(F.lit(turn), "sig")).alias("sig"))
            dealt = all_blocks(named) if last else diagonal(named)
            found = t.put("found", candidates(dealt.join(leaf, "sig"), last))
            if turn == 0:
                # Small groups whose pairs are all tried now are done; large ones meet slice by slice so far.
                large = member.groupBy("grp").count().where(F.col("count") > BLOCK).select("grp")
                open_ = found.where("more").select("grp").union(large).distinct()
                member = t.put("members", member.join(open_, "grp", "left_semi"))
            pairs = found.select("a", "b").distinct()
            pairs = t.put("pairs", pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                continue
            ends = inside.join(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "sig", "left_semi")
            ends = t.put("ends", ends.select("doc_id", "key"))
            packed = t.put("packed", packed_texts(picked(texts, ends).select("text")).dropDuplicates(["sig"]))
            done = t.put(f"done{turn}", pairs if done is None else done.unionByName(pairs))
            new = t.put("new", tried(pairs, packed))
            if new.isEmpty():
                continue
            links = t.put(f"links{turn}", new if links is None else links.unionByName(new))
            roots = components(links, t, "roots").withColumnRenamed("node", "sig")
            classes = t.put("classes", inside.select("sig").join(roots, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root")))
        roots = nodes.join(classes, "sig", "left").select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
        ids = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        ids = roots.join(ids, "root").select("sig", "component_id")
        return rows.join(ids, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
