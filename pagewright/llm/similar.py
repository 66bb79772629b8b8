"""Documents without their near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

Two texts of similarity 0.8 differ in about 10 of 64 bits of a SimHash, too many to find by segments alone, so a text has
three fingerprints from the same shingles. Each is cut into four segments of 16 bits, and every segment is indexed once
for each of its bits, with that bit wiped out (one-wildcard variants, as in simhash.py). Of pairs at 0.8, 98 in 100 meet
in one of these 192 buckets at least; pairs that are more alike nearly always do. The 192 bits then settle all pairs that are clearly
alike or clearly not, and the pairs between are verified by the exact similarity of their shingle sets. Texts are joined
with pairs only where parities of their sets, some bits for each shingle, leave that similarity possible.

What the index misses, and what stands back there for a nearer pair, an exact join finds: two sets of similarity 0.8 share one
of the first fifth of their shingles, in any order that is the same for all texts. Pairs of one tree are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, shuffles_dropped, small_batches, written
from .components import Forest, connected_components
from .simhash import PAIRED, bucket_tree, buckets, by_bucket, cut, fingerprints, mix, shingle_hashes, small_pairs

PRINTS = 3
SEGMENTS = 4
LEAST_SIMILARITY = 0.8
#: Of all bits. A similarity of 0.8 makes 29 bits differ on average, with a deviation of 5, and one of 0.9 makes 20.
SURE_BITS = 18
MAYBE_BITS = 44
#: Pairs in doubt for each row of a bucket of over PAIRED rows; a denser crowd is left to the exact join.
MOST_IN_DOUBT = 16
#: One in so many texts is counted for the order of shingles, and so many of the frequent ones come last. The order only bears on speed.
COUNTED = 16
MOST_RANKED = 100_000
#: Pairs of rows of a large bucket of the exact join that are compared at a time.
COMPARED = 1 << 20
#: Bits of parity for each shingle of a text in a pair in doubt, at least; a set of more than 2 ** MOST_RANGES / RANGES has fewer.
RANGES = 2
MOST_RANGES = 20
PRINT_COLUMNS = [f"p{i}" for i in range(PRINTS)]
ODD = [f"odd{i}" for i in range(4)]


def node_of(prints: np.ndarray) -> np.ndarray:
    """A number for each row of fingerprints; texts with all the same bits are one node."""
    out = np.zeros(len(prints), np.uint64)
    for i in range(PRINTS):
        out = mix(out + prints[:, i] + np.uint64(i))
    return out


def _sketches(words: int):
    """(doc_id, text, mark) to (doc_id, mark, node, p0, p1, p2, odd0 to odd3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprints(t, words, PRINTS) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, PRINTS)
            node = node_of(found.view(np.uint64)).view(np.int64)
            odd = np.frombuffer(b"".join(parity(shingles(t, words)) for t in batch.column("text").to_pylist()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(node), *(pa.array(found[:, i].copy()) for i in range(PRINTS)), *(pa.array(odd[:, i].copy()) for i in range(4))], ["doc_id", "mark", "node", *PRINT_COLUMNS, *ODD])

    return run


CUT = cut(list(range(64)), SEGMENTS)
SEGMENT_MASKS = [np.uint64(sum(1 << b for b in bits)) for bits in CUT]
#: Of each bit of all fingerprints: its segment without it, and a number of its own.
REST = np.array([mask & ~np.uint64(1 << b) for _ in range(PRINTS) for mask, bits in zip(SEGMENT_MASKS, CUT) for b in bits], np.uint64)
SALT = mix(np.arange(1, 64 * PRINTS + 1, dtype=np.uint64))


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p0, p1, p2, root) to a row for each two neighbouring segments of a fingerprint: the bucket of their values, and all
    columns."""
    for batch in batches:
        for i in range(PRINTS):
            fp = batch.column(i).to_numpy().view(np.uint64)
            for k in range(SEGMENTS):
                key = mix((fp & (SEGMENT_MASKS[k] | SEGMENT_MASKS[(k + 1) % SEGMENTS])) ^ SALT[i * SEGMENTS + k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["bucket", *batch.schema.names])


def variant(fp: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    """The bucket of a fingerprint's segment without one bit of it; bits count through all fingerprints."""
    return mix((fp & REST[bit]) ^ SALT[bit])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p0, p1, p2, root) to a row for each bit of each fingerprint: the bucket of its segment without that bit."""
    for batch in batches:
        for bit in range(64 * PRINTS):
            key = variant(batch.column(bit // 64).to_numpy().view(np.uint64), bit)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["bucket", *batch.schema.names])


def at_home(bucket: np.ndarray, prints: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Those of pairs of rows of one bucket whose first bucket in common this is, so that each pair is told once in all."""
    a, b = pairs[:, 0], pairs[:, 1]
    first = np.full(len(pairs), 64 * PRINTS - 1)
    for i in range(PRINTS)[::-1]:
        differ = prints[a, i] ^ prints[b, i]
        for mask, bits in list(zip(SEGMENT_MASKS, CUT))[::-1]:
            x = differ & mask
            n = np.bitwise_count(x)
            first = np.where(n == 0, 64 * i + bits[0], np.where(n == 1, 64 * i + np.bitwise_count(x - np.uint64(1)).astype(np.int64), first))
    return pairs[variant(prints[a, first // 64], first) == bucket[a]]


def apart(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits of pairs of rows."""
    return sum(np.bitwise_count(prints[a, i] ^ prints[b, i]).astype(np.int64) for i in range(PRINTS))


def doubts(prints: np.ndarray, trees: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a large bucket that are in doubt. Rows of its largest tree are not compared with one another, and
    of the rows of another tree that are near a row the nearest one stands for all."""
    _, inverse, counts = np.unique(trees, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(inverse != counts.argmax())
    for x in outside.tolist():
        d = sum(np.bitwise_count(prints[:, i] ^ prints[x, i]).astype(np.int64) for i in range(PRINTS))
        near = np.flatnonzero((d <= MAYBE_BITS) & (inverse != inverse[x]))
        near = near[np.lexsort((d[near], inverse[near]))]
        for y in near[np.unique(inverse[near], return_index=True)[1]].tolist():
            yield x, y


def nearest(prints: np.ndarray, trees: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs of rows, for each two trees the pair that is nearest by its bits; those of one tree are left out."""
    pairs = np.where((trees[pairs[:, 0]] > trees[pairs[:, 1]])[:, None], pairs[:, ::-1], pairs)
    low, high = trees[pairs[:, 0]], trees[pairs[:, 1]]
    order = np.lexsort((pairs[:, 1], pairs[:, 0], apart(prints, pairs[:, 0], pairs[:, 1]), high, low))
    order = order[low[order] != high[order]]
    first = np.ones(len(order), bool)
    first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    return [tuple(p) for p in pairs[order[first]].tolist()]


def _links(only_sure: bool, most: int = 0):
    """(bucket, p0, p1, p2, root; a root of 0 stands for the own node) sorted by bucket to (a, b, sure): roots of nodes that
    are clearly alike, as many as connect them, and unless only_sure pairs of nodes of different trees that are in doubt:
    of two trees the nearest pair among the rows that a task holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for keys, *columns, root in by_bucket(batches):
            bucket = keys.view(np.uint64)
            prints = np.stack([c.view(np.uint64) for c in columns], axis=1)
            node = node_of(prints)
            tree = np.where(root == 0, node, root.view(np.uint64))
            out: list[tuple[int, int, bool]] = []

            def joined(a: int, b: int) -> None:
                x, y = int(tree[a]), int(tree[b])
                if forest.join(x, y):
                    out.append((x, y, True))

            starts, sizes = buckets(bucket, most)
            maybe: list[tuple[int, int]] = []
            for a, b in small_pairs(starts, sizes):
                other = tree[a] != tree[b]
                a, b = a[other], b[other]
                d = apart(prints, a, b)
                for x, y in zip(a[d <= SURE_BITS].tolist(), b[d <= SURE_BITS].tolist()):
                    joined(x, y)
                unsure = (d > SURE_BITS) & (d <= MAYBE_BITS)
                maybe += zip(a[unsure].tolist(), b[unsure].tolist())
            for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
                if (tree[s : s + n] == tree[s]).all():
                    continue
                for x, y in bucket_tree(prints[s : s + n], SURE_BITS):
                    joined(x + s, y + s)
                trees = np.array([forest.root(t) for t in tree[s : s + n].tolist()], np.uint64)
                if only_sure or (trees == trees[0]).all():
                    continue
                found = []
                for x, y in doubts(prints[s : s + n], trees):
                    found.append((x + s, y + s))
                    if len(found) > MOST_IN_DOUBT * n:
                        found = []
                        break
                maybe += found
            if maybe and not only_sure:
                pairs = at_home(bucket, prints, np.array(maybe))
                out += [(int(node[a]), int(node[b]), False) for a, b in nearest(prints, np.array([forest.root(t) for t in tree.tolist()], np.uint64), pairs)]
            both = np.array([x[:2] for x in out], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)), pa.array([x[2] for x in out], pa.bool_())], ["a", "b", "sure"])

    return run


def shingles(text: str | None, words: int) -> np.ndarray:
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def parity(of_text: np.ndarray) -> bytes:
    """256 bits: whether a set has an odd number of hashes in each of 256 ranges. Two sets differ in at least as many hashes
    as their bits."""
    return np.packbits(np.bincount(of_text >> np.uint64(56), minlength=256).astype(np.uint8) & 1).tobytes()


def wide_parity(of_text: np.ndarray) -> bytes:
    """The same for a power of two of ranges, by the size of the set."""
    bits = min(MOST_RANGES, max(3, (RANGES * len(of_text) - 1).bit_length()))
    return np.packbits(np.bincount(of_text >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def odd_ranges(x: bytes, y: bytes) -> int:
    """Number of ranges by whose parity two sets differ; the finer ranges are put together first."""
    few, many = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    if len(few) < len(many):
        many = np.packbits(np.bitwise_xor.reduce(np.unpackbits(many).reshape(8 * len(few), -1), axis=1))
    return int(np.bitwise_count(few ^ many).sum(dtype=np.int64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _verified(words: int, least: float):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = lru_cache(64)(lambda text: shingles(text, words))  # pairs often come sorted by one side
        for left, right in columns:
            yield pa.array([similarity(of(x), of(y)) >= least for x, y in zip(left.to_pylist(), right.to_pylist())], pa.bool_())

    return run


def _wide_parities(words: int):
    """(node, text) to (node, size, odd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, odd = [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, words)
                sizes.append(len(own))
                odd.append(wide_parity(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary())], ["node", "size", "odd"])

    return run


def _may_be_alike(least: float):
    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for both, left, right in columns:
            differ = np.array([odd_ranges(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], np.int64)
            yield pa.array(differ * (1 + least) <= (1 - least) * both.to_numpy() + 1e-6)

    return run


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    return run


def frequent_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of texts (text) that occur in several of one in COUNTED, the rarest of them first; at most MOST_RANKED."""
    counts = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(COUNTED)) == 0).select("text").mapInArrow(_shingle_rows(words), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    rows = counts.where("n > 1").orderBy(F.desc("n"), "shingle").limit(MOST_RANKED).collect()
    return np.array([r.shingle for r in rows[::-1]], np.int64).view(np.uint64)


def prefix(of_text: np.ndarray, ranked: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a sorted set, of which two sets of similarity least or more have one in common. ranked: the
    frequent ones, sorted, with their ranks; they come last, the others by their hash."""
    n = len(of_text)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, of_text), len(ranked) - 1)
        of_text = of_text[np.argsort(np.where(ranked[at] == of_text, rank[at] + 1, 0), kind="stable")]
    return of_text[: n - math.ceil(least * n - 1e-9) + 1]


KEYED = "bucket long, node long, root long, size int, place int"


def _prefixes(words: int, least: float, frequent: Broadcast):
    """(node, root, text) to a row for each shingle of the text's prefix, with the size of the set and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(frequent.value)
        ranked = frequent.value[order]
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            firsts = [prefix(x, ranked, order, least) if len(x) else x for x in sets]
            n = np.array(list(map(len, firsts)), np.int64)
            if n.sum():
                nodes, roots = (np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1))
                sizes, places = np.repeat(np.array(list(map(len, sets)), np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), *map(pa.array, (nodes, roots, sizes, places))], ["bucket", "node", "root", "size", "place"])

    return run


def bucket_pairs(starts: np.ndarray, sizes: np.ndarray, tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of rows of one bucket, some at a time. The largest tree of a large bucket is not compared with itself."""
    yield from small_pairs(starts, sizes)
    for s, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        _, inverse, counts = np.unique(tree[s : s + n], return_inverse=True, return_counts=True)
        largest, places = inverse == counts.argmax(), np.arange(n)
        outside = np.flatnonzero(~largest)
        for at in range(0, len(outside), max(1, COMPARED // n)):
            x = outside[at : at + max(1, COMPARED // n)]
            a, b = np.nonzero(largest | (places > x[:, None]))
            yield x[a] + s, b + s


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of prefixes sorted by bucket, without those of shingles that only one tree has."""
    for columns in by_bucket(batches):
        bucket, node, root = columns[:3]
        tree, (starts, sizes) = np.where(root == 0, node, root), buckets(bucket)
        met = np.repeat(np.minimum.reduceat(tree, starts) < np.maximum.reduceat(tree, starts), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], ["bucket", "node", "root", "size", "place"])


def _joined(least: float):
    """Rows of prefixes, with their texts' parities, sorted by bucket, to pairs (a, b) of nodes of different trees whose sets may
    have a similarity of least or more by their sizes, the places of the shared shingle and the parities. A pair may be
    told for each shingle that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, root, size, place, *odd in by_bucket(batches):
            tree, found, size = np.where(root == 0, node, root), [], size.astype(np.int64)
            bits = np.stack(odd, 1).view(np.uint64)
            for a, b in bucket_pairs(*buckets(bucket), tree):
                both = size[a] + size[b]
                most = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b])
                may = np.flatnonzero((most * (1 + least) >= least * both - 1e-6) & (tree[a] != tree[b]))
                a, b, both = a[may], b[may], both[may]
                may = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) * (1 + least) <= (1 - least) * both + 1e-6
                if may.any():
                    x, y = node[a[may]], node[b[may]]
                    found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def exact_pairs(docs: DataFrame, nodes: DataFrame, trees: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b) with all pairs of nodes of different trees whose texts have a similarity of least or more, and some others."""
    rooted = nodes.select("node", "mark").join(trees, "node", "left").select("node", "mark", F.coalesce("root", F.lit(0)).alias("root"))
    texts = docs.select(F.xxhash64("text").alias("mark"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words))
    firsts = texts.join(rooted, "mark").select("node", "root", "text").mapInArrow(_prefixes(words, least, frequent), KEYED)
    shared = written(firsts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, KEYED), "shared")
    shuffles_dropped(docs.sparkSession)
    told = shared.join(nodes.select("node", *ODD), "node").select(*shared.columns, *ODD)
    return told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_joined(least), "a long, b long").distinct()


def _of_trees(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """pairs (a, b) whose nodes are of different trees, with the roots of these; a node without a tree is one."""
    n = trees.count()
    for side in ("a", "b"):
        pairs = pairs.join(broadcast_if_small(trees.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), n), side, "left")
    rooted = pairs.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    return written(rooted.where("a_root <> b_root"), "pairs")


def _texts_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) for the nodes of pairs, a row for each document with that text."""
    of_node = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "mark"), "node"), "doubted")
    return docs.select(F.xxhash64("text").alias("mark"), "text").join(broadcast_if_small(of_node, of_node.count()), "mark").select("node", "text")


def _bounded(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of pairs (a, b, a_root, b_root) whose texts may have a similarity of least or more by their parities, which are
    far shorter than the texts."""
    odd = written(_texts_of(docs, nodes, pairs).mapInArrow(_wide_parities(words), "node long, size long, odd binary").dropDuplicates(["node"]), "parities")
    met = pairs
    for side in ("a", "b"):
        met = met.join(odd.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("odd").alias(f"{side}_odd")), side)
    may = F.arrow_udf(_may_be_alike(least), "boolean")(F.col("a_size") + F.col("b_size"), F.col("a_odd"), F.col("b_odd"))
    return written(met.withColumn("may", may).where("may").select(pairs.columns), "bounded")


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The roots (a, b) of pairs (a, b, a_root, b_root) of nodes whose texts have a similarity of least or more."""
    pairs = _bounded(docs, nodes, pairs, words, least)
    texts = written(_texts_of(docs, nodes, pairs).groupBy("node").agg(F.min("text").alias("text")), "texts")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
    alike = F.arrow_udf(_verified(words, least), "boolean")(F.col("a_text"), F.col("b_text"))
    out = written(pairs.withColumn("alike", alike).where("alike").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), "alike")
    shuffles_dropped(docs.sparkSession)
    return out


def _led_on(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of trees after their roots, and nodes beside them, have been connected further by roots (node, root)."""
    on = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
    led = trees.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(led.unionByName(roots.join(trees.select("node"), "node", "left_anti").select("node", "root")), "trees")


def groups(docs: DataFrame, words: int = 5, least: float = LEAST_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark: hash of the text, node, p0, p1, p2, odd0 to odd3) for every row of docs, and (node, root: the smallest node of its
    group) for every node that has a near duplicate."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in PRINT_COLUMNS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_sketches(words), f"doc_id {kind}, mark long, node long, {columns}, {', '.join(f'{c} long' for c in ODD)}")
    sketches = written(rows, "sketches")
    least_text = F.min(F.struct("mark", *ODD)).alias("of_text")
    nodes = written(sketches.groupBy("node", *PRINT_COLUMNS).agg(least_text).select("node", *PRINT_COLUMNS, "of_text.*"), "nodes")
    found, keyed = "a long, b long, sure boolean", f"bucket long, {columns}, root long"

    def bucketed(rows: DataFrame, index, *within: str) -> DataFrame:
        return rows.select(*PRINT_COLUMNS, "root").mapInArrow(index, keyed).repartition("bucket").sortWithinPartitions("bucket", *within)

    easy = connected_components(bucketed(nodes.withColumn("root", F.lit(0).cast("long")), _whole_segments, "p0").mapInArrow(_links(True, 4_096), found))
    grown = written(nodes.join(easy, "node", "left").select("node", *PRINT_COLUMNS, "mark", F.coalesce("root", F.lit(0)).alias("root")), "grown")
    shuffles_dropped(docs.sparkSession)
    links = written(bucketed(grown, _variants).mapInArrow(_links(False), found), "links")
    shuffles_dropped(docs.sparkSession)
    trees = _led_on(grown.where("root <> 0").select("node", "root"), connected_components(links.where("sure")))
    trees = _led_on(trees, connected_components(_alike(docs, nodes, _of_trees(links.where("not sure").select("a", "b"), trees), words, least)))
    rest = _of_trees(exact_pairs(docs, nodes, trees, words, least), trees)
    return sketches, _led_on(trees, connected_components(_alike(docs, nodes, rest, words, least)))


def without_duplicates(docs: DataFrame, words: int = 5, least: float = LEAST_SIMILARITY) -> DataFrame:
    """docs without near duplicates: of each group one row stays, with the smallest doc_id if one has an id.

    Groups are connected by pairs of similarity ``least`` or more. Rows are told apart by id and text, so different
    texts without an id, or with the same one, go only for a row of their own group; of repeated rows one stays. Null,
    empty and blank texts have no shingle and are alike. A text under ``words`` words is one shingle; a text of any
    length is hashed a part at a time. An empty table stays one; other columns are kept as they are and not read.
    """
    sketches, parts = groups(docs, words, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("head")
    of_node = sketches.groupBy("node").agg(first).join(parts, "node", "left").select(F.coalesce("root", "node").alias("group"), "head")
    heads = written(of_node.groupBy("group").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("head"), F.col("head.mark").alias("of_text")), "heads")
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("of_text"))
    # the texts are dealt out by id and text whatever the number of heads, as it grows with the corpus
    stays = docs.join(heads.hint("shuffle_merge"), is_head, "left_semi")
    repeated = written(sketches.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"), F.col("mark").alias("of_text")), "repeated")
    n = repeated.count()
    if not n:
        return stays
    again = F.col("doc_id").eqNullSafe(F.col("again")) & (F.xxhash64("text") == F.col("of_text"))
    once = stays.join(broadcast_if_small(repeated, n), again, "left_anti")
    return once.unionByName(stays.join(broadcast_if_small(repeated, n), again, "left_semi").dropDuplicates(["doc_id", "text"]))
