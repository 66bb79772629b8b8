"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most ``bits`` bits agree, in at least one of
``segments = bits // 2 + 1`` segments, up to one bit. The index holds each segment once for every bit of it,
with that bit wiped out (a one-wildcard variant); fingerprints that meet in a variant are candidates, and the
full distance decides. Copies collapse first: everything below works on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, written
from .components import Forest, connected_components

SEED = 42
#: Shingles hashed at a time; bounds the memory that one text takes.
CHUNK = 1 << 15
#: Distinct fingerprints of one bucket that are compared directly; a larger bucket is cut again by its other bits.
MOST_IN_BUCKET = 16_384
#: The same for a bucket whose fingerprints are of one root, which costs memory but no comparisons.
MOST_OF_ROOT = 1_000_000
#: Times a bucket is cut again; three cuts leave at most about 20 free bits.
MOST_CUTS = 3


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some at a time."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: max(1, len(parts) - words + 1)].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    whole = xxhash.xxh64_digest
    for at in range(0, len(first), CHUNK):
        yield np.frombuffer(b"".join([whole(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])]), ">u8")


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint, as a signed number, whose bits are those that over half of n hashes have."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def count_ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)


def fingerprints(text: str | None, words: int, prints: int = 1) -> list[int]:
    """The SimHash of a text, and further ones from the same hashes mixed anew; 0 if it has no word."""
    n, ones = 0, np.zeros((prints, 64), np.int64)
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for i in range(prints):
            ones[i] += count_ones(mix(hashes.astype(np.uint64) + np.uint64(i)) if i else hashes)
    return [majority(o, n) for o in ones]


def _fingerprints(words: int, prints: int):
    """(doc_id, text, mark) to (doc_id, mark, p0, p1 and so on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(t, words, prints) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(prints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], ["doc_id", "mark", *(f"p{i}" for i in range(prints))])

    return run


def cut(free: list[int], segments: int) -> list[list[int]]:
    """free bits in so many runs of nearly equal length."""
    return [x.tolist() for x in np.array_split(np.array(free, np.int64), segments)]


def paths(segments: int, cuts: int) -> list[list[int]]:
    """For every path of earlier cuts, as a number to the base ``segments``, the bits that are still free."""
    free = [list(range(64))]
    for _ in range(cuts):
        free = [[b for b in f if b not in s] for f in free for s in cut(f, segments)]
    return free


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; where two buckets get one number they only share their candidates."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_keys(bucket: np.ndarray, value: np.ndarray, segment: int) -> np.ndarray:
    return mix(mix(bucket + np.uint64(segment + 101)) ^ value)


def _segments(segments: int, cuts: int):
    """(bucket, fp, root, path) to one row for each segment: the key of its value in its bucket, and the root."""
    free = paths(segments, cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp, root, path = (batch.column(i).to_numpy() for i in range(4))
            bucket, fp, keys, roots = bucket.view(np.uint64), fp.view(np.uint64), [], []
            for p in np.unique(path):
                here = path == p
                for i, bits in enumerate(cut(free[p], segments)):
                    mask = np.uint64(sum(1 << b for b in bits))
                    keys.append(_segment_keys(bucket[here], fp[here] & mask, i))
                    roots.append(root[here])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(roots))], ["value_key", "root"])

    return run


def _variants(segments: int, cuts: int, with_values: bool):
    """(bucket, fp, root, path) to a row for each free bit: the bucket of its segment's variant without that bit.
    with_values: also the keys of the two segment values that share the variant."""
    free = paths(segments, cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp, root, path = (batch.column(i).to_numpy() for i in range(4))
            bucket, fp = bucket.view(np.uint64), fp.view(np.uint64)
            for p in np.unique(path):
                here = path == p
                old, own, tree = bucket[here], fp[here], root[here]
                for i, bits in enumerate(cut(free[p], segments)):
                    mask = np.uint64(sum(1 << b for b in bits))
                    for b in bits:
                        bit = np.uint64(1 << b)
                        rest = own & (mask & ~bit)
                        columns = [mix(mix(old + np.uint64(b + 1)) ^ rest).view(np.int64), own.view(np.int64), tree]
                        names = ["bucket", "fp", "root"]
                        if with_values:
                            columns += [_segment_keys(old, rest, i).view(np.int64), _segment_keys(old, rest | bit, i).view(np.int64), np.full(len(own), p * segments + i, np.int64)]
                            names += ["off_key", "on_key", "path"]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def near(fp: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(fp ^ at) <= bits


def bucket_tree(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links, as positions, that connect one bucket's rows exactly as all its links would, fewer than it has rows. fp: a
    row of fingerprints for each row of the bucket, which differ in the bits of all of them together.
    A search from any fingerprint takes what is within reach out of the rest, so a dense bucket takes few passes."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            close = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1, dtype=np.int64) <= bits
            if close.any():
                out += [(int(at), int(x)) for x in rest[close]]
                reached += list(rest[close])
                rest = rest[~close]
    return out


#: Buckets up to this size are compared pair by pair, all at once; larger ones by a search.
PAIRED = 64


def small_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of rows of the buckets of at most PAIRED rows, by their distance in the bucket."""
    few = (sizes > 1) & (sizes <= PAIRED)
    starts, sizes = starts[few], sizes[few]
    offset = 1
    while len(starts):
        n = sizes - offset
        ends = np.cumsum(n)
        left = np.repeat(starts - ends + n, n) + np.arange(ends[-1])
        yield left, left + offset
        offset += 1
        more = sizes > offset
        starts, sizes = starts[more], sizes[more]


def buckets(bucket: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of one bucket. most: a larger one is taken in pieces (only for links that may be missed)."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    if most:
        starts = np.unique(np.concatenate([starts, np.arange(0, len(bucket), most)]))
    return starts, np.diff(np.concatenate([starts, [len(bucket)]]))


def bucket_links(bucket: np.ndarray, fp: np.ndarray, root: np.ndarray, bits: int, most: int = 0) -> Iterator[tuple[int, int]]:
    """Positions of linked rows of sorted buckets that have different roots, so many that they connect what all links would.
    Rows of one root are connected already."""
    starts, sizes = buckets(bucket, most)
    for a, b in small_pairs(starts, sizes):
        met = near(fp[a], fp[b], bits) & (root[a] != root[b])
        yield from zip(a[met].tolist(), b[met].tolist())
    many = sizes > PAIRED
    many[many] = np.minimum.reduceat(root, starts)[many] != np.maximum.reduceat(root, starts)[many]
    for s, n in zip(starts[many].tolist(), sizes[many].tolist()):
        yield from ((a + s, b + s) for a, b in bucket_tree(fp[s : s + n, None], bits) if root[a + s] != root[b + s])


def by_bucket(batches: Iterator[pa.RecordBatch], held_rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of many whole buckets at a time, from rows that are sorted by the first column."""
    held, n_held = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
        n_held += batch.num_rows
        if n_held < held_rows:
            continue
        parts = [np.concatenate(x) for x in zip(*held)]
        last = np.searchsorted(parts[0], parts[0][-1])
        if last:
            yield [x[:last] for x in parts]
        held, n_held = [[x[last:] for x in parts]], 0
    if held and (parts := [np.concatenate(x) for x in zip(*held)]) and len(parts[0]):
        yield parts


def _bucket_links(bits: int, most: int = 0):
    """(bucket, fp, root) sorted by bucket within the partition, to links between rows of one bucket. A partition keeps a
    union-find of what it has linked and returns only links that join two trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for bucket, fp, root in by_bucket(batches):
            ids, trees = fp.view(np.uint64), root.view(np.uint64)
            out = [(int(ids[a]), int(ids[b])) for a, b in bucket_links(bucket, ids, root, bits, most) if forest.join(int(trees[a]), int(trees[b]))]
            both = np.array(out, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])

    return run


def _whole_segments(segments: int):
    """(p0, ...) to a row for each two neighbouring segments of p0: the bucket of their values, and all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.uint64(sum(1 << b for b in bits)) for bits in cut(list(range(64)), segments)]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(segments):
                key = mix((fp & (masks[i] | masks[(i + 1) % segments])) + np.uint64(i))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], ["bucket", *batch.schema.names])

    return run


def easy_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between fingerprints that agree in two neighbouring segments. They connect most of every crowd of near
    copies by a few rows each, and the full index then has nothing more to say about these; what they miss, it finds.
    A large bucket is sorted and taken in pieces."""
    keyed = fps.select("fp", F.col("fp").alias("root")).mapInArrow(_whole_segments(bits // 2 + 1), "bucket long, fp long, root long")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_bucket_links(bits, 4_096), "a long, b long")


def links_within(fps: DataFrame, bits: int, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b) that connect the distinct fingerprints of fps (fp, root: long) exactly as all pairs would that differ in at
    most ``bits`` bits; what has one root is connected already.

    A bucket that may hold more than most_in_bucket fingerprints of several roots (known from the counts of its two segment
    values) is cut again by its other bits, up to MOST_CUTS times; no candidate is dropped.
    """
    segments, carried, zero = bits // 2 + 1, ["bucket", "fp", "root"], F.lit(0).cast("long")
    rows = fps.select(zero.alias("bucket"), "fp", "root", zero.alias("path"))
    out = None
    for cuts in range(MOST_CUTS + 1):
        hot, n_hot = None, 0
        if cuts < MOST_CUTS:
            counts = rows.mapInArrow(_segments(segments, cuts), "value_key long, root long").groupBy("value_key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
            hot = written(counts.where((F.col("n") > MOST_OF_ROOT) | (F.col("n") > most_in_bucket // 2) & (F.col("x") < F.col("y"))).select("value_key"), "hot")
            n_hot = hot.count()
        kinds = [*carried, "off_key", "on_key", "path"] if n_hot else carried
        made = rows.mapInArrow(_variants(segments, cuts, n_hot > 0), ", ".join(f"{k} long" for k in kinds))
        if n_hot:
            for side in ("off", "on"):
                keys = hot.select(F.col("value_key").alias(f"{side}_key"), F.lit(True).alias(side))
                made = made.join(broadcast_if_small(keys, n_hot), f"{side}_key", "left")
            made = written(made.select(*carried, "path", (F.col("off").isNotNull() | F.col("on").isNotNull()).alias("hot")), "variants")
        plain = made.where("not hot") if n_hot else made
        found = plain.select(*carried).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(bits), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not n_hot:
            return out
        rows = made.where("hot").select("bucket", "fp", "root", "path")
    return out


def marked(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """(doc_id, mark: hash of the text, p0 and so on) for every row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "".join(f", p{i} long" for i in range(prints))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_fingerprints(words, prints), f"doc_id {kind}, mark long{columns}")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 9, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs (doc_id, text; other columns are not read).

    fp: SimHash over XXH64 (seed 42) of the ``words``-word shingles of the text with A-Z in lower case; a shorter text
    is one shingle, an empty, blank or null one has fingerprint 0 and links like any other. component_id: the smallest
    doc_id (nulls aside) reachable over links of at most ``bits`` differing bits. Repeated rows and ids each keep their
    row; a text of any length is hashed a part at a time; an empty table gives none.
    """
    prints = written(marked(docs, words, 1).select("doc_id", F.col("p0").alias("fp")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    easy = written(easy_links(nodes, bits), "easy")
    trees = connected_components(easy).withColumnRenamed("node", "fp")
    grown = written(nodes.join(trees, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "grown")
    parts = connected_components(easy.unionByName(links_within(grown, bits, most_in_bucket))).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(parts, "fp", "left").select("fp", "least", "root"), "rooted")
    linked = rooted.where("root is not null")
    # a table of its own, so that Spark can split the join where one root has many fingerprints
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    alone = rooted.where("root is null").select("fp", F.col("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id").unionByName(alone)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
