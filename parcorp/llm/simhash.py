"""Near-duplicates by SimHash, compared in bit-sliced blocks."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp.llm.common import Forest, components, with_package, written

BITS = 64
WORDS = 4  # words of a shingle
RADIUS = 4
BLOCK = 4096  # fingerprints that are compared at once
KEYED = 2000  # fingerprints per block that the choice of keys aims at
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- fingerprints ---------------------------------------------------------------------------
def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text over its word shingles, repeats included.

    A-Z are lower-cased; words are runs of anything but space and \\t to \\r; fewer words
    than a shingle needs form one; without words it is 0. A bit is 1 if set in over half
    of the shingles' XXH64 values.
    """
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = list(itertools.accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest, last = xxhash.xxh64_intdigest, min(words, len(found)) - 1
    total = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):  # bounded, however long the text
        hi = min(n, lo + (1 << 16))
        values = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo + last:hi + last])),
            np.uint64, hi - lo)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    over = np.flatnonzero(2 * total > n)
    return int(sum(1 << int(b) for b in over))


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed bigint of the same 64 bits."""
    with_package(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "id bigint, fp bigint")


# ---- bit-sliced comparison -------------------------------------------------------------------
def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row b holds bit b of every fingerprint, 64 to a word."""
    pad = -len(fps) % 64
    bits = np.unpackbits(
        np.concatenate([fps, np.zeros(pad, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view(np.uint64)


_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def within(fps: np.ndarray, sliced: np.ndarray, lo: int, hi: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, members within `radius` of fingerprint i) for lo <= i < hi.

    One pass over the planes updates the distances to 64 fingerprints per word: the
    differing bits of a plane are added to carry-save counters (bit k of all 64 counters
    in one word), counters that exceed the radius stay marked. Words in which every
    fingerprint has exceeded it are abandoned on the way.
    """
    words, width = sliced.shape[1], max(1, radius.bit_length())
    queries = np.repeat(np.arange(lo, hi), words)
    where = np.tile(np.arange(words), hi - lo)
    tail = np.full(words, _ONES)
    if len(fps) % 64:
        tail[-1] = np.uint64((1 << (len(fps) % 64)) - 1)
    counters = [np.zeros(len(where), np.uint64) for _ in range(width)]
    over = ~tail[where]
    for b in range(BITS):
        flip = (np.uint64(0) - ((fps[queries] >> np.uint64(b)) & np.uint64(1)))
        carry = sliced[b][where] ^ flip
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b >= 15 or b == BITS - 1:
            above = np.zeros(len(where), np.uint64)  # counter > radius, bit by bit
            equal = np.full(len(where), _ONES)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            over |= above
            live = np.flatnonzero(over != _ONES)
            if len(live) < len(where):
                queries, where, over = queries[live], where[live], over[live]
                counters = [c[live] for c in counters]
            if not len(live):
                return
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    row, bit = np.nonzero(near)
    i, j = queries[row], where[row] * 64 + bit
    cuts = np.flatnonzero(np.diff(i)) + 1
    for part_i, part_j in zip(np.split(i, cuts), np.split(j, cuts)):
        yield int(part_i[0]), part_j


def block_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one block: (member, smallest index reachable)."""
    n, forest = len(fps), Forest(len(fps))
    sliced = planes(fps)
    step = max(1, (1 << 16) // max(1, sliced.shape[1]))
    for lo in range(0, n, step):
        for i, members in within(fps, sliced, lo, min(n, lo + step), radius):
            if len(members) > 1:
                forest.join(members)
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(n))
    return moved, roots[moved]


# ---- candidates ------------------------------------------------------------------------------
def key_masks(pieces: int, radius: int = RADIUS) -> list[int]:
    """Cut the bits into `pieces`; `radius` differing bits leave pieces - radius untouched."""
    if pieces <= radius:
        raise ValueError("more pieces than differing bits are needed")
    edges = [BITS * i // pieces for i in range(pieces + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in pick) for pick in itertools.combinations(range(pieces), pieces - radius)]


def pieces_for(n: int, radius: int = RADIUS) -> int:
    """Enough pieces that random fingerprints share a key with about KEYED others."""
    for pieces in range(radius + 1, radius + 6):
        if n / 2 ** (BITS // pieces * (pieces - radius)) <= KEYED:
            break
    return pieces


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked(fps: DataFrame, radius: int = RADIUS, pieces: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all within `radius`.

    Fingerprints within the radius agree on the bits of at least one key. Those of one key
    value are compared in blocks; a key value with more than `block` of them is cut into
    parts, and every pair of parts is a block of its own, so no block grows with the data.
    Each block returns only links that span its components, never all its pairs.
    """
    fps = fps.select("fp").distinct()
    fps = written(fps, "simhash-fps")
    pieces = pieces or pieces_for(fps.count(), radius)
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in key_masks(pieces, radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("key", "mask")).select(
        "fp", F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > block)
    crowded = written(crowded.select(
        F.col("bucket").alias("cb"), F.ceil(F.col("c") * 2 / block).cast("int").alias("parts")), "simhash-crowded")
    if not crowded.isEmpty():
        keyed = keyed.join(crowded, F.col("bucket") == F.col("cb"), "left").withColumn(
            "parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
        others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(
            F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != mine))
        keyed = keyed.select("fp", "bucket", "parts", mine.alias("m"), F.explode(others).alias("o")).select(
            "fp", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(
                F.xxhash64("bucket", F.least("m", "o"), F.greatest("m", "o"))).alias("bucket"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp")
    with_package(fps.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def blocks(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
            a, b = [], []
            for lo, hi in zip(starts, ends):
                if hi - lo > 1:
                    part = fp[lo:hi]
                    i, root = block_links(part.view(np.uint64), radius)
                    a.append(part[i])
                    b.append(part[root])
            empty = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], ["a", "b"])

        for batch in batches:
            bucket = np.concatenate([held_b, batch.column(1).to_numpy()])
            fp = np.concatenate([held_f, batch.column(0).to_numpy()])
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last key value may go on
            held_b, held_f = bucket[last:], fp[last:]
            if last:
                yield blocks(bucket[:last], fp[:last])
        if len(held_b):
            yield blocks(held_b, held_f)

    return dealt.select("fp", "bucket").mapInArrow(compare, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                pieces: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the smallest id reachable
    over links between fingerprints that differ in at most `radius` bits.

    Null and empty texts have fingerprint 0, which links like any other. Rows that repeat
    an id are returned as often; null ids are never the smallest unless a component has no
    other. Fingerprints are compared once each, however many rows share one.
    """
    rows = written(fingerprints(docs, row_id, text), "simhash")
    first = rows.groupBy("fp").agg(F.min("id").alias("low"))
    tree = components(linked(first, radius, pieces, block))
    placed = first.join(tree, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that the join below can split the rows of a large component
    lows = written(placed.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    classes = placed.select(F.col("fp").alias("c"), "root").join(lows, "root").select("c", "component_id")
    classes = written(classes, "simhash-classes")
    return rows.join(classes, F.col("fp") == F.col("c")).select(
        F.col("id").alias(row_id), "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
