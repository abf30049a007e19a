"""Repeated passages by a sparse, distributed suffix array over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.llm.common import with_package, written

MIN_WORDS = 50  # shortest passage that is reported
WINDOW = 24  # one suffix is kept of so many neighbouring ones
GRAM = 4  # words whose hash selects it
GROUP_CHARS = 1 << 22  # texts that are hashed together
ROWS_PER_TASK = 500_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Hashes of word ranges of a group of texts."""

    def __init__(self, texts: list[bytes]) -> None:
        found = [_WORD.findall(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.begin[-1])
        digest = xxhash.xxh64_intdigest
        self.hash = np.fromiter((digest(w) for f in found for w in f), np.uint64, n)
        self.stop = np.repeat(self.begin[1:], sizes)  # end of the text, per word
        self._sums: dict[int, tuple] = {}

    def _prefix(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self._sums:
            b = _BASES[base]
            n = len(self.hash)
            power = np.full(n, b, np.uint64)
            inverse = np.full(n, pow(b, -1, 1 << 64), np.uint64)
            if n:
                power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            total = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * power)])
            self._sums[base] = total, inverse
        return self._sums[base]

    def ranges(self, length: int, base: int = 0) -> np.ndarray:
        """Hash of the `length` words from each position on, also across texts."""
        total, inverse = self._prefix(base)
        m = max(0, len(self.hash) - length + 1)
        return _mixed((total[length:length + m] - total[:m]) * inverse[:m])

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words from lo to before hi, and of their number."""
        total, inverse = self._prefix(1)
        return _mixed((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))

    def anchors(self, words: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, anchors): every start of a passage of `words` words within one text, and
        the position among the next `window` ones whose gram has the smallest hash (the
        leftmost of equals). Equal passages have their anchor at the same place."""
        gram_hash = self.ranges(gram)
        starts = np.flatnonzero(np.arange(len(self.hash)) + words <= self.stop)
        if not len(starts):
            return starts, starts
        low = (gram_hash & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram_hash), dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if window > size:
            low = np.minimum(low[:len(low) - (window - size)], low[window - size:])
        return starts, (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts, size, lo = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= GROUP_CHARS:
            yield lo, i + 1, texts
            texts, size, lo = [], 0, i + 1
    if texts:
        yield lo, batch.num_rows, texts


_ROW = "h1 bigint, h2 bigint, id bigint, pos int, n int"


def _rows(ids: np.ndarray, w: Words, h1: np.ndarray, h2: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    doc = np.searchsorted(w.begin, at, side="right") - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[doc]),
         pa.array((at - w.begin[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
        ["h1", "h2", "id", "pos", "n"])


def sparse_suffixes(docs: DataFrame, words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h1, h2, id, pos, n): one row per kept suffix.

    Each passage of `words` words belongs to the suffix at its anchor, one of its first
    `window` positions; pos and n name the passages of a suffix: they start at pos, pos + 1,
    … pos + n - 1. h1 stands for the words - window + 1 words from the anchor on, which all
    of them share, h2 for all words of all of them.
    """
    prefix = words - window + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, texts in _groups(batch, 1):
                w = Words(texts)
                starts, anchor = w.anchors(words, window, gram)
                # a suffix's passages follow one another within one text
                new = np.flatnonzero(np.concatenate(
                    [[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)])) if len(starts) else starts
                n = np.diff(np.concatenate([new, [len(starts)]]))
                first = starts[new]
                yield _rows(ids[lo:hi], w, w.ranges(prefix)[anchor[new]], w.between(first, first + n - 1 + words), first, n)

    return docs.mapInArrow(scan, _ROW)


def passages(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, id, pos, 1) of the passages that `at` (pos, n) lists: docs (id, text, at)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, texts in _groups(batch, 1):
                w = Words(texts)
                parts = []
                for i in range(lo, hi):
                    pos = at[i].values.field("pos").to_numpy() + w.begin[i - lo]
                    n = at[i].values.field("n").to_numpy()
                    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    parts.append(np.repeat(pos, n) + shift)
                q = np.concatenate(parts)
                yield _rows(ids[lo:hi], w, w.ranges(words)[q], w.ranges(words, 1)[q], q, np.ones(len(q)))

    return docs.mapInArrow(scan, _ROW)


ONLY, FIRST, LATER = 0, 1, 2


def compared(rows: DataFrame, tasks: int, hashes: int = 2, only: bool = False) -> DataFrame:
    """Rows (h1, h2, id, pos, n) with `kind`: whether a row is the first (by id, then pos) or
    a later one of several with its hashes (h1, or both); with `only`, also those that are alone.

    Rows are sorted over all tasks by hash, then place, and compared with their neighbours.
    A hash of very many rows runs on over several tasks; each task reports its first and
    last run, and those few rows are settled by an aggregate.
    """
    keys = ["h1", "h2", "id", "pos"]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    names = ["h1", "h2", "id", "pos", "n", "kind", "run"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def packed(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the run that goes on: its first row, its rows so far, whether it is the task's first
        start, size, opening = None, 0, True

        def ended() -> list[tuple]:
            if opening:
                return [(*start, 0, size)]
            if size > 1 or only:
                return [(*start, FIRST if size > 1 else ONLY, 0)]
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(5)]
            a = cols[0]
            other = np.any([c[1:] != c[:-1] for c in cols[:hashes]], axis=0)
            here = tuple(int(c[0]) for c in cols[:hashes])
            new = np.concatenate([[start is None or here != start[:hashes]], other])
            heads = np.flatnonzero(new)
            kind = np.where(new, -1, LATER)
            extra: list[tuple] = []
            if start is not None:
                size += int(heads[0]) if len(heads) else len(a)
            if len(heads):
                if start is not None:
                    extra += ended()
                    opening = False
                sizes = np.diff(np.concatenate([heads, [len(a)]]))
                for h, n in ((heads[0], int(sizes[0])),) if opening and len(heads) > 1 else ():
                    start, size = tuple(int(c[h]) for c in cols), n
                    extra += ended()
                    opening, heads, sizes = False, heads[1:], sizes[1:]
                inner = heads[:-1]
                kind[inner] = np.where(sizes[:-1] > 1, FIRST, ONLY if only else -1)
                start, size = tuple(int(c[heads[-1]]) for c in cols), int(sizes[-1])
            at = np.flatnonzero(kind >= 0)
            yield packed([*(c[at] for c in cols), kind[at], np.zeros(len(at), np.int64)])
            if extra:
                yield packed(zip(*extra))
        if start is not None:
            yield packed(zip((*start, 0, size)))

    found = written(dealt.mapInArrow(scan, f"{_ROW}, kind int, run bigint"), "suffix-runs")
    # run > 0: the first row of a task's first or last run, with the length of the run
    edges = found.where("run > 0")
    by = [F.col(k).alias(f"k{k}") for k in keys[:hashes]]
    totals = edges.groupBy(*by).agg(F.sum("run").alias("total"), F.min(F.struct("id", "pos")).alias("low"))
    kind = F.when(F.col("total") == 1, ONLY).when(F.struct("id", "pos") == F.col("low"), FIRST).otherwise(LATER)
    settled = edges.join(totals, [F.col(k) == F.col(f"k{k}") for k in keys[:hashes]])
    settled = settled.withColumn("kind", kind).where(F.lit(only) | (F.col("kind") != ONLY))
    cols = ["h1", "h2", "id", "pos", "n", "kind"]
    return found.where("run = 0").select(*cols).unionByName(settled.select(*cols))


def spans(rows: DataFrame, words: int) -> DataFrame:
    """(id, spans, n_words): passages (id, pos, n) joined where they overlap or touch."""
    by_doc = W.partitionBy("id").orderBy("pos", "n")
    rows = rows.select("id", "pos", (F.col("pos") + F.col("n") - 1 + words).alias("end"), "n")
    before = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", (before.isNull() | (F.col("pos") > before)).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    joined = rows.groupBy("id", "span").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_words"))


def repeated_passages(docs: DataFrame, row_id: str = "doc_id", text: str = "text",
                      words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans, n_words, later, n_later) for every row.

    `spans` lists (start, end), in words, of everything that lies in a passage of at least
    `words` words which occurs again, in the same or another text; `later` only counts
    occurrences behind the first one (by id, then position), which a de-duplication would
    cut. Words are runs of anything but space and \\t to \\r and compared as they are; null
    and empty texts hold none. Rows that repeat an id, or have none, are rows of their own, later
    than those with smaller ids; rows without an id are the last. An empty table gives no rows.

    Suffixes at selected positions are sorted by their first words, and those that equal no
    neighbour are dropped. The others are extended to the left and right: first as a whole,
    to all passages that belong to them; where neighbours agree on these, one of them stands
    for all. What is left differs from its neighbours somewhere in reach and is compared
    passage by passage. Every repeated passage is found.
    """
    with_package(docs.sparkSession)
    if words < window + gram - 1:
        raise ValueError("a passage must hold a whole window")
    slim = docs.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    odd = slim.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 OR id IS NULL")
    if not odd.isEmpty():  # rows get numbers of their own, in the order of their ids
        rows = docs.select(F.col(row_id).alias("own"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
        rows = rows.orderBy(F.col("own").cast("bigint").asc_nulls_last(), "at").drop("at")
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "suffix-rows")
        found = repeated_passages(rows, "key", "text", words, window, gram)
        names = rows.select(F.col("key").alias("k"), "own")
        return found.join(names, F.col("key") == F.col("k")).select(
            F.col("own").alias(row_id), "spans", "n_words", "later", "n_later")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settled(rows: DataFrame, hashes: int = 2, only: bool = False) -> DataFrame:
        return compared(rows, max(width, -(-rows.count() // ROWS_PER_TASK)), hashes, only)

    kept = written(sparse_suffixes(slim, words, window, gram), "suffixes")
    near = settled(kept, 1).drop("kind")
    whole = settled(near, only=True)
    stand = settled(whole.where(F.col("kind") != LATER).drop("kind"), 1).select("id", "pos", "n")
    at = stand.groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("pos", "n")).alias("at"))
    again = slim.join(at, F.col("id") == F.col("i")).select("id", "text", "at")
    single = written(settled(written(passages(again, words), "suffix-passages")), "suffix-repeated")

    every = spans(whole.where(F.col("kind") != ONLY).select("id", "pos", "n").unionByName(
        single.select("id", "pos", "n")), words)
    later = spans(whole.where(F.col("kind") == LATER).select("id", "pos", "n").unionByName(
        single.where(F.col("kind") == LATER).select("id", "pos", "n")), words)
    later = later.select(F.col("id").alias("l"), F.col("spans").alias("later"), F.col("n_words").alias("n_later"))
    out = docs.select(F.col(row_id).alias("d")).join(every, F.col("d") == F.col("id"), "left")
    out = out.join(later, F.col("d") == F.col("l"), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return out.select(
        F.col("d").alias(row_id), F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce("later", none).alias("later"), F.coalesce("n_later", F.lit(0)).cast("bigint").alias("n_later"))
