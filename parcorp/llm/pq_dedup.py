"""Near-duplicate embeddings: inverted lists, residual product codes, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from parcorp.llm.common import Forest, components, with_package, written

THRESHOLD = 0.93
FIT_ROWS = 20_000  # at most about twice as many vectors fit the index
LIST_ROWS = 500  # vectors per list that the number of lists aims at
MAX_LISTS = 4096
SUBSPACES = 8
CODES = 256
BLOCK = 8192  # queries, and list members, that one block compares
BATCH_BYTES = 1 << 26  # of vectors that one batch hands back to Spark
ROUNDS = 8  # of k-means
SLACK = 1e-4  # for single-precision rounding in the candidate tests
MISS = 0.0  # probe as far as the linking radius: no neighbour can be missed


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centroids of a bounded sample; starts from k distinct rows."""
    rnd = np.random.default_rng(seed)
    centres = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate(
        [(x[i:i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])


class Index:
    """Coarse centroids and, per subspace, codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> None:
        dim = sample.shape[1]
        self.centres = kmeans(sample, max(1, min(lists, len(sample))))
        left = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = [dim * i // min(subspaces, dim) for i in range(min(subspaces, dim) + 1)]
        self.books = [kmeans(left[:, a:b], min(codes, len(left))) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): error is the distance to what the codes stand for."""
        near = nearest(x, self.centres)
        left = x - self.centres[near]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            codes[:, m] = nearest(left[:, a:b], self.books[m])
            error += ((left[:, a:b] - self.books[m][codes[:, m]]) ** 2).sum(axis=1)
        return near, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, margin: float) -> Iterator[np.ndarray]:
        """For each vector the lists whose border with its own list is within `margin`.

        A member of list c is no nearer to any other centroid, so it lies on c's side of
        the plane half-way between c and the vector's own centroid. With the linking
        radius as the margin no neighbour can be missed.
        """
        for i in range(0, len(x), 1024):
            beyond, _ = self._beyond(x[i:i + 1024])
            yield from (np.flatnonzero(r) for r in beyond <= margin + SLACK)

    def _beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each vector from the border of every list with its own, and its own."""
        squares = (self.centres**2).sum(axis=1)
        d = squares - 2 * x @ self.centres.T
        own = d.argmin(axis=1)
        gaps = np.sqrt(np.maximum(squares[own][:, None] + squares - 2 * self.centres[own] @ self.centres.T, 0))
        return (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * gaps, 1e-12), own

    def margin(self, sample: np.ndarray, radius: float, miss: float, seed: int = 42) -> float:
        """How far to look beyond borders: the linking radius itself where `miss` is 0.

        Otherwise all but a share `miss` of made-up neighbours at that distance from the
        sample's vectors, in random directions, are found. Real neighbours lie where the
        data vary and cross borders more often, so the share missed of them has no bound.
        """
        if miss <= 0:
            return radius
        rnd = np.random.default_rng(seed)
        cosine, needed = 1 - radius**2 / 2, []
        for i in range(0, len(sample), 1024):
            x = sample[i:i + 1024]
            side = rnd.normal(size=x.shape)
            side -= (side * x).sum(axis=1, keepdims=True) * x
            side /= np.maximum(np.sqrt((side**2).sum(axis=1, keepdims=True)), 1e-12)
            beyond, _ = self._beyond(x)
            y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * side
            needed.append(beyond[np.arange(len(x)), nearest(y, self.centres)])
        return min(radius, float(np.quantile(np.concatenate(needed), 1 - miss)))

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to coded members of a list: per subspace
        a table of distances to every codeword, then look-ups."""
        left = queries - self.centres[centre]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            book, part = self.books[m], left[:, a:b]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            total += np.take(table.astype(np.float32), codes[:, m], axis=1)
        return total


def usable(rows: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """(id, c, label, v, dim): c, a digest of label and vector, is null where the row links
    with nothing. The digest is that of the vector divided by its largest component, so that
    copies and their exact multiples by powers of two are one class. Vectors of doubles are
    kept so divided, since their squares could overflow; those of floats as they are, which
    halves them."""
    kind = rows.select(vector).schema[0].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.col(label).isNotNull(), F.lit(False))
    good = good & (largest > 0)
    scaled = F.transform(v, lambda x: x / largest + F.lit(0.0))  # -0.0 becomes 0.0
    out = rows.select(
        F.col(row_id).cast("bigint").alias("id"), F.when(good, F.col(label).cast("string")).alias("label"),
        F.when(good, scaled).alias("s"), F.when(good, F.col(vector) if single else scaled).alias("v"))
    text = F.concat(F.length("label").cast("string"), F.lit(":"), F.col("label"), F.lit("|"),
                    F.array_join(F.col("s").cast("array<string>"), ","))
    return out.withColumn("c", F.md5(text)).drop("s").withColumn("dim", F.when(F.col("v").isNotNull(), F.size("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows at length one, in double precision."""
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _as_bytes(x: np.ndarray) -> pa.Array:
    """One binary value per row: bytes pass between Spark and Python as a block, arrays by element."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _from_bytes(column: pa.Array, width: int) -> np.ndarray:
    """The rows of `_as_bytes`: width values each, of the type that their size tells."""
    data = b"".join(column.to_pylist())
    kind = {1: np.uint8, 4: np.float32, 8: np.float64}[len(data) // (len(column) * width)]
    return np.frombuffer(data, kind).reshape(-1, width)


def _assigned(classes: DataFrame, index: Index, dim: int, margin: float) -> DataFrame:
    """Each vector as a member of its list and as a visitor of later lists to be probed."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = _matrix(batch.column(3), dim)
            x = _unit(given)
            own, codes, error = index.encode(x)
            probes = [p[p >= o] for p, o in zip(index.probes(x, margin), own)]
            probes = [p if o in p else np.append(p, o) for p, o in zip(probes, own)]
            at = np.repeat(np.arange(len(x)), [len(p) for p in probes])
            lists = np.concatenate(probes).astype(np.int32)
            step = max(1, BATCH_BYTES // (dim * given.itemsize))
            for lo in range(0, len(at), step):
                one, part = at[lo:lo + step], lists[lo:lo + step]
                take = pa.array(one)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                     _as_bytes(given[one]), pa.array(part), pa.array(part == own[one]),
                     _as_bytes(codes[one]), pa.array(error[one])],
                    ["c", "label", "n", "v", "list", "member", "codes", "error"])

    return classes.select("c", "label", "n", "v").mapInArrow(
        place, "c string, label string, n bigint, v binary, list int, member boolean, codes binary, error double")


def _compare(index: Index, x, member, codes, error, part, n, centre: int, threshold: float):
    """(links per row, root per row) of one block; pairs within a part only if it is alone."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    count, forest = np.zeros(len(x), np.int64), Forest(len(x))
    inner, own = part.min() == part.max(), np.flatnonzero(member)
    reach = ((radius + error[own] + SLACK) ** 2).astype(np.float32)
    for lo in range(0, len(x) if len(own) else 0, 256):
        rows = np.arange(lo, min(len(x), lo + 256))
        near = index.distances(x[rows], centre, codes[own]) <= reach
        # two members meet once, a visitor meets all members
        near &= ~member[rows][:, None] | (own > rows[:, None])
        if not inner:
            near &= part[rows][:, None] != part[own]
        i, j = np.nonzero(near)
        i, j = rows[i], own[j]
        keep = [np.einsum("ij,ij->i", x[i[k:k + 65536]], x[j[k:k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
        if not keep:
            continue
        keep = np.concatenate(keep)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        np.add.at(count, i, n[j])
        np.add.at(count, j, n[i])
        cuts = np.flatnonzero(np.diff(i)) + 1
        for first, members in zip(i[np.concatenate([[0], cuts])], np.split(j, cuts)):
            forest.join(np.append(members, first))
    return count, forest.roots()


def _linked(classes: DataFrame, dim: int, rows: int, threshold: float, lists: int | None, block: int,
            miss: float) -> DataFrame:
    """(a, b, links): class a has `links` more linked rows; a and b share a component."""
    bound = f"{min(FIT_ROWS * 16**7 // rows, 16**7):08x}"
    chosen = F.concat(F.lit("0"), F.substring("c", 1, 7)) < F.lit(bound)
    sample = classes.where(chosen).select("v").limit(2 * FIT_ROWS).toArrow()
    if not sample.num_rows:
        sample = classes.select("v").limit(1).toArrow()
    per_label = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    known = _unit(_matrix(sample.column(0).combine_chunks(), dim))
    index = Index(known, lists or min(MAX_LISTS, math.ceil(per_label / LIST_ROWS)))
    margin = index.margin(known, math.sqrt(max(0.0, 2 - 2 * threshold)), miss)
    placed = written(_assigned(classes, index, dim, margin), "pq-lists")

    sizes = placed.groupBy("label", "list").agg(F.count("*").alias("c_")).where(F.col("c_") > block)
    sizes = written(sizes.select(F.col("label").alias("l_"), F.col("list").alias("li_"),
                                 F.ceil(F.col("c_") / block).cast("int").alias("parts")), "pq-crowded")
    if sizes.isEmpty():
        placed = placed.withColumn("parts", F.lit(1))
    else:
        placed = placed.join(sizes, (F.col("label") == F.col("l_")) & (F.col("list") == F.col("li_")), "left")
        placed = placed.withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.concat_ws("/", "list", F.least("part", "o"), F.greatest("part", "o"), "label")
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(key.alias("key"), "c", "n", "v", "list", "member", "codes", "error", "part")
    dealt = dealt.repartition(width, "key").sortWithinPartitions("key", "c")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_rows(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            col = {name: t.column(name).combine_chunks() for name in t.column_names}
            x = _unit(_from_bytes(col["v"], dim))
            codes = _from_bytes(col["codes"], len(index.books))
            count, root = _compare(
                index, x, col["member"].to_numpy(zero_copy_only=False), codes, col["error"].to_numpy(),
                col["part"].to_numpy(), col["n"].to_numpy(), col["list"][0].as_py(), threshold)
            hit = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays(
                [col["c"].take(pa.array(hit)), col["c"].take(pa.array(root[hit])), pa.array(count[hit])],
                ["a", "b", "links"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            keys = held.column("key").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], cuts):
                if hi - lo > 1:
                    yield block_rows(held.slice(lo, hi - lo))
            held = held.slice(cuts[-1]) if len(cuts) else held  # the last block may go on
        if held is not None and held.num_rows > 1:
            yield block_rows(held)

    return dealt.mapInArrow(scan, "a string, b string, links bigint")


def near_vectors(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, lists: int | None = None, block: int = BLOCK,
                 miss: float = MISS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and the cosine, in double precision, is at least
    `threshold`. Rows with a null label or a vector that is null, empty, zero or holds null
    or non-finite components link with nothing; vectors of different lengths do not link.
    Equal vectors of a label are compared once and counted as often as they occur. Rows
    that repeat an id count one by one; the smallest id of a component stays, and null ids
    are never the smallest unless there is no other.

    The index is fitted on a bounded sample and holds every vector. All lists are probed
    whose border is within the linking radius, so that no neighbour can be missed (a `miss`
    above 0 gives that up, see `Index.margin`); the test of the code distances uses a bound
    that no neighbour in a probed list can fall outside of, and the exact cosine decides. Lists are compared in blocks of bounded size: a crowded
    list is cut into parts, and each pair of parts is a block of its own.
    """
    with_package(rows.sparkSession)
    base = written(usable(rows, row_id, vector, label), "pq-rows")
    classes = base.where("c IS NOT NULL").groupBy("c").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("v").alias("v"), F.first("dim").alias("dim"))
    classes = written(classes, "pq-classes")
    sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}
    links = classes.limit(0).select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("n").alias("links"))
    for dim, n in sorted(sizes.items()):
        links = links.unionByName(_linked(classes.where(F.col("dim") == dim), dim, n, threshold, lists, block, miss))
    links = written(links, "pq-links")
    tree = components(links.where("a <> b").select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    placed = (
        classes.select("c", "low", "n").join(tree, F.col("c") == F.col("node"), "left")
        .join(counts, F.col("c") == F.col("a"), "left")
        .select("c", "low", F.coalesce("root", "c").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    # a table of its own, so that the join below can split the rows of a large component
    lows = written(placed.groupBy("root").agg(F.min("low").alias("component_id")), "pq-lows")
    result = placed.join(lows, "root").select(F.col("c").alias("k"), "n_links", "component_id")
    result = written(result, "pq-result")
    out = base.select("id", "c").join(result, F.col("c") == F.col("k"), "left").select(
        F.col("id").alias(row_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("k").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(row_id).eqNullSafe(F.col("component_id")))
