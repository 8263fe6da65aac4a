"""Exact k nearest neighbours of all vectors through a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it, and stored
by pivot in the order of that distance (iDistance: Jagadish, Ooi, Tan, Yu and
Zhang, 2005). A query visits the cells from the most promising one and, in
each, the annulus around its own distance to the pivot, ring after ring
outwards. A ring is a row group of the cell's file, whose statistics give its
least and greatest distance, so a ring that isn't needed isn't read. By the
triangle inequality no vector of a ring is nearer than the ring's distance from
the query's, and rings beyond the k-th distance so far are left out. The bounds
only save work: the result is that of comparing all pairs.

There are as many pivots as the square root of the vectors, so cells grow no
faster than the list of pivots, and both stay small beside the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, open_shared, positional, shared_dir, stored

K = 10
#: Bytes of a ring in its file, queries handled together, queries of a task, bytes of rings that a worker keeps.
RING, BLOCK, QUERIES, KEEP = 1 << 20, 512, 4096, 96 << 20
#: What rounding may add to a squared distance of the first, faster formula in single precision, relative to the vectors' squared lengths.
SLACK = 1e-5


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _assign(pivots: np.ndarray):
    dim = pivots.shape[1]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = matrix(b.column(1), dim)
                cell = squared(x, pivots).argmin(1)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(dist), *b.columns], names=["cell", "dist", "vec_id", "vec"])

    return f


class Cells:
    """The cells of an index: each one's rings, read when they are needed."""

    def __init__(self, path: str, dim: int):
        self.path, self.dim, self.held, self.bytes, self.known = path, dim, {}, 0, {}

    def rings(self, cell: int) -> list[tuple[float, float, tuple]]:
        """(least distance, greatest distance, key) of each ring."""
        if cell not in self.known:
            import pyarrow.parquet as pq
            from pyarrow import fs

            files, at = open_shared(f"{self.path}/cell={cell}")
            out = []
            for info in files.get_file_info(fs.FileSelector(at)):
                if info.path.endswith(".parquet"):
                    meta = pq.read_metadata(info.path, filesystem=files)
                    dist = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "dist")
                    for g in range(meta.num_row_groups):
                        st = meta.row_group(g).column(dist).statistics
                        out.append((st.min, st.max, (info.path, g)))
            self.known[cell] = out
        return self.known[cell]

    def ring(self, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and vectors of a ring, the vectors in double and in single precision."""
        if key not in self.held:
            import pyarrow.parquet as pq

            files, _ = open_shared(self.path)
            t = pq.ParquetFile(key[0], filesystem=files).read_row_group(key[1], columns=["vec_id", "vec"])
            vec = matrix(t.column("vec").combine_chunks(), self.dim)
            got = t.column("vec_id").to_numpy(), vec, vec.astype(np.float32)
            self.bytes += sum(x.nbytes for x in got)
            while self.held and self.bytes > KEEP:
                self.bytes -= sum(x.nbytes for x in self.held.pop(next(iter(self.held))))
            self.held[key] = got
        return self.held[key]


class Best:
    """The k nearest of each query of a block so far, by distance and id."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.q32, self.len2 = q.astype(np.float32), (q * q).sum(1)
        self.who, self.d, self.of = (np.zeros(0, np.int64) for _ in range(3))
        self.d = self.d.astype(float)
        self.kth = np.full(len(q), np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vec: np.ndarray, vec32: np.ndarray) -> None:
        far = (vec * vec).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            near = (-2 * self.q32[rows]) @ vec32.T
            near += far.astype(np.float32)[None, :]
            # squared distances less the queries' squared lengths; what overflows counts as near
            near[~np.isfinite(near)] = -np.inf
            slack = SLACK * (self.len2[rows] + far.max())
            limit = self.kth[rows] ** 2 - self.len2[rows]
            some = np.flatnonzero(np.isinf(limit) & (limit > 0))
            if len(some) and vec.shape[0] > self.k + 1:
                # k others at least are as near, whether or not a row with the query's own id is among these
                limit[some] = np.partition(near[some], self.k, axis=1)[:, self.k] + slack[some]
            r, c = np.nonzero(near <= np.minimum(limit + slack, np.finfo(np.float32).max)[:, None].astype(np.float64))
        other = self.ids[rows[r]] != ids[c]
        r, c = r[other], c[other]
        if not len(r):
            return
        # those that may count, by the plain formula, so that equal vectors tie
        d = np.concatenate([np.sqrt(((self.q[rows[r[i : i + 65536]]] - vec[c[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(r), 65536)])
        ok = d <= self.kth[rows[r]]
        r, c, d = r[ok], c[ok], d[ok]
        of, d, who = np.append(self.of, rows[r]), np.append(self.d, d), np.append(self.who, ids[c])
        order = np.lexsort((who, d, of))
        of, d, who = of[order], d[order], who[order]
        start = np.searchsorted(of, np.arange(len(self.q)))
        rank = np.arange(len(of)) - start[of]
        m = rank < self.k
        self.of, self.d, self.who = of[m], d[m], who[m]
        last = rank == self.k - 1
        self.kth[of[last]] = d[last]


def search(q: np.ndarray, ids: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, cells: Cells, k: int) -> Best:
    """Best of the queries; low and high: least and greatest distance to each pivot, NaN for an empty cell."""
    best = Best(q, ids, k)
    to = np.sqrt(squared(q, pivots))
    eps = 1e-7 * (1 + to.max(initial=0))  # for the rounding of these distances
    bound = np.maximum(np.maximum(to - high, low - to), 0) - eps
    for cell in np.argsort(np.nan_to_num(bound.min(0) + 1e-9 * to.min(0), nan=np.inf), kind="stable").tolist():
        if np.isnan(low[cell]) or not (bound[:, cell] <= best.kth).any():
            continue
        middle = np.median(to[:, cell])
        # rings of the annulus, from the queries' own distances outwards
        for lo, hi, key in sorted(cells.rings(cell), key=lambda r: abs((r[0] + r[1]) / 2 - middle)):
            rows = np.flatnonzero(np.maximum(to[:, cell] - hi, lo - to[:, cell]) - eps <= best.kth)
            if len(rows):
                best.offer(rows, *cells.ring(key))
    return best


def _search(path: str, pivots, low: np.ndarray, high: np.ndarray, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        cells = Cells(path, p.shape[1])
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                b = batch.slice(i, BLOCK)
                ids = b.column(0).to_numpy()
                best = search(matrix(b.column(1), p.shape[1]), ids, p, low, high, cells, k)
                start = np.searchsorted(best.of, np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.of]), pa.array(best.who), pa.array((np.arange(len(best.of)) - start[best.of] + 1).astype(np.int32)), pa.array(best.d)], names=["vec_id", "neighbour_id", "rank", "distance"])

    return f


def top_k(vectors: DataFrame, k: int = K, pivots: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, rank int, distance double): the k nearest other vectors of each, ties by lesser id.

    Distances are Euclidean. Vectors with a null id, without components, with a
    null or non-finite one, or of another length than most take no part (of
    lengths as frequent, the lesser counts). Rows that repeat an id are found
    each, but a vector is no neighbour of rows with its own id. With fewer
    vectors than k, all are neighbours; an empty table gives an empty one.
    pivots: the square root of the number of vectors, unless given.
    """
    spark = vectors.sparkSession
    pos, names = positional(vectors)
    vec = F.col(column(names, vector)).cast("array<double>")
    fine = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vec) > 0)
    rows = pos.select(F.col(column(names, key)).cast("bigint").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & fine)
    out = "vec_id bigint, neighbour_id bigint, rank int, distance double"
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim, n = common.n, common["count"]
    rows = rows.where(F.size("vec") == dim)
    # their number, and so what goes to the driver and to each worker, grows with the square root of the table
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots or max(16, math.isqrt(n))).collect()
    p = np.unique(np.array([r.vec for r in chosen], dtype=float), axis=0)
    held = spark.sparkContext.broadcast(p)
    keyed = stored(rows.mapInArrow(lambda it: _assign(held.value)(it), "cell int, dist double, vec_id bigint, vec array<double>"))
    path = shared_dir(spark)
    keyed.repartition("cell").sortWithinPartitions("cell", "dist").write.partitionBy("cell").option("parquet.block.size", RING).parquet(path)
    low, high = np.full(len(p), np.nan), np.full(len(p), np.nan)
    sizes = keyed.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("rows"))
    for r in sizes.collect():  # a row a pivot
        low[r.cell], high[r.cell] = r.lo, r.hi
    # neighbours search together; a large cell's queries are spread over tasks
    parts = F.ceil(F.col("rows") / QUERIES)
    spread = keyed.join(F.broadcast(sizes.select(F.col("cell").alias("_cell"), parts.alias("_parts"))), F.col("cell") == F.col("_cell"))
    queries = spread.repartition(max(8, -(-n // (QUERIES // 2))), "cell", F.pmod(F.xxhash64("vec_id"), F.col("_parts"))).sortWithinPartitions("cell", "dist")
    return queries.select("vec_id", "vec").mapInArrow(_search(path, held, low, high, k), out)
