"""Product quantization: mean, codebooks, codes, distance tables, and scans by code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.config import CENTROIDS, DIM
from beamlake.operators.blocked import matrix, topk


def vector_mean(vectors: DataFrame) -> DataFrame:
    """dim and the floor of the mean, by dimension; partial sums per task, one row per dimension."""
    each = vectors.select(F.posexplode("vec").alias("dim", "x"))
    return each.groupBy("dim").agg(F.floor(F.sum(F.col("x").cast("bigint")) / F.count("*")).cast("bigint").alias("mean"))


def mean_array(vectors: DataFrame) -> np.ndarray:
    rows = vector_mean(vectors).collect()  # one row per dimension
    out = np.zeros(len(rows), dtype=np.int64)
    for r in rows:
        out[r["dim"]] = r["mean"]
    return out


#: Levels of a dimension in the first partition: as many cells of a subspace as it has centroids.
LEVELS = {16: 4, 32: 16}
#: Rounds of k-means after it.
ROUNDS = 2
#: Rows that are encoded, or summed, at a time.
STEP = 1_024


def _means(vectors: DataFrame, cells, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the vectors' subvectors by subspace and cell. cells gives n x m cells of centred rows.

    One pass over all rows; a task sums its own first, and m x CENTROIDS rows reach the driver."""
    schema = "cell int, n bigint, " + ", ".join(f"s{j} bigint" for j in range(width))

    def run(batches):
        sums, n = np.zeros((count, width), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                x, at = cells(matrix(pa.chunked_array([b.column(0).slice(i, STEP)])))
                flat = (at + np.arange(at.shape[1]) * CENTROIDS).ravel()
                parts = x.reshape(-1, width)
                n += np.bincount(flat, minlength=count)
                for j in range(width):  # sums of STEP values of few bits: a double holds them without loss
                    sums[:, j] += np.bincount(flat, weights=parts[:, j], minlength=count).astype(np.int64)
        used = np.flatnonzero(n)
        cols = [pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), *[pa.array(sums[used, j], pa.int64()) for j in range(width)]]
        yield pa.RecordBatch.from_arrays(cols, names=["cell", "n", *[f"s{j}" for j in range(width)]])

    each = vectors.select("vec").mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    sums, n = np.zeros((count, width), dtype=np.int64), np.zeros(count, dtype=np.int64)
    for r in each.collect():  # at most m x CENTROIDS
        n[r["cell"]] = r["n"]
        sums[r["cell"]] = [r[f"s{j}"] for j in range(width)]
    return sums, n


def train_codebook(vectors: DataFrame, mean: np.ndarray, m: int, rounds: int = ROUNDS) -> np.ndarray:
    """CENTROIDS x dim, trained on all rows in whole numbers. Subspace s of m is columns s*dim/m on.

    The first partition of a subspace is a grid: each dimension is cut into LEVELS of equal width, a step that follows
    its mean absolute value. Its cells' means are the first centroids (an empty cell's is its middle), and `rounds` rounds of
    k-means follow; a centroid that no row is nearest to stays."""
    dim = len(mean)
    width, levels = dim // m, LEVELS[m]
    spread = np.zeros(dim, dtype=np.int64)
    centred = F.zip_with("vec", F.lit(mean.tolist()), lambda x, mu: F.abs(x.cast("bigint") - mu))
    for r in vectors.select(F.posexplode(centred).alias("dim", "x")).groupBy("dim").agg(F.floor(F.sum("x") / F.count("*")).alias("x")).collect():
        spread[r["dim"]] = r["x"]
    step = spread // (levels // 4 if levels > 4 else 1) + 1
    powers = levels ** np.arange(width)

    def grid(x: np.ndarray):
        c = x - mean
        level = np.clip(c // step + levels // 2, 0, levels - 1)
        return c, (level.reshape(len(c), m, width) * powers).sum(axis=2)

    sums, n = _means(vectors, grid, m * CENTROIDS, width)
    cell = np.arange(CENTROIDS)
    level = cell[None, :, None] // powers % levels
    middle = ((level - levels // 2) * step.reshape(m, 1, width) + step.reshape(m, 1, width) // 2).reshape(m * CENTROIDS, width)
    centre = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], middle)
    whole = lambda c: c.reshape(m, CENTROIDS, width).transpose(1, 0, 2).reshape(CENTROIDS, dim)
    for _ in range(rounds):
        book = whole(centre)

        def nearest(x: np.ndarray, book: np.ndarray = book):
            return x - mean, encode_array(x - mean, book, m).astype(np.int64)

        sums, n = _means(vectors, nearest, m * CENTROIDS, width)
        centre = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centre)
    return whole(centre)


def codebook_rows(spark, book: np.ndarray, m: int) -> DataFrame:
    width = book.shape[1] // m
    rows = [(s, c, book[c, s * width : (s + 1) * width].tolist()) for s in range(m) for c in range(len(book))]
    return spark.createDataFrame(rows, "subspace int, centroid int, c array<int>")


def _crossed(x: np.ndarray, book: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Subvectors and centroids by subspace as m x n x width and m x width x centroids, and m x n x centroids: c * c - 2 x * c. Doubles, all of
    them whole and without loss, as vectors have 16 bits."""
    width = x.shape[1] // m
    parts = x.astype(np.float64).reshape(len(x), m, width).transpose(1, 0, 2)
    centre = book.astype(np.float64).reshape(len(book), m, width).transpose(1, 2, 0)
    d = np.matmul(-2 * parts, centre)
    d += (centre * centre).sum(axis=1)[:, None, :]
    return parts, d


def tables(x: np.ndarray, book: np.ndarray, m: int) -> np.ndarray:
    """n x m x centroids: squared distances of each centred row's subvectors to the centroids."""
    parts, d = _crossed(x, book, m)
    d += (parts * parts).sum(axis=2)[:, :, None]
    return np.ascontiguousarray(d.transpose(1, 0, 2)).astype(np.int64)


def encode_array(x: np.ndarray, book: np.ndarray, m: int) -> np.ndarray:
    """Nearest centroid by subspace, ties to the smaller number."""
    out = np.empty((len(x), m), dtype=np.int16)
    for i in range(0, len(x), 256):
        out[i : i + 256] = _crossed(x[i : i + 256], book, m)[1].argmin(axis=2).T
    return out


def _lists(a: np.ndarray) -> pa.ListArray:
    """A list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def encode(vectors: DataFrame, mean: np.ndarray, books: dict[int, np.ndarray]) -> DataFrame:
    """vec_id and the codes pq16, pq32 of the given codebooks, which are of fixed size."""
    schema = "vec_id bigint, " + ", ".join(f"pq{m} array<smallint>" for m in books)

    def run(batches):
        for b in batches:
            x = matrix(pa.chunked_array([b.column(1)])) if b.num_rows else np.zeros((0, DIM), np.int64)
            codes = [_lists(encode_array(x - mean, book, m)) for m, book in books.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *codes], names=["vec_id", *[f"pq{m}" for m in books]])

    return vectors.select("vec_id", "vec").mapInArrow(run, schema)


def adc_tables(queries: DataFrame, mean: np.ndarray, book: np.ndarray, m: int) -> DataFrame:
    """query_id, subspace, centroid, dist."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                ids = b.column(0).slice(i, 64).to_numpy(zero_copy_only=False)
                t = tables(matrix(pa.chunked_array([b.column(1).slice(i, 64)])) - mean, book, m)
                n, _, c = t.shape
                at = np.indices((n, m, c)).reshape(3, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[0]], pa.int64()), pa.array(at[1], pa.int32()), pa.array(at[2], pa.int32()), pa.array(t.ravel(), pa.int64())], names=["query_id", "subspace", "centroid", "dist"]
                )

    return queries.select("query_id", "vec").mapInArrow(run, "query_id bigint, subspace int, centroid int, dist bigint")


def adc_scan(codes: DataFrame, queries: DataFrame, mean: np.ndarray, book: np.ndarray, m: int, k: int) -> DataFrame:
    """The k rows nearest to each query by code, without an index."""

    def block(a: pa.Table, q: pa.Table) -> np.ndarray:
        c = matrix(a.column("code"))
        t = tables(matrix(q.column("vec")) - mean, book, m)
        return np.stack([one[np.arange(m)[:, None], c.T].sum(axis=0) for one in t])

    return topk(codes.select("vec_id", F.col(f"pq{m}").alias("code")), queries.select("query_id", "vec"), k, block)
