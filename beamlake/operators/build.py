"""Index construction from a table of float embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.config import DEGREE, DIM, SCALE
from beamlake.functions.vector import quantize
from beamlake.operators import graph, pq
from beamlake.operators.search import Index
from beamlake.operators.tables import stored


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and vec of every usable row: DIM finite components, none null, that fit 16 bits. Other rows take no part."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 32767 / SCALE))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") == DIM) & F.coalesce(fits, F.lit(False))
    return e.where(usable).select("vec_id", quantize(F.col("embedding")).alias("vec"))


def base_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are indexed: all of them."""
    return quantized(spark, sf_dir)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the rows whose vec_id is divisible by 10. Searches leave a query's own row out of its results."""
    return quantized(spark, sf_dir).where(F.pmod("vec_id", F.lit(10)) == 0).withColumnRenamed("vec_id", "query_id")


def build_index(vectors: DataFrame, degree: int = DEGREE) -> Index:
    """Mean, trained codebooks, codes and exact neighbour graph; the entry is the smallest vec_id."""
    mean = pq.mean_array(vectors)
    books = {m: pq.train_codebook(vectors, mean, m) for m in (16, 32)}
    codes = stored(pq.encode(vectors, mean, books), "codes")
    links = stored(graph.knn_graph(vectors, degree), "graph")
    entry = vectors.agg(F.min("vec_id")).first()[0]
    return Index(vectors, links, codes, mean, books, entry)
