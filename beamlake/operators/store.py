"""An index as stored tables: generations of bucketed files, and a manifest that is flipped in one step.

A generation's files are written first, into a folder of their own; then manifest-<number> appears, by a rename that fails where the
number is taken. Readers take the largest number, so they see a whole generation or the one before, and of two writers that begin from the same
generation one is told so. A generation may name tables of former ones for the shards that it leaves as they are.

Rows are bucketed by shard and sorted by vec_id: vectors, codes and lists of a row lie together, a query reads the columns it needs, and a search
by shard reads its tables without an exchange.

`open_index` loads the index of a table, and builds it only if no generation was built from these very files.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.config import DEGREE
from beamlake.operators import pq, shards
from beamlake.operators.search import Index
from beamlake.operators.tables import shared_dir, stored
from beamlake.sources.files import FileStore

LENGTHS = (16, 32)


@dataclass
class Stored:
    """A loaded generation: parts are bucketed tables, each with the shards that are read from it; the rest is small."""

    manifest: dict
    parts: list[tuple[DataFrame, list[int]]]
    mean: np.ndarray
    books: dict[int, np.ndarray]

    @property
    def rows(self) -> DataFrame:
        """All rows, as one table. A search that takes the parts one by one moves none of them."""
        return functools.reduce(DataFrame.unionByName, [rows for rows, _ in self.parts])

    def index(self) -> Index:
        """The index as tables that search takes; with one shard its graph is that of all rows."""
        r = self.rows
        return Index(r.select("vec_id", "vec"), r.select("vec_id", "neighbors"), r.select("vec_id", "pq16", "pq32"), self.mean, self.books, self.manifest["entry"])


class IndexStore:
    """Generations of an index under `path`, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), FileStore(spark)

    def generations(self) -> list[int]:
        """Published generations, oldest first."""
        if not self.files.exists(self.path):
            return []
        return sorted(int(n.removeprefix("manifest-")) for n in self.files.names(self.path) if n.removeprefix("manifest-").isdigit() and n.startswith("manifest-"))

    def manifest(self, generation: int | None = None) -> dict | None:
        """What is published, the newest or the one asked for; None if nothing is."""
        known = self.generations()
        if not known:
            return None
        return json.loads(self.files.read_bytes(f"{self.path}/manifest-{generation or known[-1]:06d}"))

    def publish(self, rows: DataFrame, mean: np.ndarray, books: dict[int, np.ndarray], n_shards: int, entry: int | None, after: int | None = None, shards_written: list[int] | None = None, kept: list[dict] | None = None, **facts: object) -> dict:
        """Write a generation and flip the manifest to it. after: the generation that rows were made from; another writer's is an error.

        shards_written: the shards that rows holds, where it isn't all; kept: parts of former generations that are read for the others."""
        known = self.generations()
        base = known[-1] if known else 0
        if after is not None and after != base:
            raise RuntimeError(f"generation {after} is no longer the newest: {base} is")
        number, name = base + 1, uuid.uuid4().hex
        where = f"{self.path}/rows-{name}"
        table = f"index_{name}"
        rows.repartition(n_shards, "shard").write.bucketBy(n_shards, "shard").sortBy("vec_id").option("path", where).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the definition; files stay
        mine = list(range(n_shards)) if shards_written is None else shards_written
        m = {"generation": number, "parts": [*(kept or []), {"rows": where, "shards": mine}], "shards": n_shards, "entry": entry, "mean": mean.tolist(), **facts}
        m["books"] = {str(k): b.tolist() for k, b in books.items()}  # CENTROIDS x dimension each, whatever the rows
        if self.files.exists(f"{self.path}/manifest-{number:06d}"):
            raise RuntimeError(f"generation {number} has been published by another writer")
        self.files.write_text(f"{self.path}/manifest-{number:06d}", json.dumps(m))
        return m

    def adopt(self, other: Stored) -> dict:
        """Begin this store with another's generation: its manifest is copied, its files are read where they are."""
        if self.generations():
            raise RuntimeError(f"{self.path} has generations of its own")
        m = other.manifest | {"generation": 1}
        self.files.write_text(f"{self.path}/manifest-000001", json.dumps(m))
        return m

    def _part(self, part: dict, n_shards: int) -> tuple[DataFrame, list[int]]:
        table = "index_" + part["rows"].rsplit("-", 1)[1]
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({shards.ROWS}) USING parquet CLUSTERED BY (shard) SORTED BY (vec_id) INTO {n_shards} BUCKETS LOCATION '{part['rows']}'")
        rows = self.spark.table(table)
        return (rows if len(part["shards"]) == n_shards else rows.where(F.col("shard").isin(part["shards"]))), part["shards"]

    def load(self, generation: int | None = None) -> Stored:
        """The newest generation, or the one asked for."""
        m = self.manifest(generation)
        if m is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return Stored(m, [self._part(p, m["shards"]) for p in m["parts"]], np.array(m["mean"], dtype=np.int64), {int(k): np.array(b, dtype=np.int64) for k, b in m["books"].items()})

    def build(self, vectors: DataFrame, degree: int = DEGREE, n_shards: int | None = None, mean: np.ndarray | None = None, books: dict[int, np.ndarray] | None = None, **facts: object) -> dict:
        """Train (unless mean and books are given), encode, link and publish: the whole work of an index, once."""
        vectors = stored(vectors.select("vec_id", "vec"), "vectors")
        count = vectors.count()
        n_shards = n_shards or max(1, -(-count // shards.SHARD))
        mean = pq.mean_array(vectors) if mean is None else mean
        books = books or {m: pq.train_codebook(vectors, mean, m) for m in LENGTHS}
        rows = stored(shards.sharded_rows(vectors, pq.encode(vectors, mean, books), n_shards, degree), "index-rows")
        entry = vectors.agg(F.min("vec_id")).first()[0]
        return self.publish(rows, mean, books, n_shards, entry, vectors=count, degree=degree, **facts)


def fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """The files that df reads, with their sizes and times, as one hash. One line per file."""
    files = FileStore(spark)
    seen = [(f, *(files.stat(f)[k] for k in ("size", "modified"))) for f in sorted(df.inputFiles())]
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()[:16]


def open_index(spark: SparkSession, source: DataFrame, vectors: Callable[[], DataFrame], name: str = "all", degree: int = DEGREE, n_shards: int | None = None) -> Stored:
    """The stored index of vectors(), which come from source's files; built by the first who asks, loaded by everyone after."""
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{name}-{fingerprint(spark, source)}-{degree}-{n_shards or 'auto'}")
    if not store.generations():
        store.build(vectors(), degree, n_shards)
    return store.load()
