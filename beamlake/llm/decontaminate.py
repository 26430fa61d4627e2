"""Benchmark decontamination by size-partitioned MinHash containment, DataFrame operations only.

Items are partitioned by their number n of distinct five-word shingles, in powers of two. The sketch of an
item holds its k smallest shingle hashes, with k = floor((1 - t) * largest n of the partition) + 1: a
document that contains the share t of an item misses at most floor((1 - t) * n) shingles, so at least
k - floor((1 - t) * n) >= 1 of the sketch are found in it, however long the document is. A document's sketch are its
hashes up to the largest in any item's sketch: a sketch of a fixed size would hold none of a short item's hashes in a long
document. A pass over all documents makes it in generated code and probes the items' sketches; the candidates' documents alone
are read again, and the share of the item's shingles that they hold is counted exactly, on the words.

Equal texts are one: hits are aggregated by a 128-bit key of the text before anything else, one row of each is
read again, and the rows of a leaked text are joined by the key at the end, so that a passage or a text that a
third of the rows hold costs a row per task. Long texts are exploded in generated code, a shingle at a time.

Sketches and candidates are broadcast only where a pass over them has shown how many bytes they take; else they
are joined with a shuffle. A word is a run of letters, digits and combining marks, lower case. Null and empty texts
hold nothing; items of fewer than five words have no shingle and never match. Rows that repeat count once; a doc_id
with two texts has the leaks of both. Ties don't arise. Empty tables give no rows. Of docs only doc_id and text are
read, and drop_leaks returns its columns as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.llm.common import NOT_WORD, light, stored, text_key

N_WORDS, THRESHOLD = 5, 0.8


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    """A row per shingle: keep, words and the place i of its first word. Explode runs in generated code."""
    long = df.where(F.size("words") >= N_WORDS)
    return long.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - N_WORDS)).alias("i"))


def _hash() -> Column:
    return F.xxhash64(*[F.col("words")[F.col("i") + k] for k in range(N_WORDS)])


def _string() -> Column:
    return F.concat_ws(" ", *[F.col("words")[F.col("i") + k] for k in range(N_WORDS)])


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, hash, n (distinct shingles) and in_sketch."""
    own = items.select("item_id", _words(F.col("text")).alias("words"))
    s = _positions(own, "item_id").select("item_id", _string().alias("shingle"), _hash().alias("hash")).distinct()
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("hash", "shingle")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    return s.withColumn("k", F.floor((1 - THRESHOLD) * largest + 1e-9).cast("int") + 1).withColumn("in_sketch", F.col("place") <= F.col("k")).drop("place")


def leaked_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key1, key2, item_id, n_shingles, n_found and containment: a row per distinct text and item that it holds."""
    rows = docs.count()
    shingles = stored(item_shingles(items), "items", items.count(), 5_000)
    sketch = shingles.where("in_sketch").select("item_id", "hash", "n", "k")
    bound = sketch.agg(F.max("hash")).first()[0]  # null without items: then no hash passes
    text = ["key1", "key2"]
    texts = docs.select("doc_id", *text_key(F.col("text")), _words(F.col("text")).alias("words"))
    seen = _positions(texts, "doc_id", *text).select("doc_id", *text, _hash().alias("hash")).where(F.col("hash") <= F.lit(bound).cast("long"))
    # Copies of a text fall together here, by partial aggregation; one of their rows stands for all.
    hits = seen.join(light(sketch), "hash").groupBy(*text, "item_id", "hash").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("k").alias("k"))
    enough = F.least("k", "n") - F.floor((1 - THRESHOLD) * F.col("n") + 1e-9)
    found = hits.groupBy(*text, "item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("hits"), F.first("n").alias("n"), F.first("k").alias("k"))
    found = stored(found.where(F.col("hits") >= enough).select(*text, "item_id", "doc_id"), "candidates", rows)
    one = stored(found.groupBy(F.col("key1").alias("k1"), F.col("key2").alias("k2")).agg(F.min("doc_id").alias("id_")), "texts", rows)
    again = docs.select("doc_id", "text", *text_key(F.col("text")))
    again = again.join(light(one), (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
    held = _positions(again.select(*text, _words(F.col("text")).alias("words")), *text).select(*text, _string().alias("shingle"))
    both = held.join(light(shingles.select("item_id", "shingle", "n")), "shingle").groupBy(*text, "item_id", "shingle").agg(F.first("n").alias("n"))
    counted = both.groupBy(*text, "item_id").agg(F.first("n").alias("n_shingles"), F.count("*").alias("n_found"))
    # An item is a candidate of every text that holds enough of it, so that no candidate is joined back.
    return counted.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= THRESHOLD)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every leaked pair, once however often its row repeats."""
    texts = stored(leaked_texts(docs, items), "leaks", docs.count())
    rows = docs.select("doc_id", *text_key(F.col("text"))).join(light(texts), ["key1", "key2"])
    return rows.groupBy("doc_id", "key1", "key2", "item_id").agg(*[F.first(c).alias(c) for c in ("n_shingles", "n_found", "containment")]).drop("key1", "key2")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item."""
    keys = stored(leaked_texts(docs, items).select(F.col("key1").alias("k1"), F.col("key2").alias("k2")).distinct(), "leaks", docs.count())
    k1, k2 = text_key(docs["text"])
    return docs.join(light(keys), (k1 == keys["k1"]) & (k2 == keys["k2"]), "left_anti")
