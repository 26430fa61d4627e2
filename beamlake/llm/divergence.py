"""Divergence of the sources of a language: which differ, how much, and by which terms. In whole numbers throughout.

Terms are counted once per (lang, source, term), with the documents that hold them, first by each task over the rows it reads, then
by sums before and after the shuffle. Those of a language that LEAST of its documents hold are kept, and each becomes one row with a wide vector: its counts by
source, in the order of the language's sources. Higher-order functions turn the vector into smoothed frequencies in billionths, emit
the absolute difference of every two sources as one row each, and sums begin before the shuffle again, so what moves is a row
per task and pair of sources. Terms that are more frequent in a source than in its language are ranked by a window whose limit is applied
before its shuffle.

A frequency is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), with N the occurrences of all V kept terms there.
Null text, lang and source are read as the empty string. Every (lang, source) that occurs is a group, with words or without;
a language without kept terms has pairs of value 0. Rows that repeat are documents each. Ties rank by the smaller item, in the
order of UTF-8 bytes. An empty table gives no rows; other columns are not read, and texts are read whole.

The vectors of a language have an entry per source, and pairs are as many as the result has by its contract: half the square of that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.llm.common import light, stored

#: A term is a run of ASCII letters and of anything beyond ASCII; only A to Z are lower-cased.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Documents of a language that hold a kept term at least; terms per source that are returned.
LEAST, TERMS = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Characters of a text whose terms are listed at a time; counts that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 400_000


def terms_of(text: str) -> Iterator[list[str]]:
    """The terms of a text, in lists; a long text is read in pieces that end between terms."""
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    at = 0
    while at < len(text):
        end = _BETWEEN.search(text, at + PIECE)
        to = end.start() if end else len(text)
        yield TERM.findall(text, at, to)
        at = to


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and n_docs, of docs(lang, source, text).

    A task adds up what its rows hold and passes on at most about HELD counts at a time, which are summed before and after the shuffle."""

    def batch(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, in_docs) in held.items():
            n = len(terms)
            same = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)]
            cols = [*same, pa.array(terms.keys(), pa.string()), pa.array(terms.values(), pa.int64()), pa.array(map(in_docs.__getitem__, terms), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for lang, source, text in zip(*(b.column(i).slice(at, 256).to_pylist() for i in range(3)), strict=True):
                    terms, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(terms)
                    own: set[str] = set()
                    for some in terms_of(text):
                        terms.update(some)
                        own.update(some)
                    in_docs.update(own)
                    size += len(terms)
                    if size >= HELD:
                        yield from batch(held)
                        held, size = {}, 0
            del b
        yield from batch(held)

    each = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _frequency(count: Column, total: Column, kept: Column) -> Column:
    exact = lambda c: c.cast("decimal(19,0)")
    over = exact(total) + exact(kept) * F.lit(SMOOTH).cast("decimal(2,0)")
    return 1 + F.call_function("div", (exact(count) + F.lit(SMOOTH).cast("decimal(2,0)")) * F.lit(SCALE).cast("decimal(10,0)"), over)


def vectors(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """langs(lang, sources, kept, totals, total) and terms(lang, term, counts, p, q) of docs(lang, source, text).

    sources and totals are arrays in the order of the sources; counts and p have an entry for each of them, q is the language's."""
    sources = docs.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    sources = stored(sources, "divergence-sources")
    each = stored(counts(docs), "divergence-counts")
    wide = each.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by")).where(F.col("n_docs") >= least)  # an entry per source
    wide = wide.join(light(sources), "lang").select("lang", "term", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0).cast("long"))).alias("counts"))
    wide = stored(wide, "divergence-terms")
    sums = wide.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("totals"), F.max("kept").alias("kept"))  # an entry per source
    zeros = F.transform("sources", lambda s: F.lit(0).cast("long"))
    langs = sources.join(sums, "lang", "left").select("lang", "sources", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("totals", zeros).alias("totals"))
    langs = stored(langs.withColumn("total", F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x)), "divergence-langs")
    each = wide.join(light(langs.select("lang", "kept", "totals", "total")), "lang")
    p = F.zip_with("counts", "totals", lambda n, total: _frequency(n, total, F.col("kept")))
    q = _frequency(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.col("total"), F.col("kept"))
    return langs, stored(each.select("lang", "term", "counts", p.alias("p"), q.alias("q")), "divergence-vectors")


def _two(n: Column, value) -> Column:
    """value(i, j) for all i < j < n, as one array."""
    inner = lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: value(i, j))
    return F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), inner)))


def pairs(langs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item and value: of every two sources of a language, either way round, the sum of their terms' differences."""
    gap = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.abs(F.col("p")[i] - F.col("p")[j]).alias("f"))
    each = terms.select("lang", F.explode(_two(F.size("p"), gap)).alias("g")).select("lang", "g.i", "g.j", "g.f")
    sums = each.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    ends = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    all_ = langs.select("lang", "sources", F.explode(_two(F.size("sources"), ends)).alias("e")).select("lang", "sources", "e.i", "e.j")
    out = all_.join(sums, ["lang", "i", "j"], "left").select("lang", "sources", F.explode(both).alias("x"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return out.select("lang", F.col("sources")[F.col("x.a")].alias("source"), F.col("sources")[F.col("x.b")].alias("item"), "value")


def leading(langs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item and value: the terms that a source holds and has more often than its language."""
    each = terms.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("i", "x")).where((F.col("x.counts") > 0) & (F.col("x.p") > F.col("q")))
    each = each.join(light(langs.select("lang", "sources")), "lang")
    return each.select("lang", F.col("sources")[F.col("i")].alias("source"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, most: int = TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language, and by which terms it leads."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    langs, terms = vectors(docs.select(text("lang"), text("source"), text("text")), least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    one = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return one(pairs(langs, terms), "pair").unionByName(one(leading(langs, terms), "term").where(F.col("rank") <= most))
