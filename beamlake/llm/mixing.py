"""Mixing sources to target weights. DataFrame operations only.

Words are counted per source, sources get targets, a target over its source's words is a repetition rate, and each
document is emitted floor(rate) times, plus once more where a number in [0, 1) drawn from the hash of its id and text is
below the rate's fraction. So every document of a source has the same expected share, and a rerun takes the same copies.

Targets: sources in the order of code points, null last, get the weights of a cycle in turn, and share `share` times all
words by weight. No target exceeds `most` times its source's words; what is cut there is shared anew, by weight, among the
others, until none is above. Each of these rounds is one sum over the sources' table; only the sums reach the driver, and
all of it is whole numbers up to the last division. Sources are numbered by a range partitioning, so any number of them will do.

A null text, or one of white space only, has size 0. A null source is a source. Rows that repeat, and rows of one doc_id with
different texts, are documents each; rows alike in id and text are taken alike. A source without words has target 0 and emits
nothing; an empty table gives no rows. Columns of docs keep their names and values, whatever they are called; texts are read whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.llm.common import light, numbered, stored

#: Weights of the sources in their order, repeating; words taken of all words; the highest rate of a source.
CYCLE, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: A word is a run of anything but a blank, tab, line feed, vertical tab, form feed and carriage return.
_SPACE = r"\x20\x09-\x0D"
#: Hexadecimal digits of a hash that make a number in [0, 1).
_HEX = 13


def size_of(text: Column) -> Column:
    """Words of a text: each becomes one character, the white space around them goes, and what is left is counted."""
    marks = F.regexp_replace(text, f"[{_SPACE}]*+[^{_SPACE}]++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{_SPACE}]++", "")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the hash of seed, id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))


def targets(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target and rate (target over size, 0 for a source without words) of every source of docs(source, text)."""
    each = docs.select(docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    weights = F.array(*[F.lit(w) for w in cycle])
    sources = numbered(stored(each, "mix-sources"), order, "mix-sources").select("source", "source_size", F.get(weights, F.pmod("number", F.lit(len(cycle))).cast("int")).alias("weight"))
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    num, den, before = 0, 1, None
    capped = F.lit(False)
    while True:  # a round leaves at least one source more at its limit, or is the last
        r = sources.agg(F.sum(F.when(capped, 1).otherwise(0)).alias("n"), F.sum(F.when(capped, F.col("source_size"))).alias("at_most"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")).first()
        if r["n"] == before:
            break
        before = r["n"]
        num, den = share.numerator * all_words - share.denominator * most * int(r["at_most"] or 0), share.denominator * int(r["weight"] or 0)
        if not den:  # all are at their limits
            break
        capped = F.col("weight").cast("decimal(10,0)") * big(num) > F.col("source_size").cast("decimal(20,0)") * big(most * den)
    limit = F.col("source_size").cast("double") * float(most)
    target = F.least(limit, F.col("weight").cast("double") * float(num) / float(den)) if den else limit
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    return sources.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def planned(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: Fraction = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """row_ (a row of docs), size, source_size, target, and copies: how often the mix takes it."""
    rates = targets(docs, cycle, share, most)
    rates = stored(rates.withColumnRenamed("source", "source_"), "mix-rates")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), size_of(docs["text"]).alias("size"), draw(docs["doc_id"], docs["text"], seed).alias("draw"))
    each = rows.join(light(rates), F.col("row_")["source"].cast("string").eqNullSafe(F.col("source_")))
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return each.select("row_", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: Fraction = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    taken = planned(docs, cycle, share, most, seed).select("row_", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("row_")[c].alias(c) for c in docs.columns])
