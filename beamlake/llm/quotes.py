"""Quotation linking for conversations, DataFrame operations only.

A message's lines are grouped into passages of equal quote level (the number of leading `>`). Level 0 is
its own text. Quoted passages, and their lines of MIN_LINE characters or more, are normalised and hashed, and joined to
the hashes of the own texts, passages and lines of all messages. Of the originals of a hash the earliest in the same
conversation is taken if it comes before the quoting message, else the earliest of all conversations with a smaller
conv_id; both are minima per hash, made with partial aggregation, so a text that a third of the messages share is one row.

A message replies to the original of its longest linked passage of the lowest level, else to the turn
before it (turn - 1) in its conversation, else to none. A conversation whose first message replies to
another conversation continues its thread. build() puts the messages of each thread in reply order, conversation by
conversation and turn by turn: a message always comes after the one it replies to. The order is a range
partitioning of all messages, so a thread of any length is dealt over as many tasks as it fills, and place numbers
are completed by sums over tasks.

Own texts are without quotes, and without the line that introduces one (`On Monday Bob wrote:`) directly before it. Rows
with a null conv_id or turn link to nothing. A null text is empty, repeated rows stay (in an arbitrary order among
themselves), texts of any length are parsed whole, and an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.llm.common import drop_stored, light, stored

#: Shortest normalised line, in characters, that links on its own.
MIN_LINE = 20
_MARK = r"^[ \t]*+(?:>[ \t]?)++"
# Verbs that introduce a quotation.
_ATTRIBUTION = r"(?i)(?:^|\n)[^\n]*\b(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:\s*$"
_EMPTY = "array<struct<level:int,text:string>>"


def passages(text: Column) -> Column:
    """array of (level, text): runs of lines of one quote level, marks removed, in order."""
    lines = F.split(text, r"\r?\n", -1)
    level = lambda s: F.length(F.regexp_replace(F.regexp_extract(s, _MARK, 0), "[^>]", ""))
    parsed = F.transform(lines, lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, _MARK, "").alias("text")))

    def runs(p: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(p))
        first = F.filter(places, lambda i: (i == 1) | (F.element_at(p, i)["level"] != F.element_at(p, F.greatest(i - 1, F.lit(1)))["level"]))
        ends = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(p) + 1))
        pairs = F.arrays_zip(first.alias("a"), ends.alias("b"))
        return F.transform(
            pairs,
            lambda x: F.struct(F.element_at(p, x["a"])["level"].alias("level"), F.array_join(F.transform(F.slice(p, x["a"], x["b"] - x["a"]), lambda y: y["text"]), "\n").alias("text")),
        )

    one = F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))).cast(_EMPTY)
    # aggregate binds the parsed lines once, so that they aren't parsed again for each use
    bound = F.aggregate(F.array(parsed), F.array().cast(_EMPTY), lambda a, p: runs(p).cast(_EMPTY))
    return F.when(text.rlike(r"(?m)^[ \t]*+>"), bound).otherwise(one)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def _keys(text: Column) -> Column:
    """Hashes with lengths: of a whole passage, and of each of its lines that is long enough."""
    whole = F.array(normal(text))
    own = F.filter(F.transform(F.split(text, r"\r?\n", -1), normal), lambda s: F.length(s) >= MIN_LINE)
    every = F.filter(F.array_distinct(F.concat(whole, own)), lambda s: s != "")
    return F.transform(every, lambda s: F.struct(F.md5(s).alias("hash"), F.length(s).alias("size")))


def _own(p: Column) -> Column:
    """The passages of level 0, without the line that introduces the quotation after it."""
    before = lambda i: F.coalesce(F.get(p, i + 1)["level"] > 0, F.lit(False))
    cut = F.transform(p, lambda x, i: F.struct(x["level"].alias("level"), F.when(before(i), F.regexp_replace(x["text"], _ATTRIBUTION, "")).otherwise(x["text"]).alias("text")))
    text = F.array_join(F.transform(F.filter(cut, lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _parents(parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv_id, turn, to_conv, to_turn and n_linked of each message with a linked passage."""
    q = quoted.select("conv_id", "turn", F.posexplode("quotes").alias("nth", "quote"))
    q = q.select("conv_id", "turn", "nth", F.col("quote.level").alias("level"), F.explode(_keys(F.col("quote.text"))).alias("k"))
    q = stored(q.select("conv_id", "turn", "nth", "level", F.col("k.hash").alias("hash"), F.col("k.size").alias("size")), "quotes")
    texts = F.array_distinct(F.concat(F.array("own"), F.transform(F.filter("parts", lambda x: x["level"] == 0), lambda x: x["text"])))
    o = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(F.flatten(F.transform(texts, _keys))).alias("k"))
    o = o.select("conv_id", "turn", F.col("k.hash").alias("hash")).join(q.select("hash").distinct(), "hash", "left_semi")
    near = stored(o.groupBy("hash", "conv_id").agg(F.min("turn").alias("near")), "originals")
    far = near.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("far"))
    m = q.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    here = F.col("near") < F.col("turn")
    there = F.col("far.conv_id") < F.col("conv_id")
    m = m.withColumn("to", F.when(here, F.struct("conv_id", F.col("near").alias("turn"))).when(there, F.col("far"))).where("to is not null")
    best = F.struct((-F.col("level")).alias("l"), "size", here.cast("int").alias("here"), (-F.col("to.conv_id")).alias("c"), (-F.col("to.turn")).alias("t"))
    g = m.groupBy("conv_id", "turn").agg(F.max_by("to", best).alias("to"), F.count_distinct("nth").alias("n_linked"))
    return g.select("conv_id", "turn", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"), "n_linked")


def _threads(parents: DataFrame, firsts: DataFrame) -> DataFrame:
    """conv_id and thread_id of the conversations that continue another, by pointer doubling.

    A conversation points to an earlier one only (a smaller conv_id), so there are no circles."""
    start = parents.join(firsts, ["conv_id", "turn"], "left_semi").where("to_conv <> conv_id")
    state = stored(start.groupBy("conv_id").agg(F.min("to_conv").alias("thread_id")), "threads")
    while True:
        up = state.select(F.col("conv_id").alias("thread_id"), F.col("thread_id").alias("above"))
        step = stored(state.join(up, "thread_id", "left"), "threads")
        moved = step.where("above is not null").limit(1).count()
        new = step.select("conv_id", F.coalesce("above", "thread_id").alias("thread_id"))
        if not moved:
            return new
        drop_stored(state)
        state = new


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, thread_id, parent_conv, parent_turn, n_quotes, n_linked and text (without quotes)."""
    parsed = conversations.select("conv_id", "turn", "role", passages(F.coalesce(F.col("text"), F.lit(""))).alias("parts"))
    parsed = parsed.withColumn("own", _own(F.col("parts"))).withColumn("quotes", F.filter("parts", lambda x: (x["level"] > 0) & (normal(x["text"]) != "")))
    quoted = parsed.where((F.size("quotes") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    out = parsed.select("conv_id", "turn", "role", F.size("quotes").cast("long").alias("n_quotes"), F.col("own").alias("text"))
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", F.col("turn").alias("before")).distinct()
    out = out.join(turns.select("conv_id", (F.col("before") + 1).alias("turn"), "before"), ["conv_id", "turn"], "left")
    parents = stored(_parents(parsed, quoted), "parents")
    if parents.limit(1).count() == 0:
        none = F.lit(None).cast("long")
        out = out.withColumns({"to_conv": none, "to_turn": none, "n_linked": none, "above": none})
    else:
        firsts = turns.groupBy("conv_id").agg(F.min("before").alias("turn"))
        threads = _threads(parents, firsts).withColumnRenamed("thread_id", "above")
        out = out.join(parents, ["conv_id", "turn"], "left").join(threads, "conv_id", "left")
    linked = F.col("to_conv").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("above", "conv_id").alias("thread_id"),
        F.when(linked, F.col("to_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(linked, F.col("to_turn")).otherwise(F.col("before")).alias("parent_turn"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "text",
    )


def build(conversations: DataFrame) -> DataFrame:
    """The columns of link() and place (from 0), a message's place in its thread, sorted by thread_id and place."""
    order = ["thread_id", "conv_id", "turn"]
    # One file per range of the order; the number says which, and the row's place there.
    ranges = stored(link(conversations).orderBy(*order).withColumn("number", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("number", 33).alias("part")
    runs = ranges.groupBy("thread_id", part).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("thread_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.select(F.col("thread_id").alias("thread_"), "part", "first", F.coalesce(ahead, F.lit(0)).alias("ahead")), "runs")
    put = ranges.join(light(runs), F.col("thread_id").eqNullSafe(F.col("thread_")) & (F.shiftright("number", 33) == F.col("part")))
    return put.withColumn("place", F.col("number") - F.col("first") + F.col("ahead")).drop("number", "thread_", "part", "first", "ahead")
