"""Personal data: base patterns, and bootstrapped contextual extraction. DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns, checked afterwards (octets, Luhn,
numbers of digits). Their texts seed the method, as do strings of the FORMS that keys and digests have. Instances are the tokens with a digit or an at sign; each occurrence
of one is evidence for lexical patterns: the word before it, the two before it, the words on either side, the key before
an equals sign or colon, the word after it where it begins a text, and its own shape (how many digits, which characters,
which length). Pattern and instance form a graph, which is scored in rounds until nothing changes by more than SETTLED:

* a pattern's confidence is the weight of its distinct instances over one more than the distinct tokens of any kind
  that it extracts in the corpus;
* an instance's weight is 1 for a seed, 0 for a token that a refused match of a base pattern covers whole, else KEEP times the
  highest confidence among its patterns, so weight fades with every step from a seed.

Shapes carry weight from seeds to tokens in other contexts, and these to the contexts; they extract nothing themselves.
Patterns of context with a confidence of CONFIDENCE and instances of at least the weight SUPPORT mark all their tokens that have a
form of a key, four digits or more, or an at sign, of kind `other`. So what follows `token =` is found once most of it
are strings of a key's form, or of a shape that most identifiers have; a number or a digest in any other place is left alone.
In a text that holds a found token, every word that is it is marked, and every part of a word that is it, between characters other than
letters, digits and . _ @ + % -. A word that a base span reaches into is left to that, but for one that is a key as a whole.

Offsets are code points, ends exclusive. A null text is empty. Rows that repeat, and texts that repeat, are treated
alike; a doc_id with two texts is two rows. Columns that clash with names used here are left out of spans and kept by
mask. An empty table gives no rows. Every text is read whole. Words carry marks of the base matches that reach into them, so no token
is ever compared with all matches of its text; places are sums over runs of about the square root of their number, and the
patterns don't backtrack: time is close to linear in a text's length, in its matches, and in its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.llm.common import Kept, kept, packed, stored, text_key, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Possessive, and tried only where a run starts or the last match ended: the same matches without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Forms of seeds that are no base spans: digests in hexadecimal, with a letter and a digit; keys with a known prefix; signed tokens.
FORMS = [
    r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"(?:gh[a-z]|glpat|sk|pk|xox[a-z])[-_][A-Za-z0-9_-]{20,}",
    r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
]
_FORM = "^(?:" + "|".join(FORMS) + ")$"
#: What a word must hold to be a token: a digit, an at sign, or the beginning of a key that may have neither.
_TOKEN = r"[0-9@]|(?:AKIA|ASIA)[A-Z]{16}|(?:gh[a-z]|glpat|sk|pk|xox[a-z])[-_][A-Za-z_-]{20}|eyJ[A-Za-z_-]+\."

#: One text in so many is read to give up contexts of which already these hold too many tokens.
PART = 16
SUPPORT, CONFIDENCE, KEEP, SETTLED = 4.0, 0.8, 0.9, 0.01
#: What a confidence may still gain in all rounds after one that moves by SETTLED: each moves by KEEP times the one before at most.
TAIL = SETTLED * KEEP / (1 - KEEP)

_SPAN = "array<struct<kind:int,start:int,end:int,found:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(found))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn(_digits(found))).otherwise(False)


def _refused(kind: str, found: Column) -> Column:
    """Whether a match looks like its kind and still fails its check; a short run of digits is no card at all."""
    if kind == "card":
        return F.length(_digits(found)).between(16, 19) & ~_passes(kind, found)
    return ~_passes(kind, found)


def _let(value: Column, use) -> Column:
    """use(value), where value is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(items: Column) -> Column:
    """An array in consecutive slices, about as many as each has items. Where sums run through an array, each slice's are made first, and
    carried on over the slices, so that no array grows an item at a time to more than the square root of all."""
    n = F.size(items)
    step = F.greatest(F.lit(32), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda c: F.slice(items, c * step + 1, step))
    return F.when(n > 0, cut).otherwise(F.array())


def _pieces(text: Column, pattern: Column | str) -> tuple[Column, Column]:
    """The matches, and what lies before, between and after them."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)


def _matches(text: Column, pattern: Column | str, kind: int) -> Column:
    """array of (kind, start, end, found) of every match."""
    found, between = _pieces(text, pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["found"].alias("found")))

    def placed(runs: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        heads = F.aggregate(runs, none, lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(runs, heads, moved))

    pairs = F.arrays_zip(found.alias("found"), F.slice(between, 1, F.greatest(F.size(found), F.lit(0))).alias("between"))
    return _let(_let(pairs, lambda x: F.transform(_runs(x), lambda run: F.aggregate(run, zero, add))), placed)


def _tried(text: Column, kind: str) -> Column:
    """Whether a text has a match of a kind's pattern."""
    hint = _HINTS[kind]
    return (text.contains(hint) if hint else F.lit(True)) & text.rlike(PATTERNS[kind])


def _all_matches(text: Column) -> Column:
    """Every match of the four patterns, by kind, then start."""
    none = F.array().cast(_SPAN)
    return F.concat(*[F.when(_tried(text, kind), _matches(text, PATTERNS[kind], k)).otherwise(none) for k, kind in enumerate(KINDS)])


#: Before and after what a base span, or a refused match, has of a word. Texts that hold these characters hold others in their place.
_GOOD, _BAD, _END = "\ue000", "\ue001", "\ue002"


def _plain(text: Column) -> Column:
    return F.when(text.rlike(f"[{_GOOD}-{_END}]"), F.translate(text, _GOOD + _BAD + _END, "\ufffd" * 3)).otherwise(text)


def _marked(text: Column, kind: str) -> Column:
    """The text with marks around each part of a word that a span or a refused match of this kind has; null if there are none."""
    found, between = _pieces(text, PATTERNS[kind])

    def mark(f: Column) -> Column:
        put = lambda m: F.regexp_replace(f, "[^ ]+", f"{m}$0{_END}")
        return F.when(_passes(kind, f), put(_GOOD)).when(_refused(kind, f), put(_BAD)).otherwise(f)

    whole = F.array_join(F.zip_with(between, found, lambda b, f: F.concat(b, F.coalesce(mark(f), F.lit("")))), "")
    return F.when(_tried(text, kind), _let(whole, lambda t: F.when(t.rlike(f"[{_GOOD}{_BAD}]"), t)))


def _which(s: Column, test) -> Column:
    out = F.lit(False)
    for k, kind in enumerate(KINDS):
        out = F.when(s["kind"] == k, test(kind, s["found"])).otherwise(out)
    return out


def base_spans(text: Column) -> Column:
    """Base spans by kind, then start."""
    return F.filter(_all_matches(text), lambda s: _which(s, _passes))


def _core(raw: Column) -> Column:
    """A token without what encloses it."""
    return F.regexp_replace(raw, r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")


#: The same words as _words has, in place.
_WORD = r"[^\s=:]++(?::(?![\s\"'])[^\s=:]*+)*+|(?::(?![\s\"'])[^\s=:]*+)++|[=:]"
_PART = r"[A-Za-z0-9](?:[A-Za-z0-9._@+%-]*[A-Za-z0-9])?"


def _words(text: Column) -> Column:
    """Words between white space; an equals sign, and a colon before white space or a quotation mark, is a word `=`."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*+(?:=|:(?=[\s\"']))\s*+", " = "), r"\s+", " ")), " ")


_KEY = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _around(*keep: str) -> list[Column | str]:
    """Word i of w as raw, and its neighbours l1, l2 and r1, null beyond the ends. Plain columns, so that w is carried no further."""
    at = lambda k: F.get("w", F.col("i") + k)
    return [*keep, at(0).alias("raw"), at(-1).alias("l1"), at(-2).alias("l2"), at(1).alias("r1")]


def _moved(words: str, by: int) -> Column:
    """An array's items `by` places further on, null where there are none."""
    n, nulls = F.size(words), F.array(*[F.lit(None).cast("string")] * abs(by))
    return F.slice(F.concat(nulls, words), F.lit(1), n) if by > 0 else F.concat(F.slice(words, F.lit(1 - by), n), nulls)


def _near() -> Column:
    """The word of a context that patterns are looked up by first."""
    return F.when(F.col("l1").isNull(), F.col("r1")).when((F.col("l1") == "=") & F.col("l2").isNotNull(), F.regexp_replace("l2", _KEY, "")).otherwise(F.col("l1"))


def _contexts() -> Column:
    """Patterns of the context of a word: K key, L, LL, LR, or R at the beginning of a text."""
    l1, l2, r1, key = F.col("l1"), F.col("l2"), F.col("r1"), F.regexp_replace("l2", _KEY, "")
    keyed = l1 == "="
    return F.array_compact(
        F.array(
            F.when(keyed & (key != ""), F.concat(F.lit("K "), key)),
            F.when(~keyed, F.concat(F.lit("L "), l1)),
            F.when(~keyed, F.concat(F.lit("LL "), l2, F.lit(" "), l1)),
            F.when(~keyed, F.concat(F.lit("LR "), l1, F.lit(" "), r1)),
            F.when(l1.isNull(), F.concat(F.lit("R "), r1)),
        )
    )


def _shapes(core: Column) -> Column:
    """Patterns of a token's own form: 4, 8 or 16 digits and more; its characters, with the length in powers of two."""
    n = F.length(_digits(core))
    kind = F.when(core.rlike("^[0-9]+$"), "number").when(core.rlike("^[0-9a-fA-F]+$"), "hex").when(core.rlike("^[A-Za-z0-9]+$"), "alnum").when(core.contains("@"), "at").otherwise("mixed")
    steps = [F.when(n >= k, F.lit(f"D {k}")) for k in (4, 8, 16)]
    return F.array_compact(F.array(*steps, F.concat(F.lit("S "), kind, F.lit(" "), F.floor(F.log2(F.length(core))).cast("string"))))


def _any(test) -> Column:
    """Whether test holds for a word as any kind marks it."""
    out = F.lit(False)
    for k in range(len(KINDS)):
        out = out | test(F.col(f"m{k}"))
    return out


def _tokens(docs: DataFrame) -> DataFrame:
    """key1, key2, instance, state (seed 1, seed by its form 2, refused 0, else null) and contexts of every token with a digit, an at sign, or a key's form."""
    t = docs.where(F.col("text").rlike(_TOKEN)).select(*text_key(F.col("text")), _plain(F.col("text")).alias("text"))
    t = t.select("key1", "key2", _words(F.col("text")).alias("w"), *[_marked(F.col("text"), kind).alias(f"t{k}") for k, kind in enumerate(KINDS)])
    t = t.select("key1", "key2", "w", *[F.coalesce(_words(F.col(f"t{k}")), "w").alias(f"m{k}") for k in range(len(KINDS))])
    each = F.arrays_zip(F.col("w").alias("raw"), _moved("w", 1).alias("l1"), _moved("w", 2).alias("l2"), _moved("w", -1).alias("r1"), *[F.col(f"m{k}") for k in range(len(KINDS))])
    t = t.select("key1", "key2", each.alias("x")).select("key1", "key2", F.explode(F.filter("x", lambda x: x["raw"].rlike(_TOKEN))).alias("x")).select("key1", "key2", "x.*")
    t = t.withColumns({c: F.lower(c) for c in ("l1", "l2", "r1")}).withColumn("instance", _core(F.col("raw"))).where(F.col("instance") != "")
    whole = lambda mark: _any(lambda m: m.contains(mark) & F.regexp_extract(m, f"{mark}([^{_END}]*+)", 1).contains(F.col("instance")))
    state = F.when(whole(_GOOD), 1).when(whole(_BAD), 0).when(F.col("instance").rlike(_FORM), 2).when(_any(lambda m: m.contains(_GOOD)), 1)
    return t.select("key1", "key2", "instance", state.alias("state"), _contexts().alias("contexts"))


def _located(docs: DataFrame) -> DataFrame:
    """key1, key2, word (its place), based (whether a base span reaches into it) and candidates of each word of docs(key1, key2, text).

    candidates: (start, end, found, whole) of the word without what encloses it, and of its parts."""
    t = docs.select("key1", "key2", _plain(F.col("text")).alias("text"))
    t = t.select("key1", "key2", "text", *[_marked(F.col("text"), kind).alias(f"t{k}") for k, kind in enumerate(KINDS)])
    words = [F.coalesce(F.regexp_extract_all(F.col(f"t{k}"), F.lit(_WORD), F.lit(0)), F.col("w.found")).alias(f"m{k}") for k in range(len(KINDS))]
    t = t.withColumn("w", _matches(F.col("text"), _WORD, len(KINDS))).select("key1", "key2", "w", *words)
    t = t.select("key1", "key2", F.arrays_zip("w", *[f"m{k}" for k in range(len(KINDS))]).alias("x"))
    t = t.select("key1", "key2", F.explode(F.filter("x", lambda x: x["w"]["found"].rlike(_TOKEN))).alias("x")).select("key1", "key2", "x.*")
    t = t.select("key1", "key2", F.col("w.start").alias("word"), F.col("w.found").alias("raw"), _any(lambda m: m.contains(_GOOD)).alias("based"), _core(F.col("w.found")).alias("core"))
    begin = F.col("word") + F.length(F.regexp_extract("raw", "^[^A-Za-z0-9+]+", 0))
    one = lambda start, found, whole: F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), F.lit(whole).alias("whole"))
    parts = F.transform(_matches(F.col("core"), _PART, len(KINDS)), lambda s: one(begin + s["start"], s["found"], False))
    every = F.concat(F.array(one(begin, F.col("core"), True)), F.when(F.col("core").rlike("[^A-Za-z0-9._@+%-]"), parts).otherwise(F.array()))
    return t.select("key1", "key2", "word", "based", every.alias("candidates"))


def _patterns(counts: DataFrame, rows: int, name: str) -> Kept:
    """counts(pattern, seeds, total) with the confidence and mass of the first round, in which only seeds weigh; `moved` is how far that goes from 0."""
    one = F.least(F.lit(1.0), F.col("seeds").cast("double") / (F.col("total") + 1))
    first = counts.select("pattern", "seeds", "total", one.alias("confidence"), F.col("seeds").cast("double").alias("mass"))
    return kept(first, name, rows, moved=F.max("confidence"))


def _settled(edges: DataFrame, fixed: DataFrame | Kept) -> DataFrame:
    """pattern, seeds, total, confidence and mass (the weight of its instances).

    edges(pattern, instance): of open instances. fixed(pattern, seeds, total), or what _patterns makes of it. A round is one job, which also tells how far it has moved."""
    state = first = fixed if isinstance(fixed, Kept) else _patterns(fixed, None, "pii-confidence")
    while (state.more["moved"] or 0.0) > SETTLED:  # each round moves by KEEP times the one before at most
        now = state.table
        weight = edges.join(state.light(now.select("pattern", "confidence")), "pattern").groupBy("instance").agg((KEEP * F.max("confidence")).alias("weight"))
        open_ = edges.join(weight.where("weight > 0"), "instance").groupBy("pattern").agg(F.sum("weight").alias("open"))
        score = (F.col("seeds") + F.coalesce("open", F.lit(0.0))).alias("mass")
        new = now.select("pattern", "seeds", "total", F.col("confidence").alias("before")).join(open_, "pattern", "left").select("pattern", "seeds", "total", "before", score)
        new = new.select("pattern", "seeds", "total", F.least(F.lit(1.0), F.col("mass") / (F.col("total") + 1)).alias("confidence"), "mass", "before")
        state = kept(new, "pii-confidence", first.rows, moved=F.max(F.abs(F.col("confidence") - F.col("before"))))
    return state.table.select("pattern", "seeds", "total", "confidence", "mass")


def _totals(docs: DataFrame, contexts: Kept) -> DataFrame:
    """pattern and all, the number of distinct tokens of any kind in its context, of contexts(pattern)."""
    p, patterns = F.split("pattern", " "), contexts.table.select("pattern")
    nears = kept(patterns.select(F.when(p[0] == "LL", p[2]).otherwise(p[1]).alias("near")).distinct(), "pii-near", contexts.rows)
    w = docs.where(F.col("text").isNotNull()).select(_words(F.lower("text")).alias("w")).select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    each = w.select(*_around()).withColumn("near", _near()).join(nears.light(), "near", "left_semi")
    every = each.select("raw", F.explode(_contexts()).alias("pattern")).join(contexts.light(patterns), "pattern", "left_semi")
    return every.select("pattern", _core(F.col("raw")).alias("core")).distinct().groupBy("pattern").agg(F.count("*").alias("all"))


def bootstrap(docs: DataFrame, tokens: Kept) -> DataFrame:
    """pattern, confidence and mass of the contexts that may extract, from tokens(instance, state, contexts)."""
    rows = tokens.rows
    each = tokens.table.select(F.lower("instance").alias("instance"), "state", F.explode(F.concat("contexts", _shapes(F.col("instance")))).alias("pattern"))
    graph = stored(each.groupBy("pattern", "instance").agg(F.max("state").alias("state")), "pii-graph", 8 * rows, 100_000)
    count = graph.groupBy("pattern").agg(F.sum(F.when(F.col("state") > 0, 1).otherwise(0)).alias("seeds"), F.count("*").alias("total"))
    fixed = _patterns(count.where(F.col("total") >= SUPPORT), rows, "pii-patterns")  # no other can gain the mass
    edges = stored(graph.where("state is null").select("pattern", "instance").join(fixed.light(fixed.table.select("pattern")), "pattern", "left_semi"), "pii-edges", 8 * rows, 100_000)
    shape = F.col("pattern").rlike("^[DS] ")
    good = (F.col("confidence") >= CONFIDENCE) & (F.col("mass") >= SUPPORT) & ~shape
    may = (F.col("confidence") + TAIL >= CONFIDENCE) & (F.col("mass") + TAIL * F.col("total") >= SUPPORT) & ~shape
    hopeful = kept(_settled(edges, fixed).where(may), "pii-hopeful", fixed.rows)
    # So far only tokens with a digit or an at sign counted. A part of the texts bounds the number of all others from
    # below, which is enough to give up contexts such as those of common words; the rest is counted over all texts.
    least = _totals(docs.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), hopeful)
    able = F.coalesce("all", F.lit(0)) * CONFIDENCE <= F.col("mass") + TAIL * F.col("total")
    hopeful = kept(hopeful.table.join(least, "pattern", "left").where(able).select("pattern"), "pii-hopeful", hopeful.rows)
    if not hopeful.rows:
        return hopeful.table.select("pattern", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("mass"))
    totals, counts = _totals(docs, hopeful), fixed.table.select("pattern", "seeds", "total")
    exact = counts.where(shape).unionByName(counts.join(hopeful.table, "pattern", "left_semi").join(totals, "pattern").select("pattern", "seeds", F.greatest("total", "all").alias("total")))
    exact = _patterns(exact, fixed.rows, "pii-exact")
    edges = stored(edges.join(exact.light(exact.table.select("pattern")), "pattern", "left_semi"), "pii-edges", 8 * rows, 100_000)
    return _settled(edges, exact).where(good).select("pattern", "confidence", "mass")


def spans(docs: DataFrame) -> DataFrame:
    """docs with base and more: arrays of (kind, start, end, found); more holds what the method adds, of kind 4."""
    cols = [c for c in docs.columns if c not in ("base", "more", "key1", "key2")]
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(*cols)
    tokens = kept(_tokens(read.select("text")), "pii-tokens", weigh=False)
    chosen = kept(bootstrap(read, tokens).select("pattern"), "pii-chosen", tokens.rows)
    out = read.withColumn("base", base_spans(text))
    none = F.array().cast(_SPAN)
    form = F.col("state") == 2
    open_ = tokens.table.where("state is null or state = 2").where(form | (F.length(_digits(F.col("instance"))) >= 4) | F.col("instance").contains("@"))
    new = open_.select("key1", "key2", "instance", F.coalesce(form, F.lit(False)).alias("form"), F.explode("contexts").alias("pattern")).join(chosen.light(), "pattern", "left_semi")
    found = kept(new.groupBy("key1", "key2", F.col("instance").alias("found")).agg(F.max("form").alias("form")), "pii-found", tokens.rows)
    if not found.rows:
        return out.withColumn("more", none)
    keys = ["key1", "key2"]
    keyed = lambda df: df.withColumns(dict(zip(keys, text_key(F.col("text")), strict=True)))
    texts = keyed(read.select("text")).join(found.light(found.table.select(*keys).distinct()), keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"))
    each = _located(texts).select(*keys, "word", "based", F.explode("candidates").alias("c")).select(*keys, "word", "based", "c.*")
    hits = each.join(found.light(), [*keys, "found"]).where(~F.col("based") | (F.col("whole") & F.col("form")))
    span = F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end", "found")
    # Of a word the whole, or else its parts; of a text as many as it has.
    per = hits.groupBy(*keys, "word").agg(F.max("whole").alias("any"), F.collect_list(F.struct("whole", span.alias("s"))).alias("c"))
    per = per.select(*keys, F.transform(F.filter("c", lambda x: x["whole"] == F.col("any")), lambda x: x["s"]).alias("c")).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("more"))
    per = kept(per, "pii-placed", tokens.rows)
    return keyed(out).join(per.light(), keys, "left").drop(*keys).withColumn("more", F.coalesce(F.col("more").cast(_SPAN), none))


def _named(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "other")])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the hash of all base spans, and all spans."""
    s = spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.concat("base", "more")).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; n_chars, where there is one, follows."""
    s = spans(packed(docs).withColumn("doc_id", F.col("row_")["doc_id"]))
    every = F.array_sort(F.concat("base", "more"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, "other")])
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    empty = F.array().cast("array<string>")

    def run(a: Column, spans_: Column) -> Column:  # the text of a run of spans is cut out once, and their masks put into that
        last = F.greatest(a["at"], F.array_max(F.transform(spans_, lambda x: x["end"])))

        def put(part: Column) -> Column:
            def one(b: Column, x: Column) -> Column:  # a span inside one that is masked already adds nothing
                before = F.substring(part, b["at"] - a["at"] + 1, x["start"] - b["at"])
                return F.when(x["start"] >= b["at"], state(x["end"], F.concat(b["out"], F.array(before, names[x["kind"]])))).otherwise(state(F.greatest(b["at"], x["end"]), b["out"]))

            return F.aggregate(spans_, state(a["at"], empty), one, lambda b: state(b["at"], F.concat(a["out"], F.array(F.array_join(b["out"], "")))))

        return _let(F.substring(F.col("text"), a["at"] + 1, last - a["at"]), put)

    s = s.withColumn("runs_", _let(every, _runs))
    masked = F.aggregate("runs_", state(F.lit(0), empty), run, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.size(F.concat("base", "more")) > 0, masked).otherwise(F.col("text"))
    s = s.withColumn("masked_", text)  # a step of its own: a new text must not be read in place of the old one
    changed = {"text": F.col("masked_")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(F.concat("base", "more")) > 0, F.length("masked_").cast("long")).otherwise(F.col("row_")["n_chars"])
    return unpacked(s, docs.columns, **changed)
