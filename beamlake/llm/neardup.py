"""Near-duplicates by ProbMinHash over weighted word shingles, banding, and exact verification.

Shingles are five words (all words of a shorter text), weighted 1 + ln(count). Each shingle is a Poisson
process with its weight as rate; its arrivals fall on random components of the signature, and a component
keeps the shingle that arrived first. Arrivals are made in order, and a shingle stops at the first that
comes later than every component's earliest (early termination). Two signatures agree in a component
with the probability Jaccard of the texts. BANDS bands of ROWS components find 99.8 % of the pairs at 0.8.

Equal texts (same words in the same order, by 128 bits of a cryptographic hash) are first reduced to one representative, with partial
aggregation, so groups of copies of any size cost one row. Pairs of representatives in a small bucket are
all verified; in a bucket of more than SMALL texts each text is verified against the bucket's hub, the one
that shares most buckets, which is how copies hang together; whatever is then still in different
components is verified in pairs (but for pairs that shingles found in no other of these texts rule out), in blocks of
BLOCK by BLOCK texts. One shared bucket is enough, whatever its size: no switch or cap leaves a pair out. Only pairs that
are in one class already are not made again, so a class has links enough to connect it and not all it could have.

A link is a Jaccard of at least THRESHOLD between the sets of shingles, counted exactly on 64-bit hashes; the weights
only steer the sketch. Where no shingle repeats, both similarities are the same; the tests measure that at least 0.99 of
the pairs at 0.8 and more share a bucket.

A document without words, or with a null doc_id, is a class of its own. Texts of any length are sketched whole. Rows
that repeat a doc_id with the same words are one document; a doc_id with several texts is a document for each.
Classes are named by their smallest doc_id. Other columns are not read, and deduplicate returns the columns of docs,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.llm.common import WORD, in_slices, light, stored, text_key
from beamlake.llm.components import components

N_WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 7, 26
M = ROWS * BANDS
#: Texts of a bucket up to which all its pairs are verified.
SMALL = 24
#: Texts of a large bucket that one task compares with as many others.
BLOCK = 256
#: Characters of text that are sketched together.
CHUNK = 400_000

_U = np.uint64
#: Words whose hashes a worker remembers.
REMEMBERED = 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64 bits of each word, remembered while it comes up again."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_HASHES = _WordHashes()


def normal(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    return WORD.findall(text.lower()) if text else []


def word_key(words: list[str]) -> str:
    """128 bits of a cryptographic hash, equal for equal words only."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).hexdigest()


def shingle_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Over all texts: the hash of each shingle, and its text's number.

    A shingle's hash mixes in its words' hashes one after the other, so it has no structure that texts could share by chance."""
    words = np.array([len(t) for t in texts], dtype=np.int64)
    h = np.fromiter((_HASHES[w] for t in texts for w in t), dtype=_U, count=int(words.sum()))
    of = np.repeat(np.arange(len(texts)), words)
    start = np.concatenate([[0], np.cumsum(words)])[:-1]
    place = np.arange(len(h)) - start[of]
    take = np.minimum(N_WORDS, words)[of]
    at = np.flatnonzero(place + take <= words[of])
    take, s = take[at], h[at]
    with np.errstate(over="ignore"):
        for k in range(1, N_WORDS):
            more = np.flatnonzero(take > k)
            s[more] = _mix(s[more] * _U(0x9E3779B97F4A7C15) + h[at[more] + k])
        return _mix(s + take.astype(_U)), of[at]


def _unique(shingles: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, ordered by text, then shingle."""
    order = np.lexsort((shingles, of))
    s, o = shingles[order], of[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])]) if len(s) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return s[at], o[at], np.diff(np.append(at, len(s)))


def signatures(shingles: np.ndarray, of: np.ndarray, counts: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts x M shingle hashes: for each component the shingle whose process reaches it first."""
    earliest = np.full(n_texts * M, np.inf)
    winner = np.zeros(n_texts * M, dtype=_U)
    own = np.bincount(of, minlength=n_texts)
    mean_gap = 1 / (1 + np.log(counts))
    # So many arrivals at first that most components of a text are reached; then one more at a time.
    repeats = np.ceil(M * np.log(M) / np.maximum(own, 1)).astype(np.int64)[of]
    element, clock = np.arange(len(of)), np.zeros(len(of))
    step = np.zeros(len(of), dtype=np.int64)
    while len(element):
        e = np.repeat(element, repeats)
        heads = np.concatenate([[0], np.cumsum(repeats)])[:-1]
        nth = np.arange(len(e)) - np.repeat(heads, repeats) + np.repeat(step, repeats)
        with np.errstate(over="ignore"):
            x = _mix(shingles[e] + (nth.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((x >> _U(32)).astype(np.float64) + 0.5) / 2**32) * mean_gap[e]
        total = np.cumsum(gap)
        before = np.repeat(total[heads] - gap[heads], repeats)
        time = np.repeat(clock, repeats) + (total - before)
        slot = of[e] * M + ((x & _U(0xFFFFFFFF)) * _U(M) >> _U(32)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        winner[slot[won]] = shingles[e[won]]
        last = earliest.reshape(n_texts, M).max(axis=1)
        ends = heads + repeats - 1
        alive = time[ends] < last[of[element]]
        element, clock, step = element[alive], time[ends][alive], (step + repeats)[alive]
        repeats = np.ones(len(element), dtype=np.int64)
    return winner.reshape(n_texts, M)


def bands(signature: np.ndarray) -> np.ndarray:
    """BANDS hashes of each signature; a band's number is part of its hash."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(signature), BANDS)).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            h = _mix(h * _U(0x100000001B3) + parts[:, :, i])
    return h.view(np.int64)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    at, part, size = 0, [], 0
    for i, t in enumerate(t for some in in_slices(texts) for t in some):
        part.append(normal(t))
        size += len(t or "")
        if size > CHUNK or len(part) >= 1024:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key1 and key2 of the text, word_key (equal for equal words), n (distinct shingles) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _chunks(b.column(3)):
                s, o, k = _unique(*shingle_hashes(part))
                n = np.bincount(o, minlength=len(part))
                h = bands(signatures(s, o, k, len(part)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(part) + 1) * BANDS, BANDS), pa.int32()), pa.array(h.ravel()))
                own = [b.column(i).slice(at, len(part)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(map(word_key, part), pa.string()), pa.array(n, pa.int64()), flat], names=["doc_id", "key1", "key2", "word_key", "n", "bands"])
            del b  # not held while the next one arrives

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
    return rows.mapInArrow(run, "doc_id long, key1 long, key2 long, word_key string, n long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """rep and the distinct shingle hashes of the rows of docs(rep, word_key, text) whose text has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _chunks(b.column(2)):
                s, o, _ = _unique(*shingle_hashes(part))
                edges = np.searchsorted(o, np.arange(len(part) + 1))
                sets = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(s.view(np.int64)))
                same = pc.equal(pa.array(map(word_key, part), pa.string()), b.column(1).slice(at, len(part)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), sets], names=["rep", "shingles"]).filter(same)
            del b  # not held while the next one arrives

    return docs.select("rep", "word_key", "text").mapInArrow(run, "rep long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard of THRESHOLD, in generated code."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return both.select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= THRESHOLD)


def _near_size(a: str, b: str) -> F.Column:
    """Sizes that a Jaccard of THRESHOLD allows."""
    return F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _pairs(x: DataFrame) -> DataFrame:
    """All pairs of x(bucket, rep, n) within a bucket."""
    l, r = x.select("bucket", F.col("rep").alias("a"), F.col("n").alias("n1")), x.select("bucket", F.col("rep").alias("b"), F.col("n").alias("n2"))
    return l.join(r, "bucket").where((F.col("a") < F.col("b")) & _near_size("n1", "n2")).select("a", "b").distinct()


def _alone(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """rep and alone, its shingles that no other of ids holds, where there are any. Two counts, no join.

    What two texts share is at most what either has in common with any other, so this bounds the Jaccard of all
    pairs of a text at once: those that cannot reach THRESHOLD are never made."""

    each = sets.join(ids, "rep", "left_semi").select("rep", F.explode("shingles").alias("shingle"))
    single = each.groupBy("shingle").agg(F.count("*").alias("holders"), F.first("rep").alias("rep")).where("holders = 1")
    return single.groupBy("rep").agg(F.count("*").alias("alone"))


def _possible(n1: str, held1: str, n2: str, held2: str) -> F.Column:
    """Whether two texts of n shingles, `held` of which others hold too, can have a Jaccard of THRESHOLD."""
    both = F.least(held1, held2)
    return both >= THRESHOLD * (F.col(n1) + F.col(n2) - both) - 1e-9


def _apart(rest: DataFrame) -> DataFrame:
    """Pairs of rest(bucket, blocks, rep, n, held, root) in different components that share its bucket.

    A bucket's texts are dealt to blocks, and each pair of blocks is a key of its own, so no bucket, however large,
    meets in one task. A pair that shares several buckets is made once: at the smallest."""
    of = rest.groupBy("rep").agg(F.collect_set("bucket").alias("large"))  # at most BANDS
    each = rest.join(of, "rep").withColumn("own", F.pmod(F.hash("rep"), F.col("blocks")))
    names = ["rep", "n", "held", "root", "large"]
    # The first block of a pair is the smaller; each text is on either side as often as it takes.
    l = each.select("bucket", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *[F.col(c).alias(f"{c}1") for c in names])
    r = each.select("bucket", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *[F.col(c).alias(f"{c}2") for c in names])
    able = (F.col("root1") != F.col("root2")) & ((F.col("i") < F.col("j")) | (F.col("rep1") < F.col("rep2"))) & _possible("n1", "held1", "n2", "held2")
    once = F.col("bucket") == F.array_min(F.array_intersect("large1", "large2"))
    return l.join(r, ["bucket", "i", "j"]).where(able & once).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def _with_roots(x: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return x.join(roots, x["rep"] == roots["node"], "left").select(*x.columns, F.coalesce("root", "rep").alias("root"))


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, similarity: verified links that connect all representatives found similar.

    reps(rep, doc_id, word_key, n, bands): rep names a distinct text, doc_id a row of docs that has it."""
    count = reps.count()
    each = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(each.join(sizes, "bucket"), "buckets", BANDS * count, 200_000)
    ids = stored(reps.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("doc_id").alias("id_"), "word_key"), "shared-ids", count)
    texts = docs.select("doc_id", "text").join(light(ids), F.col("doc_id") == F.col("id_"))
    sets = stored(shingle_sets(texts).groupBy("rep").agg(F.first("shingles").alias("shingles")), "shingles", count)
    large = shared.where(F.col("size") > SMALL)
    alone = stored(_alone(large.select("rep").distinct(), sets), "alone", count)
    large = large.join(light(alone), "rep", "left").withColumn("held", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    large = stored(large.where(F.col("held") >= THRESHOLD * F.col("n") - 1e-9), "large", BANDS * count, 200_000)
    weight = large.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = large.join(weight, "rep")
    hub = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("n").alias("hub_n"), F.col("held").alias("hub_held"))).alias("h"))
    hub = hub.select("bucket", (-F.col("h.minus")).alias("hub"), F.col("h.hub_n").alias("hub_n"), F.col("h.hub_held").alias("hub_held"))
    to_hub = weighed.join(hub, "bucket").where((F.col("rep") != F.col("hub")) & _near_size("n", "hub_n") & _possible("n", "held", "hub_n", "hub_held"))
    to_hub = to_hub.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    found = stored(_verified(_pairs(shared.where(F.col("size") <= SMALL)).unionByName(to_hub).distinct(), sets), "links", count, 5_000)
    # What large buckets still hold in different components.
    rest = _with_roots(large.select("bucket", "rep", "n", "held"), found)
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    split = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks).where("lo < hi").select("bucket", "blocks")
    rest = stored(rest.join(split, "bucket"), "apart", BANDS * count, 200_000)
    if rest.limit(1).count():
        found = found.unionByName(stored(_verified(_apart(rest), sets), "links", count, 5_000))
    return found


def representatives(own: DataFrame) -> DataFrame:
    """rep, doc_id, word_key, n and bands of each distinct text of sketches. rep is its smallest doc_id, unless an
    earlier text of that doc_id has it; then, which is rare, it is a hash."""
    reps = own.groupBy("word_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = own.count()
    reps = stored(reps, "representatives", rows)
    several = stored(reps.groupBy(F.col("doc_id").alias("id_")).agg(F.min("word_key").alias("first"), F.count("*").alias("texts")).where("texts > 1").drop("texts"), "several", rows)
    if several.limit(1).count() == 0:
        return reps.select(F.col("doc_id").alias("rep"), "doc_id", "word_key", "n", "bands")
    both = reps.join(light(several), F.col("doc_id") == F.col("id_"), "left")
    other = F.col("first").isNotNull() & (F.col("word_key") != F.col("first"))
    return stored(both.select(F.when(other, F.xxhash64("word_key", "doc_id")).otherwise(F.col("doc_id")).alias("rep"), "doc_id", "word_key", "n", "bands"), "representatives", rows)


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, key1, key2, root (null for a class of its own), class_id and n_links of every row."""
    own = stored(sketch(docs), "sketches")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    reps = representatives(own.where(usable))
    found = links(reps, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    roots = components(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = reps.select("word_key", "rep", "doc_id").join(roots, F.col("rep") == F.col("node"), "left").drop("node")
    named = named.join(ends, F.col("rep") == F.col("node"), "left").select("word_key", "doc_id", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = stored(named, "classes", reps.count())
    name = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = named.drop("doc_id").join(name, "root")
    every = own.select("doc_id", "key1", "key2", F.when(usable, F.col("word_key")).alias("word_key"))
    out = every.join(named, "word_key", "left")
    return out.select("doc_id", "key1", "key2", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links (verified links kept of its distinct text, which connect its class) of every row."""
    return _classes(docs).select("doc_id", "class_id", "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs per class: of its smallest doc_id, the text of the smallest key. Rows without doc_id or words
    stay, but for repetitions of such a row, doc_id and text alike, with words.

    Texts aren't shuffled as long as the ids that go, or repeat, are few enough to broadcast."""
    row, count = ["doc_id", "key1", "key2"], docs.count()
    each = stored(_classes(docs).where("root is not null").groupBy(*row).agg(F.min("root").alias("root"), F.min("class_id").alias("class_id"), F.count("*").alias("n")), "rows", count)
    first = each.where("doc_id = class_id").groupBy("root").agg(F.min(F.struct("key1", "key2")).alias("first"))
    marked = each.join(first, "root").withColumn("stays", (F.col("doc_id") == F.col("class_id")) & (F.struct("key1", "key2") == F.col("first")))
    marked = stored(marked.where("not stays or n > 1").select(F.col("doc_id").alias("id_"), "key1", "key2", "stays"), "marked", count)
    on = ["id_", "key1", "key2"]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs["doc_id"].cast("long").alias("id_"), *text_key(docs["text"]))
    single = rows.join(light(marked.select(*on)), on, "left_anti")
    several = rows.join(light(marked.where("stays").select(*on)), on, "left_semi").dropDuplicates(on)
    return single.unionByName(several).select(*[F.col("row_")[c].alias(c) for c in docs.columns])
