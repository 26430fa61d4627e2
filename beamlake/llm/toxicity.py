"""Toxicity by compression distance.

Two zstandard dictionaries hold the same ordinary text. The toxic one also holds fragments that
are typical of toxic training texts; the ordinary one holds padding in their place, so that all
else costs the same. A window is one word in a fixed frame, the smallest unit an insult fills.
Its distance is the ordinary length minus the toxic length; a window counts from `tau` bytes on.
`tau`, and a logistic score over the number and share of such windows, are calibrated on training
texts that the calibration dictionaries have not seen.

Dictionaries that are only trained on the texts of their own class tell the classes apart less well, as a toxic text
differs by a word or two: README has the figures. So the fragments are chosen against the ordinary texts.

Every word of every text is scored, however long the text. A null text counts as empty; that, and a text without words or
without a window that counts, is ordinary. Equal scores are equal predictions; the training sample is in the order
of a hash of doc_id, and of the text where an id has several, of which one is trained on. A table without labels of both
classes gives score 0 for all. Rows repeat freely, each scored for itself; a null doc_id is never trained on. Columns that
clash with the new ones are replaced by them, and drop_toxic keeps them all. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.llm.common import WORD, crc_mod, in_slices, packed, unpacked, wider
from beamlake.llm.compression import FRAME, compressor, expander, lengths

#: Bound of the training sample: texts of each class, and characters of a text that may be sampled.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 1_500, 4_000, 50_000
#: predicted is 1 from this score on.
CUT = 0.7
#: Words whose distance a worker remembers: the last half of them, and those of the half before that come up again.
CACHE = 200_000

_widen = expander(3)
#: Highest score, as a logit, of a text without a window that counts: half of CUT's odds.
_BELOW = math.log(CUT / (1 - CUT) / 2)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    tau: int
    weights: tuple[float, ...]


def _grams(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in range(4, 11) for i in range(len(w) - n + 1)}


#: Fragments at most, words of training texts that each stands for at most, and common words that both dictionaries hold.
FRAGMENTS, PER_FRAGMENT, CORE_WORDS = 120, 12, 2_500


def fragments(toxic: list[str], ordinary: list[str], cover: int = 4, per_gram: int = PER_FRAGMENT) -> tuple[list[str], Counter]:
    """Strings typical of the toxic texts, most typical first, and the ordinary words' document counts.

    Greedy cover: the next string is the one that the most not yet covered toxic texts hold, among
    those that are at least thirty times as frequent there as in ordinary texts.
    """
    df_t, df_o = Counter(), Counter()
    own: dict[str, str] = {}  # one string per word, however many texts hold it
    sets = [{own.setdefault(w, w) for w in WORD.findall(t.lower())} for t in toxic]
    for s in sets:
        df_t.update(s)
    for t in ordinary:
        df_o.update(set(WORD.findall(t.lower())))
    n_t, n_o = len(toxic), len(ordinary)
    rare = max(1, n_o // 3000)
    novel = {w for w, k in df_t.items() if df_o[w] <= rare and k >= 2}
    least = max(3, n_t // 200)
    seen: Counter = Counter()
    for s in sets:
        seen.update({g for w in s & novel for g in _grams(w)})
    frequent = {g for g, k in seen.items() if k >= least}
    del seen
    holders: dict[str, set[int]] = defaultdict(set)
    for i, s in enumerate(sets):
        for w in s & novel:
            for g in _grams(w) & frequent:
                holders[g].add(i)
    in_ordinary: Counter = Counter()
    for w, k in df_o.items():
        for g in _grams(w) & frequent:
            in_ordinary[g] += k
    pure = {g: holders[g] for g in frequent if (in_ordinary[g] + 0.5) / n_o < 0.03 * len(holders[g]) / n_t}
    need = [cover] * n_t
    chosen: list[str] = []
    open_docs = set(range(n_t))
    gain = {g: len(h) for g, h in pure.items()}
    while gain and open_docs and len(chosen) < FRAGMENTS:
        order = sorted(gain, key=lambda g: (-gain[g], -len(g), g))
        best, most = None, -1
        for g in order:  # gains only shrink: stop at the first that still holds
            if gain[g] < most:
                break
            gain[g] = len(pure[g] & open_docs)
            if gain[g] > most:
                best, most = g, gain[g]
        if best is None or most < max(3, n_t // 300):
            break
        chosen.append(best)
        for i in pure[best] & open_docs:
            need[i] -= 1
            if need[i] <= 0:
                open_docs.discard(i)
        for g in [g for g in gain if g in best or best in g]:  # the same string, longer or shorter
            del gain[g]
    found: dict[str, None] = {}
    for g in chosen:
        found[g.strip()] = None
        whole = sorted((w for w in novel if g in f" {w} "), key=lambda w: (-df_t[w], w))
        found.update(dict.fromkeys(whole[:per_gram]))
    return list(found), df_o


def dictionaries(toxic: list[str], ordinary: list[str], core_words: int = CORE_WORDS) -> tuple[bytes, bytes]:
    frag, df_o = fragments(toxic, ordinary)
    common = sorted(df_o, key=lambda w: (-df_o[w], w))[:core_words]
    core = FRAME + b"".join(_widen(f" {w} ".encode()) for w in reversed(common))
    extra = b"".join(_widen(f" {w} ".encode()) for w in reversed(frag))
    pad = _widen(bytes(range(1, 8)) * (len(extra) // 21 + 1))[: len(extra)]
    return core + extra, core + pad


class Distances:
    """Word distances under one pair of dictionaries, remembered within a bound."""

    def __init__(self, toxic: bytes, ordinary: bytes, tau: int | None = None):
        """tau: remember only whether (1 or 0) a distance reaches it."""
        self.toxic, self.ordinary, self.tau, self.known, self.older = compressor(toxic), compressor(ordinary), tau, {}, {}

    def learn(self, words: set[str]) -> dict[str, int]:
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        new = []
        for w in words:
            if w not in self.known:
                if (d := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.known[w] = d
        windows = [FRAME + _widen(f" {w} ".encode("utf-8", "replace")) for w in new]
        for i in range(0, len(new), 4096):
            part = windows[i : i + 4096]
            d = lengths(self.ordinary, part) - lengths(self.toxic, part)
            d = d if self.tau is None else (d >= self.tau).astype(int)
            self.known.update(zip(new[i : i + 4096], d.tolist(), strict=True))
        return self.known


def _features(k: int, n: int) -> tuple[float, ...]:
    """Of a text with n words, k of which reach tau."""
    n = max(1, n)
    return (1.0, math.log1p(k), math.log(k / n + 1e-3), min(k, 3) / 3)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps, classes weighted alike."""
    w, share = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + 0.5 * w
        h = (x.T * (share * p * (1 - p) + 1e-9)) @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Fit on labelled texts; None where a class is missing or nothing tells them apart."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    a_t, b_t = [t for i, t in enumerate(toxic) if i % 5 < 3], [t for i, t in enumerate(toxic) if i % 5 >= 3]
    a_o, b_o = [t for i, t in enumerate(ordinary) if i % 5 < 3], [t for i, t in enumerate(ordinary) if i % 5 >= 3]
    if len(toxic) < 10:
        a_t = b_t = toxic
    d = Distances(*dictionaries(a_t, a_o))
    y = np.array([1] * len(b_t) + [0] * len(b_o))
    found = []
    for t in b_t + b_o:  # numbers, not words, are kept of each text
        split = WORD.findall(t.lower())
        found.append(np.fromiter(map(d.learn(set(split)).__getitem__, split), dtype=np.int32, count=len(split)))
    best: tuple[float, int, np.ndarray, float] | None = None
    for tau in range(2, 10):
        k = np.array([int((t >= tau).sum()) for t in found])
        x = np.array([_features(int(a), len(t)) for a, t in zip(k, found, strict=True)])
        w = _logistic(x, y)
        z = x @ w
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        ends = np.append(z[order][:-1] != z[order][1:], True)  # a cut lies between different scores only
        ends &= np.minimum.accumulate(k[order]) > 0  # a text without a window that counts is never toxic
        if not ends.any():
            continue
        i = int(np.argmax(np.where(ends, f1, -1)))
        after = z[order][i + 1] if i + 1 < len(z) else z[order][i] - 1
        if best is None or f1[i] > best[0] + 1e-9:
            best = (float(f1[i]), tau, w, float((z[order][i] + after) / 2))
    if best is None:  # nothing tells the classes apart
        return None
    _, tau, w, cut = best
    w = w.copy()
    w[0] += math.log(CUT / (1 - CUT)) - cut
    return Model(*dictionaries(toxic, ordinary), tau, tuple(w.tolist()))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 is not 1.

    The sample is the first rows of each class in the order of a hash of doc_id. Only its ids
    (MAX_TOXIC + MAX_ORDINARY at most) are broadcast; the texts are not shuffled.
    """
    free = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~crc_mod(F.col("doc_id"), 3).isin(1, -1))
    take = lambda c, n: free.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = take(1, MAX_TOXIC).unionByName(take(0, MAX_ORDINARY)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    # One text of each id of the sample, so that what reaches the driver stays bounded however often ids repeat.
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows), key=lambda r: (r[0] * 2654435761 % 2**32, r[0], r[1]))
    return train([t for _, t, c in rows if c == 1], [t for _, t, c in rows if c == 0])


def score_texts(model: Model | None, texts: list[str], distances: Distances | None) -> tuple[list[float], list[int]]:
    if model is None:
        return [0.0] * len(texts), [0] * len(texts)
    scores, counts = [], []
    for i in range(0, len(texts), 128):
        split = [WORD.findall((t or "").lower()) for t in texts[i : i + 128]]
        known = distances.learn({w for s in split for w in s})
        for s in split:
            k = sum(map(known.__getitem__, s))
            z = sum(a * b for a, b in zip(model.weights, _features(k, len(s)), strict=True)) if s else -30.0
            if not k:
                z = min(z, _BELOW)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            counts.append(k)
    return scores, counts


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with tox_score (0 to 1) and tox_windows, the windows that count."""
    docs = docs.drop("tox_score", "tox_windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Distances(model.toxic, model.ordinary, model.tau) if model else None
        for b in batches:
            s, k = [], []
            for texts in in_slices(b.column(b.schema.get_field_index("text"))):
                one, other = score_texts(model, texts, d)
                s += one
                k += other
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(k, pa.int64())], names=[*b.schema.names, "tox_score", "tox_windows"])
            del b  # not held while the next one arrives

    schema = wider(docs, tox_score="double", tox_windows="long")
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_windows of every document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= CUT).cast("int").alias("predicted"),
        F.col("tox_windows").alias("n_windows"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    scored = score(packed(docs), fit(docs, labels))
    return unpacked(scored.where(F.col("tox_score") < CUT), docs.columns)
