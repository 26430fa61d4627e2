"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its training words. A text, reduced to its
lower-case letters-only words with immediate repeats dropped, is cut into windows; each window is
compressed under every dictionary and the language with the smallest total wins. The score is the
winner's share after a softmax over the lengths; `rejected` marks a margin too narrow to trust.

A text that is null or has no letter is `und` with score 0. With no training row at all, every text is `und`.
Letters are Unicode's, with the marks that follow them; digits, fractions and signs are none. Equal lengths go to
the alphabetically first language. Every text is read whole, in windows, whatever its length. Rows that repeat are
predicted each for itself, and count once in training; a doc_id with two texts trains on both. Columns that clash
with the new ones are replaced by them. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamlake.llm.common import crc_mod, in_slices, stored, wider
from beamlake.llm.compression import FRAME, compressor, lengths

#: Bound of the training sample: texts of each language, and characters of each, from a place given by its hash.
MAX_TEXTS, MAX_CHARS = 600, 4_000
#: Bytes of a dictionary and of a window; zstandard's level.
DICT_BYTES, WINDOW, LEVEL = 48_000, 2_048, 6
#: Below this relative margin between the two best lengths the prediction is marked as rejected.
NARROW = 0.01

_LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")


def normal(text: str | None) -> bytes:
    """Letters-only words, lower case, immediate repeats dropped; empty if there is no letter."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return b""
    kept = [words[0], *(b for a, b in pairwise(words) if a != b)]
    return f" {' '.join(kept)} ".encode("utf-8", "replace")


def train(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """A dictionary of each language: equal shares of its texts, taken in turn until it is full."""
    out = {}
    for lang, own in sorted(texts.items()):
        parts = [p for p in map(normal, own) if p]
        if not parts:
            continue
        share = max(200, DICT_BYTES // len(parts) + 1)
        held = b"".join(p[i : i + share] for i in range(0, 4 * share, share) for p in parts)
        out[lang] = held[:DICT_BYTES] + FRAME
    return out


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Train on a bounded sample of the rows with a language whose crc32(doc_id) mod 4 is not 2.

    One pass takes the ids: the first MAX_TEXTS of each language in the order of a hash, ranked within each task before
    the shuffle. Another takes MAX_CHARS characters of their texts, so that what reaches the driver is at most a
    dictionary's material per language; languages, which are classes, are all kept."""
    free = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~crc_mod(F.col("doc_id"), 4).isin(2, -1))
    key = F.xxhash64("doc_id", F.length("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    chosen = free.select("lang", "doc_id", key.alias("key")).withColumn("nth", nth).where(F.col("nth") <= MAX_TEXTS)
    chosen = stored(chosen.select("lang", "doc_id", "key").distinct(), "sample")
    at = F.pmod(F.col("key"), F.greatest(F.length("text") - MAX_CHARS, F.lit(0)).cast("long") + 1).cast("int")
    part = F.substring("text", at + 1, F.lit(MAX_CHARS)).alias("text")
    # A sample of at most MAX_TEXTS rows of a few bytes per language is broadcast.
    rows = free.withColumn("key", key).join(F.broadcast(chosen), ["lang", "doc_id", "key"]).select("lang", "key", "doc_id", part).distinct()
    texts: dict[str, list[tuple]] = {}
    for r in rows.toLocalIterator():
        texts.setdefault(r["lang"], []).append((r["key"], r["doc_id"], r["text"]))
    return train({lang: [t for _, _, t in sorted(own)] for lang, own in texts.items()})


class Predictor:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.by = [compressor(dictionaries[x], level=LEVEL) for x in self.langs]

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, relative margin to the second, and whether it is rejected."""
        b = normal(text)
        if not b or not self.langs:
            return "und", 0.0, 0.0, True
        windows = [FRAME + b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]
        total = [int(lengths(c, windows).sum()) for c in self.by]
        order = sorted(range(len(total)), key=lambda i: (total[i], self.langs[i]))
        least = total[order[0]]
        margin = (total[order[1]] - least) / total[order[1]] if len(order) > 1 else 1.0
        unit = max(1.0, least / 50)
        score = 1 / sum(math.exp(-(t - least) / unit) for t in total)
        return self.langs[order[0]], score, margin, margin < NARROW


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, lang_score, lang_margin and lang_rejected."""
    new = {"lang_pred": "string", "lang_score": "double", "lang_margin": "double", "lang_rejected": "boolean"}
    docs = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Predictor(dictionaries)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for b in batches:
            found = [one(t) for texts in in_slices(b.column(b.schema.get_field_index("text"))) for t in texts]
            cols = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])
            del b  # not held while the next one arrives

    return docs.mapInArrow(run, wider(docs, **new))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every document."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_margin").alias("margin"),
        F.col("lang_rejected").alias("rejected"),
    )
