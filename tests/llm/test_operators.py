import gzip
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from beamlake.llm import common, decontaminate, forest, htmltext, langid, neardup, packing, pii, queries, quotes, toxicity, warc
from beamlake.llm.common import stored
from beamlake.llm.components import components

RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """documents with extra columns whose names clash with ones that operators make."""
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("n", "score", "base", "more", "bands", "rep", "words", "hash", "text_hash", "kind", "rank", "tox_score", "class_id", "root", "row_key", "id_"):
        d = d.withColumn(c, F.lit("x"))
    return d


ODD = [(None, "no id at all, but a text"), (900, None), (901, ""), (902, "  \n\t "), (903, "!!! ... ???"), (904, "word"), (905, "😀 émoji ß"), (906, "a" * 30_000), (907, "ab " * 30_000)]


# -- 1 ------------------------------------------------------------------------------------------------------


def words(t):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(params=[1 << 25, -1], ids=["broadcast", "shuffled"])
def light(request, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", request.param)


def test_leaks_against_brute_force(spark, light):
    items = [(i, prose(n, 100 + i)) for i, n in enumerate((5, 9, 14, 30, 33, 64, 130, 300))] + [(50, "too few"), (51, None), (52, "")]
    rows = list(ODD)
    for i, t in items[:8]:
        w = t.split()
        rows.append((len(rows), prose(200, i) + " " + t.upper().replace(" ", ",  ") + ". " + prose(50, -i)))
        for share in (0.95, 0.85, 0.8, 0.7, 0.5):
            keep = w[: max(5, round(share * len(w)))]
            rows.append((len(rows), prose(300, 7 * i) + " " + " ".join(keep)))
    rows += [rows[-1], (500, rows[-1][1])]
    rows += [(600 + i, f"{items[3][1]} {prose(i % 5, i)}") for i in range(60)] + [(600, "another text of an id " + items[5][1])]
    rows += [(700, "मैं हिन्दी में लिखता हूँ और यह एक परीक्षा है"), (701, "no mark of हिन्दी is lost " + items[4][1])]
    items += [(53, "हिन्दी में लिखता हूँ और यह")]
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            s = shingles(x)
            if s and len(s & shingles(t)) / len(s) >= 0.8:
                want[d, i] = len(s & shingles(t)) / len(s)
    assert got == want and len(want) > 15
    kept = decontaminate.drop_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    leaked = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in leaked)


def test_leaks_of_empty_tables(spark):
    none, items = docs_of(spark, [(1, "a b c d e f g")]).where("1 = 0"), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs_of(spark, [(1, "a b c d e f g")]), items.where("1 = 0")).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.standard_normal((900, 24)).astype("float32")
    v[100:160] = v[100]
    rows = [(i, v[i].tolist()) for i in range(900)] + [(5, v[5].tolist())]
    bad = [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24), (1150, [float("inf")] + [1.0] * 23), (None, v[0].tolist()), (1200, [1.0, 2.0]), (1250, [None] + [1.0] * 23), (1300, [])]
    d = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("shard", F.lit(1))
    monkeypatch.setattr(forest, "SHARD_ROWS", 300)
    monkeypatch.setattr(forest, "BLOCK", 9)
    asked = d.where("vec_id % 50 = 0")
    got = {}
    for x in forest.nearest(d, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    x = v.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    hits = 0
    for q in range(0, 900, 50):
        sc = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(900), -sc)) if i != q][:5]
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - sc[i]) < 1e-12 for _, i, s in got[q])
        hits += len(set(order) & {i for _, i, _ in got[q]})
    assert hits / (5 * 18) >= 0.9
    assert [i for _, i, _ in got[100]] == [101, 102, 103, 104, 105]  # ties to the smaller id
    assert not set(got) & {1000, 1050, 1100, 1150, 1250, 1300} and 1200 not in got
    assert forest.nearest(d.where("1 = 0"), asked, 5).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in forest.nearest(two, two, 5).collect()) == [(0, 50, 0.0), (50, 0, 0.0)]


def test_ascent_ends_early_where_neighbours_are_near():
    r = np.random.default_rng(1)
    centres = r.standard_normal((60, 48))
    v = centres[r.integers(0, 60, 4000)] + 0.5 * r.standard_normal((4000, 48))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    f, asked = forest.Forest(unit), np.arange(0, 4000, 50)
    low, high = f.ranges(unit[asked])
    hits = 0
    for i, q in enumerate(asked):
        found = f.nearest(unit, unit[q], low[:, :, i], high[:, :, i], 5, np.arange(4000) != q)
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(found.tolist()))
    assert hits >= 0.97 * 5 * len(asked) and f.read <= 0.1 * 4000 * len(asked)


# -- 3 ------------------------------------------------------------------------------------------------------


def test_quotes(spark):
    first = "Hello there, this is the very first message.\nSecond line of it is here also."
    rows = [
        (1, 0, "user", first),
        (1, 1, "bot", "> Hello there, this is the very first message.\n> Second line of it is here also.\nI agree with all of this."),
        (1, 2, "user", "On Monday Bob wrote:\n>> hello there, this is the VERY first message.\n>> Second line of it is here also.\n> I agree with all of this.\nMe too.\n"),
        (1, 3, "bot", None), (2, 0, "user", "> I agree with all of this.\nA new thread."), (3, 0, "user", ">A new thread.\nyes"), (None, 0, "user", "> x"),
        (4, None, "user", "q"), (4, 0, "user", "> nothing known here at all\nok"), (4, 2, "user", "gap"), (5, 0, "user", ">" * 5000 + " deep\nown"), (5, 1, None, ""), (6, 0, "user", first), (6, 0, "user", first),
        (7, 0, "bot", "> Second line of it is here also.\npartly"),
    ]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("own", F.lit(1)).withColumn("thread_id", F.lit("x"))
    got = {(r.conv_id, r.turn): (r.thread_id, r.parent_conv, r.parent_turn, r.n_quotes, r.n_linked, r.text) for r in quotes.link(d).collect()}
    assert quotes.link(d).count() == len(rows)
    assert got[1, 0] == (1, None, None, 0, 0, first)
    assert got[1, 1] == (1, 1, 0, 1, 1, "I agree with all of this.")
    assert got[1, 2] == (1, 1, 1, 2, 2, "Me too.")
    assert got[1, 3] == (1, 1, 2, 0, 0, "")
    assert got[2, 0] == (1, 1, 1, 1, 1, "A new thread.") and got[3, 0] == (1, 2, 0, 1, 1, "yes")
    assert got[4, 2] == (4, None, None, 0, 0, "gap") and got[4, 0][:5] == (4, None, None, 1, 0)
    assert got[5, 0][5] == "own" and got[5, 1][1:3] == (5, 0) and got[None, 0][3] == 1
    assert got[7, 0][:5] == (1, 1, 0, 1, 1)
    assert quotes.link(d.where("1 = 0")).count() == 0 and quotes.build(d.where("1 = 0")).count() == 0


def quoted_mail(seed):
    """Conversations that quote earlier messages, whole and in part, nested, with and without introductions."""
    r = random.Random(seed)
    rows, texts = [], {}
    for c in range(40):
        for t in range(r.randint(1, 5)):
            own = [" ".join(r.choice(WORDS) for _ in range(r.randint(4, 9))) for _ in range(r.randint(1, 3))]
            if r.random() < 0.15:
                own.append("as he said:")
            text = "\n".join(own)
            known = [k for k in texts if k < (c, t)]
            if known and r.random() < 0.7:
                near = [k for k in known if k[0] == c] or known
                to = r.choice(near if r.random() < 0.6 else known)
                some = texts[to].split("\n")[r.choice([0, 0, 1]) :] or ["nothing"]
                quote = "\n".join((">" if x.startswith(">") else "> ") + (x.upper() if r.random() < 0.2 else x) for x in some)
                intro = f"On day {c} someone wrote:\n" if r.random() < 0.5 else ""
                text = r.choice([f"{intro}{quote}\n{text}", f"{text}\n{intro}{quote}"])
            texts[c, t] = text
            rows.append((c, t, "user", text))
    return rows


def plain_links(rows):
    """conv_id, turn -> thread, parent and own text, by plain loops."""
    norm = lambda s: " ".join(words(s))
    keys = lambda s: {norm(s)} | {norm(x) for x in s.split("\n") if len(norm(x)) >= quotes.MIN_LINE}
    parsed, originals = {}, {}
    for c, t, _, text in rows:
        runs = []
        for x in text.split("\n"):
            mark = re.match(r"[ \t]*(?:>[ \t]?)+", x)
            level, x = (mark[0].count(">"), x[mark.end() :]) if mark else (0, x)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(x)
            else:
                runs.append((level, [x]))
        for i, (level, own) in enumerate(runs):
            if level == 0 and i + 1 < len(runs) and re.search(r"\b(wrote|said)\s*:\s*$", own[-1]):
                parsed.setdefault("cut", set()).add((c, t, i))
        parts = [(level, "\n".join(own)) for level, own in runs]
        own = "\n".join("\n".join(o[:-1]) if (c, t, i) in parsed.get("cut", ()) else "\n".join(o) for i, (level, o) in enumerate(runs) if level == 0).strip()
        parsed[c, t] = parts, own
        for s in {own, *(p for level, p in parts if level == 0)}:
            for k in keys(s) - {""}:
                originals.setdefault(k, set()).add((c, t))
    parsed.pop("cut", None)
    parent = {}
    for (c, t), (parts, _) in parsed.items():
        found = []
        for level, p in parts:
            for k in keys(p) - {""} if level else ():
                near = [x for x in originals.get(k, ()) if x[0] == c]
                far = min(originals.get(k, ()), default=None)
                to = min(near) if near and min(near) < (c, t) else far if far and far[0] < c else None
                if to:
                    found.append(((-level, len(k), to[0] == c, -to[0], -to[1]), to))
        parent[c, t] = max(found)[1] if found else (c, t - 1) if (c, t - 1) in parsed else None, bool(found)
    thread = {}
    for c in sorted({c for c, _ in parsed}):
        to, linked = parent[min(k for k in parsed if k[0] == c)]
        thread[c] = thread[to[0]] if linked and to[0] != c else c
    return {k: (thread[k[0]], parent[k][0], parsed[k][1]) for k in parsed}


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_against_brute_force(spark, light, seed):
    rows = quoted_mail(seed)
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    want = plain_links(rows)
    built = quotes.build(d).collect()
    got = {(r.conv_id, r.turn): (r.thread_id, None if r.parent_conv is None else (r.parent_conv, r.parent_turn), r.text) for r in built}
    assert got == want and sum(p is not None and p[0] != k[0] for k, (_, p, _) in want.items()) > 10
    duck = duckdb.connect()
    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    names = sorted(quotes.build(d).columns)
    assert sorted(map(str, duck.execute(f"SELECT {', '.join(names)} FROM ({queries.OP3_SQL})").fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in built)
    place = {}
    for r in built:
        place.setdefault(r.thread_id, {})[r.conv_id, r.turn] = r.place
    for own in place.values():
        assert sorted(own.values()) == list(range(len(own)))
        assert sorted(own, key=own.get) == sorted(own)
        assert all(own[want[k][1]] < own[k] for k in own if want[k][1] in own)
    assert not any(line.startswith(">") for r in built for line in r.text.split("\n"))


# -- 4 ------------------------------------------------------------------------------------------------------


def whole(rows, texts):
    """Pieces cover each document once, sequences are gapless and at most 2048 long; returns their fill."""
    ids = {k: packing.encode(t) for k, t in texts.items()}
    by, seq = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and packing.crc(own[r.start : r.start + r.length]) == r.ids_crc32
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(ids)
    for k, v in by.items():
        assert sorted(s for s, _ in v) == np.concatenate([[0], np.cumsum([n for _, n in sorted(v)])])[:-1].tolist() and sum(n for _, n in v) == len(ids[k])
    for v in seq.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    return sum(r.length for r in rows) / 2048 / len(seq)


def test_packing(spark):
    rows = [(i, prose(RND.choice([0, 1, 3, 40, 200, 500, 700, 3000]), i)) for i in range(220)] + [(1000 + i, prose(400, 1)) for i in range(80)] + [r for r in ODD if r[0] is not None]
    got = packing.pack(docs_of(spark, rows).repartition(7)).collect()
    assert whole(got, dict(rows)) > 0.985
    rows = [(None, "some text without an id"), (None, None), (3, "x"), (3, "x")]
    assert packing.pack(docs_of(spark, rows)).agg(F.sum("length")).first()[0] == sum(len(packing.encode(t)) for _, t in rows)
    assert packing.pack(docs_of(spark, rows).where("1 = 0")).count() == 0


def test_packing_tokens_are_those_of_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ["", "Hello  world", "<|endoftext|> é 😀\n\n a", "a<|endoftext|>b", "x <|endoftext|><|endoftext|>  y", "<|endoftext", "<|endoftext|>", prose(300, 1), "12 34\t\r\n", "THE!! END&&&"]:
        assert packing.encode(x)[:-1].tolist() == t.encode(x, add_special_tokens=False).ids


def test_nnls_and_plan():
    r = np.random.default_rng(1)
    a, x = r.random((30, 12)), np.maximum(0, r.standard_normal(12))
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = r.standard_normal(30)
    s = packing.nnls(a, b)
    g = a.T @ (b - a @ s)
    assert (s >= 0).all() and g.max() < 1e-6 and np.abs(g[s > 0]).max(initial=0) < 1e-6
    h = {1024: 11, 1008: 4, 1040: 4, 512: 9, 2032: 3, 16: 2}
    used = {}
    for lengths, n in packing.plan(h):
        assert sum(lengths) == 2048 and n > 0 and len(lengths) <= 3
        for v in lengths:
            used[v] = used.get(v, 0) + n
    assert all(used[v] <= h[v] for v in used) and packing.plan({}) == [] and packing.plan({2032: 5}) == []


# -- 5, 6 ---------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    bad = ["wretchface", "gorblimey", "zounderkin"]
    rows, labels = [], []
    for i in range(600):
        w = prose(RND.randint(20, 120), i).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(RND.randrange(len(w)), RND.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id bigint, toxic int").withColumn("score", F.lit(9))
    out = toxicity.toxicity(docs_of(spark, rows + ODD), lab).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    right = sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held)
    assert right > 0.95 and got[900].predicted == 0 and got[901].predicted == 0
    kept = toxicity.drop_toxic(docs_of(spark, rows + ODD), lab)
    assert kept.columns == docs_of(spark, rows[:1]).columns and sum(1 for r in kept.collect() if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4) > 420
    none = toxicity.toxicity(docs_of(spark, rows[:5]), lab.where("1 = 0")).collect()
    assert [r.score for r in none] == [0.0] * 5
    assert toxicity.toxicity(docs_of(spark, rows[:5]).where("1 = 0"), lab).count() == 0


def test_toxicity_against_brute_force(spark):
    """The score of every text from its words, each compressed for itself; ties, repeated rows and one id with two texts."""
    rows = [(i, prose(30, i) + (" wretchface and gorblimey" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate([prose(4000, 7) + " wretchface", "gorblimey", "wretchfaces!", "", None, "wretchface " * 500])] + [rows[3], (4, "another text of the id"), (6, "wretchface once more")]
    d, lab = docs_of(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, lab)
    a, b = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    got = sorted(((r.doc_id, r.score, r.n_windows) for r in toxicity.toxicity(d, lab).collect()), key=str)
    want = []
    for i, t in rows:
        w = words(t)
        packed = [toxicity.FRAME + toxicity._widen(f" {x} ".encode()) for x in w]
        k = sum(len(a.compress(x)) - len(b.compress(x)) >= model.tau for x in packed)
        z = sum(p * q for p, q in zip(model.weights, toxicity._features(k, len(w)), strict=True)) if w else -30.0
        z = z if k else min(z, math.log(0.7 / 0.3 / 2))
        want.append((i, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), k))
    want.sort(key=str)
    assert [(x[0], x[2]) for x in got] == [(x[0], x[2]) for x in want] and all(x[1] == pytest.approx(y[1]) for x, y in zip(got, want))
    assert sum(k > 0 for _, _, k in want) > 100


def test_language(spark):
    parts = {"aa": ["tion", "ment", "ough", "the", "ing"], "bb": ["ung", "keit", "sch", "der", "ß"], "cc": ["eau", "oi", "què", "les", "ç"]}
    rows = []
    for i in range(450):
        lang = list(parts)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 90))), lang))
    odd = [(d, t, "aa" if d == 906 else None) for d, t in ODD]
    d = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("x"))
    out = langid.language_id(d).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903)) and all(0 <= r.score <= 1 for r in out)
    assert langid.normal("½ ② 3 x² !") == b" x " and langid.normal("½ ② ٣ ① – \u0301") == b"" and langid.normal("हिन्दी") == " हिन्दी ".encode()
    assert {r.lang_pred for r in langid.language_id(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(d.where("1 = 0")).count() == 0


def test_language_against_brute_force(spark):
    """The dictionaries are those of all training rows, and each text goes to the smallest sum of compressed windows."""
    rows = [(i, prose(1 + i % 50, i).replace("a", "xyz"[i % 3]) * (1 + i % 7 * 20), "pqr"[i % 3]) for i in range(90)] + [(90, prose(2000, 9), "p"), (3, "one id with another text", "q"), (3, "one id with another text", "q"), (91, "mnmn", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    books = langid.fit(d)
    by = {k: langid.compressor(b, level=langid.LEVEL) for k, b in books.items()}
    assert sorted(by) == ["p", "q", "r"] and b" one id with another text " in books["q"] and books["q"].count(b" one id with another text ") == 1
    for r in langid.language_id(d.dropDuplicates()).collect():
        b = langid.normal(next(t for i, t, _ in rows if i == r.doc_id)) if r.doc_id != 3 else None
        if b:
            total = {k: sum(len(c.compress(langid.FRAME + b[i : i + langid.WINDOW])) for i in range(0, len(b), langid.WINDOW)) for k, c in by.items()}
            assert r.lang_pred == min(total, key=lambda k: (total[k], k))
    same = langid.Predictor({"b": b"x" * 300, "a": b"x" * 300})
    assert same(prose(20, 1))[0] == "a"  # ties


# -- 7 ------------------------------------------------------------------------------------------------------

TEXT = "A sentence of the article. " * 9 + "End."
DEEP, LINKS = f"<p>{TEXT}</p>", "".join(f"<li><a href=/{i}>Another article {i}</a></li>" for i in range(5))
PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=\"ad\">Buy</div>"
     "<article><h1>A &amp; B</h1><p><b>One<br>two.<p>Three  \n four.</p><ul><li>x</li><li>y</li></ul></article><footer>&copy; z</footer></body></html>", "A & B\nOne two.\nThree four.\nx\ny"),
    ("<article><p>Kept.</p><section class='comments'><p>Dropped.</p></section><aside>Side</aside><form><input><p>F</p></form><p>Last&nbsp;one&lt;</p></article>", "Kept.\nLast one<"),
    ("<div id='sidebar'><p>no</p></div><div><p>" + "Long text here. " * 12 + "</p><p>Short.</p><p>" + "More of it. " * 12 + "</p></div><div class=footer>no</div>", "\n".join([("Long text here. " * 12).strip(), "Short.", ("More of it. " * 12).strip()])),
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<article></article>", ""), ("plain text", "plain text"), ("<article><p>cut &am", "cut &am"), ("<article><p>a<!-- x", "a"), ("<article><p>t <b", "t"), ("<article>" + "<div>" * 4000 + "deep", "deep"),
    ('<article><p title="a hidden gem">First.</p><p>Second.</p></article>', "First.\nSecond."), ('<article><p class="ad">Buy<p>Real text.</p><p>More</p></article>', "Real text.\nMore"),
    ('<article><p class="social-science-notes">Real.</p><h2 id=related-work>Work</h2></article>', "Real.\nWork"), ('<div class="content has-sidebar"><p>kept</p></div>', "kept"), ("<p class='notice'>x<p>a</p><p>b</p>", "a\nb"),
    ("<article><p>Long one.</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>Short.</p></article>", "Long one.\nShort."), ("<article><p hidden>no</p><p style='Display: none'>no</p><ul><li>a<li class=ad>no<li>b</ul></article>", "a\nb"),
    (f"<article>{DEEP}<p>Read on:</p><ul>{LINKS}</ul><p>Short end.</p></article>", f"{TEXT}\nRead on:\n" + "\n".join(f"Another article {i}" for i in range(5)) + "\nShort end."),
    (f"<article><p>Intro text here.</p><aside>x</aside><aside>y</aside><aside>z</aside>{DEEP}</article>", f"Intro text here.\n{TEXT}"), (f"<div>Intro text.</div><aside>x</aside><form>y</form><aside>z</aside>{DEEP}", f"Intro text.\n{TEXT}"),
    (f"<article>{DEEP}</article><ul>{LINKS}</ul><article><p>Teaser</p></article>", TEXT), (f"<article>{DEEP}<p><a href=x>One link</a></p>{DEEP}</article>", f"{TEXT}\nOne link\n{TEXT}"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


def test_html_query(spark):
    d = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = htmltext.extract(d).collect()
    assert [r.text for r in got] == [w for _, w in PAGES] + [""] and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(d.where("1 = 0")).count() == 0


def test_regions():
    assert htmltext.regions([0, 0, 50, 60, 0, 5, 0, 0, 0, 90, 2, 0, 0, 0], 86) == [(2, 6), (9, 11)]
    assert htmltext.regions([5, 1, 90, 0, 0, 3, 0, 0, 0, 4], 86) == [(0, 6)]
    assert htmltext.regions([], 0) == [] and htmltext.regions([0, 0], 0) == []


def test_regions_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        w = [r.choice([0, 0, 0, 3, 40, 90]) for _ in range(r.randint(0, 30))]
        want, k = [], 0
        while k < len(w):  # blocks are what WIDTH lines without weight part
            if w[k]:
                e = k
                while any(w[e + 1 : e + 1 + htmltext.WIDTH]):
                    e += next(i for i in range(1, htmltext.WIDTH + 1) if w[e + i : e + i + 1] != [0])
                if max(sum(w[i : i + htmltext.WIDTH]) for i in range(k, e + 1)) > 60:
                    want.append((k, e + 1))
                k = e
            k += 1
        assert htmltext.regions(w, 60) == want


def test_distribution_decides(monkeypatch):
    """Without surges and dives, pages with several articles and with none keep what is not the article."""
    pages = [f"<article>{DEEP}</article><ul>{LINKS}</ul><article><p>Teaser</p></article>", f"<div>Home of all</div><ul>{LINKS}</ul>{DEEP}<ul>{LINKS}</ul><div>Call us</div>"]
    assert [htmltext.main_text(p) for p in pages] == [TEXT, TEXT]
    monkeypatch.setattr(htmltext, "regions", lambda w, t: [(0, len(w))])
    assert all(htmltext.main_text(p) != TEXT for p in pages)


@pytest.mark.parametrize("page", ["<nav>" * 80_000, "<nav>" * 80_000 + "</nav>", "<div>" * 80_000 + "</nav>" * 80_000, "<nav><script>" * 40_000, "<p class=ad>x" * 80_000, '<a "' * 80_000, "<script>x" * 80_000])
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 2


# -- 8 ------------------------------------------------------------------------------------------------------


def jaccard_classes(rows):
    own = {}
    for d, t in rows:
        w = words(t)
        if d is not None and w:
            own[d] = shingles(t) or {tuple(w)}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if find(a) != find(b) and len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in own}


def near(text, changes, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark, light):
    rows = [(i, prose(RND.randint(1, 150), 1000 + i)) for i in range(60)]
    base = prose(200, 77)
    rows += [(100 + i, near(base, 1 + i % 9, i)) for i in range(70)]
    rows += [(300 + i, rows[5][1].upper() + "!!") for i in range(30)] + [(400 + i, near(rows[7][1] + " " + prose(100, 3), i, i)) for i in range(5)]
    odd = [*ODD, (908, "word"), (3, rows[3][1])]
    got = {r.doc_id: r.class_id for r in neardup.classes(docs_of(spark, rows + odd)).collect()}
    want = jaccard_classes(rows + odd)
    assert {d: c for d, c in got.items() if d in want} == want
    assert got[900] == 900 and got[901] == 901 and got[903] == 903 and got[None] is None and got[904] == got[908]
    kept = sorted(str(r.doc_id) for r in neardup.deduplicate(docs_of(spark, rows + odd)).collect())
    assert kept == sorted([str(d) for d in {c for d, c in want.items()}] + ["None", "900", "901", "902", "903"])
    assert neardup.deduplicate(docs_of(spark, rows)).columns == docs_of(spark, rows[:1]).columns
    assert neardup.classes(docs_of(spark, rows).where("1 = 0")).count() == 0 and neardup.deduplicate(docs_of(spark, rows).where("1 = 0")).count() == 0


def test_texts_that_a_polynomial_cannot_tell_apart(spark):
    """The Thue-Morse word and its complement agree in every polynomial hash modulo 2 ** 64; they are different texts, and so are texts of them."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} {prose(3, 1)} {other}"), (4, f"{other} {prose(3, 1)} {word}"), (5, word.upper())]
    d = docs_of(spark, rows)
    assert sorted((r.doc_id, r.class_id) for r in neardup.classes(d).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]
    assert sorted(r.doc_id for r in neardup.deduplicate(d).collect()) == [1, 2, 3, 4]
    con = duckdb.connect()
    documents = d.select("doc_id", "text").toPandas()  # noqa: F841
    con.register("documents", documents)
    assert sorted(con.execute(queries.OP8_SQL).fetchall()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]


def test_one_id_with_several_texts(spark, light):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (1, b), (2, c), (3, near(b, 1, 5)), (1, near(a, 1, 6)), (4, b.upper()), (1, a), (5, a + "!")]
    kept = [r.text for r in neardup.deduplicate(docs_of(spark, rows)).collect()]
    assert len(kept) == 3 and c in kept and b in kept and len({a, near(a, 1, 6)} & set(kept)) == 1
    got = sorted((r.doc_id, r.class_id) for r in neardup.classes(docs_of(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 1)]


def test_recall_of_candidates_in_a_large_group(spark):
    """Of the pairs at 0.8 and more among 200 near copies, repeated shingles included, at least 0.99 share a bucket."""
    base = prose(120, 77) + " " + "again and again and again it goes " * 3 + prose(60, 78)
    texts = [near(base, i % 4, i) for i in range(200)]
    s, o, k = neardup._unique(*neardup.shingle_hashes([neardup.normal(t) for t in texts]))
    h, sets = neardup.bands(neardup.signatures(s, o, k, 200)), [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(200) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(pairs) > 3000 and sum((h[i] == h[j]).any() for i, j in pairs) >= 0.99 * len(pairs)


@pytest.mark.parametrize("block", [256, 4])
def test_pairs_that_share_only_one_large_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(2 * i + k, near(prose(150, 40 + i), 2 * k, i)) for i in range(15) for k in range(2)]
    n = {d: len(shingles(t)) for d, t in rows}
    assert len(rows) > neardup.SMALL
    keys = {r.doc_id: r.word_key for r in neardup.sketch(docs_of(spark, rows)).collect()}
    reps = spark.createDataFrame([(d, d, keys[d], n[d], [7, 1000 + d]) for d, _ in rows], "rep bigint, doc_id bigint, word_key string, n bigint, bands array<bigint>")
    found = [(x.a, x.b) for x in neardup.links(reps, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(found) == [(2 * i, 2 * i + 1) for i in range(15)]


def test_signatures_estimate_probability_jaccard():
    a, b = prose(300, 1).split(), None
    b = a[:200] + prose(100, 2).split()
    u, of, k = neardup._unique(*neardup.shingle_hashes([a, b, a]))
    sig = neardup.signatures(u, of, k, 3)
    true = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1 and (sig[0] == sig[2]).all() and neardup.word_key(a) != neardup.word_key(b)
    alone = neardup.signatures(u[of == 0], of[of == 0], k[of == 0], 1)
    assert (alone[0] == sig[0]).all()  # a text's signature does not depend on its neighbours


@pytest.mark.parametrize("hub", [512, 2])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr("beamlake.llm.components.HUB", hub)
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------------


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 900)
    big, odd = "é" * 600, "WARC/1.1\r\n\r\nfake\r\n\r\nhttp://x 0.0.0.0 20200101000000 text/html 5\nabc\n" * 20
    long = "".join(chr(32 + i * i % 90) for i in range(300_000)) + "\0"
    rows = [(1, "http://a/ b\nc", big), (2, None, None), (3, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "", odd), (7, "u", odd), (7, "u", odd), (None, "u", big), (8, "u", ""), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "\r\n\r\n" * 300), (12, "u", long)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("x")).withColumn("date", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.convert(d).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max(x[0] or 0 for x in rows if (x[2] or "").encode() == b)
        revisit = len(b) >= 1000 and (p or 0) != top
        want.append((p or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.convert(d.where("1 = 0")).count() == 0
    alone = spark.createDataFrame([(None, "u", big), (None, "u", big)], d.select("page_id", "url", "html").schema)
    assert [r.record_type for r in warc.convert(alone).collect()] == ["response"] * 2


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.version_block(version, "n.arc") + b"".join(warc.arc_record(version, "n.arc", i, "http://h/ä b", "<p>ü</p>\n\n".encode()) for i in range(3))
    got = list(warc.parse_arc(data))
    assert len(got) == 3 and got[0][0] == "http://h/ä%20b" and got[0][3].endswith("<p>ü</p>\n\n".encode())
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.version_block(3 - version, "n") + warc.arc_record(version, "n", 1, "u", b"x")))


def test_archives_of_any_number_of_members():
    parts = [warc.version_block(1, "n.arc"), *[warc.arc_record(1, "n", i, "u", bytes([65 + i]) * 70_000 * i) for i in range(4)]]
    want = list(warc.parse_arc(b"".join(parts)))
    each = [warc.member(p) for p in parts]
    halves = [gzip.compress(b"".join(parts)[:70_111]), gzip.compress(b"".join(parts)[70_111:])]
    assert len(want) == 4
    for data in (b"".join(each), b"\0\0\0".join(each) + b"\0", b"".join(halves), gzip.compress(b"".join(parts))):
        assert list(warc.parse_arc(data)) == want
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"".join(each)[:-30]))
    two = warc.warcinfo("f") + warc.warc_record("<a>", "u", "20200101000000", 1, 3, "d", b"h\r\n\r\n", b"abc", None)
    assert [f["warc-type"] for f, _ in warc.parse_warc(warc.member(two[:200]) + warc.member(two[200:]))] == ["warcinfo", "response"]


def test_warc_files_are_standard(spark):
    import glob

    d = spark.createDataFrame([(1, "u", "a" * 2000), (2, "v", "a" * 2000)], "page_id bigint, url string, html string")
    a, w = common.new_path(spark, "a"), common.new_path(spark, "w")
    warc.write_arc(d, a)
    warc.write_warc(spark, a, w)
    found = []
    for name in glob.glob(w.removeprefix("file:") + "/part*"):
        data = open(name, "rb").read()
        one = list(warc.parse_warc(gzip.decompress(data)))  # any reader of gzip can read it
        assert one[0][0]["warc-type"] == "warcinfo" and data.count(b"\x1f\x8b\x08") == len(one)  # a member per record
        found += one[1:]
    assert sorted(f["warc-type"] for f, _ in found) == ["response", "revisit"]
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", f["warc-record-id"]) and f["warc-date"] == "2020-01-01T00:00:00Z" for f, _ in found)
    by = {f["warc-type"]: f for f, _ in found}
    assert by["revisit"]["warc-refers-to"] == by["response"]["warc-record-id"] and by["revisit"]["warc-refers-to-target-uri"] == by["response"]["warc-target-uri"] == "v"


# -- 10 -----------------------------------------------------------------------------------------------------

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def plain_spans(t):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HARD = ["a@b.c%x@d.e a@b.c.@d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "😀 a@b.co +1 (555) 555-1234 ++1 22 333 4444", "1" * 4000, "a" * 9000, "a." * 4000, "a@" + "b." * 3000 + "c", "x@y.zz " * 300, "1." * 3000, "+1" + "(" * 3000, "+49 30.1234-567.", "7" * 16]


def test_base_spans_against_brute_force(spark, light):
    r = random.Random(9)
    texts = HARD + ["".join(r.choice("ab1234.@+- ()%") for _ in range(r.randint(1, 120))) for _ in range(300)] + [t for _, t in ODD]
    got = pii.digest(docs_of(spark, [(i, t) for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for row in got:
        want = plain_spans(texts[row.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (row.spans == text or row.spans.startswith(text))
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == x for k, _, _ in want) for x, _ in BASE)


def test_bootstrapped_patterns_find_unseen_identifiers(spark, light):
    r = random.Random(4)
    seeds = [(i, f"{prose(20, i)} Contact-ID: user{i}@mail.example {prose(9, -i)}") for i in range(30)]
    unseen = [(100 + i, f"{prose(20, 50 + i)} Contact-ID: K-{r.randrange(10**7, 10**8)} {prose(9, i)}") for i in range(5)]
    plain = [(200 + i, f"{prose(20, 70 + i)} item {r.randrange(10**7, 10**8)} {prose(9, i)}") for i in range(30)]
    d = docs_of(spark, seeds + unseen + plain + ODD)
    texts = dict(seeds + unseen + plain)
    got = {x.doc_id: x.spans for x in pii.digest(d).collect()}
    for i, t in unseen:
        at = t.index("K-")
        assert got[i] == f"other:{at}:{at + 10}"
    assert all(got[i].startswith("email:") and "other" not in got[i] for i, _ in seeds) and all(got[i] == "" for i, _ in plain)
    masked = {x.doc_id: x.text for x in pii.mask(d).collect()}
    assert masked[100] == re.sub(r"K-\d+", "<OTHER>", texts[100]) and masked[0] == texts[0].replace("user0@mail.example", "<EMAIL>") and masked[200] == texts[200]
    assert pii.mask(d).columns == d.columns and masked[900] is None


def test_repeated_rows_and_seeds_leave_a_pattern_its_confidence(spark):
    seed = lambda i: f"Contact-ID: user{i}@mail.example"
    rows = [(i, f"{prose(9, i)} {seed(i % 20)}, {prose(5, -i)}") for i in range(60)]
    rows += [(100 + i, f"{prose(9, 1)} ({seed(1)}) {prose(5, 2)}") for i in range(40)]
    rows += [(200, f"{prose(9, 3)} Contact-ID: K-12345678 {prose(5, 4)}")]
    got = {x.doc_id: x.spans for x in pii.digest(docs_of(spark, rows)).collect()}
    at = rows[-1][1].index("K-")
    assert got[200] == f"other:{at}:{at + 10}" and all("other" not in got[i] for i in range(60))


def test_key_contexts_are_found_from_forms_and_shapes(spark, light):
    r = random.Random(11)
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"{prose(12, i)} token = \"{digest(i)}\" {prose(7, -i)}") for i in range(12)]
    rows += [(50, f"{prose(12, 3)} TOKEN=\"7012-x\" {prose(7, 5)}"), (51, f"token: '{digest(1)[:9]}1234', {prose(4, 4)}")]
    rows += [(60 + i, f"{prose(12, 60 + i)} {r.choice(WORDS)} {digest(99 + i)} {prose(7, i)}") for i in range(8)]  # digests in prose
    rows += [(80 + i, f"{prose(9, 80 + i)} serial = {i} {prose(5, i)}") for i in range(20)]
    rows += [(110 + i, f"call me at mail = m{i}@h{i}.org now") for i in range(9)] + [(120, "mail = someone@localhost and more"), (121, "mail: none given")]
    texts, got = dict(rows), {x.doc_id: x.spans for x in pii.digest(docs_of(spark, rows + rows[:3])).collect()}
    for i in (*range(12), 50, 51, 120):
        kind, a, b = got[i].split(":")
        assert kind == "other" and texts[i][int(a) : int(b)] == {50: "7012-x", 51: digest(1)[:9] + "1234", 120: "someone@localhost"}.get(i, digest(i))
    assert all("other" not in got[i] for i in texts if not (i < 12 or i in (50, 51, 120)))


def test_secrets_that_hold_a_refused_run_of_digits(spark):
    """Some digests hold 16 digits that fail Luhn's check; all 200 of a text are marked and masked, and so is a key of letters only."""
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    refused = [i for i in range(200) if any(16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and not luhn(re.sub("[^0-9]", "", m[0])) for m in re.finditer(BASE[2][1], digest(i)))]
    assert {27, 46, 170} <= set(refused)
    text = "\n".join(f'{prose(5, i)} token = "{digest(i)}"' for i in range(200))
    rows = [(1, text), (2, f'{prose(5, 1)} token = "{digest(27)}"'), (3, f"{prose(4, 2)} token: ghp_{'abcdEFGH' * 4} {prose(3, 3)}")]
    got = {x.doc_id: x for x in pii.digest(docs_of(spark, rows)).collect()}
    assert got[1].spans.count("other:") + got[1].n_card >= 200 and got[2].spans.startswith("other:") and got[3].spans.startswith("other:")
    masked = {x.doc_id: x.text for x in pii.mask(docs_of(spark, rows)).collect()}
    assert not any(digest(i) in masked[1] for i in range(200)) and digest(27) not in masked[2] and "ghp_" not in masked[3]


def test_matches_take_time_in_proportion(spark):
    """Spans of texts with 2,000 to 16,000 addresses, eight times as many in not much more than eight times the time."""
    took = {}
    for n in (2_000, 2_000, 16_000):
        d = stored(spark.createDataFrame([(" ".join(f"user{i}@mail.example" for i in range(n)),)] * 2, "text string"), "addresses")
        began = time.perf_counter()
        assert d.select(F.size(pii.base_spans(F.col("text"))).alias("n")).where(f"n = {n}").count() == 2
        took[n] = time.perf_counter() - began
    assert took[16_000] < 16 * took[2_000]


def test_scores_against_brute_force(spark):
    """Confidence and mass of all patterns, by plain loops over the same tokens."""
    r = random.Random(2)
    left = ["id", "no", "ref"]
    rows = [(i, " ".join(f"{r.choice(left)} {r.choice(['a%d@b.co', '1.2.3.%d', 'X-%d000', '4.5.6.9%d', 'z%d'])}" % r.randint(1, 60) for _ in range(9))) for i in range(40)]
    tokens = stored(pii._tokens(docs_of(spark, rows).select("text")), "tokens").cache()
    graph = {}
    for t in tokens.select("instance", "state", F.concat("contexts", pii._shapes(F.col("instance"))).alias("p")).collect():
        for p in t.p:
            key = p, t.instance
            graph[key] = max((x for x in (graph.get(key), t.state) if x is not None), default=None)
    by = {}
    for (p, i), state in graph.items():
        by.setdefault(p, {})[i] = state
    by = {p: x for p, x in by.items() if len(x) >= pii.SUPPORT}
    conf = dict.fromkeys(by, 0.0)
    while True:
        weight = {}
        for p, x in by.items():
            for i in x:
                weight[i] = max(weight.get(i, 0), pii.KEEP * conf[p])
        mass = {p: sum(1 if s else weight[i] if s is None else 0 for i, s in x.items()) for p, x in by.items()}
        new = {p: min(1, mass[p] / (len(by[p]) + 1)) for p in by}
        moved, conf = max(abs(new[p] - conf[p]) for p in by), new
        if moved <= pii.SETTLED:
            break
    count = spark.createDataFrame([(p, sum(1 for s in x.values() if s), len(x)) for p, x in by.items()], "pattern string, seeds bigint, total bigint")
    edges = spark.createDataFrame([(p, i) for p, x in by.items() for i, s in x.items() if s is None], "pattern string, instance string")
    got = {x.pattern: (x.confidence, x.mass) for x in pii._settled(edges, count).collect()}
    assert set(got) == set(by) and all(got[p] == pytest.approx((conf[p], mass[p])) for p in by) and max(conf.values()) > 0.5


def test_masks(spark):
    d = spark.createDataFrame([(1, "😀 a@b.co, 1.2.3.4 +1 555 555 1234", 99), (2, "clean", 5), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(d).collect()}
    assert got == {1: ("😀 <EMAIL>, <IP> <PHONE>", 23), 2: ("clean", 5), 3: (None, None)}
    assert pii.digest(d.where("1 = 0")).count() == 0


def test_small_tables_are_weighed_as_they_are_written(spark, monkeypatch):
    """Contexts are scored without a pass over any table but the one that writes it; kept() counts what it writes."""

    def passed(*_):
        raise AssertionError("a pass of its own")

    monkeypatch.setattr(common, "light", passed)
    monkeypatch.setattr(pii, "light", passed, raising=False)
    counts = spark.createDataFrame([("K a", 5, 6), ("K b", 0, 9)], "pattern string, seeds bigint, total bigint")
    edges = spark.createDataFrame([("K a", "x"), ("K b", "x")], "pattern string, instance string")
    got = {x.pattern: x.confidence for x in pii._settled(edges, counts).collect()}
    assert got["K a"] > 0.79 and 0.07 < got["K b"] < 0.09
    k = common.kept(spark.range(10).select("id", F.lit("four").alias("s")), "kept", most=F.max("id"))
    assert (k.rows, k.bytes, k.more) == (10, 10 * (16 + 2 * 16 + 4), {"most": 9}) and k.light().count() == 10
    none = common.kept(k.table.where("id < 0"), "kept", most=F.max("id"))
    assert (none.rows, none.bytes, none.more) == (0, 0, {"most": None})
