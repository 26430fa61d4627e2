"""Merkle manifest, mixing of sources, divergence of sources: against plain loops, on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from beamlake.llm import common, divergence, merkle, mixing, queries
from beamlake.llm.common import crc_mod

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
#: Nulls in any column, empty and very long texts, repeated rows, one id with several texts, letters beyond ASCII.
ODD = [
    (None, "a", "en", 1, "no id\nat all"), (None, None, None, None, None), (3, "a", None, 0, ""), (3, "a", None, 0, ""), (3, "a", "en", None, "another\ntext of id 3"),
    (4, None, "en", 5, "\n\n"), (5, "ü", "de", 9, "Straße Übung ÄÖ\n x"), (6, "\U0001f600", "en", 2, "ab " * 40_000), (7, "￿", "en", 2, "a\tb\x0bc  d\xa0e\n"), (8, "", "en", 1, None), (9, "", "en", 1, " \t\n"),
]


def rows_of(n, seed=1, sources=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcXYZé") for _ in range(r.randint(1, 3))) for _ in range(60)]
    hot = lambda: "s0" if r.random() < 0.4 else f"s{r.randrange(sources)}"
    return [(100 + i, hot(), r.choice(["en", "de"]), i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 4)))) for i in range(n)]


def frame(spark, rows):
    """documents with columns whose names clash with ones that the operators make."""
    d = spark.createDataFrame(rows, COLUMNS)
    for c in ("node", "leaf", "pos", "total", "size", "rate", "draw", "copies", "source_", "number", "t", "w", "term", "value", "row_", "at_"):
        d = d.withColumn(c, F.lit("x"))
    return d.repartition(5)


@pytest.fixture(params=[1 << 25, -1], ids=["broadcast", "shuffled"])
def light(request, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", request.param)


# -- 11 -----------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 3 * 3
        out.append((nodes[run:i], nodes[i + 1 : run + 3]))
        i //= 3
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in order}
    levels = {s: plain_tree([plain_leaf(r) for r in trees[s]]) for s in order}
    top = plain_tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = plain_path(levels[s], i) + plain_path(top, k)
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            x = plain_leaf(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                x = h("".join(left) + x + "".join(right))
            out.append((r[0], plain_leaf(r), levels[s][-1][0], top[-1][0], h("".join(n for a, b in path for n in a + b)), x, x == top[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize(("levels", "most", "n", "limit"), [(7, 6561, 0, -1), (7, 6561, 1, 1 << 25), (7, 6561, 90, -1), (1, 2, 1, -1), (1, 2, 90, 1 << 25), (2, 5, 90, -1), (3, 1, 90, 1 << 25)])
def test_manifest_against_plain_trees(spark, monkeypatch, levels, most, n, limit):
    """Blocks of one level up, and a driver that holds a single node or many: the same digests, paths and folds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = (ODD if n else []) + rows_of(n, sources=9)
    docs = frame(spark, rows)
    tampered = F.when(crc_mod(docs["doc_id"], 2) == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    got = [tuple(r) for r in merkle.verified(merkle.manifest(docs, {"text": tampered}, most)).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert n < 90 or {r[-1] for r in got} == {True, False}


def test_untampered_rows_all_verify_and_one_changed_row_does_not(spark):
    rows = rows_of(40)
    assert all(r.verified for r in merkle.verified(merkle.manifest(frame(spark, rows))).collect())
    docs = frame(spark, rows)
    got = merkle.verified(merkle.manifest(docs, {"lang": F.when(docs["doc_id"] == 105, "fr").otherwise(docs["lang"])})).collect()
    assert [r.doc_id for r in got if not r.verified] == [105]


def test_root_does_not_depend_on_partitions(spark):
    rows = ODD + rows_of(30)
    roots = {merkle.manifest(frame(spark, rows).repartition(k)).first()["root"] for k in (1, 3, 11)}
    assert len(roots) == 1


# -- 12 -----------------------------------------------------------------------------------------------------


def plain_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows, cycle=(3, 1, 2), share=Fraction(3, 2), most=2):
    size = Counter()
    for r in rows:
        size[r[1]] += plain_size(r[4])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * per > most * size[s]}
        if not above:
            return size, out | {s: weight[s] * per for s in open_}
        for s in above:
            out[s] = Fraction(most * size[s])
            left -= out[s]
        open_ -= above
    return size, out


@pytest.mark.parametrize("rows", [ODD, rows_of(300), ODD + rows_of(120, 2, 30), [(1, None, "en", 1, None)], [], [(i, f"s{i:03}", "en", 1, "w " * (i * i)) for i in range(40)]])
def test_mixing_against_plain_loops(spark, light, rows):
    size, target = plain_targets(rows)
    got = mixing.planned(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        own, rate = r["row_"], target[r["row_"]["source"]] / size[r["row_"]["source"]] if size[r["row_"]["source"]] else 0
        assert r["size"] == plain_size(own["text"]) and r["source_size"] == size[own["source"]]
        assert r["target"] == pytest.approx(float(target[own["source"]]), rel=1e-12)
        draw = int(hashlib.md5(f"mix:{'-' if own['doc_id'] is None else own['doc_id']}:{own['text'] or ''}".encode()).hexdigest()[:13], 16) / 16**13
        whole = int(rate)
        if abs(draw - float(rate - whole)) > 1e-9:
            assert r["copies"] == whole + (draw < float(rate - whole)) <= 2
    if sum(size.values()):
        assert sum(target.values()) == Fraction(3, 2) * sum(size.values())


def test_mix_emits_rows_as_often_as_planned_and_reruns_agree(spark):
    docs = frame(spark, ODD + rows_of(200))
    want = Counter()
    for r in mixing.planned(docs).collect():
        want[tuple(r["row_"])] += r["copies"]
    made = mixing.mix(docs)
    assert made.columns == docs.columns
    first, second = Counter(map(tuple, made.collect())), Counter(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    assert first == second == +want
    assert all(n <= 2 * ODD.count(t[:5]) or t[:5] not in ODD for t, n in first.items())


def test_taken_words_come_near_their_targets(spark):
    """Within five standard deviations of what independent draws allow, for every source of the table."""
    rows = queries.op12_mixing(spark, "/root/testdata/sf0.01").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append((r.size, r.taken))
    for (target, size), own in by.items():
        frac = target / size % 1
        spread = (sum(s * s for s, _ in own) * frac * (1 - frac)) ** 0.5
        assert abs(sum(t for _, t in own) - target) <= 5 * spread + 1e-6 * target


# -- 13 -----------------------------------------------------------------------------------------------------


def plain_audit(rows, least, most):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        source, lang, found = r[1] or "", r[2] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[4] or "").translate(lower))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept, own = [t for t, n in docs[lang].items() if n >= least], sorted(s for g, s in groups if g == lang)
        p = {}
        for name, c in [(s, count[lang, s]) for s in own] + [(None, sum((count[lang, s] for s in own), Counter()))]:
            n = sum(c[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in own:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])[:most]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize(("rows", "least", "most"), [(rows_of(400), 30, 50), (ODD + rows_of(200, 3, 12), 5, 3), (ODD, 1, 50), (ODD, 30, 50), ([], 30, 50), (ODD * 3, 2, 2)])
def test_audit_against_plain_loops(spark, light, rows, least, most):
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), least, most).collect()]
    assert sorted(got) == sorted(plain_audit(rows, least, most))
