from pyspark.sql import functions as F

import corpus_pipeline
from beamlake.llm.common import stored, table
from test_operators import jaccard_classes, plain_spans, shingles, whole


def test_stages_against_brute_force(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, shingles(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if name == "packing":
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        gone = set(kept) - set(now)
        if name == "toxicity":
            assert sum(toxic.get(d) == 0 for d in gone) <= 0.03 * len(kept)
        elif name == "near_duplicates":
            assert gone == {d for d, c in jaccard_classes(list(kept.items())).items() if d != c}
        elif name == "decontamination":
            assert gone == {d for d, t in kept.items() if any(s and len(s & shingles(t)) / len(s) >= 0.8 for _, s in items)}
        else:
            assert not gone and all((now[d] != t) == bool(plain_spans(t)) for d, t in kept.items() if "token =" not in t)
            assert all(now[d] != t for d, t in kept.items() if plain_spans(t))
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != kept[r.doc_id])
        kept = now
    assert whole(docs.collect(), kept) > 0.9
    assert set(docs.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_on_odd_tables(spark, sf_dir):
    """Null in any column, empty and very long texts, repeated rows, clashing columns, and no row at all."""
    odd = [(None, None, None), (1, None, "en"), (2, "", None), (3, "word", "de"), (3, "word", "de"), (4, "x " * 30_000, "en"), (None, "a text without an id", None), (5, "mail a@b.co or +1 555 123 4567 now", "fr"), (5, "the same id, another text", "fr")]
    d = spark.createDataFrame(odd, "doc_id bigint, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("id_", "key1", "key2", "k1", "k2", "base", "more", "row_", "stays", "tox_score", "pattern", "hash"):
        d = d.withColumn(c, F.lit("x"))
    for docs, n in ((d, len(odd) - 1), (d.where("1 = 0"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
            assert docs.columns == d.columns
        assert docs.count() == n
        ids = sorted(str(r.doc_id) for r in docs.collect())
        assert {r.text for r in docs.where("doc_id = 5").collect()} == ({"mail <EMAIL> or <PHONE> now", "the same id, another text"} if n else set())
        pieces = stored(corpus_pipeline.pack(spark, docs, sf_dir), "packing")
        assert sorted({str(r.doc_id) for r in pieces.collect()}) == sorted(set(ids))


def test_entry_registers_every_operator(spark, sf_dir):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
