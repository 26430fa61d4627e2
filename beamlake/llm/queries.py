"""One query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm import decontaminate, divergence, forest, htmltext, langid, merkle, mixing, neardup, packing, pii, quotes, toxicity, warc
from beamlake.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where(F.pmod(F.col("vec_id"), F.lit(50)) == 0), k=5)


def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.build(table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.convert(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(merkle.manifest(docs, {"text": tampered}))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.planned(table(spark, sf_dir, "documents"))
    return p.select(F.col("row_.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (op1_decontamination, op2_nearest, op3_quotations, op4_packing, op5_toxicity, op6_language_id, op7_html, op8_near_duplicates, op9_warc, op10_pii, op11_merkle, op12_mixing, op13_divergence)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS ws FROM documents
), v AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS ws FROM benchmark
), d AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS sh FROM w WHERE len(ws) >= 5
), i AS (
  SELECT item_id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS sh FROM v WHERE len(ws) >= 5
), n AS (
  SELECT item_id, count(*) AS n FROM i GROUP BY item_id
), c AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (sh) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found::DOUBLE / n AS containment
FROM c JOIN n USING (item_id) WHERE n_found::DOUBLE / n >= 0.8
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS sh
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
), m AS (
  SELECT node, min(root) AS root FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(m.root, d.doc_id) AS class_id FROM documents d LEFT JOIN m ON m.node = d.doc_id
"""

_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"


def _keys(source: str, columns: str) -> str:
    """columns, key and size of the whole text t, and of each of its lines of 20 characters and more, of source."""
    line = f"list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: {_NORMAL.format('x')}), lambda x: length(x) >= {quotes.MIN_LINE})"
    every = f"list_distinct(list_filter(list_prepend({_NORMAL.format('t')}, {line}), lambda x: x <> ''))"
    return f"SELECT {columns}, key, length(key) AS size FROM (SELECT {columns}, unnest({every}) AS key FROM {source})"


OP3_SQL = rf"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), l AS (
  SELECT id, n, lines[n] AS line, regexp_extract(lines[n], '^[ \t]*(?:>[ \t]?)+') AS mark
  FROM (SELECT id, string_split_regex(text, '\r?\n') AS lines, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS n FROM m WHERE regexp_matches(text, '(?m)^[ \t]*>'))
), v AS (
  SELECT id, n, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(line, length(mark) + 1) AS t FROM l
), r AS (
  SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS g FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS new FROM v)
), parts AS MATERIALIZED (
  SELECT *, coalesce(lead(level) OVER (PARTITION BY id ORDER BY g), 0) AS after FROM (SELECT id, g, min(level) AS level, string_agg(t, chr(10) ORDER BY n) AS t FROM r GROUP BY id, g)
  UNION ALL SELECT id, 1, 0, text, 0 FROM m WHERE NOT regexp_matches(text, '(?m)^[ \t]*>')
), own AS MATERIALIZED (
  SELECT id, regexp_replace(coalesce(string_agg(CASE WHEN after > 0 THEN regexp_replace(t, '(?i)(?:^|\n)[^\n]*\b(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:\s*$', '') ELSE t END, chr(10) ORDER BY g)
    FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS t FROM parts GROUP BY id
), quoted AS MATERIALIZED (
  SELECT id, g, level, t FROM parts WHERE level > 0 AND {_NORMAL.format("t")} <> ''
), texts AS (
  SELECT conv_id, turn, t FROM own JOIN m USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  UNION SELECT conv_id, turn, t FROM parts JOIN m USING (id) WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL
), near AS MATERIALIZED (
  SELECT key, conv_id, min(turn) AS near FROM ({_keys("texts", "conv_id, turn")}) GROUP BY key, conv_id
), far AS MATERIALIZED (
  SELECT key, min({{'c': conv_id, 't': near}}) AS far FROM near GROUP BY key
), q AS (
  SELECT m.conv_id, m.turn, g, level, key, size FROM ({_keys("quoted", "id, g, level")}) k JOIN m USING (id) WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL
), linked AS (
  SELECT *, CASE WHEN near < turn THEN {{'c': conv_id, 't': near}} WHEN far.c < conv_id THEN far END AS goal, coalesce(near < turn, false)::INTEGER AS here FROM q LEFT JOIN near USING (key, conv_id) LEFT JOIN far USING (key)
), parents AS MATERIALIZED (
  SELECT conv_id, turn, arg_max(goal, {{'a': -level, 'b': size, 'h': here, 'c': -goal.c, 't': -goal.t}}) AS goal, count(DISTINCT g) AS n_linked FROM linked WHERE goal IS NOT NULL GROUP BY conv_id, turn
), turns AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), up AS MATERIALIZED (
  SELECT conv_id, min(goal.c) AS above FROM parents JOIN (SELECT conv_id, min(turn) AS turn FROM turns GROUP BY conv_id) USING (conv_id, turn) WHERE goal.c <> conv_id GROUP BY conv_id
), walk(conv_id, above) AS (
  SELECT conv_id, above FROM up UNION ALL SELECT w.conv_id, u.above FROM walk w JOIN up u ON u.conv_id = w.above
), thread AS (
  SELECT conv_id, min(above) AS thread_id FROM walk GROUP BY conv_id
), every AS (
  SELECT m.conv_id, m.turn, m.role, coalesce(thread.thread_id, m.conv_id) AS thread_id, CASE WHEN goal IS NOT NULL THEN goal.c WHEN b.turn IS NOT NULL THEN m.conv_id END AS parent_conv,
    CASE WHEN goal IS NOT NULL THEN goal.t ELSE b.turn END AS parent_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, own.t AS text
  FROM m JOIN own USING (id) LEFT JOIN (SELECT id, count(*) AS n_quotes FROM quoted GROUP BY id) USING (id) LEFT JOIN turns b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1
  LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN thread ON thread.conv_id = m.conv_id
)
SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY conv_id, turn) - 1 AS place FROM every
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), c AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chosen FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> chosen THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> chosen THEN chosen END AS refers_to
FROM c
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "xor(c, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda z: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)[1]"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value})) || ':' || {value} END"


def _grown(name: str, base: str, by: str) -> str:
    """The nodes of all levels: runs of three, while a tree has several."""
    return f"""{name}(level, source, pos, node) AS (
  {base}
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER ({by}) AS n FROM {name}) WHERE n > 1 GROUP BY level, source, pos // 3
)"""


def _steps(nodes: str) -> str:
    """left|right siblings of each node that is no top."""
    run = "OVER (PARTITION BY source, level, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""SELECT source, level, pos, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
    FROM {nodes} JOIN (SELECT source AS s, max(level) AS top FROM {nodes} GROUP BY source) ON s IS NOT DISTINCT FROM source WHERE level < top"""


OP11_SQL = rf"""
WITH RECURSIVE h AS (
  SELECT doc_id, source, text, {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS odd, {" || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("CASE WHEN odd THEN replace(text, chr(10), '') ELSE text END")}) AS seen FROM h
), p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), {_grown("t", "SELECT 0, source, pos, leaf FROM p", "PARTITION BY source")}, nodes AS MATERIALIZED (SELECT * FROM t), subroots AS MATERIALIZED (
  SELECT source, arg_max(node, level) AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes GROUP BY source
), {_grown("u", "SELECT 0, 0, place, subroot FROM subroots", "")}, over AS MATERIALIZED (SELECT * FROM u), steps AS MATERIALIZED (
  {_steps("nodes")}
), above AS MATERIALIZED (
  {_steps("over")}
), path AS (
  SELECT id, level, step FROM p JOIN steps s ON s.source IS NOT DISTINCT FROM p.source AND s.pos = p.pos // CAST(3 ** level AS BIGINT)
  UNION ALL SELECT id, 1000 + level, step FROM p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source JOIN above a ON a.pos = r.place // CAST(3 ** level AS BIGINT)
), paths AS (
  SELECT id, list(step ORDER BY level) AS path FROM path GROUP BY id
), v AS (
  SELECT doc_id, leaf, subroot, (SELECT arg_max(node, level) FROM over) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(seen, coalesce(path, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM p LEFT JOIN paths USING (id) JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source
)
SELECT *, folded_root = root AS verified FROM v
"""

OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS draw FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r AS (  -- in the order in which sources reach their limits
  SELECT *, sum(n) OVER () AS total, sum(w) OVER () AS weights, coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s WINDOW o AS (ORDER BY n / w, source NULLS LAST)
), c AS (
  SELECT *, 4 * n * (weights - w_before) < w * (3 * total - 4 * n_before) AS capped FROM r
), l AS (
  SELECT 3 * any_value(total) - 4 * coalesce(sum(n) FILTER (WHERE capped), 0) AS num, 2 * coalesce(sum(w) FILTER (WHERE NOT capped), 0) AS den FROM c
), t AS (
  SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN capped THEN n * 2.0::DOUBLE ELSE w * CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM c CROSS JOIN l
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""

OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), w AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(t) AS term FROM d) GROUP BY lang, source, term
), k AS MATERIALIZED (
  SELECT lang, term FROM w GROUP BY lang, term HAVING sum(docs) >= 30
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), c AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, CAST(coalesce(w.n, 0) AS HUGEINT) AS n FROM g JOIN k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)
), f AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_quotations": OP3_SQL, "op8_near_duplicates": OP8_SQL, "op9_warc": OP9_SQL, "op11_merkle": OP11_SQL, "op12_mixing": OP12_SQL, "op13_divergence": OP13_SQL}
