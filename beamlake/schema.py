"""Schemas of the engine's tables. Unsigned 32-bit ids and distances are BIGINT."""

VECTORS = "vec_id bigint, vec array<int>"
GRAPH = "vec_id bigint, neighbors array<bigint>"
CODES = "vec_id bigint, pq16 array<smallint>, pq32 array<smallint>"
CODEBOOK = "subspace int, centroid int, c array<int>"
QUERIES = "query_id bigint, vec array<int>"
GROUND_TRUTH = "query_id bigint, dists array<bigint>"
EXPANDED = "query_id bigint, step int, vec_id bigint, dist bigint"
RESULTS = "query_id bigint, rank int, vec_id bigint, dist_sq bigint"
SEARCHED = "query_id bigint, hops int, n_new int, n_dup int, expanded array<struct<dist:bigint,vec_id:bigint>>, list array<struct<dist:bigint,vec_id:bigint>>"
GEARS = "gear int, min_bytes bigint, l_size int, m int"
VOLTAGE_LOG = "seq bigint, query_id bigint, raw int, voltage double, op int"
