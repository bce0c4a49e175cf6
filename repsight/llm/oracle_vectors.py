"""DuckDB SQL for the queries on embeddings that SQL can express."""

from __future__ import annotations

FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"


def _squares(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def clustering(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    steps = [f"""
    kept AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = {size} AND {FINITE}),
    c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY h, embedding) - 1)::INTEGER AS c, v
      FROM (SELECT sha256('{seed}:' || vec_id) AS h, v, embedding FROM kept ORDER BY h, embedding LIMIT {k})),"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT r, kept.v AS v, c, {_squares('kept.v', f'c{i}.v')} AS d FROM kept, c{i}
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),""")
        if i < rounds:
            steps.append(f"""
    m{i} AS MATERIALIZED (
      SELECT c, list(s ORDER BY i) AS v FROM (
        SELECT c, i, floor(sum(x) / count(*))::BIGINT AS s
        FROM (SELECT c, unnest(v) AS x, unnest(range(1, {size + 1})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
    c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c)),""")
    return "WITH" + "".join(steps) + f"""
    done AS (SELECT vec_id, c, d FROM a{rounds} JOIN kept USING (r))
    SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM done JOIN c{rounds} USING (c)"""


def codes(size: int = 64, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    step = size // positions
    steps = [f"""
    kept AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, label, embedding,
             list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) = {size} AND {FINITE}),
    parts AS MATERIALIZED (
      SELECT r, p, v[p * {step} + 1 : p * {step} + {step}] AS x FROM kept, (SELECT unnest(range({positions})) AS p)),
    c0 AS MATERIALIZED (
      SELECT p, e, x FROM parts JOIN (
        SELECT r, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS e FROM (SELECT * FROM kept ORDER BY vec_id, embedding LIMIT {entries}))
        USING (r)),"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT r, parts.p AS p, parts.x AS x, e, {_squares('parts.x', f'c{i}.x')} AS d FROM parts JOIN c{i} ON parts.p = c{i}.p
      QUALIFY row_number() OVER (PARTITION BY r, parts.p ORDER BY d, e) = 1),""")
        if i < rounds:
            steps.append(f"""
    m{i} AS MATERIALIZED (
      SELECT p, e, list(s ORDER BY i) AS x FROM (
        SELECT p, e, i, floor(sum(y) / count(*))::BIGINT AS s
        FROM (SELECT p, e, unnest(x) AS y, unnest(range(1, {step + 1})) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e),
    c{i + 1} AS MATERIALIZED (
      SELECT p, e, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (p, e)),""")
    return "WITH" + "".join(steps) + f"""
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
    done AS (
      SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
    FROM done JOIN kept USING (r), books"""


def near_duplicates(threshold: float = 0.9) -> str:
    return f"""WITH RECURSIVE
    u AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
             coalesce({FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable FROM embeddings),
    pairs AS MATERIALIZED (
      SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND a.usable AND b.usable AND len(a.v) = len(b.v)
       AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= {threshold}),
    reach(a, b) AS (
      SELECT r, r FROM u UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    least AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN u ON u.r = reach.b GROUP BY reach.a)
    SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = u.r) AS n_links, component_id,
           vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM u JOIN least USING (r)"""
