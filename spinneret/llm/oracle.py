"""The same results as SQL over the plain tables, where SQL can express them."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _floor(total: str, n: str) -> str:
    """Whole-number division that rounds down."""
    return f"CAST(({total} - ((({total} % {n}) + {n}) % {n})) // {n} AS BIGINT)"


def _clusters(k: int = 16, rounds: int = 3) -> str:
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS BIGINT) AS num, x AS c
  FROM v QUALIFY num < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min(CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT) * {k} + num) AS m
  FROM v, c{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT m % {k} AS num, pos, sum(CAST(x[pos] AS BIGINT)) AS total, count(*) AS n
  FROM a{r} JOIN v USING (vec_id), range(1, 65) AS p(pos) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (
  SELECT num, coalesce(any_value(fresh.c), any_value(c{r}.c)) AS c
  FROM c{r} LEFT JOIN (
    SELECT num, list(CAST({_floor("total", "n")} AS DOUBLE) ORDER BY pos) AS c FROM s{r} GROUP BY num) AS fresh USING (num)
  GROUP BY num)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m % {k} AS INTEGER) AS "cluster", m // {k} AS distance,
  CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON num = m % {k}"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE {_FINITE}),
v AS MATERIALIZED (
  SELECT vec_id, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x
  FROM kept, range(0, {parts}) AS p(part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS idx, x AS c
  FROM v QUALIFY idx < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part,
    min(CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT) * {entries} + idx) AS m
  FROM v JOIN b{r} USING (part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT part, m % {entries} AS idx, pos, sum(CAST(x[pos] AS BIGINT)) AS total, count(*) AS n
  FROM a{r} JOIN v USING (vec_id, part), range(1, (SELECT max(len(x)) FROM v) + 1) AS p(pos) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (
  SELECT part, idx, coalesce(any_value(fresh.c), any_value(b{r}.c)) AS c
  FROM b{r} LEFT JOIN (
    SELECT part, idx, list(CAST({_floor("total", "n")} AS DOUBLE) ORDER BY pos) AS c FROM s{r} GROUP BY part, idx) AS fresh
  USING (part, idx) GROUP BY part, idx)""")
    return f"""WITH {", ".join(steps)},
done AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, idx))
   FROM b{rounds}) AS codebooks_sha256
FROM done JOIN kept USING (vec_id)"""


_LINKS = f"""WITH RECURSIVE sound AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, a.vec_id, b.vec_id AS other FROM sound a
  JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(vec_id, other) AS (
  SELECT DISTINCT vec_id, other FROM links
  UNION SELECT reach.vec_id, links.other FROM reach JOIN links ON reach.other = links.vec_id),
found AS (SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
  least(e.vec_id, coalesce(other, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN found USING (vec_id) LEFT JOIN least USING (vec_id)"""

# Links need a rare shingle in common: of sets ordered by how rare their shingles are, the
# first n - ceil(0.8 n) + 1 of two that are linked meet.
_SHINGLES = """WITH RECURSIVE said AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM said),
kinds AS MATERIALIZED (
  SELECT row_number() OVER () AS kind, s, least_id, ids FROM (
    SELECT list_sort(s) AS s, min(doc_id) AS least_id, list(doc_id) AS ids FROM sets WHERE len(s) > 0 GROUP BY 1)),
each AS MATERIALIZED (SELECT kind, len(s) AS n, unnest(s) AS g FROM kinds),
often AS MATERIALIZED (SELECT g, count(*) AS c FROM each GROUP BY g),
rare AS MATERIALIZED (
  SELECT kind, n, g FROM each JOIN often USING (g)
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY c, g) <= n - (4 * n + 4) // 5 + 1),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.kind AS a, b.kind AS b FROM rare a JOIN rare b USING (g)
  WHERE a.kind < b.kind AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
shared AS MATERIALIZED (
  SELECT a, b, len(x.s) + len(y.s) AS n, len(list_intersect(x.s, y.s)) AS c
  FROM pairs JOIN kinds x ON x.kind = a JOIN kinds y ON y.kind = b),
links AS MATERIALIZED (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (n - c)
  UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 80 * (n - c)),
reach(kind, other) AS (
  SELECT kind, kind FROM kinds
  UNION SELECT reach.kind, links.b FROM reach JOIN links ON links.a = reach.other),
least_ids AS MATERIALIZED (
  SELECT reach.kind, min(k.least_id) AS component_id FROM reach JOIN kinds k ON k.kind = reach.other GROUP BY reach.kind),
placed AS (SELECT unnest(ids) AS doc_id, component_id FROM kinds JOIN least_ids USING (kind))
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN placed USING (doc_id)"""

# Sources settle at the first level that one of them does not reach; a source's rows are then
# taken in the order of their keys while at least half of a row fits.
_MIX = """WITH said AS MATERIALIZED (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, coalesce(text, '') AS t FROM documents),
keyed AS MATERIALIZED (
  SELECT doc_id, source, coalesce(doc_id, -9223372036854775808) AS id,
    len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS visible,
    length(regexp_replace(t, '[^\\p{L}]+', '', 'g')) AS letters,
    (CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 12) AS BIGINT) AS DOUBLE)
      + 0.5) / 281474976710656.0 AS u
  FROM said),
ranked AS MATERIALIZED (
  SELECT doc_id, source, id, size,
    -ln(u) / (0.25 + 0.75 * CASE WHEN visible > 0 THEN CAST(letters AS DOUBLE) / visible ELSE 0 END) AS k
  FROM keyed),
sources AS MATERIALIZED (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM ranked GROUP BY source)),
reached AS MATERIALIZED (
  SELECT *, 3.0::DOUBLE * source_size / weight AS reach,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS MATERIALIZED (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(
    weight * (SELECT level FROM reached WHERE reach >= level ORDER BY reach, source NULLS LAST LIMIT 1), 3.0::DOUBLE * source_size)) AS target
  FROM sources),
goals AS MATERIALIZED (
  SELECT *, target - epochs * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets)),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, id, size) AS upto,
    sum(size) OVER (PARTITION BY source, k, id, size) AS alike
  FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * (epochs +
    CASE WHEN upto - alike < rest AND upto - alike / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, p.source
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source"""

ORACLE: dict[str, str] = {
    "op4_mix_sources": _MIX,
    "op8_minhash": _SHINGLES,
    "op11_centroid_clusters": _clusters(),
    "op12_vector_codes": _codes(),
    "op13_near_embeddings": _LINKS,
}
