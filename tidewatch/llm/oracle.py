"""DuckDB counterparts of the text queries that SQL can express.

The others have none: they rest on tokenizer files, trained models or approximate search, or would take SQL
too long on whole tables (near duplicates); the tests hold those against brute force.
"""

import string

LOW = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
SPACE = r"[\x20\x09-\x0D]"

LINE_DEDUP = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), {LOW}) AS key FROM numbered),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, line, place, coalesce(keeper = doc_id, true) AS kept FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (kept), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _shingles(table: str, key: str) -> str:
    """The different five-word shingles of a table's texts; each text has five words or more, or none counts."""
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), {LOW}), '{SPACE}+'), lambda w: w <> '')"
    return f"""SELECT DISTINCT {key}, array_to_string(words[place:place + 4], ' ') AS shingle
      FROM (SELECT {key}, words, unnest(range(1, len(words) - 3)) AS place
            FROM (SELECT {key}, {words} AS words FROM {table}) AS w WHERE len(words) >= 5) AS s"""


DECONTAMINATION = f"""
WITH held AS ({_shingles("documents", "doc_id")}),
asked AS ({_shingles("benchmark", "item_id")}),
sizes AS (SELECT item_id, count(*) AS shingles FROM asked GROUP BY item_id)
SELECT doc_id, item_id, shingles, count(*) AS shared, count(*)::DOUBLE / shingles AS containment
FROM held JOIN asked USING (shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, shingles HAVING count(*) >= 0.8 * shingles - 1e-9
"""


def _number(text: str, first: int, digits: int) -> str:
    """Some hexadecimal digits of a text's SHA-256 as a number."""
    return f"('0x' || substr(sha256({text}), {first}, {digits}))::BIGINT"


_DRAWS = ", ".join(_number("'1:' || coalesce(doc_id::VARCHAR, '')", 8 * k + 1, 8) + f" AS h{k + 1}" for k in range(4))
INFILL = f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, {_DRAWS} FROM documents),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


def _clusters(count: int = 8, rounds: int = 10) -> str:
    """All rounds written out: distances to every centroid by component, sums by component, floors of means."""
    gaps = """SELECT row, cluster, sum((x - y) * (x - y))::BIGINT AS distance
      FROM parts JOIN {before} USING (place) GROUP BY row, cluster"""
    nearest = """near{k} AS MATERIALIZED (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
      FROM ({gaps}) GROUP BY row)"""
    steps = []
    for k in range(1, rounds + 2):
        before = f"centers{k - 1}"
        steps.append(nearest.format(k=k, gaps=gaps.format(before=before)))
        if k <= rounds:
            steps.append(f"""means{k} AS (SELECT cluster, place, sum(x)::BIGINT AS s, count(*) AS n FROM near{k} JOIN parts USING (row) GROUP BY ALL),
centers{k} AS MATERIALIZED (SELECT c.cluster, c.place, coalesce((s - (s % n + n) % n) // n, c.y) AS y
  FROM {before} AS c LEFT JOIN means{k} AS m ON c.cluster = m.cluster AND c.place = m.place)""")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT row, unnest(range(64)) AS place, unnest(list_transform(v, lambda x: floor(1024 * x)::BIGINT)) AS x FROM kept),
firsts AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept),
centers0 AS MATERIALIZED (SELECT cluster, place, x AS y FROM firsts JOIN parts USING (row) WHERE cluster < {count}),
{", ".join(steps)},
named AS (SELECT cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM centers{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM near{rounds + 1} JOIN kept USING (row) JOIN named USING (cluster)
"""


MIXING = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  {_number("'13:' || coalesce(doc_id::VARCHAR, '')", 1, 15)} AS place FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size) AS most,
  [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
filled AS (SELECT *, row_number() OVER filling AS turn, sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open FROM sources
  WINDOW filling AS (ORDER BY most * (10 // weight), source NULLS LAST),
  before AS (ORDER BY most * (10 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT rest, open FROM filled WHERE most * open > weight * rest ORDER BY turn LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN most * open <= weight * rest THEN most::DOUBLE
    ELSE weight * (SELECT rest FROM first)::DOUBLE / (SELECT open FROM first) END AS target,
  {_number("'13:' || coalesce('s' || source, 'n')", 1, 8)} AS shift FROM filled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size * 4294967296)::BIGINT, 12884901888) ELSE 0 END AS rate FROM targets),
blocks AS (SELECT *, size // 64 AS block, count(*) OVER (PARTITION BY source, size // 64) AS n,
  greatest(10000, (SELECT count(*) FROM sized) // 100000) AS bucket FROM sized),
dealt AS (SELECT *, ((place >> 30) * CASE WHEN n > bucket THEN ceil(n / bucket)::BIGINT ELSE 1 END) >> 30 AS part FROM blocks),
line AS (SELECT d.*, source_size, target, rate,
  shift + sum(rate::HUGEINT) OVER (PARTITION BY d.source ORDER BY block, part, size, place, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS reached
  FROM dealt AS d JOIN rated AS r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (reached // 4294967296 - (reached - rate) // 4294967296)::BIGINT AS copies,
  (size * (reached // 4294967296 - (reached - rate) // 4294967296))::BIGINT AS taken
FROM line
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op7_decontamination": DECONTAMINATION,
    "op11_infill": INFILL,
    "op12_clusters": _clusters(),
    "op13_mixing": MIXING,
}
