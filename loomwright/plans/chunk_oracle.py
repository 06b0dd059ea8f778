"""The chunks of texts as DuckDB SQL: an independent statement of the splitting, for the oracle of the chunk queries.

Texts are cut level by level, a level for each separator; what is still too large is cut again. The pieces between two
large neighbours are a run, and each run's chunks are found one after another from the running sum of its lengths.
"""

from __future__ import annotations

from loomwright.functions.chunking import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS

# Fixed value: white space that a chunk is stripped of, as code points.
BLANKS = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


def _literal(separator: str) -> str:
    return "'" + separator.replace("\n", "' || chr(10) || '") + "'"


def chunk_rows(source: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> str:
    """Common tables, the last of which is ``chunks`` (``id``, ``chunk_index``, ``chunk``), for a query that gives ``id``, ``t``; to follow WITH RECURSIVE."""
    pick = " ".join(f"WHEN level < {k + 1} AND contains(t, {_literal(s)}) THEN {k}" for k, s in enumerate(SEPARATORS[:-1]))
    separator = "CASE k " + " ".join(f"WHEN {k} THEN {_literal(s)}" for k, s in enumerate(SEPARATORS)) + " END"
    blanks = " || ".join(f"chr({c})" for c in BLANKS)
    return f"""texts AS (
  {source}
), cut(id, path, level, t, large) AS (
  SELECT id, CAST([] AS BIGINT[]), 0, t, true FROM texts WHERE length(t) > 0
  UNION ALL
  SELECT id, list_append(path, j), k + 1, piece, length(piece) >= {size} FROM (
    SELECT id, path, k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM (
      SELECT id, path, k, list_filter(CASE WHEN k = {len(SEPARATORS) - 1} THEN list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))
        ELSE list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE s || x END) END, lambda x: x <> '') AS pieces
      FROM (SELECT *, string_split(t, s) AS parts FROM (SELECT *, {separator} AS s FROM (SELECT *, CASE {pick} ELSE {len(SEPARATORS) - 1} END AS k FROM cut WHERE large)))))
), placed AS (
  SELECT id, path, list_slice(path, 1, -2) AS parent, t, large, count(*) FILTER (large) OVER (PARTITION BY id, list_slice(path, 1, -2) ORDER BY path) AS run FROM cut WHERE len(path) > 0
), running AS (
  SELECT *, sum(length(t)) OVER (PARTITION BY id, parent, run ORDER BY path) AS upto FROM placed WHERE NOT large
), runs AS (
  SELECT id, min(path) AS path, string_agg(t, '' ORDER BY path) AS t, list(CAST(upto AS BIGINT) ORDER BY path) AS upto FROM running GROUP BY id, parent, run
), walk AS (
  SELECT id, path, t, upto, CAST(1 AS BIGINT) AS s, CAST(len(list_filter(upto, lambda c: c <= {size})) AS BIGINT) AS e FROM runs
  UNION ALL
  SELECT id, path, t, upto, s, CAST(len(list_filter(upto, lambda c: c <= (CASE WHEN s > 1 THEN upto[s - 1] ELSE 0 END) + {size})) AS BIGINT) AS e
  FROM (SELECT id, path, t, upto, CAST(1 + len(list_filter(list_prepend(CAST(0 AS BIGINT), upto), lambda c: c < greatest(upto[e] - {overlap}, upto[e + 1] - {size}))) AS BIGINT) AS s
    FROM walk WHERE e < len(upto))
), made AS (
  SELECT id, path, s, trim(substr(t, CAST((CASE WHEN s > 1 THEN upto[s - 1] ELSE 0 END) + 1 AS BIGINT), CAST(upto[e] - (CASE WHEN s > 1 THEN upto[s - 1] ELSE 0 END) AS BIGINT)), {blanks}) AS chunk FROM walk
), chunks AS (
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY path, s) - 1 AS INTEGER) AS chunk_index, chunk FROM made WHERE chunk <> ''
)"""
