"""DuckDB SQL for small linear systems: Gauss-Jordan elimination in a recursive CTE (used by the oracles only).

The systems are symmetric and positive definite, so no pivots are exchanged.
"""

from __future__ import annotations


def inverse_sql(name: str, matrix: str) -> str:
    """CTEs that turn the table ``matrix`` (i, j, v; 1-based, every entry there) into ``name`` (i, j, v), its inverse.
    Needs ``WITH RECURSIVE``."""
    return f"""
{name}_rows AS (
  SELECT i, list_concat(list(v ORDER BY j), list_transform(range(1, (SELECT max(j) FROM {matrix}) + 1),
    lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r FROM {matrix} GROUP BY i),
{name}_steps(k, n, m) AS (
  SELECT CAST(1 AS BIGINT), count(*), list(r ORDER BY i) FROM {name}_rows
  UNION ALL
  SELECT k + 1, n, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
    ELSE list_transform(r, lambda x, j: x - r[k] * (m[k][j] / m[k][k])) END) FROM {name}_steps WHERE k <= n),
{name} AS (
  SELECT i, j, m[i][n + j] AS v FROM (
    SELECT n, m, unnest(range(1, n + 1)) AS i FROM {name}_steps WHERE k = n + 1), LATERAL (SELECT unnest(range(1, n + 1)) AS j))"""
