"""Registry of named queries: Spark implementation plus the DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables (or data
that Spark derives from them).  ``sql`` is an ANSI/DuckDB statement over the
same tables with the same column names; ``None`` marks operators whose result
depends on a Python model or generator and only gets a row-count check.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --- SQL fragments shared by the oracle statements --------------------------

def h32(seed, col: str) -> str:
    """DuckDB twin of ``functions.hashing.hash32``."""
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT)"


def smd5(seed, col: str) -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def row_no_sql(id_col: str = "example_id", seed=42) -> str:
    """DuckDB twin of ``operators.numbering.number_rows``: 0-based number in the whole table's shuffled order."""
    return f"(row_number() OVER (ORDER BY {smd5(seed, id_col)}, {id_col}) - 1)"


def batch_sql(size: int, id_col: str = "example_id", seed=42) -> str:
    """Columns ``batch_id`` and ``ordinal`` of batches of ``size`` consecutive rows."""
    n = row_no_sql(id_col, seed)
    return f"CAST(floor({n} / {size}) AS BIGINT) AS batch_id, CAST({n} % {size} + 1 AS INTEGER) AS ordinal"


def stable_id_sql(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({joined}), 1, 15)) AS BIGINT)"


WS_TOKENS = "list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def ws_tokens_sql(c: str = "text") -> str:
    return WS_TOKENS.format(c=c)


def ntok_sql(c: str = "text") -> str:
    return f"len({ws_tokens_sql(c)})"


STRIP_SQL = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(c: str) -> str:
    return STRIP_SQL.format(c=c)


EXAMPLES_CTE = """examples AS (
  SELECT d.doc_id AS example_id, d.text, CAST(1 - l.quality AS INTEGER) AS label,
         d.source, d.lang AS domain, md5(d.text) AS group_key
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SCORES_CTE = EXAMPLES_CTE + f""",
scores AS (
  SELECT example_id, label, source, domain, text,
         round(CAST(0.7 AS DOUBLE) * {h32(7, 'example_id')} / 4294967296.0
               + CAST(0.3 AS DOUBLE) * label, 2) AS score
  FROM examples),
scored AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM scores)"""


def quota_sql(src: str, frac: float, seed) -> str:
    """Largest-remainder quota per stratum over relation ``src`` (stratum column)."""
    return f"""(SELECT stratum, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS q
  FROM (SELECT *, T - sum(base) OVER () AS lft,
               row_number() OVER (ORDER BY rem DESC, md5('{seed}:' || stratum), stratum) AS rk
        FROM (SELECT stratum, n, T, floor(n * T / NN) AS base,
                     round(n * T / NN - floor(n * T / NN), 9) AS rem
              FROM (SELECT stratum, CAST(n AS DOUBLE) AS n, sum(CAST(n AS DOUBLE)) OVER () AS NN,
                           ceil({frac} * sum(CAST(n AS DOUBLE)) OVER ()) AS T
                    FROM (SELECT stratum, count(*) AS n FROM {src} GROUP BY stratum) c0) c1) c2) c3)"""


SPLIT_CTE = EXAMPLES_CTE + f""",
st AS (SELECT *, CAST(label AS VARCHAR) || '_' || source AS stratum FROM examples),
q1 AS {quota_sql('st', 0.2, 42)},
r1 AS (SELECT st.*, row_number() OVER (PARTITION BY st.stratum ORDER BY {smd5(42, 'example_id')}, example_id) AS rn,
              q1.q FROM st LEFT JOIN q1 ON st.stratum = q1.stratum),
held AS (SELECT * EXCLUDE (rn, q) FROM r1 WHERE rn <= coalesce(q, 0)),
q2 AS {quota_sql('held', 0.5, 43)},
r2 AS (SELECT held.*, row_number() OVER (PARTITION BY held.stratum ORDER BY {smd5(43, 'example_id')}, example_id) AS rn,
              q2.q FROM held LEFT JOIN q2 ON held.stratum = q2.stratum),
splits AS (
  SELECT * EXCLUDE (rn, q), 'train' AS split FROM r1 WHERE rn > coalesce(q, 0)
  UNION ALL
  SELECT * EXCLUDE (rn, q), CASE WHEN rn <= coalesce(q, 0) THEN 'test' ELSE 'val' END AS split FROM r2)"""


def queries() -> dict[str, Callable]:
    from . import (q_corpus, q_generate, q_metrics, q_rounds, q_sources,  # noqa: F401
                   q_split, q_tokens)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
