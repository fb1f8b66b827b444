"""SQL fragments that several comparison texts share."""

from __future__ import annotations

from tessera.functions.text import WHITE_SPACE

WORDS = r"'[\p{L}\p{N}_]+'"
# The same character set for DuckDB's trim.
WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def embed(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """CTEs that end in ``name(key, v)``: hashed word counts scaled to unit length."""
    return f"""
{name}_w AS (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), {WORDS})) AS w FROM {source}),
{name}_c AS (SELECT key, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS b, count(*) AS c FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT key, sqrt(sum(c * c)) AS n FROM {name}_c GROUP BY 1),
{name}_z AS (SELECT {key} AS key, range AS b FROM {source}, range({dim})),
{name} AS (SELECT z.key, list(CAST(CAST(coalesce(c / n, 0) AS FLOAT) AS DOUBLE) ORDER BY z.b) AS v
    FROM {name}_z z LEFT JOIN {name}_c c ON z.key = c.key AND z.b = c.b LEFT JOIN {name}_n n ON z.key = n.key GROUP BY 1)"""


def cosine(a: str, b: str) -> str:
    return f"round(coalesce(CASE WHEN isnan(list_cosine_similarity({a}, {b})) THEN 0 ELSE list_cosine_similarity({a}, {b}) END, 0), 12)"


def shown(sql: str, **digits: int) -> str:
    """``sql`` with its scores rounded for the report; it ranks on the full ones."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {n}) AS {c}' for c, n in digits.items())}) FROM ({sql})"


def bm25(name: str, source: str, key: str, text: str, terms: list[str]) -> str:
    """CTEs that end in ``name(key, score)`` for the rows with at least one term."""
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""
{name}_t AS (SELECT {key} AS key, regexp_extract_all(lower({text}), {WORDS}) AS t FROM {source}),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM {name}_t),
{name}_f AS (SELECT key, q, len(t) AS dl, len(list_filter(t, lambda x: x = q)) AS tf FROM {name}_t, (VALUES {wanted}) w(q)),
{name}_d AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM {name}_f GROUP BY 1),
{name} AS (SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 12) AS score
    FROM {name}_f JOIN {name}_d USING (q), {name}_s WHERE tf > 0 GROUP BY key)"""


def chunks(name: str, source: str, key: str, text: str, size: int, overlap: int) -> str:
    """CTEs that end in ``name(key, chunk_no, chunk)``: word windows."""
    step = size - overlap
    return f"""
{name}_w AS (SELECT {key} AS key, regexp_extract_all({text}, '[^ \\t\\n\\r\\f]+') AS w FROM {source}),
{name}_i AS (SELECT key, w, unnest(range(0, greatest(CAST(ceil((len(w) - {overlap}) / {step}) AS BIGINT), 1))) AS i FROM {name}_w),
{name} AS (SELECT key, CAST(i AS INTEGER) AS chunk_no,
        array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS chunk FROM {name}_i)"""
