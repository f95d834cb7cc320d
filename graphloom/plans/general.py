"""Queries of problems 5 and 6: dominant keys and unparsable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import filled
from graphloom.operators import quarantine, skew
from graphloom.plans.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with at least 2 % of all rows of their table."""
    terms = table(spark, folder, "term_element_edges", "term", "element")
    edges = table(spark, folder, "edge_list", "vertex1", "vertex2")
    parts = (("term_element_edges", terms, "term", "element"), ("edge_list", edges, "vertex1", "vertex2"))
    found = None
    for name, df, key, value in parts:
        part = skew.dominant_keys(df, key, value, 0.02).where(filled(F.col("key")))
        part = part.select(F.lit(name).alias("table_name"), F.col("key").alias("key_value"))
        found = part if found is None else found.unionByName(part)
    return found


def p5_term_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct elements and the modal element of every term, null and blank terms included."""
    return skew.key_profile(table(spark, folder, "term_element_edges", "term", "element"), "term", "element")


def p5_vertex_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct partners and the modal partner of every first vertex."""
    return skew.key_profile(table(spark, folder, "edge_list", "vertex1", "vertex2"), "vertex1", "vertex2")


def p5_vertex_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of the score of every first vertex."""
    edges = table(spark, folder, "edge_list", "vertex1", "score")
    found = skew.weighted_percentiles(edges, "vertex1", "score", [0.25, 0.5, 0.75])
    return found.select("key", "probability", F.round("percentile", 6).alias("percentile"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that do not parse, each with the first reason that applies."""
    lines = table(spark, folder, "edge_lines", "line_id", "raw_line")
    return quarantine.rejected_lines(quarantine.parse_edge_lines(lines)).select("line_id", "reason")


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines with typed columns."""
    lines = table(spark, folder, "edge_lines", "line_id", "raw_line")
    parsed = quarantine.loaded_lines(quarantine.parse_edge_lines(lines))
    return parsed.select("line_id", "vertex1", "vertex2", "score", "seen_on")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p5_found, p5_term_profile, p5_vertex_profile, p5_vertex_scores, p6_found, p6_loaded)
    }


_BLANK = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


def _dominant(name: str, key: str) -> str:
    return f"""
SELECT '{name}' AS table_name, {key} AS key_value FROM {name}
WHERE {key} IS NOT NULL AND NOT regexp_full_match({key}, '{_BLANK}')
GROUP BY {key} HAVING count(*) >= 0.02 * (SELECT count(*) FROM {name})"""


def _profile(name: str, key: str, value: str) -> str:
    return f"""
WITH c AS (SELECT {key} AS key, {value} AS value, count(*) AS n FROM {name} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value IS NULL, n DESC, value) AS rn FROM c)
SELECT key, CAST(sum(n) AS BIGINT) AS n_rows, count(value) AS n_values,
       max(value) FILTER (rn = 1) AS mode,
       max(n) FILTER (rn = 1 AND value IS NOT NULL) AS mode_rows
FROM r GROUP BY key"""


# one field: quoted, or free of quotes and tabs
_FIELD = r"""("([^"]|"")*"|[^"\t]*)"""
_LINES = r"""
WITH b AS (SELECT line_id, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS body
           FROM edge_lines),
s AS (SELECT line_id, body, regexp_full_match(body, 'FIELD(\tFIELD)*', 's') AS sound,
             regexp_full_match(body, 'FIELD(\tFIELD){3}', 's') AS four FROM b),
f AS (SELECT *, CASE WHEN sound AND four THEN list_transform(regexp_extract_all(body || chr(9), '(FIELD)\t', 1, 's'),
        lambda x: trim(CASE WHEN left(x, 1) = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END, ' ')) END AS v FROM s),
j AS (SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN body IS NULL OR NOT four THEN 'columns'
        WHEN NOT (regexp_full_match(v[1], '[A-Za-z]{3}[-:_.][0-9]{9}') AND regexp_full_match(v[2], '[A-Za-z]{3}[-:_.][0-9]{9}')
          AND regexp_full_match(v[3], '[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?') AND coalesce(TRY_CAST(v[3] AS DOUBLE) <= 1, false)
          AND regexp_full_match(v[4], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v[4] AS DATE) IS NOT NULL AND left(v[4], 4) <> '0000')
        THEN 'value' END AS reason, v FROM f)
""".replace("FIELD", _FIELD)


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _dominant("term_element_edges", "term") + " UNION ALL " + _dominant("edge_list", "vertex1"),
        "p5_term_profile": _profile("term_element_edges", "term", "element"),
        "p5_vertex_profile": _profile("edge_list", "vertex1", "vertex2"),
        "p5_vertex_scores": """
WITH q AS (SELECT vertex1 AS key, quantile_cont(score, [0.25, 0.5, 0.75]) AS v FROM edge_list
           WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY vertex1)
SELECT key, CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS probability, round(unnest(v), 6) AS percentile FROM q""",
        "p6_found": _LINES + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
        "p6_loaded": _LINES
        + """SELECT line_id, v[1] AS vertex1, v[2] AS vertex2, CAST(v[3] AS DOUBLE) AS score, CAST(v[4] AS DATE) AS seen_on
FROM j WHERE reason IS NULL""",
    }
