"""Views of the driver's tables in the engine's shapes. The same SQL text serves Spark and DuckDB, so inputs are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITERIA = ("content", "teaching", "grading", "workload", "course", "instructor")
_VALUE = {
    "content": ("q", 50), "teaching": ("p", 100000), "grading": ("d", 0.1), "workload": ("t", 0.08),
    "course": ("CASE WHEN f = 'R' THEN p * (1 - d) END", 100000), "instructor": ("CASE WHEN f = 'R' THEN CAST(n AS DECIMAL(18,4)) END", 7),
}


def wide_sql(entity: str, key: str | None = None) -> str:
    """CTEs down to `wide`: entity, term and for each criterion rating r_, smoothed b_, confidence c_, samples n_."""
    aggs = ", ".join(f"CAST(SUM({v}) AS DOUBLE) AS s_{c}, COUNT({v}) AS n_{c}" for c, (v, _) in _VALUE.items())
    means = ", ".join(f"CAST(SUM(n_{c}) AS DOUBLE) / COUNT(NULLIF(n_{c}, 0)) AS mn_{c}, CAST(SUM(CAST(s_{c} AS DECIMAL(28,4))) AS DOUBLE) / NULLIF(SUM(n_{c}), 0) AS mr_{c}" for c in CRITERIA)
    cols = ", ".join(
        f"CASE WHEN n_{c} > 0 THEN s_{c} / n_{c} / {float(_VALUE[c][1])!r}e0 END AS r_{c}, "
        f"CASE WHEN n_{c} > 0 THEN (mn_{c} * mr_{c} + s_{c}) / (mn_{c} + n_{c}) / {float(_VALUE[c][1])!r}e0 END AS b_{c}, "
        f"CASE WHEN n_{c} > 0 THEN n_{c} / (n_{c} + mn_{c}) END AS c_{c}, CAST(n_{c} AS DOUBLE) AS n_{c}"
        for c in CRITERIA
    )
    return f"""base AS (SELECT {entity} AS entity, (year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1 AS term, CAST(l_quantity AS DECIMAL(18,4)) AS q,
 CAST(l_extendedprice AS DECIMAL(18,4)) AS p, CAST(l_discount AS DECIMAL(18,4)) AS d, CAST(l_tax AS DECIMAL(18,4)) AS t, l_returnflag AS f, l_linenumber AS n FROM lineitem),
sums AS (SELECT entity, term, {aggs} FROM base GROUP BY entity, term),
means AS (SELECT term AS mt, {means} FROM sums GROUP BY term),
wide AS (SELECT entity, entity AS ord, term, {cols} FROM sums JOIN means ON term = mt)"""


SUPPLIERS, PARTS = wide_sql("l_suppkey"), wide_sql("l_partkey")

#: classes: one a lineitem row of the first orders of a customer segment; venues in every shape and one that fits none
CLASSES = """classes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
 'L' || lpad(CAST(l_linenumber AS VARCHAR(4)), 2, '0') AS section, lpad(CAST(l_orderkey % 10000 AS VARCHAR(8)), 4, '0') AS number,
 CASE l_partkey % 7 WHEN 0 THEN 'Rm ' || CAST(l_partkey AS VARCHAR(12)) || ', Lift 25-26 (60)' WHEN 1 THEN 'Lecture Theater ' || chr(CAST(65 + l_suppkey % 26 AS INT))
  WHEN 2 THEN 'G' || CAST(l_partkey AS VARCHAR(12)) || ', CYT Bldg' WHEN 3 THEN 'G' || CAST(l_partkey AS VARCHAR(12)) || ', LSK Bldg (70)'
  WHEN 4 THEN 'Rm ' || CAST(l_partkey AS VARCHAR(12)) || ', Shaw Auditorium' WHEN 5 THEN 'Rm ' || CAST(l_partkey AS VARCHAR(12)) || ', xxx' ELSE 'TBA' END AS venue,
 CAST(l_shipdate AS DATE) AS from_date, CASE WHEN l_quantity > 45 THEN NULL ELSE lpad(CAST(8 + l_linenumber AS VARCHAR(4)), 2, '0') || ':30' END AS from_time,
 lpad(CAST(9 + l_linenumber AS VARCHAR(4)), 2, '0') || ':50' AS to_time FROM lineitem)"""

ATTRIBUTES = """catalog AS (SELECT p_partkey AS part, p_brand AS subject, CAST(p_partkey AS VARCHAR(12)) AS code, p_brand || CAST(p_partkey AS VARCHAR(12)) AS course_code,
 p_name AS name, CAST(24 + p_size % 5 AS VARCHAR(4)) AS area, p_type AS attr_type FROM part)"""

REACTIONS = """reactions AS (SELECT event_id, ts, user_id AS id, event_type AS unified, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta FROM events)"""


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def first_day(term: int) -> str:
    """The first day of a term of the views above."""
    return f"{1990 + term // 4}-{term % 4 * 3 + 1:02d}-01"


def view(spark: SparkSession, sf_dir: str, ctes: str, name: str, *tables: str, terms: tuple[int | None, int] | None = None) -> DataFrame:
    """terms: only lines from the first term up to the second, which is left out; as dates, so that the scan skips the others."""
    register(spark, sf_dir, *tables)
    if terms is not None:
        lines = spark.table("lineitem").where(F.col("l_shipdate") < F.lit(first_day(terms[1])).cast("timestamp_ntz"))
        if terms[0] is not None:
            lines = lines.where(F.col("l_shipdate") >= F.lit(first_day(terms[0])).cast("timestamp_ntz"))
        lines.createOrReplaceTempView("lineitem")
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}".replace("VARCHAR(4)", "STRING").replace("VARCHAR(8)", "STRING").replace("VARCHAR(12)", "STRING"))
