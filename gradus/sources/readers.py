"""Explicit schemas and readers of the nested JSON inputs, and the slice of one term as flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRITERIA = ("content", "teaching", "grading", "workload", "course", "instructor")
LABELS = {"content": "Content", "teaching": "Teaching", "grading": "Grading", "workload": "Workload", "course": "Course (SFQ)", "instructor": "Instructor (SFQ)"}

_CUBE = "map<string, struct<rating: map<string,double>, bayesian: map<string,double>, confidence: map<string,double>, samples: map<string,double>>>"
INSTRUCTOR_SCHEMA = f"meta struct<name: string, courses: map<string, array<struct<subject: string, code: string>>>>, ratings {_CUBE}"
COURSE_SCHEMA = f"meta struct<subject: string, code: string, instructors: map<string, array<string>>>, ratings {_CUBE}"
TERMS_SCHEMA = "term string, termName string"
_SCHEDULE = "struct<instructors: array<string>, venue: string, fromDate: string, toDate: string, weekdays: array<int>, fromTime: string, toTime: string>"
_CLASS = f"struct<section: string, number: string, remarks: string, quota: int, enroll: int, waitlist: int, consent: boolean, reservedQuota: array<struct<name: string, quota: int, enroll: int>>, schedule: array<{_SCHEDULE}>>"
_COURSE = f"struct<career: string, subject: string, number: string, code: string, name: string, description: string, previousCodes: string, prerequisites: string, corequisites: string, exclusions: string, credits: double, attributes: array<struct<attribute: string, value: string, attributeDescription: string, valueDescription: string>>, classes: array<{_CLASS}>>"
SCHEDULE_SCHEMA = f"term string, termName string, cq array<{_COURSE}>"
CATALOG_SCHEMA = "courseCode string, courseName string, courseAttributes array<struct<courseAttribute: string, courseAttributeValue: string, courseAttributeValueDescription: string>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, one row an element, in file order (`ord`). A malformed document fails the read."""
    whole = spark.read.text(path, wholetext=True)
    element = f"array<struct<{', '.join(_typed(schema))}>>"
    parsed = whole.select(F.from_json("value", element, {"mode": "FAILFAST"}).alias("rows"))
    return parsed.select(F.posexplode("rows").alias("ord", "row")).select(F.col("ord").cast("long").alias("ord"), "row.*")


def _typed(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema)]


def read_instructor_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, INSTRUCTOR_SCHEMA)


def read_course_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, COURSE_SCHEMA)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TERMS_SCHEMA)


def read_schedules(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """One row a course: term, termName, ord, course. With a terms manifest only its terms."""
    rows = _read(spark, path, SCHEDULE_SCHEMA)
    if terms is not None:
        rows = rows.join(terms.select("term"), "term", "left_semi")
    return rows.select("term", "termName", F.posexplode("cq").alias("ord", "course"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CATALOG_SCHEMA)


def term_slice(cubes: DataFrame, term: int) -> DataFrame:
    """Flat columns of one term: r_, b_, c_ and n_ for each criterion (null: missing)."""
    key = F.lit(str(term))
    at = lambda c, part: F.col("ratings")[c][part][key]
    cols = [at(c, part).alias(f"{p}_{c}") for c in CRITERIA for p, part in (("r", "rating"), ("b", "bayesian"), ("c", "confidence"), ("n", "samples"))]
    return cubes.select("ord", "meta", "ratings", *cols)


def write_by_term(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("term").parquet(path)
