"""Operators on nested entities: what is searched, offered, listed and shown of an instructor, a course or a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.search import compile_search
from ..sources.readers import CRITERIA


def _all_terms(lists: Column) -> Column:
    """Elements of a map's arrays, all terms together in order of the map, none for a null map."""
    return F.flatten(F.map_values(lists))


def course_codes(courses: Column) -> Column:
    """term -> array of (subject, code): the distinct "SUBJECT CODE" over all terms."""
    return F.coalesce(F.array_distinct(F.transform(_all_terms(courses), lambda c: F.concat(c["subject"], F.lit(" "), c["code"]))), F.array().cast("array<string>"))


def instructor_values(name: Column, courses: Column) -> Column:
    """What a search of instructors looks at: the name, and each course ever taught."""
    return F.concat(F.array(name), course_codes(courses))


def course_values(subject: Column, code: Column, instructors: Column) -> Column:
    """What a search of courses looks at: subject, code, both, and each instructor ever."""
    people = F.coalesce(F.array_distinct(_all_terms(instructors)), F.array().cast("array<string>"))
    return F.concat(F.array(subject, code, F.concat(subject, F.lit(" "), code)), people)


def class_values(subject: Column, code: Column, numbers: Column) -> Column:
    """What a search of a schedule looks at: subject, code and class numbers."""
    return F.concat(F.array(subject, code), F.coalesce(numbers, F.array().cast("array<string>")))


def offered(instructors: Column, term: int) -> Column:
    """The course has an instructor in the term."""
    return F.coalesce(F.size(instructors[F.lit(str(term))]) > 0, F.lit(False))


def current_list(lists: Column, term: int) -> Column:
    """The term's list in natural order, repeats kept; empty where the term is missing."""
    keys = F.array_sort(F.transform(F.coalesce(lists[F.lit(str(term))], F.array().cast("array<string>")), S.natural_key))
    return F.transform(keys, lambda k: k["c"])


def historic_list(lists: Column, term: int) -> Column:
    """What earlier terms list, each once, in natural order."""
    before = F.map_filter(lists, lambda k, _: k.try_cast("int") < term)
    keys = F.array_sort(F.array_distinct(F.transform(_all_terms(before), S.natural_key)))
    return F.coalesce(F.transform(keys, lambda k: k["c"]), F.array().cast("array<string>"))


def distinct_terms(ratings: Column) -> Column:
    """All term keys of a ratings cube (criterion -> parts -> term -> number), each once."""
    return F.array_distinct(F.flatten(F.transform(F.map_values(ratings), lambda r: F.map_keys(r["rating"]))))


def trend_rows(cubes: DataFrame, lists: Column, keep: list[str]) -> DataFrame:
    """A row for each term in which some criterion has samples: the smoothed ratings, the two sample counts, the term's list.

    cubes: ratings (criterion -> parts -> term -> number) and the columns of `keep`.
    """
    at = lambda c, part: F.col("_r")[c][part][F.col("_t")]
    rows = cubes.select(*keep, F.col("ratings").alias("_r"), lists.alias("_l"), F.explode(distinct_terms(F.col("ratings"))).alias("_t"))
    some = F.lit(False)
    for c in CRITERIA:
        some = some | F.coalesce(at(c, "samples") > 0, F.lit(False))
    return rows.where(some).select(
        *keep, F.col("_t").cast("int").alias("term"), *[at(c, "bayesian").alias(c) for c in CRITERIA],
        F.coalesce(at("content", "samples"), F.lit(0.0)).alias("review_samples"), F.coalesce(at("course", "samples"), F.lit(0.0)).alias("survey_samples"),
        F.array_join(F.coalesce(F.col("_l")[F.col("_t")], F.array().cast("array<string>")), "; ").alias("listed"),
    )


def tooltip(term: Column, review: Column, survey: Column, listed: Column) -> Column:
    """What the chart says of a term."""
    n = lambda c: c.cast("long").cast("string")
    return F.concat(S.format_term(term), F.lit("\nReviews: "), n(review), F.lit("\nSurveys: "), n(survey), F.lit("\n"), listed)


def score_shown(score: Column) -> Column:
    """The score as a percentage with one decimal."""
    return F.when(score.isNull() | F.isnan(score), " - ").otherwise(F.call_function("format_number", score * 100, F.lit("0.0")))


def page(df: DataFrame, first: int, size: int, position: str = "rank") -> DataFrame:
    """The rows at positions `first` to `first + size - 1`."""
    return df.where((F.col(position) >= first) & (F.col(position) < first + size))


def catalog_lookup(df: DataFrame, catalog: DataFrame, subject: Column, code: Column | None = None) -> DataFrame:
    """Left join with a catalogue of one row a courseCode, by subject and code or, where the code is missing or empty, by a full code."""
    key = subject if code is None else F.concat(subject, F.coalesce(code, F.lit("")))
    return df.withColumn("_code", key).join(catalog.withColumnRenamed("courseCode", "_course"), F.col("_code") == F.col("_course"), "left").drop("_code", "_course")


def term_name(df: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Adds termName; of terms with one code the first counts."""
    one = terms.groupBy("term").agg(F.min_by("termName", "ord").alias("termName")).withColumnRenamed("term", "_term")
    return df.join(F.broadcast(one) if _small(terms) else one, F.col(term) == F.col("_term"), "left").drop("_term")


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def with_classes(courses: DataFrame, classes: str = "classes") -> DataFrame:
    return courses.where(F.size(classes) > 0)


def section_label(subject: Column, number: Column, section: Column, class_number: Column) -> Column:
    return F.concat(subject, F.lit(" "), number, F.lit(" "), section, F.lit(" ("), class_number, F.lit(")"))


def preview(numbers: DataFrame, classes: DataFrame) -> DataFrame:
    """Pasted class numbers (number, pos) with the classes they name; numbers that name none are dropped."""
    return numbers.join(classes.withColumnRenamed("number", "_number"), F.col("number") == F.col("_number")).drop("_number")


def cart_after_paste(cart: Column, numbers: Column) -> Column:
    """The cart with all pasted numbers, also those that name no class."""
    return F.array_union(cart, numbers)


def row_key(*parts: Column) -> Column:
    """Parts joined by "-", missing ones empty."""
    return F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def cell_key(cell: Column, is_text: bool) -> Column:
    """Text as it is, a struct as JSON."""
    return cell if is_text else F.to_json(cell)


def search_schedule(courses: DataFrame, term: Column, asked: str, query: str) -> DataFrame:
    """Courses of one term that match; an empty query keeps all of the term. courses: subject, code, numbers."""
    rows = courses.where(term == F.lit(asked))
    return rows if query == "" else rows.where(compile_search(query, class_values(F.col("subject"), F.col("code"), F.col("numbers")), 0.2))


def calendar_link(base: str, term: Column, numbers: Column, webcal: bool = False) -> Column:
    """The address of a cart's calendar."""
    head = "webcal" if webcal else "https"
    asked = F.transform(numbers, lambda n: F.concat(F.lit("number="), F.url_encode(n)))
    end = [F.lit("webcal=1")] if webcal else []
    return F.concat(F.lit(f"{head}://{base}?"), F.concat_ws("&", F.concat(F.lit("term="), F.url_encode(term)), asked, *end))
