"""Queries on nested entities (lists by term, ratings cubes, timetables), built from the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as E
from ..operators import ranking as R
from ..operators import schedule as C
from ..storage import new_path
from ..streaming import reactions as X
from . import adapters as A
from .catalogue import _ASK, _COURSES, _INSTRUCTORS, _ORDER, _RLE, ORACLE_SQL, QUERIES, TERM, _classes, _courses, _instructors, _near_sql, _reactions, _register, _suppliers

_T = "(year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1"
TAUGHT = f"taught AS (SELECT DISTINCT l_suppkey AS s, {_T} AS term, p_partkey AS part, p_brand AS subject, CAST(p_partkey AS VARCHAR) AS code FROM lineitem JOIN part ON p_partkey = l_partkey)"
_LABEL = "CAST(2000 + term // 4 AS VARCHAR) || '-' || CAST(2001 + term // 4 AS VARCHAR) || ' ' || CASE term % 4 WHEN 0 THEN 'Fall' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' ELSE 'Summer' END"


def _taught(spark, d) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_shipdate")
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("s"), F.expr(_T).alias("term"), F.col("p_partkey").alias("part"), F.col("p_brand").alias("subject"), F.col("p_partkey").cast("string").alias("code")).distinct()


def _by_term(rows: DataFrame, key: str, item) -> DataFrame:
    """key, lists: term -> sorted array of items. A list holds what one entity has in one term."""
    per = rows.groupBy(key, F.col("term").cast("string").alias("t")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", "l"))).alias("lists"))


def _teachers(spark, d) -> DataFrame:
    """s, name, courses: term -> array of (subject, code)."""
    names = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_name").alias("name"))
    return _by_term(_taught(spark, d), "s", F.struct("subject", "code")).join(names, F.col("s") == F.col("s_suppkey")).select("s", "name", F.col("lists").alias("courses"))


def _course_docs(spark, d) -> DataFrame:
    """part, subject, code, instructors: term -> array of names."""
    names = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    rows = _taught(spark, d).join(names, F.col("s") == F.col("s_suppkey"))
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("subject"), F.col("p_partkey").cast("string").alias("code"))
    return _by_term(rows, "part", F.col("s_name")).join(part, F.col("part") == F.col("p_partkey")).select("part", "subject", "code", F.col("lists").alias("instructors"))


_TEACHER_ASKED = "starts_with(lower(s_name), 'supplier#00000001') OR s_suppkey IN (SELECT s FROM taught WHERE contains(lower(subject || ' ' || code), '#12 77'))"
_TEACHER_QUERY = "^supplier#00000001 | '\"#12 77\""


@_register(f"WITH {TAUGHT} SELECT s_suppkey AS s, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT s FROM taught) AND ({_TEACHER_ASKED})")
def search_instructor_documents(spark, d):
    return R.search(_teachers(spark, d), _TEACHER_QUERY, E.instructor_values(F.col("name"), F.col("courses"))).select("s", "name")


@_register(f"""WITH {TAUGHT}, asked AS (SELECT part FROM taught JOIN supplier ON s_suppkey = s WHERE lower(s_name) = 'supplier#000000007' OR lower(subject || ' ' || code) = 'brand#12 77'
 OR starts_with(code, '19')) SELECT DISTINCT part FROM asked""")
def search_course_documents(spark, d):
    query = "=supplier#000000007 | =\"brand#12 77\" | ^19"
    return R.search(_course_docs(spark, d), query, E.course_values(F.col("subject"), F.col("code"), F.col("instructors"))).select("part")


@_register(_INSTRUCTORS.rstrip() + f", {TAUGHT} SELECT entity, s_name AS name, rank, percentile, CASE WHEN score IS NULL THEN ' - ' ELSE printf('%.1f', score * 100) END AS shown FROM final JOIN supplier ON s_suppkey = entity WHERE {_TEACHER_ASKED}")
def search_ranked_documents(spark, d):
    rows = _instructors(spark, d).join(_teachers(spark, d), F.col("entity") == F.col("s"))
    found = R.search(rows, _TEACHER_QUERY, E.instructor_values(F.col("name"), F.col("courses")))
    return found.select("entity", "name", "rank", "percentile", E.score_shown(F.col("score")).alias("shown"))


@_register(_COURSES.rstrip() + f", {TAUGHT} SELECT entity, rank FROM final WHERE entity IN (SELECT part FROM taught WHERE term = {TERM - 1})")
def filter_offered_nested(spark, d):
    rows = _courses(spark, d).join(_course_docs(spark, d), F.col("entity") == F.col("part"), "left")
    return R.filter_courses(rows, offered=E.offered(F.col("instructors"), TERM - 1)).select("entity", "rank")


@_register(_INSTRUCTORS + "SELECT entity, rank FROM final WHERE rank BETWEEN 11 AND 30")
def rank_page(spark, d):
    return E.page(_instructors(spark, d), 11, 20).select("entity", "rank")


_NAMED = "named AS (SELECT s, term, subject || ' ' || code AS name FROM taught)"
_NATURAL = "CAST(regexp_extract(name, '(\\d+)', 1) AS BIGINT), name"


@_register(f"""WITH {TAUGHT}, {_NAMED}, c AS (SELECT s, string_agg(name, '; ' ORDER BY {_NATURAL}) AS l FROM named WHERE term = {TERM} GROUP BY s),
h AS (SELECT s, string_agg(name, '; ' ORDER BY {_NATURAL}) AS l FROM (SELECT DISTINCT s, name FROM named WHERE term < {TERM}) GROUP BY s)
SELECT a.s, coalesce(c.l, '') AS current, coalesce(h.l, '') AS historic FROM (SELECT DISTINCT s FROM taught) a LEFT JOIN c ON c.s = a.s LEFT JOIN h ON h.s = a.s""")
def history_current_lists(spark, d):
    rows = _by_term(_taught(spark, d).withColumn("name", F.concat("subject", F.lit(" "), "code")), "s", F.col("name"))
    lists = F.col("lists")
    return rows.select("s", F.array_join(E.current_list(lists, TERM), "; ").alias("current"), F.array_join(E.historic_list(lists, TERM), "; ").alias("historic"))


def _cubes(spark, d) -> DataFrame:
    """entity, ratings: criterion -> (rating, bayesian, confidence, samples) -> term -> number."""
    parts = (("r", "rating"), ("b", "bayesian"), ("c", "confidence"), ("n", "samples"))
    wide = _suppliers(spark, d).withColumn("t", F.col("term").cast("string"))
    cells = F.collect_list(F.struct("t", *[f"{p}_{c}" for c in A.CRITERIA for p, _ in parts]))
    rows = wide.groupBy("entity").agg(cells.alias("x"))  # a row of each term

    def numbers(col: str):
        have = F.filter("x", lambda v: v[col].isNotNull())
        return F.map_from_entries(F.transform(have, lambda v: F.struct(v["t"], v[col])))

    made = [x for c in A.CRITERIA for x in (F.lit(c), F.struct(*[numbers(f"{p}_{c}").alias(name) for p, name in parts]))]
    return rows.select("entity", F.create_map(*made).alias("ratings"))


_TREND = f"""WITH {A.SUPPLIERS}, {TAUGHT}, {_NAMED}, l AS (SELECT s, term AS lt, string_agg(name, '; ' ORDER BY name) AS listed FROM named GROUP BY s, term),
t AS (SELECT entity, term, {', '.join(f'b_{c} AS {c}' for c in A.CRITERIA)}, coalesce(n_content, 0e0) AS review_samples, coalesce(n_course, 0e0) AS survey_samples, coalesce(listed, '') AS listed
FROM wide LEFT JOIN l ON s = entity AND lt = term WHERE n_content > 0 OR n_course > 0) """


def _trend(spark, d) -> DataFrame:
    lists = _by_term(_taught(spark, d).withColumn("name", F.concat("subject", F.lit(" "), "code")), "s", F.col("name"))
    rows = _cubes(spark, d).join(lists, F.col("entity") == F.col("s"), "left")
    return E.trend_rows(rows, F.col("lists"), ["entity"])


@_register(_TREND + "SELECT * FROM t")
def trend_rows(spark, d):
    return _trend(spark, d)


@_register(_TREND + f"SELECT entity, term, {_LABEL} || chr(10) || 'Reviews: ' || CAST(CAST(review_samples AS BIGINT) AS VARCHAR) || chr(10) || 'Surveys: ' || CAST(CAST(survey_samples AS BIGINT) AS VARCHAR) || chr(10) || listed AS tip FROM t")
def trend_tooltips(spark, d):
    return _trend(spark, d).select("entity", "term", E.tooltip(F.col("term"), F.col("review_samples"), F.col("survey_samples"), F.col("listed")).alias("tip"))


@_register(f"WITH {A.SUPPLIERS} SELECT entity, count(DISTINCT term) AS n_terms FROM wide GROUP BY entity")
def cube_terms(spark, d):
    return _cubes(spark, d).select("entity", F.size(E.distinct_terms(F.col("ratings"))).cast("long").alias("n_terms"))


# timetables
_DAYS = "CASE dayofweek(from_date) WHEN 0 THEN 'SuTu' WHEN 1 THEN 'MoWe' WHEN 2 THEN 'TuTh' WHEN 3 THEN 'WeFr' WHEN 4 THEN 'ThSa' WHEN 5 THEN 'FrSu' ELSE 'SaMo' END"
_CELLS = f"""cells AS (SELECT l_suppkey AS ord, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_RLE}) - 1 AS class_ord, unnest(range(l_linenumber % 3)) AS sched_ord, section,
 CAST(from_date AS VARCHAR) || ' ' || CAST(from_date + 91 AS VARCHAR) || ' ' || {_DAYS} || ' ' || CASE WHEN from_time IS NOT NULL THEN from_time || '-' || to_time ELSE '' END AS schedule,
 CASE WHEN l_linenumber % 2 = 0 THEN 'A, B' || chr(10) || 'C, D' ELSE 'E, F' END AS instructors, venue, number FROM classes)"""


def _span_sql(c: str) -> tuple[str, str]:
    start = f"CASE WHEN {c} IS NOT DISTINCT FROM lag({c}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS st_{c}"
    return start, f"sum(st_{c}) OVER w2 AS run_{c}"


_MERGED = ("section", "schedule", "instructors", "venue")


@_register(f"""WITH {A.CLASSES}, {_CELLS}, x AS (SELECT *, {', '.join(_span_sql(c)[0] for c in _MERGED)} FROM cells WINDOW w AS (PARTITION BY ord ORDER BY class_ord, sched_ord)),
y AS (SELECT *, {', '.join(_span_sql(c)[1] for c in _MERGED)} FROM x WINDOW w2 AS (PARTITION BY ord ORDER BY class_ord, sched_ord ROWS UNBOUNDED PRECEDING))
SELECT ord, CAST(class_ord AS INT) AS class_ord, CAST(sched_ord AS INT) AS sched_ord, {', '.join(f'{c}, CASE WHEN st_{c} = 1 THEN count(*) OVER (PARTITION BY ord, run_{c}) ELSE 0 END AS {c}_span' for c in _MERGED)},
section || '-' || schedule || '-' || venue || '-' || CAST(sched_ord AS VARCHAR) AS row_key FROM y""")
def section_table_full(spark, d):
    c = _classes(spark, d)
    day = F.dayofweek("from_date") - 1
    slot = F.struct(
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("A, B"), F.lit("C, D"))).otherwise(F.array(F.lit("E, F"))).alias("instructors"), "venue",
        F.col("from_date").cast("string").alias("fromDate"), F.date_add("from_date", 91).cast("string").alias("toDate"), F.array(day, (day + 2) % 7).alias("weekdays"),
        F.col("from_time").alias("fromTime"), F.col("to_time").alias("toTime"),
    )
    one = F.struct(*[F.col(k) for k in (*_ORDER, "l_quantity")], "section", "number", F.array_repeat(slot, (F.col("l_linenumber") % 3).cast("int")).alias("schedule"))
    courses = c.groupBy(F.col("l_suppkey").alias("ord")).agg(F.struct(F.array_sort(F.collect_list(one)).alias("classes")).alias("course"))
    rows = C.section_table(courses)
    key = E.row_key(F.col("section"), F.col("schedule"), F.col("venue"), F.col("sched_ord"))
    return rows.select("ord", "class_ord", "sched_ord", *[x for m in _MERGED for x in (m, f"{m}_span")], key.alias("row_key"))


_TERMED = f"{A.CLASSES}, termed AS (SELECT *, (year(from_date) - 1990) * 4 + quarter(from_date) - 1 AS term FROM classes)"


def _termed(spark, d) -> DataFrame:
    return _classes(spark, d).withColumn("term", F.expr("(year(from_date) - 1990) * 4 + quarter(from_date) - 1"))


@_register(f"WITH {_TERMED} SELECT term, number, section, l_partkey FROM termed QUALIFY row_number() OVER (PARTITION BY term, number ORDER BY {', '.join(_ORDER)}) = 1")
def class_lookup_by_term(spark, d):
    return C.first_class(_termed(spark, d), ["term", "number"], _ORDER).select("term", "number", "section", "l_partkey")


@_register(f"""WITH {_TERMED}, firsts AS (SELECT * FROM termed WHERE term = {TERM} QUALIFY row_number() OVER (PARTITION BY number ORDER BY {', '.join(_ORDER)}) = 1),
ask AS (SELECT unnest({_ASK}) AS req, unnest(range({len(_ASK)})) AS req_pos) SELECT CAST(req_pos AS INT) AS req_pos, number, section, l_partkey FROM ask JOIN firsts ON req = number""")
def class_request_of_term(spark, d):
    of_term = _termed(spark, d).where(F.col("term") == TERM)  # the term is the first key of the lookup
    return C.request(C.first_class(of_term, ["term", "number"], _ORDER), _ASK).select("req_pos", "number", "section", "l_partkey")


_SCHEDULE = f"{_TERMED}, courses AS (SELECT term, p_brand AS subject, CAST(p_partkey AS VARCHAR) AS code, list(DISTINCT number) AS numbers FROM termed JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"


@_register(f"WITH {_SCHEDULE} SELECT subject, code, CAST(len(numbers) AS INT) AS n FROM courses WHERE term = {TERM} AND ({_near_sql('bramd#12', 1, ('subject',))} OR list_contains(numbers, '0007'))")
def search_schedule(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_brand").alias("subject"), F.col("p_partkey").cast("string").alias("code"))
    rows = _termed(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("term", "subject", "code").agg(F.collect_set("number").alias("numbers"))
    return E.search_schedule(rows, F.col("term"), TERM, "bramd#12 | =0007").select("subject", "code", F.size("numbers").alias("n"))


@_register(f"""WITH {A.ATTRIBUTES}, ask AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_brand || CAST(p_partkey AS VARCHAR) ELSE p_brand END AS a, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS b FROM part)
SELECT k, name FROM ask LEFT JOIN catalog ON course_code = a || coalesce(b, '')""")
def catalog_lookup_pairs(spark, d):
    catalog = A.view(spark, d, A.ATTRIBUTES, "catalog", "part").select(F.col("course_code").alias("courseCode"), "name")
    full, third = F.concat("p_brand", F.col("p_partkey").cast("string")), F.col("p_size") % 3
    ask = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("k"), F.when(third == 0, full).otherwise(F.col("p_brand")).alias("a"), F.when(third == 1, F.lit("x")).when(third == 2, F.col("p_partkey").cast("string")).alias("b")
    )
    return E.catalog_lookup(ask, catalog, F.col("a"), F.col("b")).select("k", "name")


_PASTED = "L01 (0003)\nL02 (0007)\nL03 (9999)\nLA01 (0001)\nL03 (0003)"


@_register(f"WITH {A.CLASSES}, firsts AS (SELECT * FROM classes QUALIFY row_number() OVER (PARTITION BY number ORDER BY {', '.join(_ORDER)}) = 1), pasted AS (SELECT unnest(['0003', '0007', '9999', '0003']) AS n, unnest(range(4)) AS pos) SELECT CAST(pos AS INT) AS pos, 'COMP ' || CAST(l_partkey AS VARCHAR) || ' ' || section || ' (' || number || ')' AS label, '0001,0003,0007,9999' AS cart FROM pasted JOIN firsts ON number = n")
def paste_preview(spark, d):
    firsts = C.first_class(_classes(spark, d), ["number"], _ORDER)
    numbers = spark.range(1).select(F.posexplode(S.class_numbers(F.lit(_PASTED))).alias("pos", "number"))
    label = E.section_label(F.lit("COMP"), F.col("l_partkey").cast("string"), F.col("section"), F.col("number"))
    cart = E.cart_after_paste(F.array(F.lit("0001")), S.class_numbers(F.lit(_PASTED)))
    return E.preview(numbers, firsts).select("pos", label.alias("label"), F.array_join(cart, ",").alias("cart"))


@_register(f"WITH {TAUGHT} SELECT DISTINCT term, {_LABEL} AS name FROM taught WHERE term % 5 <> 0 UNION ALL SELECT DISTINCT term, NULL FROM taught WHERE term % 5 = 0")
def term_names(spark, d):
    have = _taught(spark, d).select("term").distinct()
    manifest = spark.range(200).where("id % 5 <> 0").select(F.col("id").cast("int").alias("term"), S.format_term(F.col("id").cast("int")).alias("termName"), F.col("id").alias("ord"))
    return E.term_name(have, manifest).select("term", F.col("termName").alias("name"))


@_register(f"WITH {A.CLASSES} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM classes WHERE venue <> 'TBA')")
def courses_with_classes(spark, d):
    c = _classes(spark, d).groupBy("l_partkey").agg(F.collect_list(F.when(F.col("venue") != "TBA", F.col("number"))).alias("classes"))
    return E.with_classes(c).select(F.col("l_partkey").alias("p_partkey"))


@_register("SELECT c_custkey, 'https://calendar.example/api?term=' || CAST(c_nationkey AS VARCHAR) || '&number=' || CAST(c_custkey AS VARCHAR) || '&number=' || replace(c_mktsegment, ' ', '+') AS https, 'webcal://calendar.example/api?term=' || CAST(c_nationkey AS VARCHAR) || '&number=' || CAST(c_custkey AS VARCHAR) || '&number=' || replace(c_mktsegment, ' ', '+') || '&webcal=1' AS webcal FROM customer")
def calendar_links(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    made = [E.calendar_link("calendar.example/api", F.col("c_nationkey").cast("string"), F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment")), w) for w in (False, True)]
    return c.select("c_custkey", made[0].alias("https"), made[1].alias("webcal"))


# reactions
@_register(ORACLE_SQL["reaction_counts"])
def reaction_stream(spark, d):
    """The events as a stream: each micro-batch writes its counters, the last of a key counts."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")  # a pattern, as a stream reads no single file
    rows = rows.select(F.col("user_id").alias("id"), F.col("event_type").alias("unified"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), F.col("event_id").alias("pos_id"))
    out = new_path(spark, "reactions")
    query = X.upsert(X.stream_counts(rows), out, new_path(spark, "reactions-log"))
    query.awaitTermination()
    return X.latest(spark.read.parquet(out))


@_register("SELECT unnest(['1', '2', '999999999']) AS id, unnest([" + ", ".join(f"coalesce((SELECT string_agg(unified || '=' || CAST(count AS VARCHAR), ',' ORDER BY unified) FROM ({ORACLE_SQL['reaction_counts']}) WHERE id = {i}), '')" for i in (1, 2, 999999999)) + "]) AS counts")
def reaction_point_read(spark, d):
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 999999999)])).alias("asked"))
    got = X.point_read(asked, "asked", X.counts(_reactions(spark, d), ["ts", "event_id"]))
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select(F.col("asked").cast("string").alias("id"), shown.alias("counts"))


__all__ = ["QUERIES", "ORACLE_SQL"]
