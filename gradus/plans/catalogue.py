"""The catalogue: each query on the driver's tables, with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.formula import compile_formula
from ..operators import ranking as R
from ..operators import schedule as C
from ..streaming import reactions as X
from . import adapters as A

TERM = 30
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_W2 = " + ".join(f"coalesce(b_{c}, 0e0) * 2e0 / 3e0 * {w}e0" for c, w in (("content", 0.4), ("teaching", 0.4), ("grading", 0.15), ("workload", 0.05)))
SCORE_I = _W2 + " + coalesce(b_course, 0e0) * 1e0 / 3e0 * 0.25e0 + coalesce(b_instructor, 0e0) * 1e0 / 3e0 * 0.75e0"
SCORE_C = _W2 + " + coalesce(b_course, 0e0) * 1e0 / 3e0 * 0.75e0 + coalesce(b_instructor, 0e0) * 1e0 / 3e0 * 0.25e0"
ANY = "(" + " OR ".join(f"coalesce(c_{c}, 0) <> 0" for c in A.CRITERIA) + ")"
ALL = "(" + " AND ".join(f"coalesce(c_{c}, 0) <> 0" for c in A.CRITERIA) + ")"
GRADE = "CASE " + " ".join(f"WHEN percentile >= {t}e0 THEN '{g}'" for t, g in S.GRADES) + " ELSE 'F' END"


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _suppliers(spark, d, terms: tuple[int | None, int] | None = None) -> DataFrame:
    return A.view(spark, d, A.SUPPLIERS, "wide", "lineitem", terms=terms)


def _parts(spark, d, terms: tuple[int | None, int] | None = None) -> DataFrame:
    return A.view(spark, d, A.PARTS, "wide", "lineitem", terms=terms)


_NOW = (TERM, TERM + 1)


def _ranked_sql(ctes: str, gate: str, score: str, term: int | None = TERM, order: str = "ord") -> str:
    where = gate if term is None else f"term = {term} AND {gate}"
    return f"""WITH {ctes}, scored AS (SELECT *, {score} AS score FROM wide WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, {order}) AS rank, count(*) OVER (PARTITION BY term) AS total FROM scored),
final AS (SELECT *, 1e0 - CAST(rank - 1 AS DOUBLE) / total AS percentile FROM ranked) """


_INSTRUCTORS, _COURSES = _ranked_sql(A.SUPPLIERS, ANY, SCORE_I), _ranked_sql(A.PARTS, ALL, SCORE_C)


def _instructors(spark, d, formula: str = R.INSTRUCTOR_FORMULA) -> DataFrame:
    return R.rank(R.gate_any(_suppliers(spark, d, _NOW)), formula)


def _courses(spark, d) -> DataFrame:
    return R.rank(R.gate_all(_parts(spark, d, _NOW)), R.COURSE_FORMULA)


@_register(_INSTRUCTORS + "SELECT entity, score, rank, percentile FROM final")
def rank_instructors(spark, d):
    return _instructors(spark, d).select("entity", "score", "rank", "percentile")


@_register(_COURSES + "SELECT entity, score, rank, percentile FROM final")
def rank_courses(spark, d):
    return _courses(spark, d).select("entity", "score", "rank", "percentile")


@_register(_ranked_sql(A.SUPPLIERS, ANY, SCORE_I, None) + "SELECT entity, term, score, rank, percentile FROM final")
def rank_every_term(spark, d):
    return R.rank(R.gate_any(_suppliers(spark, d)), R.INSTRUCTOR_FORMULA, partition=["term"]).select("entity", "term", "score", "rank", "percentile")


@_register(_INSTRUCTORS + f"SELECT entity, rank, percentile, {GRADE} AS grade FROM final")
def rank_letter_grade(spark, d):
    return _instructors(spark, d).select("entity", "rank", "percentile", S.letter_grade(F.col("percentile")).alias("grade"))


def _channel(k: int) -> str:
    out = "CASE WHEN percentile < 0 OR percentile > 1 THEN 0"
    for (lo, a), (hi, b) in zip(S.STOPS, S.STOPS[1:], strict=False):
        out += f" WHEN percentile <= {hi}e0 THEN CAST(floor({float(a[k])}e0 + (percentile - {lo}e0) / {hi - lo}e0 * {float(b[k] - a[k])}e0 + 0.5e0) AS INT)"
    return out + " ELSE 0 END"


@_register(_INSTRUCTORS + f"SELECT entity, {_channel(0)} AS red, {_channel(1)} AS green, {_channel(2)} AS blue FROM final")
def grade_color(spark, d):
    r, g, b = S.grade_color(F.col("percentile"))
    return _instructors(spark, d).select("entity", r.alias("red"), g.alias("green"), b.alias("blue"))


@_register(_INSTRUCTORS + f"SELECT {GRADE} AS grade, count(*) AS n FROM final GROUP BY 1")
def grade_distribution(spark, d):
    return _instructors(spark, d).groupBy(S.letter_grade(F.col("percentile")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


_CUSTOM = "CASE WHEN coalesce(r_content, 0e0) > 0.5e0 THEN greatest(coalesce(b_teaching, 0e0), coalesce(b_course, 0e0)) ELSE -(coalesce(b_grading, 0e0) * 2e0) END"


@_register(_ranked_sql(A.SUPPLIERS, ANY, _CUSTOM) + "SELECT entity, score, rank, percentile FROM final")
def rank_custom_formula(spark, d):
    f = "content.rating > 0.5 ? max(teaching.bayesian, course.bayesian) : -(grading.bayesian * 2)"
    return _instructors(spark, d, f).select("entity", "score", "rank", "percentile")


@_register(_ranked_sql(A.SUPPLIERS, ANY, "coalesce(r_content, 0e0)") + "SELECT entity, score, rank, percentile FROM final")
def rank_rating_only(spark, d):
    return _instructors(spark, d, "content.rating").select("entity", "score", "rank", "percentile")


@_register(_ranked_sql(A.SUPPLIERS, ANY, "1e0") + "SELECT entity, rank, percentile FROM final")
def rank_formula_ties(spark, d):
    return _instructors(spark, d, "1").select("entity", "rank", "percentile")


@_register(f"""WITH {A.SUPPLIERS}, s AS (SELECT entity, CASE WHEN entity % 3 = 0 THEN NULL ELSE coalesce(b_content, 0e0) END AS x FROM wide WHERE term = {TERM} AND {ANY})
SELECT entity, row_number() OVER (ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, -x, entity) AS rank FROM s""")
def rank_formula_nan(spark, d):
    rows = R.gate_any(_suppliers(spark, d, _NOW)).withColumn("r_content", F.when(F.col("entity") % 3 == 0, 0.0).otherwise(1.0))
    return R.rank(rows, "content.rating / content.rating * content.bayesian").select("entity", "rank")


@_register(f"WITH {A.PARTS} SELECT term, count(*) FILTER (WHERE {ANY}) AS n_any, count(*) FILTER (WHERE {ALL}) AS n_all FROM wide GROUP BY term")
def gate_any_vs_all(spark, d):
    wide = _parts(spark, d)
    a = R.gate_any(wide).groupBy("term").agg(F.count(F.lit(1)).alias("n_any"))
    b = R.gate_all(wide).groupBy("term").agg(F.count(F.lit(1)).alias("n_all"))
    return a.join(b, "term", "left").select("term", "n_any", F.coalesce("n_all", F.lit(0)).alias("n_all"))


# search
_DOC = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE "


def _search(query: str, threshold: float = 0.1, values: tuple[str, ...] = ("p_name", "p_brand", "p_type")):
    def run(spark, d):
        p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
        return R.search(p, query, F.array(*values), threshold)

    return run


def _any_value(test: str) -> str:
    return "(" + " OR ".join(test.replace("v", f"lower({c})") for c in ("p_name", "p_brand", "p_type")) + ")"


for _name, _query, _sql in (
    ("search_contains", "'widget", _any_value("contains(v, 'widget')")),
    ("search_prefix", "^brand#1", _any_value("starts_with(v, 'brand#1')")),
    ("search_suffix", "2$", _any_value("suffix(v, '2')")),
    ("search_equals", "=brand#12", _any_value("v = 'brand#12'")),
    ("search_or_groups", "=brand#12 | =brand#21", _any_value("v = 'brand#12'") + " OR " + _any_value("v = 'brand#21'")),
    ("search_same_field_and", "^brand 2$", _any_value("(starts_with(v, 'brand') AND suffix(v, '2'))")),
):
    QUERIES[_name] = _search(_query)
    ORACLE_SQL[_name] = _DOC + _sql


QUERIES["search_negate"], ORACLE_SQL["search_negate"] = _search("!1", values=("p_brand",)), _DOC + "NOT contains(lower(p_brand), '1')"


def _near_sql(token: str, k: int, columns: tuple[str, ...] = ("p_name", "p_brand", "p_type")) -> str:
    m = len(token)
    test = f"len(list_filter(range(1, length(v) + 1), lambda i: len(list_filter(range({m - k}, {m + k + 1}), lambda n: levenshtein(substring(v, i, n), '{token}') <= {k})) > 0)) > 0"
    return "(" + " OR ".join(f"({test.replace('(v', f'(lower({c})')})" for c in columns) + ")"


QUERIES["search_fuzzy_k1"], ORACLE_SQL["search_fuzzy_k1"] = _search("brend#1", 0.2), _DOC + _near_sql("brend#1", 1)
QUERIES["search_fuzzy_k2"], ORACLE_SQL["search_fuzzy_k2"] = _search('"smoll rimg"', 0.2), _DOC + _near_sql("smoll rimg", 2)


@_register(_INSTRUCTORS + "SELECT entity, s_name, rank FROM final JOIN supplier ON s_suppkey = entity WHERE contains(lower(s_name), '1')")
def search_rank_preserved(spark, d):
    names = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    ranked = _instructors(spark, d).join(names, F.col("entity") == F.col("s_suppkey"))
    return R.search(ranked, "1", F.array("s_name")).select("entity", "s_name", "rank")


# facets and catalogue
def _catalog(spark, d) -> DataFrame:
    c = A.view(spark, d, A.ATTRIBUTES, "catalog", "part")
    attr = F.struct(F.lit("CC22").alias("courseAttribute"), F.col("area").alias("courseAttributeValue"))
    return c.withColumn("attributes", F.array(attr))


@_register(_COURSES.rstrip() + f", {A.ATTRIBUTES} SELECT entity, rank, area FROM final JOIN catalog ON part = entity WHERE area IN ('24', '26')")
def filter_facet_any(spark, d):
    return R.filter_courses(_courses(spark, d).join(_catalog(spark, d), F.col("part") == F.col("entity"), "left"), areas=["24", "26"]).select("entity", "rank", "area")


@_register(_COURSES.rstrip() + f", {A.ATTRIBUTES} SELECT entity, rank FROM final JOIN catalog ON part = entity WHERE area = '25' AND n_content >= 2")
def filter_combined(spark, d):
    rows = _courses(spark, d).join(_catalog(spark, d), F.col("part") == F.col("entity"), "left")
    return R.filter_courses(rows, offered=F.col("n_content") >= 2, areas=["25"]).select("entity", "rank")


@_register(_COURSES + "SELECT entity, rank FROM final WHERE n_content >= 2")
def filter_offered(spark, d):
    return R.filter_courses(_courses(spark, d), offered=F.col("n_content") >= 2).select("entity", "rank")


@_register(_COURSES + "SELECT entity, rank FROM final")
def filter_noop(spark, d):
    return R.filter_courses(_courses(spark, d)).select("entity", "rank")


@_register(_COURSES + "SELECT entity, rank, p_name FROM final LEFT JOIN part ON p_partkey = entity AND p_size > 10")
def catalog_left_lookup(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size > 10").select("p_partkey", "p_name")
    return _courses(spark, d).join(p, F.col("entity") == F.col("p_partkey"), "left").select("entity", "rank", "p_name")


@_register("SELECT p_brand AS course_code, p_partkey AS part, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def catalog_last_wins(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("courseCode"), "p_partkey", "p_name")
    return R.catalog_index(p, "p_partkey").select(F.col("courseCode").alias("course_code"), F.col("p_partkey").alias("part"), "p_name")


# reports and trends
def _long(df: DataFrame) -> DataFrame:
    s = ", ".join(f"'{c}', r_{c}, b_{c}, c_{c}, n_{c}" for c in A.CRITERIA)
    return df.select("entity", "term", F.expr(f"stack({len(A.CRITERIA)}, {s}) as (criterion, rating, bayesian, confidence, samples)"))


_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT entity, term, '{c}' AS criterion, r_{c} AS rating, b_{c} AS bayesian, c_{c} AS confidence, n_{c} AS samples FROM wide" for c in A.CRITERIA) + ") "


@_register(f"WITH {A.SUPPLIERS}{_LONG} SELECT entity, criterion, rating, bayesian, confidence FROM long WHERE term = {TERM}")
def report_current_term(spark, d):
    return _long(_suppliers(spark, d, _NOW)).drop("term", "samples")


@_register(f"WITH {A.SUPPLIERS}{_LONG} SELECT entity, criterion, sum(samples) AS samples FROM long GROUP BY entity, criterion")
def report_total_samples(spark, d):
    return _long(_suppliers(spark, d)).groupBy("entity", "criterion").agg(F.sum("samples").alias("samples"))


@_register(f"WITH {A.SUPPLIERS} SELECT entity, sum(n_content) AS review_samples, coalesce(sum(n_course), 0) AS survey_samples FROM wide GROUP BY entity")
def report_source_samples(spark, d):
    return _suppliers(spark, d).groupBy("entity").agg(F.sum("n_content").alias("review_samples"), F.coalesce(F.sum("n_course"), F.lit(0.0)).alias("survey_samples"))


@_register(f"""WITH {A.SUPPLIERS} SELECT entity, CASE WHEN b_content IS NULL THEN ' - ' ELSE CASE WHEN b_content >= 0 THEN '+' ELSE '' END || printf('%.2f', b_content) END AS shown,
CASE WHEN b_content IS NULL THEN 'N/A' ELSE printf('%.3f', b_content) END AS charted FROM wide WHERE term = {TERM}""")
def report_formatted(spark, d):
    return _suppliers(spark, d, _NOW).select("entity", S.signed(F.col("b_content")).alias("shown"), S.chart_value(F.col("b_content")).alias("charted"))


@_register(f"WITH {A.PARTS} SELECT entity, term, {', '.join(f'b_{c} AS {c}' for c in A.CRITERIA)} FROM wide WHERE term < {TERM}")
def trend_pivot(spark, d):
    rows = _long(_parts(spark, d, (None, TERM)))
    return rows.groupBy("entity", "term").pivot("criterion", list(A.CRITERIA)).agg(F.first("bayesian", ignorenulls=True))


@_register(f"WITH {A.PARTS}{_LONG} SELECT DISTINCT entity, term FROM long WHERE samples > 0")
def trend_terms_distinct(spark, d):
    return _long(_parts(spark, d)).where("samples > 0").select("entity", "term").distinct()


@_register(f"WITH {A.SUPPLIERS} SELECT DISTINCT l_suppkey AS entity, string_agg(name, '; ' ORDER BY p) AS historic FROM (SELECT DISTINCT l_suppkey, p_brand AS name, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1 < 21) GROUP BY l_suppkey")
def history_natural_sort(spark, d):
    A.register(spark, d, "lineitem", "part")
    rows = spark.sql("SELECT DISTINCT l_suppkey AS entity, p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1 < 21")
    keyed = rows.groupBy("entity").agg(F.array_sort(F.collect_set(S.natural_key(F.col("name")))).alias("k"))
    return keyed.select("entity", F.array_join(F.transform("k", lambda x: x["c"]), "; ").alias("historic"))


_EWMA = f"""WITH RECURSIVE {A.SUPPLIERS}, o AS (SELECT entity, b_content AS x, row_number() OVER (PARTITION BY entity ORDER BY term) AS i FROM wide),
e AS (SELECT entity, i, x AS v FROM o WHERE i = 1 UNION ALL SELECT o.entity, o.i, e.v * (1e0 - 0.08425e0) + o.x * 0.08425e0 FROM e JOIN o ON o.entity = e.entity AND o.i = e.i + 1)
SELECT entity, v AS ewma FROM e QUALIFY row_number() OVER (PARTITION BY entity ORDER BY i DESC) = 1"""


@_register(_EWMA)
def ewma_by_entity(spark, d):
    rows = _suppliers(spark, d).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("term", "b_content"))).alias("t"))
    return rows.select("entity", R.ewma(F.col("t.b_content")).alias("ewma"))


def _sums(spark, d) -> DataFrame:
    return A.view(spark, d, A.SUPPLIERS, "sums", "lineitem").select("entity", "term", "s_content", "n_content")


@_register(f"WITH {A.SUPPLIERS} SELECT entity, term, b_content AS bayesian FROM wide")
def bayesian_average(spark, d):
    return R.smooth(_sums(spark, d), "s_content", "n_content", "term").select("entity", "term", (F.col("bayesian") / F.lit(50.0)).alias("bayesian"))


@_register(f"""WITH {A.SUPPLIERS}, m AS (SELECT term AS mt, CAST(sum(CAST(q AS DECIMAL(28,4))) AS DOUBLE) AS s, CAST(sum(CAST(q * q AS DECIMAL(28,4))) AS DOUBLE) AS ss, count(*) AS n FROM base GROUP BY term)
SELECT entity, term, (s_content / n_content - s / n) / sqrt(ss / n - s / n * (s / n)) AS z FROM sums JOIN m ON term = mt""")
def standardize(spark, d):
    raw = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr("(year(l_shipdate) - 1990) * 4 + quarter(l_shipdate) - 1").alias("t"), F.col("l_quantity").cast("decimal(18,4)").alias("q"))
    return R.standardize(_sums(spark, d), F.col("s_content") / F.col("n_content"), "term", raw, "q", "t").select("entity", "term", "z")


# terms
_TERMS = "SELECT DISTINCT lpad(CAST(year(l_shipdate) - 1990 AS VARCHAR), 2, '0') || CAST(quarter(l_shipdate) AS VARCHAR) || '0' AS code FROM lineitem"


def _terms(spark, d):
    A.register(spark, d, "lineitem")
    return spark.sql(_TERMS.replace("VARCHAR", "STRING"))


@_register(f"SELECT code, CAST(substr(code, 1, 2) AS INT) * 4 + CAST(substr(code, 3, 1) AS INT) - 1 AS num FROM ({_TERMS})")
def term_decode(spark, d):
    return _terms(spark, d).select("code", S.term_code_to_num(F.col("code")).alias("num"))


@_register(f"""SELECT code, CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) || ' ' || CASE n % 4 WHEN 0 THEN 'Fall' WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' ELSE 'Summer' END AS label
FROM (SELECT code, n, 2000 + n // 4 AS y FROM (SELECT code, CAST(substr(code, 1, 2) AS INT) * 4 + CAST(substr(code, 3, 1) AS INT) - 1 AS n FROM ({_TERMS})))""")
def term_format(spark, d):
    return _terms(spark, d).select("code", S.format_term(S.term_code_to_num(F.col("code"))).alias("label"))


@_register(f"SELECT max(code) AS code FROM ({_TERMS})")
def current_term(spark, d):
    return _terms(spark, d).agg(F.max("code").alias("code"))


# schedule
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_FIRST = f"WITH {A.CLASSES}, firsts AS (SELECT * FROM classes QUALIFY row_number() OVER (PARTITION BY number ORDER BY {', '.join(_ORDER)}) = 1) "
_ASK = ["0003", "0001", "0003", "9999", "0007"]


def _classes(spark, d) -> DataFrame:
    return A.view(spark, d, A.CLASSES, "classes", "lineitem")


def _firsts(spark, d) -> DataFrame:
    return C.first_class(_classes(spark, d), ["number"], _ORDER)


@_register(_FIRST + "SELECT number, section, l_partkey FROM firsts")
def class_lookup_first(spark, d):
    return _firsts(spark, d).select("number", "section", "l_partkey")


@_register(_FIRST + f", ask AS (SELECT unnest({_ASK}) AS req, unnest(range({len(_ASK)})) AS req_pos) SELECT CAST(req_pos AS INT) AS req_pos, number, section, l_partkey FROM ask JOIN firsts ON req = number")
def class_lookup_request_order(spark, d):
    return C.request(_firsts(spark, d), _ASK).select("req_pos", "number", "section", "l_partkey")


@_register(f"WITH {A.CLASSES} SELECT l_orderkey, count(*) AS n FROM classes WHERE l_orderkey IN (SELECT l_orderkey FROM classes WHERE number IN ('0003', '0007')) GROUP BY l_orderkey")
def cart_filter(spark, d):
    per = _classes(spark, d).groupBy("l_orderkey").agg(F.collect_list("number").alias("numbers"))
    return C.in_cart(per, ["0003", "0007"], F.col("numbers")).select("l_orderkey", F.size("numbers").cast("long").alias("n"))


@_register(f"WITH {A.CLASSES} SELECT l_orderkey, section, number FROM classes WHERE number IN ('0003', '0007')")
def cart_sections(spark, d):
    per = _classes(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("section", "number")).alias("c"))
    cart = F.array(F.lit("0003"), F.lit("0007"))
    return per.select("l_orderkey", F.explode(F.filter("c", lambda c: F.array_contains(cart, c["number"]))).alias("c")).select("l_orderkey", "c.section", "c.number")


@_register("SELECT unnest(['0001', '0003', '0007']) AS number EXCEPT SELECT '0003'")
def cart_union_except(spark, d):
    a, b = F.array(F.lit("0001"), F.lit("0003")), F.array(F.lit("0003"), F.lit("0007"))
    return spark.range(1).select(F.explode(F.array_except(F.array_union(a, b), F.array(F.lit("0003")))).alias("number"))


_RLE = ", ".join(_ORDER + ["l_quantity"])


@_register(f"""WITH {A.CLASSES}, x AS (SELECT *, CASE WHEN section IS NOT DISTINCT FROM lag(section) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS start FROM classes WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_RLE})),
y AS (SELECT *, sum(start) OVER (PARTITION BY l_suppkey ORDER BY {_RLE} ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, section, CASE WHEN start = 1 THEN count(*) OVER (PARTITION BY l_suppkey, run) ELSE 0 END AS section_span FROM y""")
def section_table_rowspan(spark, d):
    return C.merge_cells(_classes(spark, d), ["l_suppkey"], [*_ORDER, "l_quantity"], "section").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "section", "section_span")


_ROOM = "CASE " + " ".join(f"WHEN regexp_matches(venue, '{p.replace(chr(92) + 'w', '[0-9A-Za-z_]')}') THEN '{b}' || regexp_extract(venue, '{p.replace(chr(92) + 'w', '[0-9A-Za-z_]')}', 1)" for p, b in S.VENUES) + " END"


@_register(f"WITH {A.CLASSES} SELECT DISTINCT venue, {_ROOM} AS room, 'https://pathadvisor.example/room/' || {_ROOM} AS url FROM classes")
def venue_room_code(spark, d):
    return _classes(spark, d).select("venue").distinct().select("venue", S.room_code(F.col("venue")).alias("room"), S.room_url(F.col("venue")).alias("url"))


@_register(f"""WITH {A.CLASSES} SELECT DISTINCT venue, CASE WHEN regexp_matches(venue, '^(.*) \\((\\d+)\\)$') THEN CAST(regexp_extract(venue, '^(.*) \\((\\d+)\\)$', 2) AS INT) END AS capacity,
len(string_split(regexp_replace(venue, ' \\(\\d+\\)$', ''), ', ')) AS parts FROM classes""")
def venue_segments(spark, d):
    seg, cap = S.venue_segments(F.col("venue"))
    return _classes(spark, d).select("venue").distinct().select("venue", cap.alias("capacity"), F.size(seg).cast("long").alias("parts"))


@_register(f"WITH {A.CLASSES} SELECT l_orderkey, l_linenumber, l_partkey, CASE dayofweek(from_date) WHEN 0 THEN 'Su' WHEN 1 THEN 'Mo' WHEN 2 THEN 'Tu' WHEN 3 THEN 'We' WHEN 4 THEN 'Th' WHEN 5 THEN 'Fr' ELSE 'Sa' END AS days, CASE WHEN from_time IS NOT NULL THEN from_time || '-' || to_time ELSE '' END AS times FROM classes")
def weekday_and_time_labels(spark, d):
    days = F.array(F.dayofweek("from_date") - 1)
    return _classes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", S.weekday_labels(days).alias("days"), S.time_range(F.col("from_time"), F.col("to_time")).alias("times"))


_PASTE = f"WITH {A.CLASSES}, pasted AS (SELECT l_suppkey, string_agg(section || ' (' || number || ')', chr(10) ORDER BY {_RLE}) AS text FROM classes GROUP BY l_suppkey) "


@_register(_PASTE + "SELECT l_suppkey, unnest(n) AS number, unnest(range(len(n))) AS pos FROM (SELECT l_suppkey, regexp_extract_all(text, '(?m)^\\w{3} \\((\\d{4})\\)$', 1) AS n FROM pasted)")
def sis_parse(spark, d):
    rows = _classes(spark, d).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "l_quantity", F.concat("section", F.lit(" ("), "number", F.lit(")")).alias("line")))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: x["line"]), "\n")
    return rows.select("l_suppkey", F.posexplode(S.class_numbers(text)).alias("p", "number")).select("l_suppkey", "number", F.col("p").cast("long").alias("pos"))


def _flat(spark, d) -> DataFrame:
    c = _classes(spark, d)
    day = F.dayofweek("from_date") - 1
    return c.select(
        *_ORDER, "l_quantity", F.lit("COMP").alias("subject"), F.col("l_partkey").cast("string").alias("code"), "section", "number", F.array(F.lit("A, B"), F.lit("C, D")).alias("instructors"),
        "venue", "from_date", F.date_add("from_date", 91).alias("to_date"), F.array((day + 1) % 7, (day + 3) % 7).alias("weekdays"), "from_time", "to_time",
    )


@_register(f"""WITH {A.CLASSES}, x AS (SELECT *, unnest([1, 3]) AS k FROM classes WHERE from_time IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, k, from_date + CAST(k AS INT) + CAST(from_time AS TIME) - INTERVAL 8 HOUR AS start_utc, from_date + CAST(k AS INT) + CAST(to_time AS TIME) - INTERVAL 8 HOUR AS end_utc,
'FREQ=WEEKLY;UNTIL=' || strftime(from_date + 91 + CAST(to_time AS TIME) - INTERVAL 8 HOUR, '%Y%m%dT%H%M%SZ') AS rule,
'COMP ' || CAST(l_partkey AS VARCHAR) || ' ' || section AS title, 'Instructors: A, B, C, D' || chr(10) || 'Path Advisor: ' || coalesce('https://pathadvisor.example/room/' || {_ROOM}, 'undefined') AS description FROM x""")
def calendar_events(spark, d):
    return C.events(_flat(spark, d), ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("day_pos") * 2 + 1).alias("k"), "start_utc", "end_utc", "rule", "title", "description")


@_register()
def calendar_ics_text(spark, d):
    some = C.request(C.first_class(_flat(spark, d), ["number"], _ORDER), _ASK)
    return C.ics_text(C.events(some, ["req_pos"]), ["req_pos"])


# reactions
_RUN = """s AS (SELECT id, unified, delta, sum(delta) OVER (PARTITION BY id, unified ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM reactions),
c AS (SELECT id, unified, CAST(sum(delta) - least(0, min(s)) AS BIGINT) AS count FROM s GROUP BY id, unified) SELECT id, unified, count FROM c WHERE count > 0"""


def _reactions(spark, d) -> DataFrame:
    return A.view(spark, d, A.REACTIONS, "reactions", "events")


@_register(f"WITH {A.REACTIONS}, {_RUN}")
def reaction_counts(spark, d):
    return X.counts(_reactions(spark, d), ["ts", "event_id"])


@_register("""WITH reactions AS (SELECT event_id, ts, event_type AS id, event_type AS unified, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) % 2 = 1 THEN 1 ELSE -1 END AS delta FROM events), """ + _RUN)
def reaction_toggle(spark, d):
    clicks = _reactions(spark, d).select("event_id", "ts", F.col("id").alias("user"), F.col("unified").alias("id"), "unified")
    return X.counts(X.toggles(clicks, ["ts", "event_id"]), ["ts", "event_id"])


@_register(f"WITH {A.REACTIONS}, k AS ({'WITH ' + _RUN}) SELECT id, string_agg(unified || '=' || CAST(count AS VARCHAR), ',' ORDER BY unified) AS counts FROM k GROUP BY id")
def reaction_map(spark, d):
    got = X.snapshot(X.counts(_reactions(spark, d), ["ts", "event_id"]))
    return got.select("id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


# text
@_register("SELECT c_custkey, 'https://search.example/?q=' || replace(replace(replace(url_encode('site:people.example ' || c_name), '%20', '+'), '~', '%7E'), '%2A', '*') AS url, c_name AS family, '' AS given FROM customer")
def profile_url(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", S.profile_url(F.col("c_name")).alias("url"), S.family_name(F.col("c_name")).alias("family"), S.given_names(F.col("c_name")).alias("given"))


def formula_column(text: str):
    return compile_formula(text, R.scope())
