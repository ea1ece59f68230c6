import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gradus.functions import scalars as S
from gradus.functions.formula import FormulaError, compile_formula
from gradus.functions.search import compile_search
from gradus.operators import ranking as R
from gradus.operators import schedule as C
from gradus.streaming import reactions as X

CRITERIA = ("content", "teaching", "grading", "workload", "course", "instructor")


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def slices(spark, rows):
    names = ["ord", *[f"{p}_{c}" for c in CRITERIA for p in "rbcn"]]
    schema = "ord long, " + ", ".join(f"{n} double" for n in names[1:])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_gates(spark):
    df = slices(spark, [{"ord": 1, "c_content": 0.5}, {"ord": 2, **{f"c_{c}": 0.0 for c in CRITERIA}}, {"ord": 3, **{f"c_{c}": -0.5 for c in CRITERIA}}])
    assert [r.ord for r in R.gate_any(df).orderBy("ord").collect()] == [1, 3]
    assert [r.ord for r in R.gate_all(df).collect()] == [3]


def test_missing_is_zero_ties_and_percentile(spark):
    df = slices(spark, [{"ord": 0, "b_course": 0.6}, {"ord": 1}, {"ord": 2}, {"ord": 3}])
    got = R.rank(df, R.INSTRUCTOR_FORMULA).orderBy("rank").collect()
    assert got[0].score == pytest.approx(0.05)
    assert [(r.ord, r["rank"], r.percentile) for r in got] == [(0, 1, 1.0), (1, 2, 0.75), (2, 3, 0.5), (3, 4, 0.25)]
    assert [r.g for r in R.rank(df, "1").orderBy("rank").select(S.letter_grade(F.col("percentile")).alias("g")).collect()] == ["A+", "A-", "B", "C"]


def test_nan_last_and_bad_formula(spark):
    df = slices(spark, [{"ord": 0}, {"ord": 1, "b_content": 1.0}])
    assert [r.ord for r in R.rank(df, "content.bayesian / content.bayesian").orderBy("rank").collect()] == [1, 0]
    assert R.rank(df, "content.").count() == 0


@pytest.mark.parametrize("text,value", [("2^3^2", 512.0), ("-2^2", -4.0), ("7 % -3", -2.0), ("1 +\n2 * 3", 7.0), ("max(1, 2) > 1 and not 0 ? 5 : 6", 5.0), ("1/0", float("inf")), ("log(8, 2)", 3.0)])
def test_formula(spark, text, value):
    assert one(spark, compile_formula(text, {})) == pytest.approx(value)


def test_formula_errors():
    for bad in ("1 +", "foo(1)", "a.b", "1 2", "$"):
        with pytest.raises(FormulaError):
            compile_formula(bad, {})


def _within(v, tok, k):
    row = [0] * (len(v) + 1)
    for i, c in enumerate(tok, 1):
        new = [i]
        for j in range(1, len(v) + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != v[j - 1])))
        row = new
    return min(row) <= k


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("ab1") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r.m for r in df.select(compile_search("aab1a", F.array("v"), 0.2).alias("m")).collect()]
    assert got == [w != "" and _within(w, "aab1a", 1) for w in words]


def test_search_grammar(spark):
    values = F.array(F.lit("COMP"), F.lit("Chan, Tai Man"))
    for query, want in (("=comp", True), ("^ch", True), ("man$", True), ("!^comp", True), ("comp chan", False), ("comp | zzz", True), ('"tai man"', True), (" ", False), ("", True)):
        assert one(spark, compile_search(query, values)) is want, query


def test_scalars(spark):
    room = lambda v: one(spark, S.room_code(F.lit(v)))
    cases = {"Rm 1409, Lift 25-26 (60)": "1409", "Lecture Theater A": "LTA", "G001, CYT Bldg": "CYTG001", "G001, LSK Bldg (70)": "LSKG001", "Rm 103, Shaw Auditorium": "SA103", "Rm 1104, xxx": "1104", "TBA": None}
    assert {v: room(v) for v in cases} == cases
    assert one(spark, S.class_numbers(F.lit("LEC (1234)\nL01 (2345)\nLA01 (9999)\nT1A (12345)\nT1B (4321)"))) == ["1234", "2345", "4321"]
    assert [one(spark, S.term_code_to_num(F.lit(c))) for c in ("2410", "2420", "2440", "x")] == [96, 97, 99, None]
    assert [one(spark, S.format_term(F.lit(n))) for n in (96, 99)] == ["2024-2025 Fall", "2024-2025 Summer"]
    assert [one(spark, S.signed(F.lit(x).cast("double"))) for x in (0.5, -0.004, float("nan"), None)] == ["+0.50", "-0.00", " - ", " - "]
    assert one(spark, S.weekday_labels(F.array(F.lit(1), F.lit(3)))) == "MoWe"
    seg, cap = S.venue_segments(F.lit("Rm 2463, Lift 25-26 (122)"))
    assert (one(spark, seg), one(spark, cap)) == (["Rm 2463, ", "Lift 25-26"], 122)
    assert one(spark, S.css_color(S.grade_color(F.lit(0.25)))) == "rgb(250, 166, 26)"


def test_row_spans(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("aaba")], "g int, i int, k string")
    assert [r.k_span for r in C.merge_cells(df, ["g"], ["i"], "k").orderBy("i").collect()] == [2, 0, 1, 1]


def test_calendar(spark):
    row = (0, "COMP", "1023", "L1", ["A"], "TBA", dt.date(2024, 9, 2), dt.date(2024, 11, 30), [1, 0], "09:00", "10:20")
    schema = "o int, subject string, code string, section string, instructors array<string>, venue string, from_date date, to_date date, weekdays array<int>, from_time string, to_time string"
    got = C.events(spark.createDataFrame([row, (*row[:9], None, "10:20")], schema), ["o"]).orderBy("day_pos").collect()
    assert [r.start_utc for r in got] == [dt.datetime(2024, 9, 2, 1), dt.datetime(2024, 9, 8, 1)]
    assert {r.rule for r in got} == {"FREQ=WEEKLY;UNTIL=20241130T022000Z"}
    assert "undefined" in got[0].description


def test_reactions_against_replay(spark):
    rng, rows, want = random.Random(1), [], {}
    for pos in range(400):
        k = rng.choice("xyz")
        d = rng.choice((-1, 1))
        rows.append(("p", k, d, pos))
        want[k] = max(0, want.get(k, 0) + d)
    got = X.counts(spark.createDataFrame(rows, "id string, unified string, delta int, pos int"), ["pos"]).collect()
    assert {r.unified: r["count"] for r in got} == {k: v for k, v in want.items() if v}


def test_reaction_stream(spark, tmp_path):
    rows = [("p", "a", d, i) for i, d in enumerate((-1, 1, 1, -1))]
    spark.createDataFrame(rows, "id string, unified string, delta int, pos int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, unified string, delta int, pos int").parquet(str(tmp_path / "in"))
    q = X.stream_counts(stream).writeStream.outputMode("update").format("memory").queryName("r").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r.unified, r["count"]) for r in spark.sql("select * from r").collect()] == [("a", 1)]


def test_readers(spark, tmp_path):
    from gradus.sources import readers

    (tmp_path / "i.json").write_text('[{"meta": {"name": "Chan, A", "courses": {"96": [{"subject": "COMP", "code": "1"}]}}, "ratings": {"content": {"rating": {"96": 0.5}, "bayesian": {"96": 0.4}, "confidence": {"96": 0.3}, "samples": {"96": 7}}}}]')
    got = readers.term_slice(readers.read_instructor_ratings(spark, str(tmp_path / "i.json")), 96).first()
    assert (got.r_content, got.b_content, got.c_content, got.n_content, got.r_course) == (0.5, 0.4, 0.3, 7.0, None)


def test_rank_by_ranges_equals_one_window(spark):
    rng = random.Random(6)
    rows = [{"ord": i, "b_content": rng.choice([0.1, 0.2, rng.random(), None])} for i in range(3000)]
    df = slices(spark, rows)
    formula = "content.bayesian == 0.2 ? 0/0 : content.bayesian"  # some are NaN, many are equal
    one, many = ([(r.ord, r["rank"], r.percentile) for r in R.rank(df, formula, one_task=limit).orderBy("ord").collect()] for limit in (10**30, 0))
    assert one == many and R.rank(df.where("false"), formula, one_task=0).count() == 0


def test_default_formulas():
    assert R.COURSE_FORMULA != R.INSTRUCTOR_FORMULA
    assert [w for w in R.COURSE_FORMULA.split() if w.startswith("0.")] == ["0.40", "0.40", "0.15", "0.05", "0.75", "0.25"]


def test_json_readers(spark, tmp_path):
    from gradus.sources import readers

    cube = '"ratings": {"content": {"rating": {"96": 0.5}, "bayesian": {"96": 0.4}, "confidence": {"96": 0.3}, "samples": {"96": 7}}}'
    (tmp_path / "c.json").write_text('[{"meta": {"subject": "COMP", "code": "1021", "instructors": {"96": ["Chan, A"], "97": []}}, ' + cube + "}]")
    course = readers.read_course_ratings(spark, str(tmp_path / "c.json"))
    from gradus.operators import entities as E

    assert course.select(E.offered(F.col("meta.instructors"), 96), E.offered(F.col("meta.instructors"), 97), E.offered(F.col("meta.instructors"), 98)).first()[:] == (True, False, False)
    assert course.select(E.course_values(F.col("meta.subject"), F.col("meta.code"), F.col("meta.instructors")).alias("v")).first().v == ["COMP", "1021", "COMP 1021", "Chan, A"]
    (tmp_path / "t.json").write_text('[{"term": "2410", "termName": "Fall"}]')
    klass = '{"section": "L1", "number": "0001", "schedule": [{"instructors": ["A"], "venue": "TBA", "fromDate": "2024-09-02", "toDate": "2024-11-30", "weekdays": [1], "fromTime": "09:00", "toTime": "10:20"}]}'
    (tmp_path / "s.json").write_text("[" + ", ".join(f'{{"term": "{t}", "termName": "x", "cq": [{{"subject": "COMP", "number": "1", "code": "COMP 1", "classes": [{klass}]}}]}}' for t in ("2410", "2420")) + "]")
    terms = readers.read_terms(spark, str(tmp_path / "t.json"))
    found = readers.read_schedules(spark, str(tmp_path / "s.json"), terms)
    assert [r.term for r in found.collect()] == ["2410"]
    table = C.section_table(found.select("ord", "course")).first()
    assert (table.section, table.schedule, table.venue_span) == ("L1", "2024-09-02 2024-11-30 Mo 09:00-10:20", 1)
    readers.write_by_term(found.select("term", "termName"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "g.json").write_text('[{"courseCode": "COMP1", "courseName": "One", "courseAttributes": []}, {"courseCode": "COMP1", "courseName": "Two", "courseAttributes": []}]')
    assert R.catalog_index(readers.read_catalog(spark, str(tmp_path / "g.json"))).first().courseName == "Two"
    (tmp_path / "bad.json").write_text('[{"term": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_terms(spark, str(tmp_path / "bad.json")).collect()


def test_lists_of_a_term(spark):
    from gradus.operators import entities as E

    lists = F.create_map(F.lit("95"), F.array(F.lit("B 10"), F.lit("B 9"), F.lit("B 9")), F.lit("97"), F.array(F.lit("C 1")))
    assert one(spark, E.current_list(lists, 96)) == [] and one(spark, E.historic_list(lists, 96)) == ["B 9", "B 10"]
    assert one(spark, E.current_list(lists, 95)) == ["B 9", "B 9", "B 10"]
    assert one(spark, S.criterion_label(F.lit("Course (SFQ)"))) == "Course\n(SFQ)"
    assert one(spark, E.calendar_link("x.example", F.lit("2410"), F.array(F.lit("1"), F.lit("1")), True)) == "webcal://x.example?term=2410&number=1&number=1&webcal=1"


def test_icalendar_text(spark):
    long = "x" * 180
    row = (0, 0, f"COMP 1;{long}", "Rm 1, y", dt.datetime(2024, 9, 2, 1), dt.datetime(2024, 9, 2, 2), "FREQ=WEEKLY;UNTIL=20241130T022000Z", "a\nb")
    rows = spark.createDataFrame([row], "o int, day_pos int, title string, venue string, start_utc timestamp_ntz, end_utc timestamp_ntz, rule string, description string")
    text = C.ics_text(rows, ["o"]).first().text
    lines = text.split("\r\n")
    assert max(map(len, lines)) <= 75 and lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""]
    whole = text.replace("\r\n ", "").split("\r\n")
    assert whole[1:4] == ["VERSION:2.0", "PRODID:-//gradus//EN", "BEGIN:VEVENT"] and whole[5:] == [
        "DTSTAMP:20240101T000000Z", "DTSTART:20240902T010000Z", "DTEND:20240902T020000Z", "RRULE:FREQ=WEEKLY;UNTIL=20241130T022000Z", f"SUMMARY:COMP 1\\;{long}",
        "LOCATION:Rm 1\\, y", "DESCRIPTION:a\\nb", "END:VEVENT", "END:VCALENDAR", "",
    ]
    assert "Content-Disposition" in C.ics_headers(None) and "Content-Disposition" not in C.ics_headers("1")


def test_reaction_table(spark, tmp_path):
    rows = [("p", "a", 1, 0), ("p", "b", 1, 0), ("p", "b", 0, 1), ("q", "a", 3, 1)]
    table = X.latest(spark.createDataFrame(rows, "id string, unified string, count long, batch int"))
    got = {r.k: r.counts for r in X.point_read(spark.createDataFrame([("p",), ("z",)], "k string"), "k", table).collect()}
    assert got == {"p": {"a": 1}, "z": {}}


def test_entry_imports():
    import __spark_entry__ as e

    assert "rank_letter_grade" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
