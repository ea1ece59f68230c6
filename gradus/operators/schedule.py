"""Class lookup, section tables with merged cells, and calendar events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def first_class(classes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of classes with equal keys the first."""
    w = W.partitionBy(*keys).orderBy(*order)
    return classes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def request(classes: DataFrame, numbers: list[str], key: str = "number") -> DataFrame:
    """Requested classes in request order, repeats kept, misses dropped."""
    want = classes.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, numbers))).alias("req_pos", "req"))
    return F.broadcast(want).join(classes, F.col("req") == F.col(key)).drop("req")  # as long as the request


def in_cart(df: DataFrame, cart: list[str], numbers: Column) -> DataFrame:
    return df.where(F.arrays_overlap(numbers, F.array(*map(F.lit, cart)))) if cart else df.where(F.lit(False))


def merge_cells(df: DataFrame, partition: list[str], order: list[str], column: str) -> DataFrame:
    """Run-length merge of a column: <column>_span (0 where the cell is merged into one above)."""
    w = W.partitionBy(*partition).orderBy(*order)
    start = (~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    out = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(W.partitionBy(*partition, "_run"))
    return out.withColumn(f"{column}_span", F.when(F.col("_start") == 1, size).otherwise(0).cast("long")).drop("_start", "_run")


def section_table(courses: DataFrame) -> DataFrame:
    """course rows (ord, course struct) -> one row a class and schedule with merged section, schedule, instructors and venue."""
    rows = courses.select("ord", F.posexplode("course.classes").alias("class_ord", "class"))
    rows = rows.select("ord", "class_ord", "class", F.posexplode("class.schedule").alias("sched_ord", "s"))
    rows = rows.select(
        "ord", "class_ord", "sched_ord", F.col("class.section").alias("section"),
        F.concat_ws(" ", F.col("s.fromDate"), F.col("s.toDate"), S.weekday_labels(F.col("s.weekdays")), S.time_range(F.col("s.fromTime"), F.col("s.toTime"))).alias("schedule"),
        F.array_join("s.instructors", "\n").alias("instructors"), F.col("s.venue").alias("venue"),
    )
    for c in ("section", "schedule", "instructors", "venue"):
        rows = merge_cells(rows, ["ord"], ["class_ord", "sched_ord"], c)
    return rows


def _time(t: Column) -> Column:
    """HH:mm as an interval."""
    return F.make_dt_interval(F.lit(0), F.substring(t, 1, 2).cast("int"), F.substring(t, 4, 2).cast("int"))


def events(classes: DataFrame, order: list[str]) -> DataFrame:
    """Flat schedules (subject, code, section, number, instructors, venue, from_date, to_date, weekdays, from_time, to_time) -> one weekly event a weekday."""
    rows = classes.where((F.col("from_time") != "") & (F.col("to_time") != ""))
    midnight = lambda d: d.cast("timestamp_ntz")
    room = F.coalesce(S.room_url(F.col("venue")), F.lit("undefined"))
    rows = rows.select(  # what does not depend on the weekday is worked out once a schedule
        *order, "venue", "from_date", "weekdays", _time(F.col("from_time")).alias("_from"), _time(F.col("to_time")).alias("_to"),
        S.weekly_rule(S.to_utc(midnight(F.col("to_date")) + _time(F.col("to_time")))).alias("rule"),
        F.concat_ws(" ", F.concat(F.col("subject"), F.lit(" "), F.col("code")), "section").alias("title"),
        F.concat(F.lit("Instructors: "), F.array_join("instructors", ", "), F.lit("\nPath Advisor: "), room).alias("description"),
    )
    rows = rows.select("*", F.posexplode("weekdays").alias("day_pos", "weekday"))
    day = midnight(S.first_on_weekday(F.col("from_date"), F.col("weekday")))
    return rows.select(*order, "day_pos", "title", "venue", "description", S.to_utc(day + F.col("_from")).alias("start_utc"), S.to_utc(day + F.col("_to")).alias("end_utc"), "rule")


def _folded(line: Column, width: int = 75) -> Column:
    """Lines of more than `width` characters go on in the next ones, after a blank."""
    cut = F.regexp_replace(line, rf"(?s)^(.{{{width}}})(?=.)", "$1\r\n ")
    rest = F.regexp_replace(line, rf"(?s)^.{{0,{width}}}", "")
    more = F.regexp_replace(rest, rf"(?s)(.{{{width - 1}}})(?=.)", "$1\r\n ")
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.regexp_extract(cut, rf"(?s)^(.{{{width}}}\r\n )", 1), more))


def ics_text(rows: DataFrame, order: list[str], stamp: str = "20240101T000000Z") -> DataFrame:
    """One iCalendar document (column `text`) of a request's events, in request order; as long as the request."""
    when = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,")), F.lit("\n"), F.lit("\\n"))
    fields = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in order], "title", when(F.col("start_utc"))))), F.lit(f"DTSTAMP:{stamp}"),
        F.concat(F.lit("DTSTART:"), when(F.col("start_utc"))), F.concat(F.lit("DTEND:"), when(F.col("end_utc"))), F.concat(F.lit("RRULE:"), F.col("rule")), F.concat(F.lit("SUMMARY:"), esc(F.col("title"))),
        F.concat(F.lit("LOCATION:"), esc(F.coalesce("venue", F.lit("")))), F.concat(F.lit("DESCRIPTION:"), esc(F.col("description"))), F.lit("END:VEVENT"),
    ]
    lines = F.concat_ws("\r\n", *map(_folded, fields))
    body = F.array_sort(F.collect_list(F.struct(*order, "day_pos", lines.alias("_text"))))
    head = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//gradus//EN\r\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda r: r["_text"]), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))


def ics_headers(webcal: str | None) -> dict[str, str]:
    """Headers of the answer: any text in `webcal` asks for the calendar itself, else it is a file to keep."""
    kind = {"Content-Type": "text/calendar"}
    return kind if webcal else kind | {"Content-Disposition": "attachment; filename=calendar.ics"}
