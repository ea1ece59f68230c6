"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: grade thresholds
GRADES = ((0.9, "A+"), (0.8, "A"), (0.75, "A-"), (0.6, "B+"), (0.45, "B"), (0.35, "B-"), (0.3, "C+"), (0.25, "C"), (0.2, "C-"), (0.1, "D"))
#: fixed values: colour stops
STOPS = ((0.0, (237, 27, 47)), (0.25, (250, 166, 26)), (0.75, (163, 207, 98)), (1.0, (0, 154, 97)))
#: fixed values: venue shapes, tried in order, and what stands before the room
VENUES = ((r"Rm (\w+), Lift", ""), (r"Lecture Theater (\w+)", "LT"), (r"(\w+), CYT Bldg", "CYT"), (r"(\w+), LSK Bldg", "LSK"), (r"Rm (\w+), Shaw Auditorium", "SA"), (r"Rm (\w+)", ""))
#: fixed values: names of seasons and weekdays
SEASONS = ("Fall", "Winter", "Spring", "Summer")
WEEKDAYS = ("Su", "Mo", "Tu", "We", "Th", "Fr", "Sa")


def term_code_to_num(code: Column) -> Column:
    """`YYSx` -> YY*4 + S-1; other text gives null."""
    return F.substring(code, 1, 2).try_cast("int") * 4 + F.substring(code, 3, 1).try_cast("int") - 1


def format_term(n: Column) -> Column:
    year = (F.lit(2000) + F.floor(n / 4)).cast("int")
    season = F.element_at(F.array(*map(F.lit, SEASONS)), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    return F.concat(year.cast("string"), F.lit("-"), (year + 1).cast("string"), F.lit(" "), F.when(n < 0, F.when(n % 4 == 0, F.lit("Fall")).otherwise("undefined")).otherwise(season))


def letter_grade(p: Column) -> Column:
    out = F.when(p.isNull() | F.isnan(p), "F")
    for at, grade in GRADES:
        out = out.when(p >= F.lit(at), grade)
    return out.otherwise("F")


def grade_color(p: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue; 0 outside 0 to 1."""

    def channel(k: int) -> Column:
        out = F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), 0)
        for (lo, a), (hi, b) in zip(STOPS, STOPS[1:], strict=False):
            out = out.when(p <= hi, F.floor(F.lit(float(a[k])) + (p - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(b[k] - a[k])) + F.lit(0.5)).cast("int"))
        return out.otherwise(0)

    return channel(0), channel(1), channel(2)


def css_color(rgb: tuple[Column, Column, Column]) -> Column:
    return F.format_string("rgb(%d, %d, %d)", *rgb)


def signed(x: Column) -> Column:
    """Two decimals with a sign; missing or NaN is ` - `."""
    return F.when(x.isNull() | F.isnan(x), " - ").otherwise(F.concat(F.when(x >= 0, "+").otherwise(""), F.call_function("format_number", x, F.lit("0.00"))))


def chart_value(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "N/A").otherwise(F.call_function("format_number", x, F.lit("0.000")))


def room_code(venue: Column) -> Column:
    """The room of a venue, null if it has no known shape; each shape is matched once (a match is never empty)."""
    out = []
    for pattern, before in VENUES:
        room = F.nullif(F.regexp_extract(venue, pattern, 1), F.lit(""))
        out.append(F.concat(F.lit(before), room) if before else room)
    return F.coalesce(*out)


def room_url(venue: Column, prefix: str = "https://pathadvisor.example/room/") -> Column:
    return F.concat(F.lit(prefix), room_code(venue))


def class_numbers(text: Column) -> Column:
    """Class numbers in pasted timetable text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\w{3} \((\d{4})\)$"), F.lit(1))


def weekday_labels(days: Column) -> Column:
    names = F.array(*map(F.lit, WEEKDAYS))
    return F.array_join(F.transform(days, lambda d: F.element_at(names, d + 1)), "")


def time_range(start: Column, end: Column) -> Column:
    return F.when((start != "") & (end != ""), F.concat(F.substring(start, 1, 5), F.lit("-"), F.substring(end, 1, 5))).otherwise("")


def venue_segments(venue: Column) -> tuple[Column, Column]:
    """Segments (separators kept but on the last) and the capacity, null if none."""
    shape = r"^(.*) \((\d+)\)$"
    has = venue.rlike(shape)
    parts = F.split(F.when(has, F.regexp_extract(venue, shape, 1)).otherwise(venue), ", ")
    segments = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(", "))).otherwise(x))
    return segments, F.when(has, F.regexp_extract(venue, shape, 2).cast("int"))


def family_name(name: Column) -> Column:
    return F.element_at(F.split(name, ", "), 1)


def given_names(name: Column) -> Column:
    parts = F.split(name, ", ")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")


def profile_url(name: Column, base: str = "https://search.example/?q=", site: str = "site:people.example") -> Column:
    return F.concat(F.lit(base), F.url_encode(F.concat(F.lit(site + " "), name)))


def criterion_label(label: Column) -> Column:
    at = F.instr(label, " ")
    return F.when(at > 0, F.concat(F.substr(label, F.lit(1), at - 1), F.lit("\n"), F.substr(label, at + 1))).otherwise(label)


def natural_key(text: Column) -> Column:
    """Sort key: text before the first number, that number, the text."""
    return F.struct(F.regexp_extract(text, r"^(\D*)", 1).alias("a"), F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("long"), F.lit(-1)).alias("b"), text.alias("c"))


def first_on_weekday(day: Column, weekday: Column) -> Column:
    """The first date from `day` on that is the weekday (0 is Sunday)."""
    return F.date_add(day, F.pmod(weekday - (F.dayofweek(day) - 1), F.lit(7)).cast("int"))


def to_utc(local: Column, zone: str = "Asia/Hong_Kong") -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def weekly_rule(until_utc: Column) -> Column:
    return F.concat(F.lit("FREQ=WEEKLY;UNTIL="), F.date_format(until_utc, "yyyyMMdd'T'HHmmss'Z'"))
