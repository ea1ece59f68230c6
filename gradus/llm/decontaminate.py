"""Benchmark decontamination by template canonicalisation, in built-in functions only.

A text is lowered and cut into words; names (a capitalised word amid a sentence), numbers and units after a number
become typed placeholders in its template. Hashes of WINDOW template words (built by doubling: two, four, eight) are
hash-joined with those of the benchmark; an item of fewer words is one window of its own width. An item is leaked by a document
if one occurrence in it has at least COVERAGE of the item's windows and agrees in its slots: every value that fills a placeholder
in the item stands for one value there. Each of these is tried as an occurrence: the hits of one alignment (pos - ipos), a run of
hits through which the place in the item grows (copies with words put in or left out), and all hits of the document (a scattered
copy). Windows with fewer than MIN_WORDS plain words say nothing and are left out; an item that has no others is matched by its
literal words. The benchmark side is broadcast up to BROADCAST_ROWS windows (counted); a larger one is joined by shuffle.

Cases: null and empty texts and items leak nothing; repeated rows give the result of one row; equal items are reported each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WINDOW, MIN_WORDS, COVERAGE = 8, 4, 0.4
BROADCAST_ROWS = 500_000
UNITS = "km|m|cm|mm|mi|miles?|kg|g|mg|lb|lbs|pounds?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|dollars?|euros?|cents?|litres?|liters?|l|ml"
_NAME = ""


def words_text(text: Column) -> Column:
    """Lower-case words divided by white space, names marked in front."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;:] )(?=\p{Lu}\p{Ll})", _NAME)
    return F.trim(F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}{_NAME}]+", " "))


def template_text(words: Column) -> Column:
    """The same words with placeholders; never more or fewer of them."""
    t = F.regexp_replace(words, rf"{_NAME}[^ ]+", "~name")
    t = F.regexp_replace(t, r"(?<![^ ])[^ ]*\p{N}[^ ]*", "~num")
    return F.regexp_replace(t, rf"(?<=~num )(?:{UNITS})(?![^ ])", "~unit")


def _split(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.split(c, " ")).otherwise(F.array().cast("array<string>"))


def window_hashes(words: str, width: str = str(WINDOW)) -> str:
    """SQL for the hashes of all windows of `width` (1 to WINDOW) of an array of words, from hashes of shorter ones."""
    h = f"transform({words}, w -> xxhash64(w))"
    for k in (f"least(1, {width} - 1)", f"greatest(least(2, {width} - 2), 0)", f"greatest({width} - 4, 0)"):
        # the pair of neighbours k apart, for every place that has one
        h = f"aggregate(array({h}), cast(array() as array<bigint>), (acc, a) -> zip_with(slice(a, 1, greatest(size(a) - {k}, 0)), slice(a, {k} + 1, greatest(size(a) - {k}, 0)), (x, y) -> xxhash64(x, y)))"
    return h


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, words, tmpl, width, lit (matched by literal words) and one row for each window: ipos, h."""
    it = items.where(F.col("text").isNotNull()).select("item_id", words_text(F.col("text")).alias("w"))
    it = it.select("item_id", _split(F.replace("w", F.lit(_NAME))).alias("words"), _split(template_text(F.col("w"))).alias("tmpl"))
    it = it.where(F.size("tmpl") > 0).withColumn("width", F.least(F.size("tmpl"), F.lit(WINDOW)))
    plain = f"filter(sequence(0, size(tmpl) - width), p -> size(filter(slice(tmpl, p + 1, width), x -> not startswith(x, '~'))) >= {MIN_WORDS})"
    it = it.withColumn("plain", F.expr(plain)).withColumn("lit", F.size("plain") == 0)
    # the first word of a short item may look like a name amid a sentence
    named = f"if(width < {WINDOW} and not lit, array(tmpl, concat(array('~name'), slice(tmpl, 2, width - 1))), array(if(lit, words, tmpl)))"
    it = it.withColumn("key", F.explode(F.array_distinct(F.expr(named))))
    rows = it.select("item_id", "words", "tmpl", "width", "lit", "plain", F.posexplode(F.expr(window_hashes("key", "width"))).alias("ipos", "h"))
    return rows.where("lit or array_contains(plain, ipos)").drop("plain")


def _occurrences(hits: DataFrame, by: list[str]) -> DataFrame:
    """The hits (ipos, pos), with the occurrences `part` that each may belong to."""
    off = hits.withColumn("off", F.col("pos") - F.col("ipos"))
    # at every place the hit of the longest alignment; a run ends where the place in the item falls back
    strong = off.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by, "off")))
    one = strong.groupBy(*by, "pos").agg(F.max(F.struct("n", -F.col("off"), "ipos")).alias("m")).select(*by, "pos", F.col("m.ipos").alias("ipos"))
    order = Window.partitionBy(*by).orderBy("pos")
    back = (F.col("ipos") <= F.lag("ipos").over(order)).cast("int")
    runs = one.withColumn("back", F.coalesce(back, F.lit(0))).withColumn("part", F.concat(F.lit("run"), F.sum("back").over(order)))
    cols = [*by, "ipos", "pos", "part"]
    return off.withColumn("part", F.concat(F.lit("at"), "off")).select(cols).union(runs.select(cols)).union(off.withColumn("part", F.lit("all")).select(cols))


def leaking(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_matched, n_windows, kind of every leak; n_matched is that of the best occurrence."""
    wins = saved(item_windows(items), "benchmark")
    total = wins.groupBy("item_id").agg(F.countDistinct("ipos").alias("n_windows"))
    small = wins.count() <= BROADCAST_ROWS
    if small:
        total = F.broadcast(total)
    base = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("th"), words_text(F.col("text")).alias("w"))
    by = ["doc_id", "th", "item_id"]
    parts = []
    for width, lit in sorted(map(tuple, wins.select("width", "lit").distinct().collect())) or [(WINDOW, False)]:  # at most two a width
        keys = wins.where((F.col("width") == width) & (F.col("lit") == lit)).select("item_id", F.col("ipos").cast("int").alias("ipos"), "h")
        arrays = base.select("doc_id", "th", _split(F.replace("w", F.lit(_NAME)) if lit else template_text(F.col("w"))).alias("key"))
        seen = arrays.select("doc_id", "th", F.posexplode(F.expr(window_hashes("key", str(width)))).alias("pos", "h"))
        parts.append(seen.join(F.broadcast(keys) if small else keys, "h").select(*by, "pos", "ipos"))
    hits = saved(reduce(DataFrame.union, parts), "hits")
    found = hits.groupBy(by).agg(F.countDistinct("ipos").alias("n")).join(total, "item_id").where(F.col("n") >= coverage * F.col("n_windows"))
    found = saved(found, "found")

    # documents with a leak: their own words tell exact copies from others and fill the slots
    matched = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    if matched.count() <= BROADCAST_ROWS // 4:
        matched = F.broadcast(matched)
    own = base.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "th"])
    own = own.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), _split(F.replace("w", F.lit(_NAME))).alias("dwords"))
    full = found.select(F.col("doc_id").alias("fd"), F.col("th").alias("ft"), F.col("item_id").alias("fi"), "n_windows")
    near = hits.join(full, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")) & (F.col("item_id") == F.col("fi")))
    near = saved(near.select(*by, "pos", "ipos", "n_windows").distinct(), "near")
    pairs = _occurrences(near, [*by, "n_windows"]).groupBy(*by, "n_windows", "part")
    pairs = pairs.agg(F.sort_array(F.collect_set(F.struct("ipos", "pos"))).alias("at"))  # at most a document's length
    pairs = pairs.withColumn("n_matched", F.expr("size(array_distinct(transform(at, a -> a.ipos)))").cast("long")).where(F.col("n_matched") >= coverage * F.col("n_windows"))
    whole = wins.groupBy("item_id").agg(F.first("words").alias("iwords"), F.first("tmpl").alias("tmpl"), F.first("width").alias("width"))
    joined = pairs.join(own, (pairs.th == own.t) & pairs.doc_id.eqNullSafe(own.d)).join(whole, "item_id")
    slots = """array_distinct(flatten(transform(at, a -> transform(
        filter(sequence(0, width - 1), k -> startswith(tmpl[a.ipos + k], '~')),
        k -> struct(tmpl[a.ipos + k] as kind, iwords[a.ipos + k] as i, dwords[a.pos + k] as d)))))"""
    same = "forall(at, a -> slice(iwords, a.ipos + 1, width) = slice(dwords, a.pos + 1, width))"
    plain = "forall(at, a -> forall(sequence(0, width - 1), k -> startswith(tmpl[a.ipos + k], '~') or iwords[a.ipos + k] = dwords[a.pos + k]))"
    out = joined.withColumn("slots", F.expr(slots)).withColumn("exact", F.expr(same))
    out = out.where(F.expr(f"exact or ({plain} and size(array_distinct(transform(slots, s -> struct(s.kind, s.i)))) = size(slots))"))
    out = out.groupBy(by).agg(F.max(F.struct("exact", "n_matched")).alias("best"), F.first("n_windows").alias("n_windows"))
    return out.select(*by, F.col("best.n_matched").alias("n_matched"), "n_windows", F.when(F.col("best.exact"), "exact").otherwise("template").alias("kind"))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, kind ('exact' or 'template') of every leak."""
    return leaking(docs, items, coverage).drop("th")


def without_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns; a leak is known by its text, whatever the id."""
    bad = leaking(docs.select("doc_id", "text"), items, coverage).select("doc_id", "th").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")), "left_anti").select("row.*")
