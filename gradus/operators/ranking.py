"""Gates, scores, ranks and percentiles over flat term slices (r_, b_, c_, n_ by criterion)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formula import FormulaError, compile_formula
from ..functions.search import compile_search
from ..sources.readers import CRITERIA
from ..storage import saved

#: fixed values: the default formulas of the two views
INSTRUCTOR_FORMULA = """content.bayesian * 2 / 3 * 0.40 + teaching.bayesian * 2 / 3 * 0.40 + grading.bayesian * 2 / 3 * 0.15 + workload.bayesian * 2 / 3 * 0.05 +
course.bayesian * 1 / 3 * 0.25 + instructor.bayesian * 1 / 3 * 0.75"""
COURSE_FORMULA = """content.bayesian * 2 / 3 * 0.40 + teaching.bayesian * 2 / 3 * 0.40 + grading.bayesian * 2 / 3 * 0.15 + workload.bayesian * 2 / 3 * 0.05 +
course.bayesian * 1 / 3 * 0.75 + instructor.bayesian * 1 / 3 * 0.25"""
#: estimated bytes up to which all rows may be ranked in one task
ONE_TASK = 2 << 30
RANGES, PER_RANGE = 200, 50


def _truthy(c: Column) -> Column:
    return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))


def gate_any(df: DataFrame) -> DataFrame:
    """Some criterion has a confidence."""
    ok = F.lit(False)
    for c in CRITERIA:
        ok = ok | _truthy(F.col(f"c_{c}"))
    return df.where(ok)


def gate_all(df: DataFrame) -> DataFrame:
    """Every criterion has a confidence."""
    ok = F.lit(True)
    for c in CRITERIA:
        ok = ok & _truthy(F.col(f"c_{c}"))
    return df.where(ok)


def scope() -> dict[tuple[str, str], Column]:
    return {(c, name): F.coalesce(F.col(f"{p}_{c}"), F.lit(0.0)) for c in CRITERIA for p, name in (("r", "rating"), ("b", "bayesian"))}


def rank(df: DataFrame, formula: str, order: str = "ord", partition: list[str] | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """score, rank (position; ties keep `order`, which is unique), percentile. A bad formula gives no rows.

    Without `partition` the ranks are global. A table that the planner puts at `one_task` bytes at most is ranked by one window; a larger one
    by ranges of (score, order), each in a task of its own (see _positions). With `partition` (a term, say) a window runs for each.
    """
    try:
        score = compile_formula(formula, scope())
    except FormulaError:
        return df.where(F.lit(False)).withColumns({"score": F.lit(0.0), "rank": F.lit(0).cast("long"), "percentile": F.lit(0.0)})
    out = df.withColumn("score", score)
    best = -F.coalesce(F.col("score"), F.lit(0.0))
    if partition is None and estimated_bytes(df) > one_task:
        out = _positions(out.withColumn("_best", best), order).drop("_best")
    else:
        w = W.partitionBy(*(partition or [])).orderBy(best.asc(), F.col(order).asc())
        out = out.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*(partition or []))))
    return out.withColumn("percentile", F.lit(1.0) - (F.col("rank") - 1) / F.col("_n")).drop("_n")


def estimated_bytes(df: DataFrame) -> int:
    """What the planner expects of the result; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _positions(df: DataFrame, order: str, ranges: int = RANGES, per_range: int = PER_RANGE) -> DataFrame:
    """rank (place by _best, then `order`) and _n (rows in all), without one task that sees all rows.

    A sample by hash of about ranges * per_range rows, whatever the input, gives the bounds of the ranges; the ranges are counted, and a row's
    place is the rows of earlier ranges plus its place within its own.
    """
    rows = saved(df, "ranked")
    total = rows.count()
    share = min(1.0, ranges * per_range / max(total, 1))
    kept = F.xxhash64(order) <= min(int(share * 2**64) - 2**63, 2**63 - 1)
    # a NaN is last; a struct compares by its members in turn
    some = rows.where(kept).select("_best", F.col(order).alias("_ord")).orderBy("_best", "_ord").limit(4 * ranges * per_range).collect()
    bounds = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    kind = df.schema[order].dataType
    listed = [F.struct(F.lit(float(b["_best"])).alias("b"), F.lit(b["_ord"]).cast(kind).alias("o")) for b in bounds]
    own = F.struct(F.col("_best").alias("b"), F.col(order).alias("o"))
    part = F.size(F.filter(F.array(*listed), lambda x: x <= own)) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_k")).withColumnRenamed("_part", "_p")
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    joined = rows.join(F.broadcast(before.drop("_k")), F.col("_part") == F.col("_p"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_best", order))
    return joined.withColumn("rank", (F.col("_before") + inside).cast("long")).withColumn("_n", F.lit(total)).drop("_part", "_p", "_before")


def search(df: DataFrame, query: str, values: Column, threshold: float = 0.1) -> DataFrame:
    """Keeps matching rows with the ranks they have."""
    return df if query == "" else df.where(compile_search(query, values, threshold))


def filter_courses(df: DataFrame, offered: Column | None = None, areas: list[str] | None = None, attributes: str = "attributes") -> DataFrame:
    """After ranking: offered in the term, and an attribute CC22 with one of the area values. No flags keep all."""
    ok = F.lit(True)
    if offered is not None:
        ok = ok & F.coalesce(offered, F.lit(False))
    if areas:
        ok = ok & F.coalesce(F.exists(F.col(attributes), lambda a: (a["courseAttribute"] == "CC22") & a["courseAttributeValue"].isin(areas)), F.lit(False))
    return df.where(ok)


def catalog_index(catalog: DataFrame, order: str = "ord") -> DataFrame:
    """Of rows with the same courseCode the last one."""
    rest = [c for c in catalog.columns if c != "courseCode"]
    got = catalog.groupBy("courseCode").agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return got.select("courseCode", "row.*")


def smooth(df: DataFrame, total: str, n: str, by: str) -> DataFrame:
    """Adds bayesian, ((mn*mr)+(n*r))/(mn+n) with r = total/n; mn and mr are the mean count of an entity and the mean rating within `by`.

    The means come from one aggregate of the entities, a row for each value of `by`.
    """
    means = df.where(F.col(n) > 0).groupBy(F.col(by).alias("_by")).agg((F.sum(n) / F.count(F.lit(1))).alias("_mn"), (F.sum(F.col(total).cast("decimal(28,4)")).cast("double") / F.sum(n)).alias("_mr"))
    value = (F.col("_mn") * F.col("_mr") + F.col(total)) / (F.col("_mn") + F.col(n))
    return df.join(means, F.col(by) == F.col("_by")).withColumn("bayesian", F.when(F.col(n) > 0, value)).drop("_by", "_mn", "_mr")


def standardize(df: DataFrame, value: Column, by: str, raw: DataFrame, raw_value: str, raw_by: str) -> DataFrame:
    """Adds z, (value - mean) / deviation, with both over the raw rows of the same `by` (population, by exact sums)."""
    x = F.col(raw_value)
    exact = lambda c: F.sum(c.cast("decimal(28,4)")).cast("double")
    m = raw.groupBy(F.col(raw_by).alias("_by")).agg(exact(x).alias("_s"), exact(x * x).alias("_ss"), F.count(F.lit(1)).alias("_k"))
    mean = F.col("_s") / F.col("_k")
    return df.join(m, F.col(by) == F.col("_by")).withColumn("z", (value - mean) / F.sqrt(F.col("_ss") / F.col("_k") - mean * mean)).drop("_by", "_s", "_ss", "_k")


def ewma(values: Column, alpha: float = 0.08425) -> Column:
    """Exponentially weighted mean of an array in time order; the first value starts it."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)
