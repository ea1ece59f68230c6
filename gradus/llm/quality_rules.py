"""Quality rules by isolation forest on rule statistics.

Trees split random features at random values over small samples of well-labelled documents; the fewer
splits isolate a document, the more anomalous it is: score 2^(-mean path / c(sample)). The labelled rows that pass the base rules are
halved by a hash of their id. The forest is fitted on rows of quality 1 of the first half, at most FIT_ROWS (least hash of the id), within the
ranges that the features have over all labelled rows. The threshold comes from the scores of the second half: of the thresholds that keep at least
KEEP of quality 1, those that reject the most of quality 0, and of these the middle one (without quality 0: the least that keeps KEEP).

Cases: see text_stats; a document without labels around (no labelled rows at all, or too few for two halves) is judged by the base rules alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, saved
from .text_stats import COUNTS, FEATURES, text_stats

FIT_ROWS = 20_000
KEEP = 0.99
BINS = 2000


def _c(n: np.ndarray | float):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Per tree, arrays by node: feature (-1: leaf), cut, left child (right is left + 1), path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
        """x: the rows that are normal; low, high: least and greatest value of each feature over all rows.

        Where the rows of a node have one value in a feature, the cut falls anywhere in what is left of its range, so that rows with other
        values are set apart at once.
        """
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        deepest = int(np.ceil(np.log2(max(size, 2)))) + 4
        wide = np.flatnonzero(high > low)
        out = []
        for _ in range(trees):
            feature, cut, left, path = [], [], [], []
            todo = [(rng.choice(len(x), size, replace=False), 0, low, high)]
            nodes = 1
            while todo:
                rows, depth, lo, hi = todo.pop(0)
                if depth >= deepest or len(rows) <= 1 or not len(wide):
                    feature.append(-1), cut.append(0.0), left.append(0), path.append(depth + float(_c(len(rows))))
                    continue
                f = int(rng.choice(wide))
                a, b = x[rows, f].min(), x[rows, f].max()
                # the range is widened a little, so that what lies beyond all samples is set apart
                a, b = (a - 0.1 * (b - a), b + 0.1 * (b - a)) if b > a else (min(lo[f], a), max(hi[f], b))
                at = rng.uniform(a, b)
                below = x[rows, f] < at
                feature.append(f), cut.append(at), left.append(nodes), path.append(0.0)
                top, bottom = hi.copy(), lo.copy()
                top[f] = bottom[f] = at
                todo += [(rows[below], depth + 1, lo, top), (rows[~below], depth + 1, bottom, hi)]
                nodes += 2
            out.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
        return cls(out, float(_c(size)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                step = left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at])
                at = np.where(go, step, at)
            total += path[at]
        return 2.0 ** (-(total / max(1, len(self.trees))) / self.norm)


def _scored(stats: DataFrame, forest: Forest, extra: str = "") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.names.index("x"))
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            keep = [i for i, name in enumerate(b.schema.names) if name != "x"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(forest.score(m))], names=[*(b.schema.names[i] for i in keep), "anomaly"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name != "x"]
    return stats.mapInArrow(run, ", ".join([*fields, "anomaly double"]))


def threshold(per: np.ndarray, keep: float) -> int:
    """per[quality, bin]: rows by score. The last bin that is kept."""
    below = per.cumsum(1)  # kept if the bin is at most b
    ok = below[1] >= keep * per[1].sum()
    if not per[0].sum():
        return int(np.argmax(ok))
    best = np.flatnonzero(ok & (below[0] == below[0][ok].min()))
    return int(best[0] + best[-1]) // 2


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept, anomaly."""
    stats = saved(text_stats(docs), "stats")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labelled = stats.where(~failed).join(marks, stats.id == marks.doc_id).select("id", "quality", "x", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0).alias("first"))
    labelled = saved(labelled, "labelled")  # what the base rules leave
    fit = first_by_hash(labelled.where("first and quality = 1"), fit_rows).select("x").collect()
    ranges = labelled.agg(*[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]).first()
    others = labelled.where("not first")
    if fit and others.where("quality = 1").limit(1).count():
        forest = Forest.fit(np.array([r["x"] for r in fit]), np.array(ranges[: len(FEATURES)]), np.array(ranges[len(FEATURES) :]))
        hist = _scored(others.select("id", "quality", "x"), forest).groupBy("quality", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        per = np.zeros((2, BINS + 2))
        for r in hist:
            per[1 if r["quality"] else 0, min(BINS, r["bin"])] += r["n"]
        rows = _scored(stats, forest).withColumn("fine", F.floor(F.col("anomaly") * BINS) <= threshold(per, keep))
    else:
        rows = stats.drop("x").withColumn("anomaly", F.lit(0.0)).withColumn("fine", F.lit(True))
    return rows.select(F.col("id").alias("doc_id"), *COUNTS, failed.alias("base_failed"), (~failed & F.col("fine")).alias("kept"), "anomaly")
