"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; unlabelled are any documents, their labels unseen. A small network on text
statistics minimises, with logistic losses and the class prior,
  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
The prior is estimated from positives and unlabelled documents alone: a network is fitted on half of them (two folds by a hash of the id, so
copies of an id stay together), and over the scores of the other half the prior is the least share(unlabelled >= t) / share(positive >= t) of any
threshold t, with a margin for small counts (where only positives score, the two shares differ by the prior). At most FIT_ROWS rows of each
kind are used (least hash of the id).

Cases: see text_stats; where no row is labelled 1, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, fold, saved
from .text_stats import FEATURES, text_stats

FIT_ROWS = 20_000
CUT = 0.3


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class PUNet:
    """One hidden layer; the inputs are standardised features and their square roots."""

    def __init__(self, hidden: int = 24, seed: int = 3):
        self.hidden, self.rng = hidden, np.random.default_rng(seed)

    def _in(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([x, np.sqrt(np.abs(x)), np.log(np.abs(x) + 1e-3)], 1)
        return z if not hasattr(self, "mean") else np.clip((z - self.mean) / self.std, -6, 6)

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 3e-3) -> PUNet:
        raw = self._in(np.concatenate([pos, unl]))
        self.mean, self.std = raw.mean(0), raw.std(0) + 1e-6
        p, u = self._in(pos), self._in(unl)
        d = p.shape[1]
        w = [self.rng.normal(0, 1 / np.sqrt(d), (d, self.hidden)), np.zeros(self.hidden), self.rng.normal(0, 0.2, self.hidden), np.array([np.log(prior / (1 - prior))])]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            pu = self.rng.permutation(len(u))
            for lo in range(0, len(u), batch):
                b = pu[lo : lo + batch]
                xp, xu = p[self.rng.integers(0, len(p), len(b))], u[b]
                x = np.concatenate([xp, xu])
                h = np.maximum(0, x @ w[0] + w[1])
                s = _sig(h @ w[2] + w[3][0])
                sp, su = s[: len(b)], s[len(b) :]
                loss_n = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
                if loss_n >= 0:  # gradient of prior*R_p(+) + R_u(-) - prior*R_p(-)
                    g = np.concatenate([prior * (sp - 1) - prior * sp, su]) / len(b)
                else:  # step back on the part that has gone below zero
                    g = np.concatenate([prior * sp, -su]) / len(b)
                gh = np.outer(g, w[2]) * (h > 0)
                grads = [x.T @ gh + 1e-4 * w[0], gh.sum(0), h.T @ g, np.array([g.sum()])]
                t += 1
                for k, gr in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return _sig(np.maximum(0, self._in(x) @ w[0] + w[1]) @ w[2] + w[3][0])


def class_prior(pos: np.ndarray, unl: np.ndarray, margin: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of both that no fit has seen."""
    cuts = np.unique(np.concatenate([pos, unl]))[::-1]
    p = (len(pos) - np.searchsorted(np.sort(pos), cuts)) / len(pos)
    u = (len(unl) - np.searchsorted(np.sort(unl), cuts)) / len(unl)
    slack = lambda n: np.sqrt(np.log(4 / margin) / (2 * n))  # noqa: E731  of a share that n rows give
    ok = p > 2 * slack(len(pos))
    upper = (u[ok] + (slack(len(unl)) + slack(len(pos)))) / p[ok]
    if not len(upper):
        return 0.5
    best = np.argmin(upper)
    return float(np.clip(u[ok][best] / p[ok][best], 0.02, 0.98))


def fit_with_prior(pos: np.ndarray, unl: np.ndarray, pos_half: np.ndarray, unl_half: np.ndarray) -> tuple[PUNet, float]:
    """The network of all rows, with the prior that two networks of one half each find in the other."""
    found = []
    for half in (False, True):
        p, u = pos[pos_half == half], unl[unl_half == half]
        if len(p) and len(u) and len(p) < len(pos) and len(u) < len(unl):
            net = PUNet().fit(p, u, 0.5, epochs=20)
            found.append(class_prior(net.score(pos[pos_half != half]), net.score(unl[unl_half != half])))
    prior = float(np.mean(found)) if found else 0.5
    return PUNet().fit(pos, unl, prior), prior


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    stats = saved(text_stats(docs).select("id", "x"), "features")
    learn = stats.where(fold(F.col("id"), folds) != held)
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.where(fold(F.col("doc_id"), folds) != held)
    good = marks.where("quality = 1").select(F.col("doc_id").alias("id"))
    half = (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0).alias("half")

    def take(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = first_by_hash(df, fit_rows).select("x", half).collect()
        return np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["half"] for r in rows], bool)

    (pos, pos_half), (unl, unl_half) = take(learn.join(good, "id", "left_semi")), take(learn)
    net = fit_with_prior(pos, unl, pos_half, unl_half)[0] if len(pos) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(net.score(x), 9) if net else np.full(len(x), 0.5))], names=["id", "score"])

    scored = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), folds) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
