"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Kernel: a word's features are its three-letter subsequences with at most two letters skipped between
neighbours, each weighted DECAY^skipped and normalised, so inserted letters (`idxiot`), marks (`i.d.i.o.t`) and
spaced letters (`i d i o t`) leave most features in place. Two marks before a word give its first letters more weight. Of two
sentences it is the sum, over all pairs of their words (the first of equal words in a document), of the squared word kernel (a convolution kernel); word kernels below LEAST count as 0. Landmarks are sentences of one word: of the words
that mark toxic learning documents (a test on document counts, words like each other counted together), the strongest that
differ, and the frequent words of clean documents that are most like them. K_mm^(-1/2) maps a sentence's kernel row to Nyström features; a linear SVM is trained
on labelled sentences (of a learning document its PER_DOC most suspicious; those of clean documents are clean, of a toxic one the
highest is toxic, chosen anew as the machine learns). A document's score is a logistic curve over the decisions of its TOP highest
sentences and its number of sentences, fitted on the same documents, weighted as toxic and clean ones occur among all labelled rows.

Learning documents are at most FIT_ROWS labelled ones, half of them toxic at most (least hash of the id; of several texts of one id the
least). Letters outside a to z share 38 codes, so some of them count as equal.

Cases: null and empty texts and texts without letters have the score of an empty sentence; ids may be null or repeated;
without toxic learning rows every score is 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, first_by_hash, fold, held, release, saved

FIT_ROWS, PER_DOC, TOP = 12_000, 6, 5
LANDMARKS, NEUTRAL, CANDIDATES = 64, 20, 2000
GAP, DECAY = 2, 0.5
LEAST = 0.3  # kernel values below count as 0
CUT = 0.3
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ENDS = (".", "!", "?")


def letters(word: str) -> str:
    w = word.lower()
    return w if w.isalpha() else _NOT_LETTERS.sub("", w)


def units(text: str) -> list[str]:
    """Words of a text; a run of three or more single letters counts as one word more, put where it ends."""
    words = ascii_words(text)
    out, run = [], []
    for w in words:
        if len(w) <= 2 and len(c := letters(w)) == 1:
            run.append(c)
        elif run:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
        out.append(w)
    if len(run) >= 3:
        out.append("".join(run))
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of words, two marks before the first, end to end as numbers 0 to 63, where each starts, how long it is."""
    words = ["^^" + w for w in words]
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where((raw >= 97) & (raw <= 122), raw - 97, 26 + raw % 38)
    return code, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(words) else lengths, lengths


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised subsequence features: (word index, code of the three letters, value), one row a word and code."""
    code, starts, lengths = _codes(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(code))  # letters from here to the word's end
    keys = []
    for g in range(GAP + 1):
        for k in range(GAP + 1):
            at = np.flatnonzero(left > 2 + g + k)
            keys.append((owner[at] << 21) | (code[at] << 15) | (code[at + 1 + g] << 9) | (code[at + 2 + g + k] << 3) | (g + k))
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return key, key, key.astype(float)
    value, key = (DECAY ** np.arange(8.0))[key & 7], key >> 3
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value = np.add.reduceat(value, first)
    who, what = key[first] >> 18, key[first] & 0x3FFFF
    norm = np.sqrt(np.bincount(who, value * value, minlength=len(words)))
    return who, what, value / norm[who]


class Kernel:
    """Squared kernel values of words with fixed landmarks, by one table over the codes that landmarks have: of each code the landmarks that have it."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        who, what, value = features(landmarks)
        by_code = np.argsort(what, kind="stable")
        used, count = np.unique(what, return_counts=True)
        self.place = np.full(1 << 18, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.who, self.value, self.count = who[by_code], value[by_code], count
        self.first = np.cumsum(count) - count

    def rows(self, words: list[str]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(words), m), np.float32)
        step = max(20, 150_000 // max(1, m))  # bounds what is looked up at once
        for lo in range(0, len(words), step):
            some = words[lo : lo + step]
            who, what, value = features(some)
            place = self.place[what]
            hit = np.flatnonzero(place >= 0)
            if len(hit):
                place = place[hit]
                count = self.count[place]
                ends = np.cumsum(count)
                at = np.arange(ends[-1]) + np.repeat(self.first[place] - ends + count, count)
                pair = np.repeat(who[hit] * m, count) + self.who[at]
                out[lo : lo + len(some)] = np.bincount(pair, np.repeat(value[hit], count) * self.value[at], len(some) * m).reshape(-1, m)
        out[out < LEAST] = 0
        return out * out


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # of kernel rows
    bias: float
    document: np.ndarray  # of the TOP decisions, the number of sentences, 1

    def summary(self, rows: np.ndarray, n: int) -> np.ndarray:
        """What a document is scored by: its highest decisions (an empty sentence's where it has fewer), its number of sentences, 1."""
        d = np.sort(np.concatenate([rows @ self.weights + self.bias, np.full(TOP, self.bias)]))[: -TOP - 1 : -1]
        return np.concatenate([d, [np.log1p(n), 1.0]])

    def score(self, rows: np.ndarray, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(rows, n) @ self.document, -30, 30))))


class Known(dict):
    """word -> row of kernel values (0: none worth keeping) and whether it ends a sentence; when `most` is reached, words in use stay."""

    def __init__(self, kernel: Kernel, most: int = 300_000):
        self.kernel, self.most, self.cores = kernel, most, {}
        self.rows = [np.zeros((1, len(kernel.landmarks)), np.float32)]
        self.count = 1

    def learn(self, texts: list[list[str]]) -> None:
        found: set[str] = set()
        for t in texts:
            found.update(t)
        if len(self) + len(found) > self.most or len(self.cores) + len(found) > self.most:
            kept = {w: self[w] for w in found if w in self}
            self.clear()
            self.update(kept)
            self.cores = {letters(w): at >> 1 for w, at in kept.items()}
            used, to = np.unique(np.array([0, *self.cores.values()]), return_inverse=True)
            self.rows, self.count = [self.table()[used]], len(used)
            place = dict(zip(used.tolist(), range(len(used)), strict=True))
            self.cores = dict(zip(self.cores, to[1:].tolist(), strict=True))
            self.update({w: place[at >> 1] * 2 + (at & 1) for w, at in kept.items()})
        pairs = [(w, letters(w)) for w in found.difference(self)]
        new = list({c: None for _, c in pairs if c not in self.cores})
        rows = self.kernel.rows(new)
        active = rows.any(axis=1)
        self.cores.update(zip(new, np.where(active, np.cumsum(active) - 1 + self.count, 0).tolist(), strict=True))
        self.rows.append(rows[active])
        self.count += int(active.sum())
        for w, c in pairs:
            self[w] = self.cores[c] * 2 + (w[-1] in _ENDS)

    def table(self) -> np.ndarray:
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0]


def _sentences(known: Known, words: list[str], table: np.ndarray) -> tuple[np.ndarray, int]:
    """Kernel rows of the sentences of a text that have any, and how many sentences it has."""
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    active = np.flatnonzero(at >= 2)
    n = int((at & 1).sum())
    if not len(active):
        return np.zeros((0, table.shape[1]), np.float32), n
    active = active[np.sort(np.unique(at[active] >> 1, return_index=True)[1])]  # a word that comes again says nothing new
    sentence = np.cumsum(at & 1)[active] - (at[active] & 1)
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    return np.add.reduceat(table[at[active] >> 1], first, axis=0), n


def _over(rows: DataFrame, kernel_in, name: str, result, kind: str, names: list[str]) -> DataFrame:
    """Run result(sentence rows, number of sentences) over every text; rows: id, text, then columns passed on. The text is passed on if it is in names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(f"toxicity {name}", lambda: Known(kernel_in.value))
        for b in batches:
            texts, lo = b.column(1), 0
            while lo < b.num_rows:
                hi, size, part = lo, 0, []
                while hi < b.num_rows and size < 2_000_000:
                    part.append(units(texts[hi].as_py() or ""))
                    size += 6 * len(part[-1]) + 100
                    hi += 1
                known.learn(part)
                table = known.table()
                got = [result(*_sentences(known, w, table)) for w in part]
                keep = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns) if i != 1 or "text" in names]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(got)], names=names)
                lo = hi

    return rows.mapInArrow(run, kind)


def _word_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> word, toxic documents with it, clean documents with it."""
    bad, good = Counter(), Counter()
    release()

    def flush() -> pa.RecordBatch:
        words = list(bad.keys() | good.keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64())], names=["word", "bad", "good"])
        bad.clear(), good.clear()
        return out

    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = {c for w in set(units(text.as_py())) if 3 <= len(c := letters(w)) <= 40}
            (bad if toxic else good).update(words)
            if len(bad) + len(good) > 200_000:
                yield flush()
    yield flush()


def choose_landmarks(labelled: DataFrame, most: int = LANDMARKS, neutral: int = NEUTRAL) -> tuple[list[str], int]:
    """Toxic words first, then frequent words of clean documents; how many are toxic. labelled: toxic, text."""
    seen = labelled.groupBy().agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not seen["bad"]:
        return [], 0
    words = labelled.select("toxic", "text").mapInArrow(_word_docs, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = saved(words, "words")
    n_bad, n_good = float(seen["bad"]), float(seen["good"] or 0)
    share_bad, share_good = F.col("bad") / F.lit(n_bad + 1), (F.col("good") + 0.5) / F.lit(n_good + 1)
    strong = words.where((F.col("bad") >= 2) & (share_bad > 3 * share_good)).withColumn("w", share_bad * F.log(share_bad / share_good))
    strong = strong.orderBy(F.desc("w"), "word").limit(CANDIDATES).select("word", "bad", "good").collect()
    plain = words.where("good > 0").orderBy(F.desc("good"), "word").limit(CANDIDATES).select("word", "bad", "good").collect()
    if not strong:
        return [], 0
    # a candidate is judged with the words like it, so that many rare forms of one stem count together
    candidates = [r["word"] for r in strong]
    others = candidates + [r["word"] for r in plain if r["word"] not in set(candidates)]
    table = {r["word"]: (r["bad"], r["good"]) for r in [*plain, *strong]}
    counts = np.array([table[w] for w in others], float)
    # (others, candidates); a kernel's table has a column for each of its words, so they come in groups
    sim = np.concatenate([Kernel(candidates[i : i + 100]).rows(others) for i in range(0, len(candidates), 100)], axis=1)
    sim[sim < 0.25] = 0
    bad, good = sim.T @ counts[:, 0], sim.T @ counts[:, 1]
    p_bad, p_good = np.minimum(bad / n_bad, 1), np.minimum((good + 0.5) / (n_good + 1), 1)
    p = (bad + good + 0.5) / (n_bad + n_good + 1)
    z = (p_bad - p_good) / np.sqrt(np.clip(p * (1 - p), 1e-9, None) * (1 / n_bad + 1 / (n_good + 1)))
    picked: list[int] = []
    best = np.zeros(len(candidates))
    for i in np.argsort(-z, kind="stable"):
        if z[i] > 4 and p_bad[i] > 4 * p_good[i] and best[i] < 0.6 and len(picked) < most - neutral:
            picked.append(int(i))
            best = np.maximum(best, sim[: len(candidates), i])
    toxic = [candidates[i] for i in picked]
    if not toxic:
        return [], 0
    # clean words that are most like the toxic ones, and seen often, tell them apart
    clean = [r for r in plain if r["word"] not in toxic and (r["good"] + 0.5) / (n_good + 1) > r["bad"] / n_bad]
    like = Kernel(toxic).rows([r["word"] for r in clean]).sum(axis=1) * np.sqrt([r["good"] for r in clean])
    return toxic + [clean[i]["word"] for i in np.argsort(-like, kind="stable")[:neutral]], len(toxic)


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.concatenate([z, np.ones((len(z), 1))], 1)
    w = np.zeros(x.shape[1])
    keep = np.diag(np.concatenate([np.full(z.shape[1], ridge), [1e-3]]))
    for _ in range(30):
        inside = y * (x @ w) < 1
        c = cost[inside]
        xs = x[inside]
        new = np.linalg.solve(keep + xs.T @ (xs * c[:, None]), xs.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new if not w.any() else w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, t: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column is 1 and is not held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = weight * (p * (1 - p) + 1e-6)
        step = np.linalg.solve(np.diag(hold) + x.T @ (x * r[:, None]), x.T @ (weight * (p - t)) + hold * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame, toxic_share: float = 0.5) -> Model | None:
    """labelled: id, text (not null), toxic (0 or 1), the learning documents; toxic_share: how many of all labelled rows are toxic."""
    landmarks, n_toxic = choose_landmarks(labelled)
    if not n_toxic:
        return None
    kernel = Kernel(landmarks)
    name = xxhash.xxh64_hexdigest("|".join(landmarks))
    kmm = kernel.rows(landmarks).astype(float)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    sent = labelled.sparkSession.sparkContext.broadcast(kernel)

    def worst(s: np.ndarray, n: int) -> bytes:  # the number of sentences, and the most suspicious ones end to end
        s = s[np.argsort(-s[:, :n_toxic].sum(axis=1), kind="stable")[:PER_DOC]]
        return np.concatenate([[n], s.reshape(-1)]).astype("<f4").tobytes()

    kind = labelled.schema["id"].dataType.simpleString()
    got = _over(labelled.select("id", "text", "toxic"), sent, name, worst, f"id {kind}, toxic int, k binary", ["id", "toxic", "k"]).select("toxic", "k").collect()
    y = np.array([1.0 if r["toxic"] else -1.0 for r in got])
    sent_back = [np.frombuffer(r["k"], "<f4") for r in got]
    count = [int(k[0]) for k in sent_back]
    # an empty sentence stands for documents that have no other
    rows = [k[1:].reshape(-1, len(landmarks)) if len(k) > 1 else np.zeros((1, len(landmarks)), np.float32) for k in sent_back]
    bags = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z_all = np.concatenate(rows).astype(float) @ whiten
    first = np.concatenate([[0], np.flatnonzero(np.diff(bags)) + 1])
    clean = np.flatnonzero(y[bags] < 0)
    top = first.copy()
    cost_bad = max(1.0, len(clean) / max(1.0, (y > 0).sum()) / 2)
    w, b = np.zeros(z_all.shape[1]), 0.0
    for _ in range(4):  # which sentence makes a document toxic is chosen anew by what has been learnt
        use = np.concatenate([top[y > 0], clean])
        t_use = y[bags[use]]
        w, b = _svm(z_all[use], t_use, np.where(t_use > 0, cost_bad, 1.0))
        d_all = z_all @ w + b
        top = np.array([f + int(np.argmax(d_all[f : f + len(r)])) for f, r in zip(first, rows, strict=True)])
    model = Model(kernel, whiten @ w, b, np.zeros(TOP + 2))
    x = np.array([model.summary(r, n) for r, n in zip(rows, count, strict=True)])
    t = (y + 1) / 2
    share = min(max(toxic_share, 1e-6), 1.0)
    weight = np.where(t > 0, share / max(t.mean(), 1e-9), (1 - share) / max(1 - t.mean(), 1e-9))
    model.document = _logistic(x, t, weight)
    return model


def score_texts(rows: DataFrame, model: Model | None, with_text: bool = False) -> DataFrame:
    """rows: id, text -> id, score (with_text: id, text, score)."""
    names = ["id", "text"] if with_text else ["id"]
    if model is None:
        return rows.select(*names, F.lit(0.0).alias("score"))
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    sent = rows.sparkSession.sparkContext.broadcast(model.kernel)
    name = xxhash.xxh64_hexdigest("|".join(model.kernel.landmarks))
    rest = Model(None, model.weights.astype(float), model.bias, model.document)  # the kernel is sent apart
    return _over(rows.select("id", "text"), sent, name, rest.score, f"{kind}, score double", [*names, "score"])


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of the labelled rows outside the fold `out`. The ids are chosen first, so that only the texts of these are moved."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    marks = marks.where(fold(F.col("doc_id"), folds) != out).select(F.col("doc_id").alias("label_id"), "toxic")
    rows = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    known = rows.select("id").join(marks, F.col("id") == F.col("label_id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = saved(known, "marks")
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return None
    chosen = [first_by_hash(known.where(F.col("toxic") == t), fit_rows // 2) for t in (1, 0)]
    ids = saved(chosen[0].unionByName(chosen[1]).select(F.col("id").alias("chosen"), "toxic"), "chosen")
    labelled = rows.join(F.broadcast(ids), F.col("id") == F.col("chosen")).groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # fit_rows at most
    return train(saved(labelled.repartition(16), "labelled"), float(share))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from labelled rows outside the fold `out`."""
    scored = score_texts(docs.select(F.col("doc_id").alias("id"), "text"), learn(docs, labels, folds, out))
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id"), folds) == out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    others = [c for c in docs.columns if c != "text"]  # the text goes to the workers once
    whole = docs.select(F.struct(F.lit(0).alias("text"), *[F.col(f"`{c}`") for c in others]).alias("id"), F.col("text").alias("text"))
    scored = score_texts(whole, learn(docs, labels), with_text=True).where(F.col("score") < cut)
    return scored.select(*[F.col("text") if c == "text" else F.col("id")[c].alias(c) for c in docs.columns])
