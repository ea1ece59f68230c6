"""Language identification by interpolated Kneser-Ney character models, one for each language.

A word is read with four blanks before it and one after; every character is predicted from the four
before it. Five-gram counts are gathered from all learning documents (summed in each task, then in the
cluster). Tables are sorted arrays of n-gram hashes, looked up by binary search; a word's log-probabilities
are kept, so that each word is looked up once in a worker. A text gets the language with the lowest cross-entropy a character.
`accepted` is false where that entropy is above the 99.5 % quantile of the learning documents of that language.

A model of up to SENT_CELLS five-grams times languages is sent to every task; a larger table stays in the cluster, where the
distinct words of all texts are scored by joins with it. Both ways give the same result and leave out nothing.

Cases: a text that is null or has no letter is `und` with score 0; rows without lang teach nothing; repeated rows are
counted as often as they occur; with nothing to learn from, every text is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, fold, held, mix, saved

ORDER = 5
SENT_CELLS = 16_000_000  # about 30 bytes each over all orders
HOT_WORDS = 20_000  # the most frequent words, whose scores are sent where the others are joined by shuffle
DISCOUNT = 0.75
ALPHABET = 4096  # characters that are told apart when nothing else is known
_U = np.uint64
_STRIP = ".,;:!?*#$%&|<>()[]{}\"'-_/\\+=0123456789"


def core(word: str) -> str:
    """What a word is scored by: nothing, if it has no letter."""
    c = word.strip(_STRIP).lower()
    return c if c.isalpha() or any(map(str.isalpha, c)) else ""


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five-grams of words, one for each letter and the end: their characters as numbers, a hash, and the word of each."""
    text = [" " * (ORDER - 1) + w + " " for w in words]
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.array([len(t) for t in text], np.int64) - (ORDER - 1)
    owner = np.repeat(np.arange(len(words)), count)
    codes = np.lib.stride_tricks.sliding_window_view(flat, ORDER)[np.arange(len(owner)) + owner * (ORDER - 1)] if len(words) else np.zeros((0, ORDER), np.uint32)
    return codes, _hashes(codes), owner


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of characters."""
    h = np.zeros(len(codes), _U)
    for k in range(codes.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + codes[:, k].astype(_U))
    return h


class _Grams:
    """Five-gram counts of one language in a task."""

    def __init__(self):
        self.words: Counter = Counter()
        self.keys, self.codes, self.n = np.zeros(0, _U), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)

    def settle(self) -> None:
        """Turn the words counted so far into five-grams."""
        cores: Counter = Counter()
        for w, n in self.words.items():
            cores[core(w)] += n
        cores.pop("", None)
        self.words.clear()
        codes, keys, owner = _codes(list(cores))
        n = np.fromiter(cores.values(), np.int64, len(cores))[owner]
        self.keys, first, to = np.unique(np.concatenate([self.keys, keys]), return_index=True, return_inverse=True)
        self.codes = np.concatenate([self.codes, codes])[first]
        self.n = np.bincount(to, np.concatenate([self.n, n]), len(first)).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, gram, n: of each task the five-grams and how often they occur."""
    held: dict[str, _Grams] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, g in held.items():
            g.settle()
            text = g.codes.tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(g.n)], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            g = held.setdefault(lang, _Grams())
            g.words.update(ascii_words(text.as_py()))
            if len(g.words) > 200_000:
                g.settle()
                if sum(len(x.keys) for x in held.values()) > 2_000_000:
                    yield from flush()
    yield from flush()


def gram_table(learn: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all learning rows."""
    rows = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """For each order: sorted gram hashes with the discounted share by language, and sorted context hashes with the weight passed on."""

    def __init__(self, table: pa.Table):
        lang = table.column("lang").combine_chunks().dictionary_encode()
        lang = lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang
        names = lang.dictionary.to_pylist()
        self.langs = sorted(names)
        place = np.array([self.langs.index(x) for x in names], np.int64)
        col = place[lang.indices.to_numpy(zero_copy_only=False)] if len(lang) else np.zeros(0, np.int64)
        n = table.column("n").to_numpy().astype(np.float64)
        text = "".join(table.column("gram").to_pylist())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        del text
        k, self.tables = len(self.langs), []
        for order in range(ORDER, 0, -1):
            keys, gram = np.unique(_hashes(codes), return_inverse=True)
            contexts, ctx = np.unique(_hashes(codes[:, :-1]), return_inverse=True)
            at = ctx * k + col
            total, kinds = (np.bincount(at, w, len(contexts) * k) for w in (n, None))
            share = np.zeros((len(keys), k), np.float32)
            share[gram, col] = np.maximum(n - DISCOUNT, 0) / total[at]
            passed = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1).astype(np.float32).reshape(len(contexts), k)
            self.tables.append((keys, share, contexts, passed))
            if order > 1:  # below: how many different characters stand before it
                _, lower = np.unique(_hashes(codes[:, 1:]), return_inverse=True)
                both, first, n = np.unique(lower * k + col, return_index=True, return_counts=True)
                codes, col, n = codes[first, 1:], col[first], n.astype(np.float64)

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): log-probability by language, then characters predicted."""
        out = np.zeros((len(words), len(self.langs) + 1))
        codes, keys, owner = _codes(words)
        _, first, to = np.unique(keys, return_index=True, return_inverse=True)
        codes = codes[first]
        p = np.full((len(codes), len(self.langs)), 1.0 / ALPHABET)
        for order in range(1, ORDER + 1):
            grams, share, contexts, passed = self.tables[ORDER - order]
            p = _find(_hashes(codes[:, ORDER - order :]), grams, share, 0.0) + _find(_hashes(codes[:, ORDER - order : -1]), contexts, passed, 1.0) * p
        logs = np.log(p)
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, logs[to, j], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out


def _find(h: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(h), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where((keys[at] == h)[:, None], values[at], missing)


class Known(dict):
    """word -> row of `rows`, the same for words of one core; when `most` words or rows are reached, those in use stay."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.cores = model, most, {"": 0}
        self.rows = np.zeros((1024, len(model.langs) + 1), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        found: set[str] = set()
        for words in texts:
            found.update(words)
        if len(self) + len(found) > self.most or len(self.cores) + len(found) > self.most:
            kept = {w: self[w] for w in found if w in self}
            used, row = np.unique(np.array([0, *kept.values()]), return_inverse=True)
            at = dict(zip(used.tolist(), range(len(used)), strict=True))
            self.cores = {c: at[i] for c, i in self.cores.items() if i in at}
            self.rows[: len(used)] = self.rows[used]
            self.clear()
            self.update(zip(kept, row[1:].tolist(), strict=True))
        pairs = [(w, core(w)) for w in found.difference(self)]
        new = list({c: None for _, c in pairs if c not in self.cores})
        start = len(self.cores)
        if start + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((start + len(new), self.rows.shape[1]), np.float32)])
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            self.rows[start + i : start + i + len(some)] = self.model.words(some)
        self.cores.update(zip(new, range(start, start + len(new)), strict=True))
        for w, c in pairs:
            self[w] = self.cores[c]

    def text(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0, dtype=float)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, text) -> v, core of a word, n: how often it is in the text; words without a letter are left out."""
    for b in batches:
        vs, cores, ns = [], [], []
        for v, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts: Counter = Counter()
            for w, n in Counter(ascii_words(text.as_py())).items():
                if c := core(w):
                    counts[c] += n
            vs.extend([v] * len(counts)), cores.extend(counts), ns.extend(counts.values())
            if len(vs) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(cores, pa.string()), pa.array(ns, pa.int64())], names=["v", "core", "n"])
                vs, cores, ns = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(cores, pa.string()), pa.array(ns, pa.int64())], names=["v", "core", "n"])


def _gram_scores(table: DataFrame, need: DataFrame, langs: DataFrame) -> DataFrame:
    """(gram, lang, p) of the five-grams in need(gram), by the recursion of Model, from the orders below upwards."""
    level, orders = table, []
    for order in range(ORDER, 0, -1):
        ctx = level.groupBy("lang", F.expr(f"substring(gram, 1, {order - 1})").alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        orders.append((order, level, saved(ctx, "contexts")))
        level = saved(level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), "level") if order > 1 else level
    p = None
    for order, level, ctx in reversed(orders):
        rows = need.select(F.expr(f"right(gram, {order})").alias("gram")).distinct().crossJoin(F.broadcast(langs))
        rows = rows.withColumn("ctx", F.expr(f"substring(gram, 1, {order - 1})")).join(level, ["lang", "gram"], "left")
        rows = rows.join(F.broadcast(ctx) if order <= 2 else ctx, ["lang", "ctx"], "left")  # of orders 1 and 2: one row for each character at most
        if p is None:
            rows = rows.withColumn("below", F.lit(1.0 / ALPHABET))
        else:
            rows = rows.withColumn("tail", F.expr("substring(gram, 2)")).join(p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below")), ["lang", "tail"])
        share = F.coalesce(F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        passed = F.coalesce(DISCOUNT * F.col("kinds") / F.col("total"), F.lit(1.0))
        p = saved(rows.select("lang", "gram", (share + passed * F.col("below")).alias("p")), "level")
    return p


def _identify_by_joins(docs: DataFrame, table: DataFrame, langs: list[str]) -> DataFrame:
    """What identify gives, with the gram table in the cluster."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("v"), "text").groupBy("v").agg(F.first("text").alias("text"))
    words = saved(texts.mapInArrow(_words_of, "v long, core string, n long"), "words")
    counts = saved(words.groupBy("core").agg(F.count(F.lit(1)).alias("texts")), "cores")
    padded = F.concat(F.lit(" " * (ORDER - 1)), "core", F.lit(" "))
    grams = counts.withColumn("w", padded).select("core", F.explode(F.expr(f"transform(sequence(1, length(w) - {ORDER - 1}), i -> substring(w, i, {ORDER}))")).alias("gram"))
    grams = saved(grams.groupBy("core", "gram").agg(F.count(F.lit(1)).alias("times")), "of-words")
    p = _gram_scores(table, grams.select("gram").distinct(), spark.createDataFrame([(x,) for x in langs], "lang string"))
    place = {x: i for i, x in enumerate(langs)}
    per = p.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, F.log("p"))).alias(f"s{i}") for x, i in place.items()])
    sums = [F.sum(F.col("times") * F.col(f"s{i}")).alias(f"s{i}") for i in range(len(langs))]
    scores = saved(grams.join(per, "gram").groupBy("core").agg(*sums, F.sum("times").alias("chars")), "scores")
    hot = F.broadcast(counts.orderBy(F.desc("texts"), "core").limit(HOT_WORDS).select("core"))
    often = words.join(F.broadcast(scores.join(hot, "core")), "core")
    seldom = words.join(hot, "core", "left_anti").join(scores, "core")
    sums = [F.sum(F.col("n") * F.col(f"s{i}")).alias(f"s{i}") for i in range(len(langs))]
    got = often.unionByName(seldom).groupBy("v").agg(*sums, F.sum(F.col("n") * F.col("chars")).alias("chars"))
    got = got.select("v", "chars", F.array(*[-F.col(f"s{i}") / F.col("chars") for i in range(len(langs))]).alias("h")).withColumn("entropy", F.array_min("h"))
    got = got.withColumn("lang_pred", F.array(*map(F.lit, langs))[F.expr("cast(array_position(h, entropy) - 1 as int)")])
    got = got.withColumn("score", F.expr("1 / aggregate(h, 0d, (a, x) -> a + exp(-(x - entropy) * least(chars, 20)))")).select("v", "lang_pred", "score", "entropy")
    rows = docs.select("id", F.xxhash64("text").alias("_v"), F.col("text").isNotNull().alias("_has"))
    rows = rows.join(got, F.col("_has") & (F.col("_v") == F.col("v")), "left")
    return rows.select("id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), "entropy")


def identify(docs: DataFrame, learn: DataFrame, most: int = SENT_CELLS) -> DataFrame:
    """id, lang_pred, score, entropy of every row of docs(id, text, ...); learn has lang and text. A larger model than `most` is not sent."""
    spark = docs.sparkSession
    table = saved(gram_table(learn), "grams")
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    if table.count() * len(langs) > most:
        return _identify_by_joins(docs, table, langs)
    model = Model(table.toArrow())
    sent = spark.sparkContext.broadcast(model)
    name = xxhash.xxh64_hexdigest(repr(langs).encode() + b"".join(x.tobytes() for x in model.tables[0][:2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(f"languages {name}", lambda: Known(sent.value))
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            lo = 0
            while lo < b.num_rows:
                hi, size, part = lo, 0, []
                while hi < b.num_rows and size < 3_000_000:
                    text = texts[hi].as_py() or ""
                    part.append(ascii_words(text) if langs else [])
                    size += len(text)
                    hi += 1
                preds, scores, entropies = [], [], []
                known.learn(part)
                for words in part:
                    row = known.text(words)
                    if row[-1] == 0:
                        preds.append("und"), scores.append(0.0), entropies.append(None)
                        continue
                    h = -row[:-1] / row[-1]
                    best = int(np.argmin(h))
                    z = np.exp(-(h - h[best]) * min(row[-1], 20.0))
                    preds.append(langs[best]), scores.append(float(1 / z.sum())), entropies.append(float(h[best]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64())], names=["id", "lang_pred", "score", "entropy"])
                lo = hi

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double, entropy double")


def language_id(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row; learns from the rows outside the held fold."""
    out = fold(F.col("doc_id"), folds) == held_fold
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    scored = saved(identify(rows, docs.where(~out).select("lang", "text")), "languages")
    held_out = fold(F.col("id"), folds) == held_fold
    limits = scored.where(~held_out & F.col("entropy").isNotNull()).groupBy("lang_pred").agg(F.percentile_approx("entropy", 0.995, 1000).alias("most"))
    joined = scored.join(F.broadcast(limits.select(F.col("lang_pred").alias("l"), "most")), F.col("lang_pred") == F.col("l"), "left")  # one row a language
    return joined.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", F.coalesce(F.col("entropy") <= F.col("most"), F.lit(False)).alias("accepted"))
