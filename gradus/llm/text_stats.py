"""Rule statistics of whole texts, shared by the quality classifier and the quality rules.

Cases: a null text has no words and only zeros; ids may be null or repeated (a row for each row);
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, hashed, windows_of

SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbols_per_char", "dup_line_share", "repeat_word_share", "upper_share", "digit_share", "pipe_share",
    "bang_share", "end_mark_share", "comma_share", "odd_ascii_share", "distinct_share", "top_word_share", "marked_word_share", "words_per_line",
    "upper_word_share", "tiny",
)
_U = np.uint64


def _per_doc(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes by document: distinct ones, the most frequent one's count, and for each hash how often its document has it."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    run = np.cumsum(new) - 1
    size = np.bincount(run, minlength=0)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[new], size)
    times = np.empty(len(x), np.int64)
    times[order] = size[run]
    return np.bincount(d[new], minlength=n), top, times


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 5) counts and (n, len(FEATURES)) features of whole texts."""
    n = len(texts)
    words = [ascii_words(t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = hashed([x for w in words for x in w])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(n), lengths)
    distinct, top, _ = _per_doc(owner, flat, n)
    h, at = windows_of(flat, starts, lengths, 3)
    covered = np.zeros(len(flat), bool)
    if len(h):
        _, _, times = _per_doc(owner[at], h, n)
        again = at[times >= 2]
        for k in range(3):
            covered[again + k] = True
    repeat = np.bincount(owner[covered], minlength=n) if len(flat) else np.zeros(n, np.int64)

    counts, feats = np.zeros((n, 5), np.int64), np.zeros((n, len(FEATURES)))
    for i, t in enumerate(texts):
        if not t:
            feats[i, -1] = 1
            continue
        raw = t.encode("utf-8", "replace")
        b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        dup = len(lines) - len(set(lines))
        w = max(1, int(lengths[i]))
        chars = len(t) - int(b[list(WHITE)].sum())
        c = max(1, chars)
        symbols, upper = int(b[list(SYMBOLS)].sum()), int(b[65:91].sum())
        marks = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        shouted = sum(map(str.isupper, words[i]))
        counts[i] = lengths[i], chars, symbols, dup, repeat[i]
        feats[i] = (
            np.log1p(w), chars / w, symbols / c, dup / max(1, len(lines)), repeat[i] / w, upper / c, b[48:58].sum() / c, b[124] / w, b[33] / w,
            (b[46] + b[63]) / w, b[44] / w, (marks - b[46] - b[44]) / w, distinct[i] / w, top[i] / w, symbols / w, w / max(1, len(lines)), shouted / w, w < 20,
        )
    feats[:, 15] = np.log1p(feats[:, 15])
    return counts, feats


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lo = 0
        while lo < batch.num_rows:
            hi, size, part = lo, 0, []
            while hi < batch.num_rows and size < 2_000_000:
                part.append(texts[hi].as_py())
                size += len(part[-1] or "") + 200
                hi += 1
            counts, feats = measure(part)
            cols = [pa.array(counts[:, j]) for j in range(5)]
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * feats.shape[1])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols, pa.ListArray.from_arrays(offsets, pa.array(feats.reshape(-1)))], names=["id", *COUNTS, "x"])
            lo = hi


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five counts of the rules, and x, the features (array<double>)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measured, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>")
