"""Helpers that the corpus operators share: shared storage, word hashing, stable splits."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, saved, shared_dir  # noqa: F401

_U = np.uint64
MIX_A, MIX_B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs (they count as disk until the driver collects garbage)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a worker remembers between tasks, made once under a name. It holds one such thing at a time: a worker serves many operators."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release(words: bool = True) -> None:
    """Forget what other operators have left in this worker, with the hashes of words or without."""
    _HELD.clear()
    if words:
        WORDS.clear()
    give_back()


def give_back() -> None:
    """What was freed goes back to the system: else the C library keeps it for this worker, which may live as long as the application."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def first_by_hash(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The n rows of df that come first by (hash of the id, id).

    Only rows under a bound of the hash that leaves little more than n are sorted; else every partition would send
    its own first n rows, which grow with the partitions. If the bound leaves fewer (ids that repeat), all are sorted.
    """
    h, total = F.xxhash64(id_col), df.count()
    if total > 2 * n:
        near = df.where(h <= int((n + 8 * n**0.5 + 64) / total * 2**64) - 2**63)
        if near.count() >= n:
            df = near
    return df.orderBy(h, id_col).limit(n)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> _U(30))) * MIX_A
    h = (h ^ (h >> _U(27))) * MIX_B
    return h ^ (h >> _U(31))


class WordHash(dict):
    """word -> 64-bit hash, remembered; emptied when it has grown to `most` entries."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


WORDS = WordHash()


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: white space of str.split() that does not divide words here
_ODD = tuple("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))


def ascii_words(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+ of a text. str.split() also splits at other white space, so texts that hold such take the slow way."""
    for c in _ODD[:4] if text.isascii() else _ODD:
        if c in text:
            return _slow_words(text)
    return text.split()


def _slow_words(text: str) -> list[str]:
    return _WORD.findall(text)


def windows_of(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows of documents laid end to end in h. Returns (hash, index of first word)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        w = w * _U(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, bool)
    ends = (starts + lengths)[:-1] if len(starts) else starts
    for e in range(1, k):  # a window that starts within the last k-1 words before a document's end crosses it
        at = ends - e
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(w[at]), at
