"""Packing by concatenate-and-cut: two passes of prefix sums, then fixed windows with boundary records.

Pass 1 tokenises every document once and writes (part, place in the part, ids). The token totals of the
parts (one row a part) give each part its global offset; pass 2 adds a document's place in its part and
cuts the one long stream at every multiple of the window. Nothing is sorted or shuffled by text.

Cases: null and empty texts give no ids of their own, only the end id; an empty table gives no rows;
repeated rows are packed once for each row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, give_back, held, mix, saved

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
SLICE = 1_500_000  # characters that are looked at together: of each some 50 bytes are held
LONG = 4096  # characters of the longest run that is not left to the tokenizer
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character below 65536.

    Odd are those that normalisation or lowering may change otherwise than one by one: marks that combine and what they combine to anew,
    jamo, sigma, white space beyond ASCII, controls and unassigned ones (65535 is one, and stands for all characters above it).
    """
    kind, low = np.full(1 << 16, ODD, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        what, small = unicodedata.category(c), c.lower()
        if c in " \t\n\x0b\x0c\r":
            kind[i] = SPACE
        elif what[0] in "CMZ" or len(small) != 1 or i == 0x3A3 or 0x1100 <= i <= 0x11FF or not unicodedata.is_normalized("NFC", c):
            continue
        else:
            kind[i] = LETTER if what[0] == "L" else DIGIT if what[0] == "N" else MARK
            low[i] = ord(small)
    return kind, low


class RunIds:
    """Texts -> token ids, by runs of letters, single digits and runs of marks, each tokenised once.

    The tokenizer drops white space and splits at these runs (and at 's 't 're 've 'm 'll 'd where a run starts so) before it merges, so
    a text's ids are its runs' ids end to end. Runs are known by 64-bit hashes of their lower-case characters. Texts that hold
    odd characters, special tokens or runs of more than LONG characters are left to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a run
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind, self.low = _tables()
        self.power = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15 | 5, _U), dtype=_U)
        self.value = mix(np.arange(1, (1 << 16) + 1, dtype=_U) * MIX_A) | _U(1)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def tokenise(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs end to end, and how many each has; 500 runs in a call, each ends with a token that ends a run."""
        parts = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        all_ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for part, got in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                one_by_one = list(map(self.ids, part))
                ids, ends = np.concatenate(one_by_one), np.cumsum([len(x) for x in one_by_one])
            all_ids.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(all_ids), np.concatenate(counts)

    def _runs(self, kind: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs start and end."""
        before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
        start = ((kind != before) | (kind == DIGIT)) & (kind != SPACE)
        quote = np.flatnonzero((low == 39) & (kind == MARK) & (before != MARK))
        if len(quote):
            one, two = low[np.minimum(quote + 1, len(low) - 1)], low[np.minimum(quote + 2, len(low) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            for hit, step in ((short, 2), (long, 3)):  # what comes after is a run of its own
                after = quote[hit] + step
                after = after[after < len(kind)]
                start[after] = kind[after] != SPACE
        bound = np.flatnonzero(start | ((kind == SPACE) & (before != SPACE)))
        is_start = start[bound]
        return bound[is_start], np.append(bound[1:], len(kind))[is_start]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        big = "\n".join(texts) + "\n"
        offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        code = np.minimum(np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32), (1 << 16) - 1)
        kind, low = self.kind[code], self.low[code]
        special = {i for i, t in enumerate(texts) if "<|" in t and _SPECIAL.search(t)}
        special.update((np.searchsorted(offs, np.flatnonzero(kind == ODD), "right") - 1).tolist())
        for i in special:
            kind[offs[i] : offs[i + 1]] = SPACE
        start, end = self._runs(kind, low)
        length = end - start
        if len(length) and length.max() > LONG:
            for i in np.unique(np.searchsorted(offs, start[length > LONG], "right") - 1).tolist():
                special.add(i)
                kind[offs[i] : offs[i + 1]] = SPACE
            start, end = self._runs(kind, low)
            length = end - start
        begin = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(begin, length)
        values = self.value[low[kind != SPACE]] * self.power[within]
        h = mix(np.add.reduceat(values, begin) + length.astype(_U) * MIX_A) if len(begin) else np.zeros(0, _U)
        order = np.argsort(h)
        h = h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(first) - 1
        h, one = h[first], order[first]

        if len(self.keys) + len(h) > self.most:
            self.forget()
        place = np.searchsorted(self.keys, h)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            ids, n = self.tokenise([big[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
            at = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, ids])
            self.keys, self.at, self.n = (np.insert(x, place[new], y) for x, y in ((self.keys, h[new]), (self.at, at), (self.n, n)))
            place = np.searchsorted(self.keys, h)
        at, n = self.at[place][which], self.n[place][which]
        sums = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(at - sums[:-1], n) + np.arange(sums[-1])]
        cut = sums[np.searchsorted(start, offs)]
        out = [ids[lo:hi] for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        for i in special:
            out[i] = self.ids(texts[i])
        return out


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about `most` bytes, one text at least; none of them is read for that."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + (most or SLICE), "right")))
        yield lo, hi
        lo = hi


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pass 1: a row for each document: part, start_in_part, n_ids, ids (zstd, 32-bit little-endian), with the id column as `doc`."""
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, press = held(f"tokenizer {path}", lambda: RunIds(path)), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, texts, parts = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi in slices(texts):  # a batch of very long texts is emitted piece by piece
                starts, counts, blobs = [], [], []
                for got in words.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]):
                    starts.append(start)
                    counts.append(len(got) + 1)
                    start += len(got) + 1
                    blobs.append(press.compress(got.tobytes() + end))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), parts.slice(lo, hi - lo), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc", "part", "start_in_part", "n_ids", "ids"],
                )
                give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(encode, f"doc {kind}, part int, start_in_part long, n_ids long, ids binary")


def concat_and_cut(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows: doc, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    rows = saved(tokenised(docs, path, id_col, text_col), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part of the scan
    base, at = {}, 0
    for r in totals:
        base[r["part"]], at = at, at + r["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, part, start, blobs = (batch.column(i) for i in (0, 1, 2, 4))
            parts, starts = part.to_numpy(), start.to_numpy()
            take, out = [], {k: [] for k in ("start", "length", "ids", "n", "seq", "off")}
            for i in range(batch.num_rows):
                raw = press.decompress(blobs[i].as_py())
                n, g, done = len(raw) // 4, base[int(parts[i])] + int(starts[i]), 0
                while done < n:
                    seq, off = divmod(g + done, window)
                    length = min(window - off, n - done)
                    take.append(i)
                    out["start"].append(done)
                    out["length"].append(length)
                    out["ids"].append(raw[4 * done : 4 * (done + length)])
                    out["n"].append(n)
                    out["seq"].append(seq)
                    out["off"].append(off)
                    done += length
                if len(take) > 20_000:
                    yield _batch(doc, take, out)
                    take, out = [], {k: [] for k in out}
            if take:
                yield _batch(doc, take, out)

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _batch(doc: pa.Array, take: list[int], out: dict) -> pa.RecordBatch:
    long = lambda k: pa.array(out[k], pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc.take(pa.array(take, pa.int32())), long("start"), long("length"), pa.array(out["ids"], pa.binary()), long("n"), long("seq"), long("off")],
        names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids of a piece as their crc32."""
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
