"""Exact-substring deduplication by merging the Burrows-Wheeler transforms of shards.

What is removed: every byte covered by a WINDOW-byte string that also starts anywhere else in the corpus.

A suffix matters only to the depth of WINDOW bytes, and only if another shares that prefix, so the order of all suffixes is
never built. Suffixes that cannot matter are settled first, then the others are sorted, shard by shard, and the shards are merged:

  sample    Of the seeds (SEED-byte strings) in a window the one of least hash stands for it, so equal windows are stood for at the
            same place. A context is the text of all windows that one seed stands for. Suffixes whose seed occurs once are settled;
            so are equal contexts (an interval whose LCP is the whole context: repeated), of which one goes on with weight 2.
  shards    Each partition of the remaining contexts is a shard. It sorts its suffixes that start with the seeds, within blocks of
            one seed, and keeps the LCP of neighbours.
  merge     A task gets whole blocks, as sorted runs of many shards, and interleaves them by refinement, eight bytes a round: only the
            heads of segments (suffixes of a run that agree so far) are compared, a block with one run left is settled and keeps the
            order and LCPs of that run, and where a block splits the LCP of the neighbours is known. Nothing is sorted again.
  backward  The merged transform (each suffix with the byte before it) is walked backwards: a stable split of each block by that byte
            gives the order of the suffixes that start one byte earlier, and the LCP of neighbours is one more than the least LCP
            between them. Where it is WINDOW or more the interval is a repeat. Blocks of one suffix are dropped as they arise.

A block of more than BIG contexts (a very common passage) is split before the merge, so that no task gets it whole: contexts are
cut into cells, fixed ranges of window places about the seed, of half the size in each round. All windows of a cell have a core
in common, so contexts that share a window share the core: (seed, cell, core) are the new blocks. Cells alone in their block are settled,
blocks of equal cells are repeats, those of BIG cells at most go to the shards, the others are halved again.

Seeds, contexts and cores are told apart by 64-bit hashes, two of them at each step (seed and context, block and cell), and equal texts by
one; in the shards and the merge bytes are compared.

Cases: a null text counts as empty; texts of fewer than WINDOW bytes lose nothing; equal texts and repeated rows have equal
results (all of it goes, if it is long enough); an empty table gives no rows; other columns are ignored or passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, discard, free_shuffles, mix, release, saved

WINDOW, SEED, PIECE = 200, 32, 1 << 19
BIG = 2000  # contexts of a block beyond which it is split before the merge
SPAN = WINDOW - SEED  # a window starts at most so many bytes before its seed
CELLS = 256  # windows in the first cell, a power of two over SPAN
RIGHT = -(-WINDOW // 8)  # eight-byte keys of a suffix
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.cumprod(out, dtype=_U)


_POW, _IPOW = _powers(_BASE, PIECE + 2 * WINDOW + 2), _powers(_INV, PIECE + 2 * WINDOW + 2)
_BYTE = mix(np.arange(1, 257, dtype=_U) * MIX_A) | _U(1)


class Hashes:
    """Hashes of all substrings of a piece of text, by prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_BYTE[raw] * _POW[: self.n], out=self.sums[1:], dtype=_U)

    def fixed(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:m]) * _IPOW[:m])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _IPOW[start] + (end - start).astype(_U) * MIX_A)


def sampled(raw: np.ndarray, h: Hashes, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes of a piece: place, first and last window that it stands for; and their seed hashes."""
    keys = h.fixed(seed)
    span = window - seed + 1  # seeds in a window
    low = _U((1 << 20) - 1)
    v = (keys & ~low) | np.arange(len(keys), dtype=_U)  # of equal seeds the first
    n = len(v) - span + 1
    pad = -len(v) % span
    blocks = np.concatenate([v, np.full(pad, _U(2**64 - 1))]).reshape(-1, span)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(backward[:n], forward[span - 1 : span - 1 + n])
    place = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return place[first], first, last, keys[place[first]]


def _pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces of a text; every window starts in one of them."""
    raw = np.frombuffer(text, np.uint8)
    for lo in range(0, max(1, len(raw) - WINDOW + 1), PIECE):
        yield lo, raw[lo : lo + PIECE + WINDOW - 1]


def _suffixes(text: bytes) -> tuple[np.ndarray, ...]:
    """Of the sampled suffixes of a text of WINDOW bytes at least: seed hash, context hash, place, and how far before it the first and last window start."""
    out = []
    for lo, raw in _pieces(text):
        h = Hashes(raw)
        place, first, last, seeds = sampled(raw, h)
        context = h.at(first, last + WINDOW) ^ mix((place - first).astype(_U) + MIX_A)
        out.append((seeds.view(np.int64), context.view(np.int64), place + lo, (place - first).astype(np.int16), (place - last).astype(np.int16)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slices(b: pa.RecordBatch, text_at: int, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    texts, lo = b.column(text_at), 0
    while lo < b.num_rows:
        hi, size = lo, 0
        while hi < b.num_rows and size < most:
            size += len(texts[hi].as_buffer() or b"") + 200
            hi += 1
        yield lo, hi
        lo = hi


def _sampled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, raw) -> u, seed, context, place, far, near, w; equal texts of a task give rows once, with w = 2."""
    held: dict[int, bool] = {}
    release()
    for b in batches:
        us = b.column(0).to_pylist()
        for lo, hi in _slices(b, 1):
            cols = [[] for _ in range(7)]
            for i in range(lo, hi):
                u = us[i]
                if held.get(u):  # a third copy adds nothing
                    continue
                w = 2 if u in held else 1
                held[u] = u in held
                s = _suffixes(b.column(1)[i].as_buffer().to_pybytes())
                for c, x in zip(cols, (np.full(len(s[0]), u), *s, np.full(len(s[0]), w, np.int32)), strict=True):
                    c.append(x)
            if len(held) > 500_000:
                held.clear()
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["u", "seed", "context", "place", "far", "near", "w"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, raw, wanted: seed, place, far, near, w, kinds) -> u, block, place, far, near, w, kinds, bytes of the context."""
    last = None
    for b in batches:
        for i in range(b.num_rows):
            u = b.column(0)[i].as_py()
            if u == last:  # a copy; those that lie elsewhere are dropped later
                continue
            raw, rows, last = b.column(1)[i].as_buffer().to_pybytes(), b.column(2)[i].as_py(), u
            for lo in range(0, len(rows), 20_000):
                some = rows[lo : lo + 20_000]
                col = lambda k, kind: pa.array([r[k] for r in some], kind)  # noqa: B023, E731
                text = [raw[r["place"] - r["far"] : r["place"] - r["near"] + WINDOW] for r in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([u] * len(some), pa.int64()), col("seed", pa.int64()), col("place", pa.int64()), col("far", pa.int16()), col("near", pa.int16()), col("w", pa.int32()), col("kinds", pa.int64()), pa.array(text, pa.binary())],
                    names=["u", "block", "place", "far", "near", "w", "kinds", "bytes"],
                )


_CUT = "u long, block long, place long, far short, near short, w int, bytes binary"


def _cells(size: int):
    """Contexts of blocks that are too big -> the same in cells of `size` windows, with new blocks and the hash of each cell's text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(8)]
            for u, block, place, far, near, w, raw in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                at = far  # of the seed in raw
                for cell in range(near // size, far // size + 1):
                    lo, hi = max(near, cell * size), min(far, (cell + 1) * size - 1)
                    core = raw[at - cell * size : at - min(SPAN, (cell + 1) * size - 1) + WINDOW]
                    text = raw[at - hi : at - lo + WINDOW]
                    key = xxhash.xxh3_64_intdigest(core, (block ^ (cell * 0x9E3779B97F4A7C15)) & (2**64 - 1)) - 2**63
                    for c, x in zip(out, (u, key, place, hi, lo, w, text, xxhash.xxh64_intdigest(text, hi) - 2**63), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["u", "block", "place", "far", "near", "w", "bytes", "whole"])

    return split


def right_keys(texts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at` in their texts, to WINDOW bytes: as rows of eight-byte numbers (ends filled with 0), and their lengths."""
    right = [t[a : a + WINDOW] for t, a in zip(texts, at.tolist(), strict=True)]
    whole = b"".join(r.ljust(8 * RIGHT, b"\0") for r in right)
    return np.frombuffer(whole, ">u8").reshape(len(right), RIGHT).astype(_U), np.array([len(r) for r in right], np.int64)


def _common(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of each number."""
    out = np.zeros(len(x), np.int64)
    for k in range(7, -1, -1):
        out += (x >> _U(8 * k)) == 0
    return out


def shard_order(block: np.ndarray, texts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order of (block, suffix), and the LCP of each with the one before it (0 at the start of a block)."""
    order = np.array(sorted(range(len(texts)), key=lambda i: (block[i], texts[i][at[i] : at[i] + WINDOW])), np.int64)
    keys, length = right_keys([texts[i] for i in order], at[order])
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        apart = keys[1:] != keys[:-1]
        where = np.where(apart.any(axis=1), apart.argmax(axis=1), RIGHT - 1)
        rows = np.arange(1, len(order))
        lcp[1:] = np.minimum(8 * where + _common(keys[rows, where] ^ keys[rows - 1, where]), np.minimum(length[1:], length[:-1]))
        b = block[order]
        lcp[1:][b[1:] != b[:-1]] = 0
    return order, lcp


def interleave(block: np.ndarray, run: np.ndarray, keys: np.ndarray, length: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs of suffixes: rows come by (block, run, place in the run). Returns the merged order and its LCPs.

    Round d refines the blocks by bytes 8d to 8d + 7. A head is a suffix that agrees less than so far with the one before it in its run;
    the others of its segment go where it goes.
    """
    n = len(block)
    order = np.arange(n)
    edge = np.concatenate([[True], block[1:] != block[:-1]]) if n else np.zeros(0, bool)
    common = np.where(edge, 0, 8 * RIGHT)
    for d in range(RIGHT):
        first = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        lo, hi = (f.reduceat(run[order], first) if n else run for f in (np.minimum, np.maximum))
        pos = np.flatnonzero((lo != hi)[group])  # blocks of one run are settled
        if not len(pos):
            break
        rows, g = order[pos], group[pos]
        follows = np.concatenate([[False], (g[1:] == g[:-1]) & (run[rows[1:]] == run[rows[:-1]])])
        head = ~follows | (lcp[rows] < 8 * (d + 1))
        values, rank = np.unique(keys[rows[head], d], return_inverse=True)
        rank = rank[np.cumsum(head) - 1]
        to = np.argsort(g * len(values) + rank, kind="stable")
        order[pos], rank = rows[to], rank[to]  # of each block only its own places change
        parts = np.flatnonzero((g[1:] == g[:-1]) & (rank[1:] != rank[:-1])) + 1
        edge[pos[parts]] = True
        common[pos[parts]] = 8 * d + _common(values[rank[parts]] ^ values[rank[parts - 1]])
    same = np.flatnonzero(~edge)
    one_run = run[order[same]] == run[order[same - 1]]
    common[same[one_run]] = lcp[order[same[one_run]]]
    common[1:] = np.minimum(common[1:], np.minimum(length[order[1:]], length[order[:-1]]))
    return order, common


class _Least:
    """Least of any range of an array (sparse table)."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        k = 1
        while 2 * k <= len(x):
            self.levels.append(np.minimum(self.levels[-1][: len(self.levels[-1]) - k], self.levels[-1][k:]))
            k *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of lo to hi, both included."""
        size = hi - lo + 1
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            sel = level == k
            out[sel] = np.minimum(self.levels[k][lo[sel]], self.levels[k][hi[sel] - (1 << int(k)) + 1])
        return out


def backward(block: np.ndarray, common: np.ndarray, texts: list[bytes], far: np.ndarray) -> np.ndarray:
    """Walk a merged transform backwards: (suffixes, SPAN + 1) marks of the windows, by how far before the seed they start, that are repeated."""
    marks = np.zeros((len(block), SPAN + 1), bool)
    text = np.frombuffer(b"".join(texts), np.uint8)
    seed = np.cumsum([0, *map(len, texts)])[:-1] + far  # where the suffixes start
    least, live, group = _Least(common), np.arange(len(block)), block
    for back in range(SPAN + 1):
        pair = np.flatnonzero(group[1:] == group[:-1])
        if not len(pair):
            break
        alike = pair[least.of(live[pair] + 1, live[pair + 1]) + back >= WINDOW]
        marks[live[alike], back] = marks[live[alike + 1], back] = True
        size = np.bincount(group)
        keep = (size[group] > 1) & (far[live] > back)
        live, group = live[keep], group[keep]
        if not len(live):
            break
        group = group * 256 + text[seed[live] - back - 1]  # the byte before: the transform's symbol
        to = np.argsort(group, kind="stable")
        live, group = live[to], group[to]
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return marks


def _runs_of(marks: np.ndarray, us: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Marked windows as runs: u, first and last start."""
    m = np.zeros((len(marks), SPAN + 3), np.int8)
    m[:, 1:-1] = marks
    step = np.diff(m, axis=1)
    row, near = np.nonzero(step == 1)
    far = np.nonzero(step == -1)[1] - 1
    return pa.RecordBatch.from_arrays([pa.array(us[row]), pa.array(place[row] - far), pa.array(place[row] - near)], names=["u", "first", "last"])


def _shards(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Contexts of a partition (u, block, place, far, near, w, bytes) -> the same as sorted runs of `most` at most, with run, pos and lcp."""
    task, part = TaskContext.get().partitionId(), 0
    for b in batches:
        for lo in range(0, b.num_rows, most):
            some = b.slice(lo, most)
            texts, far = some.column(6).to_pylist(), some.column(3).to_numpy().astype(np.int64)
            order, lcp = shard_order(some.column(1).to_numpy(), texts, far)
            some = some.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [*(some.column(i) for i in (0, 1, 2, 3, 6)), pa.array(np.full(len(order), (task << 32) + part)), pa.array(np.arange(len(order), dtype=np.int32)), pa.array(lcp.astype(np.int16))],
                names=["u", "block", "place", "far", "bytes", "run", "pos", "lcp"],
            )
            part += 1


def _merge(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Whole blocks, sorted by (block, run, pos) -> u, first, last: runs of repeated windows."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        us, block, place, far, run, lcp = (t.column(k).to_numpy() for k in ("u", "block", "place", "far", "run", "lcp"))
        texts, far, lcp = t.column("bytes").to_pylist(), far.astype(np.int64), lcp.astype(np.int64)
        block = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
        # the first of a run in a block that its shard did not put first has the LCP with a stranger
        lcp[np.concatenate([[True], (block[1:] != block[:-1]) | (run[1:] != run[:-1])])] = 0
        keys, length = right_keys(texts, far)
        order, common = interleave(block, run, keys, length, lcp)
        marks = backward(block[order], common, [texts[i] for i in order], far[order])
        return _runs_of(marks, us[order], place[order])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:  # all blocks but the last, which may go on
            t = pa.Table.from_batches(held)
            block = t.column("block").to_numpy()
            cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            if cut:
                yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield solve(pa.Table.from_batches(held))


def _split_big(contexts: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Blocks of more than `most` contexts, in cells: (contexts for the shards, settled runs of repeated windows, tables to discard)."""
    small, certain, tables = [], [], []
    big, size = contexts, CELLS
    while size > 1 and big.limit(1).count():
        size //= 2
        rows = saved(big.mapInArrow(_cells(size), f"{_CUT}, whole long"), "cells")
        stat = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("n > 1").withColumnRenamed("block", "b")
        rows = saved(rows.join(stat, F.col("block") == F.col("b")).drop("b", "whole"), "cells")
        tables.append(rows)
        certain.append(rows.where("lo = hi").selectExpr("u", "place - far as first", "place - near as last"))
        small.append(rows.where(f"lo <> hi and n <= {most}").drop("n", "lo", "hi"))
        big = rows.where(f"lo <> hi and n > {most}").drop("n", "lo", "hi")
    return small, certain, tables


def repeats(docs: DataFrame, most: int = BIG) -> DataFrame:
    """u, first, last: runs of window starts that are repeated, for texts (u, raw) given once or more."""
    spark = docs.sparkSession
    long = docs.where(F.length("raw") >= WINDOW).select("u", "raw")
    suffixes = long.mapInArrow(_sampled_rows, "u long, seed long, context long, place long, far short, near short, w int")
    blocks = suffixes.groupBy("seed").agg(F.sum("w").alias("n")).where("n > 1").select(F.col("seed").alias("s"))
    at = ["u", "place", "far", "near"]
    live = suffixes.join(blocks, F.col("seed") == F.col("s")).groupBy("seed", "context", *at).agg(F.sum("w").alias("w")).drop("s")
    live = saved(live, "live")
    free_shuffles(spark)
    contexts = live.groupBy("seed", "context").agg(F.sum("w").alias("n"), F.min(F.struct("u", "place")).alias("one"))
    seeds = contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    named = saved(contexts.join(seeds.select(F.col("seed").alias("s"), "kinds", "least"), F.col("seed") == F.col("s")).drop("s"), "contexts")
    both = live.join(named.select(F.col("seed").alias("s"), F.col("context").alias("c"), "n", "kinds", "least", "one"), (F.col("seed") == F.col("s")) & (F.col("context") == F.col("c")))
    both = saved(both.select("seed", *at, "n", "kinds", "least", "one"), "blocks")
    discard(live, named)
    certain = both.where("n > 1").selectExpr("u", "place - far as first", "place - near as last")
    # blocks with some context that is alone: of equal contexts one speaks for all
    asked = both.where("kinds > 1 and least = 1 and (n = 1 or (one.u = u and one.place = place))")
    asked = asked.select(F.col("u").alias("wu"), F.struct("seed", "place", "far", "near", F.least("n", F.lit(2)).cast("int").alias("w"), "kinds").alias("x"))
    wanted = asked.groupBy("wu").agg(F.collect_list("x").alias("wanted"))  # as long as its document
    texts = long.join(wanted, F.col("u") == F.col("wu")).select("u", "raw", "wanted")
    cut = texts.mapInArrow(_cut_contexts, _CUT.replace("bytes", "kinds long, bytes")).dropDuplicates(["u", "place"])  # of equal texts once
    cut = saved(cut, "contexts")
    free_shuffles(spark)
    small, settled, tables = _split_big(cut.where(f"kinds > {most}").drop("kinds"), most)
    runs = cut.where(f"kinds <= {most}").drop("kinds")
    for part in small:
        runs = runs.union(part)
    sorted_runs = runs.mapInArrow(_shards, "u long, block long, place long, far short, bytes binary, run long, pos int, lcp short")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = sorted_runs.repartition(shards, "block").sortWithinPartitions("block", "run", "pos").mapInArrow(_merge, "u long, first long, last long")
    for part in settled:
        certain = certain.union(part)
    out = saved(certain.union(merged), "repeats")
    discard(both, cut, *tables)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, raw, runs) -> u, n_removed, n_spans, kept_sha256, spans."""
    for b in batches:
        out = [[] for _ in range(5)]
        for i in range(b.num_rows):
            raw, runs = b.column(1)[i].as_buffer().to_pybytes(), b.column(2)[i].as_py()
            spans, end = [], -1
            for r in sorted((x["first"], x["last"] + WINDOW) for x in runs):
                if r[0] <= end:
                    end = spans[-1][1] = max(end, r[1])
                else:
                    spans.append([*r])
                    end = r[1]
            sha, at = hashlib.sha256(), 0
            for lo, hi in spans:
                sha.update(raw[at:lo])
                at = hi
            sha.update(raw[at:])
            for c, x in zip(out, (b.column(0)[i].as_py(), sum(hi - lo for lo, hi in spans), len(spans), sha.hexdigest(), spans), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
            names=["u", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def dedup(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs, its text null), text, and n_removed, n_spans, kept_sha256, spans (null: nothing is removed)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64("text").alias("u"), raw.alias("raw"))
    runs = repeats(rows)
    per = runs.groupBy("u").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # as long as its document
    texts = rows.join(per.withColumnRenamed("u", "ru"), F.col("u") == F.col("ru")).select("u", "raw", "runs")
    done = texts.mapInArrow(_remove, "u long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    done = done.groupBy("u").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "spans")))
    done = saved(done, "removed")
    discard(runs)
    free_shuffles(docs.sparkSession)
    columns = [F.lit(None).cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]  # the text moves once
    whole = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"), F.xxhash64("text").alias("u"))
    return whole.join(done.withColumnRenamed("u", "du"), F.col("u") == F.col("du"), "left").drop("u", "du")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.sha2(text.cast("binary"), 256)).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of the texts; a character that is cut in two goes as a whole."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                if spans:
                    raw, at, parts = text.as_buffer().to_pybytes(), 0, []
                    for lo, hi in [*spans, [len(raw), len(raw)]]:
                        parts.append(raw[at:lo].decode("utf-8", "ignore"))
                        at = hi
                    out.append("".join(parts))
                else:
                    out.append(text.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row", "text"])

    rows = dedup(docs).select("row", "text", "spans")
    kind = rows.schema["row"].dataType.simpleString()
    got = rows.mapInArrow(strip, f"row {kind}, text string")
    return got.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
