"""Near-duplicate classes by DartMinHash and banded joining.

A text is a multiset of five-word shingles (words are lower-case, split at ASCII white space; a text of
one to four words is one shingle). A shingle that occurs w times is w unit-wide regions. Darts fall on
each region as a Poisson process in rank (intensity 1, all from hashes of the shingle), so two texts see
the same darts on what they share. A text takes the darts below a rank bound that gives about
k ln k + 2k of them, deals each to one of k coordinates by hash and keeps the earliest per coordinate;
where a coordinate stays empty the bound is doubled. Coordinates agree with probability equal to the
weighted Jaccard similarity.

Bands of coordinates are joined, candidates are checked exactly on their shingles (0.8 or more), and
links are closed to classes:
  1. equal texts are one vertex from the start, so copies are never paired;
  2. in every band group each member is checked against the group's leader, the vertex that meets the most others in all
     its groups (of copies with edits, their source), one link a member;
  3. classes are formed; in groups that still hold several, members of different classes are paired if they differ from the
     leader in the same regions, by a join on the rarest of these that loses no link (see _across), and checked too.
Groups are never gathered in one task; leaders come from partial aggregates.

Cases: a null text is a class of its own; texts that are equal (empty ones too) share a class; texts
without a word are linked to nothing else; an empty table gives no rows; a repeated row is a copy;
the class id is the least doc_id of the class; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, ascii_words, discard, free_shuffles, hashed, mix, release, saved, windows_of

K, ROWS = 120, 5
WORDS_PER_SHINGLE, SIMILARITY = 5, 0.8
SIEVE = 1 << 16
_U = np.uint64


def elements(words: list[list[str]], k: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit regions of texts given as words: (document index, hash of (shingle, how many-th)), sorted by both."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = hashed([x for w in words for x in w])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    h, at = windows_of(flat, starts, lengths, k)
    doc = owner[at]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        extra = [mix(np.array([hash_run(flat[starts[i] : starts[i] + lengths[i]])], _U))[0] for i in short]
        h, doc = np.concatenate([h, np.array(extra, _U)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h) == 0:
        return doc, h
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - first[np.cumsum(new) - 1]
    return doc, np.where(nth > 0, mix(h + nth.astype(_U) * MIX_A), h)


def hash_run(h: np.ndarray) -> int:
    total = len(h) * 0x9E3779B97F4A7C15
    for x in h.tolist():
        total = (total * 0x9E3779B97F4A7C15 + x) % 2**64
    return total


def dart_signatures(doc: np.ndarray, region: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """(n_docs, k) signatures; the row of a text without regions stays 0."""
    weight = np.bincount(doc, minlength=n_docs).astype(float)
    sig = np.zeros((n_docs, k), _U)
    bound = np.where(weight > 0, (k * np.log(k) + 2 * k) / np.maximum(weight, 1), 0.0)
    todo = np.flatnonzero(weight > 0)
    live = np.arange(len(region))
    while len(todo):
        sel = live if len(todo) == n_docs else live[np.isin(doc[live], todo)]
        rank = np.zeros(len(sel))
        ranks, slots, ids, j = [], [], [], 0
        while len(sel):
            j += 1
            dart = mix(region[sel] + _U(j * 0xD1B54A32D192ED03 % 2**64))
            rank = rank - np.log(((dart >> _U(11)).astype(float) + 0.5) / 9007199254740992.0)
            keep = rank < bound[doc[sel]]
            sel, rank, dart = sel[keep], rank[keep], mix(dart[keep] ^ MIX_A)
            ranks.append(rank)
            slots.append(doc[sel] * k + (dart % _U(k)).astype(np.int64))
            ids.append(dart)
        ranks, slots, ids = np.concatenate(ranks), np.concatenate(slots), np.concatenate(ids)
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last
        sig.reshape(-1)[slots[order]] = ids[order]
        full = np.zeros(n_docs * k, bool)
        full[slots] = True
        todo = todo[~full.reshape(n_docs, k)[todo].all(axis=1)]
        bound[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = sig.shape
    keys = np.zeros((n, k // rows), _U)
    for r in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + sig[:, r :: rows][:, : k // rows])
    return mix(keys + np.arange(k // rows, dtype=_U) * MIX_A).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, text) -> vertex, bands, regions (32-bit, distinct); a text is signed once in a task."""
    seen: set[int] = set()
    release(words=False)
    for batch in batches:
        vertices, texts = batch.column(0).to_pylist(), batch.column(1)
        lo = 0
        while lo < len(vertices):
            ids, words, size = [], [], 0
            while lo < len(vertices) and size < 150_000:
                v = vertices[lo]
                if v not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(v)
                    w = ascii_words(texts[lo].as_py().lower())
                    if w:
                        ids.append(v)
                        words.append(w)
                        size += len(w) + 50
                lo += 1
            if not ids:
                continue
            doc, region = elements(words)
            sig = dart_signatures(doc, region, len(ids))
            bands = band_keys(sig)
            off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(off), pa.array((region >> _U(32)).astype(np.uint32).view(np.int32))),
                ],
                names=["v", "bands", "regions"],
            )


def _checked(pairs: DataFrame, regions: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of vertices whose weighted Jaccard similarity is at least `similarity`."""
    a = regions.select(F.col("v").alias("a"), F.col("regions").alias("ra"))
    b = regions.select(F.col("v").alias("b"), F.col("regions").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    near = F.least(F.size("ra"), F.size("rb")) >= similarity * F.greatest(F.size("ra"), F.size("rb"))
    joined = pairs.join(b, "b").join(a, "a").where(near)
    return joined.where(both >= similarity * (F.size("ra") + F.size("rb") - both)).select("a", "b")


def _sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose v may be among those of keys, before a shuffle: a bitmap of SIEVE longs, of one size whatever the input."""
    bit = "shiftleft(1L, cast(shiftright(v, 16) & 63 as int))"
    sieve = keys.groupBy((F.expr(f"v & {SIEVE - 1}")).alias("slot")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    return rows.join(F.broadcast(sieve), F.expr(f"slot = v & {SIEVE - 1}")).where(F.expr(f"(bits & {bit}) != 0")).drop("slot", "bits")


def _across(open_: DataFrame, regions: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of different classes that share a band; no pair of similarity `similarity` is missed.

    Texts x and y of n regions are similar if |x - y| + |y - x| is at most far * (nx + ny). Let X and Y be what x and y differ
    in from the leader of their band, y being of another class than the leader, so not similar to it: |Y| > far * (ny + nl).
    As X and Y differ in what x and y differ in, they share (|X| + |Y| - far * (nx + ny)) / 2 members at least, more than
    (|X| + far * (nl - nx)) / 2. So of the members of X, rarest first, one of the first |X| - that + 1 is in Y.
    """
    far = (1 - similarity) / (1 + similarity)
    leads = open_.groupBy("band").agg(F.max(F.struct("degree", "v", "root")).alias("lead")).select("band", F.col("lead.v").alias("l"), F.col("lead.root").alias("lroot"))
    members = open_.join(leads, "band").where("v <> l").select("l", "v", "root", (F.col("root") != F.col("lroot")).alias("other")).distinct()
    both = members.join(regions.select("v", F.col("regions").alias("r")), "v").join(regions.select(F.col("v").alias("l"), F.col("regions").alias("rl")), "l")
    diff = F.concat(F.array_except("r", "rl"), F.array_except("rl", "r"))
    least = F.floor((F.size("diff") + far * (F.size("rl") - F.size("r"))) / 2 - 1e-6).cast("int") + 1
    diffs = saved(both.withColumn("diff", diff).select("l", "v", "root", "other", F.size("r").alias("n"), F.size("diff").alias("d"), least.alias("least"), "diff"), "diffs")
    met = diffs.select("l", "other", F.explode("diff").alias("token")).groupBy("l", "token").agg(F.count(F.lit(1)).alias("df"), F.max("other").alias("any")).where("df > 1 and any").drop("any")
    shared = diffs.select("l", "v", F.explode("diff").alias("token")).join(met, ["l", "token"])
    shared = shared.groupBy("l", "v").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))  # at most two texts long
    rows = saved(diffs.drop("diff").join(shared, ["l", "v"]).withColumn("s", F.size("ts")), "shared")
    side = lambda df, tag, ts: df.select("l", F.explode(ts).alias("t"), *[F.col(c).alias(c + tag) for c in ("v", "root", "other", "n", "d", "s")]).select("l", F.col("t.token").alias("token"), "*").drop("t")
    x = side(rows.where("s >= least"), "x", F.expr("slice(ts, 1, s - least + 1)"))
    y = side(rows.where("other"), "y", F.col("ts")).select(F.col("l").alias("ly"), F.col("token").alias("ty"), "vy", "rooty", "ny", "dy", "sy")
    fits = f"rootx <> rooty and (not otherx or vx < vy) and least(nx, ny) >= {similarity} * greatest(nx, ny) and 2 * least(sx, sy) >= dx + dy - {far} * (nx + ny) - 0.000001"
    pairs = x.join(y, (F.col("l") == F.col("ly")) & (F.col("token") == F.col("ty")) & F.expr(fits))
    return pairs.select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges: least-neighbour hooking and pointer jumping until nothing changes."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root"), F.lit(0).cast("long").alias("old")), "labels")
    while True:
        of_b = labels.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        best = both.join(of_b, "b").groupBy("a").agg(F.min("rb").alias("m"))
        hooked = labels.join(best, labels.v == best.a).select("v", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("v").alias("p"), F.col("root").alias("up"))
        nxt = saved(hooked.join(up, F.col("root") == F.col("p"), "left").select("v", F.least("root", F.coalesce("up", "root")).alias("root"), "old"), "labels")
        discard(labels)
        labels = nxt
        if not labels.where("root <> old").limit(1).count():
            discard(both)
            return labels.select("v", "root")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, v (hash of its text), class_key (its class), class_id (least id of the class), class_size."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("v", F.xxhash64("text"))
    signed = saved(rows.where("text is not null").select("v", "text").mapInArrow(_sign, "v long, bands array<long>, regions array<int>"), "signed")
    members = signed.select("v", F.explode("bands").alias("band")).groupBy("band", "v").agg(F.lit(1).alias("one")).select("band", "v")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = members.join(sizes, "band")  # band groups of two texts at least
    degree = groups.groupBy("v").agg(F.sum("size").alias("degree"))
    groups = saved(groups.drop("size").join(degree, "v").select("band", "v", "degree"), "groups")
    regions = _sifted(signed.select("v", "regions"), groups).groupBy("v").agg(F.first("regions").alias("regions"))
    held = saved(regions.join(groups.select("v").distinct(), "v", "left_semi"), "regions")
    lead = F.max(F.struct("degree", "v"))  # the text that meets the most others: of copies of one text with edits, that text
    leads = groups.groupBy("band").agg(lead.alias("lead")).select("band", F.col("lead.v").alias("l"))
    ordered = lambda df: df.select(F.least("l", "v").alias("a"), F.greatest("l", "v").alias("b")).where("a < b").distinct()
    tried = saved(ordered(groups.join(leads, "band")), "pairs")
    edges = saved(_checked(tried, held, similarity), "links")
    labels = components(edges)
    # groups that still hold several classes: texts of different classes that part from the leader in the same regions
    own = groups.join(labels, "v", "left").select("band", "v", "degree", F.coalesce("root", "v").alias("root"))
    several = own.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    open_ = saved(own.join(several, "band"), "open")
    more = saved(_across(open_, held, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
    extra = saved(_checked(more, held, similarity), "links")
    if extra.limit(1).count():
        labels = components(edges.union(extra))
    free_shuffles(docs.sparkSession)

    small = rows.select("id", "v", F.col("text").isNull().alias("none")).join(labels, "v", "left")
    # a null text has the hash of nothing; its class is its row, told apart by id
    small = small.withColumn("class_key", F.when(F.col("none"), F.lit(None).cast("long")).otherwise(F.coalesce("root", "v"))).select("id", "v", "class_key")
    small = saved(small, "classes")
    discard(signed, groups, held, tried, edges, open_, more, extra)
    size = small.where("class_key is not null").groupBy("class_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    with_text = small.where("class_key is not null").join(size, "class_key").select("id", "v", "class_key", "class_id", "class_size")
    alone = small.where("class_key is null").select("id", "v", "class_key", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_text.union(alone)


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns; null texts stay.

    It is the one with the least doc_id, of several texts under that id the one of the least hash, of rows that still
    differ the one whose other columns have the least hash.
    """
    classes = near_duplicates(docs, similarity)
    roots = classes.where("class_key is not null and id <=> class_id").groupBy("class_key").agg(F.min("id").alias("root_id"), F.min("v").alias("root"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("v"), F.col("text").isNull().alias("none"))
    kept = rows.where("not none").join(roots, (F.col("v") == F.col("root")) & F.col("id").eqNullSafe(F.col("root_id")))
    kept = kept.groupBy("class_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return kept.union(rows.where("none").select("row")).select("row.*")
