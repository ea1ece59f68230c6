import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import common, decontaminate, html_extract, language_id, near_dup, packing, quality_pu, quality_rules, sharding, suffix_dedup, text_stats, toxicity

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("aeioustrnl") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


EDGE = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "é"), (None, "no id here"), (1004, "x " * 20000), (1005, "same same"), (1005, "same same")]


@pytest.fixture(autouse=True)
def seeded():
    """Each test draws the same texts, whatever ran before it."""
    RNG.seed(11)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng.randint(3, 200), rng)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    long = prose(300, rng).split()
    for i in range(6):
        w = list(long)
        w[rng.randrange(300)] = f"edit{i}"
        rows.append((200 + i, " ".join(w)))
    rows += EDGE
    # clashing and extra columns
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, u int, id int")


def empty(docs):
    return docs.where("false")


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and sharding.shard_documents(empty(docs)).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1003} == {(18, zlib.crc32("é".encode()))}


TREE = sharding.Tree((1.0,) * 10 + (0.0, 2.5, 1.0, 0.5), per_rack=3, per_region=2)


def test_shards_equal_a_descent_by_hand(spark):
    """The hashes come from Spark, the descent from plain Python."""
    from math import log

    tree = TREE.grow(3.0)
    keys = spark.createDataFrame([(i,) for i in range(600)] + [(None,)], "id long")
    nodes = {101: [0, 1, 2, -15], 102: [*range(5), -15], 103: [i for i, w in enumerate(tree.weights) if w]}
    cols = [F.xxhash64("id", F.lit(n).cast("long"), F.lit(level)).alias(f"h{level}_{n}") for level, names in nodes.items() for n in names]
    rows = sharding.assign(keys, "id", tree).select("shard", *cols).collect()

    def draw(r, level, name, shards):
        return -log(((r[f"h{level}_{name}"] % 2**64 >> 11) + 0.5) / 2**53) / sum(tree.weights[i] for i in shards)

    for r in rows:
        layout = {g: {} for g in nodes[101]}
        for i, w in enumerate(tree.weights):
            if w:
                layout[i // 6 if i < 14 else -15].setdefault(i // 3 if i < 14 else -15, []).append(i)
        g = min(layout, key=lambda g: draw(r, 101, g, [i for k in layout[g].values() for i in k]))
        k = min(layout[g], key=lambda k: draw(r, 102, k, layout[g][k]))
        assert r.shard == min(layout[g][k], key=lambda i: draw(r, 103, i, [i]))


def test_shard_weights_confine_moves(spark):
    keys = spark.range(20000)
    heavy = sharding.Tree((*TREE.weights[:7], 4.0, *TREE.weights[8:]), 3, 2)
    both = sharding.assign(sharding.assign(keys, "id", TREE, "x"), "id", heavy, "y").where("x <> y").select("x", "y").collect()
    # shard 7 is in rack 2 (6 to 8) of region 1 (6 to 11): rows come into that region, in it into that rack, in that into that shard
    assert both and all((r.x // 6 != 1 and r.y // 6 == 1) or (r.x // 3 != 2 and r.y // 3 == 2) or r.y == 7 for r in both)
    grown = sharding.assign(sharding.assign(keys, "id", TREE, "x"), "id", TREE.grow(), "y").where("x <> y").select("y").distinct().collect()
    assert [r.y for r in grown] == [14]
    share = {r.shard: r["count"] / 20000 for r in sharding.assign(keys, "id", TREE).groupBy("shard").count().collect()}
    assert set(share) == {i for i, w in enumerate(TREE.weights) if w} and all(abs(s - TREE.weights[i] / 14) < 0.012 for i, s in share.items())


def test_packing_round_trip(spark, docs):
    path = packing.tokenizer_path()
    tok = packing.RunIds(path)
    assert packing.concat_and_cut(empty(docs), path).count() == 0
    got = packing.digest(packing.concat_and_cut(docs, path)).orderBy("sequence_id", "offset").collect()
    # the stream is the documents' ids end to end in some order, cut at every multiple of the window
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, np.asarray([*tok.tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    at = 0
    by_len = {}
    for doc, ids in want.elements():
        by_len.setdefault((doc, len(ids) // 4), []).append(ids)
    i = 0
    while i < len(got):
        first = got[i]
        assert first.start == 0
        pieces, have = [], 0
        while have < first.doc_tokens:
            p = got[i]
            assert (p.doc_id, p.start, p.doc_tokens, p.sequence_id, p.offset) == (first.doc_id, have, first.doc_tokens, at // 2048, at % 2048)
            assert p.length == min(2048 - p.offset, first.doc_tokens - have)
            pieces.append(p)
            have, at, i = have + p.length, at + p.length, i + 1
        texts = by_len[first.doc_id, first.doc_tokens]
        fits = [t for t in texts if all(zlib.crc32(t[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in pieces)]
        texts.remove(fits[0])
    assert not any(by_len.values())


def test_tokenising_holds_a_slice_at_a_time():
    """Memory follows the slice, not the batch; slices are whole texts and leave none out."""
    import tracemalloc

    rng = random.Random(6)
    texts = [None, "", "é" * 10, *(" ".join(rng.choice(VOCAB) for _ in range(1000)) for _ in range(1500)), "word " * 500_000, None]
    col = pa.array(texts, pa.string())
    parts = list(packing.slices(col))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(texts))) and len(parts) > 4
    assert all(hi == lo + 1 or sum(len((t or "").encode()) for t in texts[lo:hi]) <= packing.SLICE for lo, hi in parts)
    assert list(packing.slices(col.slice(0, 0))) == []
    words = packing.RunIds(packing.tokenizer_path())
    tracemalloc.start()
    for lo, hi in parts[:-1]:
        if hi - lo > 1:
            words.encode([t or "" for t in col.slice(lo, hi - lo).to_pylist()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak


def test_word_ids_equal_the_tokenizer():
    tok = packing.RunIds(packing.tokenizer_path())
    rng = random.Random(2)
    letters = "aAbB zZ.,'!#$%é É\u0130\u03a3ς\u0301\u0327ﬁß中文１२3\u200d\xa0\u2028\n\t<|>İŞ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["don't it's I'M", "naïve café İstanbul ΣΑΣ", "ŞEHRİ. TEKLİFİ, İ!", "a b c 12ab3 !!--..a", "x\x1cy <|endoftext|> z", "", "é" * 3000 + "."]
    texts += ["x" * 5000 + " a", "''s 's 'start 'LL 'vex don'TS .'re 9's 'r 'v' 'l", "😀 a", "'", "a'", "'re", "'r"]
    texts += ["".join(rng.choice("aRsETvdlLm''’. 1") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for most in (10_000, 50):  # the second forgets all the time
        tok.most = most
        for lo in range(0, len(texts), 100):
            for t, got in zip(texts[lo : lo + 100], tok.encode(texts[lo : lo + 100]), strict=True):
                assert got.tolist() == tok.ids(t).tolist(), ascii(t)


def _multiset(text):
    w = text.lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def _classes(rows, similarity=0.8):
    """Class of each row by comparing all pairs: (id, text) -> index of the class; and the links between different texts."""
    parent, links = list(range(len(rows))), set()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [_multiset(t or "") for _, t in rows]
    sizes = [sum(s.values()) for s in sets]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            both = sum((sets[i] & sets[j]).values()) if min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]) else 0
            if rows[i][1] == rows[j][1] or (both and both >= similarity * (sizes[i] + sizes[j] - both)):
                parent[find(i)] = find(j)
                if rows[i][1] != rows[j][1]:
                    links.add((i, j))
    return [find(i) for i in range(len(rows))], links


def test_near_duplicates_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.id, r.class_id): r.class_size for r in near_dup.near_duplicates(docs).collect()}
    classes, _ = _classes(rows)
    least = {}
    for c, (d, _) in zip(classes, rows, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    assert {(d, least.get(c)) for c, (d, _) in zip(classes, rows, strict=True)} == set(got)
    kept = near_dup.representatives(docs)
    assert kept.columns == docs.columns and near_dup.representatives(empty(docs)).count() == 0


def test_near_duplicates_lose_no_link(spark):
    """Families of texts edited more and less, many of them about 0.8 alike: every link found by comparing all pairs lies within a class."""
    rng, rows = random.Random(21), []
    for family in range(25):
        base = prose(rng.randint(60, 160), rng).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"new{family}x{rng.randrange(5)}"
            rows.append((len(rows), " ".join(w)))
    classes, links = _classes(rows)
    assert len(links) > 300
    got = {r.id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[i] == got[j] for i, j in links) / len(links)
    wrong = sum(1 for i in got if classes[i] != classes[got[i]])
    assert recall == 1.0 and wrong == 0


def test_dart_signatures_estimate_similarity():
    a, b = prose(400).split(), prose(400).split()
    mixed = a[:300] + b[:60]
    doc, region = near_dup.elements([a, mixed])
    sig = near_dup.dart_signatures(doc, region, 2, 2000)
    x, y = Counter(tuple(a[i : i + 5]) for i in range(396)), Counter(tuple(mixed[i : i + 5]) for i in range(356))
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def _without_repeats(rows):
    starts = Counter()
    for _, text in rows:
        b = (text or "").encode()
        starts.update(b[i : i + 200] for i in range(len(b) - 199))
    want = []
    for doc, text in rows:
        b = (text or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 199):
            if starts[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\x01" * 200
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        want.append((doc, len(b), sum(hit), sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("most", [2000, 3])  # the second splits nearly all blocks into cells
def test_suffix_dedup_against_brute_force(spark, docs, most, monkeypatch):
    rng = random.Random(8)
    passage, other = prose(60, rng), prose(50, rng)
    extra = [(500 + i, prose(20, rng) + passage + prose(25, rng)) for i in range(14)] + [(600 + i, prose(3, rng) + passage[: 230 + 9 * i] + other + "é" * 230 + str(i)) for i in range(9)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    monkeypatch.setattr(suffix_dedup.repeats, "__defaults__", (most,))
    got = [tuple(r) for r in suffix_dedup.digest(suffix_dedup.dedup(both)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(_without_repeats([(r.doc_id, r.text) for r in both.collect()]), key=key)


def test_suffix_dedup_edges(spark, docs):
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_u", "u", "row", "spans", "_spans", "n_removed")])
    assert suffix_dedup.without_repeats(clash).columns == clash.columns and suffix_dedup.without_repeats(clash).count() == clash.count()
    assert suffix_dedup.without_repeats(empty(docs)).count() == 0 and suffix_dedup.digest(suffix_dedup.dedup(empty(docs))).count() == 0


def test_shard_orders_merge_to_the_order_of_all():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice([97, 98], int(rng.integers(40, 300)), p=[0.9, 0.1]).astype(np.uint8)) for _ in range(300)] * 2
    far = np.array([int(rng.integers(0, 30)) for _ in texts])
    block = rng.integers(0, 3, len(texts))
    shard = rng.integers(0, 5, len(texts))
    rows, lcps, runs = [], [], []
    for s in range(5):
        own = np.flatnonzero(shard == s)
        order, lcp = suffix_dedup.shard_order(block[own], [texts[i] for i in own], far[own])
        rows.append(own[order]), lcps.append(lcp), runs.append(np.full(len(own), s))
    rows, lcps, runs = map(np.concatenate, (rows, lcps, runs))
    by = np.lexsort((np.arange(len(rows)), runs, block[rows]))
    rows, lcps, runs = rows[by], lcps[by], runs[by]
    keys, length = suffix_dedup.right_keys([texts[i] for i in rows], far[rows])
    order, common = suffix_dedup.interleave(block[rows], runs, keys, length, lcps)
    right = [texts[i][far[i] : far[i] + 200] for i in rows[order]]
    assert [(block[i], r) for i, r in zip(rows[order], right, strict=True)] == sorted((block[i], texts[i][far[i] : far[i] + 200]) for i in range(len(texts)))
    for k in range(1, len(right)):
        same = next((j for j, (x, y) in enumerate(zip(right[k - 1], right[k], strict=False)) if x != y), min(len(right[k - 1]), len(right[k])))
        assert common[k] == (same if block[rows[order[k]]] == block[rows[order[k - 1]]] else 0)


def test_rule_counts(spark):
    texts = ["a b c a b c x", None, "", "l1\nl1\n\nl2 | $5", "a\x1cb c d"]
    counts, _ = text_stats.measure(texts)
    assert counts.tolist() == [[7, 7, 0, 0, 6], [0] * 5, [0] * 5, [5, 9, 2, 1, 0], [2, 6, 0, 0, 0]]


def test_rule_counts_against_plain_counting():
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\t#$|é\x1c\xa0") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    counts, _ = text_stats.measure(texts)
    for t, c in zip(texts, counts.tolist(), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert c == [len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)], ascii(t)


def test_forest_and_threshold():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 3)), np.zeros((2000, 1))], 1)
    odd = x[:200].copy()
    odd[:, 3] = 0.4  # only a feature that never varies among the good tells them
    both = np.concatenate([x, odd])
    forest = quality_rules.Forest.fit(x, both.min(0), both.max(0))
    good, bad = forest.score(x), forest.score(odd)
    assert (bad[:, None] > np.quantile(good, 0.98)).mean() > 0.95
    per = np.zeros((2, 12))
    per[1, 2], per[1, 3], per[0, 3], per[0, 8] = 990, 10, 1, 50
    assert quality_rules.threshold(per, 0.99) == 2
    per[0, 3] = 0
    assert quality_rules.threshold(per, 0.99) == 4
    assert quality_rules.threshold(np.zeros((2, 12)) + [[0], [1]], 0.5) == 5


def test_class_prior():
    rng = np.random.default_rng(2)
    pos, neg = rng.beta(6, 2, 4000), rng.beta(2, 6, 4000)
    for share in (0.2, 0.5, 0.9):
        unl = np.concatenate([rng.choice(pos, int(4000 * share)), rng.choice(neg, 4000 - int(4000 * share))])
        assert abs(quality_pu.class_prior(rng.beta(6, 2, 4000), unl) - share) < 0.08


def test_learned_operators_on_edges(spark):
    """Empty tables, repeated rows and ids, columns that clash, labels of one kind."""
    rows = [(i, prose(60), 1, 2) for i in range(40)] + [(7, prose(60), 1, 2), (None, None, 1, 2), (8, "", 1, 2), (9, "word " * 30000, 1, 2)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, id int, x int")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] * 2 + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for run in (lambda d, k: quality_pu.quality_scores(d, k), lambda d, k: quality_rules.quality_rules(d, k), lambda d, k: toxicity.toxicity_scores(d, k)):
        got = run(docs, labels).collect()
        assert len(got) == 2 * len(rows)
        assert len({(r[0], str(r)) for r in got}) <= len(rows)  # equal rows have equal results
        assert run(empty(docs), labels).count() == 0 and run(docs, labels.where("false")).count() == 2 * len(rows)
    assert toxicity.toxicity_scores(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")).where("score between 0 and 1").count() == 2 * len(rows)


def test_quality(spark):
    good = [(i, prose(80).capitalize() + ".") for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(80).split())) for i in range(60)]
    docs = spark.createDataFrame(good + bad + EDGE, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_pu.quality_scores(docs, labels).where("held_out and doc_id is not null").collect()}
    right = [(r.score >= 0.5) == (d < 1000) for d, r in got.items() if d < 1000 or 1005 < d]
    assert sum(right) >= 0.9 * len(right)
    rules = quality_rules.quality_rules(docs, labels).collect()
    assert len(rules) == docs.count()
    assert sum(r.kept for r in rules if r.doc_id is not None and r.doc_id < 1000) >= 0.95 * 150
    assert not any(r.kept for r in rules if r.doc_id is not None and r.doc_id > 1005)
    assert quality_rules.quality_rules(docs, labels.where("false")).count() == docs.count()


def test_first_by_hash_equals_a_full_sort(spark):
    ids = spark.createDataFrame([(i,) for i in range(5000)] + [(None,)] * 3 + [(7,)] * 40, "id long")
    for n in (1, 300, 4000):
        assert common.first_by_hash(ids, n).collect() == ids.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    assert common.first_by_hash(ids.where("false"), 5).count() == 0


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(400):
        w = prose(60).split()
        if i % 3 == 0:
            w[RNG.randrange(60)] = RNG.choice(["zugbork", "zug-bork", "zugxbork", "zuggbork"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows + [(2000 + i, t) for i, (_, t) in enumerate(EDGE)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, lab).where("held_out and doc_id < 400").collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) >= 0.95 * len(got)
    assert toxicity.toxicity_scores(docs, lab.where("false")).where("score > 0").count() == 0
    k = toxicity.Kernel(["idiot"])
    assert k.rows(["idxiot"])[0, 0] > 0.4 and k.rows(["pilot"])[0, 0] == 0
    assert "idiot" in toxicity.units("you i d i o t !")


def test_kernel_rows_equal_plain_products():
    """Each word's product with each landmark, from the pairs of code and landmark that there are, not from a table of all."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeilostné") for _ in range(rng.randint(1, 9))) for _ in range(400)] + [""]
    marks = words[:30]

    def plain(w):
        codes = toxicity.features([w])
        return dict(zip(codes[1].tolist(), codes[2].tolist(), strict=True))

    k = toxicity.Kernel(marks)
    fs, fm = [plain(w) for w in words], [plain(w) for w in marks]
    want = np.array([[sum(v * m.get(c, 0) for c, v in f.items()) for m in fm] for f in fs])
    want[want < toxicity.LEAST] = 0
    assert np.allclose(k.rows(words), want**2, atol=1e-6) and (want > 0).any()
    assert len(k.value) == sum(map(len, fm))


def test_workers_give_back_what_they_held():
    """What one operator leaves in a worker goes back to the system when the next begins: the pipeline's stages share workers."""
    import os
    import subprocess
    import sys

    code = """
import re
from gradus.llm import common
size = lambda: int(re.search(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
common.release()
before = size()
common.held("a", lambda: [bytes(1000) for _ in range(200_000)])
common.hashed([f"w{i}" for i in range(200_000)])
keep = [bytes(2000) for _ in range(10)]
assert size() > before + 150
common.release()
assert not common.WORDS and size() < before + 60, (before, size())
"""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory is read from /proc")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_texts_go_to_the_workers_once(spark, docs):
    """Rows that stages carry beside the text do not hold it a second time."""
    assert suffix_dedup.dedup(docs).where("row.text is not null").count() == 0
    rows = [(i, "clean words only" if i % 2 else "you zugbork there", "x") for i in range(80)]
    some = spark.createDataFrame(rows, "doc_id long, text string, score string").select("score", "text", "doc_id")
    lab = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = toxicity.clean_documents(some, lab)
    assert kept.columns == some.columns and sorted(kept.collect()) == sorted(r for r in some.collect() if "clean" in r.text)


def test_stages_tell_texts_of_one_id_apart(spark):
    texts = [prose(60) for _ in range(6)]
    rows = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (8, texts[5]), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted((r.n, r.doc_id, r.text) for r in near_dup.representatives(docs).collect())
    assert kept == [(k, i, t) for k, (i, t) in enumerate(rows) if k != 6]
    items = spark.createDataFrame([(1, texts[1]), (2, texts[4])], "item_id long, text string")
    assert sorted(r.n for r in decontaminate.without_leaks(docs, items).collect()) == [0, 2, 3, 5, 6, 7]


def test_leaks(spark):
    items = spark.createDataFrame([(1, "If Anna buys 12 apples and pays 3 dollars for each of the apples in the red basket how much does Anna pay"), (2, None), (3, "too short")], "item_id long, text string")
    q = "noise. if {a} buys 40 apples and pays {n} dollars for each of the apples in the red basket how much does {b} pay? ok"
    docs = spark.createDataFrame([(1, q.format(a="Bob", b="Bob", n=9)), (2, q.format(a="Bob", b="Carl", n=9)), (3, None), (4, ""), (5, prose(100)), (5, prose(100))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, items).collect()] == [(1, 1, "template")]
    assert decontaminate.without_leaks(docs, items).count() == 5 and decontaminate.leaks(docs.where("false"), items).count() == 0


def test_leaks_are_judged_by_occurrence(spark):
    q = "If Anna buys {} apples and pays {} dollars for each of the apples in the red basket how much does Anna pay"
    twice = "take the long way from the old mill to the bridge with {} horses then "
    items = [(1, q.format(12, 3)), (2, (twice.format(5) + twice.format(7)).strip()), (3, "Who wrote the lost letters"), (4, "12 + 15 = 27"), (5, "7 8 9 10 11 12 13 14 15")]
    items = spark.createDataFrame(items, "item_id long, text string")
    noted = "If Anna now buys {} apples and pays {} dollars for each of the good apples in the red basket how much does Anna pay"
    rows = [
        (1, q.format(12, 3) + ". " + q.format(40, 9)),  # a literal copy and a variant
        (2, q.format(41, 8) + ". " + q.format(40, 9)),  # two variants
        (3, "so " + items.where("item_id = 2").first().text + " end"),  # an item that repeats its own windows
        (4, "well, Who wrote the lost letters of Rome"),
        (5, "that 12 + 15 = 27 holds"),
        (6, "that 12 + 15 = 28 fails"),
        (7, "count 7 8 9 10 11 12 13 14 15 16"),
        (8, noted.format(40, 9) + ". " + noted.format(41, 8)),  # two variants with words put in
        (9, "well, Bob wrote the lost letters of Rome"),
    ]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, "exact"), (2, 1, "template"), (3, 2, "exact"), (4, 3, "exact"), (5, 4, "exact"), (7, 5, "exact"), (8, 1, "template")}


def test_leaks_against_brute_force(spark):
    """Items and documents of one small vocabulary, so that windows repeat; numbers stand for slots."""
    rng = random.Random(5)
    few = VOCAB[:12]
    line = lambda n: [rng.choice(few) for _ in range(n)]
    items, docs = [], []
    for k in range(25):
        w = line(rng.randint(9, 30))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = str(rng.randint(1, 3))
        items.append((k, " ".join(w)))
    for k in range(120):
        w = line(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):  # pieces of items, with other numbers
            piece = rng.choice(items)[1].split()
            lo = rng.randrange(len(piece))
            piece = [str(int(p) + rng.choice((0, 7))) if p.isdigit() else p for p in piece[lo : lo + rng.randint(4, 30)]]
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((k, " ".join(w)))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    tmpl = lambda w: ["~num" if x.isdigit() else x for x in w]
    want_exact = set()
    for d, text in docs:
        for i, item in items:
            w, v = text.split(), item.split()
            wins = [p for p in range(len(v) - 7) if sum(not x.isdigit() for x in v[p : p + 8]) >= 4]
            hits = [(p, q) for p in wins for q in range(len(w) - 7) if tmpl(v[p : p + 8]) == tmpl(w[q : q + 8])]
            found = False
            for off in {q - p for p, q in hits}:  # one alignment: each number of the item stands for one number there
                at = [(p, q) for p, q in hits if q - p == off]
                slots = {(v[p + k], w[q + k]) for p, q in at for k in range(8) if v[p + k].isdigit()}
                if len({p for p, _ in at}) >= 0.4 * len(wins) and (len({a for a, _ in slots}) == len(slots) or all(a == b for a, b in slots)):
                    found = True
            if found and wins:
                want_exact.add((d, i))
            if len({p for p, _ in hits}) < 0.4 * len(wins):
                assert (d, i) not in got
    assert len(want_exact) > 30 and want_exact <= set(got)
    # what else is found comes from copies with words put in or left out: few here
    assert len(got) <= len(want_exact) * 1.5


def test_extract(spark):
    notice = "<p>We use small cakes here</p>"
    page = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>Cookies!</div><article><h1>T{i}</h1>" + notice + "<p>One &amp; two {i}\n x<b> y{i}</b><br>z{i}<p>Three{i}</article><div id=comments>bad</div><footer>f</footer>"
    rows = [(i, "http://h.example/", page.replace("{i}", str(i))) for i in range(24)] + [(110, None, None), (111, "u", ""), (112, "http://x/", "<p>a<script>var t='</p>'</script><p>b")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\nOne & two 3 x y3 z3\nThree3"
    assert got[110] == got[111] == "" and got[112] == "a\nb"


def test_extract_keeps_repeated_and_copied_pages(spark):
    page = "<html><body><article><h1>T{i}</h1><p>Seen by all</p><p>One {i}</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i))) for i in range(24)]
    rows += rows  # every row twice
    rows += [(100 + i, f"http://c.example/{i}", page.replace("{i}", str(min(i, 2)))) for i in range(40)]  # copies under other urls
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id < 100) == sorted((i, f"T{i}\nOne {i}") for i in range(24) for _ in range(2))
    assert all(r.text == f"T{min(r.page_id - 100, 2)}\nSeen by all\nOne {min(r.page_id - 100, 2)}" for r in got if r.page_id >= 100)


def test_extract_without_a_main_container(spark):
    """The template tells the article from a header and a sidebar that change on every page; without it they stay."""
    rng = random.Random(4)
    page = "<html><body><div class=x1><b>Site</b><i>{h}</i></div><div class=x2><p>Read this too</p><p>{a}</p><p>{b}</p></div><div class=x3><em>Now: {s}</em></div><div class=x4>End</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(h=prose(3, rng), a=prose(30, rng), b=prose(30, rng), s=prose(4, rng))) for i in range(40)]
    rows += [(100, "http://h.example/x", page.format(h="h", a="Site", b=prose(30, rng), s="s"))]  # text of the template, out of its order
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: html_extract.re.findall("<p>(.*?)</p>", h)[1:] for i, _, h in rows}
    assert all(got[i].split("\n") == want[i] for i in want)
    assert all(len(html_extract.main_text(h).split("\n")) > 2 for _, _, h in rows)


def test_templates_keep_only_tokens_in_order_and_nested(spark):
    """Tokens of a class that change places from page to page, or lie in another gap, are no template."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        a, b = ("<b class=q1>One</b>", "<b class=q2>Two</b>") if i % 2 else ("<b class=q2>Two</b>", "<b class=q1>One</b>")
        guest = "<i class=g>Guest</i>" if i % 20 else ""  # on 95 % of pages, on a third of these at the end
        rows.append((i, "h.example", f"<html><body><div class=x1>Top</div>{a}{b}{guest if i % 3 else ''}<div class=x2>{prose(20, rng)}</div><div class=x3>End</div>{'' if i % 3 else guest}</body></html>"))
    pages = spark.createDataFrame(rows, "uid long, host string, html string")
    got = html_extract.templates(pages).collect()
    assert len(got) == 1
    nodes = [(path, text) for path, text, *_ in html_extract.nodes(rows[1][2])]
    token = {text: html_extract._token(path, text) for path, text in nodes if text}
    tokens = got[0].tokens
    assert tokens.index(token["Top"]) < tokens.index(token["End"]) and token["Guest"] not in tokens
    assert not {token["One"], token["Two"]} <= set(tokens)


def test_extract_edges(spark):
    deep = "<div>" * 20000 + "<article><p>In</p></article>" + "</div>" * 20000 + "<nav>" + "<i>" * 500 + "menu" + "</i>" * 500 + "</nav>"
    named = "<article><h1 class='article-header'>H</h1><p class='share-price'>S</p><p class='ad'>A</p><div class='share-bar'>B</div><p>x &lt;y&gt; &#233;</p></article>"
    rows = [(1, "http://a/", deep), (2, "http://a/", named), (3, None, "<p>no host"), (3, None, "<p>no host"), (4, "http://a/", "<article>" + "<p>w w</p>" * 30000 + "</article>"), (5, "http://a/", "<div <p>< broken")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, tokens int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()]
    assert sorted(g for g in got if g[0] < 4) == [(1, "In", 2), (2, "H\nS\nx <y> é", 11), (3, "no host", 7), (3, "no host", 7)]
    assert next(n for i, _, n in got if i == 4) == 30000 * 4 - 1
    assert html_extract.extract(df.where("false")).count() == 0


def test_language(spark):
    rows = [(i, " ".join(RNG.choice(["the", "thing", "with", "house"]) for _ in range(30)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(RNG.choice(["der", "schön", "nicht", "haus"]) for _ in range(30)), "de") for i in range(40)]
    rows += [(900, None, "en"), (901, "12 34", None), (902, "", "de"), (None, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs).collect()}
    assert all(got[i] == "en" and got[100 + i] == "de" for i in range(40))
    assert got[900] == got[901] == got[902] == "und" and got[None] == "en"
    assert language_id.language_id(docs.where("false")).count() == 0


def test_language_with_the_table_in_the_cluster(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(40)), "en") for i in range(60)]
    rows += [(100, "der schöne häßliche vogel singt nicht, Straße", "de"), (101, None, "de"), (102, "12 34 x", None), (102, "12 34", None), (103, "der vogel", None), (104, "vogel " * 9, None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    key = lambda r: (r.id, r.lang_pred)
    sent, kept = (sorted(language_id.identify(docs, docs, n).collect(), key=key) for n in (16_000_000, 10))
    assert [key(r) for r in sent] == [key(r) for r in kept] and {r.lang_pred for r in kept} == {"en", "de", "und"}
    for a, b in zip(sent, kept, strict=True):
        assert abs(a.score - b.score) < 1e-4 and (a.entropy is None) == (b.entropy is None) and abs((a.entropy or 0) - (b.entropy or 0)) < 1e-4


def _kneser_ney(learn):
    """Interpolated Kneser-Ney by plain counting: word -> log-probability, for one language."""
    grams = Counter()
    for text in learn:
        for w in text.split():
            if c := language_id.core(w):
                s = "    " + c + " "
                grams.update(s[i : i + 5] for i in range(len(c) + 1))
    levels = {5: grams}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / 4096
        same = [(h, n) for h, n in levels[k].items() if h[:-1] == g[:-1]]
        total = sum(n for _, n in same)
        if not total:
            return p(g[1:])
        return max(levels[k][g] - 0.75, 0) / total + 0.75 * len(same) / total * p(g[1:])

    return lambda c: sum(np.log(p(("    " + c + " ")[i : i + 5])) for i in range(len(c) + 1))


def test_language_scores_equal_plain_counting(spark):
    rng = random.Random(9)
    by = {"en": [prose(30, rng) for _ in range(8)], "de": ["der schöne Häßliche vogel, singt nicht! 12x"], "x": ["中文 字 中"]}
    learn = spark.createDataFrame([(k, t) for k, ts in by.items() for t in ts], "lang string, text string")
    model = language_id.Model(language_id.gram_table(learn).toArrow())
    words = ["vogel", "singen", "中文", "aeio", VOCAB[3], "qqq"]
    want = np.array([[_kneser_ney(by[k])(w) for k in model.langs] for w in words])
    assert model.langs == ["de", "en", "x"] and np.allclose(model.words(words)[:, :-1], want, rtol=1e-5)
    known = language_id.Known(model, most=4)  # forgets all the time
    for _ in range(3):
        for w in words:
            known.learn([[w, w + "!"]])
            assert np.allclose(known.text([w, w + "!"])[:-1], 2 * want[words.index(w)], rtol=1e-4)


def test_a_rare_language_stays(spark):
    rows = [(i, "the thing with house " * 9, "en") for i in range(300)] + [(1000 + i, "ĉu vi ŝatas la ĝardenon", "eo") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == "eo" for r in language_id.language_id(docs).where("doc_id >= 1000").collect())


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    rows, labels = [], []
    passage, item = prose(60, rng), prose(40, rng)
    for i in range(300):
        w = prose(rng.randint(40, 90), rng).split()
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["zugbork", "zug-bork", "zuggbork"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(400 + i, rows[i][1]) for i in range(1, 30, 4)]  # exact copies
    rows += [(500 + i, rows[i][1] + " edited") for i in range(2, 30, 4)]  # near copies
    rows += [(600 + i, prose(30, rng) + " " + passage + " " + prose(30, rng)) for i in range(5)]
    rows += [(700 + i, prose(30, rng) + " " + item + " " + prose(30, rng)) for i in range(1)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, row int, _id int, _key int, _u int, _spans int, _leaking int, id int, v int"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), *range(8)) for d, t in rows], extra)
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    clean = {r.doc_id for r in toxicity.clean_documents(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    toxic = {d for d, t in rows if "bork" in t}
    assert len(toxic & clean) <= 0.05 * len(toxic) and len(set(dict(rows)) - toxic - clean) <= 0.05 * len(rows)
    at = [(d, t) for d, t in rows if d in clean]
    classes, _ = _classes(at)
    first = {}
    for c, (d, t) in sorted(zip(classes, at, strict=True), key=lambda x: x[1][0]):
        first.setdefault(c, (d, t))
    at = sorted(first.values())
    starts = Counter(t[i : i + 200] for _, t in at for i in range(len(t) - 199))
    cut = []
    for d, t in at:
        hit = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                hit[i : i + 200] = b"\x01" * 200
        cut.append((d, "".join(c for c, h in zip(t, hit, strict=True) if not h)))
    tok = packing.RunIds(packing.tokenizer_path())
    want = {d: len(tok.ids(t)) + 1 for d, t in cut if item not in t}
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == want and 700 not in got and any(a != b for a, b in zip(at, cut, strict=True))
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, prose(80), "en", "s", 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "a b c")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(40))
