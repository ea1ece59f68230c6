"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the node draws -ln(u)/weight for a row, u from a hash of (key, child), weight the sum of its shards'
weights; the row goes down to the child with the least draw. A row is compared with the regions, then with the racks of one region,
then with the shards of one rack. When a shard's weight changes, only the draws of that shard, its rack and its region change: rows move
into or out of that region's, that rack's and that shard's subtree, and no others move. A shard that is added later is a region of its
own (grow), so rows move into it alone.

Law: `key`. All in built-in functions; no row is compared with another to find its shard.

Cases: a null key is hashed as such and gets one fixed shard; null and empty texts have size 16;
repeated rows share a shard and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 40
SIZE_EXTRA = 16
CHUNK = 100_000


@dataclass(frozen=True)
class Tree:
    """weights[i] is shard i's; the first `base` shards fill racks of `per_rack`, these regions of `per_region`, in order; each later one is a region."""

    weights: tuple[float, ...]
    per_rack: int = 4
    per_region: int = 3
    base: int | None = None

    @classmethod
    def even(cls, n: int, **k) -> Tree:
        return cls((1.0,) * n, **k)

    def grow(self, weight: float = 1.0) -> Tree:
        """One shard more."""
        return Tree((*self.weights, weight), self.per_rack, self.per_region, len(self.weights) if self.base is None else self.base)

    def regions(self) -> list[list[list[int]]]:
        """Shards by region and rack; those without weight are left out, which leaves the places of the others as they are."""
        base = len(self.weights) if self.base is None else self.base
        out: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.weights):
            rack = i // self.per_rack if i < base else -1 - i
            region = rack // self.per_region if i < base else -1 - i
            if w > 0:
                out.setdefault(region, {}).setdefault(rack, []).append(i)
        return [list(racks.values()) for racks in out.values()]


#: hash seeds of the levels
_REGION, _RACK, _SHARD = 101, 102, 103


def descend(key: str, tree: Tree) -> Column:
    """The shard of a key column: least draw by region, then rack, then shard (a tie goes to the lower place).

    The tree is a constant nested array, walked by higher-order functions: the plan stays small at any shard count.
    """
    weigh = lambda shards: sum(tree.weights[i] for i in shards)
    node = lambda name, w, below: f"named_struct('id', {name}L, 'w', {float(w)!r}D, 'below', {below})"

    def rack(shards: list[int], name: int) -> str:
        leaves = ", ".join(f"named_struct('id', {i}L, 'w', {float(tree.weights[i])!r}D)" for i in shards)
        return node(name, weigh(shards), f"array({leaves})")

    regions = []
    for racks in tree.regions():
        first = min(i for r in racks for i in r)
        in_base = tree.base is None or first < tree.base
        name = lambda i, n: i // n if in_base else -1 - i  # noqa: B023, E731
        below = ", ".join(rack(r, name(r[0], tree.per_rack)) for r in racks)
        regions.append(node(name(first, tree.per_rack * tree.per_region), weigh([i for r in racks for i in r]), f"array({below})"))
    draw = lambda x, level: f"-ln((shiftrightunsigned(xxhash64(`{key}`, {x}.id, {level}), 11) + 0.5D) / 9007199254740992D) / {x}.w"
    least = lambda nodes, x, level: f"array_min(transform({nodes}, ({x}, {x}_at) -> named_struct('draw', {draw(x, level)}, 'at', {x}_at))).at"
    # each level picks the place of the child; element_at goes down to it
    region = f"transform(array(array({', '.join(regions)})), g -> element_at(g, {least('g', 'x', _REGION)} + 1))"
    one = f"transform({region}, g -> element_at(g.below, {least('g.below', 'y', _RACK)} + 1))"
    return F.expr(f"element_at(transform({one}, r -> element_at(r.below, {least('r.below', 'z', _SHARD)} + 1).id), 1)")


def assign(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    return df.withColumn(name, descend(key, tree))


def shard_documents(docs: DataFrame, shards: int = SHARDS, buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Equal rows are counted before the shuffle. A slot is the sum of the counts in earlier buckets of the
    shard (one number a shard and bucket) plus the place within the bucket, so no task gets a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + SIZE_EXTRA).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    tree = Tree.even(shards)
    rows = assign(assign(rows, "doc_id", tree), "doc_id", tree.grow(), "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(buckets)).cast("int"))
    totals = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(base), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))  # shards x buckets rows at most
    rows = rows.withColumn("at", F.col("base") + F.col("first"))
    # equal rows come back one by one, CHUNK at a time, so that no array grows with their number
    rows = rows.select("*", F.explode(F.expr(f"sequence(at, at + n - 1, {CHUNK}L)")).alias("lo"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.explode(F.expr(f"sequence(lo, least(lo + {CHUNK - 1}, at + n - 1))")).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
