"""Sharding by a hierarchical weighted hash tree, DataFrame functions only.

A document descends from the root to a region, from there to a rack and from there to a
shard. At every level each child draws u in (0, 1] from a hash of (doc_id, child) and the
child with the greatest ln(u) / weight wins, where a node's weight is that of the shards
below it. A draw doesn't depend on the siblings, so if a weight grows, documents only move
into that child; everything below a node whose weights stay the same keeps its place.

Law `key`: doc_id and the number of shards decide. A grown tree gets its new shard as a
new region, so the only subtree whose weight changed is that shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared

#: A tree is {region: {rack: {shard: weight}}}.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, per_region: int = 4) -> Tree:
    """Shards 0.. in racks and regions of fixed sizes, weight 1 each."""
    out: Tree = {}
    for s in range(shards):
        out.setdefault(f"region{s // per_region}", {}).setdefault(f"rack{s // per_rack}", {})[s] = 1.0
    return out


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and region of its own."""
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, name: str, weight: float) -> Column:
    """ln(u) / weight, u from the first 48 bits of an MD5 of the key and the node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 12), 16, 10).cast("double")
    return F.log((bits + 1) / F.lit(float(2**48))) / F.lit(weight)


def pick(key: Column, node, path: str = "") -> Column:
    """The shard that the key's descent from this node ends in. Of equal draws the later child wins."""
    if not isinstance(node, dict):
        raise TypeError("a tree ends in shards")
    children = [(n, c) for n, c in node.items() if _weight(c) > 0]
    ends = [pick(key, c, f"{path}{n}/") if isinstance(c, dict) else F.lit(int(n)) for n, c in children]
    if len(ends) == 1:
        return ends[0]
    draws = [draw(key, f"{path}{n}", _weight(c)) for n, c in children]
    best, out = F.greatest(*draws), ends[0]
    for d, end in zip(draws[1:], ends[1:]):
        out = F.when(d == best, end).otherwise(out)
    return out


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null doc_id is drawn as an empty key; a null text has size 1 and the CRC of no bytes.
    Repeated rows each get a row and a slot; other columns are left out. An empty table gives none.
    Slots follow doc_id within a shard, ties by text checksum and size.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    placed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        pick(key, tree).cast("int").alias("shard"),
        (pick(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    out = shared.dense_slots(placed, ["shard"], ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(8)
    return shard_documents(shared.table(spark, sf_dir, "documents"), tree, with_shard(tree, 8))
