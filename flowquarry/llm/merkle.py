"""A Merkle manifest of a table: trees of fan-out 8, stored in blocks that are laid out by van Emde Boas.

Method. Every row is a leaf; the leaves of a group (a language) stand in the order of their ids. While a level has several
nodes, every 8 consecutive ones become their parent. The tree is stored in blocks of `CAPACITY` aligned leaves with the
levels above them. In a block, a subtree is cut at half its height again and again: the top half first, then each of
the bottom subtrees, each stored in one stretch (`address`). Building and finding siblings are arithmetic on these addresses.
The blocks' roots are the leaves of the next tier, until a group has one root; the groups' roots, in the groups' order, are
the leaves of one more such tree. A proof holds the siblings of a leaf, level by level.

Scale. Texts are hashed once, where they are read, and only digests travel. Ranks in a group come from sampled ranges: rows
are numbered within a range, and the ranges' counts are added up before, so one group with most of the rows is spread over
many tasks. A task holds one block. The driver sees the number of tiers and the one root.

Cases. A null field is written as `-`; a null group comes first; null ids come first in their group. Repeated ids stand in
the order of their leaves, and repeated rows are leaves of their own. A group of one row has its leaf as root. An empty
table gives no rows and no root. Texts of any length are one leaf each. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.stage import settled
from flowquarry.llm.textcore import giving_back

FAN, HEIGHT = 8, 4
CAPACITY = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_size(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of a depth (the root's is 0) in a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = levels - top, FAN ** (depth - top)
    return tree_size(top) + index // below * tree_size(bottom) + address(bottom, depth - top, index % below)


def rise(n: int) -> int:
    """How many levels the block of a group with n nodes in its tier has above its leaves."""
    levels = 0
    while FAN**levels < n and levels < HEIGHT:
        levels += 1
    return levels


def grow(leaves: list[str], levels: int) -> tuple[bytes, str]:
    """The stored block over the leaves' digests, `levels` levels above them, and its root."""
    places, nodes, current = [], [], leaves
    for depth in range(levels, -1, -1):
        places.append(address(levels + 1, depth, np.arange(len(current))))
        nodes.append(np.frombuffer(bytes.fromhex("".join(current)), np.uint8).reshape(-1, 32))
        if depth:
            current = [digest("".join(current[i : i + FAN])) for i in range(0, len(current), FAN)]
    places, nodes = np.concatenate(places), np.concatenate(nodes)
    tree = np.zeros((int(places.max()) + 1, 32), np.uint8)
    tree[places] = nodes
    return tree.tobytes(), current[0]


class Block:
    """A stored block of n leaves."""

    def __init__(self, tree: bytes, n: int, levels: int):
        self.tree, self.levels, self.counts = tree, levels, [-(-n // FAN ** (levels - d)) for d in range(levels + 1)]

    def nodes(self, depth: int, first: int, last: int) -> list[str]:
        places = address(self.levels + 1, depth, np.arange(first, min(last, self.counts[depth])))
        return [self.tree[32 * a : 32 * a + 32].hex() for a in places.tolist()]

    def paths(self) -> Iterator[list[str]]:
        """For each leaf: what stands left and right of it and of each node above it, joined, from the leaves up."""
        runs: dict[int, tuple[int, list[str]]] = {}
        for leaf in range(self.counts[-1]):
            out, at = [], leaf
            for depth in range(self.levels, 0, -1):
                run = at // FAN
                if depth not in runs or runs[depth][0] != run:
                    runs[depth] = run, self.nodes(depth, run * FAN, run * FAN + FAN)
                own = runs[depth][1]
                out += "".join(own[: at % FAN]), "".join(own[at % FAN + 1 :])
                at = run
            yield out


def fold(leaf: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def _head(values: tuple[str | None, ...]) -> bytes:
    return b"".join(b"-" if v is None else b"%d:%s" % (len(v.encode()), v.encode()) for v in values)


def leaf(head: bytes, text: memoryview | bytes | None) -> str:
    """The digest of a row: the fields before the text, as they are written, and the text."""
    h = hashlib.sha256(head)
    if text is None:
        h.update(b"-")
    else:
        h.update(b"%d:" % len(text))
        h.update(text)
    return h.hexdigest()


def leaf_table(docs: DataFrame, is_tampered: Column, tamper: Callable[[bytes], bytes]) -> DataFrame:
    """(g, doc_id, digest, other): group, id and leaf of each row, and the leaf of its tampered text where `is_tampered` holds, else the leaf again."""
    g = F.coalesce(F.concat(F.lit("1"), docs["lang"].cast("string")), F.lit("0"))  # sorts as null first, then by bytes
    heads = [docs[c].cast("string").alias(f"_{i}") for i, c in enumerate(FIELDS[:-1])]
    rows = docs.select(g.alias("g"), docs["doc_id"].cast("long").alias("doc_id"), *heads, docs["text"].cast("string").alias("_text"), F.coalesce(is_tampered, F.lit(False)).alias("_tampered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            own, other = [], []
            for i, (*head, tampered) in enumerate(zip(*(batch.column(f"_{k}").to_pylist() for k in range(len(FIELDS) - 1)), batch.column("_tampered").to_pylist())):
                first, text = _head(tuple(head)), texts[i].as_buffer() if texts[i].is_valid else None
                own.append(leaf(first, None if text is None else memoryview(text)))
                other.append(leaf(first, tamper(text.to_pybytes())) if tampered and text is not None else own[-1])
            yield pa.record_batch([batch.column("g"), batch.column("doc_id"), pa.array(own, pa.string()), pa.array(other, pa.string())], names=["g", "doc_id", "digest", "other"])

    return rows.mapInArrow(giving_back(run), "g string, doc_id long, digest string, other string")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0, in the group) and n (the group's rows). rows: a written table, of columns that Arrow has as they are; group: no null."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for x in batch.column(group).to_pylist():
                n = n + 1 if x == last else 0
                last = x
                at.append(n)
            yield pa.record_batch([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "_part", "_at"])

    schema = T.StructType([*rows.schema.fields]).add("_part", "integer").add("_at", "long")
    sorted_ = settled(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(giving_back(number), schema))
    counts = sorted_.groupBy("_part", group).agg(F.count("*").alias("_own"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_own").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select("_part", group, before.alias("_before"), F.sum("_own").over(own).alias("n"))
    found = sorted_.join(heads, ["_part", group])
    return found.withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


_BLOCKS = "g string, block long, n long, tree binary, root string"


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("rank")
    n = group["n"][0].as_py()
    tree, root = grow(group["digest"].to_pylist(), rise(n))
    return pa.table({"g": group["g"][:1], "block": pa.array([group["rank"][0].as_py() // CAPACITY], pa.int64()), "n": pa.array([n], pa.int64()), "tree": pa.array([tree], pa.binary()), "root": [root]})


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over nodes (g, rank, n, digest), from the leaves up. A group's last block is the one of its tier alone."""
    tiers = []
    while not tiers or not nodes.isEmpty():
        block = F.floor(F.col("rank") / CAPACITY)
        tiers.append(settled(nodes.select("g", "rank", "n", "digest", block.alias("block")).groupBy("g", "block").applyInArrow(_build, _BLOCKS)))
        up = tiers[-1].where(F.col("n") > CAPACITY)
        nodes = up.select("g", F.col("block").alias("rank"), F.ceil(F.col("n") / CAPACITY).alias("n"), F.col("root").alias("digest"))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(g, root) of every group."""
    found = [t.where(F.col("n") <= CAPACITY).select("g", "root") for t in tiers]
    for more in found[1:]:
        found[0] = found[0].union(more)
    return found[0]


def _block_of(row: dict) -> Block:
    return Block(row["tree"], min(CAPACITY, row["n"] - row["block"] * CAPACITY), rise(row["n"]))


_ABOVE = "g string, block long, above array<string>"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            above = [path + row["above"] for path in _block_of(row).paths()]
            at = np.arange(len(above)) + row["block"] * CAPACITY
            yield pa.record_batch([pa.array([row["g"]] * len(above)), pa.array(at), pa.array(above, pa.list_(pa.string()))], names=["g", "block", "above"])


def contexts(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, block, above): what stands beside each block of the lowest tier on the way up. above: the same (g, above) of each group's root."""
    alone = [t.where(F.col("n") <= CAPACITY).select("g", "block").join(above, "g") for t in tiers]
    found = alone[-1]
    for tier, own in zip(tiers[:0:-1], alone[-2::-1]):
        found = own.unionByName(tier.join(found, ["g", "block"]).mapInArrow(giving_back(_spread), _ABOVE))
    return found


def proofs(leaves: DataFrame, extra: str) -> DataFrame:
    """Per row of leaves (g, digest, other, and the columns of the schema `extra`): extra, digest, subroot, root, proof_sha256 and folded_root.

    leaves: a written table. `other` is what the path is folded from. Columns of `extra` give the order within a group before digests do.
    """
    spark = leaves.sparkSession
    names = [x.split()[0] for x in extra.split(", ")]
    nodes = settled(ranked(leaves, "g", [*names, "digest"]))
    tiers = forest(nodes)
    groups = settled(roots(tiers))
    tops = settled(ranked(settled(groups.select(F.lit("").alias("all"), "g", F.col("root").alias("digest"))), "all", ["g"]))
    top = forest(tops.select(F.col("all").alias("g"), "rank", "n", "digest"))
    one = roots(top).first()
    nothing = spark.createDataFrame([("", [])], "g string, above array<string>")
    beside = top[0].join(contexts(top, nothing), ["g", "block"]).mapInArrow(giving_back(_spread), _ABOVE).select(F.col("block").alias("rank"), "above")
    own = tiers[0].join(contexts(tiers, tops.select("g", "rank").join(beside, "rank").select("g", "above")), ["g", "block"])
    own = own.join(groups.withColumnRenamed("root", "subroot"), "g").drop("root")

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows, block = rows.sort_by("rank"), block.to_pylist()[0]
        proof, folded = [], []
        for other, path in zip(rows["other"].to_pylist(), _block_of(block).paths(), strict=True):
            path += block["above"]
            proof.append(digest("".join(path)))
            folded.append(fold(other, path))
        n = len(proof)
        return pa.table([*(rows[c] for c in names), rows["digest"], pa.array([block["subroot"]] * n), pa.array(proof), pa.array(folded)], names=[*names, "digest", "subroot", "proof_sha256", "folded_root"])

    at = nodes.withColumn("block", F.floor(F.col("rank") / CAPACITY)).groupBy("g", "block")
    schema = f"{extra}, digest string, subroot string, proof_sha256 string, folded_root string"
    found = at.cogroup(own.groupBy("g", "block")).applyInArrow(prove, schema)
    return found.withColumn("root", F.lit(one["root"] if one else None).cast("string"))


def audit(docs: DataFrame, is_tampered: Column, tamper: Callable[[bytes], bytes]) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Rows that `is_tampered` picks (null: not) fold their path from a leaf of `tamper(text)` in place of their text; a null text stays.
    """
    found = proofs(settled(leaf_table(docs, is_tampered, tamper)), "doc_id long").withColumnRenamed("digest", "leaf")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
