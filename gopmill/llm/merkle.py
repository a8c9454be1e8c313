"""Merkle manifest of a document table, with proofs, its nodes stored in van Emde Boas order.

Each row is a leaf. Per language the leaves ascend by doc_id, and every FANOUT consecutive nodes become their parent,
level by level, until one is left, the subroot; the subroots of all languages are the leaves of one more such tree, whose
top is the root. A tree is cut into blocks of HEIGHT levels: aligned subtrees of up to FANOUT ** HEIGHT leaves, whose tops
are the leaves of the next layer of blocks. A block is an array in van Emde Boas order: its levels are split at half
height, the upper half is stored first, the subtrees below it after it from left to right, each laid out in the same way.
``address`` finds any node by arithmetic alone; construction writes through it, and proofs read siblings through it.

How it runs: leaves are hashed by column functions and written, range-partitioned by (language, doc_id) and numbered by
sums over slices, so no language is one task's work. A task builds a block from at most FANOUT ** HEIGHT leaves, for one
layer after another (three layers for 10^8 documents, four for 10^10). For proofs the way from a block up to the root is
handed down from layer to layer, and a block's leaves meet its array in one task.

Null fields are '-', as the digest's rule says; null languages form the first tree, null ids come first in theirs and count
as '' where rows are picked for tampering. Rows of one id are ordered by their digests; rows equal in everything are leaves
beside each other. Other columns than the five are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import remainder
from gopmill.operators import slices
from gopmill.session import written

FANOUT, BITS = 8, 3
HEIGHT = 3
LEAVES = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "tree string, block bigint, size bigint, root string, nodes binary"
PATH = "tree string, block bigint, lefts array<string>, rights array<string>, subroot string, root string"


def digest(*inputs: bytes) -> bytes:
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


def leaf(text: Column) -> Column:
    """Digest of a row whose text is ``text``."""
    fields = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    coded = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


# -- one block ------------------------------------------------------------------------------------------------------


def slots(levels: int) -> int:
    """Nodes of a full subtree of that many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (0 is the top) are stored in a block of ``levels`` levels."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
        else:
            below = depth - upper
            at = at + slots(upper) + (index >> BITS * below) * slots(levels - upper)
            index = index & (FANOUT**below - 1)
            depth, levels = below, levels - upper
    return at


def height_of(size: int) -> int:
    """Levels above the leaves in a block of a tree that has ``size`` leaves on this layer."""
    height = 0
    while height < HEIGHT and FANOUT**height < size:
        height += 1
    return height


def block_of(leaves: np.ndarray, height: int) -> np.ndarray:
    """The array of a block; nodes that a last, shorter run lacks are empty."""
    levels, count = height + 1, len(leaves)
    nodes = np.zeros(slots(levels), "S64")
    nodes[address(levels, height, np.arange(count))] = leaves
    for depth in range(height - 1, -1, -1):
        count = -(-count // FANOUT)
        runs = nodes[address(levels, depth + 1, np.arange(count * FANOUT))].reshape(count, FANOUT)
        nodes[address(levels, depth, np.arange(count))] = [digest(*run.tolist()) for run in runs]
    return nodes


def siblings(nodes: np.ndarray, height: int, index: int) -> tuple[list[bytes], list[bytes]]:
    """What stands left and right of a leaf's way up through its block, from below."""
    lefts, rights = [], []
    for depth in range(height, 0, -1):
        place = index & (FANOUT - 1)
        run = nodes[address(height + 1, depth, np.arange(index - place, index - place + FANOUT))].tolist()
        lefts.append(b"".join(run[:place]))
        rights.append(b"".join(run[place + 1 :]))
        index >>= BITS
    return lefts, rights


def fold(node: bytes, lefts: Iterable[bytes], rights: Iterable[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights, strict=True):
        node = digest(left, node, right)
    return node


def _coded(texts: list[str]) -> list[bytes]:
    return [t.encode() for t in texts]


# -- layers of blocks -----------------------------------------------------------------------------------------------


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    size = table.column("size")[0].as_py()
    nodes = block_of(np.array(_coded(table.column("digest").to_pylist()), "S64"), height_of(size))
    top = nodes[0].decode()
    return pa.table({
        "tree": table.column("tree").slice(0, 1).cast(pa.string()), "block": table.column("block").slice(0, 1),
        "size": pa.array([size], pa.int64()), "root": [top], "nodes": pa.array([nodes.tobytes()], pa.binary()),
    })


def layers(rows: DataFrame) -> list[DataFrame]:
    """Blocks(tree, block, size, root, nodes) of each layer from below, each a written table.

    ``rows(tree, size, at, digest)``: leaves with their number from 0 and their tree's count of leaves.
    """
    out = []
    while True:
        blocks = rows.select("tree", "size", "at", "digest", F.shiftright("at", BITS * HEIGHT).alias("block"))
        out.append(written(blocks.groupBy("tree", "block").applyInArrow(_build, BLOCK)))
        above = F.ceil(F.col("size") / F.lit(LEAVES)).cast("bigint")
        rows = out[-1].where(F.col("size") > LEAVES).select(
            "tree", above.alias("size"), F.col("block").alias("at"), F.col("root").alias("digest")
        )
        if rows.isEmpty():
            return out


def tops(grown: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    ends = [layer.where(F.col("size") <= LEAVES).select("tree", "root") for layer in grown]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up from each leaf of a block: its siblings inside, then the block's own way."""
    for batch in batches:
        for row in batch.to_pylist():
            size, nodes = row["size"], np.frombuffer(row["nodes"], "S64")
            first = row["block"] * LEAVES
            height, count = height_of(size), min(LEAVES, size - first)
            ways = [siblings(nodes, height, i) for i in range(count)]
            yield pa.RecordBatch.from_pydict({
                "tree": [row["tree"]] * count, "block": pa.array(range(first, first + count), pa.int64()),
                "lefts": pa.array([[x.decode() for x in left] + row["lefts"] for left, _ in ways], pa.list_(pa.string())),
                "rights": pa.array([[x.decode() for x in right] + row["rights"] for _, right in ways], pa.list_(pa.string())),
                "subroot": [row["subroot"]] * count, "root": [row["root"]] * count,
            })


def ways(grown: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the lowest layer with their way up: ``above(tree, lefts, rights, subroot, root)`` is each tree's own."""
    found = None
    for layer in reversed(grown):
        alone = layer.where(F.col("size") <= LEAVES).select("tree", "block").join(above, "tree")
        known = alone if found is None else alone.unionByName(found)
        found_here = layer.select("tree", "block", "size", "nodes").join(known, ["tree", "block"])
        found = found_here.mapInArrow(_children, PATH)
    return found_here


def numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves(tree, ...)`` with ``at``, the place in their tree by a unique order, and the tree's ``size``."""
    ranged = slices.range_slices(leaves, [F.col("tree"), *order])

    def carries(over):
        whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return [F.coalesce(F.sum("_n").over(slices.before(over)), F.lit(0)).alias("_carry"), F.sum("_n").over(whole).alias("size")]

    carried = slices.inherit(ranged, ["tree"], F.col(slices.SLICE), [F.count(F.lit(1)).alias("_n")], carries)
    place = F.row_number().over(slices.in_slice(["tree"], ["_at"])) + F.col("_carry") - F.lit(1)
    return written(carried.select(*leaves.columns, place.cast("bigint").alias("at"), "size"))


def _prove(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    block = blocks.to_pylist()[0]
    nodes, height = np.frombuffer(block["nodes"], "S64"), height_of(block["size"])
    lefts, rights, root = _coded(block["lefts"]), _coded(block["rights"]), block["root"].encode()
    beyond = b"".join(x + y for x, y in zip(lefts, rights, strict=True))
    out = []
    for doc, at, own, altered in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "at", "digest", "altered")), strict=True):
        left, right = siblings(nodes, height, at - block["block"] * LEAVES)
        proof = digest(*(x + y for x, y in zip(left, right, strict=True)), beyond)
        folded = fold((own if altered is None else altered).encode(), left + lefts, right + rights)
        out.append((doc, own, block["subroot"], block["root"], proof.decode(), folded.decode(), folded == root))
    kinds = [rows.schema.field("doc_id").type, *[pa.string()] * 5, pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=PROVED)


PROVED = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame], DataFrame]:
    """Numbered leaves, the blocks of the languages' trees, those of the tree above them, and its numbered leaves.

    A leaf row has ``altered``, the digest of the row after tampering, where 3 divides its id's checksum.
    """
    lowered = F.translate("text", UPPER, LOWER)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then by bytes
    hashed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), leaf(F.col("text")).alias("digest"),
        F.when(remainder(3) == 0, leaf(lowered)).alias("altered"),
    ).withColumn("tie", F.monotonically_increasing_id())
    rows = numbered(written(hashed), [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")])
    low = layers(rows)
    subroots = tops(low).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    named = numbered(subroots, [F.col("name")])
    return rows, low, layers(named), named


def proved(rows: DataFrame, low: list[DataFrame], high: list[DataFrame], named: DataFrame) -> DataFrame:
    """Proof of every leaf, and the root its current row folds to."""
    none = F.array().cast("array<string>")
    root = tops(high).select("tree", none.alias("lefts"), none.alias("rights"), F.col("root").alias("subroot"), "root")
    above = ways(high, root).mapInArrow(_children, PATH).select(F.col("block").alias("at"), "lefts", "rights", "root")
    trees = named.select("at", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(above, "at").drop("at")
    blocks = ways(low, trees).groupBy("tree", "block")
    leaves = rows.drop("tie").withColumn("block", F.shiftright("at", BITS * HEIGHT)).groupBy("tree", "block")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.cogroup(blocks).applyInArrow(_prove, schema)


def op11(docs: DataFrame) -> DataFrame:
    return proved(*manifest(docs.select(*FIELDS)))


def _oracle() -> str:
    fields = []
    for name in FIELDS:
        text = name if name in ("source", "lang", "text") else f"CAST({name} AS VARCHAR)"
        value = "{t}" if name == "text" else text
        fields.append(f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')")
    coded = " || ".join(fields)
    changed = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = (
        "list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), "
        "lambda s, c: list_reduce([xor(s, c)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], "
        "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    )
    return f"""WITH RECURSIVE hashed AS MATERIALIZED (
 SELECT doc_id, lang, sha256({coded.format(t="text")}) AS leaf,
   CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN sha256({coded.format(t=changed)}) END AS altered FROM documents),
placed AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM hashed),
nodes AS (
 SELECT lang, 0 AS level, pos, leaf AS digest FROM placed
 UNION ALL
 SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM
   (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 GROUP BY lang, level, pos // 8),
heads AS MATERIALIZED (SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM
   (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM nodes) WHERE level = top),
crown AS (
 SELECT 0 AS level, pos, digest FROM heads
 UNION ALL
 SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM
   (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY level, pos // 8),
top AS (SELECT digest AS root, level AS crown_height FROM crown ORDER BY level DESC LIMIT 1),
joint AS MATERIALIZED (
 SELECT nodes.lang, nodes.level, nodes.pos, nodes.digest FROM nodes JOIN heads ON nodes.lang IS NOT DISTINCT FROM heads.lang WHERE nodes.level < heads.height
 UNION ALL
 SELECT heads.lang, heads.height + crown.level, crown.pos, crown.digest FROM crown, heads, top WHERE crown.level < crown_height AND crown.pos // 8 = heads.pos // (8 ** (crown.level + 1))::BIGINT),
runs AS MATERIALIZED (SELECT lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM joint GROUP BY lang, level, pos // 8),
ways AS MATERIALIZED (
 SELECT p.doc_id, p.leaf, p.altered, p.lang, p.pos, h.pos AS head, h.height, h.digest AS subroot, top.root, h.height + top.crown_height AS levels
 FROM placed p JOIN heads h ON p.lang IS NOT DISTINCT FROM h.lang, top),
climb AS (
 SELECT doc_id, leaf, lang, subroot, root, head, height, levels, 0 AS level, CASE WHEN height = 0 THEN head ELSE pos END AS place, coalesce(altered, leaf) AS folded, '' AS proof, pos FROM ways
 UNION ALL
 SELECT c.doc_id, c.leaf, c.lang, c.subroot, c.root, c.head, c.height, c.levels, c.level + 1,
   CASE WHEN c.level + 1 = c.height THEN c.head ELSE c.place // 8 END,
   sha256(array_to_string(r.digests[1:c.place % 8], '') || c.folded || array_to_string(r.digests[c.place % 8 + 2:], '')),
   c.proof || array_to_string(r.digests[1:c.place % 8], '') || array_to_string(r.digests[c.place % 8 + 2:], ''), c.pos
 FROM climb c JOIN runs r ON r.lang IS NOT DISTINCT FROM c.lang AND r.level = c.level AND r.run = c.place // 8 WHERE c.level < c.levels)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM climb WHERE level = levels"""


ORACLE = _oracle()
