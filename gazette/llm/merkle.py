"""A Merkle manifest of a table: proofs for every row, and what the root becomes when a row is tampered with.

Leaves of a key (a source) ascend by id; 16 consecutive nodes make one node of the next level until one is left. The nodes are
held in aligned blocks of 256 (two levels), one table row per block, so no task ever holds more than a block at a time
however many leaves a key has. The roots of the blocks are the leaves of the next table, until every key has one
block; the keys' roots, in order, go through the same tables once more.

A block is persistent: a tampered leaf makes a version of it that shares every node with the original but the copied ancestors
of that leaf. Versions go on above their block along its path: the siblings of each ancestor, which the tables above
hand down, one row per block. So versions are folded where their block is and only paths travel.

Null ids, sources, texts and counts are hashed as ``-``. Rows of equal id are ordered by their leaf's digest; equal rows are equal
leaves side by side. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gazette.llm.common import stored

FANOUT, LEVELS = 16, 2
BLOCK = FANOUT**LEVELS


def field(value: Column) -> Column:
    """``-`` for null, else number of UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def tampered(text: Column) -> Column:
    """The tampering of the check: A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def struck(doc_id: Column) -> Column:
    """Whether a row is tampered with: its id's CRC-32 is divisible by 5 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(documents: DataFrame) -> DataFrame:
    """key, doc_id, leaf, changed: the digests of the row as it is and, where it is struck, as tampered with.

    Keys are ``-`` for a null source and ``=source`` else, so they ascend like the sources, null first.
    """

    def row(text: Column) -> Column:
        return digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    changed = F.when(struck(F.col("doc_id")), row(tampered(F.col("text"))))
    return documents.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), row(F.col("text")).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows with ``pos``, their place (from 0) within ``key`` by ``order``, and ``total``, the rows of the key.

    A range sort and one count per key and sorted part; a large key spreads over many parts.
    """
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), f"{label}-rows")
    ranged = rows.repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie")
    ranged = stored(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), f"{label}-sorted")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_key = Window.partitionBy("key")
    before = F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_key).alias("total"))
    return ranged.join(counts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def lifted(level: list[str]) -> list[str]:
    """The next level."""
    return [sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]


def grown(digests: list[str], total: int) -> list[list[str]]:
    """The levels of a block, its root last. A block that is the only one of its key ends when one node is left."""
    tree = [digests]
    while len(tree) <= LEVELS and not (total <= BLOCK and len(tree[-1]) == 1):
        tree.append(lifted(tree[-1]))
    return tree


def around(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """The siblings of a leaf's ancestors, level by level: those to the left and those to the right, each as one text."""
    out = []
    for level in tree[:-1]:
        start = place - place % FANOUT
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + FANOUT])))
        place //= FANOUT
    return out


def version(tree: list[list[str]], place: int, new: str) -> list[tuple[int, int, str]]:
    """A version of the block: the copied path as (level, place, digest); every other node is the original's."""
    copied = [(0, place, new)]
    for depth, level in enumerate(tree[:-1]):
        start = place - place % FANOUT
        run = level[start : start + FANOUT]
        run[place - start] = copied[-1][2]
        place //= FANOUT
        copied.append((depth + 1, place, sha256("".join(run).encode()).hexdigest()))
    return copied


def folded(digest_: str, path: list[tuple[str, str]]) -> str:
    """The root over a node, given the siblings of its ancestors."""
    for left, right in path:
        digest_ = sha256((left + digest_ + right).encode()).hexdigest()
    return digest_


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """One stored row per aligned block: key, block, total, members (in order) and its root.

    ``nodes`` has key, pos, total, digest and whatever else the members are to carry.
    """
    carried = [c for c in nodes.columns if c not in ("key", "pos", "total")]
    members = F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(BLOCK)).cast("int").alias("place"), *carried)), lambda a, b: a["place"] - b["place"])
    packed = nodes.groupBy("key", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("total").alias("total"), members.alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            digests, ends = lists.flatten().field("digest"), lists.offsets.to_pylist()
            roots = [grown(digests.slice(a - ends[0], b - a).to_pylist(), n)[-1][0] for a, b, n in zip(ends, ends[1:], batch.column("total").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "root"])

    return stored(packed.mapInArrow(run, StructType([*packed.schema.fields, StructField("root", StringType())])), label)


_PATH = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(table: DataFrame) -> DataFrame:
    """key, pos, digest, name, path and subroot of each member of the blocks; ``above`` is the path of the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                members = row["members"]
                tree = grown([m["digest"] for m in members], row["total"])
                above, n, first = [(s["left"], s["right"]) for s in row["above"]], len(members), row["block"] * BLOCK
                paths = [[{"left": a, "right": b} for a, b in around(tree, place) + above] for place in range(n)]
                made = [
                    pa.array([row["key"]] * n, pa.string()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array([m["digest"] for m in members], pa.string()),
                    pa.array([m.get("name") for m in members], pa.string()),
                    pa.array(paths, _STEPS),
                    pa.array([row["subroot"]] * n, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["key", "pos", "digest", "name", "path", "subroot"])

    return table.mapInArrow(run, f"key string, pos long, digest string, name string, path {_PATH}, subroot string")


def climbed(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The tables of blocks from the leaves up; in the last one each key has one block, whose root is the key's.

    A key of one block climbs on as the only member of its blocks, which adds no level.
    """
    tables = []
    while True:
        tables.append(blocks(nodes, f"{label}-{len(tables)}"))
        if tables[-1].where(F.col("total") > BLOCK).isEmpty():
            return tables
        nodes = tables[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("digest"))


def descended(tables: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """The lowest table with ``above``, the path from each block's root upwards, and ``subroot``.

    The argument gives key, above and subroot of the keys' roots. Every join is one row to one row.
    """
    joined = tables[-1].join(above, "key")
    for k in range(len(tables) - 2, -1, -1):
        paths = stored(_paths(joined), f"{label}-{k}").select("key", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot")
        joined = tables[k].join(paths, ["key", "block"])
    return joined


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see the module for nulls and ties."""
    rows = placed(leaves(documents), ["doc_id", "leaf"], "merkle-leaves").withColumnRenamed("leaf", "digest")
    tables = climbed(rows, "merkle-blocks")
    tops = tables[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"))
    upper = climbed(placed(tops, ["name"], "merkle-sources"), "merkle-source-blocks")
    root = upper[-1].select("root").first()  # a single row, or none of an empty table
    ends = upper[-1].select("key", F.array().cast(_PATH).alias("above"), F.lit(None).cast("string").alias("subroot"))
    sources = stored(_paths(descended(upper, ends, "merkle-source-paths")), "merkle-source-ends")
    above = sources.select(F.col("name").alias("key"), F.col("path").alias("above"), F.col("digest").alias("subroot"))
    return proved(descended(tables, above, "merkle-paths"), root[0] if root else "")


def proved(table: DataFrame, root: str) -> DataFrame:
    """The result rows of each lowest block: proofs, versions of tampered leaves and the roots that these lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                members = row["members"]
                tree = grown([m["digest"] for m in members], row["total"])
                above = [(s["left"], s["right"]) for s in row["above"]]
                beyond = "".join(left + right for left, right in above)
                proofs = [sha256(("".join(left + right for left, right in around(tree, place)) + beyond).encode()).hexdigest() for place in range(len(members))]
                ends = [version(tree, place, m["changed"])[-1][2] if m["changed"] else tree[-1][0] for place, m in enumerate(members)]
                # untampered leaves are the block's own version: their ancestors are the tree's nodes
                again = {end: folded(end, above) for end in set(ends)}
                n = len(members)
                made = [
                    pa.array([m["doc_id"] for m in members], pa.int64()),
                    pa.array([m["digest"] for m in members], pa.string()),
                    pa.array([row["subroot"]] * n, pa.string()),
                    pa.array([root] * n, pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array([again[end] for end in ends], pa.string()),
                    pa.array([again[end] == root for end in ends], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = table.select("members", "total", "above", "subroot")
    return rows.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
