"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 48 components of 16 bits. Two texts of similarity s differ in each with chance 1 - s. The components are
split into 8 chunks of 6. If two signatures differ in at most 23 places, then by the pigeonhole principle some chunk has
at most 2 of them; so both signatures have a key in common if every chunk gives one key for each choice of 2 places that
are left out. That is 120 keys, and no pair within distance 23 is missed. At similarity 0.8 the distance is 9.6 on
average, and above 23 with a chance under 1e-5. Pairs that meet are confirmed on the full shingle sets.

Texts with equal shingle sets are one node throughout. The pairs of a bucket aren't listed: first each node is compared
with one leader, then with the leaders of buckets that still hold several components; where a bucket still does after
that, its members of different components are compared in blocks, so that no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import alone, handing_back, mix, slices, stored, text_bytes
from gazette.llm.graph import components

COMPONENTS, CHUNKS, ERRORS = 48, 8, 2
CHUNK = COMPONENTS // CHUNKS
#: Largest signature distance for which a common key is certain.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Ids that a broadcast may hold; more are met by a shuffle.
BROADCAST_IDS = 2_000_000

_RANDOM = np.random.default_rng(20240607)
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_FACTORS = _RANDOM.integers(0, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, COMPONENTS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _UNBASE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the text of each word."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_WHITE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | border[1:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | border[1:-1], [True]])) + 1
    up, down = _powers(1 << max(20, (len(data) + 1).bit_length()))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its set of word shingles as sorted 64-bit hashes.

    A text of fewer words than ``size``, but at least one, has one shingle of all its words; one without words has none.
    """
    words, owner = word_hashes(data, offsets)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    grams = words.copy()
    for k in range(1, size):
        grams = mix(grams[: max(0, len(words) - k)] * _STEP + words[k:]) if len(words) > k else grams[:0]
    out = []
    for i, n in enumerate(counts.tolist()):
        start = first[i]
        if n >= size:
            out.append(np.unique(grams[start : start + n - size + 1]))
        elif n:
            one = words[start : start + 1]
            for k in range(1, n):
                one = mix(one * _STEP + words[start + k : start + k + 1])
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit components of the signature of each set, a row per set; sets mustn't be empty."""
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    if sets:
        every = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for k in range(COMPONENTS):
            least = np.minimum.reduceat(every * _FACTORS[k] + _TERMS[k], starts)
            out[:, k] = (least * _STEP) >> np.uint64(48)
    return out


def node_of(shingles: np.ndarray) -> int:
    """Number of a shingle set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketched(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node and signature of each document; node and signature are null for empty sets."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_sets(*text_bytes(batch.column(1)), size)
                rows = signatures([s for s in sets if len(s)])
                full = iter(range(len(rows)))
                made = [rows[next(full)].tobytes() if len(s) else None for s in sets]
                nodes = [node_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_shingles", "node", "signature"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, signature binary")


def keys(nodes: DataFrame) -> DataFrame:
    """(key, node): the keys of each signature, one for each chunk and choice of places left out."""
    choices = [(c, [c * CHUNK + i for i in range(CHUNK) if i not in out]) for c in range(CHUNKS) for out in combinations(range(CHUNK), ERRORS)]

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                node = part.column(0).to_numpy()
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS).astype(np.uint64)
                out = np.empty((len(choices), len(rows)), np.uint64)
                for i, (_, places) in enumerate(choices):
                    key = np.full(len(rows), i, np.uint64)
                    for place in places:
                        key = mix(key * _STEP + rows[:, place])
                    out[i] = key
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.tile(node, len(choices)))], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, leader) of keys that several nodes have; the leader is the smallest node."""
    every = keys(nodes)
    shared = every.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    return every.join(shared, "key")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` per cent of their union in common."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        for whole in batches:
            for batch in slices(whole, "text_b"):
                known: dict[int, np.ndarray] = {}
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for names, column in ((a, batch.column(2)), (b, batch.column(3))):
                    for i, name in enumerate(names):
                        if name not in known:
                            known[name] = shingle_sets(*text_bytes(column.slice(i, 1)), size)[0]
                keep = []
                for x, y in zip(a, b):
                    common = len(np.intersect1d(known[x], known[y], assume_unique=True))
                    keep.append(100 * common >= percent * (len(known[x]) + len(known[y]) - common))
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def within_distance(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures are within the distance and whose set sizes allow the similarity."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for i in (2, 3))
                yield batch.filter(pa.array((x != y).sum(1) <= DISTANCE)).select(["a", "b"])

    side = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"s_{name}"), F.col("n_shingles").alias(f"n_{name}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return met.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def linked(nodes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another one."""
    held = stored(buckets(nodes), "buckets")
    members = held.select("node").distinct().join(nodes, "node").select(F.col("first_id").alias("doc_id"))
    members = stored(members, "members")
    few = members.count() <= BROADCAST_IDS
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(members) if few else members, "doc_id", "left_semi")

    @handing_back
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_sets(*text_bytes(batch.column(1)), size)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), batch.column(1)], names=["node", "text"])

    texts = stored(chosen.mapInArrow(named, "node long, text string").dropDuplicates(["node"]), "texts")

    def checked(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(within_distance(pairs, nodes, percent), texts, size, percent), "links")

    # One leader for each node.
    links = checked(held.where("node <> leader").groupBy("node").agg(F.min("leader").alias("a")).select("a", F.col("node").alias("b")))
    roots = stored(components(links), "roots")

    def placed(roots: DataFrame) -> DataFrame:
        """(node, n_shingles, root) of all nodes."""
        return stored(nodes.select("node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components."""
        several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return rows.join(several, "key")

    # All leaders of buckets that still hold several components, where the sizes of the sets allow the similarity.
    places = placed(roots)
    open_ = stored(mixed(held.join(places, "node")), "open")
    leaders = places.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"), F.col("n_shingles").alias("leader_n"))
    fits = 100 * F.least("n_shingles", "leader_n") >= percent * F.greatest("n_shingles", "leader_n")
    more = open_.join(leaders, "leader").where((F.col("leader_root") != F.col("root")) & fits).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = links.union(checked(more))
    places = placed(components(links))
    # Members of different components in buckets that still hold several; pairs with the leader are done.
    open_ = mixed(open_.where("node <> leader").select("key", "node").join(places.select("node", "root"), "node"))
    return components(links.union(across(stored(open_, "open"), texts, size, percent)))


def across(open_: DataFrame, texts: DataFrame, size: int, percent: int, block: int = 1000, part: int = 4000) -> DataFrame:
    """Links (a, b) between the components of buckets (key, node, root) that hold several, one for each node and component at least.

    Components that meet in buckets make a cluster. All its nodes but those of its largest component are compared with all
    of its nodes, by blocks: the shingles of a block are one sorted array, in which a set finds how many it shares with
    each node of the block at once. So pairs are counted, not listed, and no task holds more than a block and a part.
    """
    hubs = open_.groupBy("key").agg(F.min("root").alias("hub"))
    clusters = components(open_.join(hubs, "key").select(F.col("hub").alias("a"), F.col("root").alias("b")))
    rows = stored(open_.select("node", "root").distinct().join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root"), "clustered")
    sizes = rows.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("largest"))
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("n") / block), "parts": F.ceil((F.col("n") - F.col("largest")) / part)}).drop("largest")
    full = rows.join(sizes, "cluster").join(texts, "node")
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    spread = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    asked = full.where("root <> main").select("cluster", spread("blocks").alias("block"), place("parts").alias("part"), "node", "root", "text")
    named = {name: F.col(name).alias(f"held_{name}") for name in ("cluster", "node", "root", "text")}
    held = full.select(named["cluster"], place("blocks").alias("held_block"), spread("parts").alias("held_part"), named["node"], named["root"], named["text"])

    def sets_of(texts: pa.ChunkedArray) -> list[np.ndarray]:
        return [shingle_sets(*text_bytes(pa.array([text.as_py()])), size)[0] for text in texts]

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if len(queries) and len(members):
            sets = sets_of(members.column("held_text"))
            nodes, roots = members.column("held_node").to_numpy(), members.column("held_root").to_numpy()
            lengths = np.array([len(s) for s in sets])
            shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            for node, root, own in zip(queries.column("node").to_pylist(), queries.column("root").to_pylist(), sets_of(queries.column("text"))):
                low, high = np.searchsorted(shingles, own), np.searchsorted(shingles, own, side="right")
                hits = high - low
                total = int(hits.sum())
                at = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits)
                common = np.bincount(owner[at], minlength=len(sets))
                linked_ = np.flatnonzero((100 * common >= percent * (lengths + len(own) - common)) & (roots != root))
                _, first = np.unique(roots[linked_], return_index=True)
                found += [(int(nodes[i]), node) for i in linked_[first]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    met = asked.groupBy("cluster", "block", "part").cogroup(held.groupBy("held_cluster", "held_block", "held_part"))
    return met.applyInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked if their sets of ``size``-word shingles have at least ``percent`` per cent of their union in common;
    component_id is the smallest doc_id that links lead to, itself included, and kept marks it. Null, empty and wordless
    texts have an empty set and are linked with nothing. A null doc_id is linked with nothing and kept. Repeated rows
    have the same result. An empty table gives no rows; other columns aren't read.
    """
    sketches = stored(sketched(documents, size), "sketches")
    nodes = stored(
        sketches.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "nodes"
    )
    roots = linked(nodes, documents, size, percent)
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("node", "component_id")
    out = sketches.join(named, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null ids last), the earliest among equal ids.

    Rows are numbered and stored with their numbers first, and the numbers take the place of ids in the comparison; so rows
    that repeat an id, with the same text or another, and rows without one are each decided on their own text. Rows
    without words are linked with nothing and stay. Columns stay as they are, whatever their names.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.toDF(*names)
    doc_id, text = (names[documents.columns.index(c)] for c in ("doc_id", "text"))
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), size, percent)
    found = stored(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "components")
    several = found.where("row <> component").select("component").distinct()
    members = found.join(several, "component").join(rows.select("row", F.col(doc_id).alias("id")), "row")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))["row"].alias("first"))
    dropped = stored(members.select("row", "component").join(first, "component").where("row <> first").select("row"), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(dropped) if few else dropped, "row", "left_anti")
    return kept.select(*names).toDF(*documents.columns)
