"""Removal of passages that an earlier document has: suffix arrays over what can repeat.

Each 50-byte window has an anchor: of its 16-byte grams the one with the least hash, the leftmost among equals. Equal
windows have equal anchors at equal places, so windows are compared only with those of the same anchor. Neighbouring
windows with one anchor form a unit, about eighteen bytes apart. Units are grouped by anchor, as packed columns:

* where many texts are whole copies of a smaller document's (by SHA-256), these go as a whole before there are any units;
* an anchor that one document alone has is done: its windows are nowhere else;
* of units with equal bytes, all but those of the smallest document go as a whole;
* a window holds seventeen bytes more on one side of its anchor at least, so a unit whose anchor no other document has with
  the same seventeen bytes before it, nor with the same behind it (by 24 hashed bits each), shares no window;
* what is left of anchors with different units is compared byte by byte. Their segments are cut out of the texts and sorted, shard by
  shard, by Larsson-Sadakane refinement; Kasai's common prefixes tell where equal windows end; the shards are merged by
  binary search for each other's windows. A window goes if a smaller document has it.

Groups by anchor are packed and their number grows with the bytes of the corpus, so tasks stay of one size; an anchor that
many documents share brings one segment for each different surrounding, not for each document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import alone, handing_back, mix, slices, stored, text_bytes

GRAM = 16
#: Bytes of text for each group of anchors, bytes of a shard, and windows of a text handled at once.
GROUP_BYTES, SHARD_BYTES, PIECE = 16 << 20, 1 << 20, 4 << 20
#: Later copies of whole texts are set aside first if they are at least one byte of so many; fewer aren't worth dealing out all texts.
COPIED = 8

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_UNA = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)
_RANDOM = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []

UNIT = [("anchor", "<u8"), ("content", "<u8"), ("before", "<u4"), ("after", "<u4"), ("doc", "<i8"), ("at", "<i4"), ("count", "u1")]


def powers(size: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        up, down = np.full(size, _A), np.full(size, _UNA)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, first byte lowest; 64 bytes of zeros follow the data."""
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    return np.ndarray((len(data) + 56,), "<u8", padded, strides=(1,))


def beside(words: np.ndarray, start: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
    """24 bits, never all 0, of the ``size`` bytes from each place on; 0 where they aren't there."""
    out = np.zeros(len(start), np.uint64)
    for skip in range(0, size, 8):
        value = words[np.clip(start + skip, 0, len(words) - 1)]
        if size - skip < 8:
            value = value & np.uint64((1 << 8 * (size - skip)) - 1)
        out = mix(out * _B + value * _A)
    return np.where(there, np.maximum(out >> np.uint64(40), 1), 0).astype(np.uint64)


def units(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Units of the windows of all texts: anchor and content hashes, text, place, number of windows, place of the anchor, and
    hashes of what stands before and after the anchor in those windows that hold the longer part of their rest there."""
    n = len(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(n) + length <= ends)
    if not len(at):
        return {"anchor": np.empty(0, np.uint64), "content": np.empty(0, np.uint64), "text": np.empty(0, np.int64), "at": np.empty(0, np.int64), "count": np.empty(0, np.int64), "left": np.empty(0, np.int64), "before": np.empty(0, np.uint64), "after": np.empty(0, np.uint64)}
    words = words_at(data)
    gram = mix(words[:n] * _A + mix(words[8 : n + 8] * _B))
    low = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, wide = 1, length - GRAM + 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: len(low) - (wide - width)], low[wide - width :])
    anchor = (low[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    start, place = at[first], anchor[first]
    up, down = powers(1 << max(20, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[:n], out=sums[1:])
    content = mix((sums[start + count - 1 + length] - sums[start]) * down[start] + (count * 256 + place - start).astype(np.uint64) * _C)
    half = (length - GRAM) // 2
    before = beside(words, place - half, half, start <= place - half)
    after = beside(words, place + GRAM, half, start + count - 1 >= place - (length - GRAM - half))
    return {"anchor": gram[place], "content": content, "text": np.searchsorted(offsets, start, side="right") - 1, "at": start, "count": count, "left": place - start, "before": before, "after": after}


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Units, ordered by document, as columns of few bytes: 5 of the anchor, which tell the anchors of a bucket apart (and
    may let two meet, which costs a comparison), 6 of the content, 3 of what is before and after; documents and places as differences."""
    n = len(columns["doc"])
    none = np.zeros(n, np.uint64)
    part = lambda x, width: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes()
    step = lambda x, kind: np.diff(x, prepend=x.dtype.type(0)).astype(kind).view(np.uint8).reshape(n, -1).T.tobytes()
    return b"".join([np.int64(n).tobytes(), part(columns["anchor"], 5), part(columns["content"], 6), part(columns.get("before", none), 3), part(columns.get("after", none), 3), step(columns["doc"].astype("<i8"), "<i8"), step(columns["at"].astype("<i8"), "<i4"), columns["count"].astype("u1").tobytes()])


def unpack(blob: bytes) -> np.ndarray:
    """What :func:`pack` has packed, as rows of ``UNIT``."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    body, place = np.frombuffer(blob, np.uint8, offset=8), 0
    out = np.zeros(n, UNIT)
    for name, width, kind in (("anchor", 5, "<u8"), ("content", 6, "<u8"), ("before", 3, "<u4"), ("after", 3, "<u4"), ("doc", 8, "<i8"), ("at", 4, "<i4")):
        wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        wide[:, :width] = body[place : place + n * width].reshape(width, n).T
        place += n * width
        values = wide.reshape(-1).view(kind)
        out[name] = np.cumsum(values, dtype=kind) if name in ("doc", "at") else values
    out["count"] = body[place : place + n]
    return out


def packed_units(documents: DataFrame, length: int, groups: int) -> DataFrame:
    """(bucket, units): the units of each task's texts, packed by bucket of the anchor."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("suffix")
        held: list[dict[str, np.ndarray]] = []
        total = 0

        def rows() -> Iterator[pa.RecordBatch]:
            every = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
            bucket = (every["anchor"] >> np.uint64(48)).astype(np.int64) % groups
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for start, end in zip(cuts, [*cuts[1:], len(order)]):
                chosen = order[start:end]
                chosen = chosen[np.lexsort((every["at"][chosen], every["doc"][chosen]))]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[chosen[0]])], pa.int32()), pa.array([pack({k: v[chosen] for k, v in every.items()})], pa.binary())], names=["bucket", "units"])

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                docs = batch.column(0).to_numpy()
                data, offsets = text_bytes(batch.column(1))
                if len(data) <= PIECE:
                    parts = [(0, units(data, offsets, length))]
                else:  # one long text: pieces that share the bytes of a window
                    parts = [(base, units(data[base : base + PIECE + length - 1], np.array([0, min(len(data) - base, PIECE + length - 1)]), length)) for base in range(0, len(data), PIECE)]
                for base, found in parts:
                    if len(found["at"]):
                        text = found.pop("text")
                        found["doc"], found["at"] = docs[text], found["at"] - offsets[text] + base
                        held.append(found)
                        total += len(text)
                if total > 2_000_000:
                    yield from rows()
                    held, total = [], 0
        if held:
            yield from rows()

    return documents.mapInArrow(run, "bucket int, units binary")


def met(rows: np.ndarray, side: str) -> np.ndarray:
    """Whether another document has the anchor with the same bytes on this side."""
    order = np.lexsort((rows[side], rows["anchor"]))
    sides, anchors, docs = rows[side][order], rows["anchor"][order], rows["doc"][order]
    first = np.flatnonzero(np.concatenate([[True], (sides[1:] != sides[:-1]) | (anchors[1:] != anchors[:-1])]))
    several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
    out = np.empty(len(rows), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(rows)))) & (sides != 0)
    return out


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's units: those that go as a whole, and those to compare byte by byte.

    Expects all units of each anchor that the rows have.
    """
    rows = rows[np.argsort(rows["anchor"], kind="stable")]
    if not len(rows):
        return rows, rows
    first = np.flatnonzero(np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]))
    shared = np.minimum.reduceat(rows["doc"], first) < np.maximum.reduceat(rows["doc"], first)
    rows = rows[np.repeat(shared, np.diff(np.append(first, len(rows))))]
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["content"], rows["anchor"]))]
    new_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
    new_content = new_anchor | np.concatenate([[True], rows["content"][1:] != rows["content"][:-1]])
    content = np.cumsum(new_content) - 1
    later = rows["doc"] > rows["doc"][new_content][content]
    anchor = np.cumsum(new_anchor) - 1
    several = np.bincount(anchor[new_content])[anchor] > 1
    asked = rows[~later & several]
    return rows[later], asked[met(asked, "before") | met(asked, "after")] if len(asked) else asked


RUN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("count", "<i4")])
ASK = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("at", "<i4"), ("count", "u1")])
PACKED = "place int, runs binary, asks binary"


def places_of(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group in which what is found about a document meets."""
    return (mix(docs.astype("<i8").view("<u8").copy()) % np.uint64(groups)).astype(np.int32)


def planes(rows: np.ndarray) -> bytes:
    """Rows as all their first bytes, all their second bytes and so on: sorted numbers compress well that way."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes()


def from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    """The rows of :func:`planes`."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def by_place(rows: np.ndarray, kind: np.dtype, groups: int) -> tuple[list[int], list[bytes]]:
    """Rows packed as ``kind`` by the place of their document."""
    out = np.empty(len(rows), kind)
    for name in kind.names:
        out[name] = rows[name]
    place = places_of(out["doc"], groups)
    order = np.lexsort((out["at"], out["doc"], place))
    out, place = out[order], place[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    return place[cuts].tolist(), [planes(out[a:b]) for a, b in zip(cuts, [*cuts[1:], len(out)])]


def settled(table: pa.Table, groups: int) -> pa.Table:
    """(place, runs, asks) of one bucket: what goes as a whole and what is to be compared, packed by place."""
    later, asked = grouped(np.concatenate([unpack(blob.as_py()) for blob in table.column("units")]))
    (first, runs), (second, asks) = by_place(later, RUN, groups), by_place(asked, ASK, groups)
    return pa.table({"place": pa.array(first + second, pa.int32()), "runs": pa.array(runs + [None] * len(second), pa.binary()), "asks": pa.array([None] * len(first) + asks, pa.binary())})


def by_document(table: pa.Table, kind: np.dtype) -> pa.Table:
    """(doc_id, rows) of one place: what is packed in its rows, for each document."""
    rows = np.concatenate([from_planes(blob.as_py(), kind) for blob in table.column("rows")])
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]
    cuts = np.flatnonzero(np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]]))
    return pa.table({"doc_id": pa.array(rows["doc"][cuts], pa.int64()), "rows": pa.array([rows[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)])], pa.binary())})


def sorted_with(keys: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their keys (equal keys: of the places), by one sort of both in one number."""
    return np.sort((keys << np.uint64(bits)) | places.astype(np.uint64)) & np.uint64((1 << bits) - 1)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` bytes (or more) from each on; zeros follow the data.

    Larsson-Sadakane: places are sorted by their first five bytes and numbered by group; then each group that isn't
    settled is sorted by the numbers of the places as many bytes further on as are compared already, which doubles them.
    Takes up to 4 MB, so that two numbers and a place fit 64 bits.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    if n >= 1 << 22:
        raise ValueError("a shard may have less than 4 MB")
    keys = words_at(data)[:n].byteswap() >> np.uint64(24)
    bits = max(1, n.bit_length())
    order = sorted_with(keys, np.arange(n), bits).astype(np.int64) if bits <= 24 else np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.zeros(n + 2 * depth + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    seen = 5
    while seen < depth:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        places = order[open_]
        # Groups are numbered in order, so sorting by group and onward number leaves every group in its place.
        group, onward = rank[places].astype(np.uint64), rank[places + seen].astype(np.uint64)
        dense = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]])).astype(np.uint64)
        inner = sorted_with((dense << np.uint64(bits)) | onward, np.arange(len(places)), len(places).bit_length()) if len(places).bit_length() + 2 * bits <= 63 else np.lexsort((onward, dense)).astype(np.uint64)
        inner = inner.astype(np.int64)
        places, group, onward = places[inner], group[inner], onward[inner]
        order[open_] = places
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (onward[1:] != onward[:-1])])
        new[open_] = split
        rank[places] = open_[np.flatnonzero(split)][np.cumsum(split) - 1] + 1
        seen *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = 8) -> np.ndarray:
    """For each place of ``order`` how many bytes it has in common with the one before it, at most ``most`` (first: 0).

    Kasai's rule: the place after one with k bytes in common has at least k - 1, so counting starts there (unless k is
    ``most``, beyond which the order isn't settled). Every eighth place starts from nothing; between them, all places of
    equal distance are counted together, eight bytes at a time.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    if n:
        before[order[0]] = -1
    words = words_at(data)
    for lane in range(lanes):
        at = np.arange(lane, n, lanes)
        known = np.where(out[at - 1] < most, np.maximum(out[at - 1] - 1, 0), 0) if lane else np.zeros(len(at), np.int64)
        live = np.flatnonzero(before[at] >= 0)
        known[before[at] < 0] = 0
        while len(live):
            a, b = at[live] + known[live], before[at[live]] + known[live]
            differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            same = differ == 0
            lowest = differ & (~differ + np.uint64(1))
            bits = np.where(same, 64, np.frexp(np.maximum(lowest, 1).astype(np.float64))[1] - 1)
            room = n - np.maximum(a, b)
            known[live] += np.minimum(bits // 8, np.maximum(room, 0))
            live = live[same & (room > 8) & (known[live] < most)]
        out[at] = np.minimum(known, most)
    return out[order]


def rows_of(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each place on as big-endian numbers, a row for each place."""
    words, parts = words_at(data), []
    for skip in range(0, length, 8):
        value = words[places + skip].byteswap()
        if length - skip < 8:
            value = value & ~np.uint64((1 << 8 * (8 - (length - skip))) - 1)
        parts.append(value)
    return np.stack(parts, 1) if len(places) else np.empty((0, -(-length // 8)), np.uint64)


def found_in(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked row in a sorted table, or -1, by binary search: by the first number, then where it occurs by the rest."""

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
        for k in range(x.shape[1]):
            out |= open_ & (x[:, k] < y[:, k])
            open_ &= x[:, k] == y[:, k]
        return out

    out = np.full(len(asked), -1)
    first = np.ascontiguousarray(table[:, 0])
    low, high = np.searchsorted(first, asked[:, 0]), np.searchsorted(first, asked[:, 0], side="right")
    some = np.flatnonzero(low < high)
    low, high, asked = low[some], high[some], asked[some]
    live = np.arange(len(some))
    while len(live):
        middle = (low[live] + high[live]) // 2
        right = less(table[middle], asked[live])
        low[live], high[live] = np.where(right, middle + 1, low[live]), np.where(right, high[live], middle)
        live = live[low[live] < high[live]]
    hit = low < len(table)
    hit[hit] = (table[low[hit]] == asked[hit]).all(1)
    out[some[hit]] = low[hit]
    return out


def earliest(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each window start of each shard the smallest document with the same window in any shard.

    A shard is (bytes, document of the window that starts at each place; none: the largest number).
    """
    tables, groups, owners = [], [], []
    for data, docs in shards:
        order = suffix_array(data, length)
        new = common_prefixes(data, order, length) < length
        group = np.empty(len(data), np.int64)
        group[order] = np.cumsum(new) - 1
        owner = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(owner, group, docs)
        real = np.flatnonzero(owner < np.iinfo(np.int64).max)  # groups in which a window starts
        place = np.full(len(owner) + 1, -1)
        place[real] = np.arange(len(real))
        tables.append(rows_of(data, order[new][real], length))
        groups.append(place[group])
        owners.append(np.append(owner[real], np.iinfo(np.int64).max))
    merged = [o.copy() for o in owners]
    for i in range(len(shards)):
        for j in range(i):
            at = found_in(tables[j], tables[i])
            hit = np.flatnonzero(at >= 0)
            merged[i][hit] = np.minimum(merged[i][hit], owners[j][at[hit]])
            merged[j][at[hit]] = np.minimum(merged[j][at[hit]], owners[i][hit])
    return [m[g] for m, g in zip(merged, groups)]


def compared(table: pa.Table, length: int, groups: int) -> pa.Table:
    """(place, rows): runs of windows of the segments of one bucket that a smaller document has, packed by place."""
    docs, at, count = (table.column(c).to_numpy() for c in ("doc_id", "at", "count"))
    texts = table.column("segment").combine_chunks().cast(pa.large_binary())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) else np.empty(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    cuts = [0]
    for i in range(len(texts)):
        if offsets[i + 1] - offsets[cuts[-1]] > SHARD_BYTES and i > cuts[-1]:
            cuts.append(i)
    cuts.append(len(texts))
    shards = []
    for a, b in zip(cuts, cuts[1:]):
        base, size = offsets[a], offsets[b] - offsets[a]
        own = np.full(size, np.iinfo(np.int64).max)
        inside = np.arange(size) - np.repeat(offsets[a:b] - base, np.diff(offsets[a : b + 1]))
        window = inside < np.repeat(count[a:b], np.diff(offsets[a : b + 1]))
        own[window] = np.repeat(docs[a:b], np.diff(offsets[a : b + 1]))[window]
        shards.append((data[base : base + size], own))
    found = []
    for (a, b), first in zip(zip(cuts, cuts[1:]), earliest(shards, length)):
        base, sizes = offsets[a], np.diff(offsets[a : b + 1])
        segment = np.repeat(np.arange(a, b), sizes)
        inside = np.arange(len(first)) - np.repeat(offsets[a:b] - base, sizes)
        goes = (first < docs[segment]) & (inside < count[segment])
        begins = goes & ~(np.concatenate([[False], goes[:-1]]) & (inside > 0))
        ends = goes & ~(np.concatenate([goes[1:], [False]]) & np.concatenate([inside[1:] > 0, [False]]))
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        rows = np.empty(len(start), RUN)
        rows["doc"], rows["at"], rows["count"] = docs[segment[start]], at[segment[start]] + inside[start], end - start + 1
        found.append(rows)
    places, runs = by_place(np.concatenate(found) if found else np.empty(0, RUN), RUN, groups)
    return pa.table({"place": pa.array(places, pa.int32()), "rows": pa.array(runs, pa.binary())})


def segments(texts: DataFrame, asks: DataFrame, length: int, groups: int) -> DataFrame:
    """(bucket, doc_id, at, count, segment): the bytes of the units to compare."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("suffix")
        for whole in batches:
            for batch in slices(whole, "text"):
                buckets, docs, at, count, cut = [], [], [], [], []
                for doc, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    data = text.encode("utf-8", "surrogatepass")
                    rows = np.frombuffer(asked, ASK)
                    buckets.append((mix(rows["anchor"].astype(np.uint64)) % np.uint64(groups)).astype(np.int32))
                    docs += [doc] * len(rows)
                    at.append(rows["at"])
                    count.append(rows["count"].astype(np.int32))
                    cut += [data[a : a + c + length - 1] for a, c in zip(rows["at"].tolist(), rows["count"].tolist())]
                join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(join(buckets), pa.int32()), pa.array(docs, pa.int64()), pa.array(join(at), pa.int32()), pa.array(join(count), pa.int32()), pa.array(cut, pa.binary())], names=["bucket", "doc_id", "at", "count", "segment"])

    met = texts.join(asks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "asks")
    return met.mapInArrow(run, "bucket int, doc_id long, at int, count int, segment binary")


def removal(documents: DataFrame, length: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and the
    columns to ``carry``.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id, by the
    texts as they are given; matches don't cross documents. Null texts are empty. Rows with the same id are one document
    as to what is smaller, and lose the same bytes if their texts are the same (else each its own). A null id is neither
    smaller nor larger than another: such rows stay whole. An empty table gives no rows; other columns aren't read.
    """
    made = _removal(documents, length, carry)
    return made.withColumnsRenamed({f"carried_{c}": c for c in carry})


def _removal(documents: DataFrame, length: int, carry: tuple[str, ...]) -> DataFrame:
    """:func:`removal` with ``carried_`` before the names of the carried columns, so that they clash with none it makes."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    others = [f"carried_{c}" for c in carry]
    texts = rows.where("doc_id is not null")
    digest = F.sha2("text", 256).alias("digest")
    alike = stored(texts.groupBy(digest, F.octet_length("text").alias("size")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "alike")
    copies = alike.where((F.col("n") > 1) & (F.col("size") >= length)).select("digest", "first")
    total, copied = alike.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("size") >= length, F.col("size") * (F.col("n") - 1))), F.lit(0))).first()
    whole = None
    if copied * COPIED > total:
        later = stored(texts.select("doc_id", digest).join(copies, "digest").where("doc_id > first").select("doc_id", "digest").distinct(), "later")
        gone = texts.select("doc_id", *others, F.octet_length("text").cast("long").alias("n_bytes"), digest).join(later, ["doc_id", "digest"], "left_semi")
        whole = gone.select("doc_id", *others, "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
        texts = stored(texts.withColumn("digest", digest).join(later, ["doc_id", "digest"], "left_anti").drop("digest"), "texts")
        total -= copied
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / GROUP_BYTES))
    found = packed_units(texts.select("doc_id", "text"), length, groups).groupBy("bucket").applyInArrow(lambda table: settled(table, groups), PACKED)
    found = stored(found, "units")
    per_document = lambda rows, kind, name: rows.groupBy("place").applyInArrow(lambda table: by_document(table, kind), "doc_id long, rows binary").withColumnRenamed("rows", name)
    asks = per_document(found.where("asks is not null").select("place", F.col("asks").alias("rows")), ASK, "asks")
    detail = segments(texts.select("doc_id", "text"), asks, length, groups).groupBy("bucket").applyInArrow(lambda table: compared(table, length, groups), "place int, rows binary")
    runs = per_document(found.where("runs is not null").select("place", F.col("runs").alias("rows")).unionByName(detail), RUN, "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for text, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    if not blob:
                        out.append((len(data), 0, 0, data))
                        continue
                    own = np.frombuffer(blob, RUN)
                    end = np.minimum(own["at"] + own["count"] - 1 + length, len(data))
                    steps = np.zeros(len(data) + 1, np.int64)
                    np.add.at(steps, own["at"], 1)
                    np.add.at(steps, end, -1)
                    gone = np.cumsum(steps)[:-1] > 0
                    spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                    out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
                made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept"])

    known = texts.join(runs.hint("shuffle_hash"), "doc_id", "left").select("text", "runs", "doc_id", *others)
    schema = T.StructType([*known.schema.fields[2:], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    nameless = rows.where("doc_id is null").select("doc_id", *others, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    made = known.mapInArrow(cut, schema).unionByName(nameless)
    return made if whole is None else made.unionByName(whole)


def cleaned(documents: DataFrame, length: int = 50) -> DataFrame:
    """The documents without their repeated passages, with the columns of the input.

    What a cut leaves of a character goes with it. A document of which only white space is left goes; ``n_chars``
    follows the text, if there. Other columns stay.
    """
    others = tuple(c for c in documents.columns if c not in ("doc_id", "text"))
    carried = {f"carried_{c}": c for c in others}
    rest = _removal(documents, length, others)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "kept"):
                made = [data.decode("utf-8", "ignore") for data in batch.column(batch.schema.get_field_index("kept")).to_pylist()]
                names = [n for n in batch.schema.names if n != "kept"]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(made, pa.string())], names=[*names, "text"])

    wanted = rest.select("doc_id", *carried, "n_removed", "kept")
    schema = T.StructType([f for f in wanted.schema.fields if f.name != "kept"] + [T.StructField("text", T.StringType())])
    out = wanted.mapInArrow(texts, schema).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in others:
        out = out.withColumn("carried_n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select("doc_id", "text", *carried).withColumnsRenamed(carried).select(documents.columns)
