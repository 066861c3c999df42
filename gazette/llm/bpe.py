"""Byte-level BPE: encoding through a lazily determinised transducer, decoding as a stream.

The merges are compiled into a transducer over bytes. A path of it is a sequence of tokens in which every two
neighbours are what the merges make of their joined bytes; exactly one such path spells a given text. While it
reads, several paths are open: each has emitted some tokens and stands inside a token of the vocabulary's trie.
The subset construction joins the open paths into one state, made when it is first needed. What all open paths
agree on is emitted; no path runs longer than the longest token, so the lookahead is bounded by that length.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import alone, slices

#: An arc is the next state, below the number of the tokens that are certain then.
STATE_BITS = 32
STATE_MASK = (1 << STATE_BITS) - 1

#: States and words kept per worker; beyond it the tables start anew (results don't change).
MOST_STATES, MOST_WORDS = 250_000, 150_000

#: Characters below U+0250: letters, and those that are neither digits 0 to 9 nor any other number; white space as \\s has it.
_LETTERS, _SIMPLE, _SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f", r"\t-\r \x85\xa0"


class Transducer:
    """Tokens of single matches of the split pattern, by the ranks of a vocabulary that holds all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: dict[int, bytes] | None = None):
        self.ranks = ranks
        self.bytes_of = bytes_of or {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        inner = {0}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                inner.add(node)
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = rank
        self.inner = inner
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[bytes, int]] | None] = {}
        self._restart()

    def _restart(self) -> None:
        start = array("i", (-1, 0, 0)).tobytes()
        self.states, self.number, self.arcs = [start], {start: 0}, {}
        self.outputs, self.output_number = [()], {(): 0}
        self.fits.clear()

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges of ranks under ``below`` as defined, lowest rank first and leftmost among equals. Used on tokens only."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            ranks = [get(left + right, below) for left, right in zip(parts, parts[1:])]
            lowest = min(ranks)
            if lowest >= below:
                break
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, last: bool) -> list[tuple[bytes, int]] | None:
        """The parts that are a token's first (or last) one while it is merged, each with the rank that ends it."""
        key = token << 1 | last
        if key not in self.edges:
            data, ends, out = self.bytes_of[token], 1 << 60, []
            while True:
                out.append((data, ends))
                if len(data) == 1:
                    break
                ends = self.ranks[data]
                parts = self.merged(data, ends)
                if len(parts) != 2:
                    out = None  # the merges never make this token
                    break
                data = parts[last]
            self.edges[key] = out and out[::-1]
        return self.edges[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Both are merged apart as long as no merge crosses their border. Side by side stand the last part of the left
        and the first part of the right; a crossing merge comes first if its rank is below the rank that ends the
        left part and not above the rank that ends the right part (among equals the leftmost merge goes first).
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            ys = self.edge(right, False)
            xs = self.edge(left, True) if left >= 0 else [(b"", 1 << 60)]
            known, i, j = bool(xs and ys), 0, 0
            while known and left >= 0:
                (x, x_ends), (y, y_ends) = xs[i], ys[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                elif x_ends <= y_ends and i + 1 < len(xs):
                    i += 1
                elif j + 1 < len(ys):
                    j += 1
                else:
                    break
            self.fits[key] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The determinised arc: the next state, and above it the number in ``outputs`` of the tokens that are certain now.

        A state holds its open paths as bytes, which take a quarter of what tuples do: of each the last token (-1: none),
        node of the trie, number of tokens held, and these. The one path that could end here (node 0) is the first.
        """
        paths, child, inner, token_at, settled, at = [], self.child, self.inner, self.token_at, True, 0
        open_ = memoryview(self.states[state]).cast("i").tolist()
        size = len(open_)
        while at < size:
            start, end = at + 3, at + 3 + open_[at + 2]
            node = child.get(open_[at + 1] << 8 | byte)
            if node is not None:
                last, held = open_[at], open_[start:end]
                if node in inner:
                    paths.append((last, node, held))
                    settled = settled and held
                token = token_at[node]
                if token >= 0 and self.follows(last, token):
                    paths.insert(0, (token, 0, [*held, token]))
            at = end
        same = 0
        if settled and paths:  # no open path has nothing held, so they may agree on something
            first = paths[0][2]
            same = len(first)
            for _, _, held in paths:
                size, same = min(same, len(held)), 0
                while same < size and first[same] == held[same]:
                    same += 1
        common, flat = tuple(paths[0][2][:same]) if same else (), []
        for last, node, held in paths:
            flat += last, node, len(held) - same
            if held:
                flat += held[same:] if same else held
        reached = array("i", flat).tobytes()
        arc = self.number.get(reached)
        if arc is None:
            arc = self.number[reached] = len(self.states)
            self.states.append(reached)
        if common:
            output = self.output_number.get(common)
            if output is None:
                output = self.output_number[common] = len(self.outputs)
                self.outputs.append(common)
            arc |= output << STATE_BITS
        self.arcs[state << 8 | byte] = arc
        return arc

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match of the split pattern, in time linear in its length."""
        if len(self.states) > MOST_STATES:
            self._restart()
        state, before, out, arcs, outputs = 0, 0, [], self.arcs, self.outputs
        for byte in data:
            state = arcs.get(state << 8 | byte)
            if state is None:
                state = self.step(before, byte)
            if state > STATE_MASK:
                out += outputs[state >> STATE_BITS]
                state &= STATE_MASK
            before = state
        last = memoryview(self.states[state]).cast("i")
        if last[2]:
            out += last[3 : 3 + last[2]].tolist()
        return tuple(out)


class Packed(dict):
    """Matches met before, with their tokens as the bytes of 32-bit numbers: the newest, and behind them those of the generation before."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        tokens = self.older.get(word)
        if tokens is None:
            tokens = array("i", self.transducer.encode(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 40:
            self[word] = tokens
        return tokens


class Words:
    """Tokens of matches and of texts."""

    def __init__(self, transducer: Transducer):
        self.packed = Packed(transducer)

    def __getitem__(self, word: str) -> tuple[int, ...]:
        return tuple(array("i", self.packed[word]))

    def ids(self, matches: Iterable[str]) -> np.ndarray:
        """Tokens of all matches of a text, one after the other."""
        return np.frombuffer(b"".join(map(self.packed.__getitem__, matches)), np.int32)


class StreamDecoder:
    """Turns tokens that arrive in pieces into text; a character is emitted once its last byte is there.

    The state is what an unfinished character still needs: its bytes so far and how many are missing. Bytes that
    are no UTF-8 become U+FFFD, in the same places whether they arrive together or one by one.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.tail = bytes_of, b""

    @staticmethod
    def open_at_end(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0
                if back >= need:
                    return 0
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                return back if back == 1 or low <= data[-back + 1] <= high else 0
        return 0

    def feed(self, tokens: Iterable[int]) -> str:
        """Text that these tokens complete."""
        data = self.tail + b"".join(map(self.bytes_of.__getitem__, tokens))
        held = self.open_at_end(data)
        self.tail = data[len(data) - held :]
        return data[: len(data) - held].decode("utf-8", "replace")

    def close(self) -> str:
        """What an unfinished character leaves."""
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def simple_form(pattern: str) -> str | None:
    """The pattern for the standard module, equal on texts of ``_SIMPLE`` characters; None if it has other escapes."""
    inside, classes = False, {"\\p{L}": _LETTERS, "\\p{N}": "0-9", "\\s": _SPACE}
    out = []
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part == "\\S" and not inside:
            out.append(f"[^{_SPACE}]")
        elif part[0] == "\\":
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def splitter(pattern: str):
    """Function from a text to the matches of the pattern in it."""
    whole, simple = regex.compile(pattern).findall, simple_form(pattern)
    if simple is None:
        return whole
    fast, other = re.compile(simple).findall, re.compile(f"[^{_SIMPLE}]").search
    return lambda text: whole(text) if other(text) else fast(text)


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@functools.lru_cache(maxsize=2)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


@functools.lru_cache(maxsize=2)
def _words(path: str, pattern: str) -> tuple[Words, object]:
    return Words(Transducer(_ranks(path), _bytes_of(path))), splitter(pattern)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), kind))


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"the input has a column {name}; name another output")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _forget() -> None:
    _words.cache_clear()
    _ranks.cache_clear()
    _bytes_of.cache_clear()


def encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of ids."""
    alone("bpe", _forget)
    words, split = _words(ranks_path, pattern)
    for whole in batches:
        for batch in slices(whole, text):
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                rows.append(words.ids(split(value)) if value else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(rows, pa.int32())], names=[*batch.schema.names, ids])


def decoded(batches: Iterator[pa.RecordBatch], ranks_path: str, ids: str, data: str, piece: int) -> Iterator[pa.RecordBatch]:
    """The batches with a column of decoded bytes."""
    bytes_of = _bytes_of(ranks_path)
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            rows = []
            for value in batch.column(batch.schema.get_field_index(ids)):
                tokens = value.values.to_pylist() if value.is_valid else []
                stream = StreamDecoder(bytes_of)
                parts = [stream.feed(tokens[at : at + piece]) for at in range(0, len(tokens), piece)]
                rows.append("".join([*parts, stream.close()]).encode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, data])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns, with the token ids of the whole text in ``ids`` (array of int).

    Null and empty texts have an empty list. Each match of ``pattern`` is encoded apart. ``ranks_path`` is a file
    that every executor has, as an installed vocabulary is. A text is worked on by itself, so rows may repeat.
    Raises if the input has a column ``ids``.
    """
    return df.mapInArrow(lambda batches: encoded(batches, ranks_path, pattern, text, ids), _added(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded", piece: int = 4096) -> DataFrame:
    """All rows and columns, with the text of the ids in ``data`` as UTF-8 bytes.

    A row's ids are fed to a :class:`StreamDecoder` in pieces. Null and empty lists give no bytes; an id that the
    vocabulary lacks is an error. Bytes that are no UTF-8 become U+FFFD. Raises if the input has a column ``data``.
    """
    return df.mapInArrow(lambda batches: decoded(batches, ranks_path, ids, data, piece), _added(df, data, T.BinaryType()))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass over the rows."""
    both = T.StructType([*_added(df, ids, T.ArrayType(T.IntegerType())).fields, *_added(df.select(), data, T.BinaryType()).fields])
    _added(df, data, T.BinaryType())
    return df.mapInArrow(lambda batches: decoded(encoded(batches, ranks_path, pattern, text, ids), ranks_path, ids, data, 4096), both)


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (see the query)."""
    return round_trip(documents.select("doc_id", "text"), ranks_path, pattern).select(
        F.col("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
