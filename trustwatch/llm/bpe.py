"""Operator 11: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regex. Every code point has a class (an array over all code points); a class is a function from state to
state of a small automaton, and composing such functions is associative. So the states before all characters come from a scan:
functions are composed along short rows, for all rows at once, the rows' functions are composed by doubling, and a second pass along
the rows from their now known first states gives every state. Texts of a slice are scanned together, a reset between each two. A token
starts where state, class and next class say so; the automaton is that of the pattern ``PATTERN`` below.

The slices between boundaries go to pair merging (lowest rank first, leftmost of equals, by a heap over linked parts, so one
slice of any length takes n log n); short slices are cached. Ids are kept with the byte offset of each token, and decoding lays the
vocabulary's bytes down at these offsets. No step shuffles; what a task holds is an Arrow batch and a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.llm import text as T
from trustwatch.llm.stage import id_text

#: The pattern that the automaton stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDTH = 64
"""Characters of a row of the scan."""
CACHED, LONGEST = 400_000, 64
"""Slices in a worker's cache, and bytes of the longest."""

RESET, BLANK, SPACE, OTHER, TICK, DIGIT, LETTER, ENDS, R_V, L, E, NONE = range(12)
"""Classes. ENDS: s, t, m, d; NONE: padding, which leaves the state alone."""
FREE, AFTER_BLANK, AFTER_SPACE, IN_LETTERS, IN_DIGITS, IN_OTHERS, AFTER_TICK, TICK_R_V, TICK_L = range(9)
"""States. FREE: at the start of a text or after a contraction; AFTER_TICK: an apostrophe that starts a token."""
STATES = 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state by class and state, whether a token starts at a character of the class in the state)."""
    to = np.empty((12, STATES), np.uint8)
    to[RESET], to[BLANK], to[SPACE], to[OTHER], to[DIGIT] = FREE, AFTER_BLANK, AFTER_SPACE, IN_OTHERS, IN_DIGITS
    to[TICK] = AFTER_TICK
    to[TICK, [AFTER_SPACE, IN_OTHERS, AFTER_TICK]] = IN_OTHERS
    to[LETTER:NONE] = IN_LETTERS
    to[ENDS, AFTER_TICK], to[R_V, AFTER_TICK], to[L, AFTER_TICK] = FREE, TICK_R_V, TICK_L
    to[E, TICK_R_V] = to[L, TICK_L] = FREE
    to[NONE] = np.arange(STATES)
    starts = np.ones((12, STATES), bool)
    starts[RESET] = starts[NONE] = False
    for kind in (BLANK, SPACE):
        starts[kind, [AFTER_BLANK, AFTER_SPACE]] = False
    starts[DIGIT, [IN_DIGITS, AFTER_SPACE]] = False
    for kind in (OTHER, TICK):
        starts[kind, [IN_OTHERS, AFTER_TICK, AFTER_SPACE]] = False
    starts[LETTER:NONE, IN_LETTERS] = starts[LETTER:NONE, AFTER_SPACE] = starts[LETTER:NONE, TICK_R_V] = starts[LETTER:NONE, TICK_L] = False
    starts[ENDS, AFTER_TICK] = False
    return to, starts


_TO, _STARTS = _automaton()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point. Letters, numbers and white space are those of the tokenizer library's own Unicode tables, asked for once
    per process: an encoding of single bytes whose pattern is one class returns exactly the characters of that class."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000)))

    def members(kind: str) -> np.ndarray:
        found = bytes(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        return np.frombuffer(found.decode().encode("utf-32-le"), "<u4")

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
        out[members(kind)] = value
    for chars, value in ((" ", SPACE), ("'", TICK), ("stmd", ENDS), ("rv", R_V), ("l", L), ("e", E)):
        out[[ord(c) for c in chars]] = value
    return out


def states_before(classes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """State before each symbol, by a scan over transition functions, from FREE."""
    n = len(classes)
    rows = max(1, -(-n // width))
    grid = np.full(rows * width, NONE, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = _TO.ravel()
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for column in grid:
        whole = flat[column[:, None].astype(np.intp) * STATES + whole]
    step = 1
    while step < rows:  # whole[r]: function of all rows up to r
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), 1)])
        step *= 2
    state = np.r_[np.uint8(FREE), whole[:-1, FREE]]
    out = np.empty((width, rows), np.uint8)
    for i, column in enumerate(grid):
        out[i] = state
        state = flat[column.astype(np.intp) * STATES + state]
    return out.T.ravel()[:n]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a token starts at each symbol; the symbols of a text follow a RESET."""
    state = states_before(classes)
    then = np.r_[classes[1:], np.uint8(RESET)]
    out = _STARTS[classes, state]
    blank = (classes == BLANK) | (classes == SPACE)
    out |= blank & (then != BLANK) & (then != SPACE) & (then != RESET)  # the last of a run before more text stands apart
    tick = state == AFTER_TICK
    out[tick & (classes == R_V) & (then == E)] = False
    out[tick & (classes == L) & (then == L)] = False
    return out


def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, first slice of each text and the number of all) of the slices of texts buf[offs[r]:offs[r + 1]]."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.searchsorted(lead, offs)
    classes = np.insert(code_point_classes()[points], first[:-1], RESET)
    mark = np.delete(boundaries(classes), first[:-1] + np.arange(len(offs) - 1))
    start = lead[mark]
    ptr = np.searchsorted(start, offs)
    end = np.r_[start[1:], offs[-1:]] if len(start) else start
    return start, end, ptr


class Vocabulary:
    """Ranks file of a byte-level vocabulary: bytes to ids and back, and pair merging with a bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.most = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        words: list[bytes | None] = [None] * size
        for b, i in self.ranks.items():
            words[i] = b
        self.known = np.array([w is not None for w in words])
        self.length = np.array([len(w or b"") for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(w or b"" for w in words), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, ranks, most = len(piece), self.ranks, self.most
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int, e: int) -> None:
            if e - i <= most and (r := ranks.get(piece[i:e])) is not None:
                heapq.heappush(heap, (r, i, e))

        while heap:
            _, i, e = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != e:
                continue  # one of the two parts has been merged since
            end[i], end[middle] = e, 0
            if e < n:
                before[e] = i
                offer(i, end[e])
            if before[i] >= 0:
                offer(before[i], e)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, piece: bytes) -> tuple[int, ...]:
        got = self.merge(piece)
        if len(piece) <= LONGEST:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each in its text, first id of each text and the number of all)."""
        start, end, ptr = cut(buf, offs)
        data, get, ids = buf.tobytes(), self.cache.get, self.ids
        parts = [get(data[a:b]) or ids(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.fromiter(chain.from_iterable(parts), np.int32, int(count.sum()))
        rows = np.r_[0, np.cumsum(count)][ptr]
        at = np.r_[0, np.cumsum(self.length[out])]
        return out, at[:-1] - np.repeat(offs[:-1], np.diff(rows)), rows

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes of the ids, each laid down at its offset (gapless from 0)."""
        size = self.length[ids]
        return self.bytes[np.repeat(self.begin[ids] - offsets, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_vocabulary() -> str:
    """Ranks file of the public vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, offsets (first byte of each token in the text's UTF-8) of each row.

    A null or empty text has no ids. Repeated rows are encoded each; rows without a doc_id are left out; an empty table gives no rows;
    extra columns are ignored. Texts are encoded whole, whatever their length.
    """
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for lo, hi, buf, offs in T.slices(b.column("text")):
                ids, at, rows = v.encode(buf, offs)
                ptr = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(ptr, pa.array(ids)), pa.ListArray.from_arrays(ptr, pa.array(at.astype(np.int32)))], ["doc_id", "ids", "offsets"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids and more) with ``decoded``: the bytes of the ids. Null ids give null; an id that the vocabulary lacks stops the job, for
    the ids are then of another vocabulary. Offsets are taken from the column if it is there and fits, else counted anew."""
    path = path or default_vocabulary()
    own = "offsets" in encoded.columns

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            out: list[bytes | None] = []
            columns = [b.column("ids"), b.column("offsets") if own else [None] * b.num_rows]
            for ids, at in zip(*columns):
                ids = ids.values
                if ids is None:
                    out.append(None)
                    continue
                ids = ids.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(v.known) or not v.known[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                at = at.values.to_numpy(zero_copy_only=False).astype(np.int64) if at is not None and at.values is not None else None
                want = np.cumsum(v.length[ids]) - v.length[ids]
                out.append(v.decode(ids, at if at is not None and np.array_equal(at, want) else want).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of ``encoded`` with its decoded bytes."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
