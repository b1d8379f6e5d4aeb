"""Operator 10: best-fit packing by the sum-of-squares rule.

Documents are tokenized in tasks; only those longer than a sequence are cut, the remainder first. A piece of full length is a
sequence of its own. The others are dealt by a hash into bins of work of bounded size, and each places its pieces, longest
first, where the squared counts of open sequences per residual gap become smallest. Sequences that stay loose are placed again,
whole, with those of other bins, in rounds that each have fewer bins of work. What moves is a few numbers per piece, never token ids.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.llm.groups import map_groups
from trustwatch.llm.stage import id_text, written

LIMIT = 32_768
"""Pieces that one task places at a time."""


class Tokens:
    """Token ids of a byte-level BPE vocabulary, those of its JSON file in ``tokenizers``, read from its ranks file (which encodes faster).

    ``added``: the JSON file's added tokens and their ids; they are found in texts, as there.
    """

    def __init__(self, ranks: str, pattern: str, added: dict[str, int] | None = None):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens=added or {})

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def default_tokenizer() -> tuple[str, str, dict[str, int]]:
    """Ranks file, pre-token pattern and added tokens of the public 50k byte-level vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


def pieces(docs: DataFrame, tokenizer: tuple[str, str] | tuple[str, str, dict[str, int]], length: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece; an empty or null text is its end token alone."""

    def run(batches):
        t = Tokens(*tokenizer)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(t.ids(text), np.uint32(end)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for c, v in zip(out, (doc, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), ids[lo:hi] if with_ids else None)):
                        c.append(v)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols[:5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each size, in the given order: into the open bin that leaves the smallest sum of squared counts of
    open bins per residual gap; a bin is opened where none has room."""
    count = np.zeros(length + 1, np.int64)  # open bins by gap; a gap of 0 is closed and not counted
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    used: list[int] = []
    where, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    none = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 * (count[g - s] - count[g] + 1), closing it by 1 - 2 * count[g]
        change = 2 * (count[:length + 1 - s] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = none
        gap = int(change.argmin())
        if change[gap] < none:
            count[gap + s] -= 1
            b = open_bins[gap + s].pop()
        else:
            gap, b = length - s, len(used)
            used.append(0)
        where[i], place[i] = b, used[b]
        used[b] += s
        if gap:
            count[gap] += 1
            open_bins[gap].append(b)
    return where, place


def _place(loose: DataFrame, groups: int, length: int, salt: int) -> DataFrame:
    """loose: unit, size. Adds its sequence (the smallest unit in it, told apart by the unit's hash) and offset, and the fill of the sequence."""

    def fn(t: pa.Table, bounds: np.ndarray):
        unit, size = t.column("unit").to_numpy(), t.column("size").to_numpy()
        seq, off, fill = (np.empty(len(unit), np.int64) for _ in range(3))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            order = lo + np.lexsort((unit[lo:hi], -size[lo:hi]))
            where, place = sum_of_squares(size[order], length)
            head = np.full(where.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(head, where, unit[order])
            seq[order], off[order] = head[where], place
            fill[order] = np.bincount(where, weights=size[order]).astype(np.int64)[where]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (unit, size, seq, off, fill)], ["unit", "size", "seq", "off", "fill"])

    dealt = loose.withColumn("work", F.pmod(F.xxhash64("unit", F.lit(salt)), F.lit(groups)))
    return map_groups(dealt.select("work", "unit", "size"), "work", fn, "unit long, size long, seq long, off long, fill long")


def place_pieces(cut: DataFrame, length: int = 1024, limit: int = LIMIT, rounds: int = 3) -> DataFrame:
    """``cut`` (unit and length of each piece, and more) with sequence_id and place: where each piece lies, gapless from 0."""
    full = cut.filter(F.col("length") >= length).withColumn("sequence_id", F.col("unit")).withColumn("place", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < length)
    lies = None
    loose = rest.select("unit", F.col("length").alias("size"))
    n, groups = loose.count(), 0
    for r in range(rounds):
        now = max(1, -(-n // limit))
        if r and (now >= groups or n == 0):
            break
        groups = now
        got = written(_place(loose, groups, length, r), "placed")
        if lies is None:
            lies = got.select("unit", "seq", "off")
        else:  # sequences that were placed as a whole take their pieces along
            moved = got.select(F.col("unit").alias("seq"), F.col("seq").alias("to"), F.col("off").alias("by"))
            lies = written(lies.join(moved, "seq", "left").select("unit", F.coalesce("to", "seq").alias("seq"), (F.col("off") + F.coalesce("by", F.lit(0))).alias("off")), "lies")
        if groups == 1:
            break
        loose = got.filter(f"fill < {length}").groupBy(F.col("seq").alias("unit")).agg(F.max("fill").alias("size"))
        n = loose.count()
    placed = rest.join(lies, "unit").withColumn("sequence_id", F.col("seq")).withColumn("place", F.col("off")).drop("seq", "off")
    return full.unionByName(placed)


def pack(docs: DataFrame, tokenizer: tuple[str, str] | tuple[str, str, dict[str, int]] | None = None, length: int = 1024, end: int = 2, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece of every document.

    A null or empty text is its end token. Equal doc_ids stay separate rows (units are numbered by id, piece and a rank among
    rows that agree in both). An empty table gives no rows; extra columns are ignored. Documents of any length are cut whole.
    """
    cut = pieces(docs, tokenizer or default_tokenizer(), length, end, with_ids)
    key = F.xxhash64("doc_id", "piece")
    cut = written(cut, "pieces")
    repeats = cut.groupBy("doc_id", "piece").agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.isEmpty():
        cut = cut.withColumn("unit", key)
    else:
        again = Window.partitionBy("doc_id", "piece").orderBy("start", "length", "ids_crc32")
        cut = written(cut.withColumn("rank", F.row_number().over(again)).withColumn("unit", F.xxhash64("doc_id", "piece", "rank")).drop("rank"), "pieces")
    out = place_pieces(cut, length, limit)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", F.col("place").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the token ids of each sequence (``packed`` made with ids); at most one sequence length of ids to a group."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("s")) \
        .select("sequence_id", F.expr("flatten(transform(s, x -> x.ids))").alias("ids"), F.expr("transform(s, x -> x.doc_id)").alias("doc_ids"))
