"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers and are sorted by label and, within a label, by their place on a Hilbert curve (the axes that spread most
first). Runs of ``block`` rows are written as Parquet, one row per block: ids, labels and the packed vectors, and beside them the zone map,
least and greatest value of every dimension and of the label. Interval arithmetic over a zone map bounds an anchor's score from
both sides, so only blocks are read whose interval meets what the anchor looks for:

* positives: blocks of its label whose upper bound reaches its weakest kept score so far (from its own block at first);
* negatives: blocks of another label whose interval meets one of its windows [low % of p, high % of p], p a positive's score.

Anchors are a stated query set. They travel in tiles, zone maps in packs of many blocks, and (tile, pack) rows compute bounds; for a
chosen block only the anchors that need it travel on, and the block's rows are scored by one matrix product. No row per pair of vectors is
ever made: a block gives an anchor ``count`` rows for its positives and ``count`` for each window at most. Block, tile and pack sizes
bound a task's memory; they don't change the result. Scores are exact: products that doubles can't hold are made with Python integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.llm.stage import partitions, written

BLOCK, TILE, PACK = 1024, 512, 256
BITS, KEY = 4, 32
"""Bits of a coordinate on the curve, and bytes of a place that are kept."""
LONG = np.iinfo(np.int64)


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (rows x dimensions, 0 <= cell < 2**bits), as rows of bits, most significant first."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for q in (1 << i for i in range(bits - 1, 0, -1)):  # undo the excess work of every level: exchange or invert low bits
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap).astype(np.uint32)
            x[i] ^= swap if i else np.uint32(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for q in (1 << i for i in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, np.uint32(q - 1), np.uint32(0))
    x ^= flip
    return np.stack([(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)], 1).astype(np.uint8)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; beyond 64 bits the nearest 64-bit integer."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LONG.min, LONG.max).astype(np.int64)


def interval(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between lo and hi (one box a row)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return tuple(exact_product(np.hstack([up, down]), np.hstack(x)) for x in ((lo, hi), (hi, lo)))  # type: ignore[return-value]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column, filled with zeros to ``dims``."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _list(values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values.ravel(), kind))


def _pack(m: np.ndarray) -> bytes:
    """Integers in the narrowest of 16, 32 and 64 bits, named by the first byte."""
    most = int(np.abs(m.astype(float)).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([width]) + m.astype(f"<i{width}").tobytes()


def _unpack(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64).reshape(-1, dims)


def _spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, greatest, variance) of every dimension; the numbers that meet on the driver are a few per dimension."""

    def run(batches):
        for b in batches:
            size = np.diff(b.column("q").offsets.to_numpy())
            dims = int(size.max(initial=0))
            m = _matrix(b.column("q"), dims).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), *[pa.array(x) for x in (m.min(0, initial=np.inf), m.max(0, initial=-np.inf), m.sum(0), (m * m).sum(0))], pa.array(np.full(dims, len(m)), pa.int64())], ["d", "lo", "hi", "s", "ss", "n"])

    got = rows.select("q").mapInArrow(run, "d int, lo double, hi double, s double, ss double, n long").groupBy("d").agg(F.min("lo"), F.max("hi"), F.sum("s"), F.sum("ss"), F.sum("n")).orderBy("d").toPandas().to_numpy(float)
    if not len(got):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    return got[:, 1], got[:, 2], got[:, 4] / got[:, 5] - (got[:, 3] / got[:, 5]) ** 2


def ordered_blocks(rows: DataFrame, dims: int, spread: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = BLOCK) -> DataFrame:
    """rows (row, vec_id, label, q, anchor) as blocks along the curve: block, n, least and greatest label, zone map, rows."""
    lo, hi, var = spread
    axes = np.argsort(-var, kind="stable")
    scale = np.where(hi > lo, hi - lo, 1.0)

    def place(batches):
        for b in batches:
            m = _matrix(b.column("q"), dims)
            cells = np.clip((m - lo) / scale * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)[:, axes]
            key = np.packbits(hilbert_place(cells, BITS), 1)[:, :KEY] if dims else np.zeros((len(m), 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in key], pa.binary())], [*b.schema.names, "place"])

    kinds = "row long, vec_id long, label int, anchor boolean, q array<long>"
    keyed = written(rows.select("row", "vec_id", "label", "anchor", "q").mapInArrow(place, kinds + ", place binary"), "placed")
    dealt = keyed.repartitionByRange(partitions(rows), "label", "place", "vec_id", "row").sortWithinPartitions("label", "place", "vec_id", "row").drop("place")

    def close(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        count = 0

        def row(t: pa.Table):
            nonlocal made
            t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
            m = _matrix(t.column("q").combine_chunks(), dims)
            labels = t.column("label").to_numpy()
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([len(m)]), pa.array([labels.min()], pa.int32()), pa.array([labels.max()], pa.int32()), _list(m.min(0)), _list(m.max(0)),
                                               _list(t.column("row").to_numpy()), _list(t.column("vec_id").to_numpy()), _list(labels, pa.int32()), _list(t.column("anchor").to_numpy(), pa.bool_()), pa.array([_pack(m)], pa.binary())],
                                              ["block", "n", "label_lo", "label_hi", "lo", "hi", "rows", "ids", "labels", "anchors", "vectors"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(block - count, b.num_rows - at)
                held.append(b.slice(at, take))
                at, count = at + take, count + take
                if count == block:
                    yield row(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield row(pa.Table.from_batches(held))

    return written(dealt.mapInArrow(close, "block long, n long, label_lo int, label_hi int, lo array<long>, hi array<long>, rows array<long>, ids array<long>, labels array<int>, anchors array<boolean>, vectors binary"), "blocks")


def _anchors(blocks: DataFrame, dims: int, count: int) -> DataFrame:
    """row, anchor_id, label, vector and floor of every anchor: its ``count``-th best score among its own block's rows of its label, null if they are fewer."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                m, labels = _unpack(r["vectors"], dims), np.array(r["labels"])
                at = np.flatnonzero(r["anchors"])
                if not len(at):
                    continue
                s = exact_product(m[at], m)
                floor: list[int | None] = []
                for i, a in enumerate(at.tolist()):
                    peers = labels == labels[a]
                    peers[a] = False
                    own = s[i, peers]
                    floor.append(int(np.partition(own, len(own) - count)[len(own) - count]) if len(own) >= count else None)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["rows"])[at]), pa.array(np.array(r["ids"])[at]), pa.array(labels[at], pa.int32()), pa.array([_pack(m[a:a + 1]) for a in at], pa.binary()), pa.array(floor, pa.int64())], ["row", "anchor_id", "label", "vector", "floor"])

    return written(blocks.filter("exists(anchors, x -> x)").select("rows", "ids", "labels", "anchors", "vectors").mapInArrow(run, "row long, anchor_id long, label int, vector binary, floor long"), "anchors")


_TILE = "tile long, rows array<long>, labels array<int>, vectors array<binary>, least array<array<long>>, most array<array<long>>"


def _tiles(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors (row, label, vector and the ends of the ranges of scores they look for) in tiles of at most ``size``."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, size):
                made += 1
                part = b.slice(at, size)
                ptr = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), *[pa.ListArray.from_arrays(ptr, pa.concat_arrays([part.column(c)])) for c in ("row", "label", "vector", "least", "most")]], ["tile", "rows", "labels", "vectors", "least", "most"])

    return anchors.select("row", "label", "vector", "least", "most").mapInArrow(run, _TILE)


def _packs(blocks: DataFrame, size: int) -> DataFrame:
    """Zone maps in numbered packs of about ``size`` blocks."""
    n = max(1, -(-blocks.count() // size))
    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(n)).alias("pack"), F.struct("block", "label_lo", "label_hi", "lo", "hi").alias("zone"))
    return written(zones.groupBy("pack").agg(F.collect_list("zone").alias("zones"), F.lit(n).alias("packs")), "zones")


def chosen(tiles: DataFrame, packs: DataFrame, dims: int, same_label: bool) -> DataFrame:
    """block, and the anchors (rows, labels, vectors, least, most) that must read it: those for whom the block's interval of scores meets one of their ranges."""
    n = packs.select("packs").first()
    pairs = tiles.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n.packs - 1 if n else 0)).cast("array<long>"))).join(packs, "pack")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                a = np.concatenate([_unpack(x, dims) for x in r["vectors"]])
                labels, zones = np.array(r["labels"]), r["zones"]
                lo, hi = (np.array([z[c] for z in zones], np.int64).reshape(len(zones), dims) for c in ("lo", "hi"))
                first, last = (np.array([z[c] for z in zones]) for c in ("label_lo", "label_hi"))
                down, up = interval(a, lo, hi)
                inside = (first <= labels[:, None]) & (labels[:, None] <= last) if same_label else ~((first == labels[:, None]) & (last == labels[:, None]))
                ends = np.zeros_like(inside)
                for j, (least, most) in enumerate(zip(r["least"], r["most"])):
                    for x, y in zip(least, most):
                        ends[j] |= (up[j] >= x) & (down[j] <= y)
                need = inside & ends
                for k in np.flatnonzero(need.any(0)):
                    at = np.flatnonzero(need[:, k]).tolist()
                    yield pa.RecordBatch.from_pylist([{"block": zones[k]["block"], **{c: [r[c][j] for j in at] for c in ("rows", "labels", "vectors", "least", "most")}}], schema=form)

    form = pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("vectors", pa.list_(pa.binary())), ("least", pa.list_(pa.list_(pa.int64()))), ("most", pa.list_(pa.list_(pa.int64())))])
    return pairs.select("rows", "labels", "vectors", "least", "most", "zones").mapInArrow(run, _TILE.replace("tile", "block"))


def _scored(needed: DataFrame, blocks: DataFrame, dims: int, count: int, same_label: bool) -> DataFrame:
    """row (the anchor's), slot (which of its ranges), score, vec_id and other (row) of the ``count`` best rows of each block read for each range."""
    read = needed.join(blocks.select("block", F.col("rows").alias("b_rows"), "ids", F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors")), "block")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                m, a = _unpack(r["b_vectors"], dims), np.concatenate([_unpack(x, dims) for x in r["vectors"]])
                rows, ids, labels = np.array(r["b_rows"]), np.array(r["ids"]), np.array(r["b_labels"])
                s = exact_product(a, m)
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                for j, (own, label, least, most) in enumerate(zip(r["rows"], r["labels"], r["least"], r["most"])):
                    ok = np.flatnonzero(((labels == label) & (rows != own)) if same_label else labels != label)
                    ok = ok[(s[j, ok] >= min(least)) & (s[j, ok] <= max(most))]
                    ok = ok[np.argsort(-s[j, ok], kind="stable")]  # a block's rows are in the order of their ids, so ties are too
                    down = -s[j, ok]
                    for slot, (x, y) in enumerate(zip(least, most)):
                        at = ok[np.searchsorted(down, -y):][:count]
                        at = at[s[j, at] >= x]
                        for c, v in zip(out, (np.full(len(at), own), np.full(len(at), slot), s[j, at], ids[at], rows[at])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], ["row", "slot", "score", "vec_id", "other"])

    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id", "other")
    got = read.select("rows", "labels", "vectors", "least", "most", "b_rows", "ids", "b_labels", "b_vectors").mapInArrow(run, "row long, slot long, score long, vec_id long, other long")
    return got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, anchors: str, count: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK, tile: int = TILE, pack: int = PACK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding; ``anchors``: a condition on vec_id. A component x becomes floor(scale * x), a score is an inner product, higher
    scores come first and ties by vec_id. A positive is one of the first ``count`` other rows of the anchor's label; its negatives are the
    first ``count`` rows of other labels whose score is low to high percent of the positive's.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Rows that repeat a vec_id are rows of their own (an
    anchor twice gives its results twice). Shorter vectors count as filled with zeros; an empty vector scores 0 with all. Scores beyond
    64 bits are the nearest 64-bit integer, components beyond it likewise. An anchor without positives, or a positive without negatives, gives
    no rows, as does an empty table. Extra columns are ignored.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.expr(anchors).alias("anchor"), whole.alias("q")), "rows")
    spread = _spread(rows)
    dims = len(spread[0])
    blocks = ordered_blocks(rows, dims, spread, block)
    own = _anchors(blocks, dims, count)
    packs = _packs(blocks, pack)
    floor = F.coalesce("floor", F.lit(int(LONG.min)))
    wanted = own.withColumn("least", F.array(floor)).withColumn("most", F.array(F.lit(int(LONG.max))))
    positives = written(_scored(chosen(_tiles(wanted, tile), packs, dims, True), blocks, dims, count, True), "positives")
    ranges = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    held = own.join(ranges, "row")
    # low * p <= 100 * s <= high * p, in integers
    least, most = F.expr(f"transform(p, x -> -((-{low} * x.score - pmod(-{low} * x.score, 100L)) div 100))"), F.expr(f"transform(p, x -> ({high} * x.score - pmod({high} * x.score, 100L)) div 100)")
    wanted = written(held.select("row", "anchor_id", "label", "vector", "p", least.alias("least"), most.alias("most")), "windows")
    negatives = _scored(chosen(_tiles(wanted, tile), packs, dims, False), blocks, dims, count, False)
    at = lambda c: F.expr(f"p[CAST(slot AS INT)].{c}")
    return negatives.join(wanted.select("row", "anchor_id", "p"), "row").select("anchor_id", at("vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), at("score").alias("positive_score"), F.col("score").alias("negative_score"))
