"""Operator 12: ranked lexical search over two hierarchies.

Documents and items are vectors of terms. A document's coordinate is its term's saturated frequency, an item's is the term's weight,
and a score is their inner product; all coordinates are 0 or more. Documents are sorted by their most frequent terms, so
copies and texts of one language lie together, and written as Parquet in batches of ``batch`` rows: each batch holds its documents,
its leaves' coordinate maxima and its own. Items are packed alike into tiles whose groups hold coordinate maxima.

The product of two nodes' maxima bounds every score between them. First the batches' maxima alone are read: the best batch of each item gives the item a
weakest kth score to start from, and only (tile, batch) pairs whose bound reaches it for some item are searched. Inside a pair the search goes down both trees
level by level (groups of items against leaves, items against leaves, items against documents), and drops every node pair whose bound is below
the weakest kth score of all its items; these scores rise on the way. A bound equal to it is kept, so ties are exact.

Nothing unbounded is broadcast: item terms thin the documents' terms by a bit table of ``BITS`` bits (4 MB), whatever their number, and false hits only cost
room. Tiles meet batches by a salted key. A task holds Arrow batches of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustwatch.llm import text as T
from trustwatch.llm.stage import BITS, SEGMENT, id_text, partitions, written

BATCH, LEAF, TILE, GROUP = 128, 16, 128, 8
U = np.uint64


def _terms(rows: DataFrame, key: str, bits=None) -> DataFrame:
    """key, n (terms with repeats), terms (their hashes, distinct, most frequent first) and tfs; with ``bits`` only terms whose bit is set are listed."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in T.slices(b.column("text")):
                w = T.hash_words(buf, offs, T.NOT_ALNUM, T.LOWER)
                row, h = w.rows(), w.hash
                if bits is not None:
                    at = h & U(BITS - 1)
                    keep = (bits.value[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
                    row, h = row[keep], h[keep]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.r_[first, len(h)])
                row, h = row[first], h[first]
                order = np.lexsort((T.mix(h), -tf, row))
                ptr = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, hi - lo), pa.array(np.diff(w.ptr)), pa.ListArray.from_arrays(ptr, pa.array(h[order].view(np.int64))), pa.ListArray.from_arrays(ptr, pa.array(tf[order], pa.int64()))], [key, "n", "terms", "tfs"])

    return rows.select(key, "text").mapInArrow(run, f"{key} long, n long, terms array<long>, tfs array<long>")


def _bit_table(terms: DataFrame) -> np.ndarray:
    """Bit h mod BITS of every term hash; BITS / 8 bytes, however many terms there are."""
    bit = F.pmod("term", F.lit(BITS))
    out = np.zeros(BITS // 8, np.uint8)
    for r in terms.select(F.floor(bit / SEGMENT).alias("segment"), (bit % SEGMENT).alias("at")).repartition("segment").groupBy("segment").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r.segment * SEGMENT // 8:(r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, term, greatest value) of each (node, term)."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])]) if len(node) else np.zeros(0, np.int64)
    return node[first], term[first], np.maximum.reduceat(value, first) if len(first) else value


def _packed(rows: DataFrame, size: int, keys: tuple[str, ...], term: str, value: str, form: str, build) -> DataFrame:
    """Consecutive rows of each task in runs of ``size``, each made one row by ``build``."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(size - count, b.num_rows - at)
                held.append(b.slice(at, take))
                at, count = at + take, count + take
                if count == size:
                    made += 1
                    yield build((task << 32) + made, pa.Table.from_batches(held).combine_chunks())
                    held, count = [], 0
        if count:
            yield build((task << 32) + made + 1, pa.Table.from_batches(held).combine_chunks())

    return rows.select(*keys, term, value).mapInArrow(run, form)


def document_tree(vectors: DataFrame, batch: int = BATCH, leaf: int = LEAF) -> DataFrame:
    """vectors (doc_id, terms, values) as batches: batch, ids, ptr, terms, values, maxima of the leaves (leaf_of, leaf_terms, leaf_values) and of the batch (top_terms, top_values)."""
    keys = [F.get("terms", F.lit(i)) for i in range(3)]
    dealt = vectors.repartitionByRange(partitions(vectors), *keys, "doc_id").sortWithinPartitions(*keys, "doc_id")

    def build(number: int, t: pa.Table) -> pa.RecordBatch:
        terms, values = (t.column(c).combine_chunks() for c in ("terms", "values"))
        size = np.diff(terms.offsets.to_numpy())
        doc = np.repeat(np.arange(len(size)), size)
        term, value = terms.flatten().to_numpy(), values.flatten().to_numpy()
        low = _maxima(doc // leaf, term, value)
        top = _maxima(np.zeros(len(low[0]), np.int64), low[1], low[2])
        lists = [(t.column("doc_id").to_numpy(), pa.int64()), (np.r_[0, np.cumsum(size)], pa.int32()), (term, pa.int64()), (value, pa.int64()), (low[0], pa.int32()), (low[1], pa.int64()), (low[2], pa.int64()), (top[1], pa.int64()), (top[2], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([number]), *[_lists([v], k) for v, k in lists]], names)

    names = ["batch", "ids", "ptr", "terms", "values", "leaf_of", "leaf_terms", "leaf_values", "top_terms", "top_values"]
    form = "batch long, ids array<long>, ptr array<int>, terms array<long>, values array<long>, leaf_of array<int>, leaf_terms array<long>, leaf_values array<long>, top_terms array<long>, top_values array<long>"
    return _packed(dealt, batch, ("doc_id",), "terms", "values", form, build)


def item_tiles(items: DataFrame, tile: int = TILE) -> DataFrame:
    """items (row, item_id, terms, weights) in tiles: tile, rows, item_ids, i_ptr, i_terms, weights. Similar items lie together."""
    keys = [F.get("terms", F.lit(i)) for i in range(3)]
    dealt = items.repartitionByRange(max(1, -(-items.count() // (4 * tile))), *keys, "row").sortWithinPartitions(*keys, "row")

    def build(number: int, t: pa.Table) -> pa.RecordBatch:
        terms, weights = (t.column(c).combine_chunks() for c in ("terms", "weights"))
        lists = [(t.column("row").to_numpy(), pa.int64()), (t.column("item_id").to_numpy(), pa.int64()), (np.r_[0, np.cumsum(np.diff(terms.offsets.to_numpy()))], pa.int32()), (terms.flatten().to_numpy(), pa.int64()), (weights.flatten().to_numpy(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([number]), *[_lists([v], k) for v, k in lists]], ["tile", "rows", "item_ids", "i_ptr", "i_terms", "weights"])

    form = "tile long, rows array<long>, item_ids array<long>, i_ptr array<int>, i_terms array<long>, weights array<long>"
    return _packed(dealt, tile, ("row", "item_id"), "terms", "weights", form, build)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers of 0 or more, exact."""
    if float(a.sum(1, dtype=float).max(initial=0)) * float(b.max(initial=0)) < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _ItemTree:
    """The items of a tile over the tile's own terms, and groups of ``size`` of them with their maxima."""

    def __init__(self, r: dict[str, np.ndarray], size: int = GROUP):
        self.rows, self.item_ids = r["rows"], r["item_ids"]
        self.vocabulary, at = np.unique(r["i_terms"], return_inverse=True)
        self.weight = np.zeros((len(self.rows), len(self.vocabulary)), np.int64)
        self.weight[np.repeat(np.arange(len(self.rows)), np.diff(r["i_ptr"])), at] = r["weights"]
        self.first = np.arange(0, len(self.rows), size)
        self.group = np.maximum.reduceat(self.weight, self.first) if len(self.rows) else self.weight
        self.of = np.arange(len(self.rows)) // size

    def dense(self, node: np.ndarray, nodes: int, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, matrix) of the nodes' coordinates that the tile has too."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros((nodes, 0), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == term
        columns, place = np.unique(at[ok], return_inverse=True)
        out = np.zeros((nodes, len(columns)), np.int64)
        out[node[ok], place] = value[ok]
        return columns, out

    def floors(self, floor: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(floor, self.first)


def _row(b: pa.RecordBatch, i: int, columns: list[str]) -> dict[str, np.ndarray]:
    """Arrays of one row."""
    return {c: b.column(c)[i].values.to_numpy() for c in columns}


def _best(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:count]


def _searched(tree: _ItemTree, r: dict[str, np.ndarray], floor: np.ndarray, count: int, leaf: int) -> list[tuple[np.ndarray, ...]]:
    """(item's place in the tile, document ids, scores) of the ``count`` best documents of a batch for each item, leaving out what is below its floor."""
    ids, ptr, terms, values = r["ids"], r["ptr"], r["terms"], r["values"]
    leaves = -(-len(ids) // leaf)
    columns, low = tree.dense(r["leaf_of"], leaves, r["leaf_terms"], r["leaf_values"])
    floor = floor.copy()
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in tree.rows]
    bound = _product(tree.group[:, columns], low)  # groups of items against leaves
    for k in np.argsort(-bound.max(0, initial=0), kind="stable").tolist():
        groups = np.flatnonzero(bound[:, k] >= tree.floors(floor))
        if not len(groups):
            continue
        items = np.flatnonzero(np.isin(tree.of, groups))
        items = items[_product(tree.weight[np.ix_(items, columns)], low[k:k + 1])[:, 0] >= floor[items]]  # items against the leaf
        if not len(items):
            continue
        a, b = k * leaf, min(len(ids), (k + 1) * leaf)
        span = slice(ptr[a], ptr[b])
        own, docs = tree.dense(np.repeat(np.arange(b - a), np.diff(ptr[a:b + 1])), b - a, terms[span], values[span])
        score = _product(tree.weight[np.ix_(items, own)], docs)
        for i, s in zip(items.tolist(), score):
            at = np.flatnonzero(s >= floor[i])
            if len(at):
                old = found[i]
                d, v = np.concatenate([x[0] for x in old] + [ids[a:b][at]]), np.concatenate([x[1] for x in old] + [s[at]])
                top = _best(v, d, count)
                found[i] = [(d[top], v[top])]
                if len(top) == count:
                    floor[i] = max(floor[i], v[top[-1]])
    return [(np.full(len(d), i), d, v) for i, x in enumerate(found) for d, v in x]


_DOCUMENT = ["ids", "ptr", "terms", "values", "leaf_of", "leaf_terms", "leaf_values"]
_ITEMS = ["rows", "item_ids", "i_ptr", "i_terms", "weights", "floors"]


def _meet(tiles: DataFrame, batches: DataFrame) -> DataFrame:
    """Every tile with every batch, dealt by (tile, salt): no key holds more than a share of the batches."""
    salts = partitions(batches)
    ids = sorted(r.tile for r in tiles.select("tile").collect())  # a number for TILE items
    left = batches.withColumn("tile", F.explode(F.array(*[F.lit(i) for i in ids]))).withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)))
    return left.join(tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), ["tile", "salt"])


def _bounds(pairs: DataFrame, best: bool) -> DataFrame:
    """pairs of tiles and batches' maxima. best: row, batch and bound of each item's best batch among those of an Arrow batch; else tile and batch of the pairs to search."""

    def run(batches):
        for b in batches:
            trees: dict[int, tuple[_ItemTree, np.ndarray]] = {}
            top: dict[int, tuple[int, int]] = {}
            keep: list[tuple[int, int]] = []
            for i in range(b.num_rows):
                tile, batch = b.column("tile")[i].as_py(), b.column("batch")[i].as_py()
                if tile not in trees:
                    r = _row(b, i, _ITEMS)
                    trees[tile] = _ItemTree(r), r["floors"]
                tree, floor = trees[tile]
                term, value = (b.column(c)[i].values.to_numpy() for c in ("top_terms", "top_values"))
                columns, high = tree.dense(np.zeros(len(term), np.int64), 1, term, value)
                groups = np.flatnonzero(_product(tree.group[:, columns], high)[:, 0] >= tree.floors(floor))
                items = np.flatnonzero(np.isin(tree.of, groups))
                bound = _product(tree.weight[np.ix_(items, columns)], high)[:, 0]
                if best:
                    for row, s in zip(tree.rows[items].tolist(), bound.tolist()):
                        if s > 0 and s > top.get(row, (0, 0))[0]:
                            top[row] = s, batch
                elif (bound >= floor[items]).any():
                    keep.append((tile, batch))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (top, [v[1] for v in top.values()], [v[0] for v in top.values()])], ["row", "batch", "bound"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], pa.int64()) for j in (0, 1)], ["tile", "batch"])

    return pairs.select("tile", "batch", "top_terms", "top_values", *_ITEMS).mapInArrow(run, "row long, batch long, bound long" if best else "tile long, batch long")


def _search(pairs: DataFrame, tiles: DataFrame, tree: DataFrame, count: int, leaf: int) -> DataFrame:
    """row, item_id, doc_id, score of the ``count`` best documents for each item among the pairs (tile, batch)."""
    salts = partitions(tree)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts))).join(tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), ["tile", "salt"])
    read = tree.select("batch", *_DOCUMENT).join(salted.select("batch", "tile", *_ITEMS), "batch")

    def run(batches):
        for b in batches:
            trees: dict[int, _ItemTree] = {}
            for i in range(b.num_rows):
                tile = b.column("tile")[i].as_py()
                if tile not in trees:
                    trees[tile] = _ItemTree(_row(b, i, _ITEMS))
                t = trees[tile]
                found = _searched(t, _row(b, i, _DOCUMENT), b.column("floors")[i].values.to_numpy(), count, leaf)
                at = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t.rows[at]), pa.array(t.item_ids[at]), *[pa.array(np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64)) for j in (1, 2)]], ["row", "item_id", "doc_id", "score"])

    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    return read.select("tile", *_DOCUMENT, *_ITEMS).mapInArrow(run, "row long, item_id long, doc_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def ranked(docs: DataFrame, items: DataFrame, count: int = 10, batch: int = BATCH, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """item_id, rank, doc_id, score: the ``count`` best documents of each item, those with a score above 0; equal scores by ascending doc_id.

    Null and empty texts have no terms: such documents are not counted and never found, such items give no rows. Rows that repeat a doc_id are
    documents of their own, rows that repeat an item_id are ranked each (the item_id then has every rank that often). Rows without an id are
    left out. Empty tables give no rows; extra columns are ignored. Texts are read whole.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    asked = written(_terms(asked, "item_id").filter("n > 0").select(F.monotonically_increasing_id().alias("row"), "item_id", "terms"), "items")
    words = written(asked.select(F.explode("terms").alias("term")).distinct(), "item-terms")
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(words))
    counted = written(_terms(id_text(docs), "doc_id", bits), "terms")
    n, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(words, "term")
    weights = held.select("term", F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    weighed = asked.select("row", "item_id", F.explode("terms").alias("term")).join(weights, "term").groupBy("row", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("x"))
    weighed = weighed.select("row", "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    tiles = written(item_tiles(written(weighed, "weighed"), tile), "tiles")
    m = f"(10 + (90 * n * {n}) div {max(length, 1)})"
    vectors = counted.filter("size(terms) > 0").select("doc_id", "terms", F.expr(f"transform(tfs, x -> (1000000000 * x) div (1000 * x + 8 * {m}))").alias("values"))
    tree = written(document_tree(vectors, batch, leaf), "tree")
    if tiles.isEmpty():
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    open_floor = tiles.withColumn("floors", F.transform("rows", lambda x: F.lit(1).cast("long")))
    tops = tree.select("batch", "top_terms", "top_values")
    best = _bounds(_meet(open_floor, tops), True).groupBy("row").agg(F.max_by("batch", F.struct("bound", -F.col("batch"))).alias("batch"))
    where = tiles.select("tile", F.explode("rows").alias("row"))
    seeds = written(best.join(where, "row").select("tile", "batch").distinct(), "seeds")
    kth = written(_search(seeds, open_floor, tree, count, leaf).filter(F.col("rank") == count).select("row", "score"), "floors")
    floors = where.join(kth, "row", "left").groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("row", F.coalesce("score", F.lit(1)).alias("floor")))).alias("f"))
    known = written(tiles.join(floors, "tile").withColumn("floors", F.transform("rows", lambda x: F.col("f")[x])).drop("f"), "known")
    pairs = written(_bounds(_meet(known, tops), False), "pairs")
    return _search(pairs, known, tree, count, leaf).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
