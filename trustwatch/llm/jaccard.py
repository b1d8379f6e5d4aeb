"""Operator 9: exact n-gram Jaccard join in the metric space of shingle sets.

Identical sets form one class and go on as its smallest document. Of n shingles, p = n - ceil(t * n) + 1 can't all be foreign to
a linked set. Each document emits its first q >= p shingles in an order that puts expectedly common ones last. How many of these
linked sets have in common at least follows from their two sizes; a document passes over the most held (counted exactly) of its
shared ones, fewer than that least number for any size it can link with, so a common one is left.
A document that shares none is alone; what hangs together by the others is a region. Each region takes the member that most
others met as its pivot, and members are laid out in rings by their exact Jaccard distance to it, as wide as the link distance:
by the triangle inequality a link reaches no further than the next ring, into which boundary members are replicated. Members within
reach of the pivot are linked and closed; the open ones meet the closed ones and each other in blocks of bounded size. Where
many stay open, they form a region of their own with a new pivot, and so on. All that is reported was compared by whole sets.

At worst (many documents of one region, none within reach of its pivots) the work inside that region is quadratic, in blocks;
memory is bounded by two blocks in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.llm import text as T
from trustwatch.llm.groups import components, map_groups
from trustwatch.llm.stage import id_text, with_ids, without_ids, written

CELLS = 1 << 17
SLICE = 1 << 12
HIST = 128
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
MANY_OPEN = 4096
RARE = 0.05
U = np.uint64


def _shingled(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words, shingles with repeats) of each text; fewer than k words make one shingle."""
    for lo, hi, buf, offs in T.slices(column):
        w = T.hash_words(buf, offs, T.SPACE, T.LOWER)
        s = T.shingles(w.hash, k)
        for r in range(hi - lo):
            a, b = w.ptr[r], w.ptr[r + 1]
            if b - a >= k:
                yield lo + r, w.hash[a:b], s[a:b - k + 1]
            else:
                yield lo + r, w.hash[a:b], np.array([T.whole_sequence(w.hash[a:b])] if b > a else [], np.uint64)


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often words of each of CELLS hash cells occur in all documents: a table of fixed size, whatever the corpus."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, _, buf, offs in T.slices(b.column("text")):
                w = T.hash_words(buf, offs, T.SPACE, T.LOWER).hash
                total += np.bincount((w & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        parts = total.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], ["slice", "counts"])

    rows = docs.select("text").mapInArrow(count, "slice int, counts array<long>").select("slice", F.posexplode("counts").alias("pos", "n")).filter("n > 0").groupBy("slice", "pos").agg(F.sum("n").alias("n"))
    got = rows.toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got["slice"].to_numpy() * SLICE + got["pos"].to_numpy()] = got["n"].to_numpy()
    return out


def _needed(n, pct: int):
    return -(-pct * n // 100)


def _emitted(n, pct: int):
    """Shingles that a set of ``n`` emits (of numbers or arrays)."""
    p = n - _needed(n, pct) + 1
    return np.minimum(np.maximum(p + p // 2, n // 5), n)


@lru_cache(1 << 16)
def _spare(n: int, pct: int) -> int:
    """How many of its shared shingles a set of ``n`` may pass over.

    A link of n with m needs c = ceil(pct (n + m) / (100 + pct)) common shingles, so the first a of n and b of m share at least
    min(a - (n - c), b - (m - c)). Both pass over the last of one order, together no more of the shared ones than the larger number.
    """
    m = np.arange(_needed(n, pct), 100 * n // pct + 1)
    c = -(-pct * (n + m) // (100 + pct))
    least = np.minimum(_emitted(n, pct) - n + c, _emitted(m, pct) - m + c).min()
    return int(min(_emitted(n, pct) - (n - _needed(n, pct) + 1), least - 1))


def _expected(words: np.ndarray, k: int, n: int, freq: np.ndarray) -> np.ndarray:
    """Expected occurrences of each shingle if words were independent (0 below RARE); one of fewer than k words counts as rare."""
    if len(words) < k:
        return np.zeros(n)
    share = np.maximum(freq[(words & U(CELLS - 1)).astype(np.int64)], 1) / max(freq.sum(), 1)
    out = np.full(n, float(max(freq.sum(), 1)))
    for i in range(k):
        out *= share[i:i + n]
    return np.where(out < RARE, 0.0, out)


def profile(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n (set size), a 128-bit digest of the set, its first q shingles in common-last order, ties by hash, and how many it may pass over."""
    docs = id_text(docs)
    freq = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k))

    def run(batches):
        f = freq.value
        for b in batches:
            ids, sizes, d1, d2, pre, spare = b.column("doc_id"), [], [], [], [], []
            for _, w, s in _shingled(b.column("text"), k):
                often = _expected(w, k, len(s), f)
                s, first = np.unique(s, return_index=True)
                n = len(s)
                sizes.append(n)
                d1.append(int(T.mix(s).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(T.mix(s + U(0x5851F42D4C957F2D))).view(np.int64)) if n else 0)
                pre.append(s[np.argsort(often[first], kind="stable")[:_emitted(n, pct)]].view(np.int64))
                spare.append(_spare(n, pct) if n else 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(pre, pa.list_(pa.int64())), pa.array(spare, pa.int32())], ["doc_id", "n", "d1", "d2", "prefix", "spare"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>, spare int")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([np.unique(s).tobytes() for _, _, s in _shingled(b.column("text"), k)], pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Rows (task, side, open, id) of the block pairs in which open members of a region can find partners.

    members: region, ring, open, last (open ones meet each other here), id, weight. Blocks of one (region, ring, open) come from a hash of the id.
    """
    size = members.groupBy("region", "ring", "open", "last").agg(F.ceil(F.greatest(F.sum("weight") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"))
    a = size.filter("open").select("region", F.col("ring").alias("ring_a"), F.col("blocks").alias("blocks_a"), F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
    pairs = a.join(size, ["region", "ring"]).filter("NOT open OR last AND ring >= ring_a") \
        .withColumn("i", F.explode(F.expr("sequence(0, blocks_a - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).filter("NOT (open AND ring = ring_a) OR j >= i") \
        .select("region", "ring_a", "i", "ring", "open", "j", F.xxhash64("region", "ring_a", "i", "ring", "open", "j").alias("task"))
    placed = members.drop("last").join(size.drop("last"), ["region", "ring", "open"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = pairs.select("task", "region", F.col("ring_a").alias("ring"), F.lit(True).alias("open"), F.col("i").alias("block"), F.lit(0).alias("side"))
    right = pairs.select("task", "region", "ring", "open", F.col("j").alias("block"), F.lit(1).alias("side"))
    return placed.join(left.unionByName(right), ["region", "ring", "open", "block"]).select("task", "side", "open", "id")


def _l1_near(hist: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray, pct: int) -> np.ndarray:
    """Which of ``others`` can reach the threshold with ``one`` by their sizes and cell counts (no false negatives)."""
    n, m = sizes[one], sizes[others]
    others = others[(100 * np.minimum(n, m) >= pct * np.maximum(n, m))]
    apart = np.abs(hist[others] - hist[one]).sum(1)
    return others[apart * (100 + pct) <= (100 - pct) * (n + sizes[others])]


def _set(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(rows: DataFrame, pct: int) -> DataFrame:
    """(a, b): links between members of block pairs by whole sets; of links that join the same members again, one is enough."""

    def fn(t: pa.Table, bounds: np.ndarray):
        sets = [_set(x) for x in t.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        hist = np.stack([np.bincount((s >> U(57)).astype(np.int64), minlength=HIST) for s in sets]).astype(np.int32) if sets else np.zeros((0, HIST), np.int32)
        ids, side, opened = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "side", "open"))
        found: list[tuple[int, int]] = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            up = {int(x): int(x) for x in ids[lo:hi]}

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            closed = [int(x) for x in ids[lo:hi][~opened[lo:hi]]]  # all of them link to the pivot
            for x in closed:
                up[x] = closed[0]
            left, right = (lo + np.flatnonzero(side[lo:hi] == x) for x in (0, 1))
            for i in left:
                for j in _l1_near(hist, n, i, right, pct):
                    x, y = top(int(ids[i])), top(int(ids[j]))
                    if x != y:
                        both = _common(sets[i], sets[j])
                        if 100 * both >= pct * (n[i] + n[j] - both):
                            up[x] = y
                            found.append((int(ids[i]), int(ids[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return map_groups(rows.select("task", "side", "open", "id", "shingles"), "task", fn, "a long, b long")


def _to_pivot(rows: DataFrame) -> DataFrame:
    """region, id, n, common and all (intersection and union with the pivot's set)."""

    def run(batches):
        for b in batches:
            sets, pivots = b.column("shingles").to_pylist(), b.column("pivot_shingles").to_pylist()
            x = [(len(m) // 8, _common(_set(m), _set(p)), len(p) // 8) for m, p in zip(sets, pivots)]
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("id"), pa.array([v[0] for v in x], pa.int64()), pa.array([v[1] for v in x], pa.int64()), pa.array([v[0] + v[2] - v[1] for v in x], pa.int64())], ["region", "id", "n", "both", "any"])

    return rows.select("region", "id", "shingles", "pivot_shingles").mapInArrow(run, "region long, id long, n long, both long, any long")


def near_links(docs: DataFrame, prof: DataFrame, k: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc_id, n and rep of each document; links (a, b) between representatives that connect whatever is linked."""
    classes = written(prof.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
    copies = written(prof.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "rep"), "copies")
    of = prof.select("doc_id", "n").join(copies.distinct(), "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    reps = without_ids(prof.filter("n > 0").select("doc_id", "spare", "prefix"), copies.filter("doc_id <> rep").select("doc_id"), "doc_id")
    postings = reps.select("doc_id", "spare", F.explode("prefix").alias("h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("holders")).filter("holders > 1")
    # all of a document's shared shingles are at hand (no more than it emitted), rarest first: the last ``spare`` may go
    kept = postings.join(shared, "h").groupBy("doc_id", "spare").agg(F.array_sort(F.collect_list(F.struct("holders", "h"))).alias("s")).filter("size(s) > spare") \
        .select("doc_id", F.explode(F.expr("slice(s, 1, size(s) - spare)")).alias("x")).select("doc_id", F.col("x.h").alias("h"))
    kept = written(kept, "kept")
    heads = kept.groupBy("h").agg(F.min("doc_id").alias("head"), F.count("*").alias("holders")).filter("holders > 1").select("h", "head")
    met = written(kept.join(heads, "h").filter("doc_id <> head").select("head", "doc_id").distinct(), "met")
    regions = components(met.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    sets = written(_sets(with_ids(id_text(docs), regions.select(F.col("id").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]), k).withColumnRenamed("doc_id", "id"), "sets")
    degree = met.groupBy(F.col("head").alias("id")).agg(F.count("*").alias("met"))
    members = written(regions.withColumnRenamed("component", "region").join(degree, "id", "left").select("region", "id", F.coalesce("met", F.lit(0)).alias("met")), "members")
    links = None
    while True:
        pivots = members.groupBy("region").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("pivot"), F.count("*").alias("size"))
        of_pivots = with_ids(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("pivot_shingles")), pivots, "pivot")
        placed = members.join(pivots, "region").join(sets, "id").join(of_pivots, "pivot")
        near = written(_to_pivot(placed).withColumn("open", F.expr(f"100 * both < {pct} * any")).withColumn("ring", F.expr(f"CAST(floor((any - both) * 100 / (any * {100 - pct}D) - 1e-9) AS INT)")), "near")
        # a region in which many stay open, though fewer than before, goes on with a new pivot
        again = near.groupBy("region").agg(F.count("*").alias("all"), F.sum(F.col("open").cast("long")).alias("opened")).select("region", (~F.expr(f"opened > {MANY_OPEN} AND opened < 0.95 * all")).alias("last"))
        near = near.join(again, "region")
        tasks = _block_pairs(near.select("region", "ring", "open", "last", "id", F.col("n").alias("weight")))
        found = _linked(tasks.join(sets, "id"), pct)
        now = near.filter("NOT open").join(pivots.select("region", "pivot"), "region").filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(found)
        now = written(now, "found")
        links = now if links is None else links.unionByName(now)
        rest = near.filter("open AND NOT last").select("region", "id")
        members = written(rest.join(members.select("id", "met"), "id").select("region", "id", "met"), "members")
        if members.isEmpty():
            return of, links


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= pct / 100).

    Words are runs of non-space bytes, A-Z lower-cased; a set holds the distinct k-word shingles, or the whole sequence of fewer
    words. Null and empty texts have empty sets and link with nothing, not even with each other. Repeated doc_ids keep a row each
    with the same component if their texts are equal. Empty tables give no rows; other columns are ignored.
    """
    prof = written(profile(docs, k, pct), "profile")
    of, links = near_links(docs, prof, k, pct)
    comp = components(links)
    return of.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
