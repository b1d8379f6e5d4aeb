"""Operator 5: benchmark decontamination by winnowing.

Of each ``window`` consecutive k-word hashes the smallest is a fingerprint (the rightmost of equals), for documents and items
alike, so any shared span of k + window - 1 words has a fingerprint in common at the same place. Fingerprints of both sides are
joined; each hit is extended to both sides over the neighbouring words that travel with it (k + window - 1 before, as many after),
and spans of k + window - 1 words or more count. Items shorter than that are one span, looked up by its hash at its own length.

The item side is aggregated to distinct contexts first, so copies of an item don't multiply hits. The documents' fingerprints
are thinned before the shuffle by those of the items only while the items' are few (``MOST_KEYS``, counted); beyond that all are
shuffled and the join alone decides. The result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustwatch.llm import text as T
from trustwatch.llm.stage import written

MOST_KEYS = 1_000_000
K, WINDOW = 5, 6
U = np.uint64


def _fingerprints(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the fingerprints in one text."""
    h = T.shingles(words, k)
    if len(h) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h[::-1], window)[::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


def _scan(rows: DataFrame, key: str, k: int, window: int, lengths: list[int], wanted) -> DataFrame:
    """key, n_words, and its fingerprints: place, kind (0, or the length of a short item), hash and the words around as hashes."""
    span = k + window - 1

    def run(batches):
        for b in batches:
            ids = b.column(key).to_pylist()
            out: list[list] = [[], [], []]
            for lo, hi, buf, offs in T.slices(b.column("text")):
                w = T.hash_words(buf, offs, T.NOT_ALNUM, T.LOWER)
                for r in range(hi - lo):
                    x = w.hash[w.ptr[r]:w.ptr[r + 1]]
                    found = []
                    for kind in [0, *lengths]:
                        at = _fingerprints(x, k, window) if kind == 0 else np.arange(len(x) - kind + 1)
                        if not len(at):
                            continue
                        h = T.shingles(x, kind or k)[at] + U(kind)
                        if wanted is not None:
                            keys = wanted.value
                            slot = np.searchsorted(keys, h)
                            slot[slot == len(keys)] = 0
                            keep = keys[slot] == h if len(keys) else np.zeros(len(h), bool)
                            at, h = at[keep], h[keep]
                        for p, v in zip(at.tolist(), h.view(np.int64).tolist()):
                            a = max(0, p - (span - k)) if kind == 0 else p
                            found.append({"at": p, "kind": kind, "hash": v, "before": p - a, "around": x[a:p + (span if kind == 0 else kind)].view(np.int64)})
                    out[0].append(ids[lo + r])
                    out[1].append(len(x))
                    out[2].append(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(key).type), pa.array(out[1], pa.int64()), pa.array(out[2], hit)], [key, "n_words", "prints"])

    hit = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.int32()), ("hash", pa.int64()), ("before", pa.int32()), ("around", pa.list_(pa.int64()))]))
    kind_of = dict(rows.dtypes)[key]
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind_of}, n_words long, prints array<struct<at:long,kind:int,hash:long,before:int,around:array<long>>>")


def _item_lengths(items: DataFrame, most: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n = [np.diff(T.hash_words(buf, offs, T.NOT_ALNUM, T.LOWER).ptr) for _, _, buf, offs in T.slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["n"])

    return items.select("text").mapInArrow(run, "n long").filter(f"n BETWEEN 1 AND {most}").distinct()


def _extended(k: int, span: int):
    """Where the words around a hit agree: (first, last + 1) in the document, both null if the span is too short."""

    def run(batches):
        for b in batches:
            at, kind, before, item_before = (b.column(c).to_pylist() for c in ("at", "kind", "before", "item_before"))
            ours, theirs = b.column("around").to_pylist(), b.column("item_around").to_pylist()
            first, last = [], []
            for p, kd, bd, bi, x, y in zip(at, kind, before, item_before, ours, theirs):
                if kd:
                    ok = x == y
                    first.append(p if ok else None)
                    last.append(p + kd if ok else None)
                    continue
                left = 0
                while left < min(bd, bi) and x[bd - left - 1] == y[bi - left - 1]:
                    left += 1
                right = 0
                while right < min(len(x) - bd, len(y) - bi) and x[bd + right] == y[bi + right]:
                    right += 1
                ok = right >= k and left + right >= span
                first.append(p - left if ok else None)
                last.append(p + right if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(first, pa.int64()), pa.array(last, pa.int64()), b.column("content")], ["doc", "first", "last", "content"])

    return run


def shared_spans(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans): doc (a number of the row, so that repeated doc_ids stay apart), doc_id and n_words of each row; doc, first, last, item_id of shared spans."""
    span = k + window - 1
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lengths = sorted(r.n for r in _item_lengths(items, span - 1).collect())
    # an item of few words is one window: only its own length counts
    marked = _scan(items, "item_id", k, window, lengths, None).select("item_id", "n_words", F.explode("prints").alias("p")).filter("p.kind = 0 OR p.kind = n_words")
    prints = written(marked.select("item_id", "p.hash", "p.kind", F.col("p.before").alias("item_before"), F.col("p.around").alias("item_around")).distinct(), "items")
    content = F.xxhash64("hash", "item_before", "item_around").alias("content")
    contexts = written(prints.select("hash", "kind", "item_before", "item_around", content).distinct(), "contexts")
    holders = prints.select(content, "item_id").distinct()
    few = contexts.select("hash").distinct().limit(MOST_KEYS + 1).count() <= MOST_KEYS
    wanted = items.sparkSession.sparkContext.broadcast(np.sort(contexts.select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64).view(np.uint64))) if few else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scanned = written(_scan(rows, "doc_id", k, window, lengths, wanted).withColumn("doc", F.monotonically_increasing_id()), "fingerprints")
    hits = scanned.select("doc", F.explode("prints").alias("p")).select("doc", "p.*")
    pairs = hits.join(contexts, ["hash", "kind"]).select("doc", "at", "kind", "before", "around", "item_before", "item_around", "content")
    met = pairs.mapInArrow(_extended(k, span), "doc long, first long, last long, content long").filter("first IS NOT NULL").distinct()
    return scanned, written(met.join(holders, "content").select("doc", "first", "last", "item_id").distinct(), "spans")


def contaminated(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside shared spans), spans (merged), items (ids, sorted as strings) of each row of ``docs``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts have no words and hit
    nothing; an empty item never occurs; with no items nothing is hit. Rows that share a doc_id are judged each, rows without a doc_id too. Extra columns are ignored.
    """
    scanned, spans = shared_spans(docs, items, k, window)
    order = spans.select("doc", "first", "last").distinct()
    merged = order.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s")).select("doc", F.expr(
        "aggregate(s, CAST(array() AS array<struct<first:bigint,last:bigint>>), (a, x) -> IF(size(a) > 0 AND x.first <= element_at(a, -1).last, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))), concat(a, array(x))))").alias("spans"))
    held = spans.select("doc", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = merged.join(held, "doc")
    return scanned.select("doc", "doc_id", "n_words").join(found, "doc", "left").select(
        "doc_id", "n_words", F.expr("aggregate(coalesce(spans, array()), 0L, (a, x) -> a + x.last - x.first)").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
