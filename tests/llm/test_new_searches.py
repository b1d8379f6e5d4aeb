"""Operators 11 to 13 against brute force: byte-level BPE, ranked lexical search, hard negatives."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from trustwatch.llm import bpe, hard_negatives, ranked_search

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["", "'s 'S 're 'r 'll 'l 've''s it's we'll'd  's \n's \t\n x  ", "a b  c\r\n\r\n", "  two  three   x", "漢字 12１２ ²½ ok", "é \U0001F600\U0001F600!?", "<|endoftext|> \x1c\x85", "z" * 30_000, "'" * 300 + "s", " " * 5_000, None]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = bpe.vocabulary(bpe.default_vocabulary()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, sf, reference):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + ["again", "again"]
    data = [(i, x, "c", 1) for i, x in enumerate(texts)] + [(3, "same id", "c", 1), (None, "no id", "c", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = collections.defaultdict(list)
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.offsets == np.r_[0, np.cumsum([len(reference.decode_single_token_bytes(i)) for i in r.ids])][:-1].tolist()
        got[r.doc_id].append((r.ids, bytes(r.decoded)))
    want = collections.defaultdict(list)
    for i, x, *_ in data[:-1]:
        want[i].append((reference.encode_ordinary(x or ""), (x or "").encode()))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    one = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs.filter("doc_id < 3")))).collect()}
    assert one[1].ids_sha256 == hashlib.sha256(",".join(map(str, want[1][0][0])).encode()).hexdigest() and one[1].decoded_sha256 == hashlib.sha256(want[1][0][1]).hexdigest()
    assert bpe.decode(bpe.encode(docs.filter("doc_id < -1"))).count() == 0


def test_bpe_boundaries(reference):
    """Slices are the pattern's matches, for every code point and for random mixes of those that matter."""
    random.seed(4)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    mix = list("'''   \n\t\rstmdrvleaTE9é漢²! ́")
    texts = ["".join(random.choices(mix, k=random.randrange(40))) for _ in range(4000)] + ["".join(random.sample(every, len(every))), " ".join(random.sample(every, 20_000)), ""]
    raw = [x.encode() for x in texts]
    start, end, ptr = bpe.cut(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])])
    whole = b"".join(raw)
    import regex

    white = "[\t-\r \x85   -     　]"
    ours = regex.compile(bpe.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\p{{L}}\p{{N}}\t-\r \x85   -     　]").replace(r"\s", white).replace(r"\S", "[^" + white[1:]))
    for i, x in enumerate(texts[:4000]):
        assert [whole[a:b].decode() for a, b in zip(start[ptr[i]:ptr[i + 1]], end[ptr[i]:ptr[i + 1]])] == ours.findall(x), x
    v = bpe.vocabulary(bpe.default_vocabulary())
    for i in (4000, 4001):  # the library's own Unicode tables
        ids, _, _ = v.encode(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))
        assert ids.tolist() == reference.encode_ordinary(texts[i])


@pytest.mark.parametrize("width", [1, 3, 64])
def test_bpe_scan_is_the_automaton(width):
    classes = np.random.default_rng(1).integers(0, 11, 500).astype(np.uint8)
    state, want = bpe.FREE, []
    for c in classes:
        want.append(state)
        state = bpe._TO[c, state]
    assert bpe.states_before(classes, width).tolist() == want


def _ranked(docs, items, count=10):
    bags = [(i, collections.Counter(WORD.findall("".join(c.lower() if c.isascii() else c for c in x or "")))) for i, x in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, x in items:
        terms = set(WORD.findall("".join(c.lower() if c.isascii() else c for c in x or "")))
        scores = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in terms if b[w])
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:count])]
    return sorted(out)


@pytest.mark.parametrize("batch,leaf,tile", [(128, 16, 128), (7, 2, 9)])
def test_ranked_search(spark, sf, batch, leaf, tile):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs += [(900, None), (901, ""), (902, items[0][1]), (903, items[0][1]), (903, items[0][1]), (904, "ÜBER Über"), (905, " ".join(f"w{i % 977}" for i in range(60_000))), (906, "-- !!")]
    items += [(2000, None), (2001, "..."), (2002, "ÜBER"), (2003, items[1][1]), (1, items[1][1]), (2004, "nowhere"), (2005, " ".join(f"w{i}" for i in range(900)))]
    d = spark.createDataFrame([(i, x, 1, 2) for i, x in docs], "doc_id long, text string, score int, tile int").repartition(3)
    i = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, rank int")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked(d, i, batch=batch, leaf=leaf, tile=tile).collect())
    assert got == _ranked(docs, items)
    assert ranked_search.ranked(d.filter("doc_id < 0"), i).count() == 0 and ranked_search.ranked(d, i.filter("item_id < 0")).count() == 0


def test_search_prunes():
    """Batches that hold nothing of an item are left out, and a raised floor drops leaves; the result stays that of all scores."""
    rng = np.random.default_rng(2)
    items = {"rows": np.arange(4), "item_ids": np.arange(4), "i_ptr": np.arange(0, 41, 10), "i_terms": rng.permutation(40), "weights": rng.integers(1, 50, 40)}
    tree = ranked_search._ItemTree(items, 2)
    value = rng.integers(0, 9, (64, 40))
    doc, term = np.nonzero(value)
    low = ranked_search._maxima(doc // 4, term, value[doc, term])
    r = {"ids": np.arange(64), "ptr": np.searchsorted(doc, np.arange(65)), "terms": term, "values": value[doc, term], "leaf_of": low[0], "leaf_terms": low[1], "leaf_values": low[2]}
    weight = np.zeros((4, 40), int)
    weight[np.repeat(np.arange(4), 10), items["i_terms"]] = items["weights"]
    score = weight @ value.T
    for floor in (1, int(np.sort(score, 1)[:, -3].min()), 10**6):
        found = ranked_search._searched(tree, r, np.full(4, floor), 3, 4)
        got = sorted((int(i), int(d), int(s)) for at, ds, ss in found for i, d, s in zip(at, ds, ss))
        want = sorted((i, d, int(score[i, d])) for i in range(4) for d in sorted(range(64), key=lambda d: (-score[i, d], d))[:3] if score[i, d] >= floor)
        assert got == want


def _mined(rows, count=5):
    rows = [(v, lab, [math.floor(256 * x) for x in e]) for v, lab, e in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (v, lab, q) in enumerate(rows):
        if v % 100:
            continue
        s = [sum(x * y for x, y in zip(q, r[2])) for r in rows]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-s[b], rows[b][0]))
        for p in [b for b in order if rows[b][1] == lab][:count]:
            near = [b for b in order if rows[b][1] != lab and 80 * s[p] <= 100 * s[b] <= 100 * s[p]][:count]
            out += [(v, rows[p][0], k + 1, rows[b][0], s[p], s[b]) for k, b in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block,tile,pack", [(1024, 512, 256), (16, 3, 4)])
def test_hard_negatives(spark, block, tile, pack):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=5) * 0.2]) for i in range(400)]
    rows += [(500, 0, None), (501, None, [1.0] * 5), (502, 1, [1.0, None, 0.0, 0.0, 0.0]), (503, 1, [math.nan] * 5), (600, 1, [math.inf] * 5), (700, 2, [0.0] * 5), (800, 9, [1.0, 1.0]), (801, 9, []), (900, 0, list(rows[0][2])), (900, 0, list(rows[0][2])), (901, 1, list(rows[0][2])), (1000, 5, [3.0e4] * 5), (1001, 5, [3.0e4] * 5), (1002, 4, [2.9e4] * 5)]
    rows += [(2000 + i, 1, list(rows[7][2])) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, block string, anchor int").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, "vec_id % 100 = 0", block=block, tile=tile, pack=pack).collect())
    assert got == _mined(rows) and len(got) > 20
    assert hard_negatives.hard_negatives(df.filter("vec_id < 0"), "vec_id % 100 = 0").count() == 0


def test_hilbert_curve():
    """In two and three dimensions every cell has its own place, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = hard_negatives.hilbert_place(cells, bits)
        along = cells[np.lexsort(place.T[::-1])]
        assert len(np.unique(place, axis=0)) == len(cells) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_intervals_bound_scores():
    rng = np.random.default_rng(3)
    a, m = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (50, 8))
    down, up = hard_negatives.interval(a, m.min(0)[None], m.max(0)[None])
    s = a @ m.T
    assert (s >= down).all() and (s <= up).all()
    big = np.array([[2**40, 3], [-(2**40), 5]])
    assert hard_negatives.exact_product(big, np.array([[2**20, 7]])).tolist() == [[2**60 + 21], [-(2**60) + 35]]
