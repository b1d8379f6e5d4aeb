"""Places of license blocks against a run-by-run search, and a positional filter that prunes without loss."""

import numpy as np

from trustwatch.llm import license_scan as L


def found_by_runs(w, template, percent=80):
    """Blocks from left to right over every run of ``width`` words, cut to the template's tokens."""
    t = L._plain(template)
    width, need, out = -(-100 * len(t) // percent), -(-percent * len(set(t)) // 100), []
    for e in range(len(w)):
        run = range(max(0, e - width + 1), e + 1)
        last = {w[i]: i for i in run if w[i] in set(t)}
        if w[e] not in last or len(last) < need:
            continue
        one = (min(last.values()), e + 1, len(last))
        if not out or one[0] >= out[-1][1]:
            out.append(one)
        elif one[2] > out[-1][2]:
            out[-1] = one
    return [(s, e, n / len(set(t))) for s, e, n in out]


def texts():
    rng = np.random.default_rng(11)
    mit, bsd = L.TEMPLATES["mit"], L.TEMPLATES["bsd"]
    out = [f"{mit} {mit}", f"pad pad {mit} pad {bsd} pad {mit}", None, "", mit.upper(), " ".join(mit.split()[:-3]), "x " * 20000 + mit + " y" * 20000]
    names = list(L.TEMPLATES)
    for _ in range(120):
        w = []
        for name in rng.choice(names, rng.integers(1, 4)):
            w += ["x"] * int(rng.integers(0, 6)) + [v for v in L._plain(L.TEMPLATES[name]) if rng.random() < 0.93]
        out.append(" ".join(w))
    return out


def test_blocks_have_places(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(rows)], "doc_id long, text string, label string")
    got = {}
    for r in L.similar_blocks(docs).collect():
        got.setdefault((r.doc_id, r.label), []).append((r.start, r.end, r.containment))
    want = {(i, label): b for i, x in enumerate(rows) for label, t in L.TEMPLATES.items() if (b := found_by_runs(L._plain(x or ""), t))}
    assert {k: sorted(v) for k, v in got.items()} == want
    n = len(L._plain(L.TEMPLATES["mit"]))
    assert [b[:2] for b in want[0, "mit"]] == [(0, n), (n, 2 * n)] and len(want[1, "mit"]) == 2 and want[6, "mit"] == [(20000, 20000 + n, 1.0)]
    one = {r.doc_id: {b.label: (b.n, b.start, b.end) for b in r.blocks} for r in L.license_scan(docs).collect()}
    assert one[0] == {"mit": (2, 0, 2 * n)} and one[2] == one[3] == {}
    assert {(r.n_words, len(r.places), len(r.blocks)) for r in L.license_scan(docs.filter("doc_id < 4"), {}, {}).collect()} == {(2 * n, 0, 0), (len(L._plain(rows[1])), 0, 0), (0, 0, 0)}
    assert L.similar_blocks(docs, {}).count() == 0 and L.similar_blocks(docs.filter("false")).count() == 0


def test_positional_filter_prunes_and_loses_nothing(spark):
    """A text of another template's rare tokens and two common ones of this: long enough, shares a prefix token, yet too few tokens from there on."""
    a, b = "a1 a2 a3 a4 c1 c2", "b1 b2 b3 b4 c1 c2"
    known = {"a": a, "b": b}
    rows = [a, b, "b1 b2 b3 b4 b9", "a4 c1 c2 b1 b2", "b1 b2 a1", "c1 c2 b1 b2 b3 a4", "a1 a2 b3 c1"] + ["c1 c2 c3"] * 9
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    pairs = lambda p: {(r.doc_id, r.label) for r in L.candidate_pairs(L.token_sets(docs, known), known, 60, p).select("doc_id", "label").collect()}
    held = {(i, name) for i, x in enumerate(rows) for name, t in known.items() if len(set(x.split()) & set(t.split())) >= 4}
    assert held <= pairs(True) < pairs(False) and (6, "b") in pairs(False) - pairs(True)
