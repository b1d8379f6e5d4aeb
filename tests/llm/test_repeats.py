"""Rows that repeat a doc_id (with equal and with other texts), null doc_ids, null and empty texts and clashing columns: each row is judged by its own text."""

import collections
import math
import re
import zlib

import pytest

from trustwatch.llm import pitman_yor, weak_labels, winnow

SPACED, ALNUM = re.compile("[^\x20\x09-\x0D]+"), re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    more = [(base[1][0], base[1][1]), (base[1][0], "two words"), (base[2][0], None), (5_000, f"before {SPAN} after"), (5_000, "clean row"), (5_000, f"{SPAN} again"), (5_001, None), (5_001, ""), (None, f"no id {SPAN}"), (None, None)]
    return spark.createDataFrame([(*r, 1, "x") for r in base + more], "doc_id long, text string, doc int, content string").repartition(4).cache()


def _rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_language_model_rows(docs):
    rows = [(i, [*SPACED.findall(x.encode().lower().decode() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x)), ""]) for i, x in _rows(docs) if i is not None]
    count = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in rows)
    got = pitman_yor.lm_scores(docs, pitman_yor.Settings(head=20)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.doc_id, r.n_tokens].add(round(r.score, 6))
    assert all(len(s) == 1 for (i, _), s in by_text.items() if i in (5_000, 5_001))


def test_contaminated_rows(spark, docs):
    items = spark.createDataFrame([(1, SPAN), (2, "two words")], "item_id long, text string")
    span = SPAN.split()
    want = []
    for i, x in _rows(docs):
        w = ALNUM.findall("".join(c.lower() if c.isascii() else c for c in x))
        hit, held = set(), set()
        for item, n, own in ((1, 10, {tuple(span[j:j + 10]) for j in range(3)}), (2, 2, {("two", "words")})):
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in own:
                    hit |= set(range(j, j + n))
                    held.add(str(item))
        want.append((str(i), len(w), len(hit), tuple(sorted(held))))
    got = [(str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in winnow.contaminated(docs, items).collect()]
    assert sorted(got) == sorted(want) and sum(h > 0 for _, _, h, _ in want) == 4


def test_weak_label_rows(docs):
    rows = [(i, x) for i, x in _rows(docs) if i is not None]
    got = weak_labels.weak_quality(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    clean = {r.pattern for r in weak_labels.weak_quality(docs.filter("doc_id = 5000 AND text = 'clean row'")).collect()}
    own = [r for r in got if r.doc_id == 5_000]
    assert len({(r.pattern, r.score) for r in own}) == 3 and clean <= {r.pattern for r in own} and len({r.score for r in got if r.doc_id == 5_001}) == 1


def test_expectation_maximisation():
    """Against a plain loop over patterns, classes and labellers; planted accuracies come back."""
    import random

    rng = random.Random(3)
    truth = {0: [(0.7, 0.1), (0.6, 0.2), (0.5, 0.05)], 1: [(0.1, 0.7), (0.15, 0.65), (0.05, 0.6)]}  # per class and labeller: chance of "-" and of "+"
    count = collections.Counter()
    for _ in range(20_000):
        c = int(rng.random() < 0.7)
        count["".join("-" if (u := rng.random()) < a else "+" if u < a + b else "0" for a, b in truth[c])] += 1
    patterns = sorted(count)
    import numpy as np

    good, table, prior = weak_labels.posteriors(patterns, np.array([count[p] for p in patterns], float))
    p = {x: min(0.95, max(0.05, (x.count("+") + 1) / (x.count("+") + x.count("-") + 2))) for x in patterns}
    for _ in range(100):
        acc, share = {}, 0.0
        for c in (0, 1):
            for j in range(3):
                t = {s: 1.0 + sum(count[x] * (p[x] if c else 1 - p[x]) for x in patterns if x[j] == s) for s in "0-+"}
                acc[c, j] = {s: t[s] / sum(t.values()) for s in t}
        share = sum(count[x] * p[x] for x in patterns) / sum(count.values())
        new = {}
        for x in patterns:
            a = share * math.prod(acc[1, j][x[j]] for j in range(3))
            b = (1 - share) * math.prod(acc[0, j][x[j]] for j in range(3))
            new[x] = a / (a + b)
        if max(abs(new[x] - p[x]) for x in patterns) < 1e-9:
            break
        p = new
    assert all(good[i] == pytest.approx(p[x], abs=1e-6) for i, x in enumerate(patterns)) and prior == pytest.approx(0.7, abs=0.05)
    assert table[1, 0, 2] == pytest.approx(0.7, abs=0.05) and table[0, 0, 1] == pytest.approx(0.7, abs=0.05)
