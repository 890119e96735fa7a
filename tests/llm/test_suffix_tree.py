"""The suffix tree's scores against a plain tree of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import op1_suffix_tree as op1


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows, depth):
    """(score, base, tokens, known) of each row."""
    held = [i is not None and zlib.crc32(str(i).encode()) % op1.OF == op1.HELD_OUT for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    root = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    total, kinds = sum(root.values()), len(root)
    after = defaultdict(Counter)
    for t, h in zip(texts, held, strict=True):
        for i in range(len(t)):
            for k in range(1, depth + 1):
                if i >= k and not h:
                    after[tuple(t[i - k : i])][t[i]] += 1

    def rooted(w):
        return (root[w] - op1.DISCOUNT) / total if root[w] else op1.DISCOUNT * kinds / total if total else 1.0

    kept = {}

    def p(context, w):
        if not context:
            return rooted(w)
        below = p(context[1:], w)
        if not kept.get(context):
            return below
        c, n = after[context], sum(after[context].values())
        return max(c[w] - op1.DISCOUNT, 0) / n + op1.DISCOUNT * len(c) / n * below

    for k in range(1, depth + 1):
        for context in [x for x in after if len(x) == k]:
            c, gain = after[context], 0.0
            n = sum(c.values())
            if n < op1.LEAST:
                continue
            share = op1.SHARE * n ** (op1.SHARE - 1)
            for w, m in c.items():
                below = math.exp(-round(-math.log(p(context[1:], w)) * op1.STEPS) / op1.STEPS)
                gain += m * math.log(((1 - share) * (m - 1) / (n - 1) + share * below) / below)
            kept[context] = gain > op1.GAIN
    out = []
    for t in texts:
        score = sum(math.log10(p(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t))
        base = sum(math.log10((root[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        out.append((score, base, len(t), sum(root[w] > 0 for w in t)))
    return out, sum(kept.values())


@pytest.fixture(scope="module")
def corpus():
    import random

    r = random.Random(7)
    texts = [" ".join(r.choice(["The cat", "the  dog", "a\tcat", "Æ cat", "it"]) + r.choice([" sat", " ran", " sat down", f" w{r.randrange(40)}"]) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "the cat sat down"), (5, texts[5]), (900, None), (901, ""), (902, "the " * 3000), (903, "   ")]


@pytest.mark.parametrize(("depth", "hot"), [(2, op1.HOT), (3, 20), (1, 5)])
def test_scores(spark, corpus, monkeypatch, depth, hot):
    monkeypatch.setattr(op1, "PART", 700)
    frame = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, chunk string").repartition(3)
    got = op1.score(frame, depth, hot).collect()
    assert frame.count() == len(got) == len(corpus)
    expected, kept = brute(corpus, depth)
    assert kept > 10
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 5)) for r in got)
    want = sorted((-1 if i is None else i, n, known, round(base, 6), round(score, 5)) for (i, _), (score, base, n, known) in zip(corpus, expected, strict=True))
    for a, b in zip(have, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-4)
    assert sum(r.held_out for r in got) == sum(zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in corpus if i is not None)


def test_held_out_words_are_told_better_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = op1.score(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert r.s > r.b + 0.8


def test_nothing_to_learn_from(spark):
    assert op1.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = op1.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and r.score == 0 and r.base_score == 0


def _chunk(size=600_000):
    """A chunk of one training document, with words as uneven as those of texts."""
    import numpy as np

    token = np.minimum(np.random.default_rng(3).zipf(1.3, size), 60_000) - 1
    ids, token = np.unique(token, return_inverse=True)
    one = np.zeros(1, np.int64)
    hot = {level: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for level in (1, 2, 3)}
    return op1._Chunk(op1.packed(ids + 1, np.bincount(token), token), op1.packed(one, one, one, one + size), size, len(ids), hot, 200)


def test_a_chunk_is_dealt_in_less_than_a_stable_sort_of_its_pairs():
    """The sort alone was half of a deal's time, and each chunk is dealt five times."""
    import time

    import numpy as np

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    chunk = _chunk()
    dealt = least(lambda: chunk.deal(1))
    key = chunk.token[:-1].astype(np.uint64) << np.uint64(32) | chunk.token[1:].astype(np.uint64)
    assert len(chunk.at) > 500_000
    assert dealt < least(lambda: np.argsort(key, kind="stable"))


@pytest.mark.parametrize("wide", [False, True])
def test_pairs_are_ordered_whether_or_not_they_fit_one_number(wide):
    import numpy as np

    r = np.random.default_rng(5)
    a, b = r.integers(0, 30, 5000).astype(np.int32), r.integers(0, 30, 5000).astype(np.int32)
    if wide:
        a[0], b[1] = 2**31 - 1, 2**31 - 1
    order, start = op1._by_pair(a, b)
    want = sorted(range(len(a)), key=lambda i: (a[i], b[i], i))
    assert order.tolist() == want
    pairs = [(a[i], b[i]) for i in want]
    assert start.tolist() == [i for i in range(len(want)) if i == 0 or pairs[i] != pairs[i - 1]]
    assert [len(x) for x in op1._by_pair(a[:0], b[:0])] == [0, 0]
