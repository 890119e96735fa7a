"""Codes, errors and codebooks against plain Lloyd rounds in Python's integers, and the bounds against full scans."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import op11_yinyang as op11

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def plain(rows, entries, rounds=4, parts=4):
    """rows: (vec_id, vector, label) that are kept; {row number: (code, error)} and the final codebooks."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))
    size = len(whole[0]) // parts
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda e, p=p, c=c: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if turn == rounds:
            break
        for p in range(parts):
            held = defaultdict(list)
            for c, n in zip(cut, near, strict=True):
                held[n[p]].append(c[p])
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [("".join(f"{e:02x}" for e in n), sum(far(c[p], books[p][n[p]]) for p in range(parts))) for c, n in zip(cut, near, strict=True)], books


@pytest.mark.parametrize("entries", [256, 20])
def test_codes_against_plain_rounds(spark, monkeypatch, entries):
    monkeypatch.setattr(op11, "ENTRIES", entries)
    monkeypatch.setattr(op11, "ROWS", 50)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(rng.choice([-0.3, 0.2]), 0.05) for _ in range(12)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(30)]  # a common vector
    rows += [(300 + i, [rng.choice([0.0, 0.25, -0.25]) for _ in range(12)], None) for i in range(60)]  # many ties
    rows += [rows[3], (None, rows[9][1], 2)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    bad = [(1000, None, 1), (1001, [None] + [0.5] * 11, 1), (1002, [math.nan] * 12, 1), (-5, [math.inf] * 12, 1)]
    got = op11.vector_codes(spark.createDataFrame([(*r, "clash", 0) for r in rows + bad], SCHEMA).repartition(5)).collect()
    codes, books = plain(rows, entries)
    by_label = defaultdict(int)
    for (_, _, label), (_, error) in zip(rows, codes, strict=True):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    wanted = sorted((str(r[0]), code, error, by_label[r[2]], digest) for r, (code, error) in zip(rows, codes, strict=True))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == wanted


def test_bounds_skip_groups_and_keep_the_nearest():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 8))
    x = (centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    book = centres + rng.integers(-30, 30, (64, 8))
    group = op11.grouped(book)
    k = int(group.max()) + 1
    code, upper, lower, scanned = op11.assign(x, book, group, None, np.zeros(len(x)), np.zeros((len(x), k)), None)
    assert scanned == len(x) * k
    for _ in range(4):
        after = book + rng.integers(-5, 6, book.shape)
        moved = np.sqrt(((after - book) ** 2).sum(1)) * (1 + op11.LOOSE)
        book = after
        code, upper, lower, scanned = op11.assign(x, book, group, code, np.float32(upper).astype(float), np.float32(lower).astype(float), moved)
        square = ((x[:, None] - book) ** 2).sum(2)
        assert (code == square.argmin(1)).all() and scanned < len(x) * k / 2
        own = np.sqrt(square.min(1))
        assert (upper >= own - 1e-6).all()
        square[np.arange(len(x)), code] = np.iinfo(np.int64).max
        for g in range(k):
            if (group == g).any():
                assert (lower[:, g] <= np.sqrt(square[:, group == g].min(1).astype(float)) * (1 + 1e-9)).all()


def test_empty_and_odd_tables(spark):
    assert op11.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op11.vector_codes(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)).count() == 0
    assert [tuple(r)[:4] for r in op11.vector_codes(spark.createDataFrame([(1, [], 1, "", 0)], SCHEMA)).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="length"):
        op11.vector_codes(spark.createDataFrame([(1, [0.5] * 8, 1, "", 0), (2, [0.5] * 4, 1, "", 0)], SCHEMA))
