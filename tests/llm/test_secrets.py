"""Patterns against plain regular expressions, the field against enumeration, and what the trained model finds in rows that it hasn't seen."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op12_secrets as op12
from tidemark.llm.common import utf8

SCHEMA = "doc_id long, text string, spans string, n_hex int"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'crf')[k]}:{a}:{b}" for a, k, b in spans)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghilmnoprstuéß", k=rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(3, 150)) + [f"{rng.choice(words)}.{rng.randint(1, 99)}@mail.example.com", f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"]
        rng.shuffle(own)
        key = "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 40])))
        found = [f"password={key}", f'Token = "{key}"', "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)), key + key, f"API_KEY : '{key}", None, None, None][i % 8]
        if found:
            own.insert(rng.randrange(len(own)), found)
        rows.append((i, " ".join(own).replace(" ", "\n", 1), "clash", 1))
    return rows


EDGES = [
    "token=secret=abcdefghij", "token: secret: abcdefghij", "toKen=abc passwd=12345678", "secret" * 3 + '"  :  "a.b-c/d+e=_', "api-key=12345678 apikey=12345678", "AKIA AKIAAKIA123 xAKIA0123456789AB AKIA01234567890", "f" * 31 + " " + "0" * 32 + "G" + "a" * 40,
    "toKen=abcdefgh ſecret=abcdefgh", "é" * 20 + "password='ü12345678", "password=12345678" * 3, "passwordpasswd=1234567 x", 'token"=\'' + "z" * 5000, "", None, "   ", "password:\n12345678", "日本 secret=日本12345678", "AKIA" + "Z" * 30 + "token=AKIA" + "Q" * 20,
]


def test_base_spans_against_plain_expressions(spark):
    rows = corpus(80, 1) + [(1000 + i, t, "", 0) for i, t in enumerate(EDGES)]
    rows += [rows[0], (None, "password=abcdefgh", "", 0), (2000, "lorem " * 40_000 + "token=0123456789", "", 0)]
    got = op12.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    wanted = []
    for i, t, *_ in rows:
        s = plain(t or "")
        wanted.append((str(i), *(sum(k == x for _, x, _ in s) for k in range(3)), hashlib.sha256(text_of(s).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(wanted)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        spans = [(int(a), ("assign", "access", "hex", "crf").index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and [s for s in spans if s[1] < 3] == plain(text[r.doc_id]) and r.n_crf == sum(s[1] == 3 for s in spans)
        assert all(b - a >= op12.SHORTEST and not any(x < b and a < y for x, k2, y in spans if k2 < 3) for a, k, b in spans if k == 3)
    assert op12.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def score(emit, step, path):
    return sum(emit[i, s] for i, s in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))


def test_field_against_enumeration():
    rng = np.random.default_rng(1)
    chain = np.repeat([0, 1, 2, 3], [5, 1, 7, 3])
    emit, step = rng.normal(0, 1.5, (len(chain), 3)), rng.normal(0, 1, (3, 3))
    got, (share, z, pairs) = op12.viterbi(emit, chain, step), op12.expectations(emit, chain, step)
    total, counts = 0.0, np.zeros((3, 3))
    for c in range(4):
        own = emit[chain == c]
        paths = list(itertools.product(range(3), repeat=len(own)))
        scores = np.array([score(own, step, p) for p in paths])
        assert tuple(got[chain == c]) == paths[int(scores.argmax())]
        weight = np.exp(scores - scores.max())
        weight /= weight.sum()
        total += np.log(np.exp(scores).sum())
        for k in range(len(own)):
            assert np.allclose(share[chain == c][k], [sum(w for w, p in zip(weight, paths, strict=True) if p[k] == s) for s in range(3)])
        for w, p in zip(weight, paths, strict=True):
            for a, b in itertools.pairwise(p):
                counts[a, b] += w
    assert z == pytest.approx(total) and np.allclose(pairs, counts)


def test_decoding_in_runs_is_viterbi():
    rng = np.random.default_rng(2)
    data, at = utf8(pa.array([r[1] for r in corpus(30, 5)] + ["", "one", None]))
    tokens = op12.Tokens(data, at)
    for spread in (0.3, 1.0):
        weights = rng.normal(0, spread, (op12.WIDTH, 3))
        weights[:, 0] += 0.25
        model = {"weights": weights, "step": rng.normal(0, 1, (3, 3))}
        assert (op12.decode(tokens, model) == op12.viterbi(weights[tokens.ids].sum(1), tokens.row, model["step"])).all()


def test_model_on_rows_it_has_not_seen(spark):
    model = op12.train(spark.createDataFrame(corpus(900, 11), SCHEMA))
    rows = corpus(400, 12)
    right = missed = wrong = 0
    data, at = utf8(pa.array([r[1] for r in rows]))
    tokens = op12.Tokens(data, at)
    found = op12.decode(tokens, model) > 0
    for r, (_, text, *_) in enumerate(rows):
        own, state = op12._states(tokens, r, text, op12.base_spans(text))
        right += (found[own] & (state > 0)).sum()
        missed += (~found[own] & (state > 0)).sum()
        wrong += (found[own] & (state == 0)).sum()
    assert right / (right + missed) > 0.97 and right / (right + wrong) > 0.97
    planted = ["the code 4f9a0c77b1e02d6a88 of", "auth 9c1e77ab02d4f6680b end"]  # no pattern has these
    assert [[t[a:b] for a, k, b in s] for t, s in zip(planted, op12.secrets_of(pa.array(planted), model), strict=True)] == [["4f9a0c77b1e02d6a88"], ["9c1e77ab02d4f6680b"]]


def test_without_anything_to_learn_only_patterns_count(spark):
    docs = spark.createDataFrame([(None, "password=abcdefgh and 4f9a0c77b1e02d6a88", "", 0), (1, "plain words", "", 0)], SCHEMA)
    assert sorted((str(r.doc_id), r.spans) for r in op12.scan(docs).collect()) == [("1", ""), ("None", "assign:0:17")]
