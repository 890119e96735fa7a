"""The ten operators against brute force on small tables with nulls, empty texts, ties, copies and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op1_suffix_tree, op2_licenses, op3_warc, op4_jaccard, op5_digest, op6_mixing, op7_quality, op8_toolcalls, op9_suffix, op10_decontaminate
from tidemark.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, row long, h string, kind string"
WORDS = [f"word{i}" for i in range(60)] + ["Été", "naïve", "über"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = " ".join(rng.choices(WORDS, k=rng.randint(1, 120)))
        if i % 5 == 1 and out:
            base = rng.choice(out) or ""
        elif i % 5 == 2 and out:
            parts = (rng.choice(out) or "").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            base = " ".join(parts)
        elif i % 5 == 3 and out:
            base += "\n" + (rng.choice(out) or "")[:300]
        out.append(base)
    return out + [None, "", "", "   \n\t", "x", "short one", "Word1 WORD2", "tail " * 3000]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t, "en", f"src{i % 7 if i % 3 else 0}", len(t or ""), "clash", i, "clash", "clash") for i, t in enumerate(texts())]
    return [*rows, rows[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---------------------------------------------------------------- 1


def test_op1(docs, rows, empty):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    count = Counter(t for i, text, *_ in rows if not held[i] for t in [*tokens(text), None])
    n, v = sum(count.values()), len(count)
    got = op1_suffix_tree.score(docs).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    for r in got:
        own = [*tokens(by[r.doc_id][1]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert op1_suffix_tree.score(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_op2_inherits_from_the_nearest_directory(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code only"), ("a/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/c/y.py", "nothing"), ("z/q.py", None), (None, "nothing"), ("a/own.py", "x\nReleased under the MIT License.\ny")]
    got = {r.path: (r.license, r.inherited_from) for r in op2_licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", None), "a/b/x.py": ("MIT", "a"), "a/c/LICENSE": ("Apache-2.0", None), "a/c/y.py": ("Apache-2.0", "a/c"), "z/q.py": (None, None), None: (None, None), "a/own.py": ("MIT", None)}


# ---------------------------------------------------------------- 3


def test_op2_weighs_words_by_their_document_frequency(spark):
    line = "Released under the MIT License by copyright see for"
    files = [(f"a/f{i}", f"see copyright {i} for by") for i in range(400)] + [("b/x", f"x\n{line}\ny"), ("c/x", None)]
    docs = [set(op2_licenses.words_of(text or "")) for _, text in files]
    idf = lambda w: math.log((len(docs) + 1) / (sum(w in d for d in docs) + 1)) + 1
    vector = lambda text: {w: c * idf(w) for w, c in Counter(op2_licenses.words_of(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a, b = vector(line), vector(op2_licenses.TEMPLATES["MIT"])
    wanted = sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)
    got = {r.path: (r.own_license, r.own_score) for r in op2_licenses.scan(spark.createDataFrame(files, "path string, text string")).collect() if r.own_license}
    assert got == {"b/x": ("MIT", pytest.approx(wanted, abs=1e-6))}


def test_op3(spark):
    long = "<p>" + "é" * 100
    pages = spark.createDataFrame([(5, "http://a b/", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)], "page_id long, url string, html string")
    got = {r.page_id: r for r in op3_warc.archive_pages(pages).collect()}
    raw = {5: long, 3: long, 9: long, 1: "short", 2: "short", 7: "", 8: "a\r\n\r\nWARC/1.1\r\n" * 20}
    for k, v in raw.items():
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(v.encode()), hashlib.sha256(v.encode()).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 7: ("response", None), 8: ("response", None)}
    assert op3_warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_op3_arc_lengths(version):
    data = op3_warc.arc_segment(version, [("http://x/", "1.2.3.4", "20050101000000", b"body\nwith\n\nlines"), ("http://y/", "1.2.3.4", "20050101000000", b"")])
    assert [(r["URL"], r["body"]) for r in op3_warc.parse_arc(data)][1:] == [("http://x/", b"body\nwith\n\nlines"), ("http://y/", b"")]
    with pytest.raises(ValueError, match="shorter"):
        list(op3_warc.parse_arc(data.replace(b" 16\n", b" 999\n")))


def test_op3_reads_archives_byte_for_byte(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(op3_warc, "FILE_BYTES", 500)
    latin = "é".encode("latin-1") * 120 + bytes(range(256))
    web = b"HTTP/1.1 200 OK\r\nX: \xe9\r\n\r\n" + latin
    records = [("http://x/", "1.2.3.4", "20050101000000", web), ("http://y/", "1.2.3.4", "20050102030405", b"no head " * 30), ("http://z/", "1.2.3.4", "20050102030405", b"no head " * 30), ("dns:x", "1.2.3.4", "20050101000000", b"x 1.2.3.4")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(op3_warc.arc_segment("1", records))
    (tmp_path / "in/b.arc.gz").write_bytes(gzip.compress(op3_warc.arc_segment("2", records[:1])))
    rows = op3_warc.read_arc(spark, str(tmp_path / "in"))
    assert sorted(r.kind for r in rows.collect()) == ["resource", "response", "response", "response", "response", "warcinfo", "warcinfo"]
    op3_warc.write_warc(rows, str(tmp_path / "out"))
    files = [f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*"))]
    seen = [(head, block) for f in files for head, block in op3_warc.parse_warc(gzip.decompress(f))]
    assert sorted(h["warc-type"] for h, _ in seen) == ["resource", "response", "response", "response", "revisit", "warcinfo", "warcinfo"]
    ids = {(h["warc-record-id"], h["warc-target-uri"]) for h, _ in seen if "warc-target-uri" in h}
    assert len(ids) == len({i for i, _ in ids}) == 4  # URLs of one payload and date have identifiers of their own
    again = next(h for h, _ in seen if h["warc-type"] == "revisit")
    assert (again["warc-target-uri"], again["warc-refers-to"]) == ("http://z/", next(i for i, u in ids if u == "http://y/"))
    blocks = {h["warc-target-uri"]: (h["content-type"], b) for h, b in seen if "warc-target-uri" in h}
    assert blocks["http://x/"] == ("application/http; msgtype=response", web) and blocks["dns:x"] == ("text/dns", b"x 1.2.3.4")
    assert all(len(f) < 2500 for f in files) and all(f.startswith(b"\x1f\x8b") for f in files)
    got = op3_warc.read_warc(spark, str(tmp_path / "out")).where("payload_bytes = 376").first()
    assert got.payload_digest == hashlib.sha256(latin).hexdigest()


def test_op3_rows_without_ids_and_repeated_ones(spark):
    big = "x" * 3_000_000
    pages = [(4, "u", big, 1), (4, "u", big, 1), (9, "u", big, 1), (None, "u", big, 1), (None, None, None, 1)]
    got = op3_warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string, digest int")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        ("4", 3_000_000, "response", None), ("4", 3_000_000, "response", None), ("9", 3_000_000, "revisit", 4), ("None", 0, "response", None), ("None", 3_000_000, "revisit", 4),
    ]


# ---------------------------------------------------------------- 4


def grams(text):
    w = tokens(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op4(docs, rows, empty):
    sets = [grams(t) for _, t, *_ in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if link[i][j])]) for i in range(n)]
    wanted = sorted((rows[i][0], min(rows[j][0] for j in range(n) if label[j] == label[i]), sum(link[i])) for i in range(n))
    assert sorted(map(tuple, op4_jaccard.jaccard_classes(docs).collect())) == wanted
    assert op4_jaccard.jaccard_classes(empty).count() == 0
    kept = [r.doc_id for r in op4_jaccard.keep_first(docs).collect()]
    assert sorted(kept) == sorted({w[1] for w in wanted})


def test_op4_bands():
    bands, width = op4_jaccard.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**width) ** bands >= 0.999


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100)


# ---------------------------------------------------------------- 5


def test_op5(docs, rows, empty):
    by = sorted(rows[:-1])
    got = {r.doc_id: r for r in op5_digest.fingerprints(docs.dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(by)
    for k, (i, text, *_) in enumerate(by):
        text, after = text or "", by[(k + 1) % len(by)][1] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i, text, *_ in by:
        assert same.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint
    assert op5_digest.fingerprints(empty).count() == 0


def test_op5_entropy():
    data = np.frombuffer(random.Random(2).randbytes(300) + b"a" * 100 + b"the quick brown fox " * 9, np.uint8)
    for at, step in enumerate(op5_digest.entropy_steps(data)):
        p = np.bincount(data[at : at + op5_digest.WINDOW]) / op5_digest.WINDOW
        p = p[p > 0]
        assert abs(step - op5_digest.STEPS * -(p * np.log2(p)).sum() / np.log2(op5_digest.WINDOW)) <= 1.01


# ---------------------------------------------------------------- 6


def test_op6_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 50)], "domain string, lang string, source string, cap long")
    got = {r.source: r.quota for r in op6_mixing.leaf_budgets(leaves, 400, {"a": 1.0, "b": 1.0}, {}, {}).collect()}
    assert got == {"s1": 10, "s2": 165, "s3": 175, "s4": 50}


def test_op6(docs, rows, empty):
    taken = op6_mixing.mix(docs).collect()
    total = sum(len(tokens(r[1])) for r in rows)
    assert abs(sum(r.tokens_taken for r in taken) - int(total * op6_mixing.SHARE)) <= len({r[3] for r in rows})
    assert all(0 < r.tokens_taken <= op6_mixing.EPOCHS * r.n_tokens for r in taken)
    assert op6_mixing.mix(empty).count() == 0
    assert set(op6_mixing.mixed_documents(docs).columns) == {*docs.columns, "mix_epochs", "mix_tokens"}


# ---------------------------------------------------------------- 7


def test_op7_marginals():
    rng = np.random.default_rng(3)
    row = np.repeat([0, 1, 2], [4, 1, 6])
    emit, step = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    good, z, _ = op7_quality.marginals(emit, row, step)
    total = 0.0
    for r in range(3):
        own = np.flatnonzero(row == r)
        weight = {}
        for bits in range(2 ** len(own)):
            y = [(bits >> k) & 1 for k in range(len(own))]
            weight[tuple(y)] = math.exp(sum(emit[i, a] for i, a in zip(own, y, strict=True)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += math.log(sum(weight.values()))
        for k, i in enumerate(own):
            assert math.isclose(good[i], sum(w for y, w in weight.items() if y[k]) / sum(weight.values()), rel_tol=1e-9)
    assert math.isclose(z, total, rel_tol=1e-9)


def test_op7(spark, empty):
    rng = random.Random(7)
    good = lambda: "\n".join(" ".join(rng.choices(WORDS, k=12)).capitalize() + "." for _ in range(5))
    bad = lambda: "\n".join("".join(rng.choices("#$%^&*0123456789 ", k=40)) for _ in range(5))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(900, None), (901, ""), (902, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op7_quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(200) if got[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert np.mean([got[i].predicted == i % 2 for i in held]) > 0.95
    assert op7_quality.quality_scores(empty, labels).count() == 0
    assert op7_quality.quality_scores(docs, labels.limit(0)).count() == len(rows)


# ---------------------------------------------------------------- 8


def test_op8(spark):
    calls = [("c1", 0, "a", "search", '{"words": 3, "text": "x"}', None), ("c1", 2, "b", "summarise", '{"text": "x", "words": "3"}', "a"), ("c1", 4, "c", "translate", "not json", "b"), ("c2", 0, "d", "other", "{}", "e"), ("c2", 2, "e", "search", None, "d")]
    calls = spark.createDataFrame([(*c, "clash", "clash") for c in calls], "conv_id string, turn long, call_id string, name string, arguments string, after string, id string, depth string")
    results = spark.createDataFrame([("c1", "a", 1, 'said "yes"'), ("c1", "z", 1, "no call"), ("c1", "a", 3, "later")], "conv_id string, call_id string, turn long, content string")
    got = {r.call_id: r for r in op8_toolcalls.link_calls(calls, results).collect()}
    assert {k: (r.depth, r.valid, r.errors, r.has_result) for k, r in got.items()} == {
        "a": (0, True, [], True), "b": (1, False, ["type:words"], False), "c": (2, False, ["not-json"], False), "d": (None, False, ["unknown-tool"], False), "e": (None, False, ["not-json"], False),
    }
    assert got["a"].json == '{"arguments":{"text":"x","words":3},"depth":0,"errors":[],"id":"a","name":"search","result":"said \\"yes\\"","valid":true}'
    assert op8_toolcalls.link_calls(calls.limit(0), results).count() == 0


def test_op8_keeps_conversations_and_every_call_apart(spark):
    text = "t" * 200_000
    calls = [
        ("c1", 0, "call_0", "search", '{"words": 3, "text": "x"}', None), ("c2", 0, "call_0", "search", '{"words": 3, "text": "x"}', None), (None, 0, "call_0", "search", "{}", None),
        ("c1", 2, "call_0", "search", '{"words": 4, "text": "y"}', None), ("c1", 2, "call_0", "search", '{"words": 4, "text": "y"}', None),
        ("c1", 4, None, "search", '{"words": 1, "text": "' + text + '"}', "call_0"), ("c1", 4, None, None, "", "gone"), ("c1", None, "n", "search", "[]", "call_0"),
    ]
    calls = spark.createDataFrame(calls, "conv_id string, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([("c1", "call_0", 1, "one"), ("c2", "call_0", 1, None), ("c1", None, 1, "none")], "conv_id string, call_id string, turn long, content string")
    got = op8_toolcalls.link_calls(calls, results).collect()
    seen = sorted((str(r.conv_id), str(r.turn), str(r.call_id), r.depth, r.has_result) for r in got)
    assert seen == [
        ("None", "0", "call_0", 0, False), ("c1", "0", "call_0", 0, True), ("c1", "2", "call_0", 0, True), ("c1", "2", "call_0", 0, True), ("c1", "4", "None", 0, False), ("c1", "4", "None", 1, False),
        ("c1", "None", "n", 1, False), ("c2", "0", "call_0", 0, True),
    ]
    assert max(len(r.json) for r in got) > 200_000


# ---------------------------------------------------------------- 9


def test_op9_suffix_array():
    for alphabet in (2, 4, 200):
        t = np.concatenate([np.random.default_rng(alphabet).integers(1, alphabet, 400), [0]])
        sa = op9_suffix.suffix_array(t)
        raw = [tuple(t[i:]) for i in range(len(t))]
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i])
        common = op9_suffix.permuted_prefixes(t, sa)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            k = 0
            while raw[a][k : k + 1] and raw[a][k : k + 1] == raw[b][k : k + 1]:
                k += 1
            assert common[b] == k


def test_op9_suffix_array_of_contexts():
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.integers(2, 5, 60), np.arange(40, 2, -1), np.full(30, 7), rng.integers(2, 250, 40)])
    parts = [base[a : a + rng.integers(20, 90)] for a in rng.integers(0, 140, 40)] + [base, base, base[3:]]
    t = np.concatenate([x for p in parts for x in (p, [1])] + [[0]])
    ends = np.flatnonzero(t == 1)
    each = t.astype(float)  # every end differs; the last one, before the 0, is the least
    each[ends] = 1 + np.where(ends == ends[-1], 0, np.arange(1, len(ends) + 1)) / len(t)
    raw = [tuple(each[i:]) for i in range(len(t))]
    sa = op9_suffix.suffix_array(t, 1)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i])
    common = op9_suffix.permuted_prefixes(t, sa, 1)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        assert common[b] == next(k for k in range(len(t)) if raw[a][k : k + 1] != raw[b][k : k + 1])


def test_op9_each_string_has_one_context():
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=n)).encode() for n in (0, 5, 300, 40)] + [b"ab" * 120, b"-" * 500, b"x" * 100, b"y" * 99]
    texts.append(b"head " + texts[2][200:900] + b" tail")
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found: dict = {}
    for of, place, h, _, start, end in zip(*op9_suffix.anchors(data, at), strict=True):
        assert start <= place <= place + op9_suffix.K <= end <= len(texts[of])
        for s in range(start, end - 99):
            found.setdefault(texts[of][s : s + 100], []).append((of, s, h, place - s))
    assert sorted(x[:2] for own in found.values() for x in own) == [(i, s) for i, x in enumerate(texts) for s in range(len(x) - 99)]
    assert all(len({x[2:] for x in own}) == 1 for own in found.values())  # equal strings meet, at the same place


def test_op9_shards_of_lone_and_equal_contexts():
    def ranges(*rows):
        table = pa.table(dict(zip(("shard", "doc", "tie", "start", "bytes"), map(list, zip(*rows, strict=True)), strict=True)))
        return [tuple(r[c] for c in ("doc", "tie", "start", "stop")) for b in op9_suffix._shards(table) for r in b.to_pylist()]

    text = bytes(range(32, 126)) * 2
    assert ranges((1, 8, 5, 0, text[:120]), (2, 9, 5, 0, text[:120])) == []
    assert ranges((1, 8, 5, 0, text[:120]), (1, 9, 5, 0, text[30:150])) == []
    assert ranges((1, 9, 5, 7, text[:120]), (1, 8, 5, 40, text[15:150]), (1, 8, 4, 0, text[90:])) == [(9, 5, 22, 127)]


def in_order(df):
    """(doc_id, text) as repeats count them: by id, a null one last, then by a hash of the text."""
    rows = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as tie").collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))]


def removals(ordered):
    """For each text, which of its bytes go."""
    seen = set()
    for _, text in ordered:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                gone[a : a + 100] = True
            seen.add(raw[a : a + 100])
        yield raw, gone


def digest_rows(df):
    out = []
    for (i, _), (raw, gone) in zip(ordered := in_order(df), removals(ordered), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((str(i), len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_op9(docs, rows, empty):
    got = [(str(r[0]), *r[1:]) for r in map(tuple, op9_suffix.removal_digests(docs).collect())]
    assert sorted(got) == digest_rows(docs)
    assert op9_suffix.removal_digests(empty).count() == 0
    assert op9_suffix.remove_repeats(docs).columns == docs.columns


def test_op9_copies_of_a_row_keep_the_first(spark):
    t, u = "".join(f"a{i} " for i in range(40)), "short text"
    for ids in ((1, 1, 2), (None, None, 2), (1, 1, None)):
        rows = [(ids[0], t), (ids[1], t), (ids[2], "other " + u), (ids[0], u), (ids[0], u), (ids[0], None), (ids[0], t + "more of it")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((str(r[0]), *r[1:]) for r in map(tuple, op9_suffix.removal_digests(docs).collect())) == digest_rows(docs)
        kept = sorted((str(r.doc_id), r.text or "") for r in op9_suffix.remove_repeats(docs).collect())
        ordered = in_order(docs)
        left = [(str(i), bytes(np.frombuffer(raw, np.uint8)[~gone]).decode()) for (i, _), (raw, gone) in zip(ordered, removals(ordered), strict=True) if not raw or not gone.all()]
        assert kept == sorted(left) and sum(x[1].startswith(t[:50]) for x in kept) == 1


def test_op9_hot_anchors_are_split(spark):
    rng = random.Random(8)
    passage = " ".join(rng.choices(WORDS, k=40))
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) + passage[rng.randrange(60) :] + " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(50)]
    rows += [rows[4], rows[4], (None, rows[5][1]), (None, rows[5][1] + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, op9_suffix.removal_digests(docs, 3).collect())) == digest_rows(docs)
    found = op9_suffix._identified(docs).select("doc", "tie", "text").mapInArrow(op9_suffix._find, op9_suffix._FOUND)
    met = found.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "tie", "place").mapInArrow(op9_suffix._meet(3), op9_suffix._FOUND)
    assert met.where("kind = 3").count() > 50


# ---------------------------------------------------------------- 10


def _least_edits(item, text):
    """Fewest edits that turn the item into some substring of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("block", [op10_decontaminate.BLOCK, 400])
def test_op10_against_the_plain_table(spark, monkeypatch, block):
    monkeypatch.setattr(op10_decontaminate, "BLOCK", block)
    rng = random.Random(11)
    letters = "abcdefghij"
    common = "the question shared by every item is "
    items = [common + "".join(rng.choices(letters, k=rng.randint(5, 90))) for _ in range(12)] + ["".join(rng.choices(letters, k=k)) for k in (11, 12, 24, 40)]
    rows = []
    for n in range(150):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 7)):  # substitutions, insertions and deletions, at the ends too
            at = rng.choice([0, len(item) - 1, rng.randrange(len(item))]) if item else 0
            kind = rng.randrange(3)
            item[at : at + (kind != 1)] = [rng.choice(letters)] if kind < 2 else []
        around = ["".join(rng.choices(letters, k=rng.choice([0, 0, 3, 60]))) for _ in range(2)]
        rows.append((n, around[0] + "".join(item) + around[1] + (common if n % 7 == 0 else "")))
    benchmark = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __matches long").repartition(2)
    got = {r.doc_id: r for r in op10_decontaminate.contamination(docs, benchmark).collect()}
    plain = lambda t: t.replace(" ", "")
    hits = 0
    for i, text in rows:
        wanted = {}
        for k, item in enumerate(items):
            own = plain(item)
            if len(own) >= op10_decontaminate.Q:
                budget = min(int(len(own) * op10_decontaminate.RATE), (len(own) - op10_decontaminate.Q) // op10_decontaminate.Q)
                least = _least_edits(own, plain(text))
                if least <= budget:
                    wanted[None if k == 3 else k] = least
        hits += len(wanted)
        assert set(got[i].item_ids) == set(wanted), (i, text)
        assert got[i].least_edits == (min(wanted.values()) if wanted else None)
    assert hits > 60


def test_op10(spark, docs, empty):
    rng = random.Random(4)
    items = [" ".join(rng.choices(WORDS, k=30)) for _ in range(6)]
    noisy = items[1].replace("word1 ", "Word1, ", 1)
    typo = items[2][:60] + "Z" + items[2][61:]
    rows = [(1, "before " + items[0].upper() + " after"), (2, "x " + noisy), (3, typo + " y"), (4, " ".join(rng.choices(WORDS, k=200))), (5, None), (6, ""), (7, items[3][: len(items[3]) // 2])]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, None), (77, "")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.least_edits) for r in op10_decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {1: (True, [0], 0), 2: (True, [1], 0), 3: (True, [2], 1), **{i: (False, [], None) for i in (4, 5, 6, 7)}}
    assert op10_decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert op10_decontaminate.contamination(empty, benchmark).count() == 0


def test_op10_alignment_is_the_edit_distance():
    rng = random.Random(9)
    item = "".join(rng.choices("abcdefgh", k=120))
    index = op10_decontaminate.Index([1], [item])
    for edits in range(5):
        text = list(item)
        for _ in range(edits):
            text[rng.randrange(len(text))] = "z"
        body = "".join(text)
        data, at = op10_decontaminate.utf8(pa.array(["q" * 50 + body + "q" * 50]))
        found = op10_decontaminate.find(index, data, at)
        assert len(found[0]) == 1 and found[4][0] == sum(a != b for a, b in zip(item, body, strict=True))


def substring_edits(item, text):
    """Fewest edits that turn item into any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_op10_alignment_stays_within_its_document():
    rng = random.Random(7)
    items = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (40, 100, 100)]
    index = op10_decontaminate.Index(range(3), items)
    for item, e in zip(items, index.edits, strict=True):
        for cut in range(int(e) + 2):
            for body in (item[cut:], item[: len(item) - cut], item[cut:] + " more text after", "some text before " + item[: len(item) - cut]):
                texts = [body, "end" + item[:cut], body, item[len(item) - cut :] + "start", body]
                data, at = op10_decontaminate.utf8(pa.array(texts))
                together = [x[1:] for x in zip(*op10_decontaminate.find(index, data, at)) if x[0] in (0, 2, 4)]
                alone = list(zip(*op10_decontaminate.find(index, data[: at[1]], at[:2])))
                least = substring_edits(item, body.replace(" ", ""))
                assert [int(x[4]) for x in alone] == ([least] if least <= e else []), (cut, body)
                assert together == [x[1:] for x in alone] * 3, (cut, body)
