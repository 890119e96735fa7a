"""Pairs and terms against a plain version in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from tidemark.llm import op13_divergence as op13

SCHEMA = "doc_id long, text string, lang string, source string, rank int, item string, total long"


def plain(rows, least, top, scale):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in within.items() if n >= least}
        by = defaultdict(Counter)
        for _, source, terms in own:
            by[source].update(t for t in terms if t in kept)
            by[None].update(t for t in terms if t in kept)

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + scale * (c[t] + 1) // (total + len(kept)) for t in kept}

        share = {s: shares(c) for s, c in by.items()}
        for s in by.keys() - {None}:
            found = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in by.keys() - {None, s}]
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
            found = [((share[s][t] - share[None][t]) ** 2 // share[None][t], t) for t in kept if by[s][t] and share[s][t] > share[None][t]]
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def test_a_task_hands_on_what_it_has_counted(monkeypatch):
    monkeypatch.setattr(op13, "HELD", 8)
    monkeypatch.setattr(op13, "TEXT", 60)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "B", "cé", "d1e"], k=rng.randint(0, 20))) for _ in range(50)] + [None]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 51, "source": [f"s{i % 2}" for i in range(51)], "text": texts})
    counts, documents, batches = Counter(), Counter(), 0
    for out in op13._count(iter([batch, batch.slice(3, 0), batch])):
        batches += 1
        for r in out.to_pylist():
            counts[r["source"], r["term"]] += r["n"]
            documents[r["source"], r["term"]] += r["d"]
    wanted, within = Counter(), Counter()
    for i, text in enumerate(texts * 2):
        terms = re.findall("[a-zé]+", (text or "").lower())
        wanted.update((f"s{i % 51 % 2}", t) for t in terms)
        within.update((f"s{i % 51 % 2}", t) for t in set(terms))
    assert counts == wanted and documents == within and batches > 2


def test_against_the_plain_version(spark):
    rng = random.Random(2)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Été", "été", "straße", "日本", "x"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words[: rng.choice([5, 40, 85])]) + rng.choice([" ", "\n", "7", "_", "\t\x00", "--"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "a", "b", "é", None]), 1, "clash", 2))
    rows += [rows[3]] * 4 + [(900, None, "en", "none", 1, "", 0), (901, "", "xx", "only", 1, "", 0), (902, "1234", "yy", "p", 1, "", 0), (903, "rare", "yy", "q", 1, "", 0), (None, "Wa " * 5000, "en", "long", 1, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, top in ((3, 200), (1, 4)):
        assert sorted(map(tuple, op13.divergence(docs, least, top).collect())) == plain(rows, least, top, op13.SCALE)
    assert op13.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_rank_by_bytes(spark):
    rows = [(i, t, "en", s, 1, "", 0) for i, (t, s) in enumerate([("b a é z", "p"), ("b a é z", "p"), ("b a é z", "p"), ("k", "q"), ("k", "q"), ("k", "q"), ("", "r"), ("", "s")])]
    got = op13.divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 200, op13.SCALE)
    assert [r.item for r in sorted((r for r in got if r.source == "p" and r.part == "term"), key=lambda r: r.rank)] == ["a", "b", "z", "é"]
