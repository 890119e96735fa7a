"""Fingerprints and likeness against a plain version, window by window and bit by bit."""

import base64
import hashlib
import random
from collections import Counter, defaultdict
from math import log2

import numpy as np

from tidemark.llm import op5_digest as op5
from tidemark.llm.common import prefix_hash, span_hash


def entropy_step(window):
    total = sum(round(c * log2(c) * 65536) for c in Counter(window).values())
    return min(int((log2(op5.WINDOW) - total / (op5.WINDOW * 65536)) * (op5.STEPS / log2(op5.WINDOW))), op5.STEPS)


def steps_of(raw):
    return [entropy_step(raw[i : i + op5.WINDOW]) for i in range(len(raw) - op5.WINDOW + 1)]


def plain_features(raw, rank):
    steps, chosen = [rank[s] for s in steps_of(raw)], []
    votes = Counter()
    for i in range(len(steps) - op5.RIVALS + 1):
        r, at = min((r, i + k) for k, r in enumerate(steps[i : i + op5.RIVALS]))
        if r < op5._UNUSED:
            votes[at] += 1
    chosen = sorted(at for at, n in votes.items() if n >= op5.VOTES)
    if steps and not chosen:
        chosen = [min(range(len(steps)), key=lambda i: (steps[i], i))]
    found = [raw[i : i + op5.WINDOW] for i in chosen]
    if raw and len(raw) < op5.SHORT:
        found += [raw[i : i + op5.GRAM] for i in range(max(1, len(raw) - op5.GRAM + 1))]
    return list(dict.fromkeys(found))


def chain(raw, rank):
    """(features, set of bits) of each filter."""
    out = []
    found = plain_features(raw, rank)
    for a in range(0, len(found), op5.FULL):
        bits = set()
        for x in found[a : a + op5.FULL]:
            data = np.frombuffer(x, np.uint8)
            h = int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])
            bits |= {(h >> (11 * i)) & (op5.BITS - 1) for i in range(op5.HASHES)}
        out.append((len(found[a : a + op5.FULL]), bits))
    return out


def text_of(filters):
    raw = b""
    for n, bits in filters:
        flags = bytearray(op5.BITS // 8)
        for b in bits:
            flags[b // 8] |= 128 >> (b % 8)
        raw += n.to_bytes(2, "big") + bytes(flags)
    return base64.b64encode(raw).decode()


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (len(b), sum(n for n, _ in b)) < (len(a), sum(n for n, _ in a)):
        a, b = b, a
    total = 0.0
    for n, own in a:
        best = 0.0
        for _, other in b:
            most, chance = min(len(own), len(other)), len(own) * len(other) / op5.BITS
            floor = chance + op5.CUT * (most - chance)
            best = max(best, min(max((len(own & other) - floor) / max(most - floor, 1e-9), 0), 1))
        total += best * n
    return total / sum(n for n, _ in a)


def test_digests_against_the_plain_version(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 3, 30, 90, 200, 500, 900, 1500)] + ["", None, "aaaa" * 60, "short", "short"]
    texts.append(texts[5] + " tail")
    docs = spark.createDataFrame([(i * 3, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint long").repartition(3)
    total = Counter(s for t in texts for s in steps_of((t or "").encode()))
    rank = {s: r for r, (_, s) in enumerate(sorted((total[s], s) for s in range(op5.STEPS + 1)))}
    rank |= {s: op5._UNUSED for s in range(op5.STEPS + 1) if not op5.USABLE[0] <= s < op5.USABLE[1]}
    chains = [chain((t or "").encode(), rank) for t in texts]
    got = {r.doc_id: r for r in op5.fingerprints(docs).collect()}
    assert len(got) == len(texts) and max(map(len, chains)) > 1
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        own, after = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut] if cut else own
        r, other = got[i * 3], chain(edited.encode(), rank)
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == text_of(chains[i]) and r.edited_fingerprint == text_of(other)
        assert abs(r.near_edited - alike(chains[i], other)) < 1e-9
        assert abs(r.near_next - alike(chains[i], chains[(i + 1) % len(texts)])) < 1e-9
        seen[own].append(r.fingerprint)
    assert all(len(set(v)) == 1 for v in seen.values())
