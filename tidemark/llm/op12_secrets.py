"""Secrets in texts: spans of fixed patterns, and spans that a linear-chain conditional random field over tokens adds to them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, pieces, prefix_hash, span_hash, utf8

#: Documents that training reads at most, tokens around a pattern's span and of a document without one that it keeps, and one in so many of those.
SAMPLE_DOCUMENTS, AROUND, PLAIN, PLAIN_EVERY = 20_000, 12, 64, 64
#: Code points of the shortest span that the model adds.
SHORTEST = 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
_WORDS = ("password", "passwd", "secret", "token", "api")

# ---------------------------------------------------------------- patterns

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True


def _long_hex(data: np.ndarray, at: np.ndarray, least: int = 32) -> np.ndarray:
    """The rows that may have a run of so many hexadecimal digits."""
    edge = np.diff(np.concatenate([[0], _IS_HEX[data].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = start[end - start >= least]
    return np.unique(np.searchsorted(at, long, "right") - 1)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of every pattern's matches, by start and then kind, in code points.

    Matches of a kind don't overlap; those too short are taken away after that, so they hide what begins within them.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in re.finditer("[0-9a-f]{32,}", text)]  # a run is whole or not at all
    return sorted(found)


# ---------------------------------------------------------------- tokens and features

# Classes of bytes in tokens: letters, digits, marks of keys, and bytes of other letters; others part tokens.
_BIT = np.zeros(256, np.uint8)
_BIT[97:123], _BIT[65:91], _BIT[48:58], _BIT[[43, 45, 47, 95]], _BIT[128:] = 1, 2, 4, 8, 16
# What all bytes of a token can be: lower-case hexadecimal, upper-case letters or digits, digits.
_ALL = np.zeros(256, np.uint8)
_ALL[[*range(48, 58), *range(97, 103)]] |= 1
_ALL[[*range(48, 58), *range(65, 91)]] |= 2
_ALL[48:58] |= 4
_VOWEL = np.zeros(256, np.uint8)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1
# What lies between tokens: assignment, quote, line end, space, other marks.
_GAP = np.zeros(256, np.uint8)
_GAP[[58, 61]], _GAP[[34, 39, 96]], _GAP[[10, 13]], _GAP[[9, 32]] = 1, 2, 4, 8
_GAP[(_BIT == 0) & (_GAP == 0)] = 16
_LENGTHS = np.array([4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64])

#: Values that each feature takes: those of a token itself, of its neighbours, and of its file.
_VALUES = {
    "shape": 13 * 32, "changes": 7 * 4, "all": 8, "head": 1024, "vowels": 5 * 4, "digits": 6 * 4,
    "gap_before": 32, "gap_after": 32, "before": 2048, "two_before": 512, "after": 512, "shape_before": 13 * 32 + 1, "shape_after": 13 * 32 + 1, "file": 16,
}
_AT = np.concatenate([[0], np.cumsum([*_VALUES.values()])])
WIDTH = int(_AT[-1])
#: Features that a hidden copy of a training window lacks.
_HIDDEN = [[*_VALUES].index(k) for k in ("gap_before", "gap_after", "before", "two_before", "after")]


class Tokens:
    """Tokens of some rows of bytes, and their features as places in one table of weights."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at, bit = at, _BIT[data]
        ink = bit > 0
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        self.start = np.flatnonzero(ink & (first[:-1] | ~np.concatenate([[False], ink[:-1]])[: len(ink)]))
        self.end = np.flatnonzero(ink & (first[1:] | ~np.concatenate([ink[1:], [False]])[: len(ink)])) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.n = len(self.start)
        self.ids = self._features(data, bit) if self.n else np.zeros((0, len(_VALUES)), np.int64)

    def _features(self, data: np.ndarray, bit: np.ndarray) -> np.ndarray:
        n, at, row, start, end = self.n, self.at, self.row, self.start, self.end
        span = np.stack([start, end], 1).ravel()[: 2 * n - (end[-1] == len(data))]
        over = lambda f, x, **k: f.reduceat(x, span, **k)[::2]
        length = end - start
        coarse = np.searchsorted([8, 16, 32], length, "right")
        changed = np.concatenate([[0], bit[1:] != bit[:-1]]).astype(np.uint8)
        changes = over(np.add, changed, dtype=np.int32) - changed[start]
        vowels, digits = over(np.add, _VOWEL[data], dtype=np.int32) / length, over(np.add, bit == 4, dtype=np.int32) / length
        shape = np.searchsorted(_LENGTHS, length, "right") * 32 + over(np.bitwise_or, bit)
        head = np.zeros(n, np.int64)
        long = np.flatnonzero(length >= 8)
        if len(long):
            key = sum(data[start[long] + k].astype(np.int64) << (8 * k) for k in range(4))
            head[long] = 1 + (key * 2654435761 >> 7) % 1023

        opens = np.concatenate([[True], row[1:] != row[:-1]])
        closes = np.concatenate([opens[1:], [True]])
        marks = _GAP[data]
        between = np.bitwise_or.reduceat(marks, span)[1::2]
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:], after[: len(between)] = between[: n - 1], between
        for k in np.flatnonzero(opens):
            before[k] = np.bitwise_or.reduce(marks[at[row[k]] : start[k]])
        for k in np.flatnonzero(closes):
            after[k] = np.bitwise_or.reduce(marks[end[k] : at[row[k] + 1]])

        word = span_hash(prefix_hash(lowered(data)), start, end)
        lag = lambda x, k, none: np.concatenate([np.full(k, none), x[:-k]])[:n] if k > 0 else np.concatenate([x[-k:], np.full(-k, none)])[-n:]
        neighbour = lambda k, x, none: np.where(lag(row, k, -1) == row, lag(x, k, none), none)
        bucket = lambda k, size: neighbour(k, 1 + (word % np.uint64(size - 1)).astype(np.int64), 0)
        file = np.array([self._file(bit, marks, r) for r in row[opens].tolist()], np.int64)[np.cumsum(opens) - 1]
        columns = [
            shape, np.searchsorted([1, 2, 3, 4, 6, 9], changes, "right") * 4 + coarse, over(np.bitwise_and, _ALL[data]), head,
            np.searchsorted([0.05, 0.2, 0.35, 0.5], vowels, "right") * 4 + coarse, np.searchsorted([0.01, 0.1, 0.25, 0.5, 0.9], digits, "right") * 4 + coarse,
            before, after, bucket(1, _VALUES["before"]), bucket(2, _VALUES["two_before"]), bucket(-1, _VALUES["after"]), neighbour(1, shape, 13 * 32), neighbour(-1, shape, 13 * 32), file,
        ]
        return np.stack(columns, 1) + _AT[:-1]

    def _file(self, bit: np.ndarray, marks: np.ndarray, row: int) -> int:
        """Shares of digits and of assignments and quotes in the whole text, in steps."""
        a, b = self.at[row], self.at[row + 1]
        digits, signs = np.count_nonzero(bit[a:b] == 4) / (b - a), np.count_nonzero(marks[a:b] & 3) / (b - a)
        return int(np.searchsorted([0.003, 0.02, 0.1], digits, "right") * 4 + np.searchsorted([0.0005, 0.004, 0.02], signs, "right"))


# ---------------------------------------------------------------- the field

#: States: outside, begin, inside.
STATES = 3


def _side_by_side(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and length of each run of equal numbers, longest first, and how many are as long as each step."""
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    size = np.diff(np.concatenate([first, [len(chain)]]))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], np.searchsorted(-size[order], -np.arange(1, size.max() + 1), "right")


def viterbi(emit: np.ndarray, chain: np.ndarray, step: np.ndarray, lead: np.ndarray | None = None, tail: np.ndarray | None = None) -> np.ndarray:
    """The best states of each chain. lead, tail: what each state adds at the ends of a chain, a row for each place (only ends count)."""
    n = len(chain)
    if not n:
        return np.zeros(0, np.int64)
    first, size, active = _side_by_side(chain)
    best, back = emit.copy(), np.zeros((n, STATES), np.int8)
    if lead is not None:
        best[first] += lead[first]
    for t in range(1, size[0]):
        i = first[: active[t]] + t
        through = best[i - 1][:, :, None] + step
        back[i] = through.argmax(1)
        best[i] = through.max(1) + emit[i]
    out = np.zeros(n, np.int64)
    end = first + size - 1
    out[end] = (best[end] + (tail[end] if tail is not None else 0)).argmax(1)
    for t in range(size[0] - 1, 0, -1):
        i = first[: active[t]] + t
        out[i - 1] = back[i, out[i]]
    return out


def expectations(emit: np.ndarray, chain: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """P(state) of each place, the sum of the chains' log normalisers, and expected counts of transitions."""
    first, size, active = _side_by_side(chain)
    n, top = len(chain), lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    fwd, bwd = emit.copy(), np.zeros((n, STATES))
    for t in range(1, size[0]):
        i = first[: active[t]] + t
        fwd[i] = top(fwd[i - 1][:, :, None] + step, 1) + emit[i]
    for t in range(size[0] - 2, -1, -1):
        i = first[: active[t + 1]] + t
        bwd[i] = top(step + (bwd[i + 1] + emit[i + 1])[:, None, :], 2)
    z = top(fwd + bwd, 1)
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    pair = fwd[inner][:, :, None] + step + (emit[inner + 1] + bwd[inner + 1])[:, None, :] - z[inner][:, None, None]
    return np.exp(fwd + bwd - z[:, None]), float(z[first].sum()), np.exp(pair).sum(0)


def fit(ids: np.ndarray, chain: np.ndarray, state: np.ndarray, rounds: int = 100) -> dict:
    """Weights by Adam on the conditional log-likelihood, states of patterns' spans as labels. Every chain comes twice, the second time with its
    neighbouring words hidden, so that shapes count on their own. Without a span nothing is ever tagged."""
    weights, step = np.zeros((WIDTH, STATES)), np.zeros((STATES, STATES))
    if not len(ids) or not (state > 0).any():
        weights[_AT[0] : _AT[1], 0] = 1.0
        return {"weights": weights, "step": step}
    hidden = ids.copy()
    hidden[:, _HIDDEN] = _AT[_HIDDEN]
    ids, chain, state = np.concatenate([ids, hidden]), np.concatenate([chain, chain + chain.max() + 1]), np.concatenate([state, state])
    n = len(ids)
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    seen = np.zeros((STATES, STATES))
    np.add.at(seen, (state[inner], state[inner + 1]), 1)
    flat, count = ids.ravel(), ids.shape[1]
    spread = lambda x: np.stack([np.bincount(flat, np.repeat(x[:, s], count), WIDTH) for s in range(STATES)], 1)
    wanted = np.eye(STATES)[state]
    p, m, v = np.zeros(WIDTH * STATES + STATES**2), 0.0, 0.0
    scale = 1.0 / max(1, int((state > 0).sum()))  # as many outside tokens as there are don't drown the few others
    for t in range(1, rounds + 1):
        weights, step = p[: WIDTH * STATES].reshape(WIDTH, STATES), p[WIDTH * STATES :].reshape(STATES, STATES)
        got, _, pairs = expectations(weights[ids].sum(1), chain, step)
        slope = np.concatenate([spread(got - wanted).ravel(), (pairs - seen).ravel()]) * scale + 2e-4 * p
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return {"weights": p[: WIDTH * STATES].reshape(WIDTH, STATES), "step": p[WIDTH * STATES :].reshape(STATES, STATES), "tokens": n}


def decode(tokens: Tokens, model: dict) -> np.ndarray:
    """The best states of all tokens, each row a chain: exactly Viterbi's, with less work.

    A token whose emission prefers `outside` by more than any change of its two transitions can make up is outside on the best path; what is
    still open is decoded in runs between such tokens.
    """
    step = model["step"]
    out = np.zeros(tokens.n, np.int64)
    if not tokens.n:
        return out
    over = model["weights"][:, 1:] - model["weights"][:, :1]  # only differences from `outside` matter
    emit = over[tokens.ids[:, 0]]
    for k in range(1, tokens.ids.shape[1]):
        emit += over[tokens.ids[:, k]]
    ends = np.concatenate([step, np.zeros((1, STATES))]), np.concatenate([step, np.zeros((STATES, 1))], 1)  # an end of a row adds nothing
    gain = float((ends[0][:, 1:] - ends[0][:, :1]).max() + (ends[1][1:, :] - ends[1][:1, :]).max())
    open_ = np.flatnonzero(emit.max(1) + gain + 1e-9 >= 0)
    if not len(open_):
        return out
    row = tokens.row[open_]
    new = np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (row[1:] != row[:-1])])
    inside_before = (open_ > 0) & (tokens.row[np.maximum(open_ - 1, 0)] == row)
    inside_after = (open_ + 1 < tokens.n) & (tokens.row[np.minimum(open_ + 1, tokens.n - 1)] == row)
    emit = np.concatenate([np.zeros((len(open_), 1)), emit[open_]], 1)
    out[open_] = viterbi(emit, np.cumsum(new), step, inside_before[:, None] * step[0], inside_after[:, None] * step[:, 0])
    return out


def _tagged(tokens: Tokens, state: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first byte, end) of each run that begins with a begin, or with an inside after an outside."""
    on = np.flatnonzero(state > 0)
    if not len(on):
        return []
    new = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (state[on[1:]] == 1) | (tokens.row[on[1:]] != tokens.row[on[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(on)]]) - 1
    return list(zip(tokens.row[on[first]].tolist(), tokens.start[on[first]].tolist(), tokens.end[on[last]].tolist(), strict=True))


# ---------------------------------------------------------------- training rows


def _states(tokens: Tokens, row: int, text: str, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The row's tokens, and their states by the patterns' spans."""
    own = np.flatnonzero(tokens.row == row)
    state = np.zeros(len(own), np.int64)
    for _, _, end, secret in sorted(spans, key=lambda s: (s[3], -s[2])):
        a = tokens.at[row] + len(text[:secret].encode())
        b = a + len(text[secret:end].encode())
        inside = np.flatnonzero((tokens.start[own] < b) & (tokens.end[own] > a))
        if len(inside) and not state[inside].any():
            state[inside], state[inside[0]] = 2, 1
    return own, state


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and states of the tokens around spans, and of some of the documents without one."""
    for batch in batches:
        data, at = utf8(batch["text"])
        for i, j in pieces(at):
            tokens = Tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
            rows = []
            for r, text in enumerate(batch["text"].slice(i, j - i).to_pylist()):
                text = text or ""
                spans, pick = base_spans(text), zlib.crc32(text.encode())
                if not spans and pick % PLAIN_EVERY:
                    continue
                own, state = _states(tokens, r, text, spans)
                if not len(own):
                    continue
                if spans:
                    near = np.zeros(len(own), bool)
                    for k in np.flatnonzero(state):
                        near[max(0, k - AROUND) : k + AROUND + 1] = True
                else:
                    a = pick // PLAIN_EVERY % max(1, len(own) - PLAIN)
                    near = (np.arange(len(own)) >= a) & (np.arange(len(own)) < a + PLAIN)
                own, state = own[near], state[near]
                for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own) != 1) + 1):
                    rows.append((tokens.ids[own[part]].astype("<i4").tobytes(), state[part].astype(np.int8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["ids", "state"])


def train(docs: DataFrame) -> dict:
    """The model of a sample: of the SAMPLE_DOCUMENTS ids that are first by a hash, one text each (of several the first by a hash). Rows without an id
    aren't learned from. Only windows of the sample come to the driver."""
    ids = docs.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    cut = ids.agg(F.max("h")).first()[0]
    if cut is None:
        return fit(np.zeros((0, len(_VALUES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sample = docs.where((F.xxhash64("doc_id") <= F.lit(cut)) & F.col("doc_id").isNotNull())
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")
    rows = sorted((bytes(r.ids), bytes(r.state)) for r in sample.mapInArrow(_windows, "ids binary, state binary").distinct().collect())
    if not rows:
        return fit(np.zeros((0, len(_VALUES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    state = np.concatenate([np.frombuffer(s, np.int8) for _, s in rows]).astype(np.int64)
    chain = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows])
    return fit(np.frombuffer(b"".join(i for i, _ in rows), "<i4").reshape(-1, len(_VALUES)).astype(np.int64), chain, state)


# ---------------------------------------------------------------- documents


def secrets_of(texts: pa.Array, model: dict) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of every span of each text, by start and kind, in code points. Spans of the model that meet a pattern's are left out."""
    out = []
    data, at = utf8(texts)
    for i, j in pieces(at):
        own, base = data[at[i] : at[j]], at[i : j + 1] - at[i]
        tokens = Tokens(own, base)
        more: dict[int, list[tuple[int, int]]] = {}
        for r, a, b in _tagged(tokens, decode(tokens, model)):
            more.setdefault(r, []).append((a - int(base[r]), b - int(base[r])))
        hexed = set(_long_hex(own, base).tolist())
        for r, text in enumerate(texts.slice(i, j - i).to_pylist()):
            text = text or ""
            low = text.lower()
            spans = [(a, k, b) for a, k, b, _ in base_spans(text)] if r in hexed or "AKIA" in text or any(w in low for w in _WORDS) else []
            if r in more:
                place = np.concatenate([[0], np.cumsum((own[base[r] : base[r + 1]] & 0xC0) != 0x80)])  # code points before each byte
                for a, b in more[r]:
                    a, b = int(place[a]), int(place[b])
                    if b - a >= SHORTEST and not any(x < b and a < y for x, k, y in spans if k < 3):
                        spans.append((a, 3, b))
            out.append(sorted(spans))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_crf of each row.

    spans: kind:start:end of every span by start and then kind, in code points, the end exclusive; an assignment's span is that of the whole match.
    Null and empty texts have none; repeated rows give repeated results; a null doc_id is scanned like any other. The model is that of
    train(); of an empty table there are no rows. Other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = secrets_of(batch["text"], model)
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(len(KINDS))]
            sums = [hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest() for spans in found]
            columns = [batch["doc_id"], *counts[:3], pa.array(sums, pa.string()), pa.array([_joined(s) for s in found], pa.string()), counts[3]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
