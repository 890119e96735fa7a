"""Removal of repeated byte strings by suffix arrays of shards, built by induced sorting.

A byte goes if a string of LENGTH bytes covers it that also starts earlier in the input. Two equal strings of
LENGTH bytes contain the same least hash of K-byte windows, at the same place: their anchor. So the occurrences
that an anchor has, each with the bytes of the strings whose anchor it is (its context), hold every repeat, and
each string once.

1. Each task finds the anchors of its documents and keeps the first of equal contexts; later ones are repeats whole.
2. Contexts meet by anchor; again the first of equal ones stays. Anchors with different contexts need sorting.
3. Those contexts are cut from the texts and dealt to shards by anchor. A shard's suffix array is induced, its
   permuted common prefixes computed, and runs of LENGTH or more in common show which strings start earlier.
4. The repeated ranges meet their document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, pieces, prefix_hash, span_hash, unused, utf8, whole_groups, window_hash, window_min, written

LENGTH, K = 100, 32
SIDE = LENGTH - K
#: Anchors that a task holds before it drops local repeats, bytes of a shard, and contexts of one anchor beyond
#: which they're split further by the bytes around it.
HELD, SHARD, HOT = 1_000_000, 1 << 20, 4096
#: Starts of strings that one piece of a split context covers.
SLICE = 8
_LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the least of all, and is smaller."""
    last = np.concatenate([np.flatnonzero(t[:-1] != t[1:]), [len(t) - 1]])
    up = np.ones(len(last), bool)
    up[:-1] = t[last[:-1]] < t[last[:-1] + 1]
    return np.repeat(up, np.diff(last, prepend=-1))  # equal neighbours take the type of the run's end


def _put(sa: np.ndarray, at: np.ndarray, to: np.ndarray, what: np.ndarray, way: int) -> None:
    """Add positions to their buckets in order, from the bucket's head (way 1) or its tail (way -1)."""
    order = np.argsort(to, kind="stable")  # numpy sorts small integers by counting
    count = np.bincount(to, minlength=len(at))
    from_head = at - way * (np.cumsum(count) - count)
    sa[from_head[to[order]] + way * np.arange(len(to))] = what[order]
    at += way * count


def _induce(t: np.ndarray, up: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from that of the seeds (leftmost smaller ones, ascending).

    Buckets (by first symbol) are read in order. What a bucket's suffixes induce goes to their buckets at
    once; what it induces into itself makes a next wave.
    """
    n, size = len(t), int(t.max()) + 1
    count = np.bincount(t, minlength=size)
    ends = np.cumsum(count)
    heads = ends - count
    larger = heads + np.bincount(t[~up], minlength=size)  # from here to its end a bucket has the smaller ones
    sa = np.zeros(n, np.int32)
    # The symbol before each suffix if it begins a larger (else a smaller) one, or -1.
    before = np.full((2, n), -1, np.int16)
    before[0, 1:][~up[:-1]] = t[:-1][~up[:-1]]
    before[1, 1:][up[:-1]] = t[:-1][up[:-1]]

    def follow(wave: np.ndarray, way: int) -> None:
        to = before[int(way < 0)][wave]
        ok = np.flatnonzero(to >= 0)
        if len(ok):
            _put(sa, at, to[ok].astype(np.uint8), wave[ok] - 1, way)

    cut = np.searchsorted(t[seeds], np.arange(size + 1))  # ascending seeds lie by first symbol
    at = heads.copy()
    for c in np.flatnonzero(count).tolist():
        done = heads[c]
        while at[c] > done:
            wave, done = sa[done : at[c]], at[c]
            follow(wave, 1)
        follow(seeds[cut[c] : cut[c + 1]], 1)
    at = ends - 1
    for c in np.flatnonzero(count).tolist()[::-1]:
        done = ends[c] - 1
        while at[c] < done:
            wave, done = sa[at[c] + 1 : done + 1][::-1], at[c]
            follow(wave, -1)
        follow(sa[heads[c] : larger[c]][::-1], -1)
    sa[0] = n - 1  # the last symbol, which nothing induces
    return sa


def _words(t: np.ndarray, kind: str) -> np.ndarray:
    """The eight symbols from each position as one number, read in place."""
    return np.ndarray(len(t), kind, t.tobytes() + bytes(8), strides=(1,))


def _named(t: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost smaller substrings in order, and which differ from the one before: sorted by eight symbols at a time.

    Each ends with the next one's first symbol. One that another continues is the larger, so the highest symbol fills it up.
    """
    span = np.diff(small, append=len(t) - 1) + 1
    words = _words(t, ">u8")

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(span[which] - depth, 0, 8)
        fill = np.array([(1 << 8 * (8 - k)) - 1 for k in range(9)], np.uint64)
        return words[np.minimum(small[which] + depth, len(t) - 1)].astype(np.uint64) | fill[rest]

    of = np.arange(len(small))
    word = key(of, 0)
    order = np.argsort(word)
    word = word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    depth = 8
    while True:
        group = np.cumsum(new) - 1
        longer = np.bincount(group, span[order] > depth) > 0
        live = np.flatnonzero(longer[group] & ~(new & np.concatenate([new[1:], [True]])))
        if not len(live):
            return order, new
        of, group, word = order[live], group[live], key(order[live], depth)
        by = np.lexsort((word, group))
        of, group, word = of[by], group[by], word[by]
        order[live] = of
        new[live] = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        depth += 8


def _ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Positions of a string of names in the order of their suffixes. A suffix's rank is where its group begins; groups of
    several are split by the ranks that follow, twice as far each round."""
    n, step = len(order), 1
    at = np.arange(n, dtype=np.int32)
    order, alone = order.astype(np.int32), new & np.concatenate([new[1:], [True]])
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    live = order[~alone]
    while len(live):
        key = (rank[live].astype(np.int64) << 32) + rank[live + step]  # one that isn't alone doesn't reach the end, which is
        by = np.argsort(key)
        live, key = live[by], key[by]
        own = (key >> 32).astype(np.int32)
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), at[: len(own)], 0))
        rank[live] = own + np.maximum.accumulate(np.where(new[:-1], at[: len(own)], 0)) - group
        live = live[~(new[:-1] & new[1:])]
        step *= 2
    order = np.zeros(n, np.int32)
    order[rank] = at
    return order


def suffix_array(t: np.ndarray, end: int = -1) -> np.ndarray:
    """Suffix array of integers under 255 whose last is 0 and the only 0.

    Leftmost smaller substrings are sorted and named by rank, the string of names is sorted by its ranks, and its order
    seeds the induction of all suffixes. Symbols equal to `end`, if given, count as different ones: the last is the least, the
    others ascend by place. It must be 1, stand before the 0, and never at the start or beside itself.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint8)
    up = _types(t)
    small = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(small) > 1:
        order, new = _named(t, small)
        if end >= 0:
            ends = np.flatnonzero(t[small[order]] == end)
            order[ends], new[ends] = np.sort(order[ends]), True
        small = small[_ranked(order, new)]
    sa = _induce(t, up, small.astype(np.int32))
    if end >= 0:  # nothing follows from their order but their own, which was induced by what comes after
        ends = np.flatnonzero(t == end)
        sa[1 : len(ends) + 1] = np.roll(ends, 1)
    return sa


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, end: int = -1) -> np.ndarray:
    """For each position, the symbols its suffix shares with the one before it in the array.

    Where the symbols before the two suffixes agree, the value is the left neighbour's less one, so only the
    others are compared, all at once, eight symbols at a time. `end` as for suffix_array().
    """
    n = len(t)
    t = t.astype(np.uint8)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    same = t[np.maximum(before, 1) - 1]
    free = np.ones(n, bool)
    free[1:] = (before[1:] <= 0) | (t[:-1] != same[1:]) | (t[:-1] == end)
    start = np.flatnonzero(free & (before >= 0)).astype(np.int32)
    most = np.full(len(start), n, np.int32)
    if end >= 0:
        ends = np.concatenate([np.flatnonzero(t == end), [n - 1]]).astype(np.int32)
        most = ends[np.searchsorted(ends, start)] - start
    words = _words(t, "<u8")
    a, b, live = start, before[start], np.arange(len(start))
    shared = np.zeros(len(start), np.int32)
    while len(live):
        differ = words[a] ^ words[b]
        shared[live] += (np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3).astype(np.int32)
        on = (differ == 0) & (shared[live] < most[live])
        a, b, live = a[on] + np.int32(8), b[on] + np.int32(8), live[on]
    shared = np.minimum(shared, most)
    sums = np.arange(n, dtype=np.int32)
    sums[start] += shared
    where = np.flatnonzero(free)
    sums = np.repeat(sums[where], np.diff(where, append=n))
    return np.maximum(sums - np.arange(n, dtype=np.int32), 0)


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, hash, and the context's hash, start and end, of every anchor. A string's anchor is the leftmost
    of its windows with the least 32 bits, so each string lies in one context."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    p = prefix_hash(data)
    m = len(data) - K + 1
    h = window_hash(data, K, p)
    least = window_min((h & np.uint64(0xFFFFFFFF << 32)) | np.arange(m, dtype=np.uint64), SIDE + 1)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin = np.flatnonzero(row[: len(least)] == row[LENGTH - 1 :])  # no strings across documents
    if not len(begin):
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    where = (least & np.uint64(0xFFFFFFFF))[begin].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    where, start, end = where[first], begin[first], begin[np.concatenate([first[1:], [len(begin)]]) - 1] + LENGTH
    of = row[where]
    return of, where - at[of], h[where], mixed(span_hash(p, start, end) + (where - start).astype(np.uint64)), start - at[of], end - at[of]


def _ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of ranges within each document, in order."""
    if not len(doc):
        return doc, tie, start, end
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])
    group = np.cumsum(new)
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], tie[first], start[first], reach[last]


_FOUND = "kind int, anchor long, context long, doc long, tie long, place int, start int, stop int"


def _rows(kind: int, anchor, context, doc, tie, place, start, stop) -> pa.RecordBatch:
    n = len(doc)
    cols = [np.full(n, kind, np.int32), anchor.view(np.int64), context.view(np.int64), doc, tie, place.astype(np.int32), start.astype(np.int32), stop.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "anchor", "context", "doc", "tie", "place", "start", "stop"])


def _once(anchor, context, doc, tie, place) -> np.ndarray:
    """Of sorted rows, those that don't repeat the row before them: copies of a document have the same anchors, which count once."""
    differs = [x[1:] != x[:-1] for x in (anchor, context, doc, tie, place)]
    return np.concatenate([[True], np.logical_or.reduce(differs)])


def _firsts(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Of equal contexts the first, as kind 0; the ranges of the others, as kind 1."""
    anchor, context, doc, tie, place, start, stop = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((place, tie, doc, context, anchor))
    order = order[_once(*(c[order] for c in (anchor, context, doc, tie, place)))]
    again = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1])])
    first, later = np.sort(order[~again]), order[again]  # in the order of documents, rows compress far better
    if len(first):
        yield _rows(0, *(c[first] for c in (anchor, context, doc, tie, place, start, stop)))
    if len(later):
        doc, tie, start, stop = _ranges(doc[later], tie[later], start[later], stop[later])
        none = np.zeros(len(doc), np.int64)
        yield _rows(1, mixed(tie.view(np.uint64)), none, doc, tie, none, start, stop)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        doc, tie = batch["doc"].to_numpy(zero_copy_only=False), batch["tie"].to_numpy(zero_copy_only=False)
        data, at = utf8(batch["text"])
        for i, j in pieces(at):
            of, place, h, context, start, end = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if len(of):
                parts.append((h, context, doc[i + of], tie[i + of], place, start, end))
                held += len(of)
            if held >= HELD:
                yield from _firsts(parts)
                parts, held = [], 0
    if parts:
        yield from _firsts(parts)


def _meet(hot: int):
    """Rows sorted by anchor, context, document and place: ranges of repeated contexts (kind 1, those that come so
    too), and the firsts of anchors that have several (kind 2; 3 if they are more than `hot`)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["anchor"]):
            ranges = pc.equal(table["kind"], 1)
            yield from table.filter(ranges).combine_chunks().to_batches()
            table = table.filter(pc.invert(ranges))
            if not table.num_rows:
                continue
            anchor, context, doc, tie, place, start, stop = (table[c].to_numpy() for c in ("anchor", "context", "doc", "tie", "place", "start", "stop"))
            once = _once(anchor, context, doc, tie, place)
            anchor, context, doc, tie, place, start, stop = (c[once] for c in (anchor, context, doc, tie, place, start, stop))
            same = anchor[1:] == anchor[:-1]
            again = np.concatenate([[False], same & (context[1:] == context[:-1])])
            if again.any():
                d, t, a, b = _ranges(doc[again], tie[again], start[again], stop[again])
                none = np.zeros(len(d), np.int64)
                yield _rows(1, none, none, d, t, none, a, b)
            anchor, context, doc, tie, place, start, stop = (c[~again] for c in (anchor, context, doc, tie, place, start, stop))
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.repeat(np.diff(np.concatenate([first, [len(anchor)]])), np.diff(np.concatenate([first, [len(anchor)]])))
            for kind, use in ((2, (count > 1) & (count <= hot)), (3, count > hot)):
                if use.any():
                    yield _rows(kind, *(c[use] for c in (anchor, context, doc, tie, place, start, stop)))

    return meet


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's text followed by its requests, to the bytes of contexts. A context of a hot anchor gives
    pieces for SLICE starts each, dealt by the bytes that those strings all have."""

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "doc", "tie", "start", "bytes"])

    text, own = b"", None
    for batch in batches:
        kind, anchor, doc, tie, place, start, stop = (batch[c].to_pylist() for c in ("kind", "anchor", "doc", "tie", "place", "start", "stop"))
        texts, out = batch["text"], []
        for i in range(batch.num_rows):
            if kind[i] == 0:
                text, own = (texts[i].as_py() or "").encode(), (doc[i], tie[i])
            elif own == (doc[i], tie[i]):
                if kind[i] == 2:
                    out.append([anchor[i], doc[i], tie[i], start[i], text[start[i] : stop[i]]])
                    continue
                for r in range(-SIDE, 1, SLICE):
                    a, b = place[i] + r, min(place[i] + r + SLICE - 1, place[i])
                    x, y = max(a, start[i]), min(b, stop[i] - LENGTH)
                    if x <= y:
                        core = hashlib.blake2b(text[b : a + LENGTH] + b"%d" % r, digest_size=8).digest()
                        out.append([int.from_bytes(core, "little", signed=True), doc[i], tie[i], x, text[x : y + LENGTH]])
        if out:
            yield rows(out)


def _sort_shard(table: pa.Table) -> pa.RecordBatch:
    """Ranges that start earlier elsewhere, from the suffix array of a shard's contexts."""
    doc, tie, start = (table[c].to_numpy() for c in ("doc", "tie", "start"))
    data, at = utf8_binary(table["bytes"])
    n = len(doc)
    begin = at + np.arange(n + 1)
    t = np.zeros(len(data) + n + 1, np.uint8)  # a 1 ends each context, a 0 all
    inside = np.ones(len(t), bool)
    inside[begin[1:] - 1] = inside[-1] = False
    t[begin[1:] - 1] = 1
    t[inside] = data + np.uint8(2)
    sa = suffix_array(t, 1)
    common = permuted_prefixes(t, sa, 1)
    edge = np.zeros(len(t), np.int8)
    edge[begin[:-1]], edge[begin[1:] - LENGTH] = 1, -1
    sa = sa[np.cumsum(edge, dtype=np.int8).view(bool)[sa]]  # starts of whole strings; keeps runs together: no shorter one lies within a run
    new = common[sa] < LENGTH
    new[:1] = True
    several = ~(new & np.concatenate([new[1:], [True]]))
    sa, new = sa[several], new[several]
    if not len(sa):
        none = np.zeros(0, np.int64)
        return _rows(1, none, none, none, none, none, none, none)
    order = np.lexsort((tie, doc))
    doc, tie = doc[order], tie[order]
    own = np.zeros(n, np.int64)  # each context's document, numbered in order, and where its bytes begin there
    own[order] = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]))
    first = np.zeros(n, np.int64)
    first[own[order]] = np.arange(n)
    base = (own << 32) + start - begin[:-1]
    key = np.repeat(base, np.diff(begin))[sa] + sa
    head = np.flatnonzero(new)
    key = np.sort(key[key != np.repeat(np.minimum.reduceat(key, head), np.diff(head, append=len(key)))])
    apart = np.flatnonzero(np.diff(key) > LENGTH)
    a, b = key[np.concatenate([[0], apart + 1])[: len(key)]], key[np.concatenate([apart, [len(key) - 1]])[: len(key)]]
    none, of = np.zeros(len(a), np.int64), first[a >> 32]
    return _rows(1, none, none, doc[of], tie[of], none, a & 0xFFFFFFFF, (b & 0xFFFFFFFF) + LENGTH)


def utf8_binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by shard key; whole keys are sorted together, as many as make SHARD bytes."""
    held, size = [], 0
    for table in whole_groups(batches, ["shard"]):
        held.append(table)
        size += table.nbytes
        if size >= SHARD:
            yield from _shards(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield from _shards(pa.concat_tables(held))


def _shards(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key = table["shard"].to_numpy()
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    if (alone := new[1:] & new[:-1]).any():  # a key's only context repeats nothing: its strings begin at different places before the anchor
        table = table.filter(pa.array(~alone))
        key = table["shard"].to_numpy()
    length = np.cumsum(np.diff(utf8_binary(table["bytes"])[1]))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    i = 0
    while i < len(key):
        j = np.searchsorted(length, (length[i - 1] if i else 0) + SHARD)
        j = len(key) if j >= len(key) else max(first[np.searchsorted(first, j, "right") - 1], first[first > i][0] if (first > i).any() else len(key))
        part = table.slice(i, j - i)
        if part.num_rows > 1:
            yield _sort_shard(part)
        i = j


# ---------------------------------------------------------------- documents


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a document (kind 0) are followed by its row (kind 1), and that by rows alike, which lose all that strings of LENGTH bytes cover.
    Rows go as they come: however many copies a document has, none is held."""
    own, spans, first = None, [], True
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        kind, doc, tie, start, stop = (batch[c].to_pylist() for c in ("kind", "doc", "tie", "start", "stop"))
        out = []
        for i in range(batch.num_rows):
            if own != (doc[i], tie[i]):
                own, spans, first = (doc[i], tie[i]), [], True
            if kind[i] == 0:
                if spans and start[i] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop[i])
                else:
                    spans.append([start[i], stop[i]])
                continue
            raw = (batch["text"][i].as_py() or "").encode()
            gone = spans if first else [[0, len(raw)]] if len(raw) >= LENGTH else []
            first, at, kept = False, 0, hashlib.sha256()
            for a, b in gone:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((batch["doc_id"][i].as_py(), len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names)


def _trimmed(rows: pa.Table, ranges: list[list[tuple[int, int]]]) -> pa.Array:
    """Texts without the repeated ranges; a character that a range covers in part stays."""
    out = []
    for text, own in zip(rows["text"].to_pylist(), ranges, strict=True):
        if own:
            raw, at, parts = text.encode(), 0, []
            for a, b in own:
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a])
                at = b
            text = b"".join([*parts, raw[at:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "tie": F.xxhash64(F.coalesce("text", F.lit("")))})


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, tie, start, stop): byte ranges of repeated strings. doc is doc_id, the largest long for a null; tie
    is a hash of the text, which tells rows of one doc_id apart; of rows alike in both, the ranges are those of the first."""
    text = _identified(docs.select("doc_id", "text")).select("doc", "tie", "text")
    meet = text.mapInArrow(_find, _FOUND).repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "tie", "place").mapInArrow(_meet(hot), _FOUND)
    meet = written(meet, "contexts")
    wanted = meet.where("kind >= 2").select("kind", "anchor", "doc", "tie", "place", "start", "stop", F.lit(None).cast("string").alias("text"))
    source = text.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), "doc", "tie", *(F.lit(0).alias(c) for c in ("place", "start", "stop")), "text")
    contexts = source.unionByName(wanted).repartition("doc", "tie").sortWithinPartitions("doc", "tie", "kind").mapInArrow(_cut, "shard long, doc long, tie long, start long, bytes binary")
    ranges = contexts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sort, _FOUND)
    return meet.where("kind = 1").unionByName(ranges).select("doc", "tie", "start", "stop")


def removal_digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    A null text is empty and loses nothing, as does any text under LENGTH bytes. Rows of one doc_id come in the order of a hash of their texts, and
    rows alike in both one after another: the first keeps what no earlier document has, the others start later and lose
    everything from LENGTH bytes on. `hot`: contexts of one anchor from which on they are split. A null doc_id comes after all others. Other columns aren't read; an empty table gives no rows.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = _identified(docs).select(F.lit(1).alias("kind"), "doc", "tie", F.lit(0).alias("start"), F.lit(0).alias("stop"), "doc_id", "text")
    empty = [F.lit(None).cast(t).alias(c) for c, t in docs.select("doc_id", "text").dtypes]
    both = rows.unionByName(repeated_ranges(docs, hot).select(F.lit(0).alias("kind"), "doc", "tie", "start", "stop", *empty))
    dealt = both.repartition("doc", "tie").sortWithinPartitions("doc", "tie", "kind", "start")
    return dealt.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, with repeated strings cut from text. A row that loses its whole text goes; of rows alike in id and text, with
    LENGTH bytes or more, so do all but one. Shorter texts stay as they are."""
    own_ranges, doc, tie, cut_text, copy = unused(docs, "ranges", "doc", "tie", "cut", "copy")
    ranges = repeated_ranges(docs.select("doc_id", "text")).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(own_ranges))
    named = docs.withColumns({doc: F.coalesce("doc_id", F.lit(_LAST)), tie: F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = named.join(ranges.withColumnsRenamed({"doc": doc, "tie": tie}), [doc, tie], "left")

    def trim(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, own in batches:
            merged = []
            for spans in own.to_pylist():
                union: list[list[int]] = []
                for r in spans or []:
                    if union and r["start"] <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], r["stop"])
                    else:
                        union.append([r["start"], r["stop"]])
                merged.append(union)
            yield _trimmed(pa.table({"text": text}), merged)

    cut = F.arrow_udf(trim, "string").asNondeterministic()("text", own_ranges)
    again = F.row_number().over(Window.partitionBy(doc, tie).orderBy(F.lit(0))) > 1  # dealt and sorted like that by the join
    joined = joined.withColumn(copy, again).where(~F.col(copy) | (F.octet_length(F.coalesce("text", F.lit(""))) < LENGTH))
    done = joined.withColumn(cut_text, cut).where(F.col(own_ranges).isNull() | (F.col(cut_text) != ""))
    done = done.withColumn("text", F.col(cut_text))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(own_ranges).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)
