"""Benchmark passages in documents: the q-gram lemma on diagonal bands filters, banded alignment decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, removed, stored, unused, utf8, window_hash

#: Bytes of a q-gram, and edits allowed for each byte of a normalised item.
Q, RATE = 12, 0.05
#: Bytes of items that one index holds; a larger benchmark is searched block after block.
BLOCK = 4 << 20
#: Pairs that the search holds at once.
PAIRS = 1 << 20
_TABLE = 22

MATCHES = "array<struct<item_id:long,start:int,stop:int,edits:int>>"


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits in lower case (A-Z and the Latin-1 letters), offsets, and where each byte came from.
    Bytes of other non-ASCII characters stay as they are; white space, marks and punctuation go."""
    n = len(data)
    if not n:
        return data, at, np.zeros(0, np.int64)
    upper = (data >= 65) & (data <= 90)
    accent = np.zeros(n, bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    low = data + (upper | accent).astype(np.uint8) * np.uint8(32)
    use = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    kept = np.flatnonzero(use)
    return low[kept], np.searchsorted(kept, at), kept


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Index:
    """q-grams of a block of items: the edits and common q-grams that each item asks for, its probes, and all its q-grams.

    An item of t q-grams asks for t - q * edits of them. So of any q * edits + 1 of its q-grams a match has one, and its
    rarest so many are its probes: a q-gram that many items share is looked at for those alone that have none rarer.
    """

    def __init__(self, ids: list[int | None], texts: list[str], q: int = Q, rate: float = RATE):
        data, at = utf8(pa.array(texts, pa.string()))
        data, at, _ = normalised(data, at)
        self.q, self.ids, self.at, self.data = q, pa.array(ids, pa.int64()), at, data
        self.size = np.diff(at)
        self.edits = np.maximum(np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q), 0)
        self.least = np.maximum(self.size - q + 1 - q * self.edits, 1)
        h = window_hash(data, q)
        of = np.searchsorted(at, np.arange(len(h)), "right") - 1
        fits = np.arange(len(h)) + q <= at[of + 1]
        h, of, place = h[fits], of[fits], (np.arange(len(h)) - at[of])[fits]
        self.hash, gram = np.unique(h, return_inverse=True)
        count = np.bincount(gram, minlength=len(self.hash))
        # all q-grams, by item and then q-gram
        order = np.lexsort((place, gram, of))
        self.key, self.place = of[order] * max(len(self.hash), 1) + gram[order], place[order]
        # probes, by q-gram
        order = np.lexsort((place, count[gram], of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        probe = order[rank <= q * self.edits[of[order]]]
        probe = probe[np.argsort(gram[probe], kind="stable")]
        self.probe_item, self.probe_place = of[probe], place[probe]
        self.probe_first = np.searchsorted(gram[probe], np.arange(len(self.hash) + 1))
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self.hash >> np.uint64(64 - _TABLE)] = True


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for so many things each: the row of each thing, and its place among the row's."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _slices(count: np.ndarray) -> Iterator[slice]:
    """Ranges of rows that stand for PAIRS things at most, or of one row."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        yield slice(i, j)
        i = j


def _bands(index: Index, x: np.ndarray, gram: np.ndarray, row: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, band) with enough common q-grams. Band b of an item with e edits holds the diagonals from b (e + 1) to before
    (b + 2) (e + 1), so bands overlap and any match lies whole in one."""
    found = []
    count = index.probe_first[gram + 1] - index.probe_first[gram]
    for part in _slices(count):
        of, nth = _spread(count[part])
        post = index.probe_first[gram[part]][of] + nth
        item, r = index.probe_item[post], row[part][of]
        band = np.floor_divide(x[part][of] - index.probe_place[post] - cut[r], index.edits[item] + 1)
        both = np.stack([np.tile(r, 2), np.tile(item, 2), np.concatenate([band, band - 1])])
        found.append(np.unique(both, axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row_, item, band = np.unique(np.concatenate(found, axis=1), axis=1)
    wide = index.edits[item] + 1
    begin = cut[row_] + band * wide
    first = np.searchsorted(x, np.maximum(begin, cut[row_]))
    last = np.searchsorted(x, np.minimum(begin + 2 * wide + index.size[item], cut[row_ + 1]))
    shared = np.zeros(len(item), np.int64)
    count = np.maximum(last - first, 0)
    for part in _slices(count):
        of, nth = _spread(count[part])
        at = first[part][of] + nth
        key = item[part][of] * len(index.hash) + gram[at]
        low = np.searchsorted(index.key, key)
        again, more = _spread(np.searchsorted(index.key, key, "right") - low)
        diagonal = x[at][again] - index.place[low[again] + more] - begin[part][of][again]
        inside = (diagonal >= 0) & (diagonal < 2 * wide[part][of][again])
        shared[part] += np.bincount(of[again][inside], minlength=part.stop - part.start)
    enough = shared >= index.least[item]
    return row_[enough], item[enough], band[enough]


def _align(index: Index, data: np.ndarray, item: np.ndarray, low: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits that turn each item into bytes of its region, and where these start and stop in data.

    A region starts at byte `low`; row i of the alignment looks at bytes low + i to low + i + width, so
    every diagonal of the region's band is held. Starting and stopping anywhere in the band is free.
    Bytes outside the region's document, lo to hi, have an infinite cost, starts and stops there included.
    """
    size, at = index.size[item], index.at[item]
    cols = np.arange(width)
    lo, hi, never = lo[:, None], hi[:, None], np.int64(1 << 60)
    begin = low[:, None] + cols[None]
    best = np.full(len(item), 1 << 20, np.int32)
    start, stop = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    packed = np.where((begin >= lo) & (begin <= hi), begin, never)
    for i in range(int(size.max())):
        live = i < size
        where = low[:, None] + i + cols[None]
        inside = (where >= lo) & (where < hi)
        other = data[np.clip(where, 0, len(data) - 1)]
        symbol = index.data[np.minimum(at + i, len(index.data) - 1)][:, None]
        step = np.where(inside, packed + ((other != symbol).astype(np.int64) << 40), never)  # same diagonal
        skip = np.full_like(packed, never)
        skip[:, :-1] = packed[:, 1:] + (1 << 40)  # a byte of the item is missing in the text
        new = np.minimum(step, skip)
        slope = (cols.astype(np.int64) << 40)[None]
        new = np.minimum.accumulate(new - slope, 1) + slope  # bytes of the text that the item lacks
        new = np.where(inside | (where == lo - 1), np.minimum(new, never), never)
        packed = np.where(live[:, None], new, packed)
        done = size == i + 1
        if done.any():
            j = packed[done].argmin(1)
            value = packed[done][np.arange(done.sum()), j]
            best[done] = value >> 40
            start[done] = value & ((1 << 40) - 1)
            stop[done] = low[done] + i + j + 1
    return best, start, stop


def find(index: Index, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, start, stop, edits) of matches in texts; start and stop are bytes of the row's text."""
    none = (np.zeros(0, np.int64),) * 5
    low, cut, kept = normalised(data, at)
    if not len(index.hash) or len(low) < index.q:
        return none
    h = window_hash(low, index.q)
    x = np.flatnonzero(index.table[h >> np.uint64(64 - _TABLE)])
    k = np.searchsorted(index.hash, h[x])
    ok = (k < len(index.hash)) & (index.hash[np.minimum(k, len(index.hash) - 1)] == h[x])
    x, k = x[ok], k[ok]
    row = np.searchsorted(cut, x, "right") - 1
    ok = x + index.q <= cut[row + 1]
    x, k, row = x[ok], k[ok], row[ok]
    row, item, band = _bands(index, x, k, row, cut)
    if not len(row):
        return none
    edits = index.edits[item]
    begin = cut[row] + band * (edits + 1) - edits
    outs = []
    for e in np.unique(edits):  # a band is 2e + 2 diagonals, and the alignment may leave it by e on either side
        of = np.flatnonzero(edits == e)
        for i in range(0, len(of), 1024):
            part = of[i : i + 1024]
            cost, start, stop = _align(index, low, item[part], begin[part], 4 * int(e) + 2, cut[row[part]], cut[row[part] + 1])
            fit = cost <= e
            outs.append((row[part][fit], item[part][fit], start[fit], stop[fit], cost[fit].astype(np.int64)))
    row, item, start, stop, cost = (np.concatenate(c) for c in zip(*outs, strict=True))
    order = np.lexsort((stop, start, cost, item, row))
    row, item, start, stop, cost = row[order], item[order], start[order], stop[order], cost[order]
    # neighbouring bands find one place twice: the best of each run of overlapping matches stays
    order = np.lexsort((cost, start, item, row))
    row, item, start, stop, cost = row[order], item[order], start[order], stop[order], cost[order]
    if not len(row):
        return none
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] >= stop[:-1])])
    run = np.cumsum(new)
    order = np.lexsort((start, cost, run))
    keep = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])]
    row, item, start, stop, cost = row[keep], item[keep], start[keep], stop[keep], cost[keep]
    return row, item, kept[start] - at[row], kept[stop - 1] + 1 - at[row], cost


def _column(index: Index):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, at = utf8(column)
            parts = []
            for i, j in pieces(at):
                found = find(index, data[at[i] : at[j]], at[i : j + 1] - at[i])
                parts.append((found[0] + i, *found[1:]))
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            values = pa.StructArray.from_arrays([index.ids.take(pa.array(cols[1])), *(pa.array(c.astype(np.int32)) for c in cols[2:])], ["item_id", "start", "stop", "edits"])
            offsets = np.searchsorted(cols[0], np.arange(len(column) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), values)

    return F.arrow_udf(run, MATCHES).asNondeterministic()("text")


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches", q: int = Q, rate: float = RATE) -> DataFrame:
    """docs with a further column of matches: item_id, byte range of the text, and edits.

    An item matches where its normalised bytes turn into the text's with RATE edits a byte at most (fewer for
    short items, so that the q-gram lemma asks for one common q-gram at least). Null and empty texts match
    nothing; neither do items that are null or have under q normalised bytes. A repeated item is found under
    each of its ids; a null item_id stays null. A benchmark of more than BLOCK bytes is searched block after block:
    driver and tasks hold the index of one, and what was found goes on in a stored table.
    """
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // BLOCK) + 1
    found, before = docs, None
    for block in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        column = _column(Index([r.item_id for r in rows], [r.text for r in rows], q, rate))
        if block == 0:
            found = found.withColumn(name, column)
        else:
            kept, path = stored(found, "matches")
            if before:
                removed(docs.sparkSession, before)
            found, before = kept.withColumn(name, F.concat(name, column)), path
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_matches, item_ids (ascending, distinct) and least edits for each row of docs."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_matches"), ids.alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, in which no item is found."""
    (name,) = unused(docs, "matches")
    return with_matches(docs, benchmark, name).where(F.size(name) == 0).drop(name)
