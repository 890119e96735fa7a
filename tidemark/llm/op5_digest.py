"""Similarity digests of rare features: byte windows ranked by how rare their entropy is, in chained Bloom filters."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, prefix_hash, span_hash, utf8, whole_groups, window_min

#: Bytes of a feature, starts that compete for one vote, votes that select a feature.
WINDOW, RIVALS, VOTES = 64, 64, 16
#: Texts under so many bytes have windows of so many bytes as features too.
SHORT, GRAM = 512, 8
#: Bits of a filter, bits that a feature sets, and features that fill a filter.
BITS, HASHES, FULL = 2048, 5, 160
#: Steps of entropy from 0 to log2(WINDOW); those outside of the range aren't features.
STEPS, USABLE = 1000, (100, 990)
#: Share of the possible overlap above chance under which filters count as unlike.
CUT = 0.3
#: Width of a block of doc_ids, whose documents find their next one together.
BLOCK = 256
_UNUSED = STEPS + 1
_LAST = np.iinfo(np.int64).max

_f = np.rint(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 65536).astype(np.int64)
_GAIN = _f[1:] - _f[:-1]


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """Shannon entropy, in STEPS, of the WINDOW bytes from each position. A byte that enters or leaves a window
    changes its sum by a table's value for the count of its like among the other bytes, so all windows come from
    one running sum."""
    n, w = len(data), WINDOW
    if n < w:
        return np.zeros(0, np.int16)
    past, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        past[d:] += same
        ahead[:-d] += same
    total = np.cumsum(_GAIN[past])  # of the first window, whose bytes' past doesn't reach beyond it
    begin = total[w - 1]
    move = np.cumsum(_GAIN[past[w:]] - _GAIN[ahead[: n - w]])
    sums = np.concatenate([[begin], begin + move])
    bits = np.log2(w) - sums / (w * 65536)
    return np.minimum(bits * (STEPS / np.log2(w)), STEPS).astype(np.int16)


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step, 0 the rarest among all windows of all texts; only STEPS sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, at = utf8(batch["text"])
            for i, j in pieces(at):
                part = data[at[i] : at[j]]
                step = entropy_steps(part)
                row = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                total += np.bincount(step[row[: len(step)] == row[WINDOW - 1 :]] if len(step) else step, minlength=STEPS + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["step", "n"])

    seen = docs.select("text").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(STEPS + 1, np.int64)
    for r in seen:
        total[r.step] = r.n
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.lexsort((np.arange(STEPS + 1), total))] = np.arange(STEPS + 1)
    ranks[: USABLE[0]], ranks[USABLE[1] :] = _UNUSED, _UNUSED
    return ranks


def features(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the selected features, in order, each once a row.

    A text in which no window gets enough votes has its rarest. Texts under SHORT bytes have few of either, so all
    their windows of GRAM bytes follow, or the text itself if it's shorter still.
    """
    n = len(data)
    size = np.diff(at)
    p = prefix_hash(data)
    rows, hashes = [], []
    if n >= WINDOW:
        row = np.repeat(np.arange(len(size)), size)
        m = n - WINDOW + 1
        rank = ranks[entropy_steps(data)]
        inside = row[:m] == row[WINDOW - 1 :]
        rank[~inside] = _UNUSED + 1
        key = (rank << 40) + np.arange(m)
        select = np.zeros(m, bool)
        if m >= RIVALS:
            least = window_min(key, RIVALS)
            whole = row[: len(least)] == row[WINDOW + RIVALS - 2 :][: len(least)]
            least = least[whole]
            least = least[(least >> 40) < _UNUSED] & ((1 << 40) - 1)
            select = np.bincount(least, minlength=m) >= VOTES
        has = np.bincount(row[:m][select], minlength=len(size)) > 0
        for r in np.flatnonzero(~has & (size >= WINDOW)):
            a = at[r]
            select[a + key[a : at[r + 1] - WINDOW + 1].argmin()] = True
        where = np.flatnonzero(select)
        rows.append(row[where])
        hashes.append(span_hash(p, where, where + WINDOW))
    short = np.flatnonzero((size > 0) & (size < SHORT))
    grams = np.maximum(size[short] - GRAM + 1, 1)
    of = np.repeat(short, grams)
    where = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    rows.append(of)
    hashes.append(span_hash(p, where, np.minimum(where + GRAM, at[of + 1])))
    of, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(of, kind="stable")
    of, h = of[order], h[order]
    if len(of):  # the first of equal features in a row
        order = np.lexsort((np.arange(len(of)), h, of))
        again = np.zeros(len(of), bool)
        again[order[1:]] = (of[order][1:] == of[order][:-1]) & (h[order][1:] == h[order][:-1])
        of, h = of[~again], h[~again]
    return of, h


def filters(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its features' count in each filter, and the filters' bits as words of 64."""
    of, h = features(data, at, ranks)
    n = len(at) - 1
    count = np.bincount(of, minlength=n)
    chains = -(-count // FULL)
    first = np.concatenate([[0], np.cumsum(chains)])
    place = np.arange(len(of)) - np.concatenate([[0], np.cumsum(count)])[of]
    which = first[of] + place // FULL
    bits = np.zeros((first[-1], BITS), bool)
    for i in range(HASHES):
        bits[which, (h >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = True
    words = np.packbits(bits, axis=1).view(np.uint64)
    sizes = np.bincount(which, minlength=first[-1])
    return [(sizes[a:b], words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def digest(own: tuple[np.ndarray, np.ndarray]) -> str:
    """Each filter's count of features (two bytes) and bits, in base64."""
    return base64.b64encode(b"".join(int(c).to_bytes(2, "big") + w.tobytes() for c, w in zip(*own, strict=True))).decode()


def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8 + 2)
    return raw[:, 0].astype(np.int64) * 256 + raw[:, 1], np.ascontiguousarray(raw[:, 2:]).view(np.uint64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the filters of the shorter chain, each against the most alike of the other's, weighted by features.

    Two filters' overlap counts from CUT of the way between that of independent filters and the largest possible.
    Two empty digests are alike.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if (len(b[0]), int(b[0].sum())) < (len(a[0]), int(a[0].sum())):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x[1]).sum(1).astype(np.float64) for x in (a, b))
    best = np.zeros(len(ones_a))
    step = max(1, (1 << 17) // len(ones_b))
    for i in range(0, len(ones_a), step):
        own = ones_a[i : i + step, None]
        both = np.bitwise_count(a[1][i : i + step, None] & b[1][None]).sum(2)
        chance = own * ones_b / BITS
        most = np.minimum(own, ones_b)
        floor = chance + CUT * (most - chance)
        best[i : i + step] = np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(1)
    return float((best * a[0]).sum() / a[0].sum())


def following(keys: DataFrame, key: str, to: str) -> DataFrame:
    """Each distinct key with the next larger one, the last with the first; no task orders all keys, only
    those of one range of 4096 values, and one task the ranges."""
    ranged = keys.select(key).distinct().withColumn("__range", F.floor(F.col(key) / 4096))
    inner = ranged.withColumn("__next", F.lead(key).over(Window.partitionBy("__range").orderBy(key)))
    tops = ranged.groupBy("__range").agg(F.min(key).alias("__first"))
    tops = tops.withColumn("__after", F.lead("__first").over(Window.orderBy("__range")))
    tops = tops.crossJoin(F.broadcast(tops.agg(F.min("__first").alias("__least")))).select("__range", F.coalesce("__after", "__least").alias("__after"))
    return inner.join(tops, "__range").select(key, F.coalesce("__next", "__after").alias(to))


def _documents(ranks: np.ndarray):
    import hashlib

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def all_filters(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return [x for i, j in pieces(at) for x in filters(data[at[i] : at[j]], at[i : j + 1] - at[i], ranks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"]):
            block, tail = table["block"].to_numpy(), table["tail"].to_numpy()
            ids, texts = table["doc_id"].to_pylist(), [t or "" for t in table["text"].to_pylist()]
            own = np.flatnonzero(tail == 0)
            plain = all_filters([t.encode() for t in texts])
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in own]
            raw = [t.encode() for t in edited]
            changed = all_filters(raw)
            assert (block[own] == block[own + 1]).all()
            out = [
                (ids[i], len(texts[i]), hashlib.sha256(r).hexdigest(), digest(plain[i]), digest(c), likeness(plain[i], c), likeness(plain[i], plain[i + 1]))
                for i, r, c in zip(own.tolist(), raw, changed, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    A null text is empty; an empty text has an empty fingerprint, like only to another empty one. Rows of one
    doc_id follow each other in the order of a hash of their texts, null ids come last; the last row's next is the
    first. A single row follows itself. An empty table gives no rows; other columns aren't read.

    Documents meet in blocks of BLOCK ids; each block also gets the first document of the next one.
    """
    ranks = entropy_ranks(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LAST))).withColumn("block", F.floor(F.col("key") / BLOCK).cast("long"))
    heads = rows.groupBy("block").agg(F.min("key").alias("key"))
    small = heads.count() <= 50_000
    before = following(heads, "block", "to").select(F.col("block").alias("from"), F.col("to").alias("block"))
    first = heads.join(before, "block").select("key", F.col("from"))
    tails = rows.drop("block").join(F.broadcast(first) if small else first, "key").withColumn("tie", F.xxhash64("text"))
    once = Window.partitionBy("from").orderBy("tie")
    tails = tails.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(F.col("from").alias("block"), F.lit(1).alias("tail"), "key", "tie", "doc_id", "text")
    all_rows = rows.select("block", F.lit(0).alias("tail"), "key", F.xxhash64("text").alias("tie"), "doc_id", "text").unionByName(tails)
    dealt = all_rows.repartition("block").sortWithinPartitions("block", "tail", "key", "tie").select("block", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_documents(ranks), schema)
