"""Similarity join on word n-grams: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lowered, mixed, pieces, prefix_hash, span_hash, utf8, words, written

#: Words of a shingle, least Jaccard similarity of a link, and wanted chance that a pair just that alike meets in a band.
N, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Documents of one block; the pairs of a group are counted block against block.
BLOCK = 512


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so the fewest false candidates, among those that reach the
    recall at the threshold, 1 - (1 - t^rows)^bands, with at most so many hashes."""
    best = (ceil(log(1 - recall) / log(1 - threshold)), 1)
    for rows in range(2, 17):
        bands = ceil(log(1 - recall) / log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


BANDS, ROWS = choose_bands(THRESHOLD, RECALL)


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, hash of each row's word sequence). Words are lower-cased in A-Z and split at ASCII white space;
    a row of fewer than n words has one shingle of all its words, a row without words none."""
    data = lowered(data)
    w0, w1, row = words(data, at)
    rows = len(at) - 1
    key = span_hash(prefix_hash(data), w0, w1) if len(w0) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    sequence = np.zeros(rows, np.uint64)
    if len(key):
        place = (np.arange(len(key)) - first[row]).astype(np.uint64)
        has = count > 0
        sequence[has] = mixed(np.add.reduceat(mixed(key + mixed(place + np.uint64(1))), first[:-1][has]) + count[has].astype(np.uint64))
    fits = max(len(key) - n + 1, 0)
    if fits:
        h = np.zeros(fits, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + key[j : j + fits]
        inside = row[:fits] == row[n - 1 :]
        h, of = mixed(h[inside]), row[:fits][inside]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        h, of = np.concatenate([h, sequence[few]]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of, sequence


def signature_batches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
        times, plus = (turn >> np.uint64(32)).astype(np.uint32) | np.uint32(1), turn.astype(np.uint32)
        for batch in batches:
            data, at = utf8(batch["text"])
            keys, sets = [], []
            for i, j in pieces(at):
                h, of, sequence = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])
                least = np.zeros((j - i, bands), np.uint64)
                if len(h):
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        joint = np.full(len(first), b + 1, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            x = (low ^ plus[r]) * times[r]
                            x ^= high
                            x *= times[r]
                            joint = mixed(joint * np.uint64(0x100000001B3) + np.minimum.reduceat(x, first))
                        least[of[first], b] = joint
                keys.append(sequence)
                sets.append(least)
            sequence = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            least = np.concatenate(sets) if sets else np.zeros((0, bands), np.uint64)
            none = sequence == 0
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, len(none) * bands + 1, bands, dtype=np.int32)), pa.array(least.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sequence.view(np.int64), mask=none), pa.array(mixed(sequence ^ np.uint64(0xABCDEF)).view(np.int64) ^ np.int64(len("tie")), mask=none), arrays],
                ["doc_id", "h", "h2", "bands"],
            )

    return run


def _links(sets: list[np.ndarray], left: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For documents of one cell: the weight of those linked to each, and the least index of its linked group.

    left: of a cell of two blocks, which are in the first; then only pairs across count. Features held by one
    document alone matter for sizes only; the others' pairwise counts come from products of dense 0/1 slices.
    """
    k = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    if k == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[0, both], [both, 0]], np.float64)
    else:
        of = np.repeat(np.arange(k), size.astype(int))
        _, feature, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        dense = np.cumsum(df > 1) - 1
        use = df[feature] > 1
        of, feature = of[use], dense[feature[use]]
        order = np.argsort(feature, kind="stable")
        of, feature = of[order], feature[order]
        total = int(feature[-1]) + 1 if len(feature) else 0
        shared = np.zeros((k, k), np.float64)
        for a in range(0, total, 4096):
            i, j = np.searchsorted(feature, [a, a + 4096])
            part = np.zeros((k, min(4096, total - a)), np.float32)
            part[of[i:j], feature[i:j] - a] = 1
            shared += part @ part.T
    alike = (shared >= threshold * (size[:, None] + size[None] - shared) - 1e-9) & (size[:, None] > 0)
    np.fill_diagonal(alike, False)
    if left.any() and not left.all():
        alike &= left[:, None] != left[None]
    label = np.arange(k)
    while True:
        new = np.minimum(label, np.where(alike, label[None], k).min(1))
        if (new == label).all():
            return alike @ weight, label
        label = new


def _cells(threshold: float, n: int):
    """Rows sorted by cell come in; a row for each document and cell, with links and a neighbour, goes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> pa.RecordBatch:
            root, a, b, block, node, copies = (t[c].to_numpy() for c in ("root", "i", "j", "block", "node", "copies"))
            data, at = utf8(t["text"])
            sets: list[np.ndarray] = []
            for i, j in pieces(at):
                h, of, _ = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], n)
                cut = np.searchsorted(of, np.arange(j - i + 1))
                sets += [np.unique(h[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            start = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for x, y in zip(start, [*start[1:], len(root)], strict=True):
                _, own = np.unique(node[x:y], return_index=True)  # repeated rows of one document
                own += x
                if len(own) > 1:
                    left = (block[own] == a[own]) & (a[own] != b[own])
                    if a[x] != b[x] and (left.all() or not left.any()):
                        continue
                    links, label = _links([sets[q] for q in own], left, copies[own].astype(float), threshold)
                    hit = links > 0
                    out.append((node[own][hit], node[own][label][hit], links[hit]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64))], ["node", "other", "links"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cells = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("root", "i", "j")])
            if (cells[:, 0] == cells[:, -1]).all():
                continue
            cut = int(np.flatnonzero((cells != cells[:, -1:]).any(0))[-1]) + 1
            held[-1] = batch.slice(0, cut)
            yield flush(pa.Table.from_batches(held))
            held = [batch.slice(cut)]
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs.

    Two rows are linked if the Jaccard similarity of their word n-gram sets is the threshold or more; n_links
    counts the other linked rows, class_id is the smallest doc_id that links lead to. Rows of the same words are
    one node from the start. Texts that are null or have no words link to nothing: their class is their own id.
    A repeated row counts as a further copy; a row without an id takes part, and its class is null if no
    member has an id. An empty table gives no rows; columns besides doc_id and text aren't read.

    Candidate groups are the components of links from each band bucket to its smallest node, so buckets are
    never expanded into pairs. A group is cut into blocks, and each pair of blocks is one unit of work.
    """
    bands, rows = choose_bands(threshold, recall)
    sig = docs.select("doc_id", "text").mapInArrow(signature_batches(bands, rows), "doc_id long, h long, h2 long, bands array<long>")
    sig = written(sig.withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = sig.where("h is not null").groupBy("h", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = written(nodes, "nodes")
    firsts = sig.join(nodes.select(F.col("node").alias("row")), "row").select("row", F.explode("bands").alias("key"))
    heads = firsts.groupBy("key").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    groups = components(firsts.join(heads, "key").select(F.col("row").alias("a"), F.col("head").alias("b")))
    groups = written(groups, "groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = member.join(nodes, F.col("id") == F.col("node")).select("h", "h2", "rep", "root", "block", "blocks", "node", "copies")
    keyed = docs.select("doc_id", "text").withColumn("h", _sequence_column())
    text = keyed.join(member.withColumnRenamed("h", "mh"), (F.col("h") == F.col("mh")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    cell = text.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = cell.select("root", F.least("x", "block").alias("i"), F.greatest("x", "block").alias("j"), "block", "node", "copies", "text")
    cell = cell.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = written(cell.mapInArrow(_cells(threshold, n), "node long, other long, links long"), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.join(counts, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left")
    full = full.withColumn("root", F.coalesce("root", "node"))
    least = full.groupBy("root").agg(F.min("rep").alias("class_id"))
    full = full.join(least, "root").select("h", "h2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = sig.where("h is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sig.where("h is not null").join(full, ["h", "h2"]).select("doc_id", "class_id", "n_links").unionByName(alone)


def _sequence_column():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, at = utf8(column)
            keys = [shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])[2] for i, j in pieces(at)]
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.array(keys.view(np.int64), mask=keys == 0)

    return F.arrow_udf(run, "long").asNondeterministic()("text")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, one of each class: that of the smallest doc_id. A repeated id stays
    once; rows without an id stay."""
    found = written(jaccard_classes(docs).where("doc_id is not null"), "classes")
    drop = found.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
