"""Product-quantised codes of vectors by Yinyang Lloyd rounds: groups of codebook entries with a lower bound each, ties decided on integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored, unused

#: Parts of a vector, entries of a codebook, rounds, and the whole numbers that a component's unit has.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of a codebook's entries, and vectors that a task treats at once.
GROUPS, ROWS = 16, 4096
#: Bounds are kept as floats and loosened by this share, far more than they can be off.
LOOSE = 1e-5
#: Scaled components beyond this would not fit a long once they are squared and summed.
LARGEST = 1 << 27

_KEPT = "vec_id long, label {label}, v array<int>"
_STATE = _KEPT + ", code binary, upper array<float>, lower array<float>"


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a column of lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), size


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a whole finite vector, its components as floor(SCALE * x)."""
    for batch in batches:
        batch = batch.filter(batch["embedding"].is_valid())
        if not batch.num_rows:
            continue
        flat, size = _vectors(batch["embedding"])
        flat = flat.astype(np.float64)  # a null component becomes a NaN
        row = np.repeat(np.arange(len(size)), size)
        good = np.bincount(row, ~np.isfinite(flat), len(size)) == 0
        whole = np.floor(flat[good[row]] * SCALE)
        if len(whole) and np.abs(whole).max() > LARGEST:
            raise ValueError(f"components beyond {LARGEST // SCALE} have no distances that fit a long")
        at = np.concatenate([[0], np.cumsum(size[good])]).astype(np.int32)
        batch = batch.filter(pa.array(good))
        v = pa.ListArray.from_arrays(pa.array(at), pa.array(whole.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], v], ["vec_id", "label", "v"])


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to their entries, in integers."""
    d = x.astype(np.int64) - entries
    return np.einsum("ij,ij->i", d, d)


def two_nearest(x: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the nearest of the entries `among` (ties: the lowest), its squared distance in integers, and about the distance of the second.

    The search is by floats; all entries as near as rounding can tell are compared in integers.
    """
    xf, c = x.astype(np.float64), book[among].astype(np.float64)
    own = np.einsum("ij,ij->i", xf, xf)
    norm = np.einsum("ij,ij->i", c, c)
    d = own[:, None] - 2 * (xf @ c.T) + norm
    slack = (own + norm.max()) * 2.0**-44
    row, col = np.nonzero(d <= (d.min(1) + 2 * slack)[:, None])
    true = exact(x[row], book[among[col]])
    order = np.lexsort((among[col], true, row))
    first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
    best, square = col[first], true[first]
    d[np.arange(len(x)), best] = np.inf
    second = np.sqrt(np.maximum(d.min(1) - slack, 0))  # inf if there is but one
    return among[best], square, second


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, code: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries (ties: the lowest), an upper bound of their distance and lower ones of each group's other entries.

    code, upper, lower: those of the round before, None without one; moved: how far each entry has moved since. A group is
    scanned only where its bound, less the drift of its entries, isn't over the distance to the entry held so far.
    Also returns how many groups were scanned.
    """
    n, groups = len(x), lower.shape[1]
    if code is None:
        code, square = np.zeros(n, np.int64), exact(x, book[np.zeros(n, np.int64)])
        need = np.ones((n, groups), bool)
        lower = np.zeros((n, groups))
    else:
        drift = np.zeros(groups)
        np.maximum.at(drift, group, moved)
        lower = np.maximum(lower - drift, 0) * (1 - LOOSE)
        upper = (upper + moved[code]) * (1 + LOOSE)
        tight = np.flatnonzero(lower.min(1) <= upper)
        square = np.full(n, -1, np.int64)
        square[tight] = exact(x[tight], book[code[tight]])
        upper[tight] = np.sqrt(square[tight])
        need = lower <= (upper * (1 + LOOSE))[:, None]
        need &= (square >= 0)[:, None]
    held, held_square = code.copy(), square.copy()
    seconds = np.full((n, groups), np.inf)
    winners, winner_square = np.full((n, groups), -1), np.zeros((n, groups), np.int64)
    for g in range(groups):
        rows = np.flatnonzero(need[:, g])
        among = np.flatnonzero(group == g)
        if not len(rows) or not len(among):
            continue
        best, own, second = two_nearest(x[rows], book, among)
        winners[rows, g], winner_square[rows, g], seconds[rows, g] = best, own, second
        better = (own < square[rows]) | ((own == square[rows]) & (best < code[rows]))
        code[rows[better]], square[rows[better]] = best[better], own[better]
    scanned = winners >= 0
    away = np.where(scanned & (winners == code[:, None]), seconds, np.sqrt(winner_square.astype(np.float64)) * (1 - LOOSE))
    lower = np.where(scanned, away, lower)
    left = np.flatnonzero(code != held)  # the entry held before counts among its group's others now
    lower[left, group[held[left]]] = np.minimum(lower[left, group[held[left]]], np.sqrt(held_square[left].astype(np.float64)) * (1 - LOOSE))
    known = square >= 0
    upper = np.where(known, np.sqrt(np.maximum(square, 0).astype(np.float64)) * (1 + LOOSE), upper)
    return code, upper, np.where(np.isfinite(lower), lower, 1e30), int(need.sum())


def grouped(book: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry: a few rounds of plain clustering of a codebook; groups can be empty."""
    c = book.astype(np.float64)
    k = max(1, min(groups, len(c)))
    centre = c[np.linspace(0, len(c) - 1, k).astype(int)]
    for _ in range(5):
        of = ((c[:, None] - centre) ** 2).sum(2).argmin(1)
        centre = np.stack([c[of == g].mean(0) if (of == g).any() else centre[g] for g in range(k)])
    return of


def _step(books: list[np.ndarray], groups: list[np.ndarray], moved: list[np.ndarray] | None, size: int):
    """A round of assignments over stored rows. moved is None in the first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                n = batch.num_rows
                x = _vectors(batch["v"])[0].reshape(n, PARTS, size)
                if moved is not None:
                    codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                    uppers = _vectors(batch["upper"])[0].reshape(n, PARTS).astype(np.float64)
                    lowers = _vectors(batch["lower"])[0].reshape(n, PARTS, -1).astype(np.float64)
                out = []
                for p in range(PARTS):
                    k = int(groups[p].max()) + 1
                    before = (None, np.zeros(n), np.zeros((n, k)), None) if moved is None else (codes[:, p], uppers[:, p], lowers[:, p, :k], moved[p])
                    out.append(assign(x[:, p], books[p], groups[p], *before))
                code = np.stack([o[0] for o in out], 1).astype(np.uint8)
                upper = np.stack([o[1] for o in out], 1).astype(np.float32)
                lower = np.zeros((n, PARTS, GROUPS), np.float32)
                for p, o in enumerate(out):
                    lower[:, p, : o[2].shape[1]] = o[2]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.size // n, dtype=np.int32)), pa.array(m.ravel())) for m in (upper, lower)]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], pa.array([bytes(c) for c in code], pa.binary()), *lists], ["vec_id", "label", "v", "code", "upper", "lower"])

    return step


def _sums(size: int):
    """A task's sums and counts of the parts of each entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS * ENTRIES, size), np.int64), np.zeros(PARTS * ENTRIES, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _vectors(batch["v"])[0].reshape(n * PARTS, size).astype(np.int64)
            entry = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64) + np.arange(PARTS) * ENTRIES
            order = np.argsort(entry.ravel(), kind="stable")
            sorted_ = entry.ravel()[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            total[sorted_[first]] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(entry.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        if len(used):
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * size + 1, size or 1, dtype=np.int32) if size else np.zeros(len(used) + 1, np.int32)), pa.array(total[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), rows], ["entry", "n", "total"])

    return sums


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def fit(vectors: DataFrame) -> tuple[list[np.ndarray], DataFrame] | None:
    """The final codebooks of PARTS parts, and the stored state of the last round's assignments; None without a vector.

    vectors: stored rows of (vec_id, label, v). Only codebooks and the sums of their entries, ENTRIES rows a part, come to the driver.
    """
    spark, label = vectors.sparkSession, vectors.schema["label"].dataType.simpleString()
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return None
    shape = vectors.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if shape.a != shape.b or shape.b % PARTS:
        raise ValueError(f"vectors of one length, a multiple of {PARTS}, are asked for: {shape.a} to {shape.b} components found")
    size = shape.b // PARTS
    start = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, size)
    books = [start[:, p] for p in range(PARTS)]
    groups = [grouped(b) for b in books]
    state, moved, path = vectors, None, None
    for _ in range(ROUNDS):
        state, new = stored(state.mapInArrow(_step(books, groups, moved, size), _STATE.format(label=label)), "op11-state")
        if path:
            removed(spark, path)
        path = new
        sums = state.select("v", "code").mapInArrow(_sums(size), "entry int, n long, total array<long>")
        columns = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]
        before, books = books, [b.copy() for b in books]
        for r in sums.groupBy("entry").agg(F.sum("n").alias("n"), *columns).collect():
            books[r.entry // ENTRIES][r.entry % ENTRIES] = [r[f"t{i}"] // r.n for i in range(size)]
        moved = [np.sqrt(exact(a, b).astype(np.float64)) * (1 + LOOSE) for a, b in zip(before, books, strict=True)]
    last = _step(books, groups, moved, size)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in last(batches):
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, PARTS)
            x = _vectors(batch["v"])[0].reshape(n, PARTS, size)
            error = sum(exact(x[:, p], books[p][codes[:, p]]) for p in range(PARTS))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([bytes(c).hex() for c in codes]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return books, state.mapInArrow(finish, f"vec_id long, label {label}, code string, error long")


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of embeddings with a whole finite vector.

    Rows without a vector, or with a null, infinite or undefined component, go. A null vec_id sorts after all others, equal ones by their vector; repeated
    rows each have a row. With fewer than ENTRIES vectors there are as many entries. Vectors of no components have code 0 and no error. Vectors of several
    lengths, or of one that isn't a multiple of PARTS, are an error, as are components beyond LARGEST / SCALE. Other columns aren't read; an empty table
    gives no rows.
    """
    spark = embeddings.sparkSession
    label = embeddings.schema["label"].dataType.simpleString()
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kept, _ = stored(vectors.mapInArrow(scaled, _KEPT.format(label=label)), "op11-vectors")
    found = fit(kept)
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, codes = found
    codes, _ = stored(codes, "op11-codes")
    (of,) = unused(codes, "of")
    by = codes.groupBy(F.col("label").alias(of)).agg(F.sum("error").alias("label_error"))
    joined = codes.join(by, F.col("label").eqNullSafe(F.col(of)))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    out = [
        f"""WITH RECURSIVE kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS id, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
part AS MATERIALIZED (SELECT id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, x AS c, list_inner_product(x, x) AS cc FROM part WHERE id <= {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        out.append(
            f"""a{i} AS MATERIALIZED (SELECT id, p, any_value(x) AS x, min(d * {ENTRIES} + e) // {ENTRIES} AS d, (min(d * {ENTRIES} + e) % {ENTRIES})::INTEGER AS e FROM
  (SELECT id, p, x, e, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + cc)::BIGINT AS d FROM part JOIN b{i} USING (p)) GROUP BY id, p)"""
        )
        if i < ROUNDS:
            out.append(
                f"""u{i} AS (SELECT p, e, list(m ORDER BY k) AS c FROM (SELECT p, e, k, floor(sum(x[k])::DOUBLE / count(*)) AS m FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) GROUP BY p, e, k) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.c, b.c) AS c, list_inner_product(coalesce(u.c, b.c), coalesce(u.c, b.c)) AS cc FROM b{i} b LEFT JOIN u{i} u USING (p, e))"""
            )
    out.append(
        f"""coded AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(c, lambda y: y::BIGINT), ',') AS x FROM b{ROUNDS}))"""
    )
    return ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (id), book"


ORACLE = _sql()
