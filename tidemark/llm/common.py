"""What the operators share: shared storage, texts as numpy bytes, rolling hashes, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers treat at once. Only a single longer text makes a larger piece.
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a local run has a temporary folder; on a
    cluster, whose executors would not see that, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (have := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = have.get()
    return where.rstrip("/")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The DataFrame as a Parquet table in the shared folder, which cuts its lineage and survives lost executors; and where it is."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers of 64 bits: each cut to the bytes that its largest value needs, byte plane by byte plane, and compressed together."""
    parts, about = [], [len(arrays)]
    for x in arrays:
        x = np.ascontiguousarray(x).view(np.uint64) if x.dtype.itemsize == 8 else x.astype(np.uint64)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        about += [len(x), width]
        parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array(about, "<i8").tobytes() + pa.Codec("zstd").compress(b"".join(parts), asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    about = np.frombuffer(data, "<i8", 1 + 2 * count)[1:].reshape(-1, 2)
    size = int((about[:, 0] * about[:, 1]).sum())
    flat = np.frombuffer(pa.Codec("zstd").decompress(data[8 * (1 + 2 * count) :], size, asbytes=True), np.uint8)
    out, at = [], 0
    for n, width in about.tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = flat[at : at + n * width].reshape(width, n).T
        out.append(wide.reshape(-1).view("<i8"))
        at += n * width
    return out


# ---------------------------------------------------------------- texts as bytes


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a column of strings; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def pieces(at: np.ndarray, most: int = PIECE):
    """Ranges of rows of at most so many bytes, of a single row if that alone is longer."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the low bits and the order of hashes look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, PIECE + 1), b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash() gives the hash of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, equal for equal bytes wherever they lie."""
    return mixed((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def window_hash(data: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k bytes from each position, for all positions that have them. `prefix`: their prefix_hash(), if it is at hand."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(data) if prefix is None else prefix
    return mixed((p[k:] - p[:-k]) * _powers(len(p))[1][:n])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than space and x09 to x0D; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = np.flatnonzero(ink & (first[:-1] | np.concatenate([[True], ~ink[:-1]])))
    end = np.flatnonzero(ink & (first[1:] | np.concatenate([~ink[1:], [True]]))) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, root), root the smallest id that can be reached; ids without links have no row.

    Large-star and small-star rounds: every node's neighbours are hung on the smallest of them, until
    nothing changes; an error if `rounds` don't suffice, which takes chains of 2**30 nodes or so. A round has two
    grouped minima, whose partial sums spare hubs, and is stored once.
    """
    spark = edges.sparkSession
    links, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*")
        links, new = stored(small.where("a <> b").distinct(), "links")
        removed(spark, path)
        path = new
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups, from record batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cut = max((int(f[-1]) + 1 for k in key if len(f := np.flatnonzero(k != k[-1]))), default=0)
        if cut or len(held) > 1 and any(held[0][k][-1] != batch[k][0] for k in keys):
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)
