"""Language-model scores from a probabilistic suffix tree over words.

The tree's root has the words' own distribution; a node is a context of the last one to DEPTH words. A context is
a child of its suffix (the context without its first word). It is kept if what follows it diverges from what its
longest kept suffix tells: the gain in log probability over all that follows it in training, each occurrence left
out of its own counts, must be over GAIN. The test is on the words themselves, and a longer context is tested
whether or not its suffix was kept. A kept context's distribution is its counts less a discount, whose mass goes
to the suffix's distribution, so each is proper over the known words and one symbol for all unknown ones. A word is
scored in the longest kept context that ends before it.

Texts are cut into chunks of bounded size, one row each. A first round gives words global numbers and counts: each chunk's
distinct words are dealt to parts by hash, and a part numbers its own, the most frequent first. Each level of the tree is then one round:

1. A chunk's distinct grams (context and next word), with their counts in its training documents, go to parts dealt
   by context. What is sent is one packed row for a chunk and part.
2. A part adds up counts over chunks, tests its contexts and answers each row in its own order: counts of
   grams, and how many kinds of words follow each kept context.
3. The chunk with its answers has the counts and probabilities of the next level.

A context with more than `hot` occurrences is dealt by gram, over all parts; its sums are added up in a table
whose size is bounded, as at most N / hot contexts are that frequent and hot is N / 2**20 at least. No step holds
the model, and no group grows with the input but through the texts' distinct grams dealt to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, mixed, packed, pieces, prefix_hash, removed, span_hash, stored, unpacked, utf8, whole_groups, words

#: Longest context, discount of each count, least count and gain (nats) of a kept context.
DEPTH, DISCOUNT, LEAST, GAIN = 2, 0.75, 2, 3.0
#: In the test, the suffix has the weight SHARE * n ** (SHARE - 1) against a context of n occurrences.
SHARE = 0.85
#: Documents whose crc32(doc_id as text) mod OF is HELD_OUT aren't learnt from.
OF, HELD_OUT = 5, 1
#: Bytes of text and documents in a chunk, words in a part, and occurrences of a context that is dealt by gram.
CHUNK, CHUNK_DOCS, PART, HOT = 4 << 20, 60_000, 1 << 19, 1 << 18
#: Steps of a log probability that is sent to the test, a nat each so many.
STEPS = 256
_END, _A, _B = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
_ROW = "kind int, chunk long, part int, data binary, docs binary"
_LISTED = _ROW + ", words binary, tokens long"
_SENT = "part int, chunk long, data binary"
_ANSWER = "kind int, chunk long, part int, data binary, docs binary, key long, n long, kinds long, gain double"


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: words lower-cased in A-Z, then one end for each row."""
    data, at = utf8(column)
    hashes, rows = [], []
    for i, j in pieces(at):
        low = lowered(data[at[i] : at[j]])
        start, end, row = words(low, at[i : j + 1] - at[i])
        key = span_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
        where = np.cumsum(np.bincount(row, minlength=j - i))
        hashes.append(np.insert(key, where, _END))
        rows.append(np.insert(row, where, np.arange(j - i)) + i)
    return (np.concatenate(hashes), np.concatenate(rows)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to one row for each chunk: its tokens as places in its list of words, its documents, and the list with counts in training."""
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 24
    number, rows, size = 0, [], 0

    def chunk() -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        held = table["held"].to_numpy()
        hashes, row = _tokens(table["text"])
        kinds, token = np.unique(hashes, return_inverse=True)
        seen = np.bincount(token[~held[row]], minlength=len(kinds))
        null = table["doc_id"].is_null().to_numpy()
        docs = packed(table["doc_id"].fill_null(0).to_numpy(), null.astype(np.int64), held.astype(np.int64), np.bincount(row, minlength=len(held)))
        cols = [pa.array([0], pa.int32()), pa.array([base + number]), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in (packed(token), docs, packed(kinds, seen))), pa.array([len(token)])]
        return pa.RecordBatch.from_arrays(cols, _names(_LISTED))

    for batch in batches:
        for i, j in pieces(utf8(batch["text"])[1], CHUNK // 4):
            for k in range(i, j, CHUNK_DOCS):
                rows.append(batch.slice(k, min(CHUNK_DOCS, j - k)))
                size += rows[-1].nbytes
                if size >= CHUNK or sum(len(x) for x in rows) >= CHUNK_DOCS:
                    yield chunk()
                    number, rows, size = number + 1, [], 0
    if rows:
        yield chunk()


def _segments(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of each run of equal parts."""
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(part[a]), a, b


def _sent(number: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 1024):
        part, data = zip(*rows[a : a + 1024], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([number] * len(part), pa.int64()), pa.array(data, pa.binary())], _names(_SENT))


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Places by part, in order within each; numpy sorts numbers of 16 bits by radix."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def _by_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of small numbers by pair, in order within each, and where each pair starts in them."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    low, place = (np.uint64(int(x).bit_length()) for x in (b.max(), n))
    if int(a.max()).bit_length() + int(low + place) <= 64:  # pair and place are one number, which is sorted by itself
        key = (a.astype(np.uint64) << low | b.astype(np.uint64)) << place | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int32)
        key >>= place
    else:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _word_parts(words: bytes, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts, order by part, and parts in that order, of a chunk's words."""
    hashes, seen = unpacked(words)
    part = (mixed(hashes.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = _by_part(part, parts)
    return hashes, seen, order, part[order]


def _word_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words in zip(batch["chunk"].to_pylist(), batch["words"], strict=True):
                hashes, seen, order, part = _word_parts(words.as_py(), parts)
                yield from _sent(number, [(p, packed(hashes[order[a:b]], seen[order[a:b]])) for p, a, b in _segments(part)])

    return run


def _answers(rows: list[dict]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    empty = {"chunk": 0, "part": 0, "data": None, "docs": None, "key": 0, "n": 0, "kinds": 0, "gain": 0.0}
    return pa.RecordBatch.from_arrays([pa.array([(empty | r)[c] for r in rows], t) for c, t in zip(_names(_ANSWER), types, strict=True)], _names(_ANSWER))


def _in_parts(one: Callable[[int, list[int], list[list[np.ndarray]]], Iterator[dict]]):
    """Rows sorted by part, to what one() makes of each whole part: answers in rows of some hundred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"]):
            for part, a, b in _segments(table["part"].to_numpy()):
                own, held = table.slice(a, b - a), []
                for row in one(part, own["chunk"].to_pylist(), [unpacked(x.as_py()) for x in own["data"]]):
                    held.append(row)
                    if len(held) == 256:
                        yield _answers(held)
                        held = []
                if held:
                    yield _answers(held)

    return run


def _numbers(parts: int, hot: int):
    """A part's words numbered, the most frequent first, and 0 for those that training lacks. Kind 0 answers, -3 has the sums,
    -2 the words that are contexts with more than `hot` occurrences."""

    def one(part: int, chunks: list[int], sent: list[list[np.ndarray]]) -> Iterator[dict]:
        own, inverse = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([x[1] for x in sent]), minlength=len(own)).astype(np.int64)
        order = np.lexsort((own, -count))
        number = np.empty(len(own), np.int64)
        number[order] = np.arange(len(own)) * parts + part + 1
        number[count == 0] = 0
        yield {"kind": -3, "n": int(count.sum()), "kinds": int((count > 0).sum())}
        for k in np.flatnonzero(count > hot):
            yield {"kind": -2, "key": int(_word_hash(number[k : k + 1]).view(np.int64)[0]), "n": int(count[k])}
        at = 0
        for chunk, x in zip(chunks, sent, strict=True):
            i = inverse[at : at + len(x[0])]
            yield {"kind": 1, "chunk": chunk, "part": part, "data": packed(number[i], count[i])}
            at += len(i)

    return _in_parts(one)


def _word_hash(number: np.ndarray) -> np.ndarray:
    return mixed(number.astype(np.uint64) * _B + _A)


def _numbered(parts: int):
    """A chunk's row and its answers, to the row with numbers and counts of its words; tokens become places in the sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["chunk"]):
            for chunk, a, b in _segments(table["chunk"].to_numpy()):
                rows = table.slice(a, b - a)
                head, answers = rows.slice(0, 1), [unpacked(x.as_py()) for x in rows["data"].slice(1)]
                (token,) = unpacked(head["data"][0].as_py())
                order = _word_parts(head["words"][0].as_py(), parts)[2]
                number, count = (np.concatenate([x[k] for x in answers]) for k in (0, 1))
                have, place = np.unique(number, return_inverse=True)
                counts, to = np.empty(len(have), np.int64), np.empty(len(order), np.int64)
                counts[place], to[order] = count, place
                cols = [pa.array([0], pa.int32()), pa.array([chunk], pa.int64()), pa.array([0], pa.int32())]
                cols += [pa.array([packed(have, counts, to[token])], pa.binary()), pa.array([head["docs"][0].as_py()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, _names(_ROW))

    return run


class _Chunk:
    """A chunk's tokens and, level by level, the counts and probabilities that the answers give."""

    def __init__(self, data: bytes, docs: bytes, total: int, kinds: int, hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int):
        self.ids, self.counts, self.token = unpacked(data)
        self.doc_id, self.null, self.held, self.size = unpacked(docs)
        self.hot, self.parts = hot, parts
        self.token = self.token.astype(np.int32)
        self.row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.place = np.arange(len(self.token), dtype=np.int32) - np.repeat((np.cumsum(self.size) - self.size).astype(np.int32), self.size)
        self.train = np.repeat(self.held == 0, self.size)
        rest = DISCOUNT * kinds / total if total else 1.0
        c = self.counts
        self.p = np.where(c > 0, (c - DISCOUNT) / max(total, 1), rest)[self.token]
        # of the gram that ends at each token: its place among the chunk's grams, their hashes, and its count in training
        self.gram, self.hashes, self.seen = self.token, _word_hash(self.ids), c[self.token]

    def deal(self, level: int) -> None:
        """Grams of contexts of so many words that training has LEAST times, in the order in which they are sent."""
        if level > 1:
            gram, seen = np.zeros(len(self.token), np.int32), np.zeros(len(self.token), np.int64)
            gram[self.at], seen[self.at] = self.inverse, self.found[self.inverse]
            self.gram, self.hashes, self.seen = gram, self.next, seen
        self.at = np.flatnonzero((self.place[1:] >= level) & (self.seen[:-1] >= LEAST)) + 1
        context, word = self.gram[self.at - 1], self.token[self.at]
        order, start = _by_pair(context, word)
        first = order[start]
        context, word = context[first], word[first]
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([head, [len(context)]]))
        of = self.hashes[context[head]]
        above = np.repeat(of, size)
        gram = mixed(np.repeat(of * _A, size) + self.ids[word].astype(np.uint64))
        part = np.repeat((mixed(of + _B) % np.uint64(self.parts)).astype(np.int32), size)
        hot = np.zeros(len(of), bool)
        if len(keys := self.hot[level][0]):
            hot = keys[np.minimum(np.searchsorted(keys, of), len(keys) - 1)] == of
        hot = np.repeat(hot, size)
        part[hot] = mixed(gram[hot] + _B) % np.uint64(self.parts)
        by = _by_part(part, self.parts)
        back = np.empty(len(by), np.int32)
        back[by] = np.arange(len(by), dtype=np.int32)
        self.inverse = np.empty(len(order), np.int32)
        self.inverse[order] = np.repeat(back, np.diff(np.concatenate([start, [len(order)]])))
        self.above, self.next, self.word, self.part, self.is_hot, self.first = above[by], gram[by], word[by], part[by], np.flatnonzero(hot[by]), self.at[first[by]]

    def parts_sent(self) -> list[tuple[int, bytes]]:
        """For each part: contexts, how many grams each has, and the grams' words, log probabilities by the suffix, and counts."""
        out, count = [], np.bincount(self.inverse[self.train[self.at]], minlength=len(self.part))
        told = np.where(count > 0, np.rint(-np.log(np.maximum(self.p[self.first], 1e-300)) * STEPS), 0).astype(np.int64)
        for part, a, b in _segments(self.part):
            h = self.above[a:b]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([start, [b - a]]))
            out.append((part, packed(h[start], size, self.ids[self.word[a:b]], told[a:b], count[a:b])))
        return out

    def take(self, level: int, answers: list[bytes]) -> None:
        """Probabilities by this level's kept contexts, and the grams' counts; answers come in order of their parts.

        Tokens that end equal grams had one probability before: that of the context's suffix, which training has as often or more.
        """
        count = np.zeros(len(self.above), np.int64)
        kinds = np.zeros(len(self.above), np.int64)
        at = 0
        for size, of, c in map(unpacked, answers):
            count[at : at + len(c)], kinds[at : at + len(c)] = c, np.repeat(of, size)
            at += len(c)
        if at != len(count):
            raise ValueError(f"answers for {at} of {len(count)} grams")
        hot, _, of = self.hot[level]
        kinds[self.is_hot] = of[np.searchsorted(hot, self.above[self.is_hot])]
        n, p = np.maximum(self.seen[self.first - 1], 1), self.p[self.first]
        p = np.where(kinds > 0, np.maximum(count - DISCOUNT, 0) / n + DISCOUNT * kinds / n * p, p)
        self.p[self.at] = p[self.inverse]
        self.found = count


def _chunks(batches: Iterator[pa.RecordBatch], levels: int, make: Callable[[bytes, bytes], _Chunk]) -> Iterator[tuple[int, _Chunk]]:
    """Each chunk after so many levels; its rows come together, the chunk itself first and answers by level and part."""
    for table in whole_groups(batches, ["chunk"]):
        rows = table.to_pydict()
        start = [i for i, k in enumerate(rows["kind"]) if k == 0]
        for a, b in zip(start, [*start[1:], table.num_rows], strict=True):
            chunk = make(rows["data"][a], rows["docs"][a])
            for level in range(1, levels + 1):
                chunk.deal(level)
                chunk.take(level, [rows["data"][i] for i in range(a + 1, b) if rows["kind"][i] == level])
            yield rows["chunk"][a], chunk


def _summed(level: int, hot: tuple[np.ndarray, np.ndarray], hot_from: int):
    """Rows of a part to answers (kind: the level), partial sums of hot contexts (-1) and grams that are hot contexts of the next level (-2)."""

    def one(part: int, chunks: list[int], sent: list[list[np.ndarray]]) -> Iterator[dict]:
        context = np.concatenate([np.repeat(x[0].view(np.uint64), x[1]) for x in sent])
        word, told, count = (np.concatenate([x[k] for x in sent]) for k in (2, 3, 4))
        gram = mixed(context * _A + word.astype(np.uint64))
        order = np.argsort(gram)
        ordered = gram[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        c = np.add.reduceat(count[order], first)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        p = np.exp(-np.maximum.reduceat(told[order], first) / STEPS)
        own, inverse = np.unique(context[order[first]], return_inverse=True)
        n = np.bincount(inverse, c, minlength=len(own))
        kinds = np.bincount(inverse[c > 0], minlength=len(own))
        is_hot = np.zeros(len(own), bool)
        if len(hot[0]):
            i = np.minimum(np.searchsorted(hot[0], own), len(hot[0]) - 1)
            is_hot = hot[0][i] == own
            n[is_hot] = hot[1][i[is_hot]]
        m = n[inverse]
        share = SHARE * np.maximum(m, 1) ** (SHARE - 1)
        left = (1 - share) * np.maximum(c - 1, 0) / np.maximum(m - 1, 1) + share * p
        gain = np.bincount(inverse, np.where(c > 0, c * np.log(left / p), 0), minlength=len(own))
        for k in np.flatnonzero(is_hot):
            yield {"kind": -1, "key": int(own[k].view(np.int64)), "n": int(n[k]), "kinds": int(kinds[k]), "gain": float(gain[k])}
        for k in np.flatnonzero(c > hot_from):
            yield {"kind": -2, "key": int(gram[order[first[k]]].view(np.int64)), "n": int(c[k])}
        kept = np.where((gain > GAIN) & (n >= LEAST) & ~is_hot, kinds, 0)
        at = 0
        for chunk, x in zip(chunks, sent, strict=True):
            g = of[at : at + len(x[2])]
            heads = g[np.cumsum(x[1]) - x[1]]
            yield {"kind": level, "chunk": chunk, "part": part, "data": packed(x[1], kept[inverse[heads]], c[g])}
            at += len(x[2])

    return _in_parts(one)


def _hot(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of contexts that are dealt by gram: N / hot at most, and 2**20 whatever N is."""
    rows = table.where("kind = -2").select("key", "n").collect()
    key = np.array([r.key for r in rows], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r.n for r in rows], np.int64)[order]


def score(docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Scores are log10 probabilities of all tokens, the end included; words not seen in training are one symbol. A
    null text is empty: its end alone. Repeated rows are learnt from and scored each; a null doc_id is not
    held out and stays null. Without training tokens both scores are of the unknown symbol alone. An empty table
    gives no rows; other columns aren't read. depth is the longest context, hot the occurrences from which a
    context is dealt by gram, which changes no result.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % OF == HELD_OUT, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    listed, listed_at = stored(source.mapInArrow(_listed, _LISTED), "listed")
    rows, tokens = listed.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts, hot_from = max(1, tokens // PART), max(hot, tokens >> 20)

    words = listed.select("chunk", "words").mapInArrow(_word_rows(parts), _SENT).repartition(parts, "part").sortWithinPartitions("part", "chunk")
    table, words_at = stored(words.mapInArrow(_numbers(parts, hot_from), _ANSWER), "words")
    total, kinds = table.where("kind = -3").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    both = listed.drop("tokens").unionByName(table.where("kind = 1").select(*_names(_ROW)), allowMissingColumns=True)
    chunks, _ = stored(_together(both, rows).mapInArrow(_numbered(parts), _ROW), "chunks")
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {1: (*_hot(table), np.zeros(0, np.int64))}
    levels = depth if total else 0
    removed(spark, listed_at)
    removed(spark, words_at)

    def make(known: dict) -> Callable[[bytes, bytes], _Chunk]:
        return lambda data, docs: _Chunk(data, docs, total, kinds, known, parts)

    answers = chunks
    for level in range(1, levels + 1):
        step = dict(known)

        def send(batches: Iterator[pa.RecordBatch], level: int = level, step: dict = step) -> Iterator[pa.RecordBatch]:
            for number, chunk in _chunks(batches, level - 1, make(step)):
                chunk.deal(level)
                yield from _sent(number, chunk.parts_sent())

        together = answers if level == 1 else _together(answers, rows)
        dealt = together.mapInArrow(send, _SENT).repartition(parts, "part").sortWithinPartitions("part", "chunk")
        table, _ = stored(dealt.mapInArrow(_summed(level, known[level][:2], hot_from), _ANSWER), f"answers-{level}")
        sums = table.where("kind = -1").groupBy("key").agg(F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain"), F.max("n").alias("n")).collect()
        of = {r.key: r.kinds if r.gain > GAIN and r.n >= LEAST else 0 for r in sums}
        keys, n, _ = known[level]
        known[level] = keys, n, np.array([of.get(int(k), 0) for k in keys.view(np.int64)], np.int64)
        known[level + 1] = *_hot(table), np.zeros(0, np.int64)
        answers = answers.unionByName(table.where("kind > 0").select(*chunks.columns))

    below = float(np.log10(total + 0.5 * (kinds + 1)))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches, levels, make(known)):
            c, size = chunk.counts[chunk.token], len(chunk.size)
            base = np.bincount(chunk.row, (np.log10(chunk.counts + 0.5) - below)[chunk.token], minlength=size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.doc_id, mask=chunk.null == 1), pa.array(chunk.held == 1), pa.array(chunk.size), pa.array(np.bincount(chunk.row[c > 0], minlength=size)),
                    pa.array(np.full(size, total)), pa.array(base), pa.array(np.bincount(chunk.row, np.log10(chunk.p), minlength=size)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (_together(answers, rows) if levels else answers).mapInArrow(result, schema)


def _together(answers: DataFrame, rows: int) -> DataFrame:
    """Each chunk followed by its answers by level and part; two chunks to a task or so."""
    return answers.repartition(max(1, rows // 2), "chunk").sortWithinPartitions("chunk", "kind", "part")
