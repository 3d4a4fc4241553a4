"""Harmonic packing: pieces in reciprocal-capacity classes, each class's bins filled with a fixed number of pieces.

Class k holds the pieces of over capacity / (k + 1) and up to capacity / k tokens, and a bin of class k holds k of them. Whole bins
are cut off a document first. What is left goes into its class whole if k such pieces fill a bin but for one in ``SLACK`` of it;
else a piece of capacity / (k + 1) tokens, of which k + 1 fill a bin, is cut off, and what is left then is dealt with alike. So a document is cut into two or
three pieces beyond its whole bins, and a bin's padding is below one in SLACK.

Each task fills its own bins and needs nothing of other tasks. At its end the pieces of open bins are laid one behind the other
into sequences, cut where one is full, and the last sequence is cut into powers of two, which need no padding. No shuffle is made, a task holds
one batch and less than a sequence's worth of open pieces a class, and a repeated task gives the same rows.

Null text is an empty text: a document of the end id alone. Equal rows are packed as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordids import CACHE_WORDS, word_ids


#: A bin may be padded by less than one in SLACK of its capacity.
SLACK = 64


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(piece length, class) of a document's pieces, in order."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        waste = capacity - k * rest
        size, k = (rest, k) if waste * SLACK < capacity or waste <= capacity % (k + 1) else (capacity // (k + 1), k + 1)
        out.append((size, k))
        rest -= size
    return out


def pack_lengths(lengths: list[tuple], capacity: int):
    """Reference form on a list of (doc, length): (doc, start, length, sequence, offset). The Arrow form streams the same."""
    packer = _Packer(capacity, 0)
    out = []
    for doc, n in lengths:
        out += packer.add(doc, b"\0" * 4 * n)
    out += packer.close()
    return [(d, s, n, q, o) for d, s, n, _, _, q, o in out]


class _Packer:
    """Open bins of one task. Sequence ids: task number << 36, then a running number."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next = capacity, task << 36
        self.open: dict[int, list] = {}

    def _emit(self, pieces: list) -> list:
        out, at = [], 0
        for doc, start, size, ids, total in pieces:
            out.append((doc, start, size, ids, total, self.next, at))
            at += size
        self.next += 1
        return out

    def add(self, doc, ids: bytes) -> list:
        out, start, total = [], 0, len(ids) // 4
        for size, k in cut(total, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, size, ids[4 * start : 4 * (start + size)], total))
            if len(bin_) == k:
                out += self._emit(bin_)
                del self.open[k]
            start += size
        return out

    def close(self) -> list:
        rest = [piece for _, bin_ in sorted(self.open.items()) for piece in bin_]
        self.open, out, now = {}, [], []
        size = sum(n for _, _, n, _, _ in rest)
        goal = self._whole(size)
        for doc, start, n, ids, total in rest:
            at = 0
            while at < n:
                part = min(n - at, goal)
                now.append((doc, start + at, part, ids[4 * at : 4 * (at + part)], total))
                at, goal, size = at + part, goal - part, size - part
                if not goal:
                    out += self._emit(now)
                    now, goal = [], self._whole(size)
        return out

    def _whole(self, size: int) -> int:
        """Length of the next sequence when ``size`` tokens are left: a full one, or the greatest power of two."""
        return self.capacity if size >= self.capacity else 1 << (size.bit_length() - 1) if size else 0


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    cache_words: words whose ids a Python worker keeps, at about 200 bytes each; it has no bearing on results."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, encode = _Packer(capacity, TaskContext.get().partitionId()), word_ids(tokenizer, cache_words)

        def rows(found: list) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(found), 20_000):
                cols = list(zip(*found[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    out += packer.add(doc, ids + end)
                yield from rows(out)
        yield from rows(packer.close())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
