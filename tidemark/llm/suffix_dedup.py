r"""Exact substring dedup with suffix arrays, sharded by content.

In every ``width`` bytes of text the eight bytes with the least hash are the string's anchor; equal strings have equal anchors at
equal places. Neighbouring strings with one anchor, whose distances to it fall into one class of ``REACH``, are a unit: they hold
``width - REACH + 1`` bytes in common, whose hash ``h`` is the unit's bucket, so equal strings stand in units of one bucket. Units,
not texts, go to the buckets:

1. Find the hashes that occur twice or more. Tasks send them to the reducers as sorted arrays, one row for a part of all hashes.
2. Write the places of units with such hashes (cuckoo filters, sent to the tasks while they are small, else a join), and sum equal
   units to their least doc_id, in every task first, so a passage of a third of all documents is one row.
   Units that share no longer stretch (``width - STEP + 1`` bytes) with another unit of their bucket share no string with it, and
   need no sorting.
3. In each bucket the other distinct units are sorted by a suffix array (linear grouping by Lyndon prefixes, ``gsaca``);
   suffixes with ``width`` bytes in common are neighbours there, and each such class gets its least doc_id. Buckets of over
   ``BUCKET`` distinct units are sorted in chunks, and the chunks' classes, a row for each distinct string, are summed in a shuffle.
4. Units' least doc_ids meet the places: every string that also starts in a smaller doc_id is covered, and the covered
   bytes are taken out. Strings are judged on the input.

Null text is empty; texts shorter than ``width`` bytes lose nothing. Documents with equal doc_id never cover each other, and rows
with a null doc_id neither cover nor lose anything. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, TEXT_ROWS, discard, materialize, own_job, table, utf8
from .cuckoo import CuckooFilter
from .gsaca import bucket_classes

ANCHOR, REACH, STEP = 8, 15, 5
#: Distinct units of a bucket that one task sorts together, and bytes of units of small buckets that are sorted in one go.
BUCKET, TOGETHER = 4000, 1 << 17
KEYS_PER_SHARD = 1_000_000
#: Bytes of text whose units are made at once; texts whose places are made at once; hashes that a task holds; bytes of text a reducer's part stands for.
BLOCK, TEXTS, HELD, PART_BYTES = 1 << 18, 200, 1 << 22, 32 << 20
#: Large buckets whose numbers of chunks are sent to all tasks, at most.
LARGE_LIMIT = 1_000_000
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _loads(buffer: bytes) -> np.ndarray:
    """The eight bytes at every place of a buffer, as numbers."""
    out = np.empty(len(buffer) - 7, np.uint64)
    for r in range(min(8, len(out))):
        out[r::8] = np.frombuffer(buffer, "<u8", (len(buffer) - r) // 8, r)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _R2
    h = (h ^ (h >> np.uint64(29))) * _R1
    return h ^ (h >> np.uint64(32))


def _hash(x: np.ndarray, at: np.ndarray, size: int, more: np.ndarray | None = None, most: int = 0, seed: int = 0) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place on, and ``more`` (``most`` at most) after them, given the loads of the buffer."""
    h = np.full(len(at), np.uint64(0x165667B19E3779F9 + seed))
    end = at + size if more is None else at + size + more
    with np.errstate(over="ignore"):
        for o in range(0, size - 7, 8):
            h = (h ^ (h >> np.uint64(30))) * _R2 + x[at + o] * _R1
        for o in range(-(-(size % 8 + most) // 8), 0, -1):  # the rest ends with the bytes; loads may overlap
            h = (h ^ (h >> np.uint64(30))) * _R2 + x[end - 8 * o] * _R1
        return _mixed(h if more is None else h * _R2 + more.astype(np.uint64))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Loads of texts one behind the other, and where each starts."""
    return _loads(b"".join(texts) + bytes(15)), np.cumsum([0, *map(len, texts)])[:-1]


def unit_hash(x: np.ndarray, at: np.ndarray, strings: np.ndarray, width: int) -> np.ndarray:
    """Hash of all bytes of units, by the place of their first byte and their number of strings, REACH at most."""
    return _hash(x, at, width, np.asarray(strings, np.int64) - 1, REACH - 1).view(np.int64)


def _block_units(parts: list[tuple[int, int, bytes]], width: int, keep: Callable | None, whole: bool) -> dict[str, np.ndarray]:
    x, first = _joined([p for *_, p in parts])
    sizes = np.array([len(p) for *_, p in parts])
    n, span = int(sizes.sum()) - width + 1, width - ANCHOR + 1
    with np.errstate(over="ignore"):
        order = np.ascontiguousarray((x[: n + span - 1] * _R1).view(np.uint32)[1::2])
    m, have = order, 1
    while 2 * have <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[:n], m[span - have : span - have + n])
    # a run of strings ends where the least hash changes, or where its anchor leaves the string and an equal one further on takes over
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[1:] |= order[: n - 1] == m[:-1]
    stop = first + sizes - width + 1  # strings from here on leave the part
    new[first] = True
    new[stop[:-1]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, n])
    part = np.searchsorted(first, start, "right") - 1
    ok = start < stop[part]
    start, count, part = start[ok], count[ok], part[ok]
    anchor = start + (np.lib.stride_tricks.sliding_window_view(order, span)[start] == m[start][:, None]).argmax(1)
    # a unit for each class of distances in a run; distances fall from one string to the next
    far = anchor - start
    near = far - count + 1
    reps = far // REACH - near // REACH + 1
    of = np.repeat(np.arange(len(start)), reps)
    kind = far[of] // REACH - (np.arange(len(of)) - np.repeat(np.cumsum(reps) - reps, reps))
    far, near, anchor, part = np.minimum(far[of], kind * REACH + REACH - 1), np.maximum(near[of], kind * REACH), anchor[of], part[of]
    h = _hash(x, anchor - kind * REACH, width - REACH + 1)
    with np.errstate(over="ignore"):
        h = _mixed(h + kind.astype(np.uint64))
    # the low 16 bits are left out: 48 tell buckets apart, and take less room in shuffles
    h = (h & ~np.uint64(0xFFFF)).view(np.int64)
    if not whole:
        return {"h": h}
    if keep is not None:
        hit = np.flatnonzero(keep(h))
        h, far, near, anchor, part, kind = h[hit], far[hit], near[hit], anchor[hit], part[hit], kind[hit]
    at, strings = anchor - far, far - near + 1
    sk = np.zeros(len(h), np.int64)
    for s in range(-(-REACH // STEP)):  # 21 bits for each stretch that some string of the unit holds; nought where none does
        low = kind * REACH + s * STEP
        have = np.flatnonzero((near < low + STEP) & (far >= low))
        key = _hash(x, anchor[have] - low[have], width - STEP + 1, seed=1 + s) >> np.uint64(43)
        sk[have] |= np.maximum(key, np.uint64(1)).astype(np.int64) << (21 * s)
    number, offset = np.array([k for k, *_ in parts]), np.array([o for _, o, _ in parts])
    return {"of": number[part], "start": at - first[part] + offset[part], "strings": strings, "h": h, "sk": sk, "k": unit_hash(x, at, strings, width)}


def units(texts: list[bytes], width: int, keep: Callable | None = None, whole: bool = True) -> dict[str, np.ndarray]:
    """Units of texts: of (which text), start, strings (how many), h, sk (stretches), k (hash of all its bytes); or h alone.

    keep: tells of an array of h which units are wanted."""
    parts, size, found = [], 0, []
    for k, t in enumerate(texts):
        for at in range(0, len(t) - width + 1, BLOCK):
            p = t[at : at + BLOCK + width - 1] if len(t) > BLOCK else t
            parts.append((k, at, p))
            size += len(p)
            if size >= BLOCK:
                found.append(_block_units(parts, width, keep, whole))
                parts, size = [], 0
    if parts:
        found.append(_block_units(parts, width, keep, whole))
    names = ("of", "start", "strings", "h", "sk", "k") if whole else ("h",)
    return {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in names}


def _packed(h: np.ndarray) -> bytes:
    """Sorted 48-bit hashes (as unsigned numbers with 16 low bits of nought) in six bytes each."""
    return (h >> np.uint64(32)).astype("<u4").tobytes() + ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(16)


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: the values that stand there once, and those that stand there more often."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    twice = np.diff(np.r_[first, len(h)]) > 1
    return h[first[~twice]], h[first[twice]]


def _shared_hashes(docs: DataFrame, width: int) -> DataFrame:
    """(h): hashes of units that occur twice or more."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (-(-size // PART_BYTES) - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            h.sort()
            rows = []
            for twice, keys in enumerate(_repeated(h)):
                if not len(keys):
                    continue
                part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                rows += [(p, bool(twice), _packed(keys[a:b])) for p, a, b in zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["part", "twice", "blob"])

        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                held.append(units(utf8(batch.column(0).slice(low, TEXTS)), width, whole=False)["h"].view(np.uint64))
                n += len(held[-1])
                if n > HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, once, more = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([*once, *more, *more])
            h.sort()
            keys = _repeated(h)[1].view(np.int64)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_pydict({"h": pa.array(keys[at : at + 100_000])})

        for batch in batches:
            for part, twice, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and last is not None:
                    yield from found()
                    once, more = [], []
                last = part
                (more if twice else once).append(_unpacked(blob))
        if last is not None:
            yield from found()

    sent = docs.select("text").mapInArrow(send, "part long, twice boolean, blob binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "h long")


def _filters(keys: DataFrame):
    """(filters by shard, sent to the tasks; number of shards) of a one-column table; (None, _) if they are too large to send."""
    name, n = keys.columns[0], keys.count()
    shards = max(1, -(-n // KEYS_PER_SHARD))
    if 4 * n > BROADCAST_LIMIT:
        return None, shards

    def build(group: pa.Table) -> pa.Table:
        h = group["h"].to_numpy()
        return pa.table({"shard": pa.array([int(_shard(h[:1], shards)[0])], pa.int32()), "blob": pa.array([CuckooFilter.build(h).to_bytes()], pa.binary())})

    sharded = keys.select(F.col(name).alias("h"), F.pmod(F.shiftright(name, 16), F.lit(shards)).cast("int").alias("shard"))
    with own_job(keys.sparkSession):
        blobs = sharded.groupBy("shard").applyInArrow(build, "shard int, blob binary").collect()
    return keys.sparkSession.sparkContext.broadcast({r.shard: bytes(r.blob) for r in blobs}), shards


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> 16) % shards


def _held(filters: dict, shards: int, h: np.ndarray) -> np.ndarray:
    hit, shard = np.zeros(len(h), bool), _shard(h, shards)
    for s in filters if len(filters) < 8 else np.unique(shard).tolist():
        if s in filters:
            at = np.flatnonzero(shard == s)
            hit[at] = filters[s].contains(h[at])
    return hit


#: Columns of places: bucket, hash of the unit, its stretches, document, first byte, number of strings.
_KINDS = {"h": "long", "k": "long", "sk": "long", "doc_id": "long", "start": "long", "strings": "int"}


def _places(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """The places of units whose h stands in wanted, and a few more that its filter lets through."""
    filters, shards = _filters(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if filters is None else {s: CuckooFilter.from_bytes(b) for s, b in filters.value.items()}
        keep = None if known is None else lambda h: _held(known, shards, h)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                found = units(utf8(part.column(1)), width, keep)
                found |= {"doc_id": part.column(0).to_numpy()[found["of"]], "strings": found["strings"].astype(np.int32)}
                if len(found["h"]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in _KINDS], list(_KINDS))

    out = docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _KINDS.items()))
    return out if filters is not None else out.join(wanted, "h", "left_semi")


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal leading columns, and the runs' bounds, from a stream sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if rest.num_rows < 20_000:
            continue
        bounds = _bounds(rest, keys)
        if len(bounds) > 1:
            end = int(bounds[-1])
            yield rest.slice(0, end).combine_chunks(), bounds
            rest = rest.slice(end)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.r_[_bounds(rest, keys), rest.num_rows]


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _to_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, k, low, high, sk) of distinct units (low, high: of their doc_ids) -> those that may lie in two documents, and
    whether they must be sorted."""
    for t, bounds in _runs(batches):
        h, k, low, high, sk = (c.to_numpy() for c in t.columns)
        size = np.diff(bounds)
        run = np.repeat(np.arange(len(size)), size)
        two = (np.minimum.reduceat(low, bounds[:-1]) < np.maximum.reduceat(high, bounds[:-1]))[run]
        sorting = np.zeros(len(h), bool)
        for s in range(-(-REACH // STEP)):
            key = (sk >> (21 * s)) & ((1 << 21) - 1)
            have = np.flatnonzero((key > 0) & two & (size[run] > 1))
            _, back, times = np.unique(run[have] << 21 | key[have], return_inverse=True, return_counts=True)
            sorting[have] |= times[back] > 1
        out = np.flatnonzero(sorting | (low < high))
        yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(k[out]), pa.array(low[out]), pa.array(sorting[out])], ["h", "k", "low", "sorting"])


def _met(places: DataFrame, found: DataFrame) -> DataFrame:
    """places joined with found on (h, k). Sorted by the number k alone, which Spark does by radix; h is compared where k meets."""
    met = places.join(found.withColumnRenamed("h", "found_h"), "k").where(F.col("h").bitwiseXOR(F.col("found_h")) == 0)
    return met.drop("found_h")


def _unit_bytes(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(h, k, low, piece): the bytes of units at one place each. Documents meet the places in them."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("h", "k", "start", "strings")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = utf8(part.column(1))
                of, (h, k, start, strings) = _listed(part.column(2))
                ok, _ = _as_listed(texts, of, start, strings, k, width)
                of, h, k, start, strings = of[ok], h[ok], k[ok], start[ok], strings[ok]
                pieces = [texts[o][a:b] for o, a, b in zip(of.tolist(), start.tolist(), (start + strings + width - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k), pa.array(part.column(0).to_numpy()[of]), pa.array(pieces, pa.binary())], ["h", "k", "low", "piece"])

    met = docs.join(wanted, "doc_id").select("doc_id", "text", "places")
    return met.mapInArrow(run, "h long, k long, low long, piece binary").dropDuplicates(["h", "k"])


def _listed(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: the row of each struct, and the structs' fields."""
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def _as_listed(texts: list[bytes], of: np.ndarray, start: np.ndarray, strings: np.ndarray, k: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places hold the unit of hash k (another text with the same doc_id may not), and the texts' starts when joined."""
    x, first = _joined(texts)
    ok = start + strings + width - 1 <= np.array([len(t) for t in texts], np.int64)[of]
    at = np.flatnonzero(ok)
    ok[at] = unit_hash(x, (first[of] + start)[at], strings[at], width) == k[at]
    return ok, first


#: Rows of sorted units: done (0), a distinct string of a chunk (1: k is its class, a and b its hash), a unit of a chunk (2: mins are classes).
_SORTED = "kind int, h long, chunk long, k long, low long, high long, a long, b long, mins array<long>"


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (h, chunk, k, low, piece, chunks) of distinct units -> least doc_ids of each unit's strings."""
        waiting: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows = []
            buckets: list[list[bytes]] = []
            for k, w in enumerate(waiting):
                if k and waiting[k - 1][:2] == w[:2]:
                    buckets[-1].append(w[4])
                else:
                    buckets.append([w[4]])
            of = bucket_classes(buckets, width)
            counts = [len(c) for c in of]
            flat = np.concatenate(of)
            least = np.full(int(flat.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, flat, np.repeat(np.array([w[3] for w in waiting], np.int64), counts))
            h, chunk, *_, chunks = waiting[0]
            if chunks > 1:  # a chunk stands alone
                cls, first = np.unique(flat, return_index=True)
                x, begin = _joined([w[4] for w in waiting])
                at = np.concatenate([b + np.arange(n) for b, n in zip(begin.tolist(), counts, strict=True)])[first]
                a, b = (_hash(x, at, width, seed=s).view(np.int64).tolist() for s in (77, 78))
                rows += [(1, h, chunk, c, m, None, p, q, None) for c, m, p, q in zip(cls.tolist(), least[cls].tolist(), a, b, strict=True)]
                rows += [(2, h, chunk, w[2], w[3], None, None, None, c) for w, c in zip(waiting, of, strict=True)]
            else:
                mins, first = least[flat], np.cumsum([0, *counts])
                lows, highs = (f.reduceat(mins, first[:-1]).tolist() for f in (np.minimum, np.maximum))
                for (h, chunk, k, *_), low, high, p, q in zip(waiting, lows, highs, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    rows.append((0, h, chunk, k, low, high, None, None, None if low == high else mins[p:q]))
            return _sorted_rows(rows)

        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last:
                    if waiting and (size >= TOGETHER or row[5] > 1 or waiting[0][5] > 1):
                        yield done()
                        waiting, size = [], 0
                    last = row[:2]
                waiting.append(row)
                size += len(row[4])
        if waiting:
            yield done()

    return run


def _sorted_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SORTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _across_chunks(done: DataFrame) -> DataFrame:
    """Units of large buckets with the least doc_ids over all chunks: strings meet by their hashes, a row for each chunk they are in."""
    strings = done.where("kind = 1").select("h", "chunk", "k", "low", "a", "b")
    least = strings.groupBy("a", "b").agg(F.min("low").alias("least"))
    met = strings.join(least, ["a", "b"]).select(F.lit(1).alias("kind"), "h", "chunk", "k", F.col("least").alias("low"), F.lit(None).cast("array<long>").alias("mins"))
    both = met.unionByName(done.where("kind = 2").select("kind", "h", "chunk", "k", "low", "mins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, {}
        for batch in batches:
            rows = []
            for h, chunk, kind, k, low, mins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, chunk) != last:
                    last, least = (h, chunk), {}
                if kind == 1:
                    least[k] = low
                else:
                    m = [least[c] for c in mins]
                    rows.append((0, h, chunk, k, min(m), max(m), None, None, None if min(m) == max(m) else m))
            if rows:
                yield _sorted_rows(rows)

    dealt = both.select("h", "chunk", "kind", "k", "low", "mins").repartition("h", "chunk").sortWithinPartitions("h", "chunk", "kind")
    return dealt.mapInArrow(run, _SORTED)


def suffix_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of removed runs) and kept (the remaining bytes), for every row of docs."""
    if width < 24:
        raise ValueError("width must be 24 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = materialize(_shared_hashes(numbered, width), "shared-hashes", TEXT_ROWS)
    all_places = materialize(_places(numbered, width, shared), "all-places", TEXT_ROWS)
    discard(shared)
    distinct = all_places.groupBy("h", "k").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("sk").alias("sk"))
    distinct = materialize(distinct, "distinct-units")
    counted = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") > BUCKET)
    large_table = materialize(counted.select("h", F.ceil(F.col("units") / BUCKET).alias("chunks")), "large-buckets")
    n_large = large_table.count()
    large = F.broadcast(large_table) if n_large <= LARGE_LIMIT else large_table
    small = distinct.join(large, "h", "left_anti") if n_large else distinct
    # dealt by bucket: at most BUCKET rows of one hash meet
    marked = small.select("h", "k", "low", "high", "sk").repartition("h").sortWithinPartitions("h").mapInArrow(_to_sort, "h long, k long, low long, sorting boolean")
    if n_large:
        marked = marked.unionByName(distinct.join(large, "h", "left_semi").select("h", "k", "low", F.lit(True).alias("sorting")))
    marked = materialize(marked, "marked-units")
    discard(distinct)
    places = materialize(_met(all_places.drop("sk"), marked).where("sorting OR low < doc_id"), "places")
    discard(all_places, marked)
    one = places.where("sorting AND doc_id = low").groupBy("h", "k").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.min("strings").alias("strings"))
    pieces = materialize(_unit_bytes(numbered, one, width), "unit-bytes")
    numbers = pieces.join(large, "h", "left") if n_large else pieces.withColumn("chunks", F.lit(None).cast("long"))
    numbers = numbers.withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("long"))
    dealt = numbers.select("h", F.pmod(F.xxhash64("k"), F.col("chunks")).alias("chunk"), "k", "low", "piece", "chunks")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes are not brought into few tasks
    done = materialize(dealt.repartition(tasks, "h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(_classes(width), _SORTED), "sorted-units")
    classes = done.where("kind = 0")
    if n_large:
        classes = classes.unionByName(_across_chunks(done))
    sorted_ = _met(places.where("sorting").drop("low"), classes.select("h", "k", "low", "high", "mins")).where("low < doc_id")
    bit = F.transform("mins", lambda m, i: F.when(m < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    which = F.when(F.col("high") >= F.col("doc_id"), F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))).otherwise(F.lit(-1).cast("long"))
    plain = places.where("NOT sorting AND low < doc_id").withColumn("which", F.lit(-1).cast("long"))
    columns = ["doc_id", "k", "start", "strings", "which"]
    covers = plain.select(*columns).unionByName(sorted_.withColumn("which", which).select(*columns))
    covers = materialize(covers.groupBy("doc_id").agg(F.collect_list(F.struct("k", "start", "strings", "which")).alias("covers")), "covers")
    discard(places, pieces, done, large_table)
    joined = docs.join(covers, "doc_id", "left").select("doc_id", "text", "covers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                texts = utf8(part.column(1))
                gone, _ = _covered(texts, part.column(2), width)
                yield pa.RecordBatch.from_arrays([part.column(0), *_taken_out(texts, gone)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _taken_out(texts: list[bytes], gone: np.ndarray) -> list[pa.Array]:
    """n_bytes, n_removed, spans and kept of texts, given which bytes of the joined texts go."""
    size = np.array([len(t) for t in texts], np.int64)
    bound = np.cumsum(np.r_[0, size])
    before = np.cumsum(np.r_[0, gone])[bound]  # bytes that go before each text
    filled = np.flatnonzero(size)
    head, tail = gone.copy(), gone.copy()  # first and last bytes of the runs that go; runs end with their text
    head[1:] &= ~gone[:-1]
    tail[:-1] &= ~gone[1:]
    head[bound[filled]] = gone[bound[filled]]
    tail[bound[filled + 1] - 1] = gone[bound[filled + 1] - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    of = np.searchsorted(bound[:-1], start, "right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - bound[of]), pa.array(end - bound[of])], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, bound).astype(np.int32)), runs)
    kept = np.frombuffer(b"".join(texts), np.uint8)[~gone]
    if len(kept) > np.iinfo(np.int32).max:
        raise ValueError("the texts of a batch are too long together")
    data = [None, pa.py_buffer((bound - before).astype(np.int32)), pa.py_buffer(kept)]
    return [pa.array(size), pa.array(np.diff(before)), spans, pa.Array.from_buffers(pa.binary(), len(texts), data)]


def _covered(texts: list[bytes], covers, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of joined texts are covered, and the texts' starts."""
    of, (k, start, strings, which) = _listed(covers)
    start, strings = start.astype(np.int64), strings.astype(np.int64)
    ok, first = _as_listed(texts, of, start, strings, k.astype(np.int64), width)
    at, n, which = (first[of] + start)[ok], strings[ok], which.astype(np.int64)[ok]
    size = sum(map(len, texts))
    step = np.zeros(size + width + 1, np.int64)
    all_ = which == -1
    np.add.at(step, at[all_], 1)
    np.add.at(step, (at + n - 1 + width)[all_], -1)
    at, n, which = at[~all_], n[~all_], which[~all_]
    for i in range(REACH):
        some = at[(i < n) & ((which >> i) & 1 > 0)] + i
        np.add.at(step, some, 1)
        np.add.at(step, some + width, -1)
    return np.cumsum(step[:size]) > 0, first


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
