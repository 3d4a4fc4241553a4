"""Reversible line dedup: exact reference counts of line keys, in hash shards, each fronted by a cuckoo filter.

A line's key is the line without leading and trailing ASCII white space, with A-Z lower-cased. ``LineStore`` keeps, per key
(a 128-bit hash), in how many documents it stands. Inserting or deleting documents first sums their keys into one change per
key, so a line that a third of all documents share costs one row per task. Each shard's filter tells keys that are surely new;
only the rest are looked up in the shard's exact table, and what the filters let through is always settled by exact counts.

Null text is an empty text, an empty text is one empty line, and keys shorter than ``min_chars`` never drop. Repeated lines of
a document count once. Every row is a document of its own, also those whose doc_id is null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, TEXT_ROWS, discard, materialize, table, utf8
from .cuckoo import CuckooFilter

STRIP = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1_000_000
#: Documents whose lines a task holds at once.
ROWS = 500


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _digests(texts: list[bytes], min_chars: int):
    """For each text its lines and, for each line, a 16-byte hash of its key (b"" for a key that is too short)."""
    from xxhash import xxh3_128_digest

    for text in texts:
        lines = text.split(b"\n")
        keys = [x.strip(STRIP).lower() for x in lines]
        yield lines, [xxh3_128_digest(k) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else b"" for k in keys]


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)


def _table_of(h: np.ndarray, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), **more})


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n): keys with the number of documents that hold them, summed within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for _, digests in _digests(utf8(batch.column(0)), min_chars):
                for d in set(digests):
                    counts[d] = counts.get(d, 0) + 1
            counts.pop(b"", None)
            if counts:
                yield _table_of(_halves(list(counts)), n=pa.array(list(counts.values()), pa.int64()))

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, n long")


class LineStore:
    """Reference counts of line keys: (shard, h1, h2, n), and a filter for each shard: (shard, blob).

    insert() and delete() write the shards that they touch to a new table in the shared folder; other shards stay where they are. A store is
    a value, so earlier versions remain readable. Tables are brought together when there are more than ``TABLES`` of them, and
    the shards doubled when they hold over ``2 * KEYS_PER_SHARD`` keys on average, so a shard always fits a task."""

    TABLES = 8

    def __init__(self, spark: SparkSession, shards: int, min_chars: int, tables: tuple[tuple[DataFrame, frozenset[int]], ...] = ()):
        self.spark, self.shards, self.min_chars = spark, shards, min_chars
        self.tables = tables  # with the shards that later tables replace

    def _rows(self) -> DataFrame:
        # made in the JVM: an empty list from Python would start Python workers of another kind, which stay
        kinds = [c.split() for c in _STORE.split(", ")]
        out = self.spark.range(0).select(*(F.lit(None).cast(kind).alias(c) for c, kind in kinds))
        for t, stale in self.tables:
            if stale:
                t = t.where(~F.col("shard").isin(sorted(stale)))
            out = out.unionByName(t)
        return out

    @property
    def counts(self) -> DataFrame:
        return self._rows().where("kind = 0").select("shard", "h1", "h2", "n")

    @property
    def filters(self) -> DataFrame:
        return self._rows().where("kind = 2").select("shard", "blob")

    def insert(self, docs: DataFrame) -> LineStore:
        return self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> LineStore:
        """Take out documents that were inserted before: their keys' counts fall, and keys at nought leave table and filter."""
        return self._apply(docs, -1)

    def _apply(self, docs: DataFrame, sign: int) -> LineStore:
        change = document_keys(docs, self.min_chars).groupBy("h1", "h2").agg((F.sum("n") * sign).alias("n"))
        shard = F.pmod(F.col("h1"), F.lit(self.shards)).cast("int")
        change = change.select(shard.alias("shard"), F.lit(1).alias("kind"), "h1", "h2", "n", F.lit(None).cast("binary").alias("blob"))
        before = self._rows()
        if self.tables:
            change = materialize(change, "line-changes", TEXT_ROWS)
            touched = change.select("shard").distinct()
            before = before.join(F.broadcast(touched), "shard", "left_semi")
        new = materialize(before.unionByName(change).groupBy("shard").applyInArrow(_merge_shard, _STORE), "line-store", TEXT_ROWS)
        if not self.tables:
            return LineStore(self.spark, self.shards, self.min_chars, ((new, frozenset()),))
        stale = frozenset(r.shard for r in new.select("shard").distinct().collect())
        discard(change)
        old = tuple((t, gone | stale) for t, gone in self.tables if len(gone | stale) < self.shards)
        return LineStore(self.spark, self.shards, self.min_chars, (*old, (new, frozenset())))._tidied()

    def _tidied(self) -> LineStore:
        shards = self.shards
        keys = self.counts.count()
        while keys > 2 * KEYS_PER_SHARD * shards:
            shards *= 2
        if shards == self.shards and len(self.tables) <= self.TABLES:
            return self
        shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
        rows = self._rows().where("kind = 0").withColumn("shard", shard) if shards > self.shards else self._rows()
        out = materialize(rows.groupBy("shard").applyInArrow(_merge_shard, _STORE), "line-store")
        return LineStore(self.spark, shards, self.min_chars, ((out, frozenset()),))

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts.where(F.col("n") >= min_docs).select("h1", "h2")


#: Rows of a store: keys with their counts (kind 0), changes (1) and the shard's filter (2).
_STORE = "shard int, kind int, h1 long, h2 long, n long, blob binary"


def _merge_shard(group: pa.Table) -> pa.Table:
    """Apply a shard's changes: keys that its filter has not seen are appended; the others meet the exact table."""
    kind = group["kind"].to_numpy()
    shard = group["shard"][0].as_py()
    h = np.stack([group["h1"].to_numpy(), group["h2"].to_numpy()], 1)
    n = group["n"].to_numpy()
    old, old_n, new, new_n = h[kind == 0], n[kind == 0].copy(), h[kind == 1], n[kind == 1]
    blob = next((b.as_py() for b in group["blob"] if b.is_valid), None)
    cuckoo = CuckooFilter.from_bytes(blob) if blob else CuckooFilter.build(old[:, 0])
    maybe = cuckoo.contains(new[:, 0]) if len(new) else np.zeros(0, bool)
    at = {k: i for i, k in enumerate(map(tuple, old.tolist()))} if maybe.any() else {}
    fresh = ~maybe
    for i in np.flatnonzero(maybe):
        j = at.get((int(new[i, 0]), int(new[i, 1])))
        if j is None:
            fresh[i] = True
        else:
            old_n[j] += new_n[i]
    fresh &= new_n > 0
    gone = old_n <= 0
    if gone.any():
        cuckoo.delete(old[gone][:, 0])
    keys = np.concatenate([old[~gone], new[fresh]])
    counts = np.concatenate([old_n[~gone], new_n[fresh]])
    if not cuckoo.insert(new[fresh][:, 0]):
        cuckoo = CuckooFilter.build(keys[:, 0])
    m = len(keys)
    return pa.table(
        {
            "shard": pa.array(np.full(m + 1, shard, np.int32)),
            "kind": pa.array(np.r_[np.zeros(m, np.int32), np.int32(2)].astype(np.int32)),
            "h1": pa.array(np.r_[keys[:, 0], 0].astype(np.int64)),
            "h2": pa.array(np.r_[keys[:, 1], 0].astype(np.int64)),
            "n": pa.array(np.r_[counts, 0].astype(np.int64)),
            "blob": pa.array([None] * m + [cuckoo.to_bytes()], pa.binary()),
        }
    )


def _frequent_filters(frequent: DataFrame, shards: int) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group["shard"][:1].cast(pa.int32()), "blob": pa.array([CuckooFilter.build(group["h1"].to_numpy()).to_bytes()], pa.binary())})

    return frequent.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def _exact(digests: set[bytes], filters: dict[int, CuckooFilter], shards: int, exact: np.ndarray) -> set[bytes]:
    """Those of the digests that are frequent: let through by their shard's filter, then found in the sorted exact list."""
    all_, out = list(digests), set()
    if all_ and len(exact):
        h = _halves(all_)
        shard = h[:, 0] % shards
        keys = np.frombuffer(b"".join(all_), "S16")
        for s in np.unique(shard).tolist():
            if s in filters:
                at = np.flatnonzero(shard == s)
                at = at[filters[s].contains(h[at, 0])]
                found = np.minimum(np.searchsorted(exact, keys[at]), len(exact) - 1)
                out.update(all_[i] for i in at[exact[found] == keys[at]].tolist())
    return out


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def drop_frequent_lines(docs: DataFrame, store: LineStore, min_docs: int) -> DataFrame:
    """docs with the columns ``n_lines``, ``n_dropped`` and the new ``text``. Other columns, whatever their names, are kept,
    but for columns of these names, which are replaced."""
    spark = docs.sparkSession
    frequent = materialize(store.frequent(min_docs), "frequent-lines")
    n = frequent.count()
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    min_chars, shards = store.min_chars, store.shards
    blobs: dict[int, bytes] | None = None
    exact: np.ndarray | None = None
    row, marks = _unused(docs, "row"), _unused(docs, "drops")
    if n * 24 <= BROADCAST_LIMIT:  # 2.4 bytes a key at worst in the filters, 16 in the exact list, here and in the tasks
        blobs = {r.shard: bytes(r.blob) for r in _frequent_filters(frequent, shards).collect()}
        got = frequent.toArrow()
        exact = np.sort(np.stack([got["h1"].to_numpy(), got["h2"].to_numpy()], 1).astype(">i8").view("S16")[:, 0]) if n else np.zeros(0, "S16")
        hits = docs
    else:  # too many to send to every task: the keys of each document meet the exact table in a join
        docs = docs.withColumn(row, F.monotonically_increasing_id())
        docs = materialize(docs, "line-docs", TEXT_ROWS)

        def keys(batches):
            for batch in batches:
                rows, digests = [], []
                for row, (_, ds) in zip(batch.column(0).to_pylist(), _digests(utf8(batch.column(1)), min_chars), strict=True):
                    ds = set(ds) - {b""}
                    rows += [row] * len(ds)
                    digests += ds
                if rows:
                    yield _table_of(_halves(digests), doc=pa.array(rows, pa.int64()))

        marked = docs.select(row, "text").mapInArrow(keys, "h1 long, h2 long, doc long").join(frequent, ["h1", "h2"], "left_semi")
        marked = marked.groupBy(F.col("doc").alias(row)).agg(F.collect_list(F.struct("h1", "h2")).alias(marks))
        hits = docs.join(marked, row, "left")
    sent = spark.sparkContext.broadcast((blobs, exact))
    joined = blobs is None
    schema = hits.select(*own).schema
    names = [*own, "text", "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if joined else {k: CuckooFilter.from_bytes(b) for k, b in sent.value[0].items()}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts, lines, dropped = [], [], []
                drops = batch.column(len(own) + 1).to_pylist() if joined else None
                parts = list(_digests(utf8(batch.column(len(own))), min_chars))
                bad = set() if joined else _exact({d for _, ds in parts for d in ds} - {b""}, filters, shards, sent.value[1])
                for i, (ls, ds) in enumerate(parts):
                    if joined:
                        bad = {np.array([d["h1"], d["h2"]], ">i8").tobytes() for d in drops[i] or []}
                    kept = [x for x, d in zip(ls, ds, strict=True) if d not in bad]
                    texts.append(b"\n".join(kept))
                    lines.append(len(ls))
                    dropped.append(len(ls) - len(kept))
                cols = [batch.column(k) for k in range(len(own))] + [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    out_schema = schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return hits.select(*own, "text", *([marks] if joined else [])).mapInArrow(run, out_schema)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> DataFrame:
    """Build a store of all lines of docs and drop the lines whose key stands in at least min_docs documents."""
    spark = docs.sparkSession
    if shards is None:  # a shard's table must fit a task: about a key for 60 bytes of text at most
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // (60 * KEYS_PER_SHARD)))
    store = LineStore(spark, int(shards), min_chars).insert(docs)
    return drop_frequent_lines(docs, store, min_docs)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row, doc_id, t.i AS i, ls[t.i] AS line FROM split, unnest(range(1, len(ls) + 1)) AS t(i)),
keyed AS (SELECT row, doc_id, i, line, {_KEY} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY row, doc_id
"""
