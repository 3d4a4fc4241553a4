r"""N-gram Jaccard join: exact links between documents' shingle sets, found with signature trees.

1. Every document's set of five-word shingles is hashed; equal sets meet by a 128-bit digest and go on as their least document.
2. Prefix filter: sets with similarity t or more share a shingle among the first n - ceil(t n) + 1 of each in any common order.
   Hash order is taken, with shingles that a sample of documents shows to be common put last (the sample sets the order alone,
   and any order is exact). Each set stands in the buckets of its prefix shingles.
3. In a bucket, sets form a signature tree: leaves by size, and nodes with the OR of their members' token bitmaps, the AND, and the
   range of sizes. Dual traversal drops node pairs whose greatest possible overlap is too small for a link. A bucket that fits a leaf
   gives all surviving pairs; larger ones a spanning forest of them, in which pairs of one tree are not looked at again.
4. Surviving pairs are narrowed by wider bitmaps, then checked exactly on the whole sets; links form components. Where a forest's pair turned out to be no link, the
   bucket is gone through again and all its surviving pairs between different components are checked, so no link is lost.

Common shingles are dealt over several tasks by document; each task's trees send one member on, and buckets whose trees
don't all meet are gone through again, in blocks: those of the bucket's largest component against those of the other rows, and
these against each other. Tasks hold one bucket (or two blocks) of bitmaps at a time.

Null, empty and blank texts have empty sets, no links and themselves as component. Ties are settled by id. Repeated doc_ids are one
node: it has the links of all its texts. A null doc_id has no links and a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, discard, materialize, table, utf8
from .components import components
from .shingles import shingle_set

BITS = 1024
BYTES = BITS // 8
#: Bits of the map by which pairs are narrowed before their sets are fetched.
WIDE = 8192
#: One document in SAMPLE shows which shingles are common: those that COMMON sampled documents or more hold.
SAMPLE, COMMON = 16, 8
COMMON_LIMIT = 2_000_000
#: Sets of a bucket that a task takes together, and of a tree's leaf. A bucket no larger than a leaf is a tree of one node.
BLOCK, LEAF = 1024, 8
IDS_LIMIT = 1_000_000


def bitmap(s: np.ndarray, width: int = BITS) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def overlap_needed(a, b, percent: int):
    """Least intersection size of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Sets ordered by size in a binary tree; each node has OR and AND of the bitmaps and the range of sizes below it."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, percent: int):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.maps, self.percent = sizes[self.order], maps[self.order], percent
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(sizes))

    def _build(self, low: int, high: int) -> int:
        kids = ()
        if high - low > LEAF:
            mid = (low + high) // 2
            kids = (self._build(low, mid), self._build(mid, high))
        self.nodes.append((low, high, kids, np.bitwise_or.reduce(self.maps[low:high]), np.bitwise_and.reduce(self.maps[low:high]), int(self.sizes[low]), int(self.sizes[high - 1])))
        return len(self.nodes) - 1

    def apart(self, x: tuple, y: tuple) -> bool:
        """No set of x can link with one of y: the greatest possible overlap falls short."""
        if 100 * min(x[6], y[6]) < self.percent * max(x[5], y[5]):
            return True
        need = overlap_needed(x[5], y[5], self.percent)
        # bits that all of x have and none of y has are shingles of x outside y
        return min(x[6] - int(np.bitwise_count(x[4] & ~y[3]).sum()), y[6] - int(np.bitwise_count(y[4] & ~x[3]).sum())) < need

    def leaf_pairs(self, x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.meshgrid(np.arange(x[0], x[1]), np.arange(y[0], y[1]), indexing="ij")
        a, b = a.ravel(), b.ravel()
        if x[0] == y[0]:
            a, b = a[a < b], b[a < b]
        ok = possible(self.sizes[a], self.maps[a], self.sizes[b], self.maps[b], self.percent)
        return a[ok], b[ok]


def possible(na, ma, nb, mb, percent: int) -> np.ndarray:
    """Of aligned sets: can they link, by sizes and bitmaps?"""
    outside_a = np.bitwise_count(ma & ~mb).sum(1, dtype=np.int64)
    outside_b = np.bitwise_count(mb & ~ma).sum(1, dtype=np.int64)
    return np.minimum(na - outside_a, nb - outside_b) >= overlap_needed(na, nb, percent)


def traverse(sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray, percent: int, forest: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (positions) of sets that may link and stand in different groups, and the group of each set at the end.

    forest: a pair joins its groups, so later pairs of one group are passed over; else groups stay as given."""
    tree = SignatureTree(sizes, maps, percent)
    order = tree.order
    label = groups[order].copy()
    out: list[tuple[int, int]] = []
    todo = [(tree.root, tree.root)]
    while todo:
        i, j = todo.pop()
        x, y = tree.nodes[i], tree.nodes[j]
        lx, ly = label[x[0] : x[1]], label[y[0] : y[1]]
        if (lx == lx[0]).all() and (ly == lx[0]).all():
            continue
        if i != j and tree.apart(x, y):
            continue
        if x[2] and (i == j or x[1] - x[0] >= y[1] - y[0]):
            a, b = x[2]
            todo += [(a, a), (a, b), (b, b)] if i == j else [(a, j), (b, j)]
        elif y[2]:
            todo += [(i, y[2][0]), (i, y[2][1])]
        else:
            for a, b in zip(*(v.tolist() for v in tree.leaf_pairs(x, y)), strict=True):
                if label[a] != label[b]:
                    out.append((int(order[a]), int(order[b])))
                    if forest:
                        label[label == label[b]] = label[a]
    final = np.empty_like(label)
    final[order] = label
    return out, final


def _signatures(docs: DataFrame, common, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (digest of the set), prefix, salts (tasks over which a prefix shingle is dealt), map."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known, blocks = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, digest, prefix, salts, maps = [], [], [], [], []
                for text in utf8(part.column(1)):
                    s = shingle_set(text)
                    p = prefix_length(len(s), percent)
                    if len(known) and len(s):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        hit = known[k] == s
                        first = np.r_[np.flatnonzero(~hit), np.flatnonzero(hit)][:p]
                        salts.append(np.where(hit[first], blocks[k[first]], 1).tolist())
                    else:
                        first = np.arange(p)
                        salts.append([1] * p)
                    prefix.append(s[first].view(np.int64))
                    n.append(len(s))
                    digest.append(xxh3_128_digest(s.tobytes()))
                    maps.append(bitmap(s))
                h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array(n, pa.int64()), "s1": pa.array(h[:, 0]), "s2": pa.array(h[:, 1]), "prefix": pa.array(prefix, pa.list_(pa.int64())), "salts": pa.array(salts, pa.list_(pa.int32())), "map": pa.array(maps, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, salts array<int>, map binary")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles, and over how many tasks each is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in utf8(batch.column(0)):
                s = shingle_set(text)
                if len(s):
                    yield pa.RecordBatch.from_pydict({"token": pa.array(s.view(np.int64))})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = materialize(sample.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON), "common-shingles", TEXT_ROWS)
    least = COMMON
    while counts.where(F.col("n") >= least).count() > COMMON_LIMIT:
        least *= 2
    got = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], np.maximum(1, -(-n[order] * SAMPLE // BLOCK)).astype(np.int32)


_PAIRS = "kind int, token long, u long, v long, n long, map binary"


def _emit(kind, token, u, v, n=None, maps=None) -> pa.RecordBatch:
    k = len(u)
    full = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(k, t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), full(token, pa.int64()), full(u, pa.int64()), full(v, pa.int64()), full(n, pa.int64()), full(maps, pa.binary())], ["kind", "token", "u", "v", "n", "map"])


def _buckets(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole runs of equal leading columns, and the runs' bounds, from a stream sorted by them."""
    rest: pa.Table | None = None

    def cut(t: pa.Table, last: bool):
        keys = [t.column(k).to_numpy() for k in range(key_columns)]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        bounds = np.flatnonzero(new)
        end = t.num_rows if last else bounds[-1]
        return t.slice(0, end), np.r_[bounds[bounds < end], end], t.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        whole, bounds, rest = cut(rest, False)
        if whole.num_rows:
            yield whole.combine_chunks(), bounds
    if rest is not None and rest.num_rows:
        whole, bounds, _ = cut(rest, True)
        yield whole.combine_chunks(), bounds


def _shared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (token, salt, doc, salted, n, first), by size in each bucket -> rows that may have a partner there, and all dealt ones.

        The least shingle that two linked sets share is among the ``first`` of the smaller one's prefix."""
        for t, bounds in _buckets(batches, 2):
            size = np.diff(bounds)
            keep = t.column(3).to_numpy() > 1
            n, first, run_of = t.column(4).to_numpy(), t.column(5).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
            near = (run_of[1:] == run_of[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:])
            pairs = np.repeat(size == 2, size)[:-1]
            near &= ~pairs | first[:-1] | ((n[:-1] == n[1:]) & first[1:])  # with two rows the smaller one is known
            keep[:-1] |= near
            keep[1:] |= near
            yield from t.select([0, 1, 2, 3]).filter(pa.array(keep)).to_batches()

    return run


def _maps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BYTES // 8)


def _forests(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (token, salt, doc, salted, n, map) -> kind 0: pairs to check; 1: pairs of a forest, with the token; 2: members sent on."""
        for t, bounds in _buckets(batches, 2):
            token, doc, salted, n = (t.column(k).to_numpy() for k in (0, 2, 3, 4))
            maps, size = _maps(t.column(5)), np.diff(bounds)
            own, run_of = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
            pairs = []
            for d in range(1, LEAF):  # small buckets, all at once: rows d apart
                a = np.flatnonzero((own[:-d] <= LEAF) & (run_of[:-d] == run_of[d:]))
                a = a[doc[a] != doc[a + d]]
                if len(a):
                    ok = possible(n[a], maps[a], n[a + d], maps[a + d], percent)
                    pairs.append(np.stack([doc[a[ok]], doc[a[ok] + d]], 1))
            if pairs and len(both := np.unique(np.sort(np.concatenate(pairs), 1), axis=0)):
                yield _emit(0, None, both[:, 1], both[:, 0])
            dealt = salted[bounds[:-1]] > 1
            for k in np.flatnonzero((size > LEAF) | dealt):
                b = slice(bounds[k], bounds[k + 1])
                found, label = traverse(n[b], maps[b], np.arange(size[k]), percent, True) if size[k] > 1 else ([], np.zeros(1, int))
                if found:
                    u, v = doc[b][np.array(found)].T
                    yield _emit(1, np.full(len(found), token[b][0]), np.maximum(u, v), np.minimum(u, v))
                if dealt[k]:
                    _, first = np.unique(label, return_index=True)
                    yield _emit(2, np.full(len(first), token[b][0]), doc[b][first], None, n[b][first], [maps[b][i].tobytes() for i in first])

    return run


def _meeting(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members sent on by the tasks of one token: kind 1 as above; kind 3: tokens whose trees don't all meet."""
        for t, bounds in _buckets(batches, 1):
            token, doc, n, maps = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), _maps(t.column(3))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                b = slice(low, high)
                found, label = traverse(n[b], maps[b], np.arange(high - low), percent, True)
                if found:
                    u, v = doc[b][np.array(found)].T
                    yield _emit(1, np.full(len(found), token[low]), np.maximum(u, v), np.minimum(u, v))
                if (label != label[0]).any():
                    yield _emit(3, token[low : low + 1], np.array([0]), None)

    return run


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (token, block pair, doc, n, map, component): all pairs that may link between different components."""
        for t, bounds in _buckets(batches, 2):
            doc, n, maps, part = t.column(2).to_numpy(), t.column(3).to_numpy(), _maps(t.column(4)), t.column(5).to_numpy()
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                b = slice(low, high)
                found, _ = traverse(n[b], maps[b], part[b], percent, False)
                if found:
                    u, v = doc[b][np.array(found)].T
                    yield _emit(0, None, np.maximum(u, v), np.minimum(u, v))

    return run


def _links(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked) of distinct pairs, checked on the whole sets of the documents in them."""
    ids = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "pair-ids")
    few = ids.count() <= IDS_LIMIT
    wanted = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(t) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array([len(s) for s in found], pa.int64()), "m": pa.array([bitmap(s, WIDE) for s in found], pa.binary()), "s": pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))})

    sets = materialize(wanted.mapInArrow(run, "doc_id long, n long, m binary, s array<long>"), "pair-sets", TEXT_ROWS)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (3, 5))
                ok = possible(batch.column(2).to_numpy(), a, batch.column(4).to_numpy(), b, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["u", "v", "linked"])

    kind = "u long, v long, linked boolean"
    u, v = ([F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")] for x in "uv")
    wide = pairs.join(sets.select(*u), "u").join(sets.select(*v), "v").select("u", "v", "nu", "mu", "nv", "mv").mapInArrow(narrow, kind)
    wide = materialize(wide, "narrowed-pairs")
    discard(ids)
    left = wide.where("linked").select("u", "v").join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("a")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("b")), "v").select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("same"))
    linked = 100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))
    out = materialize(both.select("u", "v", linked.alias("linked")).unionByName(wide.where("NOT linked")), "links")
    discard(sets, wide)
    return out


def _meeting_places(again: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, pair, doc_id, n, map, component) of the rows of open buckets, dealt so that any two rows of different components
    meet under one pair.

    The bucket's largest component needs no look within itself: its blocks meet the blocks of the other rows, and these each other.
    With few other rows, every row of the largest component is sent once, however large it is."""
    sizes = parts.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("long")
    sizes = sizes.select("token", "major", (F.col("all") <= BLOCK).alias("whole"), blocks(F.col("most")).alias("cs"), blocks(F.col("all") - F.col("most")).alias("ms"))
    rows = again.join(sizes, "token")
    at = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    code = lambda kind, i, j: F.lit(kind) + i * F.lit(1 << 30) + j
    of_most = to("ms", lambda i: code(0, i, at("cs")))
    others = F.concat(to("cs", lambda j: code(0, at("ms"), j)), to("ms", lambda i: code(1 << 60, F.least(i, at("ms")), F.greatest(i, at("ms")))))
    pair = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).when(F.col("component") == F.col("major"), of_most).otherwise(others)
    return rows.select("token", F.explode(pair).alias("pair"), "doc_id", "n", "map", "component")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; docs need doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(_signatures(docs, _common(docs), percent), "shingle-signatures", TEXT_ROWS)
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    least = materialize(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "set-representatives")
    members = sets.select("doc_id", "n", "s1", "s2").join(least, ["s1", "s2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    members = materialize(members, "set-members")
    reps = usable.select("doc_id", "n", "prefix", "salts").join(least.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    index = F.col("n") - F.ceil(F.lit(2.0 * percent) * F.col("n") / (100 + percent)) + 1
    tokens = reps.select("doc_id", F.col("n").cast("int").alias("n"), index.alias("index"), F.posexplode(F.arrays_zip("prefix", "salts")).alias("at", "t")).select(
        F.col("t.prefix").alias("token"), F.pmod(F.xxhash64("doc_id"), F.col("t.salts")).cast("int").alias("salt"), "doc_id", F.col("t.salts").alias("salted"), "n", (F.col("at") < F.col("index") + 1).alias("first")
    )
    shared = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id").mapInArrow(_shared(percent), "token long, salt int, doc_id long, salted int")
    shared = materialize(shared, "shared-prefixes")
    payload = materialize(usable.select("doc_id", "n", "map").join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), "bitmaps")
    discard(least, sets)
    rows = shared.join(payload, "doc_id").select("token", "salt", "doc_id", "salted", "n", "map")
    out = materialize(rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "doc_id").mapInArrow(_forests(percent), _PAIRS), "tree-pairs")
    sent_on = out.where("kind = 2").select("token", F.col("u").alias("doc_id"), "n", "map")
    meet = materialize(sent_on.repartition("token").sortWithinPartitions("token", "doc_id").mapInArrow(_meeting(percent), _PAIRS), "tree-meetings")

    found = out.where("kind < 2").unionByName(meet.where("kind = 1"))
    pairs = materialize(found.select("u", "v").distinct(), "tree-distinct")
    links = _links(pairs, docs, percent)
    true = links.where("linked").select("u", "v").distinct()
    wrong = links.groupBy("u", "v").agg(F.max("linked").alias("linked")).where("NOT linked")
    open_ = found.where("kind = 1").join(wrong, ["u", "v"], "left_semi").select("token").union(meet.where("kind = 3").select("token")).distinct()
    open_ = materialize(open_, "open-tokens")
    discard(out, meet)
    labels = components(true)
    if open_.count():
        again = shared.join(open_, "token", "left_semi").select("token", "doc_id").distinct().join(payload, "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        again = materialize(again.withColumn("component", F.coalesce("component", "doc_id")), "open-buckets")
        parts = again.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes are not brought into few tasks
        more = _meeting_places(again, parts).repartition(tasks, "token", "pair").sortWithinPartitions("token", "pair", "doc_id").mapInArrow(_across(percent), _PAIRS)
        more = materialize(more.select("u", "v").distinct().join(pairs, ["u", "v"], "left_anti"), "across-pairs")
        new = _links(more, docs, percent)
        before, labels = labels, components(true.unionByName(new.where("linked").select("u", "v")))
        discard(again, more, new, before)
    discard(open_, links, pairs, shared, payload)
    joined = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=80)
