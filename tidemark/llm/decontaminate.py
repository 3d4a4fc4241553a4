r"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters, digits and underscores of the lower-cased text, and single characters of scripts written without blanks. A first pass over all documents counts in how many
of them each pair of neighbouring words of the test items stands. Seeds of an item are its rare pairs and, in every window of
``WINDOW`` pairs, the rarest one, however common, so each stretch of an item has a seed and a passage that a third of all documents
quote is found like any other. In the second pass a document's seed hits are gathered by item and by where the item would start;
places with two hits (one, for an item with a single seed) are aligned, many at a time, with match 2, mismatch -1 and gap -1.
An item is leaked into a document if the best local score reaches ``min_share`` of the score of a whole copy and enough words match.

Test items are read in blocks below the broadcast limit, each block against all documents; no shuffle of documents is made.
Null and empty texts have no words; items with fewer than ``min_words`` words are never found. Repeated documents and repeated
items each give their own rows. Document columns pass through, but for one named ``leaks``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, table

#: Characters of scripts that are written without blanks (kana, Han, Thai, Lao, Burmese, Khmer): each is a word. Fixed values.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
WORD, ONE = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")
MIXED = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+")
#: Cells of an alignment's rows that a task holds at once.
CELLS = 1 << 19
WINDOW = 4
#: A pair is rare if at most this share of the documents, or ``RARE_DOCS`` of them, hold it.
RARE_SHARE, RARE_DOCS = 1e-4, 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = "array<struct<item_id:bigint,score:bigint,matched:bigint,start_word:bigint,end_word:bigint>>"
_LEAK = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "score", "matched", "start_word", "end_word")]))


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (WORD if text.isascii() or not ONE.search(text) else MIXED).findall(text)


class Items:
    """A block of test items: vocabulary, items as word numbers, and where each pair of words stands."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.ids, self.items, vocab = [], [], {}
        for item_id, text in rows:
            ws = words(text)
            if len(ws) >= min_words:
                self.ids.append(item_id)
                self.items.append(np.array([vocab.setdefault(w, len(vocab)) for w in ws], np.int64))
        self.vocab = vocab
        codes = [a[:-1] * len(vocab) + a[1:] for a in self.items]
        self.pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.at = [np.searchsorted(self.pairs, c) for c in codes]

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document of pairs of the items, and which pairs."""
        if len(doc) < 2 or not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((doc[:-1] >= 0) & (doc[1:] >= 0))
        code = doc[at] * len(self.vocab) + doc[at + 1]
        found = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        same = self.pairs[found] == code
        return at[same], found[same]

    def choose(self, counts: np.ndarray, docs: int) -> None:
        """Set the seeds: ``seeds`` maps a pair to its (item, position)s."""
        rare = counts <= max(RARE_DOCS, RARE_SHARE * docs)
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.needed = []
        for k, at in enumerate(self.at):
            c = counts[at]
            keep = rare[at].copy()
            for s in range(max(1, len(at) - WINDOW + 1)):
                keep[s + int(c[s : s + WINDOW].argmin())] = True
            chosen = np.flatnonzero(keep).tolist()
            self.needed.append(min(2, len({int(at[p]) for p in chosen})))
            for p in chosen:
                self.seeds.setdefault(int(at[p]), []).append((k, p))
        self.seeded = np.zeros(len(self.pairs), bool)
        self.seeded[list(self.seeds)] = True

    def places(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, last word + 1) of the stretches to be aligned."""
        at, found = self.hits(doc)
        if not len(at):
            return []
        seeded = self.seeded[found]
        by_item: dict[int, list[tuple[int, int]]] = {}
        for p, f in zip(at[seeded].tolist(), found[seeded].tolist(), strict=True):
            for item, q in self.seeds[f]:
                by_item.setdefault(item, []).append((p - q, f))
        out = []
        for item, starts in by_item.items():
            if len({f for _, f in starts}) < self.needed[item]:
                continue
            starts.sort()
            size, reach = len(self.items[item]), max(4, len(self.items[item]) // 3)
            group = [starts[0]]
            for s in [*starts[1:], (1 << 60, -1)]:
                if s[0] - group[-1][0] > reach:
                    if len({f for _, f in group}) >= self.needed[item]:
                        out.append((item, max(0, group[0][0] - reach), min(len(doc), group[-1][0] + size + reach)))
                    group = []
                group.append(s)
        return out


def align(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman of each a (item) with each b (passage): (score, matched words, start, end in b), all pairs at once.

    Two rows are held, with each cell's start and number of matches; steps are preferred in the order match or mismatch, word of
    the item left out, word of the passage left out. Among equal scores the alignment that ends first in the item, then first in the passage, is taken."""
    if not a:
        return []
    n, m, k = max(map(len, a)), max(map(len, b)), len(a)
    A, B = np.full((k, n), -2, np.int64), np.full((k, m), -3, np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        A[i, : len(x)], B[i, : len(y)] = x, np.where(y < 0, -3, y)
    place = np.arange(m + 1, dtype=np.int32)
    ramp, rows = -GAP * place, np.arange(k)
    score, start, matched = np.zeros((k, m + 1), np.int32), np.tile(place, (k, 1)), np.zeros((k, m + 1), np.int32)
    best = np.zeros((k, 4), np.int64)  # score, matched, start, end
    for i in range(n):
        same = A[:, i, None] == B
        h, s, t = score + GAP, start.copy(), matched.copy()
        across = score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        take = across >= h[:, 1:]
        h[:, 1:], s[:, 1:], t[:, 1:] = np.where(take, across, h[:, 1:]), np.where(take, start[:, :-1], s[:, 1:]), np.where(take, matched[:, :-1] + same, t[:, 1:])
        none = h <= 0
        h, s, t = np.where(none, 0, h), np.where(none, place, s), np.where(none, 0, t)
        score = np.maximum.accumulate(h + ramp, axis=1) - ramp
        source = np.maximum.accumulate(np.where(score == h, place, 0), axis=1)
        start, matched = np.take_along_axis(s, source, 1), np.take_along_axis(t, source, 1)
        end = score.argmax(1)
        now = score[rows, end]
        better = np.flatnonzero(now > best[:, 0])
        best[better] = np.stack([now, matched[rows, end], start[rows, end], end], 1)[better]
    return [tuple(x) for x in best.tolist()]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-4 * int(size) // limit))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (-1 if r[0] is None else r[0], r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.4, min_matched: int = 6, min_words: int = 6, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """docs with the column leaks: the test items found in each document, with score, matched words and word span."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*own).withColumn("leaks", F.expr(f"cast(array() as {LEAK})"))
    for rows in _blocks(benchmark, limit):
        items = Items(rows, min_words)
        if not items.items:
            continue
        sent = spark.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            total, n = np.zeros(len(items.pairs), np.int64), 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    total[np.unique(items.hits(items.numbers(text))[1])] += 1
                    n += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(np.r_[at, -1], pa.int64()), "n": pa.array(np.r_[total[at], n], pa.int64())})

        found = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
        counts = np.zeros(len(items.pairs), np.int64)
        counts[pair[pair >= 0]] = n[pair >= 0]
        items.choose(counts, int(n[pair < 0].sum()))
        chosen = spark.sparkContext.broadcast(items)
        at = own.index("text")

        def search(batches: Iterator[pa.RecordBatch], sent=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = _search(sent.value, batch.column(at).to_pylist(), min_share, min_matched)
                before = batch.column(len(own)).to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([b + x for b, x in zip(before, leaks, strict=True)], _LEAK)], [*own, "leaks"])

        out = out.mapInArrow(search, out.schema)
    return out


def _search(items: Items, texts: list, min_share: float, min_matched: int, at_once: int = 64) -> list[list[dict]]:
    found: list[dict[int, tuple]] = [{} for _ in texts]
    open_: list[tuple[int, int, int, np.ndarray]] = []

    def settle() -> None:
        open_.sort(key=lambda x: len(x[3]))  # alike lengths together
        k = 0
        while k < len(open_):
            # alignments are as wide as their longest passage, so long ones are taken fewer at a time
            n = at_once
            while n > 1 and n * len(open_[min(k + n, len(open_)) - 1][3]) > CELLS:
                n //= 2
            part = open_[k : k + n]
            k += n
            for (doc, item, start, _), (score, matched, s, e) in zip(part, align([items.items[x[1]] for x in part], [x[3] for x in part]), strict=True):
                size = len(items.items[item])
                if score >= min_share * MATCH * size and matched >= min(min_matched, size):
                    best = found[doc].get(item)
                    if best is None or (score, matched, -start - s) > (best[0], best[1], -best[2]):
                        found[doc][item] = (score, matched, start + s, start + e)
        open_.clear()

    for k, text in enumerate(texts):
        doc = items.numbers(text)
        for item, start, end in items.places(doc):
            open_.append((k, item, start, doc[start:end]))
        if len(open_) >= 8 * at_once:
            settle()
    settle()
    return [[dict(item_id=items.ids[i], score=a, matched=b, start_word=c, end_word=d) for i, (a, b, c, d) in sorted(f.items())] for f in found]


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("k")).select("doc_id", "k.*")
