"""Scores of whole texts under a causal self-attention model, beside a smoothed word-unigram base.

Counts are learned from all training documents: those of words and of neighbouring subwords (summed in every task first, and
kept as tables in the shared folder that grow with the corpus), from these the subwords' classes and the counts of classes after
subwords, and the attention's weights. ``EPOCHS`` parts of the training learn once from every training document between them: in each,
tasks start from the same weights, learn from the documents they hold, and rows of weights are averaged by how often each task moved them. Every text is
then scored whole, window by window, each subword once (``attention``); counts of pairs of the most frequent subwords are in the
model, other pairs meet theirs in a join.

For the base, counts of the most frequent words (at most ``HEAD``) are sent to the tasks, with their subwords' ids; other words meet their counts in a
join, one row per occurrence. Ids are kept with each row's number in a table in the shared folder, so that repeated
doc_ids stay apart.

Null and empty texts hold the end sign alone. With no training documents all counts are nought. Rows with a null doc_id are
trained on (the remainder of the empty text's checksum is 0). Other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import attention
from .common import TEXT_ROWS, fold_column, materialize, own_job, strings, table

#: Words whose counts every task has.
HEAD = 100_000
#: Bytes of texts whose words a task holds at once; a longer text is taken alone.
BYTES = 4 << 20
#: Words that are encoded in one go; a longer text is cut between words, which has no bearing on its ids.
RUN = 100_000
#: Ids of the vocabulary are below END.
END, PAD = 50256, 50257
IDS = PAD + 1

#: An expression whose pieces end with a word, so that a word's ids are its own, where no white space beyond ASCII stands beside a blank.
APART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, as characters and in UTF-8.
WHITE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BEYOND = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")

_ENCODERS: dict[tuple[str, str], object] = {}
_BLANKS: dict[tuple[str, str], np.ndarray] = {}


def encoder(ranks: str, pattern: str):
    """A byte-level encoder by its file of ranks and the expression that parts texts."""
    if (ranks, pattern) not in _ENCODERS:
        import tiktoken

        with open(ranks, "rb") as file:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if len(known) > END:
            raise ValueError(f"a vocabulary of {END} ids at most")
        _ENCODERS[ranks, pattern] = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        blank = np.zeros(IDS, bool)
        blank[[rank for token, rank in known.items() if token[:1] == b" "]] = True
        _BLANKS[ranks, pattern] = blank
    return _ENCODERS[ranks, pattern]


def encode_words(encoding, words: list[bytes]) -> bytes:
    """Ids (16-bit, little-endian) of words with a blank before each."""
    parts = [b" " + b" ".join(words[k : k + RUN]) for k in range(0, len(words), RUN)]
    return b"".join(np.array(encoding.encode_ordinary(p.decode()), "<u2").tobytes() for p in parts)


def ids_apart(tokenizer: tuple[str, str], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words without white space beyond ASCII, one behind the other, and where each word's begin; by ``APART``."""
    ids = np.frombuffer(encode_words(encoder(*tokenizer), words), "<u2") if words else np.zeros(0, "<u2")
    starts = np.flatnonzero(_BLANKS[tokenizer][ids]) if words else np.zeros(0, np.int64)  # each word has one blank, its first byte
    if len(starts) != len(words):
        raise ValueError("ids that are not apart by words")
    return ids, starts


def encode_split(tokenizer: tuple[str, str], texts: list[bytes], split: list[list[bytes]], place: np.ndarray, head_ids: np.ndarray, head_cuts: np.ndarray) -> list[bytes]:
    """``encode_words`` of each text's words. place: of all words of all texts among those whose ids are known, -1 for others."""
    encoding = encoder(*tokenizer)
    if tokenizer[1] != APART:
        return [encode_words(encoding, words) for words in split]
    whole = [not text.isascii() and BEYOND.search(text) is not None for text in texts]
    rest = np.flatnonzero(place < 0)
    flat = list(chain.from_iterable(split))
    others = [flat[k] for k in rest.tolist()]
    if any(whole):
        others = [b"x" if BEYOND.search(w) else w for w in others]
    ids, starts = ids_apart(tokenizer, others)
    pool = np.r_[head_ids, ids]
    first, n = head_cuts[place], head_cuts[place + 1] - head_cuts[place]
    first[rest], n[rest] = starts + len(head_ids), np.diff(starts, append=len(ids))
    ends = np.cumsum(n)
    blob = pool[np.arange(n.sum()) + np.repeat(first - ends + n, n)].tobytes()
    cuts = (2 * np.r_[0, ends][np.r_[0, np.cumsum([len(words) for words in split])]]).tolist()
    return [encode_words(encoding, words) if w else blob[i:j] for words, w, i, j in zip(split, whole, cuts, cuts[1:], strict=False)]


def word_key(word: bytes) -> bytes:
    """The word, or 17 bytes for one longer than 16."""
    return word if len(word) <= 16 else b"\0" + xxh3_128_digest(word)


def cut_texts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that are taken at once."""
    stops, at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + BYTES, "right")))
        yield at, end - at
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of texts (null: none): the distinct ones, which of them each word is, and its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    words = split.flatten().dictionary_encode()
    found, owner = words.indices.to_numpy(), np.repeat(np.arange(len(split)), pc.list_value_length(split))
    blank = words.dictionary.index("").as_py()  # stands before and after white space at the ends of texts
    if blank < 0:
        return words.dictionary.cast(pa.large_binary()), found, owner
    real = found != blank
    found, owner = found[real], owner[real]
    return words.dictionary.cast(pa.large_binary()).filter(pa.array(np.arange(len(words.dictionary)) != blank)), found - (found > blank), owner


def listed(words: pa.Array) -> list[bytes]:
    """Words, which have no line ends, as a list."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(b"\n", words.type))[0].as_py().split(b"\n") if len(words) else []


def word_keys(words: pa.Array) -> pa.Array:
    """``word_key`` of each word."""
    long = pc.greater(pc.binary_length(words), 16)
    return pc.replace_with_mask(words, long, pa.array([word_key(w) for w in listed(words.filter(long))], words.type)) if pc.any(long).as_py() else words


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n) of the words of all texts, by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_words(batch.column(0).slice(at, n))[:2] for at, n in cut_texts(batch.column(0))]
            if parts:
                keys = pa.concat_arrays([word_keys(words) for words, _ in parts]).dictionary_encode()
                n = np.bincount(keys.indices, np.concatenate([np.bincount(found, minlength=len(words)) for words, found in parts]), len(keys.dictionary))
                yield pa.RecordBatch.from_pydict({"w": keys.dictionary.cast(pa.binary()), "n": pa.array(n.astype(np.int64))})

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _head(tokenizer: tuple[str, str], keys: list[bytes], shares: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Places of frequent words by key, their shares of the base, the ids of all of them and where each one's begin and end; long words and
    words with white space beyond ASCII have none there and are encoded where they stand."""
    n = np.zeros(len(keys), np.int64)
    plain = [k for k, w in enumerate(keys) if len(w) <= 16 and not BEYOND.search(w)] if tokenizer[1] == APART else []
    ids, starts = ids_apart(tokenizer, [keys[k] for k in plain])
    n[plain] = np.diff(starts, append=len(ids))
    return {w: k for k, w in enumerate(keys)}, shares, ids, np.r_[0, np.cumsum(n)]


_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary, tail array<binary>"


def _encode(docs: DataFrame, tokenizer: tuple[str, str], head, ends: int, size: float) -> DataFrame:
    """Subword ids (16-bit) of each text, the base over its head words, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        end = math.log10((ends + 0.5) / size)
        for batch in batches:
            for at, many in cut_texts(batch.column(2)):
                part = batch.slice(at, many)
                n, found, base, blobs, tails = encode_texts(tokenizer, part.column(2), *head.value)
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(n)), pa.int64()), part.column(0), part.column(1), pa.array(n + 1, pa.int64()), pa.array(found + (ends > 0), pa.int64()), pa.array(end + base, pa.float64()), pa.array(blobs, pa.binary()), tails], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "tail"])
                row += len(n)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


def _blobs(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """16-bit ids, cut where starts says."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(2 * starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])


def encode_texts(tokenizer: tuple[str, str], texts: pa.Array, at_of: dict[bytes, int], shares: np.ndarray, head_ids: np.ndarray, head_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], pa.Array]:
    """Of each text: its number of words, of those in the head, their sum of shares, the ids of all words (``encode_words``), the keys of words
    that are not in the head. Only distinct words are looked up and encoded."""
    words, found, owner = split_words(texts)
    n, first = np.bincount(owner, minlength=len(texts)), listed(words)
    at = np.r_[0, np.cumsum(n)]
    place = np.fromiter(map(at_of.get, first, repeat(-1)), np.int64, len(first))
    if tokenizer[1] == APART:
        white = np.array(pc.match_substring_regex(strings(texts), WHITE), bool)
        other = place < 0
        others = list(compress(first, other.tolist()))
        if white.any():
            others = [b"x" if BEYOND.search(w) else w for w in others]  # the texts that they stand in are encoded whole
        ids = np.frombuffer(encode_split(tokenizer, [b""], [others], np.full(len(others), -1), head_ids[:0], np.zeros(1, np.int64))[0], "<u2")
        starts = np.flatnonzero(_BLANKS[tokenizer][ids])
        pool = pa.concat_arrays([_blobs(ids, np.r_[starts, len(ids)]), _blobs(head_ids, head_cuts)])
        got = pool.take(pa.array(np.where(other, np.cumsum(other) - 1, place + len(starts))[found]))
        _, ends, data = got.buffers()
        cuts = np.frombuffer(ends, np.int64)[at].tolist() if len(got) else [0] * len(at)
        blobs = [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(cuts, cuts[1:], strict=False)]
    else:
        white, blobs = np.ones(len(texts), bool), [b""] * len(texts)
    for k in np.flatnonzero(white).tolist():
        blobs[k] = encode_words(encoder(*tokenizer), [first[w] for w in found[at[k] : at[k + 1]].tolist()])
    keys, long = word_keys(words), np.flatnonzero(np.fromiter(map(len, first), np.int64, len(first)) > 16)
    place[long] = np.fromiter(map(at_of.get, keys.take(pa.array(long)).to_pylist(), repeat(-1)), np.int64, len(long))  # a long frequent word is in the head by its key
    where = place[found]
    known = where >= 0
    base = np.bincount(owner[known], shares[where[known]], len(n))
    tails = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[~known], minlength=len(n)))], pa.int32()), keys.cast(pa.binary()).take(pa.array(found[~known])))
    return n, np.bincount(owner[known], minlength=len(n)), base, blobs, tails


def _ids(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int32) for b in blobs]


#: Texts whose pairs a task counts, or whose windows it shuffles, at once; distinct pairs that it holds before it lets them go.
BLOCK, HELD = 256, 1 << 21


def _blocks(column, size: int = BLOCK) -> Iterator[list[np.ndarray]]:
    for at in range(0, len(column), size):
        yield _ids(column.slice(at, size).to_pylist())


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    starts = np.flatnonzero(np.r_[True, np.diff(keys) != 0]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n[by], starts) if len(keys) else n


def pair_counts(learn: DataFrame) -> DataFrame:
    """(pair, n) of neighbouring ids in all texts, end signs before and after them; pair is first << 16 | second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, parts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_pydict({"pair": pa.array(keys[at : at + 100_000], pa.int64()), "n": pa.array(n[at : at + 100_000], pa.int64())})

        for batch in batches:
            for docs in _blocks(batch.column(0)):
                first, second = attention.neighbours(docs, END)
                parts.append(np.unique(first << 16 | second, return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > HELD:
                    keys, n = _summed(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([n, *(c for _, c in parts)]))
                    parts, waiting = [], 0
                    if len(keys) > HELD:
                        yield from out()
                        keys, n = keys[:0], n[:0]
        keys, n = _summed(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([n, *(c for _, c in parts)]))
        yield from out()

    return learn.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _contexts(pairs: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Classes of the ids, by the pairs with a frequent id in them."""
    at = pairs.sparkSession.sparkContext.broadcast((attention.marks_of(counts).astype(np.int32), counts >= 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, known = at.value
        for batch in batches:
            pair, n = (c.to_numpy() for c in batch.columns)
            first, second = pair >> 16, pair & 0xFFFF
            for own, other, side in ((second, first, 0), (first, second, attention.MARKS)):
                ok = (marks[other] >= 0) & known[own]
                yield pa.RecordBatch.from_pydict({"place": pa.array(own[ok] * 2 * attention.MARKS + marks[other[ok]] + side, pa.int32()), "n": pa.array(n[ok], pa.int64())})

    got = pairs.mapInArrow(run, "place int, n long").toArrow()
    place, n = got["place"].to_numpy(), got["n"].to_numpy()
    return attention.cluster_counts(counts, place // (2 * attention.MARKS), place % (2 * attention.MARKS), n)


def _gather(pairs: DataFrame, classes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of classes after ids, and of pairs of frequent ids by rank."""
    top, kinds = attention.PAIRED, attention.CLASSES
    sent = pairs.sparkSession.sparkContext.broadcast((classes.astype(np.int32), rank.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, rank = sent.value
        follow = np.zeros(IDS * kinds, np.int64)
        for batch in batches:
            pair, n = (c.to_numpy() for c in batch.columns)
            first, second = pair >> 16, pair & 0xFFFF
            follow += np.bincount(first * kinds + classes[second], n, IDS * kinds).astype(np.int64)
            ok = (rank[first] < top) & (rank[second] < top)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(ok.sum(), np.int32)), "at": pa.array(rank[first[ok]].astype(np.int64) * (top + 1) + rank[second[ok]], pa.int64()), "n": pa.array(n[ok], pa.int64())})
        at = np.flatnonzero(follow)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(at), np.int32)), "at": pa.array(at, pa.int64()), "n": pa.array(follow[at], pa.int64())})

    got = pairs.mapInArrow(run, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (got[c].to_numpy() for c in ("kind", "at", "n"))
    follow, among = np.zeros((IDS, kinds)), np.zeros((top + 1, top + 1))
    follow.reshape(-1)[at[kind == 0]] = n[kind == 0]
    among.reshape(-1)[at[kind == 1]] = n[kind == 1]
    return follow, among


def fit(learn: DataFrame, classes: np.ndarray, follow: np.ndarray, epochs: int = attention.EPOCHS, seed: int = 11) -> attention.Weights:
    """Weights after ``epochs`` parts of the training, each over one in ``attention.SHARE`` of all texts; rows that no text moved are noughts."""
    spark, weights = learn.sparkSession, attention.Weights.start(IDS, PAD, seed)
    after, width = attention.logits_after(follow)[0], attention.EMBED
    fixed = spark.sparkContext.broadcast((classes, after))
    names = [f"c{k}" for k in range(2 * width)]
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((weights.rows, weights.square))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = attention.Weights(IDS, *(a.copy() for a in sent.value))
            rng = np.random.default_rng((seed, epoch, TaskContext.get().partitionId()))
            for batch in batches:
                for docs in _blocks(batch.column(0)):
                    own.learn(docs, *fixed.value, END, PAD, rng)
            at = np.flatnonzero(own.moves)
            for k in range(0, len(at), 10_000):
                part = at[k : k + 10_000]
                both = np.c_[own.rows[part], own.square[part]] * own.moves[part, None]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own.moves[part], pa.float64()), *(pa.array(c, pa.float64()) for c in both.T)], ["at", "moves", *names])

        kinds = ", ".join(f"{c} double" for c in names)
        part = learn.where(F.pmod(F.xxhash64("row"), F.lit(attention.SHARE)) == epoch % attention.SHARE)
        got = part.select("ids").mapInArrow(run, f"at int, moves double, {kinds}").groupBy("at").agg(F.sum("moves").alias("moves"), *[F.sum(c).alias(c) for c in names]).toArrow()
        sent.destroy()
        at, moves = got["at"].to_numpy(), got["moves"].to_numpy()
        mean = np.stack([got[c].to_numpy() for c in names], 1) / moves[:, None]
        weights.rows[at], weights.square[at] = mean[:, :width], mean[:, width:]
        weights.moves[at] += moves
    weights.rows[:IDS][weights.moves[:IDS] == 0] = 0
    return weights


def _rare_pairs(encoded: DataFrame, pairs: DataFrame, rank: np.ndarray, within: np.ndarray) -> DataFrame:
    """(row, pair_score): what the counts of pairs that are not in the model add to a text's score."""
    top = attention.PAIRED
    sent = encoded.sparkSession.sparkContext.broadcast((rank < top, within))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, within = sent.value
        for batch in batches:
            pair, n = (c.to_numpy() for c in batch.columns)
            rest = ~(frequent[pair >> 16] & frequent[pair & 0xFFFF])
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair[rest], pa.int64()), "gain": pa.array(attention.pair_gain(n[rest], within[pair[rest] & 0xFFFF]), pa.float64())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                docs = _ids(batch.column(1).slice(at, BLOCK).to_pylist())
                first, second = attention.neighbours(docs, END)
                rest = np.flatnonzero(~(frequent[first] & frequent[second]))
                rows = np.repeat(batch.column(0).slice(at, BLOCK).to_numpy(), [len(d) + 1 for d in docs])
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows[rest], pa.int64()), "pair": pa.array(first[rest] << 16 | second[rest], pa.int64())})

    met = encoded.select("row", "ids").mapInArrow(found, "row long, pair long").join(pairs.mapInArrow(gains, "pair long, gain double").hint("shuffle_hash"), "pair")
    return met.groupBy("row").agg(F.sum("gain").alias("pair_score"))


def lm_scores(docs: DataFrame, training: Column, tokenizer: tuple[str, str]) -> DataFrame:
    """tokenizer: a file of byte-level ranks, and the expression that parts texts. doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training).alias("held_out"), "text")
    learn = docs.where("NOT held_out")
    with own_job(spark):
        counts = materialize(word_counts(learn), "word-counts", TEXT_ROWS)
        sums = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
        ends = learn.count()
        size_n, size_v = (sums.n or 0) + ends, sums.v + (ends > 0)
        z = size_n + 0.5 * (size_v + 1)
        by_n = sorted(((r.n, r.k) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where("n > 1").collect()), reverse=True)
        least, held = 1 << 62, 0
        for n, k in by_n:
            if held + k > HEAD:
                break
            least, held = n, held + k
        got = counts.where(F.col("n") >= least).toArrow()
        head = spark.sparkContext.broadcast(_head(tokenizer, got["w"].to_pylist(), np.log10((got["n"].to_numpy() + 0.5) / z)))
        encoded = materialize(_encode(docs, tokenizer, head, ends, z), "encoded-texts", TEXT_ROWS)

        learn = encoded.where("NOT held_out")
        pairs = materialize(pair_counts(learn), "pair-counts")
        got = pairs.groupBy((F.col("pair") % 65536).cast("int").alias("id")).agg(F.sum("n").alias("n")).toArrow()
        id_counts = np.zeros(IDS)
        id_counts[got["id"].to_numpy()] = got["n"].to_numpy()
        classes, rank = _contexts(pairs, id_counts), attention.ranks_of(id_counts)
        follow, among = _gather(pairs, classes, rank)
        model = spark.sparkContext.broadcast(attention.model(fit(learn, classes, follow), classes, id_counts, follow, rank, among, END, PAD))
        rare = _rare_pairs(encoded, pairs, rank, model.value.within)

    tail = encoded.select("row", F.explode("tail").alias("w"))
    scored = tail.join(counts.hint("shuffle_hash"), "w", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / z)).alias("tail_score"), F.sum((F.coalesce("n", F.lit(0)) > 0).cast("long")).alias("tail_known")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.score(_ids(batch.column(6).slice(at, 100).to_pylist())) for at in range(0, batch.num_rows, 100)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    own = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    out = own.join(scored, "row", "left").join(rare, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(size_n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("pair_score", F.lit(0.0))).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, fold_column(F.col("doc_id")) != 1, (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
