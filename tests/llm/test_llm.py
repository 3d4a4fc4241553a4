"""The training-data operators against brute force, exact round trips and held-out accuracy, and their defined edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tidemark.llm.queries")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import attention, chat, decontaminate, gsaca, jaccard_join, langid, line_dedup, lm_score, packing, quality, suffix_dedup, token_counts, wordids  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402
from tidemark.llm.cuckoo import CuckooFilter  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SUBWORDS = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
ODD_TEXTS = [None, "", " ", "\n\n", "word", "a\nb\na", "é́ 漢字 🙂", "x" * 5000, "the quick brown fox jumps over the lazy dog " * 40, "<|endoftext|> hi <|endoftext|>", "\x1c\x85 \t.", "one two three four"]


def frame(spark, texts, extra=True):
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", 1, "clash", 7) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaks string, score long")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD_TEXTS + ODD_TEXTS)


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas().sort_values("doc_id")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    got = Q.queries()[name](spark, sf)
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# 1 quality rules


def base_counts(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(win)
    covered = {j for i, x in enumerate(win) if many[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality(spark, sf, docs, odd):
    for got, texts in ((Q.queries()["op1_quality"](spark, sf), dict(zip(docs.doc_id, docs.text, strict=True))), (quality.quality_rules(odd), dict(enumerate(ODD_TEXTS * 2)))):
        rows = got.collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = base_counts(texts[r.doc_id])
            assert tuple(r[c] for c in COUNTS) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.base_failed and r.kept)
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_rejects_planted_outliers(spark):
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [make(rng.randint(60, 300)) for _ in range(400)] + [re.sub(r" ", "%%% ", make(100)) for _ in range(40)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(frame(spark, texts)).collect()}
    assert all(kept[k] for k in range(400))
    assert not any(kept[k] for k in range(400, 440))


def test_quality_rejects_one_outlying_share(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(400)] + [" | ".join(f"{word()} {word()}" for _ in range(50)) for _ in range(40)]
    rows = quality.quality_rules(frame(spark, texts)).collect()
    assert not any(r.kept for r in rows if r.doc_id >= 400)
    assert all(r.base_failed or r.kept == (r.d2 <= quality.CHI2_975) for r in rows)
    assert np.mean([r.kept for r in rows if r.doc_id < 400]) >= 0.95


def test_quality_of_a_group_with_two_fifths_of_outliers(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(300)] + [" | ".join(f"{word()} {word()}" for _ in range(50)) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = quality.quality_rules(df).collect()
    assert not any(r.kept for r in rows if r.doc_id >= 300)
    assert np.mean([r.kept for r in rows if r.doc_id < 300]) >= 0.95


def mcd_by_hand(x, core=0.5):
    """Squared robust distances of one group, step by step as the module says, in numpy."""
    n, floors = len(x), np.array(quality.FLOORS)
    q = lambda v, p: np.sort(v)[max(0, math.ceil(p * n) - 1)]

    def fit(rows):
        cov = np.cov(rows.T, bias=True) + np.diag(floors**2)
        return np.linalg.slogdet(cov)[1] / 2, rows.mean(0), np.linalg.inv(cov)

    def far(f):
        return np.einsum("ni,ij,nj->n", x - f[1], f[2], x - f[1])

    mid = np.array([q(c, 0.5) for c in x.T])
    z = (x - mid) / np.maximum([(q(c, 0.75) - q(c, 0.25)) / 1.349 for c in x.T], floors)
    d2, kept, lowest = [(z * z).sum(1), np.abs(z).max(1)], [None, None], [np.inf, np.inf]
    while True:
        for s in range(2):
            new = fit(x[d2[s] <= q(d2[s], core)])
            kept[s] = new if kept[s] is None or new[0] < kept[s][0] else kept[s]
        if all(not k[0] < low - quality.FALL for k, low in zip(kept, lowest, strict=True)):
            break
        lowest, d2 = [k[0] for k in kept], [far(k) for k in kept]
    raw = far(min(kept, key=lambda k: k[0]))
    out = far(fit(x[raw <= quality.CHI2_975 * q(raw, 0.5) / quality.CHI2_50]))
    return out / max(1, q(out, 0.5) / quality.CHI2_50)


def test_distances_equal_a_numpy_estimate(spark):
    rng = np.random.default_rng(9)
    groups = {("a", "s"): np.r_[rng.normal(0, [1, 0.3, 0.2, 0.4, 0.2], (260, 5)), rng.normal(4, 1, (90, 5))], ("a", "t"): rng.normal(2, 1, (210, 5)) @ rng.normal(size=(5, 5))}
    rows = [(k, *g, v.tolist(), True) for g, x in groups.items() for k, v in enumerate(x)]
    got = quality.robust_outliers(spark.createDataFrame(rows, "id long, lang string, source string, x array<double>, fit boolean")).collect()
    for (lang, source), x in groups.items():
        d2 = {r.id: r.d2 for r in got if (r.lang, r.source) == (lang, source)}
        assert np.allclose([d2[k] for k in range(len(x))], mcd_by_hand(x), rtol=1e-6)


def test_settled_groups_take_no_more_steps(spark, monkeypatch):
    rng = np.random.default_rng(9)
    groups = {"a": np.r_[rng.normal(0, [1, 0.3, 0.2, 0.4, 0.2], (260, 5)), rng.normal(4, 1, (90, 5))], "b": np.tile(rng.normal(2, 1, 5), (220, 1))}
    rows = [(lang, "s", v.tolist(), True) for lang, x in groups.items() for v in x]
    fitted, keep = [], quality._fit
    monkeypatch.setattr(quality, "_fit", lambda df, keys, *more: fitted.append({r.gid for r in df.select("gid").distinct().collect()}) or keep(df, keys, *more))
    quality.robust_outliers(spark.createDataFrame(rows, "lang string, source string, x array<double>, fit boolean"))
    # the group of equal vectors falls no more after its first step; the last fit is the reweighting of both
    assert fitted[0] == fitted[-1] == {"a\x1fs", "b\x1fs"}
    assert fitted[2:-1] and all(f == {"a\x1fs"} for f in fitted[2:-1])


def test_native_matrices(spark):
    a = np.random.default_rng(1).normal(size=(5, 5))
    cov = a @ a.T + np.eye(5)
    low = np.linalg.cholesky(cov)
    packed = F.array(*[F.lit(float(cov[i, j])) for i in range(5) for j in range(i + 1)])
    r = spark.range(1).select(quality.cholesky(packed).alias("l")).select("l", quality.inverse_factor(F.col("l")).alias("w")).first()
    assert np.allclose(r.l, [low[i, j] for i in range(5) for j in range(i + 1)])
    assert np.allclose(r.w, [np.linalg.inv(low)[i, j] for i in range(5) for j in range(i + 1)])


# 2 chat


def test_chat_round_trip_and_machine(spark):
    t, rng = chat.INSTRUCT, random.Random(1)
    bits = [*t.controls, "[~INST]", "<~/s>", "~", "<", "[", " ", "a", "\n", "[~~OUT]", "<<SYS"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        role = rng.choice(["user", "assistant", "system", "tool", "", text])
        whole = "".join(s for s, _ in t.segments(role, text))
        assert t.read(whole) == (role, text)
        assert not any(c in t.escape(text) for c in t.controls)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (2, 0, "assistant", "no"), (3, 0, None, None), (None, 0, "user", "x"), (4, 1, "assistant", "b"), (4, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(b"</s>").hexdigest()
    assert [got[k].valid for k in (1, 2, 3, None, 4)] == [True, False, False, False, True]
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_segments_are_read_in_any_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    segments = chat.format_chats(rows)
    want = {r.conv_id: r.turns_sha256 for r in chat.read_chats(segments, ordered=True).collect()}
    assert {r.conv_id: r.turns_sha256 for r in chat.read_chats(segments.orderBy(F.xxhash64("text"))).collect()} == want


# 3 suffix arrays


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(3000):
        t = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randint(0, 30)))
        assert gsaca.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_arrays_side_by_side(monkeypatch):
    rng = random.Random(3)
    for short in (512, 20):
        monkeypatch.setattr(gsaca, "SHORT", short)
        for _ in range(150):
            texts = [bytes(rng.choice(rng.choice([b"a", b"ab", b"abcd"])) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
            sa, at = gsaca.suffix_arrays(texts), 0
            for t in texts:
                assert (sa[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
                at += len(t)


def test_units_hold_each_string_once_and_equal_strings_meet(monkeypatch):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 120))).encode() for _ in range(100)] + [b"a" * 500, b"ab" * 300, b"", b"x" * 50, b"y" * 49]
    for width, block in ((50, 1 << 18), (50, 300), (24, 1 << 18), (64, 1 << 18)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        found = suffix_dedup.units(texts, width)
        bucket, key, held = {}, {}, [set() for _ in texts]
        for of, start, n, h, k in zip(*(found[c].tolist() for c in ("of", "start", "strings", "h", "k")), strict=True):
            assert 1 <= n <= suffix_dedup.REACH
            assert key.setdefault(texts[of][start : start + n + width - 1], k) == k
            for at in range(start, start + n):
                assert at not in held[of]
                held[of].add(at)
                assert bucket.setdefault(texts[of][at : at + width], h) == h
        assert held == [set(range(max(0, len(t) - width + 1))) for t in texts]
        assert (suffix_dedup.units(texts, width, whole=False)["h"] == found["h"]).all()


def removed(rows, width=50):
    """{doc_id: (bytes, removed, spans, kept)} by a table of all strings."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), [b[k : k + width] for k in range(len(b) - width + 1)]
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + width] = True
        seen.update(own)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("forced", [{}, {"BUCKET": 1, "BROADCAST_LIMIT": 10, "BLOCK": 300}])
def test_suffix_dedup(spark, docs, forced, monkeypatch):
    for k, v in forced.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rng = random.Random(4)
    base = ["".join(rng.choice("ab ") for _ in range(120)) for _ in range(5)] + ["ab" * 60, "a" * 90]
    rows = [(k, "".join(b[rng.randint(0, 30) : rng.randint(40, len(b))] + rng.choice(["", "é", "\n"]) for b in rng.choices(base, k=3))) for k in range(80)]
    rows += [(1000 + k, t) for k, t in enumerate([*docs.text[:40], *ODD_TEXTS])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows)


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b = ("".join(rng.choices("abcdefgh ", k=80)) for _ in range(2))
    rows = [(1, a), (2, a + "x"), (2, a), (None, a), (3, a), (7, b), (7, b), (8, b), (None, b)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 80, 0), (2, 81, 80), (2, 80, 80), (None, 80, 0), (3, 80, 80), (7, 80, 0), (7, 80, 0), (8, 80, 80), (None, 80, 0)], key=str)
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 4 token counts


def test_places_are_joined_by_one_number(spark):
    rows = [(5, 7, 1), (5, 7, 2), (6, 7, 3), (8, 9, 4)]
    places = spark.createDataFrame(rows, "h long, k long, doc_id long")
    found = spark.createDataFrame([(5, 7, 1, True), (8, 8, 4, False)], "h long, k long, low long, sorting boolean")
    got = suffix_dedup._met(places, found.hint("merge"))
    assert sorted(map(tuple, got.select("h", "k", "doc_id", "low", "sorting").collect())) == [(5, 7, 1, 1, True), (5, 7, 2, 1, True)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[k#\d+L?\], \[k#\d+L?\]", plan)


def test_runs_are_taken_out_within_their_texts():
    texts = [b"", b"abcdef", b"ghi", b"", b"j", b""]
    gone = np.array([1, 0, 1, 1, 0, 1, 1, 1, 0, 1], bool)
    size, removed, spans, kept = (x.to_pylist() for x in suffix_dedup._taken_out(texts, gone))
    assert size == [0, 6, 3, 0, 1, 0] and removed == [0, 4, 2, 0, 1, 0] and kept == [b"", b"be", b"i", b"", b"", b""]
    assert [[(s["start"], s["end"]) for s in x] for x in spans] == [[], [(0, 1), (2, 4), (5, 6)], [(0, 2)], [], [(0, 1)], []]


def test_transducer_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    lib, m, rng = Tokenizer.from_file(BYTE), token_counts.Transducer(BYTE), random.Random(3)
    parts = [*"ab'srevltdm  \n\t.,!1234éß　\x85漢字🙂", "the", "ing", " '", "'ll", "<|endoftext|>", "\r\n", "\x1c", "don't"]
    for bound in (100_000, 50):  # the smaller one has the states dropped again and again
        monkeypatch.setattr(token_counts, "MAX_STATES", bound)
        for _ in range(4000):
            x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
            assert m.count(x, chunk=rng.choice([1, 2, 3, 7, 4096])) == len(lib.encode(x, add_special_tokens=False).ids), repr(x)


def test_chunk_maps_compose():
    m, rng = token_counts.Transducer(BYTE), random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice([*"it's a \t\nof12.", "the", " '", "'ll"]) for _ in range(rng.randint(1, 12))) for _ in "ab")
        entries = [token_counts.START, m.run("th")[0], m.run(" 1")[0], m.run("'")[0]]
        first = m.chunk_map(a, entries)
        second = m.chunk_map(b, {e for e, _ in first.values()})
        both = m.compose(first, second)
        assert all(both[s] == m.run(a + b, s) for s in entries)
        assert m.scan([first, second])[-1] == both


def test_texts_are_cut_into_chunks_and_entered_in_other_states(docs):
    m, seen = token_counts.Transducer(BYTE), []
    whole = m.chunk_map
    m.chunk_map = lambda text, entries: seen.append(set(entries)) or whole(text, entries)
    n = [m.count(t or "") for t in docs.text]
    assert sum(len(s) > 1 for s in seen) > 20 and sum(s != {token_counts.START} for s in seen) > 20
    assert n == [m.count(t or "", chunk=1 << 30) for t in docs.text]


def test_counts_of_odd_texts(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    for r in token_counts.count_tokens(odd, BYTE, limit=3).collect():
        t = (ODD_TEXTS * 2)[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 3)


def test_counts_of_long_texts_and_no_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "it's", "12", "\n", "漢字", "abcdefghij" * 3]) for _ in range(150_000))
    lib = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame([(None, text), (1, None), (1, "z" * 9000)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.count_tokens(df, BYTE).collect()) == sorted([len(lib.encode(text, add_special_tokens=False).ids), 0, len(lib.encode("z" * 9000, add_special_tokens=False).ids)])
    assert token_counts.count_tokens(df.limit(0), BYTE).count() == 0


# 5 line dedup


def without_frequent(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    df = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if df.get(key(x), 0) < least) for t in rows]


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_line_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LIMIT", limit)
    rng = random.Random(6)
    rows = ["\n".join(rng.choice(["A", " a\t", "b", "", "É", "é", f"u{rng.randint(0, 200)}"]) for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, ""]
    got = line_dedup.line_dedup(frame(spark, rows), min_docs=10, shards=3)
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(without_frequent(rows, 10)))
    assert "leaks" in got.columns
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_stores_start_no_other_python_workers(spark, monkeypatch):
    docs = frame(spark, ["a\nb", "a\nc", "d"])

    def made_in_python(*args, **kwargs):
        raise AssertionError("rows from Python need workers of another kind")

    monkeypatch.setattr(type(spark), "createDataFrame", made_in_python)
    store = line_dedup.LineStore(spark, 3, 1).insert(docs)
    more = store.insert(docs.where("doc_id = 0"))
    assert sorted(r.n for r in more.counts.collect()) == [1, 1, 2, 3]
    assert [r.n_dropped for r in line_dedup.line_dedup(docs, 2).orderBy("doc_id").collect()] == [1, 1, 0]
    assert not hasattr(line_dedup, "pd")


def test_stages_are_tables_of_their_own(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.repeated_lines):
        docs = stage(spark, docs, sf)
        assert "MapInArrow" not in docs._jdf.queryExecution().sparkPlan().toString()


def test_store_is_reversible(spark):
    one, two = frame(spark, ["a\nb", "a\nc", "b"]), frame(spark, ["a\nd", "d", "c\nc"])
    store = line_dedup.LineStore(spark, 2, 1).insert(one)
    back = store.insert(two).delete(two)
    counts = lambda s: sorted((r.h1, r.h2, r.n) for r in s.counts.collect())
    assert counts(store) == counts(back)
    assert counts(store.insert(two)) == counts(line_dedup.LineStore(spark, 2, 1).insert(one.unionByName(two)))
    assert counts(store.delete(one)) == []


def test_store_touches_few_shards_and_grows(spark, monkeypatch):
    counts = lambda s: sorted((r.h1, r.h2, r.n) for r in s.counts.collect())
    store = line_dedup.LineStore(spark, 50, 1).insert(frame(spark, ["\n".join(f"l{k}" for k in range(60))]))
    more = store.insert(frame(spark, ["l1\nnew"]))
    assert [len(gone) for _, gone in more.tables] == [2, 0]
    whole = line_dedup.LineStore(spark, 1, 1).insert(frame(spark, ["\n".join(f"l{k}" for k in range(60)), "l1\nnew"]))
    assert counts(more) == counts(whole)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 8)
    grown = whole.insert(frame(spark, ["l2"]))
    assert grown.shards == 4 and len(grown.tables) == 1
    assert counts(grown.delete(frame(spark, ["l2"]))) == counts(whole)
    monkeypatch.setattr(line_dedup.LineStore, "TABLES", 1)
    assert len(more.insert(frame(spark, ["l3"])).tables) == 1


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_line_dedup_leaves_columns_alone(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LIMIT", limit)
    df = spark.createDataFrame([(k % 3, "x\ny" if k < 10 else "y", "r", 5, True) for k in range(12)], "doc_id long, text string, row string, drops long, _row boolean")
    got = line_dedup.line_dedup(df, min_docs=10).collect()
    assert {(r.text, r.row, r.drops, r._row) for r in got} == {("", "r", 5, True)} and len(got) == 12  # equal doc_ids are documents of their own


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 60_000)
    c = CuckooFilter.build(h[:20_000])
    assert c.contains(h[:20_000]).all()
    assert c.contains(h[20_000:]).mean() < 0.01
    c.delete(h[:10_000])
    assert c.contains(h[10_000:20_000]).all()
    assert c.contains(h[:10_000]).mean() < 0.01
    assert (CuckooFilter.from_bytes(c.to_bytes()).contains(h) == c.contains(h)).all()


# 6 packing


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    lib, pieces, bins = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(list)
    for r in packing.harmonic_pack(odd, WORD, capacity=256).collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(ODD_TEXTS * 2):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[k])
        assert b"".join(b for _, b, _ in got) == np.array(ids, "<u4").tobytes()
        assert {n for *_, n in got} == {len(ids)}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_pads_and_cuts_little(docs):
    lengths = [(k, len(t or "") // 3 + 1) for k, t in enumerate(docs.text)] + [(1000 + k, n) for k, n in enumerate([1, 2047, 2048, 2049, 4096, 100_000])]
    rows = packing.pack_lengths(lengths, 2048)
    size, pieces = Counter(), Counter(d for d, *_ in rows)
    for _, _, n, q, at in sorted(rows, key=lambda r: (r[3], r[4])):
        assert at == size[q]
        size[q] += n
    padding = sum(2048 - n for n in size.values() if n & (n - 1))
    assert max(size.values()) <= 2048 and sum(size.values()) == sum(n for _, n in lengths)
    assert padding < 0.015 * sum(size.values())
    cuts = [pieces[k] - n // 2048 for k, n in lengths]
    assert sum(cuts) / len(cuts) < 3.2
    for length in range(1, 5000):
        parts = packing.cut(length, 2048)
        assert sum(n for n, _ in parts) == length and all(n * k <= 2048 for n, k in parts)


def test_packing_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one two"), (4, "three"), (4, "three"), (5, None)], "doc_id long, text string")
    got = packing.harmonic_pack(df, WORD).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == {None: 1, 4: 2, 5: 1}
    assert packing.harmonic_pack(df.limit(0), WORD).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    lib, enc, rng = Tokenizer.from_file(WORD), wordids.WordEncoder(WORD), random.Random(5)
    parts = [*"ab'sreABÉİK \n.,!12éß　漢🙂'", "the", "ing.", "'ll", "<|endoftext|>", "<|", "\x1c", "é", "́", "ΣΑΣ", "ǅ", "ñ."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for x, b in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids, repr(x)


def test_word_ids_of_letters_and_signs_come_from_the_model_alone():
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(WORD), random.Random(8)
    enc, small = wordids.WordEncoder(WORD), wordids.WordEncoder(WORD, cache_words=5)
    alone, keep = [], enc._alone
    enc._alone = lambda words: alone.extend(words) or keep(words)
    texts = ["Ñandú*** quick&&& naïve, fox", "Ñandú, the.,&&& x1 don't İx ª ΣΑΣ", "Ñandú&&& é \xa0ÿ"]
    texts += [" ".join("".join(chr(rng.randrange(1, 256)) for _ in range(rng.randint(1, 4))) for _ in range(200)).replace("<|", "") for _ in range(40)]
    texts += ["".join(f" a{chr(c)}b,{chr(c)}" for c in range(at, at + 5000) if not 0xD800 <= c < 0xE000).replace("<|", "") for at in range(0, 0x20000, 5000)]
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode([t.encode() for t in texts[:3]])] == want[:3]
    assert sorted(alone) == sorted({"***", "&&&", ",", ".,&&&", "x1", "don't", "İx", "ª", "ΣΑΣ", "é", "\xa0ÿ", ""})
    for e in (enc, small):
        for k in range(0, len(texts), 7):
            got = e.encode([t.encode() for t in texts[k : k + 7]])
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want[k : k + 7]
    assert len(small.cache) < 10_000 and list(enc.encode([])) == [] and list(enc.encode(pa.array([None, "", " "]))) == [b"", b"", b""]
    assert [b"".join(enc.encode(pa.array(texts).slice(k, 1))) for k in range(len(texts))] == list(enc.encode([t.encode() for t in texts]))  # slices


# 7 decontamination


def sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_words_of_scripts_without_blanks():
    assert decontaminate.words("Ab c_1 漢字かな, สวย é") == ["ab", "c_1", "漢", "字", "か", "な", "ส", "ว", "ย", "é"]
    assert decontaminate.words(None) == []


def traced(a, b):
    """(score, matched, start, end) by a whole table and a walk back through it."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    i, j = map(int, np.unravel_index(h.argmax(), h.shape))
    score, end, matched = int(h[i, j]), j, 0
    while h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (2 if same else -1):
            matched, i, j = matched + bool(same), i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matched, (j if score else 0), (end if score else 0)


def test_alignment_places():
    rng = random.Random(4)
    a, b = ([np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 14))]) for _ in range(300)] for _ in range(2))
    assert decontaminate.align(a, b) == [traced(x, y) for x, y in zip(a, b, strict=True)]


def test_alignment():
    rng = random.Random(1)
    a, b = ([np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))]) for _ in range(150)] for _ in range(2))
    assert [x[0] for x in decontaminate.align(a, b)] == [sw(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("limit", [64 << 20, 3000])
def test_leaks(spark, sf, docs, limit):
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    rng = random.Random(8)
    clean = [t for t in docs.text if not any(i in t for i in items.text)][:60]
    pool = " ".join(clean).split()
    edited = []
    for k, t in enumerate(items.text[:20]):
        w = [rng.choice(pool) if rng.random() < 0.12 else x for x in t.split()]
        edited.append(" ".join([*clean[k].split()[:50], *w, "end"]))
    df = frame(spark, [*clean, *edited, *ODD_TEXTS])
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.find_leaks(df, spark.createDataFrame(items[["item_id", "text"]]), limit=limit).collect()}
    assert all(not got[k] for k in range(60))
    assert all(int(items.item_id[k]) in got[60 + k] for k in range(20))
    assert all(not got[80 + k] for k in range(len(ODD_TEXTS)))
    assert decontaminate.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).where(F.size("leaks") > 0).count() == 0


def test_leaks_equal_exhaustive_alignment(spark):
    """Every item against every whole document; what is found has the best alignment there is, and no copy is missed."""
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 40)))) for k in range(12)] + [(50, "漢字仮名交文章例")]
    texts = []
    for k in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 80))
        if k % 3 == 0:
            copy = decontaminate.words(items[k % 13][1])
            for _ in range(len(copy) // 8):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            w[10:10] = copy
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, x.item_id): (x.score, x.matched) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect() for x in r.leaks}
    want = {}
    for k, t in enumerate(texts):
        for i, item in items:
            a, b = decontaminate.words(item), decontaminate.words(t)
            number = {w: n for n, w in enumerate(dict.fromkeys(a + b))}
            score, matched, *_ = traced([number[x] for x in a], [number[x] for x in b]) if b else (0, 0)
            if score >= 0.4 * 2 * len(a) and matched >= 6:
                want[k, i] = (score, matched)
    assert got == want and len(want) >= 20


# 8 language ID


def test_language(spark, sf, docs, odd):
    rows = {r.doc_id: r for r in Q.queries()["op8_langid"](spark, sf).collect()}
    held = [(r, x) for r, x in ((rows[i], lang) for i, lang in zip(docs.doc_id, docs.lang, strict=True)) if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert np.mean([r.lang_pred == x for r, x in held if x]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = langid.train(odd, F.lit(True))
    for r in langid.predict(odd, model).collect():
        t = (ODD_TEXTS * 2)[r.doc_id]
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    assert langid.LangModel([], np.zeros((langid.BUCKETS, 0)), np.ones(langid.BUCKETS), 1.0).predict("abc") == ("und", 0.0)
    assert (langid.train(odd.limit(0), F.lit(True))).langs == []


def test_signs_without_letters_and_repeated_texts(spark):
    model = langid.LangModel(["a"], np.zeros((langid.BUCKETS, 1), np.float32), np.ones(langid.BUCKETS), 1.0)
    assert [model.predict(t)[0] for t in ("²½ 12_", "ª", "漢", "é", "")] == ["und", "a", "a", "a", "und"]
    rows = [(None, "the same text", "a")] * 3000 + [(1, f"text number {k}", "b") for k in range(500)]
    got = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=50)
    assert got.langs in (["a", "b"], ["b"])  # one distinct text of a language may not be picked


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 10 + int(rng.integers(0, 500))]), np.array([1.0, 0.3], np.float32), k % 2) for k in range(300)]
    w = langid.ftrl(rows, 2, l1=0.5)
    assert (w[[0, 1]] != 0).all()
    assert (w[10:510] == 0).mean() > 0.9
    assert langid.temperature(np.array([[8.0, 0.0]] * 10), np.array([0] * 7 + [1] * 3)) > 2


def test_ftrl_by_hand():
    """The updates coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32), int(rng.integers(3))) for _ in range(25)]
    z, n, order = np.zeros((12, 3)), np.zeros((12, 3)), np.random.default_rng(7)
    lead = lambda a, b: 0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / (1.0 + math.sqrt(b) + 0.1)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = [[lead(z[i, c], n[i, c]) for c in range(3)] for i in at]
            s = [sum(float(x[j]) * w[j][c] for j in range(4)) for c in range(3)]
            p = [math.exp(v - max(s)) for v in s]
            for j, i in enumerate(at):
                for c in range(3):
                    g = float(x[j]) * (p[c] / sum(p) - (c == y))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) * w[j][c]
                    n[i, c] += g * g
    got = langid.ftrl(rows, 3)
    assert np.allclose(got[:12], [[lead(z[i, c], n[i, c]) for c in range(3)] for i in range(12)], atol=1e-5)
    assert not got[12:].any()


def test_long_texts_are_read_in_blocks(monkeypatch):
    from tidemark.llm import shingles

    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abc漢é ", k=rng.randint(1, 9))) for _ in range(4000))
    whole, grams = shingles.word_hashes(text.encode()), langid.gram_counts(text)
    for block in (7, 1000):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(langid, "BLOCK", block)
        assert (shingles.word_hashes(text.encode()) == whole).all()
        assert (langid.gram_counts(text) == grams).all()


# 9 LM scoring


def test_windows_score_each_token_once():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 100)]
    x, y, owner = attention.windows(docs, 60, 61)
    for k, d in enumerate(docs):
        stream, targets = np.r_[60, d], y[owner == k].ravel()
        assert targets[targets >= 0].tolist() == [*d.tolist(), 60]
        for row, start in zip(x[owner == k], range(0, len(d) + 1, attention.SCORED), strict=True):
            for j, v in enumerate(row):
                at = start + j - attention.CONTEXT
                assert v == (stream[at] if 0 <= at < len(stream) else 61)


def test_model_is_a_distribution_and_causal():
    rng = np.random.default_rng(2)
    sample = [rng.integers(0, 20, 40).astype(np.int32) for _ in range(30)]
    ids, end, pad = 23, 21, 22
    classes, rank = attention.cluster(sample, ids, end), attention.ranks(sample, ids, end)
    counts, follow, pairs = np.zeros(ids), np.zeros((ids, attention.CLASSES)), np.zeros((attention.PAIRED + 1, attention.PAIRED + 1))
    for d in sample:
        a, b = np.r_[end, d], np.r_[d, end]
        np.add.at(counts, b, 1)
        np.add.at(follow, (a, classes[b]), 1)
        np.add.at(pairs, (rank[a], rank[b]), 1)
    m = attention.train(sample, classes, counts, follow, rank, pairs, end, pad, epochs=1)
    head = rng.integers(0, 20, 10).astype(np.int32)
    # the probabilities of all next ids sum to one: differences of scores of the text with and without one more id
    end_free = [m.score([np.r_[head, t].astype(np.int32)])[0] - last(m, np.r_[head, t].astype(np.int32), end) for t in range(ids)]
    before = m.score([head])[0] - last(m, head, end)
    assert abs(sum(10 ** (e - before) for e in end_free) - 1) < 2e-3


def last(m, d, end):
    """log10 probability of the end after d."""
    flat, y, owner = attention.layout([d], m.end, m.pad)
    keep = attention.layout
    try:
        attention.layout = lambda *_: (flat, np.where((np.arange(y.size).reshape(y.shape) == len(d)), y, -1), owner)
        return m.score([d])[0]
    finally:
        attention.layout = keep


def test_lm(spark, docs, odd):
    texts = [*docs.text[:60], *ODD_TEXTS]
    df = frame(spark, texts)
    got = lm_score.lm_scores(df, F.col("doc_id") % 5 != 1, SUBWORDS).collect()
    counts = Counter()
    for k, t in enumerate(texts):
        if k % 5 != 1:
            counts.update([*lower(t).encode().split(), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        w = [*lower(texts[r.doc_id]).encode().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, r.doc_id % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert lm_score.lm_scores(df.limit(0), F.lit(True), SUBWORDS).count() == 0


def test_lm_learns_from_all_training_texts(spark, docs, monkeypatch):
    texts = [*docs.text[:50], *ODD_TEXTS]
    df = frame(spark, texts)
    ids = [lm_score.encode_words(lm_score.encoder(*SUBWORDS), (t or "").lower().encode().split()) for t in texts]
    encoded = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(ids)], "row long, ids binary")
    own = [np.frombuffer(b, "<u2").astype(int) for b in ids]
    pairs = Counter(p for d in own for p in zip([lm_score.END, *d.tolist()], [*d.tolist(), lm_score.END], strict=True))
    assert {(r.pair >> 16, r.pair & 0xFFFF): r.n for r in lm_score.pair_counts(encoded).collect()} == pairs
    # each text's windows move the weights in each pass; with shares, each text does in one pass of as many as there are shares
    follow = np.zeros((lm_score.IDS, attention.CLASSES))
    for share, epochs in ((1, 2), (3, 3)):
        monkeypatch.setattr(attention, "SHARE", share)
        weights = lm_score.fit(encoded, np.zeros(lm_score.IDS, int), follow, epochs=epochs)
        assert set(np.flatnonzero(weights.moves[: lm_score.IDS])) - {lm_score.PAD} == {lm_score.END, *(int(i) for d in own for i in d)}
    # scores are the same whether a pair's count is in the model or comes from the table
    train = F.col("doc_id") % 5 != 1
    want = {r.doc_id: r.score for r in lm_score.lm_scores(df, train, SUBWORDS).collect()}
    monkeypatch.setattr(attention, "PAIRED", 30)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(df, train, SUBWORDS).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=2e-3, abs_tol=0.05) for k in want)


def test_lm_attention_learns_from_every_text_by_default(spark, docs):
    encoding = lm_score.encoder(*SUBWORDS)
    ids = [lm_score.encode_words(encoding, (t or "").lower().encode().split()) for t in docs.text[:50]]
    encoded = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(ids)], "row long, ids binary")
    weights = lm_score.fit(encoded, np.zeros(lm_score.IDS, int), np.zeros((lm_score.IDS, attention.CLASSES)))
    assert set(np.flatnonzero(weights.moves[: lm_score.IDS])) - {lm_score.PAD} == {lm_score.END, *(int(i) for b in ids for i in np.frombuffer(b, "<u2"))}


def test_training_takes_each_window_once_in_runs_of_any_length(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 100, 333)]
    classes, after = rng.integers(0, attention.CLASSES, 62), rng.normal(size=(62, attention.CLASSES)).astype(np.float32)
    got = []
    for run in (1, 3, 8):
        monkeypatch.setattr(attention, "RUN", run)
        weights = attention.Weights.start(62, 61)
        weights.learn(docs, classes, after, 60, 61, np.random.default_rng(0), batch=10**6)
        got.append(weights)
    assert all(np.allclose(w.rows, got[0].rows, atol=1e-4) and np.allclose(w.square, got[0].square, rtol=1e-3) for w in got)


def test_subwords_of_cut_texts(monkeypatch):
    encoding = lm_score.encoder(*SUBWORDS)
    words_ = [*"a b\u3000 \u3000c it's 12 -- <|endoftext|> é́ 漢字 🙂".encode().split(), b"x" * 300]
    want = encoding.encode_ordinary((b" " + b" ".join(words_)).decode())
    for run in (1, 2, 1000):
        monkeypatch.setattr(lm_score, "RUN", run)
        assert np.frombuffer(lm_score.encode_words(encoding, words_), "<u2").tolist() == want
    assert lm_score.encode_words(encoding, []) == b""


def test_subwords_of_frequent_words_are_looked_up(monkeypatch):
    texts = [t.encode() for t in ("It's a cat,  A\tcat\u3000 \u3000a", "", "dog a -- dog 漢字 é́ \x1c🙂 x\xa0", "a cat's " + "y" * 30, "cat a a", "z\u2003 \u2003")]
    split = [t.lower().split() for t in texts]
    flat = [w for words in split for w in words]
    head = [b"a", b"cat", b"\0" + bytes(16), "漢字".encode(), "\u3000a".encode(), b"it's"]
    encoding = lm_score.encoder(*SUBWORDS)
    want = [lm_score.encode_words(encoding, words) for words in split]
    keep, encoded = lm_score.encode_words, []
    monkeypatch.setattr(lm_score, "encode_words", lambda e, words: encoded.append(words) or keep(e, words))
    for known in ([], head):
        at_of, _, ids, cuts = lm_score._head(SUBWORDS, known, np.zeros(len(known)))
        encoded.clear()
        assert lm_score.encode_split(SUBWORDS, texts, split, np.array([at_of.get(w, -1) for w in flat]), ids, cuts) == want
        whole = [split[k] for k in (0, 2, 5)]  # those with white space beyond ASCII
        assert encoded[1:] == whole and encoded[0] == [b"x" if lm_score.BEYOND.search(w) else w for w in flat if w not in known]
    assert lm_score.encode_split((SUBWORDS[0], r"\S+|\s+"), texts[:1], split[:1], np.full(len(split[0]), -1), ids[:0], np.zeros(1, int)) == [keep(lm_score.encoder(SUBWORDS[0], r"\S+|\s+"), split[0])]


def test_lm_sees_distinct_words_only(monkeypatch):
    texts = ["It's a cat,  A\tcat ", None, "", " \n", "dog a -- dog 漢字 é́ \x1c🙂 x\xa0", "a cat's " + "y" * 30, "ÀB ab zzz zzz zzz", "z   ", " ".join(["rare"] * 300)]
    column = pa.array(["the", *texts], pa.string()).slice(1)
    split = [(t or "").encode().lower().split() for t in texts]
    keys = [b"a", b"cat", lm_score.word_key(b"y" * 30), "漢字".encode(), "x\xa0".encode()]
    at_of, shares, ids, cuts = lm_score._head(SUBWORDS, keys, -np.arange(1.0, 6))
    keep, encoded = lm_score.encode_words, []
    monkeypatch.setattr(lm_score, "encode_words", lambda e, words: encoded.append(words) or keep(e, words))
    for tokenizer in (SUBWORDS, (SUBWORDS[0], r"\S+|\s+")):
        n, found, base, blobs, tails = lm_score.encode_texts(tokenizer, column, at_of, shares, ids, cuts)
        inside = [[at_of.get(lm_score.word_key(w)) for w in words] for words in split]
        assert n.tolist() == list(map(len, split)) and found.tolist() == [sum(k is not None for k in i) for i in inside]
        assert np.allclose(base, [sum(shares[k] for k in i if k is not None) for i in inside])
        assert blobs == [keep(lm_score.encoder(*tokenizer), words) for words in split]
        assert tails.to_pylist() == [[lm_score.word_key(w) for w, k in zip(words, i, strict=True) if k is None] for words, i in zip(split, inside, strict=True)]
    spelt = [w for w in encoded[0] if w != b"x"]
    assert len(spelt) == len(set(spelt)) and spelt.count(b"rare") == 1
    assert lm_score.encode_texts(SUBWORDS, column[:0], at_of, shares, ids, cuts)[3] == []
    for size, cuts in ((1, [(k, 1) for k in range(len(texts))]), (10**6, [(0, len(texts))])):
        monkeypatch.setattr(lm_score, "BYTES", size)
        got = list(lm_score.cut_texts(column))
        assert got == cuts or size == 1 and [k for at, n in got for k in range(at, at + n)] == list(range(len(texts))) and all(sum(map(bool, texts[at : at + n])) <= 1 for at, n in got)
    words, place, owner = lm_score.split_words(column)
    assert [[lm_score.listed(words)[w] for w in place[owner == k]] for k in range(len(texts))] == split


def test_lm_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    got = lm_score.lm_scores(df, F.lit(True), SUBWORDS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in got) == [(0, 4, 11), (2, 3, 11), (2, 3, 11), (3, 1, 11)]
    assert len({r.score for r in got if r.doc_id == 2}) == 1


# 10 Jaccard join


def classes_by_hand(rows, percent=80):
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, w in ((i, words(lower(t))) for i, t in rows)}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("forced", [{}, {"BLOCK": 8, "LEAF": 2, "SAMPLE": 1, "COMMON": 2, "IDS_LIMIT": 0}])
def test_jaccard(spark, forced, monkeypatch):
    for k, v in forced.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    common = rng.choices(vocab, k=40)
    base = [rng.choices(vocab, k=rng.randint(4, 90)) for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w + common if k % 4 == 0 else w)))
    rows += [(500 + k, t) for k, t in enumerate(ODD_TEXTS * 2)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_of_null_and_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(None, a), (4, a), (4, b), (9, b), (2, a), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 2), (4, 2, 2), (9, 2, 2), (2, 2, 2), (None, 0, None)], key=str)


def test_hubs_of_the_link_graph(spark, monkeypatch):
    from tidemark.llm import components

    monkeypatch.setattr(components, "HUB_EDGES", 3)
    monkeypatch.setattr(components, "HUB", 4)
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(k, k + 1) for k in range(200, 260)] + [(39, 120)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in [*range(40), *range(100, 130)]}, **{k: 200 for k in range(200, 261)}}


# the pipeline


def test_pipeline(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    before = spark.read.parquet(f"{sf}/documents.parquet")
    kept, df = {}, before
    for name, stage in pipeline.STAGES[:-1]:
        df = pipeline.materialize(stage(spark, df, sf), name)
        assert df.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    assert kept["language_id"] == {i: t for i, t in texts.items() if i in kept["language_id"]}
    order = list(kept["language_id"])
    assert kept["line_dedup"] == dict(zip(order, without_frequent([texts[i] for i in order], 10), strict=True))
    want = classes_by_hand(kept["line_dedup"].items())
    assert set(kept["jaccard_join"]) == {i for i, (_, c) in want.items() if c == i}
    items = pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()
    assert not any(t in x for x in kept["decontamination"].values() for t in items)
    rows = pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert {r.doc_id for r in rows} == set(kept["decontamination"])


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in entry.queries()}
