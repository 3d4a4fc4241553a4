r"""Exact token counts by a compiled finite-state transducer.

Byte-level BPE is deterministic from left to right: of the tokens that end a prefix exactly one stands beside the token that ends
where it starts as merging would leave them, so the token that ends each prefix follows from those before it. Reading one more
byte changes the count by a fixed amount that depends on finitely much: on the suffix that may still become part of a token,
and the tokens ending inside it. That is a deterministic transducer. It is joined with the automaton of the pre-tokenizer
(runs of letters, digits, other signs and white space, each with one blank before it, and contractions; white space gives its
last character to what follows). States and transitions are compiled when first met; each transition holds the change of the
token count, which may be negative where a merge takes tokens back. When the bounded table of states is full it is dropped and
compiled anew from the state at hand, so every text runs through the transducer, whatever its words.

Texts are cut into chunks of ``CHUNK`` characters, anywhere. Each chunk gives a map from the states it may be entered in to (exit state,
count); maps compose associatively, in a prefix scan. Where white space follows another sign the automaton always stands as at
its start, so the entry state matters only for a chunk's head, and the counts of whole pieces, transitions from start
to start, are kept in a bounded table.

Null and empty texts have no tokens. Strings of special tokens in a text count as one token each and part the text, as by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White_Space of Unicode; fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Endings that are tokens of their own after an apostrophe; fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

PIECES = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Where white space follows another sign: the place after a match's first sign.
BOUNDARY = re.compile(f"[^{SPACES}](?=[{SPACES}])")
#: Compiled states, remembered pieces and pairs of tokens of a worker at most. A full table of states is dropped and compiled anew.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 150_000, 1_200_000, 1_000_000
#: Characters of a text that make a chunk.
CHUNK = 4096
START = ("start",)
#: Number of the state inside a pre-token that has no byte yet.
ROOT = 0
ONE = [bytes([b]) for b in range(256)]


def byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Merging, and the test whether two tokens can stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs = byte_signs()
        of = lambda s: bytes(signs[c] for c in s)
        self.tokens = {of(s) for s in spec["model"]["vocab"]}
        self.ranks = {(of(a), of(b)): k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.longest = max(map(len, self.tokens))
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    @cached_property
    def heads(self) -> set[bytes]:
        """Proper prefixes of tokens."""
        return {t[:k] for t in self.tokens for k in range(len(t))}

    def merge(self, word: bytes) -> list[bytes]:
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            pair, out, k = (parts[at], parts[at + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def beside(self, a: bytes, b: bytes) -> bool:
        found = self._beside.get((a, b))
        if found is None:
            if len(self._beside) >= MAX_PAIRS:
                self._beside.clear()
            found = self._beside[a, b] = self.merge(a + b) == [a, b]
        return found


class Transducer:
    """States are numbers; ``steps[state]`` maps a character to (state, change of the count)."""

    def __init__(self, path: str):
        import regex

        self.bpe = ByteBpe(path)
        self._letter, self._digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self._spaces = frozenset(SPACES)
        self.pieces: dict[str, int] = {}
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.inner: list[tuple] = []
        self.inner_ids: dict[tuple, int] = {}
        self.inner_steps: list[dict[str, tuple[int, int]]] = []
        self._forget()

    def _id(self, key: tuple) -> int:
        """The number of a state; it holds until the table is dropped."""
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return k

    # A state inside a pre-token: (suffix, tokens that end at each of its cuts or None, counts at the cuts less that at the end).
    # Such states are numbered too; inner_steps[number] maps a character to (number, change).
    def _inner_id(self, state: tuple) -> int:
        k = self.inner_ids.get(state)
        if k is None:
            k = self.inner_ids[state] = len(self.inner)
            self.inner.append(state)
            self.inner_steps.append({})
        return k

    def _byte(self, state: tuple, b: int) -> tuple[tuple, int]:
        suffix, ends, counts = state
        grown, tokens, heads, beside = suffix + ONE[b], self.bpe.tokens, self.bpe.heads, self.bpe.beside
        n = len(grown)
        for cut, before in enumerate(ends):  # one of them holds, since every byte is a token
            if before is not None:
                token = grown[cut:]
                if token in tokens and (not before or beside(before, token)):
                    break
        change, keep = counts[cut] + 1, 0
        while grown[keep:] not in heads:
            keep += 1
        suffix, ends, counts = grown[keep:], list(ends[keep:]), [c - change for c in counts[keep:]]
        for k in range(1, n - keep):
            if ends[k] is not None and suffix[k:] not in heads:
                ends[k], counts[k] = None, 0
            elif ends[k] is None:
                counts[k] = 0
        return (suffix, (*ends, token), (*counts, 0)), change

    def _char(self, state: int, c: str) -> tuple[int, int]:
        got = self.inner_steps[state].get(c)
        if got is None:
            now, total = self.inner[state], 0
            for b in c.encode():
                now, change = self._byte(now, b)
                total += change
            got = self.inner_steps[state][c] = (self._inner_id(now), total)
        return got

    def _kind(self, c: str) -> str:
        return "L" if self._letter.match(c) else "N" if self._digit.match(c) else "W" if c in self._spaces else "O"

    def _open(self, kind: str, c: str, lead: bool) -> tuple[tuple, int]:
        """A pre-token begins with c, or with a blank and c."""
        state, change = self._char(ROOT, " ") if lead else (ROOT, 0)
        state, more = self._char(state, c)
        if c == "'" and not lead:
            return ("quote", state, ""), change + more
        return (kind, state), change + more

    def _move(self, key: tuple, c: str) -> tuple[tuple, int]:
        mode, kind = key[0], self._kind(c)
        if mode == "start":
            if kind == "W":
                state, change = self._char(ROOT, c)
                return ("W", ROOT, state, change, c, True), change
            return self._open(kind, c, False)
        if mode == "W":
            _, before, after, last_change, last, single = key
            if kind == "W":
                state, change = self._char(after, c)
                return ("W", after, state, change, c, False), change
            if last == " ":  # the blank leaves the run and leads the next pre-token
                key, change = self._open(kind, c, True)
                return key, change - last_change
            key, change = self._open(kind, c, False)
            if not single:  # the last character becomes a pre-token of its own
                change += self._char(ROOT, last)[1] - last_change
            return key, change
        if mode == "quote":  # an apostrophe at a start, and letters that may make a contraction
            _, state, seen = key
            if any(x.startswith(seen + c) for x in CONTRACTIONS):
                after, change = self._char(state, c) if not seen else self._char(key[1], c)
                if seen + c in CONTRACTIONS:
                    whole, count = ROOT, 0
                    for x in "'" + seen + c:
                        whole, more = self._char(whole, x)
                        count += more
                    return START, count - self._so_far(seen)
                return ("quote", after, seen + c), self._so_far(seen + c) - self._so_far(seen)
            if not seen and kind == "O":
                state, change = self._char(state, c)
                return ("O", state), change
            if not seen:
                return self._move(START, c)
            state, count = self._letters(seen)
            key, change = self._move(("L", state), c)
            return key, change
        state = key[1]
        if kind == mode:
            state, change = self._char(state, c)
            return (mode, state), change
        return self._move(START, c)

    def _letters(self, seen: str) -> tuple[tuple, int]:
        state, count = ROOT, 0
        for x in seen:
            state, more = self._char(state, x)
            count += more
        return state, count

    def _so_far(self, seen: str) -> int:
        """Count of an apostrophe and the letters after it while no contraction has been made of them."""
        return 1 + self._letters(seen)[1]

    def _forget(self) -> None:
        """Drop all compiled states; numbers given out before are void."""
        for held in (self.keys, self.ids, self.steps, self.inner, self.inner_ids, self.inner_steps):
            held.clear()
        self._inner_id((b"", (b"",), (0,)))  # ROOT
        self.start = self._id(START)

    def _outside(self, key: tuple) -> tuple:
        """A state's key with states inside pre-tokens written out, which outlasts the tables."""
        at = {"start": 1, "W": 3}.get(key[0], 2)
        return (key[0], *(self.inner[k] for k in key[1:at]), *key[at:])

    def _inside(self, key: tuple) -> tuple:
        at = {"start": 1, "W": 3}.get(key[0], 2)
        return (key[0], *(self._inner_id(k) for k in key[1:at]), *key[at:])

    def step(self, state: int, c: str) -> tuple[int, int]:
        got = self.steps[state].get(c)
        if got is None:
            key, change = self._move(self.keys[state], c)
            if key not in self.ids and max(len(self.keys), len(self.inner) // 2) >= MAX_STATES:
                key = self._outside(key)
                self._forget()
                return self._id(self._inside(key)), change
            got = self.steps[state][c] = (self._id(key), change)
        return got

    def _walk(self, text: str, state: int) -> tuple[int, int]:
        total, steps = 0, self.steps
        for c in text:
            state, change = steps[state].get(c) or self.step(state, c)
            total += change
        return state, total

    def run(self, text: str, key: tuple = START) -> tuple[tuple, int]:
        """(exit state, count) of text from a state."""
        state, total = self._walk(text, self._id(self._inside(key)))
        return self._outside(self.keys[state]), total

    def chunk_map(self, text: str, entries: Iterable[tuple]) -> dict[tuple, tuple[tuple, int]]:
        """{entry state: (exit state, count)} of a chunk cut anywhere.

        Up to the first white space behind another sign the entry state matters; from there on every piece begins at the start."""
        cut = BOUNDARY.search(text)
        if cut is None:
            return {s: self.run(text, s) for s in entries}
        head, found, total = text[: cut.start() + 1], PIECES.findall(text, cut.start() + 1), 0
        last = found.pop()
        for p, n in zip(found, map(self.pieces.get, found), strict=True):
            total += self.piece(p) if n is None else n
        exit_, n = self.run(last)
        return {s: (exit_, self.run(head, s)[1] + total + n) for s in entries}

    @staticmethod
    def compose(first: dict, second: dict) -> dict:
        return {s: (second[e][0], n + second[e][1]) for s, (e, n) in first.items()}

    @classmethod
    def scan(cls, maps: list[dict]) -> list[dict]:
        """All prefixes' compositions, by doubling: log2(n) rounds whose members don't depend on each other."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [cls.compose(maps[k - step], maps[k]) for k in range(step, len(maps))]
            step *= 2
        return maps

    def piece(self, text: str) -> int:
        """Count of a piece that begins and ends where white space begins, or with the text: a transition from start to start."""
        n = self._walk(text, self.start)[1]
        if len(text) <= 48 and len(self.pieces) < MAX_PIECES:
            self.pieces[text] = n
        return n

    def count(self, text: str, chunk: int = CHUNK) -> int:
        special = self.bpe.special
        if any(s in text for s in special):
            parts = re.split("|".join(map(re.escape, special)), text)
            return len(parts) - 1 + sum(self.count(p, chunk) for p in parts)
        maps: list[dict] = []
        for k in range(0, len(text), chunk):
            # a chunk can be entered in the start, or in what the one before may leave behind
            entries = {e for e, _ in maps[-1].values()} if maps else {START}
            if maps and len(entries) == 1:
                entries.add(START)
            maps.append(self.chunk_map(text[k : k + chunk], entries))
        return self.scan(maps)[-1][START][1] if maps else 0


_BUILT: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _BUILT:
        _BUILT[path] = Transducer(path)
    return _BUILT[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [machine.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
