"""Token ids of whole texts by a library tokenizer that never joins across ASCII white space, through a bounded cache of words.

Words are split, numbered and put back by Arrow: only a batch's distinct words are seen one by one."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings

#: Words kept by each Python worker; words beyond it are encoded again in each batch that has them.
CACHE_WORDS = 450_000
#: Letters of ASCII and Latin-1 that have a lower case, or are one; signs of ASCII, but for the apostrophe, which may begin a piece of its own.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba")
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*$"
#: The characters that byte-level models have for bytes which are not printed in Latin-1.
NAMES = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_CACHES: dict[tuple, WordEncoder] = {}


def _blobs(ids: list[int], cuts: list[int]) -> pa.Array:
    """Little-endian 32-bit ids between cuts, which begin with 0."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(4 * np.array(cuts, np.int64)), pa.py_buffer(np.array(ids, "<u4"))])


def _listed(words: pa.Array) -> list[str]:
    """Words without white space of ASCII."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py().split("\n") if len(words) else []


def _meet(where: np.ndarray, yes: pa.Array, no: pa.Array) -> pa.Array:
    """Items of ``yes``, in order, where it says so, and of ``no`` elsewhere."""
    return pa.concat_arrays([yes, no]).take(pa.array(np.where(where, np.cumsum(where) - 1, len(yes) + np.cumsum(~where) - 1)))


class WordEncoder:
    """For byte-level tokenizers that lower-case, drop white space and part letters from signs, as word_bpe_49k.json does: there the
    ids of a text are those of its words, one after the other, and of letters and following signs those of each alone."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, int] = {}
        self.pool = _blobs([], [0])  # ids of the cache's words, by place

    def _alone(self, words: list[str]) -> pa.Array:
        ids, cuts = [], [0]
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            ids += e.ids
            cuts.append(len(ids))
        return _blobs(ids, cuts)

    def _letters(self, words: list[str]) -> pa.Array:
        """Ids of words of lower-case ``LETTERS``, which need neither the library's normalizer nor its expression: its model alone."""
        merge, ids, cuts = self.tokenizer.model.tokenize, [], [0]
        for w in "\n".join(words).encode().decode("latin-1").translate(NAMES).split(chr(NAMES[10])) if words else []:
            for token in merge(w):
                ids.append(token.id)
            cuts.append(len(ids))
        return _blobs(ids, cuts)

    def _known(self, words: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Ids of distinct words: from the cache, or else learned."""
        listed = _listed(words)
        place = np.fromiter(map(self.cache.get, listed, repeat(-1)), np.int64, len(listed))
        new = place < 0
        if not new.any():
            return self.pool.take(pa.array(place))
        ids = learn(words.filter(pa.array(new)))
        if len(self.cache) < self.cache_words:
            at = np.arange(len(ids)) + len(self.pool)
            self.cache.update(zip(compress(listed, new.tolist()), at.tolist(), strict=True))
            self.pool = pa.concat_arrays([self.pool, ids])
        return _meet(new, ids, self.pool.take(pa.array(place[~new])))

    def _learn(self, new: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(new, PLAIN)
        words = new.filter(plain)
        cores = pc.utf8_lower(pc.ascii_rtrim(words, SIGNS)).dictionary_encode()
        signs = pc.utf8_ltrim(words, LETTERS).dictionary_encode()
        first = self._known(cores.dictionary, lambda w: self._letters(_listed(w))).take(cores.indices)
        then = self._known(signs.dictionary, lambda w: self._alone(_listed(w))).take(signs.indices)
        odd = self._alone(_listed(new.filter(pc.invert(plain))))
        return _meet(np.array(plain), pc.binary_join_element_wise(first, then, pa.scalar(b"", pa.large_binary())), odd)

    def encode(self, texts: Sequence[bytes] | pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text, equal to the library's encode. Null is an empty text."""
        texts = strings(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        whole = pc.match_substring(texts, "<|")  # special tokens: the whole text goes to the library
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(whole, "", texts)))
        words = split.flatten().dictionary_encode()
        ids = self._known(words.dictionary, self._learn).take(words.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[ids.offset :][np.r_[0, np.cumsum(pc.list_value_length(split))]].tolist() if len(ids) else [0] * (len(texts) + 1)
        for k, (w, a, b) in enumerate(zip(whole.to_pylist(), cuts, cuts[1:], strict=False)):
            if w:
                yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield data[a:b].to_pybytes() if b > a else b""


def word_ids(path: str, cache_words: int = CACHE_WORDS) -> Callable[..., Iterator[bytes]]:
    if (path, cache_words) not in _CACHES:
        _CACHES[path, cache_words] = WordEncoder(path, cache_words)
    return _CACHES[path, cache_words].encode
