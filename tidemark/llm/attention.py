"""A small causal self-attention language model over subword ids, in numpy.

The next subword's class is predicted from the present subword and, by attention, from those before it in the window; the
subword follows from its class and the present one, by counts. Logits of the class at position t are

    log-odds of the classes after subword x_t (counts over the whole training corpus)
    + sum over s <= t of softmax_s(q(x_t) k(x_s) + b(t, s)) v(x_s)

with q, k and v linear in a learned embedding of the subword and b a learned bias of the places. Queries, keys and values depend
on a subword alone, so they are kept as tables after training. A window has ``CONTEXT`` subwords of context, then ``SCORED`` that it
scores; windows overlap by the context, so each subword is scored once, with CONTEXT of those before it or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTEXT, SCORED = 16, 16
T = CONTEXT + SCORED
CLASSES, WIDTH, EMBED = 32, 16, 16
#: Counts of pairs among this many of the most frequent ids are in the model; those of all other pairs come from a table.
PAIRED = 2048
PAIR_WEIGHT = 2.0
#: Parts of the training, after each of which the tasks' weights are averaged; each learns from one in SHARE of the training documents,
#: other ones in each, so EPOCHS = SHARE is one pass over all of them.
EPOCHS, SHARE = 2, 2
#: Frequent ids whose neighbourhood tells the classes.
MARKS = 128
#: Neighbouring windows that the training takes together.
RUN = 8
#: Logits of the training are held between this and its opposite, so that exponentials are finite and not all nought.
LARGEST = np.float32(75)
MASK = np.where(np.arange(T)[None, :] <= np.arange(SCORED)[:, None] + CONTEXT, 0.0, -1e9).astype(np.float32)


def layout(docs: list[np.ndarray], end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all documents one behind the other, targets (windows, SCORED; -1 where there is none) and each window's document.

    A document has CONTEXT paddings, the end sign, its ids, and paddings up to a whole window; its targets are its ids, then the
    end sign. Window w begins at input w * SCORED, so the last CONTEXT / SCORED windows of a document reach into the next one's paddings
    and have no targets."""
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    per = -(-sizes // SCORED) + CONTEXT // SCORED
    total = int(per.sum()) * SCORED
    flat, target = np.full(total + CONTEXT, pad, np.int32), np.full(total + CONTEXT, -1, np.int32)
    for d, s in zip(docs, ((np.cumsum(per) - per) * SCORED + CONTEXT).tolist(), strict=True):
        flat[s] = target[s + len(d)] = end
        flat[s + 1 : s + 1 + len(d)] = target[s : s + len(d)] = d
    return flat, target[CONTEXT:].reshape(-1, SCORED), np.repeat(np.arange(len(docs)), per)


def _windowed(a: np.ndarray, n: int) -> np.ndarray:
    """n overlapping windows of T rows."""
    return np.lib.stride_tricks.as_strided(a, (n, T, *a.shape[1:]), (SCORED * a.strides[0], *a.strides))


def _runs(a: np.ndarray) -> np.ndarray:
    """The windows (T rows each) of all runs (their number, places, width)."""
    part, row, cell = a.strides
    return np.lib.stride_tricks.as_strided(a, (len(a), RUN, T, a.shape[2]), (part, SCORED * row, row, cell)).reshape(-1, T, a.shape[2])


def _turned(a: np.ndarray) -> np.ndarray:
    """``_runs``, each window turned, in one piece each."""
    part, row, cell = (a := np.ascontiguousarray(a.transpose(0, 2, 1))).strides
    return np.lib.stride_tricks.as_strided(a, (len(a), RUN, a.shape[1], T), (part, SCORED * cell, row, cell)).reshape(-1, a.shape[1], T)


def _whole(a: np.ndarray, runs: int) -> np.ndarray:
    """Sums over the windows that a place of a run lies in; the opposite of ``_runs``."""
    blocks = T // SCORED
    a = a.reshape(runs, RUN, blocks, SCORED, -1)
    out = np.zeros((runs, RUN + blocks - 1, SCORED, a.shape[4]), a.dtype)
    for k in range(blocks):
        out[:, k : k + RUN] += a[:, :, k]
    return out.reshape(runs, -1, a.shape[4])


def windows(docs: list[np.ndarray], end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, T), targets (windows, SCORED; -1 where there is none) and each window's document; all have a target."""
    flat, target, owner = layout(docs, end, pad)
    real = (target >= 0).any(1)
    return _windowed(flat, len(target))[real], target[real], owner[real]


@dataclass
class Model:
    classes: np.ndarray  # class of each id
    within: np.ndarray  # log probability of each id in its class
    rank: np.ndarray  # place of each id among the PAIRED most frequent ones; PAIRED for all others
    pairs: np.ndarray  # of pair_table
    slot: np.ndarray  # row of each id in the tables below; ids that never occurred share one of noughts with the padding
    after: np.ndarray  # (rows, CLASSES) logits after each id
    pair_classes: np.ndarray  # (rows, CLASSES) log(count of the class after each id + PAIR_WEIGHT)
    embed: np.ndarray
    query: np.ndarray  # (rows, EMBED) queries times the keys' matrix; applied to embeddings, which is the same as meeting keys
    value: np.ndarray  # (EMBED, CLASSES); applied to the attended embeddings, which is the same as attending to values
    bias: np.ndarray
    end: int
    pad: int

    def score(self, docs: list[np.ndarray], at_once: int = 512) -> np.ndarray:
        """log10 probabilities of documents given as arrays of ids. A pair not among the frequent ids counts as one never seen;
        ``pair_gain`` of its count is what it adds."""
        flat, y, owner = layout(docs, self.end, self.pad)
        slot, out, ones = self.slot[flat], np.zeros(len(docs)), np.ones((max(T, CLASSES), 1), np.float32)
        for k in range(0, len(y), at_once):
            b = y[k : k + at_once]
            n = len(b)
            at = slot[k * SCORED : (k + n) * SCORED + CONTEXT]
            now, first = at[CONTEXT:], self.rank[flat[k * SCORED + CONTEXT : (k + n) * SCORED + CONTEXT]]
            target = np.where(b >= 0, b, 0).ravel()
            e = _windowed(self.embed.take(at, 0), n)
            s = self.query.take(now, 0).reshape(n, SCORED, EMBED) @ e.transpose(0, 2, 1)
            s += self.bias
            np.exp(s, out=s)
            context = s @ e
            context /= s @ ones[:T]
            logits = context.reshape(-1, EMBED) @ self.value
            logits += self.after.take(now, 0)
            c = self.classes[target]
            hit = logits.take(np.arange(0, logits.size, CLASSES) + c)
            np.exp(logits, out=logits)
            lp = hit - np.log((logits @ ones[:CLASSES])[:, 0]) + self.within[target] + self.pairs.take(first * self.pairs.shape[1] + self.rank[target]) - self.pair_classes.take(now * CLASSES + c)
            out += np.bincount(owner[k : k + at_once], (lp.reshape(n, SCORED) * (b >= 0)).sum(1, dtype=np.float64), len(docs))
        return out / np.log(10)


def neighbours(docs: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and seconds of all neighbouring ids of documents, an end sign standing before and after each."""
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    stops = np.cumsum(sizes)
    flat = np.full(int(sizes.sum()) + 1, end, np.int64)
    for d, stop in zip(docs, stops.tolist(), strict=True):
        flat[stop - len(d) : stop] = d
    # flat is end, ids, end, ids, ..., end: each document's closing sign is the next one's opening sign
    return flat[:-1], flat[1:]


def marks_of(counts: np.ndarray) -> np.ndarray:
    """Place of each of the MARKS most frequent ids; -1 for the rest."""
    marks = np.argsort(-counts, kind="stable")[:MARKS]
    at = np.full(len(counts), -1)
    at[marks] = np.arange(len(marks))
    return at


def cluster(sample: list[np.ndarray], ids: int, end: int, seed: int = 5) -> np.ndarray:
    """``cluster_counts`` of documents."""
    first, second = neighbours(sample or [np.zeros(0, np.int32)], end)
    at = marks_of(np.bincount(second, minlength=ids))
    before, after = at[first] >= 0, at[second] >= 0
    own = np.r_[second[before], first[after]]
    return cluster_counts(np.bincount(second, minlength=ids), own, np.r_[at[first[before]], at[second[after]] + MARKS], np.ones(len(own)), seed)


def cluster_counts(counts: np.ndarray, own: np.ndarray, place: np.ndarray, n: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for each id: ids grouped by what stands before and after them, by k-means on square-root profiles.

    n: how often an id ``own`` has a frequent id before it (``place`` is that one's mark) or after it (its mark + MARKS)."""
    known = np.flatnonzero(counts >= 3)
    row = np.full(len(counts), -1)
    row[known] = np.arange(len(known))
    ok = row[own] >= 0
    profile = np.bincount(row[own[ok]] * 2 * MARKS + place[ok], n[ok], len(known) * 2 * MARKS).astype(np.float32).reshape(len(known), 2 * MARKS)
    profile = np.sqrt(profile / np.maximum(profile.sum(1, keepdims=True), 1))
    rng = np.random.default_rng(seed)
    k = min(CLASSES - 1, len(known))
    weight = np.sqrt(counts[known]).astype(np.float32)
    out = np.full(len(counts), CLASSES - 1, np.int64)  # the last class is for what the training documents hardly show
    if not k:
        return out
    centre = profile[rng.choice(len(known), k, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        label = (profile @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        own_weight = np.where(label == np.arange(k)[:, None], weight, np.float32(0))
        total = own_weight.sum(1, keepdims=True)
        centre = np.where(total > 0, own_weight @ profile / np.maximum(total, 1e-9), centre)
    out[known] = label
    return out


def ranks(sample: list[np.ndarray], ids: int, end: int) -> np.ndarray:
    """``ranks_of`` the counts of documents."""
    return ranks_of(np.bincount(np.concatenate([np.r_[d, end] for d in sample]) if sample else [end], minlength=ids))


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Places of the most frequent ids; PAIRED for the rest."""
    top = np.argsort(-counts, kind="stable")[:PAIRED]
    out = np.full(len(counts), PAIRED, np.int64)
    out[top] = np.arange(len(top))
    return out


def pair_table(rank: np.ndarray, within: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """An id's probability in its class after a first id is (pair count + w p) / (first's pairs with the class + w), p being its
    share of the class. Returns log(pair count / p + w) by both ranks."""
    top = np.flatnonzero(rank < PAIRED)
    top = top[np.argsort(rank[top])]
    n = np.zeros((PAIRED + 1, PAIRED + 1))
    n[: len(top), : len(top)] = pairs[: len(top), : len(top)]
    share = np.ones(PAIRED + 1)
    share[: len(top)] = np.exp(within[top])
    return np.log(n / share + PAIR_WEIGHT).astype(np.float16)


def pair_gain(n: np.ndarray, within: np.ndarray) -> np.ndarray:
    """log10 of what a pair counted n times scores beyond one never seen; within: of its second id."""
    return np.log10(n / np.exp(within.astype(float)) / PAIR_WEIGHT + 1)


def shares(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probability of each id in its class."""
    total = np.bincount(classes, counts + 0.5, CLASSES)
    return np.log((counts + 0.5) / total[classes]).astype(np.float32)


def logits_after(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the classes: after each id, and anywhere."""
    prior = (follow.sum(0) + 1) / (follow.sum() + CLASSES)
    return np.log((follow + 4 * prior) / (follow.sum(1, keepdims=True) + 4)).astype(np.float32), np.log(prior).astype(np.float32)


class Weights:
    """The attention's weights as rows of EMBED numbers, with the sums of their squared gradients and how often each row was moved.

    Rows are the embeddings of the ids, then queries, keys, values and biases."""

    SHAPES = (("q", (EMBED, WIDTH)), ("k", (EMBED, WIDTH)), ("v", (EMBED, CLASSES)), ("b", (SCORED, T)))

    def __init__(self, ids: int, rows: np.ndarray, square: np.ndarray):
        self.ids, self.rows, self.square, self.moves = ids, rows, square, np.zeros(len(rows))

    @classmethod
    def start(cls, ids: int, pad: int, seed: int = 11) -> Weights:
        rng = np.random.default_rng(seed)
        rows = [rng.normal(0, 0.3, (ids, EMBED)), rng.normal(0, 0.25, (EMBED, WIDTH)), rng.normal(0, 0.25, (EMBED, WIDTH)), np.zeros((CLASSES, EMBED)), np.zeros((SCORED * T // EMBED, EMBED))]
        rows[0][pad] = 0
        all_ = np.concatenate(rows).astype(np.float32)
        return cls(ids, all_, np.full_like(all_, 1e-4))

    def views(self, of: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {"e": of[: self.ids]}, self.ids
        for name, shape in self.SHAPES:
            n = shape[0] * shape[1] // EMBED
            out[name] = of[at : at + n].reshape(shape)
            at += n
        return out

    def learn(self, docs: list[np.ndarray], classes: np.ndarray, after: np.ndarray, end: int, pad: int, rng: np.random.Generator, batch: int = 256, rate: float = 0.2) -> None:
        """One pass over all windows of documents, in runs of RUN neighbours that come in random order; a run's places are looked up once."""
        p, square = self.views(self.rows), self.views(self.square)
        flat, target, _ = layout(docs, end, pad)
        runs = -(-len(target) // RUN)
        wide = RUN * SCORED + CONTEXT
        x, y = np.full(runs * RUN * SCORED + CONTEXT, pad, np.int32), np.full((runs * RUN, SCORED), -1, np.int32)
        x[: len(flat)], y[: len(target)] = flat, target
        x, y = np.lib.stride_tricks.as_strided(x, (runs, wide), (RUN * SCORED * x.strides[0], x.strides[0])), y.reshape(runs, -1)
        order, ones = rng.permutation(runs), np.ones((max(T, CLASSES), 1), np.float32)
        for k in range(0, runs, max(1, batch // RUN)):
            a, t = x[order[k : k + max(1, batch // RUN)]], y[order[k : k + max(1, batch // RUN)]].reshape(-1)
            seen, n = t >= 0, len(t) // SCORED
            weight = seen / np.float32(max(1, seen.sum()))
            c = classes[np.where(seen, t, 0)]
            every = p["e"].take(a, 0)
            now = every[:, CONTEXT:].reshape(-1, EMBED)
            e, turned = _runs(every), _turned(every)
            meet = p["q"] @ p["k"].T
            qk = (now @ meet).reshape(n, SCORED, EMBED)
            w = qk @ turned
            w += p["b"]
            np.clip(w, -LARGEST, LARGEST, out=w)  # in place of a shift by each row's greatest
            w += MASK
            np.exp(w, out=w)
            w *= 1 / (w @ ones[:T])
            context = (w @ e).reshape(-1, EMBED)
            g = context @ p["v"]
            g += after.take(a[:, CONTEXT:].reshape(-1), 0)
            np.clip(g, -LARGEST, LARGEST, out=g)
            np.exp(g, out=g)
            g *= weight[:, None] / (g @ ones[:CLASSES])
            g.reshape(-1)[np.arange(0, g.size, CLASSES) + c] -= weight
            dcontext = (g @ p["v"].T).reshape(n, SCORED, EMBED)
            ds = dcontext @ turned
            ds -= ((dcontext.reshape(-1, EMBED) * context) @ ones[:EMBED]).reshape(n, SCORED, 1)
            ds *= w
            dqk = (ds @ e).reshape(-1, EMBED)
            moved = w.transpose(0, 2, 1) @ dcontext
            moved += ds.transpose(0, 2, 1) @ qk
            de = _whole(moved, len(a))
            de[:, CONTEXT:] += (dqk @ meet.T).reshape(len(a), -1, EMBED)
            dmeet = now.T @ dqk
            ids = a.reshape(-1)
            by = np.argsort(ids.astype(np.uint16), kind="stable")  # 16-bit numbers are sorted by their digits
            ordered = ids[by]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            u = ordered[first]
            du = np.add.reduceat(de.reshape(-1, EMBED).take(by, 0), first, 0)
            du[u == pad] = 0
            sums = square["e"].take(u, 0) + du * du
            square["e"][u] = sums
            p["e"][u] -= rate * du / np.sqrt(sums)
            self.moves[u] += 1
            self.moves[self.ids :] += 1
            for name, grad in (("q", dmeet @ p["k"]), ("k", dmeet.T @ p["q"]), ("v", context.T @ g), ("b", ds.sum(0))):
                square[name] += grad * grad
                p[name] -= rate * grad / np.sqrt(square[name])


def train(sample: list[np.ndarray], classes: np.ndarray, counts: np.ndarray, follow: np.ndarray, rank: np.ndarray, pairs: np.ndarray, end: int, pad: int, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model trained in one place. counts: of each id; follow: (ids, CLASSES) counts of the class after each id; pairs: counts of
    neighbours by rank."""
    weights, rng = Weights.start(len(counts), pad, seed), np.random.default_rng(seed + 1)
    after, _ = logits_after(follow)
    for _ in range(epochs):
        weights.learn(sample, classes, after, end, pad, rng)
    weights.rows[: len(counts)][weights.moves[: len(counts)] == 0] = 0
    return model(weights, classes, counts, follow, rank, pairs, end, pad)


def model(weights: Weights, classes: np.ndarray, counts: np.ndarray, follow: np.ndarray, rank: np.ndarray, pairs: np.ndarray, end: int, pad: int) -> Model:
    p, within = weights.views(weights.rows), shares(classes, counts)
    after, prior = logits_after(follow)
    known = np.flatnonzero((counts > 0) | (follow.sum(1) > 0))
    slot = np.full(len(counts), len(known), np.int32)
    slot[known] = np.arange(len(known))
    e = np.r_[p["e"][known], np.zeros((1, EMBED), np.float32)]
    pair_classes = np.log(np.r_[follow[known], np.zeros((1, CLASSES))] + PAIR_WEIGHT).astype(np.float32)
    return Model(classes.astype(np.int32), within, rank.astype(np.int32), pair_table(rank, within, pairs), slot, np.r_[after[known], prior[None, :]], pair_classes, e, e @ (p["q"] @ p["k"].T), p["v"].copy(), p["b"] + MASK, end, pad)
