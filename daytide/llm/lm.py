"""Scoring whole texts with a word-level gated recurrent language model.

1. Words of all training texts are counted; the vocabulary stays a distributed table. Its
   most frequent words, at most ``SHORT`` of them, are known to every task, the first
   ``HEAD`` with weights of their own.
2. The softmax is factored by class: the head words in classes of ``CLASS`` neighbours by
   frequency, all other words in ``TAILS`` classes by their last bytes. Within a head class
   a second softmax chooses the word; within a tail class the smoothed count does, so every
   word, a never seen one too, has a probability.
3. The network is trained by truncated backpropagation in numpy, data-parallel, on every
   training text: a round takes one of as many shares as there are rounds, every task runs
   Adam over its part of the share, and Spark averages the weights by tokens. Output biases
   start at the unigram model, which training improves on.
4. A text is scored in windows of steps, the state carried from window to window, so its
   whole length counts. Words outside ``SHORT`` get their counts by a join on the word;
   none of them is frequent.

Tokens are A-Z lower-cased words `[^\\x20\\x09-\\x0D]+` and one end for each text.

Defined cases: a null or empty text is its end alone; a null id is no held-out one; equal
rows, and rows of equal or null ids, give a row each; without training texts counts are 0,
the base is log10(1) for each token, and so is the score; other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytide.llm.common import texts
from daytide.llm.words import LOWER, Words, mixed, parts
from daytide.session import stage

#: Words known to every task: their number bounds what is sent to them.
SHORT = 65_536
#: Words with weights of their own, the end of a text included, and words in a class.
HEAD = 2048
CLASS = 32
TAILS = 64
EMBEDDING = 16
HIDDEN = 24
#: Training: the step size of each round, and into how many shares the texts are dealt: the
#: rounds take them in turn, so that every text is learnt from.
RATES = (0.02, 0.01, 0.005)
SHARE = len(RATES)
LANES = 512
STEPS = 12
#: Lanes are fewer where a stream of tokens would give fewer updates than this.
UPDATES = 40
#: Steps of a scoring window.
WINDOW = 32
#: Bytes of text that are cut into words at a time.
SLICE = 6 << 20
#: Tokens whose texts a scoring task runs through the network side by side, kept in few bytes each.
SIDE_BY_SIDE = 1 << 22
END = 0
#: States whose choices are worked out together, so that these stay in the processor's cache.
BLOCK = 256
#: States that a scoring task gathers from its windows before their choices are worked out.
TOGETHER_SCORED = 1 << 15
#: Texts that take a step together while they are scored, so that their states stay in the cache.
ABREAST = 512
#: Bytes of text whose words are hashed at a time, for the same reason.
CUT = 1 << 16
#: The sum of a state's exponentials stays above exp(-RANGE), a normal number of 32 bits.
RANGE = 80


def held_out(doc_id: Column) -> Column:
    """Rows whose texts are never learnt from: crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- words ----------------------------------------------------------------------------


def strings_at(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans of a buffer as a string array."""
    size = end - begin
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]
    return pa.Array.from_buffers(pa.large_string(), len(size), buffers).cast(pa.string())


@cache
def _tails(tails: int) -> np.ndarray:
    """Tail class by the last two bytes."""
    return (mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) % np.uint64(tails)).astype(np.int64)


def tail_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, tails: int) -> np.ndarray:
    """Tail class of lower-cased words, from their last two bytes."""
    last = data[end - 1].astype(np.int64) << 8
    last |= np.where(end - begin > 1, data[np.maximum(end - 2, begin)], 0)
    return _tails(tails)[last]


def _word_counts(tails: int):
    def kernel(batches):
        for batch in parts(batches, limit=SLICE):
            words = Words(batch["text"], lower=True, block=CUT)
            order = np.argsort(words.hash)
            hashes = words.hash[order]
            cuts = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1], append=~hashes[-1:]))
            first, n = order[cuts[:-1]], np.diff(cuts)
            data, begin, end = LOWER[words.data], words.begin[first], words.end[first]
            yield pa.record_batch(
                [strings_at(data, begin, end), pa.array(tail_of(data, begin, end, tails)), pa.array(n)],
                names=["word", "tail", "n"],
            )

    return kernel


def word_counts(docs: DataFrame, tails: int = TAILS) -> DataFrame:
    """(word, tail, c): how often each word occurs in a frame of (doc_id, text)."""
    found = docs.select("text").mapInArrow(_word_counts(tails), "word string, tail long, n long")
    return found.groupBy("word", "tail").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows of the counts."""

    docs: int  # training texts, each with an end
    total: int  # N
    kinds: int  # V
    words: list[str]  # at most SHORT, by falling count
    counts: np.ndarray
    tails: np.ndarray
    tail_total: np.ndarray  # by tail class, over the words outside the head: sum of counts
    tail_kinds: np.ndarray
    head: int

    @property
    def hashes(self) -> np.ndarray:
        return Words(pa.array(self.words, pa.string())).hash if self.words else np.zeros(0, np.uint64)


def vocabulary(counts: DataFrame, docs: int, short: int, head: int, tails: int) -> Vocabulary:
    """``counts`` is read three times: give a written table."""
    by_tail = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    # the words above the lowest level of counts that no more than ``short`` words reach
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    upto, least = 0, None
    for row in sizes:
        if upto + row["n"] > short:
            break
        upto, least = upto + row["n"], row["level"]
    known = counts.where(level >= least).collect() if least is not None else []
    known.sort(key=lambda r: (-r["c"], r["word"]))
    own = known[: head - 1]
    total, kinds = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
    for row in by_tail:
        total[row["tail"]], kinds[row["tail"]] = row["c"], row["n"]
    for row in own:
        total[row["tail"]] -= row["c"]
        kinds[row["tail"]] -= 1
    return Vocabulary(
        docs,
        sum(r["c"] for r in by_tail) + docs,
        sum(r["n"] for r in by_tail) + (docs > 0),
        [r["word"] for r in known],
        np.array([r["c"] for r in known], np.int64),
        np.array([r["tail"] for r in known], np.int64),
        total,
        kinds,
        len(own) + 1,
    )


class Numbering:
    """Turns texts into token numbers: the end, head words, then tail classes."""

    def __init__(self, vocab: Vocabulary):
        hashes = vocab.hashes
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        # first hash of each value of the leading bits, of which there are four to a hash and more
        self.bits = np.uint64(64 - max(1, (4 * len(hashes)).bit_length()))
        leading = np.arange(1 << int(64 - self.bits), dtype=np.uint64) << self.bits
        self.begin = np.searchsorted(self.sorted, leading).astype(np.int32)
        self.head, self.tails = vocab.head, len(vocab.tail_total)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the short list, -1 if not there."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int64)
        out = np.full(len(hashes), -1, np.int64)
        for a in range(0, len(hashes), 1 << 14):
            some = hashes[a : a + (1 << 14)]
            near = self.begin[some >> self.bits]
            which = np.arange(len(some))
            # few hashes share their leading bits: go on along them where a smaller one stands
            while len(which):
                which = which[near[which] < len(self.sorted)]
                there = self.sorted[near[which]]
                same, wanted = which[there == some[which]], some[which]
                out[a + same] = self.order[near[same]]
                which = which[there < wanted]
                near[which] += 1
        return out

    def tokens(self, words: Words, data: np.ndarray):
        """(token numbers with an end after each text, places in the short list, lengths)."""
        place = self.place(words.hash)
        number = place + 1
        other = np.flatnonzero((place < 0) | (place >= self.head - 1))
        number[other] = self.head + tail_of(data, words.begin[other], words.end[other], self.tails)
        lengths = words.counts + 1
        out = np.full(int(lengths.sum()), END, np.int64)
        out[np.arange(len(number)) + words.text_number()] = number
        return out, place, lengths


# --- the network ----------------------------------------------------------------------


@dataclass
class Network:
    embed: np.ndarray  # (head + tails) x EMBEDDING
    into: np.ndarray  # EMBEDDING x 3 HIDDEN: update, reset, candidate
    turn: np.ndarray  # HIDDEN x 3 HIDDEN
    bias: np.ndarray
    classes: np.ndarray  # HIDDEN x (head classes + tails)
    class_bias: np.ndarray
    words: np.ndarray  # head classes x CLASS x HIDDEN
    word_bias: np.ndarray  # head classes x CLASS; places without a word stay at -1e9

    @property
    def head_classes(self) -> int:
        return len(self.words)

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


def start(vocab: Vocabulary, seed: int = 13) -> Network:
    """Small random weights; the output biases are the unigram model's."""
    rng = np.random.default_rng(seed)
    head, tails = vocab.head, len(vocab.tail_total)
    groups = -(-head // CLASS)
    counts = np.full(groups * CLASS, -0.5)
    counts[0] = vocab.docs
    counts[1:head] = vocab.counts[: head - 1]
    counts = counts.reshape(groups, CLASS) + 0.5
    mass = np.concatenate([counts.sum(axis=1), vocab.tail_total + 0.5 * (vocab.tail_kinds + 1)])
    with np.errstate(divide="ignore"):
        within = np.maximum(np.log(counts / counts.sum(axis=1, keepdims=True)), -1e9)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return Network(
        draw(head + tails, EMBEDDING, by=0.3),
        draw(EMBEDDING, 3 * HIDDEN, by=EMBEDDING**-0.5),
        draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        np.zeros(3 * HIDDEN, np.float32),
        draw(HIDDEN, groups + tails, by=0.05),
        np.log(mass / mass.sum()).astype(np.float32),
        draw(groups, CLASS, HIDDEN, by=0.05),
        within.astype(np.float32),
    )


def with_one(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which a bias is multiplied with."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def levelled(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """(weights with the bias as a last row, (states + 1) x choices; whether they are level).

    States lie between -1 and 1. Where that alone bounds the highest choice closely enough, the
    bound is taken off the bias, so that the sum of the choices' exponentials neither overflows
    nor vanishes. The given weights are choices x states; there may be several groups of them.
    """
    reach = np.abs(weights) @ np.ones(weights.shape[-1], weights.dtype)
    high, low = (bias + reach).max(axis=-1, keepdims=True), (bias - reach).max(axis=-1, keepdims=True)
    whole = np.concatenate([np.swapaxes(weights, -1, -2), (bias - high)[..., None, :]], axis=-2)
    return np.ascontiguousarray(whole), bool((high - low < RANGE).all())


def chosen(x: np.ndarray, choice: np.ndarray, level: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each state's choice, probabilities before the division by their sum, sum).

    ``x`` is states x choices, the products with ``levelled`` weights; it is overwritten.
    """
    if not level:
        x -= x.max(axis=1, keepdims=True)
    found = x[np.arange(len(choice)), choice]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    found -= np.log(total)
    return found, total


def halved(weights: np.ndarray) -> np.ndarray:
    """Weights whose gates (update, reset) are halved, since a gate is (1 + tanh(x / 2)) / 2."""
    weights = weights.copy()
    weights[:, : 2 * HIDDEN] *= 0.5
    return weights


def inputs(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings with a last column of ones, ``halved`` weights that move them with the bias as a last column)."""
    return with_one(net.embed), np.ascontiguousarray(halved(np.vstack([net.into, net.bias])).T)


def step(turn: np.ndarray, moved: np.ndarray, h: np.ndarray):
    """One step of the gated unit: the new state, and what its gradient needs.

    A column is a text, so that each gate lies in one piece. ``moved`` and ``turn`` are of
    weights as ``halved`` gives them, choices x states.
    """
    turned = turn @ h
    gates = turned[: 2 * HIDDEN]
    gates += moved[: 2 * HIDDEN]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r, again = gates[:HIDDEN], gates[HIDDEN:], turned[2 * HIDDEN :]
    c = r * again
    c += moved[2 * HIDDEN :]
    np.tanh(c, out=c)
    after = h - c
    after *= z
    after += c
    return after, z, r, again, c


def class_of(net: Network, token: np.ndarray) -> np.ndarray:
    head = len(net.embed) - (len(net.class_bias) - net.head_classes)
    return np.where(token < head, token // CLASS, net.head_classes + token - head)


def by_class(net: Network, cls: np.ndarray):
    """(order of tokens by class, [(head class, first and end place in that order)], how many are in head classes)."""
    order = np.argsort(cls.astype(np.int16) if len(net.class_bias) < 1 << 15 else cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(net.head_classes + 1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], cuts[-1]


def log_probabilities(net: Network, states: np.ndarray, token: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Natural log of each token's probability after its state; of its class for tail tokens."""
    return _log_probabilities(net, with_one(states), token, block)


def _log_probabilities(net: Network, states: np.ndarray, token: np.ndarray, block: int = BLOCK) -> np.ndarray:
    out, cls = np.empty(len(token)), class_of(net, token)
    weights, level = levelled(np.ascontiguousarray(net.classes.T), net.class_bias)
    for a in range(0, len(token), block):
        out[a : a + block] = chosen(states[a : a + block] @ weights, cls[a : a + block], level)[0]
    order, spans, head = by_class(net, cls)
    mine, inner = states[order[:head]], np.empty((head, CLASS), states.dtype)
    weights, level = levelled(net.words, net.word_bias)
    for k, a, b in spans:
        np.matmul(mine[a:b], weights[k], out=inner[a:b])
    out[order[:head]] += chosen(inner, token[order[:head]] % CLASS, level)[0]
    return out


def text_scores(net: Network, tokens: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Natural log-likelihood of each text (its tokens follow each other, ends included).

    Texts run side by side, the longest first; the states go on from window to window.
    """
    order = np.argsort(-lengths, kind="stable")
    size, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    total = np.empty(len(lengths))
    for a in range(0, len(lengths), ABREAST):
        mine = slice(a, a + ABREAST)
        total[mine] = _abreast(net, tokens, size[mine], first[mine], window)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _abreast(net: Network, tokens: np.ndarray, size: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """``text_scores`` of texts by falling size, whose tokens begin at ``first``, side by side."""
    embed, into = inputs(net)
    turn = np.ascontiguousarray(halved(net.turn).T)
    total = np.zeros(len(size))
    h = np.zeros((HIDDEN, len(size)), np.float32)
    longest, t = int(size[0]), 0
    running = np.searchsorted(-size, -np.arange(longest), "left")  # texts longer than each step
    upto = np.cumsum(running)
    while t < longest:
        enough = np.searchsorted(upto, (upto[t - 1] if t else 0) + TOGETHER_SCORED) + 1
        end = min(longest, t + -(-(enough - t) // window) * window)
        many = running[t:end]
        cuts = np.append(0, np.cumsum(many))
        owners = np.arange(cuts[-1]) - np.repeat(cuts[:-1], many)
        at = first[owners] + np.repeat(np.arange(t, end), many)
        target = tokens[at].astype(np.int64)
        before = tokens[at - 1]
        if t == 0:
            before[: many[0]] = END
        states = np.ones((len(target), HIDDEN + 1), np.float32)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            h = step(turn, into @ embed[before[a:b]].T, h[:, : b - a])[0]
            states[a:b, :HIDDEN] = h.T
        total += np.bincount(owners, _log_probabilities(net, states, target), len(size))
        t = end
    return total


def gradients(net: Network, seen: np.ndarray, target: np.ndarray, h: np.ndarray):
    """Loss, gradients and last states over a window (steps x lanes), cut off before it.

    A lane whose last token was an end starts a new text from the zero state.
    """
    steps_, lanes = seen.shape
    token_in, begun = seen.reshape(-1), [np.flatnonzero(row) for row in seen == END]
    embed, weights_in = inputs(net)
    came_in = embed[token_in].reshape(steps_, lanes, -1)
    turn = np.ascontiguousarray(halved(net.turn).T)
    kept, ones, h = [], np.ones((steps_ * lanes, HIDDEN + 1), h.dtype), h.T.copy()
    states = ones.reshape(steps_, lanes, -1)[:, :, :HIDDEN]
    for s in range(steps_):
        h[:, begun[s]] = 0
        after, *rest = step(turn, weights_in @ came_in[s].T, h)
        kept.append((h, *rest))
        h = after
        states[s] = h.T
    # states go by class, so that those of a head class lie in one piece
    order, spans, head = by_class(net, class_of(net, target.reshape(-1)))
    token, ones = target.reshape(-1)[order], ones[order]
    cls, loss = class_of(net, token), 0.0
    grad = Network(*(np.zeros_like(a) for a in net.arrays()))
    back, outer = np.empty((len(token), HIDDEN), h.dtype), np.ascontiguousarray(net.classes.T)
    weights, level = levelled(outer, net.class_bias)
    slope, number = np.zeros_like(weights), np.arange(BLOCK)
    for a in range(0, len(token), BLOCK):
        own, which = ones[a : a + BLOCK], cls[a : a + BLOCK]
        error = own @ weights
        found, sums = chosen(error, which, level)
        loss -= found.sum(dtype=np.float64)
        # errors times the sums: these are taken off the narrower products
        error[number[: len(which)], which] -= sums
        part = 1 / sums[:, None]
        slope += (own * part).T @ error
        np.multiply(error @ outer, part, out=back[a : a + BLOCK])
    grad.classes, grad.class_bias = slope[:-1], slope[-1]
    place, miss = token[:head] % CLASS, np.empty((head, CLASS), h.dtype)
    weights, level = levelled(net.words, net.word_bias)
    for k, a, b in spans:
        np.matmul(ones[a:b], weights[k], out=miss[a:b])
    found, sums = chosen(miss, place, level)
    loss -= found.sum(dtype=np.float64)
    miss /= sums[:, None]
    miss[np.arange(head), place] -= 1
    slope, inner = np.zeros((*net.word_bias.shape, HIDDEN + 1), h.dtype), np.empty((head, HIDDEN), h.dtype)
    for k, a, b in spans:
        np.matmul(miss[a:b].T, ones[a:b], out=slope[k])
        np.matmul(miss[a:b], net.words[k], out=inner[a:b])
    grad.words, grad.word_bias = slope[..., :-1], slope[..., -1]
    back[:head] += inner
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    back = back[at].reshape(steps_, lanes, HIDDEN)
    into, turned = np.empty((3 * HIDDEN, lanes), h.dtype), np.empty((3 * HIDDEN, lanes), h.dtype)
    rows = np.empty((EMBEDDING, steps_, lanes), h.dtype)
    slope_in, slope_turn, carry = np.zeros_like(weights_in), np.zeros_like(turn), np.zeros_like(h)
    dz, dr, dc = into[:HIDDEN], into[HIDDEN : 2 * HIDDEN], into[2 * HIDDEN :]
    for s in range(steps_ - 1, -1, -1):
        before, z, r, again, c = kept[s]
        d = carry
        d += back[s].T
        np.subtract(1, z, out=dc)
        np.subtract(before, c, out=dz)
        dz *= z
        dz *= dc
        dz *= d
        dc *= d
        c *= c
        np.subtract(1, c, out=c)
        dc *= c
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= again
        dr *= dc
        turned[: 2 * HIDDEN] = into[: 2 * HIDDEN]
        np.multiply(dc, r, out=turned[2 * HIDDEN :])
        d *= z
        carry = net.turn @ turned
        carry += d
        carry[:, begun[s]] = 0
        slope_turn += turned @ before.T
        slope_in += into @ came_in[s]
        np.matmul(net.into, into, out=rows[:, s])
    grad.into, grad.bias, grad.turn = slope_in[:, :-1].T, slope_in[:, -1], slope_turn.T
    # inputs repeat: their gradients are added up by token
    for column, row in zip(grad.embed.T, rows.reshape(EMBEDDING, -1)):
        column[:] = np.bincount(token_in, row, len(column))
    return loss, grad, h.T


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.turn = net, rate, 0
        self.first = [np.zeros_like(a) for a in net.arrays()]
        self.second = [np.zeros_like(a) for a in net.arrays()]

    def update(self, grad: Network, n: int):
        self.turn += 1
        grown, spread = 1 - 0.9**self.turn, 1 - 0.999**self.turn
        for a, g, m, v in zip(self.net.arrays(), grad.arrays(), self.first, self.second):
            m *= 0.9
            m += g * a.dtype.type(0.1 / n)
            v *= 0.999
            g = g * a.dtype.type(0.001**0.5 / n)
            g *= g
            v += g
            move = np.sqrt(v)
            move += a.dtype.type(1e-8 * spread**0.5)
            np.divide(m, move, out=move)
            move *= self.rate * spread**0.5 / grown
            a -= move


def train(net: Network, streams, rate: float) -> tuple[Network, int]:
    """The network after Adam over streams of tokens, and the number of these.

    A stream is cut into lanes of equal length; fewer tokens than lanes are left at its end.
    """
    net = net.like(net.flat())
    adam, done = Adam(net, rate), 0
    for tokens in streams:
        if not len(tokens):
            continue
        lanes = min(LANES, max(1, len(tokens) // (STEPS * UPDATES)))
        long = len(tokens) // lanes
        target = tokens[: lanes * long].reshape(lanes, long).T
        seen = np.vstack([np.full((1, lanes), END), target[:-1]])
        h = np.zeros((lanes, HIDDEN), np.float32)
        for a in range(0, long, STEPS):
            _, grad, h = gradients(net, seen[a : a + STEPS], target[a : a + STEPS], h)
            adam.update(grad, target[a : a + STEPS].size)
        done += len(tokens)
    return net, done


# --- rounds over the table ---------------------------------------------------------------

PART = 1 << 13  # weights in a row
TOGETHER = 64  # tasks whose weights are added up first


def _trained(vocab: Vocabulary, net: Network, rate: float):
    def kernel(batches):
        numbering = Numbering(vocab)

        def streams():
            for batch in parts(batches, limit=SLICE):
                words = Words(batch["text"], lower=True, block=CUT)
                yield numbering.tokens(words, LOWER[words.data])[0]

        after, n = train(net, streams(), rate)
        if n:
            flat = after.flat().astype(np.float64) * n
            cut = [flat[a : a + PART].tobytes() for a in range(0, len(flat), PART)]
            group = TaskContext.get().partitionId() // TOGETHER
            yield pa.record_batch(
                [
                    pa.array(np.arange(len(cut), dtype=np.int32)),
                    pa.array(np.full(len(cut), group, np.int32)),
                    pa.array(np.full(len(cut), n)),
                    pa.array(cut, pa.binary()),
                ],
                names=["place", "together", "n", "weights"],
            )

    return kernel


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(PART)
    for value in table["weights"]:
        one = np.frombuffer(value.as_buffer())
        total[: len(one)] += one
        size = len(one)
    first = table.slice(0, 1)
    n = sum(table["n"].to_pylist())
    return pa.table(
        {"place": first["place"], "together": first["together"], "n": [n], "weights": [total[:size].tobytes()]}
    )


def fit(docs: DataFrame, vocab: Vocabulary, share: int = SHARE, rates=RATES, seed: int = 13) -> Network:
    """The network after a round for each rate; a round takes one of ``share`` shares of (doc_id, text).

    There must be a round for every share, so that no text is left out.
    """
    if share > len(rates):
        raise ValueError(f"{share} shares need as many rounds, not {len(rates)}")
    net = start(vocab, seed)
    kind = "place int, together int, n long, weights binary"
    for number, rate in enumerate(rates):
        chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == number % share
        found = docs.where(chosen).select("text").mapInArrow(_trained(vocab, net, rate), kind)
        found = found.groupBy("place", "together").applyInArrow(_added, kind)
        found = found.groupBy("place").applyInArrow(_added, kind)
        rows = sorted(found.collect(), key=lambda r: r["place"])
        if rows:
            flat = np.concatenate([np.frombuffer(r["weights"]) / r["n"] for r in rows])
            net = net.like(flat)
    return net


SCORED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("model", pa.float64()),
        ("word", pa.string()),
        ("n", pa.int64()),
    ]
)


def _scored(vocab: Vocabulary, net: Network):
    """A row for each text, without its rare words, and a row for each rare word of a text."""

    def kernel(batches):
        numbering = Numbering(vocab)
        smooth = np.append(np.log10(vocab.counts + 0.5), 0)  # the last for words that have no place
        end = np.log10(vocab.docs + 0.5)
        whole = np.log10(vocab.total + 0.5 * (vocab.kinds + 1))
        in_tail = np.log10(vocab.tail_total + 0.5 * (vocab.tail_kinds + 1))
        row = TaskContext.get().partitionId() << 40
        small = np.int16 if len(net.embed) < 1 << 15 else np.int32
        held: list[tuple] = []

        def scored():
            """A row for each text held: the network runs over all of them together."""
            ids, rows, tokens, lengths, known, base, model = zip(*held)
            held.clear()
            ids, lengths = pa.concat_arrays(ids), np.concatenate(lengths)
            model = np.concatenate(model) + text_scores(net, np.concatenate(tokens), lengths) / np.log(10)
            n, given = len(ids), [np.concatenate(a) for a in (rows, known, base)]
            columns = [pa.array(a) for a in (lengths, *given[1:], model)]
            nothing = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            return pa.record_batch([pa.array(given[0]), ids, *columns, *nothing], schema=SCORED)

        waiting = 0
        for batch in parts(batches, limit=SLICE):
            words = Words(batch["text"], lower=True, block=CUT)
            data, n = LOWER[words.data], batch.num_rows
            tokens, place, lengths = numbering.tokens(words, data)
            owner = words.text_number()
            add = lambda which, value: np.bincount(owner[which], value, n)
            short = place >= 0
            log_count = smooth[place]
            base = np.bincount(owner, log_count, n) + end - lengths * whole
            tail = np.flatnonzero(~short | (place >= vocab.head - 1))
            number = tokens[tail + owner[tail]] - vocab.head
            model = add(tail, log_count[tail] - in_tail[number])
            rare = np.flatnonzero(~short)
            # each text's rare words, once with their number
            order = rare[np.lexsort((words.hash[rare], owner[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
            first = order[new]
            times = np.diff(np.append(np.flatnonzero(new), len(order)))
            rows = np.arange(n) + row
            row += n
            known = add(short, np.ones(int(short.sum()))).astype(np.int64) + (vocab.docs > 0)
            none = [pa.nulls(len(first), t) for t in SCORED.types[1:6]]
            found = strings_at(data, words.begin[first], words.end[first])
            yield pa.record_batch([pa.array(rows[owner[first]]), *none, found, pa.array(times)], schema=SCORED)
            # the ids are copied, so that the batch with its texts can go
            ids = batch["doc_id"].take(pa.array(np.arange(n)))
            held.append((ids, rows, tokens.astype(small), lengths, known, base, model))
            waiting += len(tokens)
            if waiting >= SIDE_BY_SIDE:
                yield scored()
                waiting = 0
        if held:
            yield scored()

    return kernel


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    short: int = SHORT,
    head: int = HEAD,
    tails: int = TAILS,
    share: int = SHARE,
    rates=RATES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    given = texts(docs, doc_id, text)
    training = given.where(~held_out(F.col("doc_id")))
    counts = stage(word_counts(training, tails), "vocabulary")
    vocab = vocabulary(counts, training.count(), short, head, tails)
    if not vocab.docs:
        net = None
        nothing = F.lit(0.0)
        n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)) + 1
        zero = F.lit(0).cast("long")
        return given.select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            n.cast("long").alias("n_tokens"),
            zero.alias("n_known"),
            zero.alias("train_tokens"),
            nothing.alias("base_score"),
            nothing.alias("score"),
        )
    net = fit(training, vocab, share, rates)
    kind = "row long, doc_id long, n_tokens long, n_known long, base double, model double, word string, n long"
    # the rows' numbers are fixed by the written table
    scored = stage(given.mapInArrow(_scored(vocab, net), kind), "scored")
    # joined by a number, which sorts faster than a word; words that share it are told apart by the other two terms
    rare = scored.where(F.col("word").isNotNull()).select("row", "word", "n", F.xxhash64("word").alias("hash"))
    known = counts.select(F.col("word").alias("same"), "c", F.xxhash64("word").alias("known_hash"))
    equal = (F.col("hash") == F.col("known_hash")) & (F.col("word") <= F.col("same")) & (F.col("word") >= F.col("same"))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(known, equal, "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("also")
    )
    whole = scored.where(F.col("word").isNull()).drop("word", "n").join(found, "row", "left")
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + also).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
