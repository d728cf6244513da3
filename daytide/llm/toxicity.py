"""Toxicity by a learnt lexicon, Levenshtein automata and context windows.

1. The lexicon is learnt from the labelled rows outside the held-out fold: words, and stems
   (beginnings of words), that documents marked toxic have more often than chance explains:
   an exact one-sided test, corrected for the number of terms that are tried. A word stays
   a term of its own, with its edits, beside a stem that it begins with. A term whose near
   misses are as common in other documents loses its edits.
2. The lexicon is a trie. A Levenshtein automaton for each term, all run at once along the
   trie, accepts a word within the edits its length allows. A stem of five letters or more
   allows edits before its last letter, which has to be there. The intersection is made
   deterministic as words ask for it, so a word costs one look-up a letter and most words
   end after a few letters.
3. Each accepted word is judged in its context: a window of words around it counts the
   other terms there, and quotation marks on its line tell a quoted term from abuse.
4. A logistic regression over the counts by kind and context gives the score. A near miss
   counts less with each edit.

Words are runs of letters, digits and ``@ $ *``, lower-cased. Each distinct word of a
slice of texts runs through the automaton once.

Defined cases: a null or empty text has no terms and gets the score of such a text; every
input row gives a row, rows with equal or null doc_id too; null labels and labels of
unknown documents are not learnt from; with labels of one class only, or none, the score
is their mean (0 without any); other columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytide.functions.sampling import seeded_sample
from daytide.llm.common import held_out, texts
from daytide.llm.words import Words, parts
from daytide.session import ship_package, stage

#: Bound of the labelled rows that the lexicon is learnt from.
LEXICON_ROWS = 12_000
STEMS = range(4, 8)
#: Chance that any word of a table whose labels mean nothing becomes a term.
CHANCE = 0.05
#: How much more often a term, and its near misses, are in toxic documents than in others.
LEAST_RATIO = 4.0
LEAST_NEAR_RATIO = 3.0
#: What a near miss counts for with each edit.
EDIT_WEIGHT = 0.7
AROUND = 8  # words on each side of a term

SEPARATORS = np.ones(256, bool)
SEPARATORS[0x80:] = False
SEPARATORS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$*")] = False
#: What is no letter at either end of a word: masks, and quotation marks beyond ASCII.
EDGES = "@$*«»“”„‘’‚…–—"
WORD = re.compile(r"[^\W\d_]{3,}")

FEATURES = [
    "exact",
    "fuzzy",
    "quoted_exact",
    "quoted_fuzzy",
    "crowded",
    "density",
    "kinds",
    "any_exact",
    "any_fuzzy",
    "any_quoted",
    "evidence",
    "strongest",
]


@dataclass(frozen=True)
class Term:
    letters: str
    stem: bool  # accepts every word that begins so
    near: bool = True  # near misses count
    weight: float = 1.0  # log of how much more often it is in toxic documents

    @property
    def edits(self) -> int:
        """Edits that still count as this term."""
        n = len(self.letters) if self.near else 0
        return 0 if n < 5 else 1 if n < 8 else 2


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    term: int = -1
    stem: int = -1
    most: int = 0  # edits allowed to any term below


NONE = (3, -1)  # (edits, term number) where no term is


class Lexicon:
    """The trie and the lazily determined automaton over it."""

    LIMIT = 300_000

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.nodes = [Node()]
        for number, term in enumerate(terms):
            at = 0
            for letter in term.letters:
                self.nodes[at].most = max(self.nodes[at].most, term.edits)
                if letter not in self.nodes[at].children:
                    self.nodes.append(Node())
                    self.nodes[at].children[letter] = len(self.nodes) - 1
                at = self.nodes[at].children[letter]
            node = self.nodes[at]
            node.most = max(node.most, term.edits)
            if term.stem:
                node.stem = number
            else:
                node.term = number
        self._restart()

    def _restart(self):
        self.numbers: dict[tuple, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple[int, int]] = []
        self.cells = 0
        self.start = self._state({(0, 0)}, NONE)

    def _state(self, pairs: set[tuple[int, int]], stem: tuple[int, int]) -> int:
        """The number of a set of (node, edits) once letters of the trie may be skipped.

        ``stem`` is the (edits, term number) of the closest stem whose last letter led here.
        """
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            for child in self.nodes[node].children.values():
                if edits < self.nodes[child].most and (child, edits + 1) not in pairs:
                    pairs.add((child, edits + 1))
                    todo.append((child, edits + 1))
        key = (frozenset(pairs), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key[0])
            self.moves.append({})
            self.stems.append(stem)
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        after, stem = set(), NONE
        for node, edits in self.sets[state]:
            one = self.nodes[node]
            if edits < one.most:
                after.add((node, edits + 1))  # a letter too many
            for other, child in one.children.items():
                if other == letter:
                    after.add((child, edits))
                    number = self.nodes[child].stem
                    if number >= 0 and edits <= self.terms[number].edits:
                        stem = min(stem, (edits, number))
                elif edits < self.nodes[child].most:
                    after.add((child, edits + 1))  # another letter
        to = self._state(after, stem) if after else -1
        self.moves[state][letter] = to
        self.cells += 1
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(term number, edits) of the closest term, or (-1, 0)."""
        if self.cells > self.LIMIT:
            self._restart()
        state, best = self.start, NONE
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                break
            best = min(best, self.stems[state])
            if best[0] == 0:
                return best[1], 0
        for node, edits in self.sets[state] if state >= 0 else ():
            number = self.nodes[node].term
            if number >= 0 and edits <= self.terms[number].edits:
                best = min(best, (edits, number))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)


# --- the lexicon, from labelled texts -----------------------------------------------


def _term_counts(batches):
    """(term, toxic documents, other documents) of each batch; a stem ends with an asterisk."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            found = {w[:n] + "*" for n in STEMS for w in words if len(w) >= n}
            counts[int(label)].update(found | words)
        terms = sorted(counts[0].keys() | counts[1].keys())
        yield pa.record_batch(
            [
                pa.array(terms, pa.string()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ],
            names=["term", "toxic", "other"],
        )


def chance_of(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    """Chance of ``toxic`` or more toxic documents among those with a term that means nothing."""

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    have, whole = toxic + other, log_choose(n_toxic + n_other, toxic + other)
    most = min(have, n_toxic)
    logs = [log_choose(n_toxic, k) + log_choose(n_other, have - k) - whole for k in range(toxic, most + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Terms of a bounded labelled frame (text, label) that mark toxic documents."""
    sizes = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return []
    counts = sample.select("text", "label").mapInArrow(_term_counts, "term string, toxic long, other long")
    counts = stage(counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
    least = CHANCE / max(1, counts.count())
    t, o, n1, n0 = F.col("toxic"), F.col("other"), F.lit(float(sizes[1])), F.lit(float(sizes[0]))
    ratio = ((t + 0.5) / (n1 + 1)) / ((o + 0.5) / (n0 + 1))
    # a likelihood ratio that any term passes whose exact chance may pass
    rate = (t + o) / (n1 + n0)
    cells = [(t, n1 * rate), (n1 - t, n1 * (1 - rate)), (o, n0 * rate), (n0 - o, n0 * (1 - rate))]
    spread = sum((F.when(x > 0, 2 * x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    bound = NormalDist().inv_cdf(1 - least) ** 2 / 2
    best = counts.where((ratio >= LEAST_RATIO) & (spread >= bound)).withColumn("gain", t * F.log(ratio)).collect()
    best = [r for r in best if chance_of(r["toxic"], r["other"], sizes[1], sizes[0]) <= least]
    # of equally good terms the longest is the most specific
    best.sort(key=lambda r: (-r["gain"], -len(r["term"]), r["term"]))
    chosen: dict[str, int] = {}
    beside: list[str] = []
    for row in best:
        term, docs = row["term"], row["toxic"]
        bare = term.rstrip("*")
        known = any(bare[:n] + "*" in chosen for n in STEMS if n <= len(bare))
        implied = term.endswith("*") and any(
            c.rstrip("*").startswith(bare) and docs <= 1.2 * n for c, n in chosen.items()
        )
        if known and bare == term:
            beside.append(term)  # the stem has no edits at its end
        elif not known and not implied:
            chosen[term] = docs
    weight = {r["term"]: r["gain"] / r["toxic"] for r in best}
    terms = [Term(t.rstrip("*"), t.endswith("*"), True, weight[t]) for t in [*chosen, *beside]]
    return without_common_misses(terms, sample, sizes)


def _near_counts(terms: list[Term]):
    """(term number, toxic documents, other documents) with near misses of the term."""

    def kernel(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                found = (lexicon.match(w) for w in set(WORD.findall((text or "").lower())))
                counts[int(label)].update({number for number, edits in found if edits})
            numbers = sorted(counts[0].keys() | counts[1].keys())
            yield pa.record_batch(
                [pa.array(numbers, pa.int64()), *(pa.array([c[i] for i in numbers], pa.int64()) for c in counts[::-1])],
                names=["term", "toxic", "other"],
            )

    return kernel


def without_common_misses(terms: list[Term], sample: DataFrame, sizes: dict[int, int]) -> list[Term]:
    """The terms; those whose near misses say little of a document keep no edits."""
    found = sample.select("text", "label").mapInArrow(_near_counts(terms), "term long, toxic long, other long")
    found = found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    plain = set()
    for row in found.collect():
        toxic, other = (row["toxic"] + 0.5) / (sizes[1] + 1), (row["other"] + 0.5) / (sizes[0] + 1)
        if row["other"] and toxic < LEAST_NEAR_RATIO * other:
            plain.add(row["term"])
    return [replace(t, near=i not in plain) for i, t in enumerate(terms)]


# --- terms in context -----------------------------------------------------------------


def _quoted(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place is between quotation marks opened on its own line."""
    marks = np.zeros(len(data) + 1, np.int64)
    marks[1:] = np.cumsum(data == 0x22)
    turn = np.zeros(len(data) + 1, np.int64)
    two = np.append(data[1:], 0)
    three = np.append(data[2:], [0, 0])[: len(data)]
    opens = ((data == 0xC2) & (two == 0xAB)) | ((data == 0xE2) & (two == 0x80) & (three == 0x9C))
    closes = ((data == 0xC2) & (two == 0xBB)) | ((data == 0xE2) & (two == 0x80) & (three == 0x9D))
    turn[1:] = np.cumsum(opens.astype(np.int8) - closes.astype(np.int8))
    starts = np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets]))
    line = starts[np.searchsorted(starts, at, "right") - 1]
    return ((marks[at] - marks[line]) % 2 == 1) | (turn[at] > turn[line])


def term_features(lexicon: Lexicon, column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of terms by kind and context, for each text."""
    words = Words(column, separator=SEPARATORS, lower=True)
    n = len(words.counts)
    data = words.data
    _, first, same = np.unique(words.hash, return_index=True, return_inverse=True)
    term = np.full(len(first), -1, np.int64)
    edits = np.zeros(len(first), np.int64)
    for i, at in enumerate(first):
        word = data[words.begin[at] : words.end[at]].tobytes().decode("utf-8", "replace").lower().strip(EDGES)
        if len(word) >= 3:
            term[i], edits[i] = lexicon.match(word)
    hit = np.flatnonzero(term[same] >= 0)
    kind, fuzzy = term[same][hit], edits[same][hit] > 0
    weight = EDIT_WEIGHT ** edits[same][hit]
    owner = words.text_number()[hit]
    # marks beyond ASCII are at the ends of a word, so its middle is looked at
    middle = (words.begin[hit] + words.end[hit]) // 2
    quoted = _quoted(data, words.offsets, middle) if len(hit) else np.zeros(0, bool)
    # other terms of the same text in the window around each term
    low = np.maximum(np.searchsorted(hit, hit - AROUND), np.searchsorted(owner, owner))
    high = np.minimum(np.searchsorted(hit, hit + AROUND, "right"), np.searchsorted(owner, owner, "right"))
    crowd = np.zeros(n, np.int64)
    np.maximum.at(crowd, owner[~quoted], (high - low)[~quoted])
    count = lambda which: np.bincount(owner[which], weight[which], n)
    pairs = np.unique(np.stack([owner, kind]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
    exact, near = count(~quoted & ~fuzzy), count(~quoted & fuzzy)
    quoted_exact, quoted_near = count(quoted & ~fuzzy), count(quoted & fuzzy)
    worth = np.array([t.weight for t in lexicon.terms] or [0.0])[kind] * weight
    strongest = np.zeros(n)
    np.maximum.at(strongest, owner[~quoted], worth[~quoted])
    found = {
        "exact": np.log1p(exact),
        "fuzzy": np.log1p(near),
        "quoted_exact": np.log1p(quoted_exact),
        "quoted_fuzzy": np.log1p(quoted_near),
        "crowded": np.log1p(crowd),
        "density": (exact + near) / np.maximum(words.counts, 1),
        "kinds": np.log1p(np.bincount(pairs[0], minlength=n)),
        "any_exact": exact > 0,
        "any_fuzzy": near > 0,
        "any_quoted": quoted_exact + quoted_near > 0,
        "evidence": np.log1p(np.bincount(owner[~quoted], worth[~quoted], n)),
        "strongest": strongest,
    }
    return {name: found[name].astype(np.float64) for name in FEATURES}


def _features(terms: list[Term]):
    def kernel(batches):
        lexicon = Lexicon(terms)
        for batch in parts(batches):
            found = term_features(lexicon, batch["text"])
            yield pa.record_batch([batch["doc_id"], *map(pa.array, found.values())], names=["doc_id", *FEATURES])

    return kernel


def matches(docs: DataFrame, terms: list[Term], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the term features of every row."""
    kind = "doc_id long, " + ", ".join(f"{n} double" for n in FEATURES)
    return texts(docs, doc_id, text).mapInArrow(_features(terms), kind)


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    cut: float = 0.3,
    lexicon_rows: int = LEXICON_ROWS,
) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least ``cut``) of every row."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    # lexicon_rows bounds what is broadcast and what the lexicon is learnt from
    few = seeded_sample(known, ["doc_id"], lexicon_rows, 5)
    sample = stage(texts(docs, doc_id, text).join(F.broadcast(few), "doc_id"), "sample")
    found = stage(matches(docs, learn_lexicon(sample), doc_id, text), "terms")
    labelled = stage(found.join(known, "doc_id"), "labelled")
    sizes = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        column = F.lit(sizes.get(1, 0) / total if total else 0.0)
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
        model = LogisticRegression(labelCol="label", regParam=1e-4, maxIter=60).fit(vectors.select("label", "features"))
        logit = F.lit(float(model.intercept))
        for name, weight in zip(FEATURES, model.coefficients.toArray()):
            logit = logit + F.col(name) * float(weight)
        column = 1 / (1 + F.exp(-logit))
    return found.withColumn("score", column).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
