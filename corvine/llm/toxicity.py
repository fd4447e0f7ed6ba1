"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens of a bounded training sample are labelled first: a token
of a toxic document is toxic if it, or one of its beginnings, occurs in far more toxic than
clean documents of the sample.  A two-state chain is then trained on windows of such tokens.
Every text is scored whole: the forward-backward algorithm gives each token's marginal
probability of the toxic state; a logistic function of their sum and maximum, fitted on the sample's
document labels, is the document's score, and tokens over one half are the spans.

A token none of whose features the model knows has the same emission as any other such
token.  Along a run of them the messages settle to a fixed point, so the algorithm runs over the
known tokens and as many neighbours as the messages need to settle to double precision.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _Cache
from .common import carried, map_rows

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit.

    The sample holds at most ``toxic`` and ``clean`` labelled documents of at most
    ``longest`` characters, those least by a hash of their id, equal texts once.
    """

    toxic: int = 3000
    clean: int = 5000
    longest: int = 20_000
    support: int = 4
    log_odds: float = 2.5
    features: int = 20_000
    window: int = 24
    windows: int = 6000
    rounds: int = 80
    l2: float = 1e-3


def word_features(word: str) -> list[str]:
    """A word, its beginnings of three to six characters and its end."""
    return [f"w={word}", *[f"p={word[:k]}" for k in range(3, min(7, len(word) + 1))], f"s={word[-3:]}"]


@dataclass
class Model:
    """Feature weights, transition scores between (clean, toxic), and the document function."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    transitions: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    document: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        """Score of the toxic state beyond the bias, zero for an unknown word."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))


def _step(m: float, t: tuple) -> float:
    """Log-odds that a state message gives the next state."""
    return np.logaddexp(t[0][1], m + t[1][1]) - np.logaddexp(t[0][0], m + t[1][0])


class Tagger:
    """A model at work; one per task, with a bounded cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self.back = tuple(zip(*model.transitions, strict=True))
        self._known = _Cache(lambda w: model.emission(w) or False, 100_000)
        # fixed points of both messages over unknown tokens, and how far they need to settle
        self._rest = [0.0, 0.0]
        reach = 1
        for side, t in enumerate((model.transitions, self.back)):
            m, n = 0.0, 0
            while n < 2000:
                new = model.bias + _step(m, t)
                n += 1
                if abs(new - m) < 1e-13:
                    break
                m = new
            self._rest[side], reach = m, max(reach, n)
        self.reach = min(2000, reach + 8)
        self._idle = self._odds(self._rest[0] + self._rest[1] - model.bias)

    @staticmethod
    def _odds(x: float) -> float:
        return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0

    def marginals(self, words: list[str]) -> tuple[float, dict[int, float]]:
        """Sum of all tokens' marginals, and those of the tokens near a known one or an end."""
        known = {i: x for i, x in enumerate(map(self._known.__getitem__, words)) if x is not False}
        out: dict[int, float] = {}
        # a text's ends are no fixed points either
        places, bias, reach = sorted({*known, 0, len(words) - 1} if words else ()), self.model.bias, self.reach
        i = 0
        while i < len(places):
            j = i
            while j + 1 < len(places) and places[j + 1] - places[j] <= 2 * reach:
                j += 1
            low, high = max(0, places[i] - reach), min(len(words), places[j] + reach + 1)
            emit = [bias + known.get(k, 0.0) for k in range(low, high)]
            ahead, behind = self._sweep(emit, self.model.transitions, low == 0, 0), self._sweep(emit[::-1], self.back, high == len(words), 1)[::-1]
            for k, (a, b, e) in enumerate(zip(ahead, behind, emit, strict=True)):
                out[low + k] = self._odds(a + b - e)
            i = j + 1
        return sum(out.values()) + (len(words) - len(out)) * self._idle, out

    def _sweep(self, emit: list[float], t: tuple, at_edge: bool, side: int) -> list[float]:
        (a, b), (c, d) = t
        out, exp, log1p = [], math.exp, math.log1p
        m = None if at_edge else self._rest[side]
        for e in emit:
            if m is None:
                m = e
            else:
                x, y = b, m + d
                up = (x if x > y else y) + log1p(exp(-abs(x - y)))
                x, y = a, m + c
                m = e + up - (x if x > y else y) - log1p(exp(-abs(x - y)))
            out.append(m)
        return out

    def document(self, words: list[str]) -> tuple[float, dict[int, float]]:
        """Score of a document and its tokens' marginals that count."""
        total, near = self.marginals(words)
        most = max(near.values(), default=self._idle if words else 0.0)
        a, b, c = self.model.document
        return self._odds(a + b * math.log1p(total) + c * most), near


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, training: Training, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """The bounded training sample: (text, label), without held-out rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64(id_col), id_col]
    # twice the number: some may be too long, be copies, or have no document
    picked = known.where("y = 1").orderBy(*order).limit(2 * training.toxic).unionByName(known.where("y = 0").orderBy(*order).limit(2 * training.clean))
    text = F.col(text_col)
    rows = docs.where(text.isNotNull() & (F.length(text) <= training.longest)).select(id_col, text.alias("text")).join(F.broadcast(picked), id_col)
    once = rows.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("y").alias("y"), F.min(id_col).alias("i"))
    out = []
    for y, n in ((1, training.toxic), (0, training.clean)):
        part = once.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n).select("text")
        out += [(r.text, y) for r in part.collect()]
    return out


def _lexicon(docs: list[tuple[list[str], int]], training: Training) -> dict[str, float]:
    """Log-odds of the features that occur in toxic documents with support."""
    seen, n = (Counter(), Counter()), [0, 0]
    for words, y in docs:
        n[y] += 1
        seen[y].update({f for w in set(words) for f in word_features(w)})
    odds = {
        f: math.log((k + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1)) for f, k in seen[1].items() if k >= training.support
    }
    best = sorted((f for f, x in odds.items() if x >= 1.0), key=lambda f: (-odds[f], f))[: training.features]
    return {f: odds[f] for f in best}


def fit(texts: list[tuple[str, int]], training: Training = Training()) -> Model:
    """Train tagger and document function on labelled texts; without both labels, an idle model."""
    once: dict[str, str] = {}  # equal words are one object, so the sample stays small on the driver
    docs = [([once.setdefault(w, w) for w in WORD.findall(t.lower())], y) for t, y in texts]
    if len({y for _, y in docs}) < 2:
        return Model(document=(-8.0, 0.0, 0.0) if not any(y for _, y in docs) else (0.0, 0.0, 0.0))
    odds = _lexicon(docs, training)
    index = {f: i for i, f in enumerate(odds)}
    strong = {f for f, x in odds.items() if x >= training.log_odds and (f[0] == "w" or f[0] == "p" and len(f) >= 6)}
    rng = np.random.default_rng(0)
    ids, tags = [], []
    width = training.window
    for words, y in docs:
        toxic = [y == 1 and not strong.isdisjoint(word_features(w)) for w in words]
        hits = [i for i, x in enumerate(toxic) if x]
        starts = [max(0, i - int(rng.integers(width))) for i in hits[:3]] + ([int(rng.integers(max(1, len(words) - width + 1)))] if words else [])
        for s in starts:
            ids.append([[index[f] for f in word_features(w) if f in index] for w in words[s : s + width]])
            tags.append(toxic[s : s + width])
    order = rng.permutation(len(ids))[: training.windows]
    ids, tags = [ids[i] for i in order], [tags[i] for i in order]
    w, bias, trans = _train_chain(ids, tags, len(index), training)
    model = Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, bias, trans)
    tagger = Tagger(model)
    x, y = [], np.array([y for _, y in docs], dtype=float)
    for words, _ in docs:
        total, near = tagger.marginals(words)
        x.append((1.0, math.log1p(total), max(near.values(), default=0.0)))
    model.document = _logistic(np.array(x), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _train_chain(ids: list, tags: list, n_features: int, training: Training) -> tuple[np.ndarray, float, tuple]:
    """Maximise the windows' conditional likelihood by Adam; gradients by forward-backward."""
    n, width = len(ids), training.window
    real = np.zeros((n, width), dtype=bool)
    gold = np.zeros((n, width), dtype=int)
    where, which = [], []
    for i, (row, tag) in enumerate(zip(ids, tags, strict=True)):
        real[i, : len(row)] = True
        gold[i, : len(row)] = tag
        for t, found in enumerate(row):
            where += [i * width + t] * len(found)
            which += found
    where, which = np.array(where, dtype=int), np.array(which, dtype=int)
    theta = np.zeros(n_features + 5)  # weights, bias, transitions (from, to)
    theta[n_features] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    log = np.logaddexp
    pairs = real[:, 1:]
    counted = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    for round_ in range(1, training.rounds + 1):
        w, bias, t = theta[:n_features], theta[n_features], theta[n_features + 1 :].reshape(2, 2)
        emit = np.zeros((n, width, 2))
        emit[:, :, 1] = bias + np.bincount(where, w[which], n * width).reshape(n, width)
        alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        alpha[:, 0] = emit[:, 0]
        for k in range(1, width):
            for b in (0, 1):
                alpha[:, k, b] = emit[:, k, b] + log(alpha[:, k - 1, 0] + t[0, b], alpha[:, k - 1, 1] + t[1, b])
            alpha[~real[:, k], k] = alpha[~real[:, k], k - 1]
        for k in range(width - 2, -1, -1):
            nxt = emit[:, k + 1] + beta[:, k + 1]
            for a in (0, 1):
                beta[:, k, a] = log(t[a, 0] + nxt[:, 0], t[a, 1] + nxt[:, 1])
            beta[~real[:, k + 1], k] = 0.0
        z = log(alpha[:, -1, 0], alpha[:, -1, 1])
        marginal = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], -50, 0)) * real
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + t[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                expected[a, b] = (np.exp(np.clip(joint, -50, 0)) * pairs).sum()
        wrong = (marginal - gold * real).ravel()
        grad = np.concatenate([np.bincount(which, wrong[where], n_features), [wrong.sum()], (expected - counted).ravel()]) / n + training.l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.2 * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.999**round_)) + 1e-8)
    t = theta[n_features + 1 :].reshape(2, 2)
    return theta[:n_features], float(theta[n_features]), tuple(tuple(map(float, row)) for row in t)


def tag_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.3,
    training: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(id, score, predicted, spans)`` of every whole text.

    ``spans`` lists the start and stop (in characters) of the tokens whose marginal is over one
    half, as ``[start, stop, start, stop, ...]``; ``predicted`` is 1 from ``threshold`` on.  The model
    is trained on ``labels`` of rows that are not held out and sees nothing but
    texts.  Null texts are scored as empty, rows with a null id are scored, repeated rows
    give repeated results, and with no labels of both kinds every score is that of the kind seen.
    Columns named in ``carry`` come along as ``in_*``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, training, id_col, text_col, label_col), training))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        tagger = Tagger(shared.value)
        for key, text, *rest in rows:
            low = (text or "").lower()
            score, near = tagger.document(WORD.findall(low))
            spans: list[int] = []
            toxic = {i for i, p in near.items() if p > 0.5}
            if toxic:
                # lower() may change lengths; offsets are of the text itself wherever it doesn't
                source = text if len(text) == len(low) else low
                for i, found in enumerate(WORD.finditer(source)):
                    if i in toxic:
                        spans += found.span()
            yield key, score, int(score >= threshold), spans, *rest

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, predicted int, spans array<int>" + carried(docs, carry)
    return map_rows(docs.select(id_col, text_col, *[F.col(c).alias(f"in_{c}") for c in carry]), run, schema)
