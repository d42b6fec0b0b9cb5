"""Quality of texts by Bradley-Terry ranking: scores learned from preference pairs.

A text of label 1 is preferred to one of label 0.  With latent scores
w . x of feature vectors x, the preferred text of a pair wins with
probability sigmoid(w . (x_good - x_bad)), and w maximises the likelihood
of all sampled pairs: logistic loss on feature differences, which has no
intercept and one optimum (Newton steps, in numpy).

Features come from whole texts and are shares, so they don't depend on
length: kinds of bytes, kinds of neighbouring bytes, words that repeat one
of the words just before, distinct words among RUN words, repeated lines,
length of words.  They are taken in bounded blocks of bytes; a long text is read
in pieces whose tallies add up.

A ranking has no scale of its own, so the cut is a quantile of scores: of
all quantiles of the learning sample's latent scores that one which
divides its labels best (mean of both classes' shares told right).  Scores
are sigmoid(a (latent - cut) + log(CUT / (1 - CUT))), so a latent score at
the cut becomes CUT; the slope a is fitted to the labels.  A corpus may
also be cut at a quantile of its own scores (``best_share``).

Only a bounded sample of labelled rows reaches the driver (SAMPLE of each
label); all texts are scored, batch by batch.

Defined cases: a null text, or one without a word, has score 0; without
labelled rows of both labels every other text has score 0.5; rows with a
null or other label, or a null doc_id, teach nothing; a doc_id with
several labels teaches each; repeated rows repeat, but teach once; equal
scores stay equal (``best_share`` keeps all of a tie); very long texts are
read whole; doc_ids may be of any type; an empty table gives an empty
result; columns besides doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .language_id import held_out

#: Bound of the sample: about so many labelled rows of each label; opponents of each row.
SAMPLE, OPPONENTS = 3000, 6
#: Weight of the squared coefficients, for each pair; Newton steps.
RIDGE, STEPS = 1e-3, 30
#: Texts with this score or more are predicted to be good.
CUT = 0.3
#: Words before a word that it may repeat; standard deviations at which features are cut off.
BACK, FAR = 4, 4.0
#: Words among which distinct ones are counted.
RUN = 64
#: Bytes of a text that are read at once.
PIECE = 1 << 20

#: Kinds of bytes: small, capital, digit, space, line end, control, start and rest of longer characters, and each mark of its own.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS = 8 + len(_MARKS)


def _kinds() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[97:123], out[65:91], out[48:58], out[[32, 9]], out[[10, 11, 12, 13]] = 0, 1, 2, 3, 4
    out[192:], out[128:192] = 6, 7
    out[_MARKS] = 8 + np.arange(len(_MARKS))
    return out


KIND = _kinds()
#: Kinds for pairs of neighbours: small or longer, capital, digit, space, line end, mark.
GROUP = np.array([0, 1, 2, 3, 4, 5, 0, 0, *[5] * len(_MARKS)], np.uint8)[KIND]
_PAIRS = 36
_MARK = (GROUP == 5) & (np.arange(256) > 32)
#: Tallies of a text: kinds, pairs, then words, repeats, capital words, words that end in a mark, bytes of words, lines, repeated lines, distinct words of runs.
TALLIES = _KINDS + _PAIRS + 8
FEATURES = TALLIES - 2


def _tallies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts by text (TALLIES columns) of a block of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, TALLIES))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out[:, :_KINDS] = np.bincount(owner * _KINDS + KIND[data], minlength=n * _KINDS).reshape(n, -1)
    if len(data) > 1:
        group = GROUP[data].astype(np.int64)
        both = owner[:-1] == owner[1:]
        out[:, _KINDS : _KINDS + _PAIRS] = np.bincount((owner[:-1] * _PAIRS + group[:-1] * 6 + group[1:])[both], minlength=n * _PAIRS).reshape(n, -1)
    words, starts, ends, first = K.words(data, offsets)
    at = out[:, _KINDS + _PAIRS :]
    counts = np.diff(first)
    mine = np.repeat(np.arange(n), counts)
    add = lambda col, flags: np.add(at[:, col], np.bincount(mine, weights=flags, minlength=n), out=at[:, col])
    again = np.zeros(len(words), bool)
    for back in range(1, min(BACK, max(0, len(words) - 1)) + 1):
        again[back:] |= (words[back:] == words[:-back]) & (mine[back:] == mine[:-back])
    at[:, 0] = counts
    add(1, again)
    if len(words):
        add(2, (KIND[data[starts]] == 1) & (KIND[data[np.minimum(starts + 1, ends - 1)]] == 1))
        add(3, _MARK[data[ends - 1]])
        add(4, ends - starts)
        run = mine * (len(words) // RUN + 1) + (np.arange(len(words)) - first[mine]) // RUN
        order = np.lexsort((words, run))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (run[order][1:] != run[order][:-1])
        at[:, 7] = np.bincount(mine[order][fresh], minlength=n)
    low, high = K.spans(data, offsets, data != 10)
    if len(low):
        whose = np.searchsorted(offsets, low, "right") - 1
        lines = K.substrings(data, low, high)
        order = np.lexsort((lines, whose))
        same = np.zeros(len(lines), bool)
        same[1:] = (lines[order][1:] == lines[order][:-1]) & (whose[order][1:] == whose[order][:-1])
        at[:, 5] = np.bincount(whose, minlength=n)
        at[:, 6] = np.bincount(whose[order][same], minlength=n)
    return out


def _features(t: np.ndarray) -> np.ndarray:
    """Square roots of shares, which spreads small ones, and the log of the mean length of words."""
    size = np.maximum(t[:, :_KINDS].sum(axis=1, keepdims=True), 1)
    words, repeats, capital, marked, letters, lines, again, distinct = t[:, _KINDS + _PAIRS :].T
    w, rows = np.maximum(words, 1), np.maximum(lines, 1)
    more = np.stack([repeats / w, capital / w, marked / w, again / rows, 1 - distinct / w], axis=1)
    return np.concatenate([np.sqrt(t[:, : _KINDS + _PAIRS] / size), np.sqrt(more), np.log1p(letters / w)[:, None]], axis=1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and whether it has a word."""
    data, offsets = K.buffers(texts)
    out = np.zeros((len(texts), TALLIES))
    for a, b in K.blocks(offsets):
        low, high = int(offsets[a]), int(offsets[b])
        if b == a + 1 and high - low > PIECE:
            while low < high:
                end = low + PIECE
                while end < high and data[end] not in (32, 10):
                    end += 1
                end = min(end, high)
                out[a] += _tallies(data[low:end], np.array([0, end - low]))[0]
                low = end
        else:
            out[a:b] = _tallies(data[low:high], offsets[a : b + 1] - low)
    return _features(out), out[:, _KINDS + _PAIRS] > 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """w that maximises the likelihood of pairs given as x_winner - x_loser, less ridge |w|^2 / 2 a pair."""
    n, d = differences.shape
    w = np.zeros(d)
    loss = lambda w: np.logaddexp(0, -(differences @ w)).mean() + ridge / 2 * w @ w
    now = loss(w)
    for _ in range(STEPS):
        p = _sigmoid(-(differences @ w))
        slope = -(differences.T @ p) / n + ridge * w
        curve = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(d)
        step, size = np.linalg.solve(curve, slope), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - new < 1e-10:
            break
        now = new
    return w


def best_cut(latent: np.ndarray, good: np.ndarray) -> float:
    """Between two neighbouring quantiles: where the mean of both classes' shares told right is largest, the middle of ties."""
    order = np.argsort(latent, kind="stable")
    s, y = latent[order], good[order]
    below = np.cumsum(~y) / max(1, (~y).sum()) + 1 - np.cumsum(y) / max(1, y.sum())
    gaps = np.flatnonzero(s[1:] > s[:-1])
    if not len(gaps):
        return float(s[0])
    ties = gaps[below[gaps] >= below[gaps].max() - 1e-12]
    at = ties[len(ties) // 2]
    return float((s[at] + s[at + 1]) / 2)


@dataclass
class Model:
    """Mean and spread of features, weights, cut of the latent score, slope."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row, so that a text's score doesn't depend on its batch.
        return (np.clip((x - self.mean) / self.spread, -FAR, FAR) * self.weights).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (self.latent(x) - self.cut) + np.log(CUT / (1 - CUT)))


def train(x: np.ndarray, good: np.ndarray, seed: int = 0) -> Model | None:
    """Fit to rows of features and their labels; None unless both labels are there."""
    if good.all() or not good.any():
        return None
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / spread, -FAR, FAR)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    winners = np.concatenate([np.repeat(up, OPPONENTS), rng.choice(up, len(down) * OPPONENTS)])
    losers = np.concatenate([rng.choice(down, len(up) * OPPONENTS), np.repeat(down, OPPONENTS)])
    w = bradley_terry(z[winners] - z[losers])
    latent = z @ w
    cut = best_cut(latent, good)
    # The slope of the likelihood through the fixed point (cut, CUT): a search on a grid of logs.
    base, far = np.log(CUT / (1 - CUT)), latent - cut
    slopes = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    loss = [np.logaddexp(0, np.where(good, -1, 1) * (a * far + base)).mean() for a in slopes]
    return Model(mean, spread, w, cut, float(slopes[int(np.argmin(loss))]))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (True: 1) of about `per_label` rows of each label outside the held-out fold.

    Rows are chosen by a hash of their doc_id, and only the chosen ids are
    joined with texts; features are taken in tasks.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_label / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_label / counts.get(0, 1))))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(12)), F.lit(1 << 40)) < share * (1 << 40))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(batch.column(0))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([lists.filter(pa.array(some)), batch.column(1).filter(pa.array(some))], ["x", "y"])

    # At most some thousand ids: per_label of each label.
    found = texts.join(F.broadcast(chosen), "id").select("text", "y").mapInArrow(run, "x array<double>, y int").distinct().collect()
    found = sorted((r[1], tuple(r[0])) for r in found)
    return np.array([x for _, x in found]).reshape(-1, FEATURES), np.array([y == 1 for y, _ in found], bool)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE) -> Model | None:
    x, good = labelled(docs, labels, label, per_label)
    return train(x, good) if len(good) else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every row; only the text is an input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(batch.column(1))
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(some, score, 0.0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def best_share(docs: DataFrame, model: Model | None, share: float, accuracy: int = 10_000) -> DataFrame:
    """doc_id, score of the best `share` of all rows: those at or above that quantile of the corpus's scores."""
    rows = scored(docs, model)
    cut = rows.agg(F.percentile_approx("score", F.lit(1 - share), accuracy)).first()[0]
    return rows.where(F.col("score") >= F.lit(cut))


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
