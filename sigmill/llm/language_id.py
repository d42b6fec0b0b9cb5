"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes, A-Z as a-z, are cut into windows of WINDOW bytes.
Filters of width 2, 3 and 4 slide over the bytes, the largest response of
each filter in a window is kept, and a softmax layer turns these into
class probabilities.  A text's prediction is the class with the largest
mean log-probability over all its windows, weighted by their bytes.

One-hot bytes make a filter a sum of table entries, one per position, so
responses are gathered from tables of byte pairs.

The network learns from a bounded sample of labelled rows (see
``labelled_windows``), which reaches the driver; it is applied to whole
texts, batch by batch.

The softmax has one more class, none, taught by windows that are no
language: windows of the sample with their letters shuffled, and random
strings.  It is left out of predictions and scores.  The filter rejects
texts without a letter and those that are none with a probability beyond
what clean texts of the held-out fold reach (see ``most_none``).

Defined cases: a null text, or one without a letter, is `und` with score
0; without any labelled row every text is `und`, and the filter, which then
has nothing to judge by, rejects only texts without a letter; rows with a
null label teach nothing; of labels with equal scores the first by code
point is predicted; repeated rows repeat; very long texts are read window
by window; doc_ids may be of any type; an empty table gives an empty
result; columns besides doc_id, text and lang are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import forget, text_tags, written

WINDOW = 256
FILTERS = 16
WIDTHS = (2, 3, 4)
CLASSES = 128
#: Bound of the sample: labelled rows of each language, one window of each.
SAMPLE = 1500
#: The filter rejects what is none beyond this probability, or beyond that of all but a share TAIL of the held-out texts.
NONE, TAIL = 0.98, 0.001
EPOCHS, BATCH, RATE = 6, 64, 0.01
UND = "und"


def _byte_classes() -> np.ndarray:
    """Class of each byte; 0 is padding.  Letters and bytes of longer characters are told apart."""
    out = np.full(256, 1, np.uint8)
    out[48:58] = 2
    out[97:123] = out[65:91] = np.arange(3, 29)
    out[[32, 9, 10, 11, 12, 13]] = 29
    out[128:192] = 30 + np.arange(64)
    out[192:256] = 94 + np.arange(64) // 2
    return out


CLASS = _byte_classes()


@dataclass
class Model:
    """labels; filter tables (width, position, class, filter); softmax weights and bias, the last class being none."""

    labels: list[str]
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two positions by byte pair (CLASSES**2 x 4 filters), and the last of width 3."""
        pairs = [(0, 0, 1), (1, 0, 1), (2, 0, 1), (2, 2, 3)]
        both = [(self.filters[w][a][:, None] + self.filters[w][b][None]).reshape(-1, FILTERS) for w, a, b in pairs]
        return np.concatenate(both, axis=1).astype(np.float32), self.filters[1][2].astype(np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Mean log-probabilities, texts x (labels and none)."""
        sizes = np.diff(offsets)
        counts = np.maximum(1, -(-(sizes + len(WIDTHS)) // WINDOW))
        starts = np.concatenate([[0], np.cumsum(counts * WINDOW)])
        code = np.zeros(starts[-1], np.uint8)
        code[np.arange(offsets[0], offsets[-1]) - offsets[0] + np.repeat(starts[:-1] - (offsets[:-1] - offsets[0]), sizes)] = CLASS[data]
        code = code.reshape(-1, WINDOW)
        # Filters at a window's end look into the next one, but not into that of the next text.
        ahead = np.zeros((len(code), len(WIDTHS)), np.uint8)
        ahead[:-1] = code[1:, : len(WIDTHS)]
        ahead[starts[1:] // WINDOW - 1] = 0
        best = np.empty((len(code), len(WIDTHS) * FILTERS), np.float32)
        f = FILTERS
        for a in range(0, len(code), 32):
            part = np.concatenate([code[a : a + 32], ahead[a : a + 32]], axis=1).astype(np.int64)
            got = tables[0][part[:, :-1] * CLASSES + part[:, 1:]]
            here = best[a : a + 32]
            here[:, :f] = got[:, :WINDOW, :f].max(axis=1)
            here[:, f : 2 * f] = (got[:, :WINDOW, f : 2 * f] + tables[1][part[:, 2 : WINDOW + 2]]).max(axis=1)
            here[:, 2 * f :] = (got[:, :WINDOW, 2 * f : 3 * f] + got[:, 2 : WINDOW + 2, 3 * f :]).max(axis=1)
        logs = _log_softmax(np.maximum(best, 0) @ self.weights + self.bias)
        first = starts[:-1] // WINDOW
        filled = np.clip(np.repeat(sizes, counts) - (np.arange(counts.sum()) - np.repeat(first, counts)) * WINDOW, 1, WINDOW)
        return np.add.reduceat(logs * filled[:, None], first, axis=0) / np.add.reduceat(filled, first)[:, None]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _no_language(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Of every second window its letters in another order, and for every eighth a random string."""
    out = []
    for t in texts[::2]:
        where = [i for i, c in enumerate(t) if c.isalpha()]
        mixed = list(t)
        for i, j in zip(where, rng.permutation(len(where)), strict=True):
            mixed[i] = t[where[j]]
        if len(where) > 20:
            out.append("".join(mixed))
    for i in range(len(texts) // 8):
        raw = rng.bytes(WINDOW)
        out.append((raw.hex(), base64.b64encode(raw).decode(), "".join(chr(97 + b % 26) if b % 7 else " " for b in raw))[i % 3][:WINDOW])
    return out


def train(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Fit on one window of each text.  Adam; gradients reach a filter where its response is largest."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    odd = _no_language(texts, rng)
    y = np.array([names.index(x) for x in labels] + [len(names)] * len(odd))
    texts = texts + odd
    code = np.zeros((len(texts), WINDOW + 4), np.int64)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        # A window of characters may have more bytes: which of them are used depends on the place of the row.
        at = i * 7919 % max(1, len(raw) - WINDOW + 1)
        raw = raw[at : at + WINDOW]
        code[i, : len(raw)] = CLASS[raw]
    params = [rng.normal(0, 0.1, (w, CLASSES, FILTERS)) for w in WIDTHS]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names) + 1)), np.zeros(len(names) + 1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for rows in np.split(order, range(BATCH, len(order), BATCH)):
            x = code[rows]
            peaks, places = [], []
            for w, table in zip(WIDTHS, params, strict=False):
                got = sum(table[j][x[:, j : j + WINDOW]] for j in range(w))
                place = got.argmax(axis=1)
                places.append(place)
                peaks.append(np.take_along_axis(got, place[:, None], 1)[:, 0])
            raw = np.concatenate(peaks, axis=1)
            hidden = np.maximum(raw, 0)
            delta = np.exp(_log_softmax(hidden @ params[-2] + params[-1]))
            delta[np.arange(len(rows)), y[rows]] -= 1
            delta /= len(rows)
            back = (delta @ params[-2].T) * (raw > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[i])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, places[i] + j, 1), np.arange(FILTERS)[None]), part)
                grads.append(g)
            grads += [hidden.T @ delta, delta.sum(axis=0)]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(names, params[:3], params[3].astype(np.float32), params[4].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_windows(docs: DataFrame, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """(window, lang) of about `per_label` labelled rows of each language outside the held-out fold.

    Which rows, and where the window begins in the text, depends on a hash
    of the doc_id and the text.  Rows with a null doc_id teach nothing.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in taught.groupBy("lang").count().collect()}
    if not counts:
        return []
    h = F.xxhash64("doc_id", "text")
    most = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))]), F.col("lang"))
    chosen = taught.where(F.pmod(h, F.lit(1 << 40)) < most * (1 << 40))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    # Many copies of one row all have one hash, so that a row is taken once.
    rows = chosen.select(F.substring("text", at, F.lit(WINDOW)).alias("w"), "lang", h.alias("h")).distinct()
    return [(r[0], r[1]) for r in sorted(rows.collect(), key=lambda r: (r[2], r[0], r[1]))]


def _judged(net: Model | None, tables, texts: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prediction and score of each text, and the probability that it is no language."""
    n = len(texts)
    best, score, none = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    if net:
        data, offsets = K.buffers(texts)
        for a, b in K.blocks(offsets):
            logs = net.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1], tables)
            best[a:b] = logs[:, :-1].argmax(axis=1)
            score[a:b] = np.exp(_log_softmax(logs[:, :-1]).max(axis=1))
            none[a:b] = np.exp(_log_softmax(logs)[:, -1])
    names = np.array(net.labels if net else [UND], object)
    return np.where(letter, names[best], UND), np.where(letter & (net is not None), score, 0.0), none


def _apply(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Model | None = model.value
        tables = net.tables() if net else None
        for batch in batches:
            pred, score, _ = _judged(net, tables, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, per_label: int = SAMPLE) -> Model | None:
    sample = labelled_windows(docs, per_label)
    return train([w for w, _ in sample], [x for _, x in sample]) if sample else None


def most_none(docs: DataFrame, model: Model) -> float:
    """A probability of being none that all but a share TAIL of the held-out fold's labelled texts stay within, NONE at least.

    All of them are judged, whole, and each text counts once; only those
    without a letter, which the filter rejects anyway, don't count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            none = _judged(net, tables, batch.column(2), np.ones(len(batch), bool))[2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(none)], ["tag", "tag2", "none"])

    tested = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & held_out(F.col("doc_id")) & _letter())
    judged = tested.select(*text_tags(), "text").mapInArrow(run, "tag bigint, tag2 bigint, none double")
    judged = written(judged.groupBy("tag", "tag2").agg(F.max("none").alias("none")), "language-none")
    over = judged.where(F.col("none") > NONE)
    most = int(TAIL * judged.count())
    bound = NONE if over.count() <= most else over.orderBy(F.desc("none")).limit(most + 1).agg(F.min("none")).first()[0]
    forget(judged)
    return bound


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _letter()).mapInArrow(_apply(shared), f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, languages: tuple[str, ...] | None = None, most: float | None = None, per_label: int = SAMPLE) -> DataFrame:
    """The documents in a recognised language, all columns kept.

    Rejected are texts that are `und`, those predicted in none of
    `languages` (default: any learned one), and those that are none with a
    probability above `most` (default: ``most_none``).
    """
    model = fit(docs, per_label)
    if model is None:
        return docs.where(_letter())
    bound = most_none(docs, model) if most is None else most
    shared, at, n = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            # Slices, so that what is kept of a batch is copied in small parts.
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                pred, _, none = _judged(net, tables, part.column(at), part.column(n).to_numpy(zero_copy_only=False).astype(bool))
                keep = (pred != UND) & (none <= bound)
                if languages is not None:
                    keep &= np.isin(pred, languages)
                rows = pa.array(keep.astype(bool))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(rows) for i in range(n)], part.schema.names[:n])

    return docs.select(*docs.columns, _letter()).mapInArrow(run, docs.schema)


def op2(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
