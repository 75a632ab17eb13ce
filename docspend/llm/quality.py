"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned at quantiles.  Cyclic boosting goes over the features again and again and
adds a small step of a shallow tree of one feature's bins, fitted to the gradient; the steps add
up to one lookup table for each feature.  The pairs whose joint bins explain most of what is left
get tables of their own in the same way.  Scoring is vectorised: the bin of each feature, then a
sum of table entries.

The model is fitted on the driver from at most SAMPLE labelled rows (those with the smallest
hashes of doc_id), never from rows whose crc32(doc_id as text) mod 4 is 2.  Features are computed
from whole texts on the executors, for all rows.

Defined cases: a null text counts as empty and has all features 0; a label that is null, or that
belongs to no document, is not used; of contradicting labels of a doc_id the smaller counts; with
no labels, or labels of one kind, the score is the smoothed share of label 1 for every text; rows
that repeat are scored each; broken UTF-8 is read as U+FFFD; no rows give no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspend.llm.bytesops import LOWER, SpanHash, chunked, code_points, string_bytes, sums, words
from docspend.llm.common import clean_text
from docspend.shipping import ship

#: Labelled rows the model is fitted on at most.
SAMPLE = 20_000
ACCEPT = 0.7
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, RIDGE, PATIENCE = 48, 12, 6, 200, 0.12, 2.0, 15

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "upper", "digits", "marks", "exclaims", "bars", "stops", "non_ascii",
    "distinct", "top_word", "stutter", "line_words", "repeated_lines", "capitalised", "bare_words",
)


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT = _set(bytes(range(65, 91))), _set(b"0123456789")
MARK, EXCLAIM, BAR, STOP = _set(b"#*$%&<>@^~=+{}[]\\/_"), _set(b"!?"), _set(b"|"), _set(b".,;:")


def features(data: np.ndarray, offsets: np.ndarray, span: SpanHash) -> np.ndarray:
    """A row of FEATURES for each text of a chunk of bytes."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    count = np.diff(bounds)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(n), count)
    length = code_points(data, starts, ends)
    h = span(low, starts, ends)
    order = np.lexsort((h, text))
    fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])) if len(h) else np.zeros(0, bool)
    head = np.flatnonzero(fresh)
    times = np.diff(np.append(head, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, text[order][head], times)
    same = np.append((h[1:] == h[:-1]) & (text[1:] == text[:-1]), False)[: len(h)]
    # words without a letter or digit
    bare = np.zeros(len(data) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122) | DIGIT[data] | (data >= 0x80), out=bare[1:])
    empty = bare[ends] == bare[starts]
    breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
    lines = 1 + np.diff(breaks)
    line_starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]), kind="stable")
    line_text = np.repeat(np.arange(n), lines)
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = np.where(np.append(line_text[1:] == line_text[:-1], False), line_ends - 1, offsets[1:][line_text])
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lh, lt = span(low, line_starts[filled], line_ends[filled]), line_text[filled]
    turn = np.lexsort((lh, lt))
    again = (lh[turn][1:] == lh[turn][:-1]) & (lt[turn][1:] == lt[turn][:-1])
    dup = np.bincount(lt[turn][1:][again], minlength=n)
    each = lambda mask: sums(mask, offsets)
    mine = lambda mask: sums(mask, bounds) / some
    out = np.stack(
        [
            np.log1p(count), sums(length, bounds) / some, mine(length >= 12), mine(length <= 3), each(UPPER[data]) / size, each(DIGIT[data]) / size,
            each(MARK[data]) / some, each(EXCLAIM[data]) / some, each(BAR[data]) / some, each(STOP[data]) / some, each(data >= 0x80) / size,
            np.bincount(text[order][head], minlength=n) / some, top / some, mine(same), count / lines, dup / lines, mine(UPPER[data[starts]] if len(starts) else np.zeros(0, bool)), mine(empty),
        ],
        axis=1,
    )
    return out.astype(np.float32)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of ordered bins, and the number of bins on its left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    G, H = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (G - gl) ** 2 / (H - hl + RIDGE) - G**2 / (H + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, bin by bin, of a tree over ordered bins."""
    gain, k = _cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])


def shallow_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree that cuts one axis of a grid, then the other on each side."""
    best = (-1.0, None)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, k = _cut(a.sum(axis=1), b.sum(axis=1))
        for cut in {k, len(a) // 2} - {0}:
            out, gain = np.zeros_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gp, hp = a[part].sum(axis=0), b[part].sum(axis=0)
                leaf = shallow_tree(gp, hp, 1)
                out[part] = leaf
                gain -= float((leaf * gp).sum())
            if gain > best[0]:
                best = (gain, out if axis == 0 else out.T)
    return best[1] if best[1] is not None else np.zeros_like(g)


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b[:, j] * PAIR_BINS // (len(self.edges[j]) + 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (j, k), t in zip(self.pairs, self.grids):
            out += t[self.coarse(b, j), self.coarse(b, k)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for feature rows x and labels y in {0, 1}."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.binned(x)
    held = np.arange(len(y)) % 7 == 3  # for stopping only
    margin = np.full(len(y), model.intercept)

    def loss() -> float:
        m = margin[held]
        return float(np.mean(np.logaddexp(0, m) - y[held] * m))

    def boosted(parts, tables, tree):
        """Cyclic boosting of tables over the given bins; the best round on the held rows stays."""
        nonlocal margin
        best, since = (loss(), [t.copy() for t in tables], margin.copy()), 0
        for _ in range(ROUNDS):
            for bins, table in zip(parts, tables):
                p = 1 / (1 + np.exp(-margin))
                g = np.bincount(bins[~held], (p - y)[~held], table.size).reshape(table.shape)
                h = np.bincount(bins[~held], (p * (1 - p))[~held], table.size).reshape(table.shape)
                step = RATE * tree(g, h)
                table += step
                margin += step.ravel()[bins]
            now = loss()
            since = 0 if now < best[0] - 1e-6 else since + 1
            if not since:
                best = (now, [t.copy() for t in tables], margin.copy())
            elif since >= PATIENCE:
                break
        margin = best[2]
        return best[1]

    model.tables = boosted([b[:, j] for j in range(b.shape[1])], model.tables, shallow_tree)
    # pairs by what their joint bins explain of the remaining gradient
    p = 1 / (1 + np.exp(-margin))
    weight = [float(np.abs(t[b[:, j]]).mean()) for j, t in enumerate(model.tables)]
    strong = sorted(np.argsort(weight)[::-1][:10].tolist())
    gains = []
    for i, j in enumerate(strong):
        for k in strong[i + 1 :]:
            bins = model.coarse(b, j) * PAIR_BINS + model.coarse(b, k)
            g, h = np.bincount(bins, p - y, PAIR_BINS**2), np.bincount(bins, p * (1 - p), PAIR_BINS**2)
            gains.append((float((g**2 / (h + 10 * RIDGE)).sum()), j, k))
    model.pairs = [(j, k) for _, j, k in sorted(gains, reverse=True)[:PAIRS]]
    flat = [model.coarse(b, j) * PAIR_BINS + model.coarse(b, k) for j, k in model.pairs]
    model.grids = boosted(flat, [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in flat], shallow_pair)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from.  A null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _mapped(rows: DataFrame, schema: str, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = SpanHash()
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for lo, hi in chunked(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], span)
                yield make(batch.slice(lo, hi - lo), x)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # at most `sample` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def make(batch, x):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    # a doc_id in several rows counts once, so that the sample keeps its bound
    found = _mapped(rows.select("doc_id", "__y", "text"), "doc_id long, y int, x array<float>", make)
    once = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(once["x"].to_numpy()) if len(once) else np.zeros((0, len(FEATURES)), np.float32)
    return fitted(x, once["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def make(batch, x):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text")), "doc_id long, score double", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject; all columns stay."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = SpanHash()
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for lo, hi in chunked(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], span)
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(x) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
