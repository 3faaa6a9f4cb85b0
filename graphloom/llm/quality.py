"""Quality of documents: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles of a bounded labelled sample; each tree's splits come from histograms
of gradients over the bins. Trained trees are flattened into arrays, a row a tree and a place a node, and a batch of
documents walks down all of them at once, a level at a time.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample, fold, slices, store

SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, RIDGE, LEAST_HESSIAN = 64, 4, 80, 0.15, 1.0, 2.0
FOLDS, THRESHOLD = 5, 0.3
#: Bytes of a text that are looked at together, and those up to the next end of a word or line.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")
PAIR_MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))

FEATURES = (
    "bytes", "words", "word_length", "long_words", "upper", "digits", "marks", "other_marks", "bangs", "bars", "beyond_ascii",
    "distinct_words", "top_word", "top_three_words", "same_as_before", "distinct_lines", "line_words", "short_lines",
    "stops", "capital_words", "shouted_words", "distinct_pairs", "single_letters", "mean_run", "byte_entropy", "at_signs", "hashes", "urls",
)

_CLASS = np.zeros(256, dtype=np.int64)  # 0: else, 1: A-Z, 2: a-z, 3: 0-9, 4: beyond ASCII, 5: white space, 6: sentence marks
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6


class _Words:
    """Counts over a text's words, which come in lists."""

    def __init__(self):
        self.n = self.length = self.long = self.same = self.capital = self.shouted = self.single = self.stops = 0
        self.hashes, self.pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.before = self.hashes[0]

    def add(self, parts: list[bytes]):
        lengths = list(map(len, parts))
        self.n += len(parts)
        self.length += sum(lengths)
        self.long += sum(n > 20 for n in lengths)
        self.single += lengths.count(1)
        here = np.fromiter(map(hash, parts), np.int64, len(parts))
        self.hashes.append(here)
        here = np.concatenate([self.before, here])
        self.same += int((here[1:] == here[:-1]).sum())
        self.pairs.append(here[:-1] * PAIR_MIX + here[1:])
        self.before = here[-1:]
        self.capital += sum(map(bytes.istitle, parts))
        self.shouted += sum(map(bytes.isupper, parts))
        self.stops += sum(w[-1] in b".!?" for w in parts)


def _pieces(data: bytes, mark_ends):
    """data in pieces of PIECE_BYTES or more that end where mark_ends finds an end, the last one where data ends: nothing is cut in two."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        end = mark_ends(data, end) if end < len(data) else len(data)
        yield data[at:end]
        at = end


def _word_end(data: bytes, at: int) -> int:
    found = _SPACE.search(data, at)
    return found.end() if found else len(data)


def _line_end(data: bytes, at: int) -> int:
    found = data.find(b"\n", at)
    return found + 1 if found >= 0 else len(data)


def statistics(data: bytes | None) -> list[float]:
    """FEATURES of one text. Null is empty; an empty text has zeros. Texts are taken in pieces of whole words, and of whole
    lines where lines count, so that their length makes no difference."""
    data = data or b""
    size = max(1, len(data))
    counts = np.zeros(256, dtype=np.int64)
    w, lines, lines_n, short = _Words(), [np.zeros(0, np.int64)], 0, 0
    for piece in _pieces(data, _word_end):
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        w.add(piece.split())
    for piece in _pieces(data, _line_end):
        own = [x for x in piece.split(b"\n") if x.strip()]
        lines_n += len(own)
        short += sum(len(x) < 30 for x in own)
        lines.append(np.fromiter(map(hash, own), np.int64, len(own)))
    urls = data.count(b"http") + data.count(b"www.")
    distinct, times = np.unique(np.concatenate(w.hashes), return_counts=True)
    all_pairs = np.concatenate(w.pairs)
    pairs_n, distinct_pairs, distinct_lines = len(all_pairs), len(np.unique(all_pairs)), len(np.unique(np.concatenate(lines)))
    n, top = max(1, w.n), [*np.sort(times)[::-1][:3].tolist(), 0, 0, 0]
    by = np.bincount(_CLASS, weights=counts, minlength=7)
    share = counts[counts > 0] / size
    return [
        math.log1p(len(data)), math.log1p(w.n), w.length / n, w.long / n, by[1] / max(1, by[1] + by[2]), by[3] / size, by[6] / size, by[0] / size,
        counts[33] / n, counts[124] / n, by[4] / size, len(distinct) / n, top[0] / n, sum(top[:3]) / n, w.same / n, distinct_lines / max(1, lines_n),
        w.n / max(1, lines_n), short / max(1, lines_n), w.stops / n, w.capital / n, w.shouted / n, distinct_pairs / max(1, pairs_n), w.single / n,
        n / max(1, n - w.same), float(-(share * np.log2(share)).sum()) if len(data) else 0.0, counts[64] / n, counts[35] / n, urls / n,
    ]


class Trees:
    """Flattened trees: at node i of a tree, feature and threshold; its children are 2i + 1 (at most the threshold) and 2i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), np.arange(len(self.feature))[None, :]
        at, rows = np.zeros((n, len(self.feature)), dtype=np.int64), np.arange(n)[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        z = self.start + self.value[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of logistic loss for labels y of 0 and 1. One class alone gives a constant."""
    n, width = x.shape
    rate = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    start, inner = math.log(rate / (1 - rate)), 2**DEPTH - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]) if n else np.zeros((0, width), int)
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    z = np.full(n, start)
    for t in range(TREES if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-z))
        grad, hess, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-6)
            for f in range(width):
                if not len(edges[f]):
                    continue
                key = local * BINS + binned[:, f]
                g = np.bincount(key, weights=grad, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(key, weights=hess, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(h < LEAST_HESSIAN) | (total_h - h < LEAST_HESSIAN)] = -1
                gain = gain[:, : len(edges[f])]
                cut = gain.argmax(axis=1)
                got = gain[np.arange(nodes), cut]
                for node in np.flatnonzero(got > best):
                    best[node] = got[node]
                    feature[t, first + node], threshold[t, first + node] = f, edges[f][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, weights=grad, minlength=inner + 1), np.bincount(leaf, weights=hess, minlength=inner + 1)
        value[t] = -RATE * g / (h + RIDGE)
        z += value[t][leaf]
    return Trees(feature, threshold, value, start)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from labelled rows outside fold 0; `rows` bounds the sample, of which statistics come to the driver."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold("doc_id", FOLDS) != 0)
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", rows)
    sample = store(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"))  # `rows` bounds what is broadcast

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, len(texts)), x], ["label", "x"])

    got = sample.mapInArrow(run, "label double, x array<double>").orderBy("x", "label").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return boost(x, got["label"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in `keep` (doc_id, unless said) with held_out, score, predicted; a row for each of docs' rows.

    Null and empty texts have zero statistics and are scored like others. A null id is in the fold of the empty id. Null
    labels and ids are left out; a document labelled twice is good if one label says so. Without labels, every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(batch.num_columns - 1)):
                kept = [batch.column(k).slice(first, len(texts)) for k in range(len(keep))]
                x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.value.score(x))], schema.names)

    out = docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
    return out.select(*[F.col(c) for c in keep], (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
