"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes, the last one filled up with zeros. Bytes are embedded; filters of several
widths slide over a window; the greatest response of each goes through a rectifier to a softmax. A document's
probabilities are its windows', weighted by their bytes. The network is trained here, in numpy, on windows of a bounded
sample of labelled texts, the same number of texts for each language; every window of every text is classified.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, slices, store

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4, 5), 8
#: Texts of the training sample, of each language at least, and windows of each text.
SAMPLE_ROWS, LEAST_ROWS, SAMPLE_WINDOWS = 4_000, 32, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows in a step: their patches stay in the processor's cache.
STEP = 64
FOLDS, HELD = 3, 1
NONE = "und"


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 1):
        rng, most = np.random.default_rng(seed), max(WIDTHS)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        # Filters of all widths in one matrix of the greatest width; what is beyond a filter's width stays zero.
        self.mask = np.zeros((most * EMBED, len(WIDTHS) * FILTERS), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 1, self.mask.shape) / np.sqrt(most * EMBED)).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = (rng.normal(0, 1, (self.mask.shape[1], len(languages))) / np.sqrt(self.mask.shape[1])).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        most, seen = max(WIDTHS), self.embed[x]
        return np.concatenate([seen[:, k : WINDOW - most + 1 + k] for k in range(most)], axis=2)

    def forward(self, x: np.ndarray):
        patches = self._patches(x)
        held = patches.reshape(-1, patches.shape[2]) @ self.filters
        pooled = held.reshape(len(x), -1, held.shape[1]).max(axis=1) + self.bias
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), patches, held, pooled

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[a : a + STEP])[0] for a in range(0, len(x), STEP)])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 2):
        """x: windows, y: places in languages. Adam on the cross entropy."""
        rng, step = np.random.default_rng(seed), 0
        names = ("embed", "filters", "bias", "out", "out_bias")
        mean, square = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a : a + BATCH]
                grads, step = self._gradients(x[rows], y[rows]), step + 1
                for k, g in grads.items():
                    mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                    rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, k, (getattr(self, k) - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, patches, held, pooled = self.forward(x)
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        active = np.maximum(pooled, 0)
        back = (p @ self.out.T) * (pooled > 0)
        where = held.reshape(len(x), -1, held.shape[1]).argmax(axis=1)  # the position that a filter's maximum is from
        rows = np.arange(len(x))[:, None]
        chosen = patches[rows, where]  # window, filter, patch
        to_patch = back[:, :, None] * self.filters.T[None]
        embed = np.zeros_like(self.embed)
        for k in range(max(WIDTHS)):
            np.add.at(embed, x[rows, where + k].ravel(), to_patch[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
        return {"embed": embed, "filters": np.einsum("bfk,bf->kf", chosen, back) * self.mask, "bias": back.sum(axis=0), "out": active.T @ p, "out_bias": p.sum(axis=0)}

    def classify(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        total = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        weight: list[np.ndarray] = []

        def run():
            if held:
                at, w = np.concatenate(owner), np.concatenate(weight)
                p = self.probabilities(np.concatenate(held)) * w[:, None]
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(at, weights=p[:, k], minlength=len(texts))
            held.clear(), owner.clear(), weight.clear()

        waiting = 0
        for k, text in enumerate(texts):
            for a in range(0, max(1, len(text)), WINDOW * 4096):  # a long text goes through in parts
                part = windows_of(text[a : a + WINDOW * 4096])
                size = np.full(len(part), WINDOW)
                size[-1] = max(1, len(text[a : a + WINDOW * 4096]) - WINDOW * (len(part) - 1))
                held.append(part), owner.append(np.full(len(part), k)), weight.append(size)
                waiting += len(part)
                if waiting >= 4096:
                    run()
                    waiting = 0
        run()
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = total.argmax(axis=1)
        return [self.languages[b] for b in best], np.clip(total[np.arange(len(texts)), best], 0, 1)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, least: int = LEAST_ROWS) -> Network | None:
    """From texts with a letter and a language, outside the held-out fold. None if there is no such text.

    The sample has the same number of texts of each language, in expectation: `rows` in all, but `least` of each language, of
    which any number is learned. A seeded hash of id and text chooses texts, and windows in a text.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL").where(fold("doc_id", FOLDS) != HELD).where(F.col("text").rlike(r"\p{L}"))
    counts = store(known.groupBy("lang").agg(F.count("*").alias("n")))
    languages = [r["lang"] for r in counts.select("lang").orderBy("lang").collect()]
    if not languages:
        return None
    each = max(least, rows // len(languages))
    dice = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = counts.select("lang", (F.lit(float(each)) / F.col("n")).alias("share"))
    sample = known.withColumn("dice", dice).join(F.broadcast(shares), "lang").where("dice < share").select("lang", "text")  # a row a language

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                langs, parts = [], []
                for lang, text in zip(batch.column("lang").slice(first, len(texts)).to_pylist(), texts):
                    windows = windows_of(text)
                    full = windows[:-1] if len(windows) > 1 else windows
                    for k in np.random.default_rng(zlib.crc32(text)).choice(len(full), min(SAMPLE_WINDOWS, len(full)), replace=False):
                        langs.append(lang)
                        parts.append(full[k].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "window"])

    got = sample.mapInArrow(run, "lang string, window binary").orderBy("lang", "window").collect()
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return None
    network = Network(languages)
    x = np.stack([np.frombuffer(r["window"], np.uint8) for r in got])
    network.fit(x, np.array([languages.index(r["lang"]) for r in got]))
    return network


def identified(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in `keep` (doc_id, unless said) with held_out, lang_pred, score; a row for each of docs' rows.

    A null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learned. A null
    id is in the fold of the empty id. Ids of any type may repeat. Texts of any length go through whole.
    """
    network = train(docs)
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(batch.num_columns - 1)):
                kept = [batch.column(k).slice(first, len(texts)) for k in range(len(keep))]
                known = [k for k, t in enumerate(texts) if t is not None and model.value is not None]
                langs, scores = [NONE] * len(texts), np.zeros(len(texts))
                if known:
                    found, score = model.value.classify([texts[k] for k in known])
                    scores[known] = score
                    for k, lang in zip(known, found):
                        langs[k] = lang
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], schema.names)

    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    out = docs.select(*keep, text.alias("_text")).mapInArrow(run, schema)
    return out.select(*[F.col(c) for c in keep], (fold("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
