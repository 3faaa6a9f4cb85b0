"""Toxic documents by weak supervision.

Voters look at whole texts: words of a small lexicon of insults, words and word beginnings mined from labelled rows,
patterns of shouting, and one that votes for a clean text where no other has anything to say. A generative model of the
votes on labelled and unlabelled texts estimates, by expectation maximisation, how each votes on toxic and on clean texts,
and from what is left between voters given the class their correlations, by which groups of voters that repeat one another
count less. A linear classifier is then trained on the posterior labels of all these texts, over the presence of words and
beginnings and the patterns. Labels choose the mined voters, count as votes seen before, and set the threshold's place.

The texts that it is trained on are bounded by SAMPLE_ROWS and UNLABELLED_ROWS, its tokens by VOCABULARY; everything else
covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample, discard, fold, slices, store
from graphloom.llm.wordhash import PIECE_BYTES, Words, pieces

#: Insults of four languages, lower case.
LEXICON = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown jerk fool hate kill shut ugly "
    "dummkopf idiotin blöd blödmann dumm trottel arschloch schwein abschaum widerlich ekelhaft versager hässlich wertlos "
    "imbécile crétin débile abruti connard salaud ordure minable dégoûtant nul stupide bouffon haine moche "
    "idiota imbécil estúpido estúpida tonto basura escoria asqueroso patético inútil payaso odio feo fracasado"
).split()
PREFIXES = (4, 6)
SAMPLE_ROWS, UNLABELLED_ROWS, VOCABULARY, MINED_VOTERS = 12_000, 8_000, 1_000, 200
#: Rows of the training matrix that are numbers, not marks, at a time.
CHUNK = 1_000
#: A token is dense in a text of which it makes up this share: some insults are made of parts that clean texts have now and then.
DENSE = 0.01
#: A mined token is in so many labelled rows at least, with this much log-likelihood ratio.
LEAST_ROWS, LEAST_RATIO = 3, 15.0
PATTERNS, SHOUTS = 4, (0, 1, 2)
FOLDS, THRESHOLD = 5, 0.5


def _stats(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums a text of: bytes, letters A-Z, letters a-z, exclamation marks."""
    marks = (np.ones(len(raw), bool), (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), raw == 33)
    return np.column_stack([np.diff(np.concatenate([[0], np.cumsum(m)])[bounds]) for m in marks]).astype(np.float64)


def patterns(stats: np.ndarray) -> np.ndarray:
    """Of each text, 0 or 1: shouts, much shouting, has exclamation marks often, has hardly any letter."""
    size, upper, lower, bangs = (stats[:, k] for k in range(4))
    size, letters = np.maximum(size, 1), np.maximum(upper + lower, 1)
    return np.column_stack([upper / letters > 0.3, upper / letters > 0.7, bangs / size > 0.02, (upper + lower) / size < 0.3]).astype(np.float32)


def token_hashes(words: Words) -> list[np.ndarray]:
    return words.hashes(*PREFIXES)


def tokens_of(texts: list[bytes | None], table: np.ndarray | None = None):
    """(text, token) pairs, each once, whether the token is dense in the text, and the texts' sums. Tokens are hashes, or
    places in `table`, a sorted array of hashes."""
    stats, sizes = np.zeros((len(texts), PATTERNS)), np.zeros(len(texts))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if table is not None:
        first = np.zeros(1 << 20, dtype=bool)
        first[table >> np.uint64(44)] = True

    def add(words: Words, whole: int, text_of: np.ndarray):
        sizes[:] += np.bincount(text_of[:whole], minlength=len(texts))
        for h in token_hashes(words):
            h, t = h[:whole], text_of[:whole]
            if table is not None:
                at = np.flatnonzero(first[h >> np.uint64(44)])
                place = np.minimum(np.searchsorted(table, h[at]), len(table) - 1)
                same = table[place] == h[at]
                pairs.append((t[at][same], place[same].astype(np.uint64)))
            else:
                pairs.append((t, h))

    short = [k for k, x in enumerate(texts) if len(x or b"") <= PIECE_BYTES]
    if short:
        parts = [texts[k] or b"" for k in short]
        words = Words(parts)
        add(words, len(words.start), np.repeat(np.array(short), np.diff(words.first)))
        stats[short] = _stats(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
    for k in set(range(len(texts))) - set(short):
        for a in range(0, len(texts[k]), PIECE_BYTES):
            raw = np.frombuffer(texts[k], np.uint8, min(PIECE_BYTES, len(texts[k]) - a), a)
            stats[k] += _stats(raw, np.array([0, len(raw)]))[0]
        for _, words, n in pieces(texts[k]):
            add(words, n, np.full(n, k))
    text = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    token = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(text)))
    return text[new], token[new], times >= DENSE * sizes[text[new]], stats


def lexicon_hashes() -> np.ndarray:
    return Words([" ".join(LEXICON).encode()]).hashes()


def mined_tokens(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of tokens that tell labels apart, best first; whether they do it by being dense or by being there; and
    whether they speak for toxic. sample: text, label."""

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                label = batch.column("label").slice(first, len(rows)).to_numpy(zero_copy_only=False)
                text, token, dense, _ = tokens_of(rows)
                keys, at = np.unique(token, return_inverse=True)
                sums = [np.bincount(at, weights=w, minlength=len(keys)).astype(np.int64) for w in (label[text], np.ones(len(text)), label[text] * dense, dense)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["token", "ones", "n", "dense_ones", "dense_n"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    n, ones = totals["n"], totals["ones"]
    if not 0 < ones < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    rate = ones / n

    def ratio(hits, rows):
        term = lambda x, share: F.when(x > 0, x * F.log(x / (rows * share))).otherwise(0.0)
        return F.when(rows >= LEAST_ROWS, 2 * (term(hits, F.lit(rate)) + term(rows - hits, F.lit(1 - rate)))).otherwise(0.0)

    counted = sample.select("text", "label").mapInArrow(run, "token long, ones long, n long, dense_ones long, dense_n long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("ones", "n", "dense_ones", "dense_n")])
    there, dense = ratio(F.col("ones"), F.col("n")), ratio(F.col("dense_ones"), F.col("dense_n"))
    scored = counted.withColumn("there", there).withColumn("dense", dense).where(F.greatest("there", "dense") >= LEAST_RATIO)
    by_dense = F.col("dense") > F.col("there")
    toxic = F.when(by_dense, F.col("dense_ones") / F.col("dense_n")).otherwise(F.col("ones") / F.col("n")) > rate
    best = scored.orderBy(F.greatest("there", "dense").desc(), "token").limit(VOCABULARY).select("token", by_dense.alias("by_dense"), toxic.alias("toxic")).collect()
    return np.array([r["token"] for r in best], np.int64).view(np.uint64), np.array([r["by_dense"] for r in best], bool), np.array([r["toxic"] for r in best], bool)


class LabelModel:
    """votes: rows x voters of 1 (toxic), 0 (nothing to say), -1 (clean). fit() gives each row's probability of toxic."""

    def __init__(self, rounds: int = 30, smooth: float = 1.0, anchor: float = 1.0):
        self.rounds, self.smooth, self.anchor = rounds, smooth, anchor

    def fit(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """gold: what is labelled toxic (1), clean (0) or not at all (nan). Votes on labelled rows enter each voter's
        estimates as counts seen before, `anchor` times, or else a group of voters that fire together takes one class for itself."""
        prior = float(np.clip(np.nanmean(gold), 0.005, 0.5)) if np.isfinite(gold).any() else 0.1
        for_it, against = (votes == 1).astype(np.float32), (votes == -1).astype(np.float32)
        start = for_it.sum(axis=1) - 0.5 * against.sum(axis=1)
        p = np.clip(1 / (1 + np.exp(-2 * start + 1)), 0.02, 0.98).astype(np.float64)
        weight = np.ones(votes.shape[1])

        def counted(q: np.ndarray) -> np.ndarray:
            yes, no = (q.astype(np.float32) @ k for k in (for_it, against))
            return np.stack([no, q.sum() - yes - no, yes]).astype(np.float64)

        seen = [self.anchor * counted(np.nan_to_num(q)) for q in (1 - gold, gold)]
        for step in range(self.rounds):
            self.by_class = []  # how each voter votes on clean, on toxic texts
            for q, before in zip((1 - p, p), seen):
                counts = counted(q) + before + self.smooth * np.array([[0.1], [1.0], [0.1]])
                self.by_class.append(counts / counts.sum(axis=0))
            prior = float(np.clip(0.5 * prior + 0.5 * p.mean(), 0.005, 0.5))
            if step % 5 == 4:
                weight = self.discounts(votes, p)
            no, nothing, yes = weight * (np.log(self.by_class[1]) - np.log(self.by_class[0]))
            gain = nothing.sum() + against @ (no - nothing).astype(np.float32) + for_it @ (yes - nothing).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain.astype(np.float64), -30, 30)))
        self.accuracy = self.by_class[1][2] * prior / np.maximum(1e-12, self.by_class[1][2] * prior + self.by_class[0][2] * (1 - prior))
        return p

    def discounts(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """1 / (1 + what a voter shares with the others): squared correlations of the votes, less what the class explains. An
        echo of k voters counts as one; voters with little in common keep their say."""
        means = [self.by_class[c][2] - self.by_class[c][0] for c in (0, 1)]
        cover = np.zeros((votes.shape[1], votes.shape[1]))
        for a in range(0, len(votes), CHUNK):
            q = p[a : a + CHUNK, None]
            left = votes[a : a + CHUNK] - ((1 - q) * means[0] + q * means[1])
            cover += left.T @ left / len(votes)
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        self.correlation = cover / np.outer(spread, spread)
        shared = np.where(np.abs(self.correlation) > 0.1, np.maximum(self.correlation, 0), 0)
        np.fill_diagonal(shared, 0)
        return 1 / (1 + (shared**2).sum(axis=1))


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[x[a : a + CHUNK].astype(np.float32) @ w.astype(np.float32) for a in range(0, len(x), CHUNK)]])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300, step: float = 0.1) -> np.ndarray:
    """Weights of least cross entropy with soft labels; by Adam, as tokens are in few rows each. x: marks of 0 and 1, the last column ones."""
    w, mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, rounds + 1):
        grad = penalty * np.append(w[:-1], 0)
        for a in range(0, len(x), CHUNK):
            part = x[a : a + CHUNK].astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(part @ w.astype(np.float32), -30, 30)))
            grad += part.T @ (p - y[a : a + CHUNK]).astype(np.float32) / len(x)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w - step * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


def calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """slope, shift of the logistic curve of labels y over scores z, by damped Newton steps, held near (1, 0)."""
    w, penalty = np.array([1.0, 0.0]), 1e-3
    x = np.column_stack([np.clip(z, -30, 30), np.ones(len(z))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + penalty * (w - [1, 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, grad), -0.5, 0.5)
    return max(float(w[0]), 0.05), float(w[1])


class Model:
    """Weights of: tokens of `table` that are there, tokens that are dense, patterns, and the bias."""

    def __init__(self, table: np.ndarray, weights: np.ndarray):
        self.table, self.weights = table, weights

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        text, token, dense, stats = tokens_of(texts, self.table)
        n, token = len(self.table), token.astype(np.int64)
        gain = self.weights[:n][token] + dense * self.weights[n : 2 * n][token]
        z = np.bincount(text, weights=gain, minlength=len(texts)) + patterns(stats) @ self.weights[2 * n : -1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(batches: list[pa.RecordBatch], place: dict[int, int], words: np.ndarray, mined: np.ndarray, by_dense: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The weights of a Model, learned from rows of label (null: none), tokens (twice the place, and one if dense) and patterns."""
    size, total = len(place), sum(len(batch) for batch in batches)
    x, gold = np.zeros((total, 2 * size + PATTERNS + 1), np.uint8), np.full(total, np.nan)
    x[:, -1], at = 1, 0
    for batch in batches:
        codes, n = batch.column("tokens"), len(batch)
        row = np.repeat(np.arange(at, at + n), np.diff(codes.offsets.to_numpy()))
        code = codes.flatten().to_numpy()
        x[row, code // 2] = 1
        x[row[code % 2 == 1], size + code[code % 2 == 1] // 2] = 1
        x[at : at + n, 2 * size : -1] = batch.column("patterns").flatten().to_numpy().reshape(n, PATTERNS)
        gold[at : at + n] = batch.column("label").to_numpy(zero_copy_only=False)
        at += n
    voters = [place[int(h)] for h in words] + [place[int(h)] + size * d for h, d, t in zip(mined, by_dense, toxic) if t][:MINED_VOTERS]
    voters = list(dict.fromkeys(voters)) + [2 * size + k for k in SHOUTS]
    votes = x[:, voters].astype(np.int8)
    votes = np.column_stack([votes, -(votes.sum(axis=1) == 0).astype(np.int8)])
    weights = logistic(x, LabelModel().fit(votes, gold))
    known = np.isfinite(gold)
    slope, shift = calibrated(scores(x[known], weights), gold[known])
    weights = weights * slope
    weights[-1] += shift
    return weights


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Model:
    """A model from labelled and other rows outside fold 0; `rows` and `unlabelled` bound the samples. Without labels of both
    kinds, only the lexicon votes. Rows of the samples go into a matrix of marks, a byte each, in the order of a hash."""
    outside = fold("doc_id", FOLDS) != 0
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(outside)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(known, "doc_id", rows)
    texts = docs.select("doc_id", "text")
    sample = store(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"))  # `rows` bounds what is broadcast
    mined, by_dense, toxic = mined_tokens(sample)
    words = lexicon_hashes()
    table = np.unique(np.concatenate([mined, words]))
    size, place = len(table), {int(h): k for k, h in enumerate(table)}
    if not len(mined):  # too little is labelled: the lexicon alone decides
        weights = np.zeros(2 * size + PATTERNS + 1)
        weights[[place[int(h)] for h in words]], weights[-1] = 3.0, -2.0
        return Model(table, weights)

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                text, token, dense, stats = tokens_of(rows, table)
                cuts = pa.array(np.searchsorted(text, np.arange(len(rows) + 1)), pa.int32())
                code = token.astype(np.int32) * 2 + dense
                marks = pa.array(list(patterns(stats)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, len(rows)), pa.ListArray.from_arrays(cuts, pa.array(code.astype(np.int32))), marks], ["label", "tokens", "patterns"])

    # The other texts are as many as `unlabelled` says, in expectation: a hash of the id below a bound that their count sets.
    others = texts.where("doc_id IS NOT NULL").where(outside)
    share = min(1.0, unlabelled / max(1, others.count()))
    others = others.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2**31)) < int(share * 2**31)).select("text", F.lit(None).cast("double").alias("label"))
    marked = sample.unionByName(others).mapInArrow(run, "label double, tokens array<int>, patterns array<float>")

    def learn(batches):
        yield pa.RecordBatch.from_arrays([pa.array([fitted(list(batches), place, words, mined, by_dense, toxic).tobytes()], pa.binary())], ["weights"])

    # One task learns from the sample, whose rows are bounded: of its matrix the driver gets the weights alone.
    ordered = marked.repartition(1).sortWithinPartitions(F.xxhash64("tokens", "label"), "label")
    weights = np.frombuffer(ordered.mapInArrow(learn, "weights binary").first()["weights"], np.float64)
    discard(sample)
    return Model(table, weights)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each of docs' rows. Other columns are left aside.

    Null and empty texts get the score of a text without any token. A null id is in the fold of the empty id. Labels of
    unknown documents, null labels and null ids are left out; a document labelled twice counts as toxic if one label says so.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), pa.array(model.value.score(rows))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows, all columns, that score below the threshold; as scored() has it for odd rows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column(at)):
                yield batch.slice(first, len(rows)).filter(pa.array(model.value.score(rows) < threshold))

    return docs.mapInArrow(run, docs.schema)
