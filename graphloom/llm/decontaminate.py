"""Benchmark passages in documents: a prefix-filtered set join with exact verification.

A window is a run of WINDOW consecutive words of a benchmark item; an item of fewer words is one window. A window's
tokens are its shingles of SHINGLE words. As all of them must be in a document that holds the window, the join needs one
prefix token of each window: the shingle that is rarest in all documents. Where a document has that token, its place in
the window gives the only possible start (positional bound), which must leave room for the whole window in the document
(length bound); the window's words are then compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices
from graphloom.llm.wordhash import PIECE_BYTES, Words, pieces, runs

WINDOW, SHINGLE = 10, 3
#: Bytes of benchmark text whose windows one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 21


class Tokens:
    """A set of token hashes of some widths, each with a number; a filter of one byte for 2^FILTER_BITS hash prefixes comes first."""

    def __init__(self, by_width: dict[int, np.ndarray]):
        self.keys = {w: np.unique(k) for w, k in sorted(by_width.items()) if len(k)}
        self.base, self.filter, at = {}, {}, 0
        for w, k in self.keys.items():
            self.base[w], at = at, at + len(k)
            self.filter[w] = np.zeros(1 << FILTER_BITS, dtype=bool)
            self.filter[w][k >> np.uint64(64 - FILTER_BITS)] = True
        self.n = at

    def found(self, hashes: np.ndarray):
        """(width, places, token numbers) for each width."""
        for w, keys in self.keys.items():
            got = runs(hashes, w)
            places = np.flatnonzero(self.filter[w][got >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(keys, got[places]), len(keys) - 1)
            same = keys[at] == got[places]
            yield w, places[same], at[same] + self.base[w]

    def number(self, width: int, key) -> int:
        return self.base[width] + int(np.searchsorted(self.keys[width], key))


class Windows:
    """The windows of some items: words, item, and tokens."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, shingle: int):
        self.texts: list[bytes] = []
        self.items: list[list] = []
        self.hashes: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        for item, text in items:
            words = Words([text])
            h = words.hashes()
            size = min(window, len(h))
            for a in range(len(h) - size + 1 if size else 0):
                key = words.text(a, a + size)
                if key not in seen:
                    seen[key] = len(self.texts)
                    self.texts.append(key)
                    self.items.append([])
                    self.hashes.append(h[a : a + size])
                if item is not None and item not in self.items[seen[key]]:
                    self.items[seen[key]].append(item)
        self.widths = [min(shingle, len(h)) for h in self.hashes]
        self.runs = [runs(h, w) for h, w in zip(self.hashes, self.widths)]

    def tokens(self) -> Tokens:
        by: dict[int, list] = {}
        for w, r in zip(self.widths, self.runs):
            by.setdefault(w, []).append(r)
        return Tokens({w: np.concatenate(r) for w, r in by.items()})


class Prefixes:
    """Each window's rarest token, as an index from token to windows."""

    def __init__(self, windows: Windows, tokens: Tokens, counts: np.ndarray):
        self.texts, self.items, self.sizes = windows.texts, windows.items, np.array([len(h) for h in windows.hashes])
        chosen = []
        for k, (w, r) in enumerate(zip(windows.widths, windows.runs)):
            rarity = [(int(counts[tokens.number(w, x)]), int(x), at) for at, x in enumerate(r)]
            _, key, at = min(rarity)
            chosen.append((w, key, at, k))
        by: dict[int, list] = {}
        for w, key, _, _ in chosen:
            by.setdefault(w, []).append(key)
        self.tokens = Tokens({w: np.array(k, dtype=np.uint64) for w, k in by.items()})
        numbered = sorted((self.tokens.number(w, np.uint64(key)), at, k) for w, key, at, k in chosen)
        numbers = np.array([x[0] for x in numbered], dtype=np.int64)
        self.at, self.window = np.array([x[1] for x in numbered], dtype=np.int64), np.array([x[2] for x in numbered], dtype=np.int64)
        self.bounds = np.searchsorted(numbers, np.arange(self.tokens.n + 1))
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.words = np.zeros((len(self.sizes), longest), dtype=np.uint64)
        for k, h in enumerate(windows.hashes):
            self.words[k, : len(h)] = h

    def occurrences(self, words: Words):
        """(start word, window) of every window in the texts, verified."""
        h = words.hashes()
        starts, found = [], []
        for _, places, numbers in self.tokens.found(h):
            n = self.bounds[numbers + 1] - self.bounds[numbers]
            each = np.repeat(np.arange(len(places)), n)
            entry = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.bounds[numbers][each]
            starts.append(places[each] - self.at[entry])
            found.append(self.window[entry])
        if not starts:
            return []
        start, window = np.concatenate(starts), np.concatenate(found)
        text = np.searchsorted(words.first, start, side="right") - 1
        fits = (start >= 0) & (start + self.sizes[window] <= words.first[np.minimum(text + 1, len(words.first) - 1)])
        start, window = start[fits], window[fits]
        for k in range(self.words.shape[1]):
            same = (k >= self.sizes[window]) | (h[np.minimum(start + k, len(h) - 1)] == self.words[window, k])
            start, window = start[same], window[same]
        return [(a, w) for a, w in zip(start.tolist(), window.tolist()) if words.text(a, a + int(self.sizes[w])) == self.texts[w]]


def scan(prefixes: Prefixes, texts: list[bytes | None], window: int = WINDOW):
    """(number of words, sorted ranges of hit words, windows found) for each text."""
    out: list = [None] * len(texts)
    short = [k for k, x in enumerate(texts) if len(x or b"") <= PIECE_BYTES]
    words = Words([texts[k] for k in short])
    counts = np.diff(words.first)
    for k, n in zip(short, counts.tolist()):
        out[k] = (n, [], [])
    for start, w in prefixes.occurrences(words):
        k = int(np.searchsorted(words.first, start, side="right")) - 1
        a = start - int(words.first[k])
        out[short[k]][1].append((a, a + int(prefixes.sizes[w])))
        out[short[k]][2].append(w)
    for k in set(range(len(texts))) - set(short):
        ranges, found, total = [], [], 0
        for base, piece, n in pieces(texts[k], window - 1):
            total = base + n
            for start, w in prefixes.occurrences(piece):
                if start + int(prefixes.sizes[w]) <= n:
                    ranges.append((base + start, base + start + int(prefixes.sizes[w])))
                    found.append(w)
        out[k] = (total, ranges, found)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _count_pass(docs: DataFrame, tokens: Tokens, window: int) -> np.ndarray:
    """How often each token is in the documents. At most a row a token comes from a task."""

    shared = max(tokens.keys, default=1) - 1

    def run(batches):
        counts = np.zeros(tokens.n, dtype=np.int64)
        for batch in batches:
            for _, rows in slices(batch.column("text")):
                words = Words([x for x in rows if len(x or b"") <= PIECE_BYTES])
                for w, places, numbers in tokens.found(words.hashes()):
                    end = words.first[np.searchsorted(words.first, places, side="right")]
                    counts += np.bincount(numbers[places + w <= end], minlength=tokens.n)
                for x in (x for x in rows if len(x or b"") > PIECE_BYTES):
                    for base, piece, n in pieces(x, shared):
                        for w, places, numbers in tokens.found(piece.hashes()):
                            own = (places + w > shared) | (base == 0)  # else the piece before has counted it
                            counts += np.bincount(numbers[own & (places + w <= n)], minlength=tokens.n)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["token", "n"])

    total = np.zeros(tokens.n, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        total[row["token"]] = row["n"]
    return total


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs needs doc_id, text; benchmark item_id, text. A row for each of docs' rows: doc_id, text_hash, n_words, spans, items.

    spans: ranges (first word, word after the last) of hit words; items: sorted ids, as strings, of items with a window in
    the text. Null or empty texts have no words and hold nothing; nor does a benchmark without words find anything. An
    item whose id is null marks words but is not listed. Items or texts that repeat count once in `items`. Other columns
    are left aside.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, g int, n_words long, spans array<struct<a: long, b: long>>, items array<string>"
    parts = []
    for k in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        windows = Windows([(r["item"], r["text"].encode()) for r in block.orderBy("item", "text").toLocalIterator()], window, shingle)
        tokens = windows.tokens()
        prefixes = spark.sparkContext.broadcast(Prefixes(windows, tokens, _count_pass(docs, tokens, window)))

        def run(batches, prefixes=prefixes):
            index = prefixes.value
            for batch in batches:
                for first, rows in slices(batch.column("text")):
                    got = scan(index, rows, window)
                    spans = [[{"a": a, "b": b} for a, b in merged(r)] for _, r, _ in got]
                    items = [sorted({i for w in set(f) for i in index.items[w]}) for _, _, f in got]
                    here = [c.slice(first, len(rows)) for c in (batch.column("doc_id"), batch.column("h"), batch.column("g"))]
                    kinds = (pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*here, pa.array([n for n, _, _ in got], pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1])], ["doc_id", "h", "g", "n_words", "spans", "items"])

        # The hashes tell rows apart when their parts meet.
        h, g = F.xxhash64("text"), F.hash("text")
        parts.append(docs.select("doc_id", "text", h.alias("h"), g.alias("g")).mapInArrow(run, schema))
    if blocks == 1:
        return parts[0].drop("g").withColumnRenamed("h", "text_hash")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    both = every.groupBy("doc_id", "h", "g", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies")
    )
    spans = "array<struct<a: bigint, b: bigint>>"

    def joined_span(done, s):
        last = F.element_at(done, -1)
        grown = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b")))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= s["a"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), grown.cast(spans)).cast(spans)).otherwise(F.concat(done, F.array(s).cast(spans)).cast(spans))

    joined = F.aggregate(F.col("spans").cast(spans), F.array().cast(spans), joined_span)
    return both.select("doc_id", F.col("h").alias("text_hash"), "n_words", joined.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
