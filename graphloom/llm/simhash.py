"""SimHash near-duplicates over a segment-popcount embedding.

A fingerprint's 32 segments of two bits map to a point of 32 bit counts. The Manhattan distance of two points is never
above the Hamming distance of their fingerprints, and each differing count adds one at least: of points within Manhattan
distance 3, at most three coordinates differ. With the coordinates in six groups, three groups agree at least, so the
points share a cell (of width one) of one of the 20 grids on three groups each. Cells are joined with themselves, pairs
beyond Manhattan distance 3 go, and the others are verified on the fingerprints.

Equal fingerprints count once. Of a cell, all members meet a few leaders first; then those that no link has joined to the
cell's main component meet the others. So a cell full of near copies costs rows, not pairs, and no link is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, slices, store
from graphloom.llm.components import components
from graphloom.llm.wordhash import NO_SPACE, Words, pieces, runs
from graphloom.llm.wordhash import PIECE_BYTES as LONG_BYTES

SHINGLE_WORDS, SEED, BITS, MOST_DIFFERING = 3, 42, 64, 3
#: Members of a cell that all others are held against first.
LEADERS = 4
#: Bytes of a text that are parted into words at a time.
PIECE_BYTES = 1 << 20
LOW_BITS = np.uint64(0x0101010101010101)
EVEN = 0x5555555555555555


def word_pieces(data: bytes):
    """Lists of lower-cased words, cut from about PIECE_BYTES of text each, for texts of any length."""
    if len(data) <= PIECE_BYTES:
        yield data.lower().split()
        return
    at, rest = 0, b""
    while at < len(data):
        piece = rest + data[at : at + PIECE_BYTES].lower()
        at += PIECE_BYTES
        words = piece.split()
        rest = b""
        if at < len(data) and not piece[-1:].isspace():
            rest = words.pop() if words else b""
        if words:
            yield words
    if rest:
        yield rest.split()


def shingle_hashes(data: bytes, width: int = SHINGLE_WORDS):
    """Arrays of the XXH64 of each run of `width` words; of the whole sequence where there are fewer."""
    held: list[bytes] = []
    made = False
    for words in word_pieces(data):
        held += words
        if len(held) < width:
            continue
        made = True
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths + 1) - 1
        joined, digest = b" ".join(held), xxhash.xxh64_intdigest
        bounds = zip((ends - lengths)[: len(held) - width + 1].tolist(), ends[width - 1 :].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in bounds], dtype=np.uint64)
        held = held[len(held) - width + 1 :] if width > 1 else []
    if held and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def fingerprint(data: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes. No word, or null: 0."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(data or b"", width):
        n += len(hashes)
        padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
        padded[: len(hashes)] = hashes
        for bit in range(8):  # in each of a word's eight bytes, one bit is counted, of 255 hashes at a time
            counts = ((padded >> np.uint64(bit)) & LOW_BITS).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
            ones[bit::8] += counts.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    if not n:
        return 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long), a row for each of docs' rows."""

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                fps = np.array([fingerprint(x, width) for x in rows], dtype=np.uint64)
                same = [batch.column(c).slice(first, len(rows)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def popcounts(fp: Column) -> Column:
    """The point, packed: a two-bit count for each two-bit segment."""
    a, b = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Of two packed points. Counts 0 to 2 that differ by one differ in the low bit, by two in the high bit alone."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grid_masks(groups: int = 6, most: int = MOST_DIFFERING) -> list[int]:
    """For each choice of the groups that agree, the packed coordinates in them, as a signed long."""
    parts = [0] * groups
    for segment in range(BITS // 2):
        parts[segment % groups] |= 3 << (2 * segment)
    masks = [sum(parts[g] for g in chosen) for chosen in combinations(range(groups), groups - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_groups(rows: int) -> int:
    """Groups of coordinates for so many points: with more of them a cell holds more coordinates, and the grids, of which there
    are more then, few points a cell. A segment's count has 1.5 bits."""
    return next(g for g in range(2 * MOST_DIFFERING, BITS // 2 + 1) if 1.5 * (BITS // 2) * (g - MOST_DIFFERING) / g >= np.log2(max(rows, 1)) or g == 12)


def stars(points: DataFrame, value: list[str], leaders: int = LEADERS, seed: int = 0) -> DataFrame:
    """points: cell, node and the columns `value`. Each point with the leaders of its cell: those columns, and x, the leader's, as a struct.

    Leaders are the members whose seeded hashes are least, so that cells with the same members have the same ones.
    """
    least = points.groupBy("cell").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(seed + k)).alias("h"), "node", *value)).alias(f"l{k}") for k in range(leaders)])
    met = points.join(least, "cell").withColumn("x", F.explode(F.array_distinct(F.array(*[F.col(f"l{k}") for k in range(leaders)]))))
    return met.where(F.col("x.node") != F.col("node")).select("node", *value, "x")


def unsettled(points: DataFrame, labels: DataFrame, value: list[str]) -> DataFrame:
    """The points of cells that `labels` (node, component) has not joined to one: cell, node, value, label, the cell's most
    frequent label as main, and how many members have others as outside. A stored table."""
    points = points.select("cell", "node", *value)
    marked = store(points.join(labels, "node", "left").select("cell", "node", *value, F.coalesce("component", "node").alias("label")))
    counts = marked.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell")
    main = counts.agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).select("cell", F.col("most.label").alias("main"), (F.col("n") - F.col("most.n")).alias("outside"))
    rest = store(marked.join(main.where("outside > 0"), "cell"))
    discard(marked)
    return rest


def apart(rest: DataFrame, value: list[str], band: Column | None = None, reach: int = 0, front: Column | None = None) -> DataFrame:
    """Pairs of a cell's members that no label has joined, of a table unsettled() returned, in the columns of stars().

    Of each cell, members outside its most frequent component meet all others: near copies, which their leaders have
    joined, are not held against one another again. band: a number of which pairs that matter differ by `reach` at most.
    front: whether a point is one of those of which a pair that matters has one at least.
    """
    band, front = F.lit(0) if band is None else band, F.lit(True) if front is None else front
    rest = rest.withColumns({"band": band, "front": front})
    few = rest.where("label <> main").withColumn("band", F.explode(F.array(*[F.col("band") + k for k in range(-reach, reach + 1)])))
    few = few.withColumn("front", F.explode(F.when(F.col("front"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    few = few.select("cell", "band", "front", F.struct("node", *value).alias("x"), F.col("label").alias("x_label"))
    pairs = rest.join(few, ["cell", "band", "front"]).where((F.col("label") != F.col("x_label")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("x.node"))))
    return pairs.select("node", *value, "x")


def crowded(points: DataFrame, front: Column | None = None) -> DataFrame:
    """Points whose cell has another one, and one in front, as a stored table."""
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.lit(True) if front is None else front).alias("front")).where("n > 1 AND front")
    return store(points.join(cells.select("cell"), "cell", "left_semi"))


def near_links(nodes: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """nodes: fp (distinct), node. Links u, v of nodes whose fingerprints differ in `most` bits at most, enough to join all that are joined."""
    masks = F.array(*[F.struct(F.lit(k).alias("grid"), F.lit(m).alias("mask")) for k, m in enumerate(grid_masks(grid_groups(nodes.count()), most))])
    points = nodes.withColumn("g", F.explode(masks)).select("fp", "node", F.xxhash64("g.grid", popcounts(F.col("fp")).bitwiseAND(F.col("g.mask"))).alias("cell"))
    points = crowded(points)

    def near(pairs: DataFrame) -> DataFrame:
        bound = manhattan(popcounts(F.col("fp")), popcounts(F.col("x.fp"))) <= most
        exact = F.bit_count(F.col("fp").bitwiseXOR(F.col("x.fp"))) <= most
        return pairs.where(bound).where(exact).select(F.least("node", "x.node").alias("u"), F.greatest("node", "x.node").alias("v")).distinct()

    first = components(near(stars(points, ["fp"])))
    left = unsettled(points, first, ["fp"])
    found = store(near(apart(left, ["fp"])))
    discard(points, left)
    return first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MOST_DIFFERING) -> DataFrame:
    """docs needs doc_id, text. Returns doc_id, fp, component: the smallest doc_id reachable over links, a row for each of docs' rows.

    Null and empty texts have fingerprint 0 and are linked like others. A row whose doc_id is null links nothing; its
    component is the one of its fingerprint, or null if all of that one's ids are null. Other columns are left aside.
    """
    marked = store(fingerprints(docs, width).select("doc_id", "fp"))
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"), F.count("*").alias("n")))
    joined = components(near_links(nodes.where("node IS NOT NULL").select("fp", "node"), most))
    # Only fingerprints with company need a row here; others are their own component.
    classes = store(nodes.join(joined, "node", "left").where("n > 1 OR component IS NOT NULL").select("fp", F.coalesce("component", "node").alias("component")))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component"))


# Similar documents: sets of shingles joined exactly, in one scope or in many.

SIMILAR_WIDTH, SIMILARITY = 5, 0.8
#: Bytes of text whose shingles are hashed together.
SET_BYTES = 1 << 20
#: The least count of a common shingle, how many are known at most, and the share of all shingles that are counted (by their hash).
#: They set the order of the shingles, so the number of candidates; any order finds the same links.
COMMON, MOST_COMMON, COUNTED = 16, 300_000, 0.3
#: 64-bit words of a set's parities, and of those that travel with its points.
PARITY_WORDS, FOLDS = 16, ("f0", "f1", "f2", "f3")
#: Leaders that members meet in later rounds, in cells of which more than twice as many are outside the main component.
MORE_LEADERS = (16,)
#: Against rounding in bounds: it lets a candidate more pass, never one less.
SLACK = 1e-9


def shingle_sets(texts: list[bytes | None], width: int = SIMILAR_WIDTH) -> list[np.ndarray]:
    """The hashes of each text's different shingles, in order; of the whole sequence where there are fewer words. No word: none."""
    out: list = [np.zeros(0, dtype=np.uint64)] * len(texts)
    short = [k for k, x in enumerate(texts) if len(x or b"") <= LONG_BYTES]
    words = Words([texts[k] for k in short], NO_SPACE)
    hashes = words.hashes()
    every = runs(hashes, width)
    for k, a, b in zip(short, words.first[:-1].tolist(), words.first[1:].tolist()):
        if b > a:
            out[k] = np.unique(every[a : b - width + 1]) if b - a >= width else runs(hashes[a:b], b - a)
    for k in set(range(len(texts))) - set(short):
        found, first, n = [], hashes[:0], 0
        for base, piece, whole in pieces(texts[k], width - 1, NO_SPACE):
            h, n = piece.hashes()[:whole], base + whole
            first = np.concatenate([first, h[len(first) - base :]])[:width] if len(first) < width else first
            found.append(np.unique(runs(h, width)))
        out[k] = np.unique(np.concatenate(found)) if n >= width else runs(first, n) if n else first
    return out


def common_shingles(docs: DataFrame, width: int = SIMILAR_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that are common in all documents, and in how many texts they are: of those that come
    first by hash, COUNTED of all, which prefixes are made of."""
    bound = np.uint64(COUNTED * 2**64)

    def run(batches):
        for batch in batches:
            for _, rows in slices(batch.column("text"), SET_BYTES):
                found, n = np.unique(np.concatenate([x[: np.searchsorted(x, bound)] for x in shingle_sets(rows, width)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["cell", "n"])

    counted = store(docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON))
    # The greatest counts, down to the power of two below which there would be too many.
    sizes = {r["power"]: r["n"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}
    least = min((p for p in sizes if sum(n for q, n in sizes.items() if q >= p) <= MOST_COMMON), default=62)
    got = counted.where(F.col("n") >= 2**least).toArrow()
    discard(counted)
    cells = got["cell"].to_numpy().view(np.uint64)
    order = np.argsort(cells)
    return cells[order], got["n"].to_numpy()[order]


def prefix(shingles: np.ndarray, cells: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """A set's first shingles, by count and hash: so many that two sets of this similarity share one of theirs."""
    n = len(shingles)
    most = n - int(np.ceil(similarity * n - SLACK)) + 1 if n else 0
    rank = np.zeros(n, dtype=np.int64)
    if len(cells):
        at = np.minimum(np.searchsorted(cells, shingles), len(cells) - 1)
        rank = np.where(cells[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[:most]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS cells of the hashes, whether the set has an odd number in it. Sets differ in as many shingles as these in bits, or more."""
    counts = np.bincount((shingles % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits(counts % 2 == 1).view(np.int64)


def prefixes(docs: DataFrame, width: int, similarity: float, scope: str | None = None) -> DataFrame:
    """doc_id, text_hash, node (a hash of the shingle set, equal for equal sets of one scope), n (its size), prefix, parity, a row for each of docs' rows."""
    cells, counts = common_shingles(docs, width)

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text"), SET_BYTES):
                sets = shingle_sets(rows, width)
                scopes = [b"" if x is None else x.to_bytes(8, "little", signed=True) for x in batch.column("scope").slice(first, len(rows)).to_pylist()]
                salts = [np.uint64(xxhash.xxh3_64_intdigest(x, SEED) if x else 0) for x in scopes]
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes() + scope, SEED) for x, scope in zip(sets, scopes)], dtype=np.uint64).view(np.int64)
                first_ones = pa.array([(prefix(x, cells, counts, similarity) ^ salt).view(np.int64) for x, salt in zip(sets, salts)], pa.list_(pa.int64()))
                same = [batch.column(c).slice(first, len(rows)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(node), pa.array([len(x) for x in sets], pa.int32()), first_ones, pa.array([parities(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "n", "prefix", "parity"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), (F.col(scope) if scope else F.lit(None)).cast("long").alias("scope"))
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, n int, prefix array<long>, parity array<long>")


def most_differing(similarity: float, total: Column) -> Column:
    """In how many shingles two sets of this similarity and this size in all can differ."""
    return (1 - similarity) / (1 + similarity) * total + SLACK


def folded() -> list[Column]:
    """The parities of a node in fewer cells: an exclusive or of words is the parity of their cells together."""
    words = [F.col("parity")[k] for k in range(PARITY_WORDS)]
    return [reduce(lambda p, q: p.bitwiseXOR(q), words[k :: len(FOLDS)]).alias(w) for k, w in enumerate(FOLDS)]


def allowed(similarity: float) -> Column:
    """Whether sizes, places of the shared shingle if it is the first one, and folded parities let a pair of stars() have the similarity."""
    size, other = F.col("size"), F.col("x.size")
    shared, total = F.least(size - F.col("pos"), other - F.col("x.pos")), size + other
    sizes = (F.least(size, other) + SLACK >= similarity * F.greatest(size, other)) & (shared + SLACK >= similarity / (1 + similarity) * total)
    differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"x.{w}"))) for w in FOLDS), F.lit(0))
    return sizes & (differing <= most_differing(similarity, total))


def candidates(pairs: DataFrame, similarity: float) -> DataFrame:
    """u, v of the pairs that the bounds allow, once each; u < v."""
    return pairs.where(allowed(similarity)).select(F.least("node", "x.node").alias("u"), F.greatest("node", "x.node").alias("v")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v) whose shingle sets have the similarity: sets are made again from the texts, where parities allow it."""

    def make(batches):
        for batch in batches:
            for first, rows in slices(batch.column("text"), SET_BYTES):
                sets = pa.array([x.view(np.int64) for x in shingle_sets(rows, width)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(rows)), sets], ["node", "shingles"])

    sides = [nodes.select(F.col("node").alias(e), F.col("n").alias(a), F.col("parity").alias(p)) for e, a, p in ("uax", "vby")]
    differing = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    near = pairs.join(sides[0], "u").join(sides[1], "v").where(differing <= most_differing(similarity, F.col("a") + F.col("b")))
    pairs = store(near.select("u", "v", "a", "b"))
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    needed = store(nodes.join(needed, "node", "left_semi").select("node", "row.doc_id", "row.text_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text")
    sets = store(texts.mapInArrow(make, "node long, shingles array<long>"))
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    both = F.size(F.array_intersect("x", "y"))
    out = store(met.where(both / (F.col("a") + F.col("b") - both) >= similarity).select("u", "v"))
    discard(pairs, needed, sets)
    return out


def similar_links(nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: links of nodes, enough to join all that verified ones join.

    Two sets of the similarity share a shingle of their prefixes, so all meet in a cell. First each cell's members are held
    against its leaders; in cells where this leaves many apart, against more leaders; then those that this has not joined
    against the others. Sizes that the similarity allows are in the same band of sizes or in the next.
    """
    value = ["size", "pos", *FOLDS]
    # Of two sets of the similarity, the smaller one has the first shared shingle among its first ones: it leaves room for what they share.
    front = F.col("size") - F.col("pos") + SLACK >= 2 * similarity / (1 + similarity) * F.col("size")
    points = crowded(nodes.where("row IS NOT NULL").select("node", F.col("n").alias("size"), *folded(), F.posexplode("prefix").alias("pos", "cell")), front)
    met = store(candidates(stars(points, value), similarity))
    links = verified(met, nodes, docs, width, similarity)
    for leaders in MORE_LEADERS:
        labels = components(links)
        joined = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        rest = unsettled(points, labels, value)
        discard(points, links)
        points, wide = rest, rest.where(F.col("outside") > 2 * leaders)
        more = stars(wide, [*value, "label"], leaders, LEADERS).where(F.col("label") != F.col("x.label"))
        more = store(candidates(more, similarity).join(met, ["u", "v"], "left_anti"))
        links = store(joined) if more.isEmpty() else store(joined.unionByName(verified(more, nodes, docs, width, similarity)))
        seen, met = met, store(met.unionByName(more))
        discard(seen, more)
    labels = components(links)
    rest = unsettled(points, labels, value)
    band = F.floor(F.log(F.col("size")) / F.lit(-np.log(similarity)) + F.lit(SLACK)).cast("int")
    left = store(candidates(apart(rest, value, band, 1, front), similarity).join(met, ["u", "v"], "left_anti"))
    discard(points, rest, met, links)
    joined = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return joined if left.isEmpty() else joined.unionByName(verified(left, nodes, docs, width, similarity))


def similar_documents(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, scope: str | None = None) -> DataFrame:
    """docs needs doc_id, text. Returns doc_id, component (the smallest doc_id reachable over links of similar texts), text_hash, class.

    class is equal for all rows of a group, and only for them, even where texts of two groups repeat a doc_id.

    Texts are similar if the sets of their shingles (as 64-bit hashes) have this Jaccard similarity or more: all such pairs
    are found, and each link is counted out on the sets. Equal sets count once. Null and empty texts are one group; a row
    with a null doc_id links nothing, and its component is its set's, or null. Other columns are left aside.
    scope: a column of longs; rows of two scopes are not held against one another.
    """
    marked = store(prefixes(docs, width, similarity, scope))
    row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("row")
    nodes = store(marked.groupBy("node").agg(row, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")))
    rows = store(marked.select("doc_id", "text_hash", "node"))
    discard(marked)
    joined = components(similar_links(nodes, docs, width, similarity)).withColumnRenamed("component", "class")
    joined = joined.unionByName(joined.select(F.col("class").alias("node"), "class")).distinct()  # with the smallest node of each
    classes = nodes.join(joined, "node", "left").where("copies > 1 OR class IS NOT NULL")
    classes = store(classes.select("node", F.col("row.doc_id").cast("long").alias("least"), F.coalesce("class", "node").alias("class")))
    discard(nodes)
    least = classes.groupBy("class").agg(F.min("least").alias("component"))
    found = rows.join(classes.join(least, "class").select("node", "class", "component"), "node", "left")
    return found.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "text_hash", F.coalesce("class", "node").alias("class"))


def near_copies(docs: DataFrame, most: int = MOST_DIFFERING, similarity: float = SIMILARITY) -> DataFrame:
    """docs needs doc_id, text. Returns text_hash, doc_id, fp_class, class, for each different row of those whose doc_id is not null.

    Fingerprints that differ in `most` bits at most link rows, as in near_duplicates(); fp_class is equal for all rows that
    they join. Texts can share a fingerprint by a line that each repeats often, so what is joined is checked exactly: rows
    are copies if (fp_class, class) is equal, that is if their fingerprints are joined and links of similar_documents(), of
    texts in the same fp_class, join their texts. A class that has one text alone needs no check: its class is null.
    """
    marked = store(fingerprints(docs.where("doc_id IS NOT NULL")))
    nodes = store(marked.select("fp", F.col("fp").alias("node")).distinct())
    joined = components(near_links(nodes, most)).withColumnRenamed("node", "fp")
    rows = store(marked.distinct().join(joined, "fp", "left").select("doc_id", "text_hash", F.coalesce("component", "fp").alias("fp_class")))
    discard(marked, nodes)
    texts = rows.groupBy("fp_class", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    mixed = rows.groupBy("fp_class").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("fp_class")
    texts = store(texts.join(mixed, "fp_class", "left_semi"))
    # One row of each text: copies of it are not read again.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    read = store(keyed.join(texts, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", "fp_class"))
    classes = similar_documents(read, similarity=similarity, scope="fp_class").select("text_hash", "class")
    out = store(rows.join(classes.distinct(), "text_hash", "left"))
    discard(rows, texts, read)
    return out
