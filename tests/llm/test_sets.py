"""op5, op7, op9, op10 against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import components as module_of_components
from graphloom.llm import decontaminate, mixing, sharding, simhash
from graphloom.llm.components import components
from graphloom.llm.wordhash import PIECE_BYTES, Words, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, shard string, fp string"


def docs(spark, rows):
    """rows: (doc_id, text, source); columns with clashing names come along."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", "y", "z", "w") for d, t, s in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[k : k + 3]), 42) for k in range(max(1, len(found) - 2))]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprints_and_components_are_the_brute_force_ones(spark):
    base = words(300, 1)
    rows = [(k, " ".join(words(60, k)), "a") for k in range(40)]
    rows += [(100 + k // 4, " ".join(base[:k] + ["X"] + base[k + 1 :]), "a") for k in range(0, 120, 4)]
    rows += [(200, "one", "a"), (201, "one two", "b"), (202, "ÉA  b c\tÉa", "b"), (203, "", "b"), (204, None, "b"), (205, " \n", "b"), (206, "a b", "c"), (207, "A\x0bB", "c"), (208, "x " * 700_000, "c"), (7, " ".join(words(60, 7)), "a")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {d: brute_fingerprint(t) for d, t, _ in rows}
    want = brute_components(fps)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps
    assert {r["doc_id"]: r["component"] for r in got} == want
    assert want[204] == want[205] == 203 and want[207] == 206


def test_similar_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEADERS", 1)
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(words(200, 3000 + k)), "a") for k in range(60)]
    for k in range(40):  # copies with a few words changed, and with many
        for copy, changes in ((1000, 2), (2000, 40)):
            text = rows[k][1].split()
            for at in rng.choice(200, changes, replace=False):
                text[at] = f"new{rng.integers(10**6)}"
            rows.append((copy + k, " ".join(text), "b"))
    rows += [(3000, "few words", "a"), (3001, "Few  words", "b"), (3002, None, "a"), (3003, "", "a"), (3004, rows[50][1].upper(), "c"), (None, rows[51][1], "c"), (None, "lost", "c"), (3005, "x " * 600_000, "a")]
    got = {}
    for r in simhash.similar_documents(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r["component"])
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[1000 + k] == [k] for k in range(40)) and all(got[2000 + k] == [2000 + k] for k in range(40))
    assert got[3001] == got[3000] == [3000] and got[3003] == [3002] and got[3004] == [50] and sorted(got[None], key=str) == [51, None]
    assert simhash.similar_documents(docs(spark, []).limit(0)).count() == 0


def test_a_repeated_line_does_not_make_texts_similar(spark):
    rows = []
    for n in (1, 5, 11):
        line = " ".join(f"line{k}" for k in range(n))
        rows += [(10 * n + k, " ".join([line] * 80 + words(200, 100 * n + k, 10**6)), "a") for k in range(2)]
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    assert got == {d: d for d, _, _ in rows}


def brute_similar(rows):
    sets = {}
    for d, text, _ in rows:
        w = text.lower().split()
        sets[d] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids, group = sorted(sets), {d: d for d in sets}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def test_folded_parities_never_exceed_the_difference(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 30, 400, 5000)]
    sets += [np.unique(np.concatenate([x[: len(x) * 4 // 5], rng.integers(0, 2**63, 9).astype(np.uint64)])) for x in sets]
    table = spark.createDataFrame([(k, simhash.parities(x).tolist()) for k, x in enumerate(sets)], "node long, parity array<long>")
    points = {r["node"]: [r[w] for w in simhash.FOLDS] for r in table.select("node", *simhash.folded()).collect()}
    for a in range(len(sets)):
        for b in range(len(sets)):
            least = sum(((p ^ q) % 2**64).bit_count() for p, q in zip(points[a], points[b]))
            assert least <= len(np.setxor1d(sets[a], sets[b])) and (least > 0) == (a != b)


@pytest.mark.parametrize("common", [10, 2])
def test_links_are_those_of_similarity_0_8_exactly(spark, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    monkeypatch.setattr(simhash, "MORE_LEADERS", (1, 2))
    rows = []
    for n in range(5, 13):  # one word more: 4 of 5 shingles for 8 and 9 words
        text = [f"t{n}_{k}" for k in range(n)]
        rows += [(100 * n, " ".join(text), "a"), (100 * n + 1, " ".join([*text, "more"]), "a")]
    for k in range(30):  # 204 words: the last 14 to 43 differ
        text = words(204, 7000 + k, 10**6)
        rows += [(10_000 + 2 * k, " ".join(text), "a"), (10_001 + 2 * k, " ".join(text[: 190 - k] + words(14 + k, 8000 + k, 10**6)), "a")]
    base = words(100, 9, 10**6)
    for k in range(60):  # copies of one text that are similar to it and not all to one another
        rows.append((20_000 + k, " ".join(base[: 3 * k % 90] + [f"own{k}"] + base[3 * k % 90 + 1 :][: 99 - k]), "b"))
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    want = brute_similar(rows)
    assert got == want
    assert want[801] == 800 and want[701] == 701 and 0 < sum(want[10_001 + 2 * k] == 10_000 + 2 * k for k in range(30)) < 30


def test_similar_sets_share_a_cell_whatever_their_smallest_shingles():
    a, b = (np.unique(np.concatenate([np.arange(first, first + 4), np.arange(100, 136)]).astype(np.uint64)) for first in (0, 10))
    assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 and not set(a[:4]) & set(b[:4])
    for common in ([], [120, 121]):
        x, y = (simhash.prefix(z, np.array(common, dtype=np.uint64), np.arange(10, 10 + len(common))) for z in (a, b))
        assert set(x) & set(y)


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 3000):
        a, b = (np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for _ in range(2))
        x, y = (simhash.parities(z).view(np.uint64) for z in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = (" ".join(words(5000, 3)) + "\n" + "y" * 4000 + " tail").encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 97)
    assert simhash.fingerprint(text) == whole


def test_dense_cells_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEADERS", 1)
    fps = [(1 << a) | (1 << b) for a in range(0, 40) for b in range(a)]  # all within 4 bits of one another
    fps += [(0xFFFF << 40) | (1 << a) for a in range(8)]
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    got = {r["node"]: r["component"] for r in components(simhash.near_links(nodes)).collect()}
    want = brute_components({k: f % 2**64 for k, f in enumerate(fps)})
    assert {k: got.get(k, k) for k in want} == want


def test_the_popcount_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63, (300, 2))]
    df = spark.createDataFrame(pairs, "a long, b long")
    out = df.select("a", "b", simhash.manhattan(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b"))).alias("d")).collect()
    for r in out:
        p, q = ([bin((x % 2**64) >> (2 * s) & 3).count("1") for s in range(32)] for x in (r["a"], r["b"]))
        assert r["d"] == sum(abs(x - y) for x, y in zip(p, q)) <= bin((r["a"] ^ r["b"]) % 2**64).count("1")


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1000, 1200)] + [(5, k) for k in range(6, 300)] + [(9000, 9000), (1, 2), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {**{k: 1000 for k in range(1001, 1201)}, **{k: 5 for k in range(6, 300)}, 2: 1}
    assert {k: c for k, c in got.items() if k != c} == linked


@pytest.mark.parametrize("most", [1 << 19, 300, 7])
def test_components_of_links_in_one_task_and_in_many(spark, monkeypatch, most):
    monkeypatch.setattr(module_of_components, "TASK_LINKS", most)
    rng = np.random.default_rng(most)
    ids = rng.choice(2**62, 1500, replace=False) - 2**61
    links = [(ids[a], ids[b]) for a, b in rng.integers(0, 500, (300, 2))]  # trees and cycles
    links += list(zip(ids[500:800], ids[501:801]))  # a chain of ids in no order
    links += [(ids[900], x) for x in ids[901:1100]] + [(ids[1100], ids[1101])] * 50  # a hub, repeats
    links += list(zip(sorted(ids[1200:1400])[1:], sorted(ids[1200:1400])))  # a chain in order
    links = [(int(a), int(b)) for a, b in links]
    label = {x: x for link in links for x in link}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, y) for x, y in label.items() if x != y)


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(2000)], "u long, v long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        got = components(links)
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.where("component = 0").count() == got.count() == 2000
    assert len(jobs) <= 5


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert decontaminate.passages(none, bench).count() == 0
    assert sharding.shard_documents(none).count() == 0


def brute_targets(sizes):
    """Weights 5, 2, 1 by source in order; shares of all words, held at three times a source's words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        total = sum(weight[s] for s in order if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / total for s in order}
        over = {s for s in order if s not in held and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        held |= over


@pytest.mark.parametrize("names", [["a", "b", "c", "d"], [None, "é", "z", "Z", "", "q"]])
def test_mix_meets_its_targets(spark, names):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(words(int(rng.integers(0, 120)), k)), names[min(int(rng.exponential(1.2)), len(names) - 1)]) for k in range(900)]
    rows += [(1000, None, names[0]), (1001, "", names[1]), (None, "lone words here", names[0]), (5, "again again", names[0]), (5, "again again", names[0])]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len(WORD.findall(t or ""))) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03, abs=8)
    again = mixing.mix(frame.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_of_documents_takes_the_same_words(spark):
    rows = [(k, "  ".join(words(50 + k, k)) + "\n", ["a", "b", "c"][k % 3]) for k in range(300)] + [(400, "", "a"), (401, None, "b"), (7, "x y", "a"), (7, "x y", "a")]
    frame = docs(spark, rows)
    out = mixing.mix_documents(frame)
    assert out.columns == frame.columns
    got, want = {}, {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mix(frame).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == {k: v for k, v in want.items() if v}


def test_mix_of_documents_keeps_sources_apart(spark):
    same = " ".join(words(40, 1))
    rows = [(1, same, "a"), (1, same, "b"), (1, same, "b"), (None, same, "a"), (None, same, None)] + [(10 + k, " ".join(words(30 + k, k)), "abc"[k % 3]) for k in range(60)]
    frame = docs(spark, rows)
    want = {}
    for r in mixing.mix(frame).collect():
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    first = None
    for parts in (1, 5):
        out = [(r["doc_id"], r["source"], r["lang"], r["text"]) for r in mixing.mix_documents(frame.repartition(parts, "text")).collect()]
        got = {}
        for d, s, _, t in out:
            got[d, s] = got.get((d, s), 0) + len(t.split())
        assert got == {k: v for k, v in want.items() if v}
        assert first is None or sorted(out, key=str) == first
        first = sorted(out, key=str)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 256, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5), 9)).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_passages(rows, items):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for d, text, _ in rows:
        w, hit, found = bench_words(text), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= {str(i) for i in ids if i is not None}
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def passage_case():
    items = [(k, " ".join(words(14 + k, 500 + k, 50))) for k in range(12)] + [(90, "Only-THREE words"), (91, "ünï"), (92, ""), (93, None), (94, " ".join(words(14, 500, 50))), (None, "no id at all here"), (95, "w1 w1"), (100, "the end of it all comes now as we said before")]
    rows = [(k, " ".join(words(300, k, 50)), "a") for k in range(30)]
    rows += [(200 + k, " ".join(words(40, 900 + k)) + " " + (items[k % 12][1]).upper() + ". " + " ".join(words(40, 950 + k)), "a") for k in range(20)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "x only three; words", "a"), (303, "(ünï)", "b"), (304, "w1, w1 w1", "b"), (305, " ".join(items[0][1].split()[:9]), "c"), (306, "no id AT all here", "c"), (307, "zz " * 20 + items[3][1], "c")]
    return rows, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_passages_are_the_brute_force_ones(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows, items = passage_case()
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontaminate.digest(decontaminate.passages(docs(spark, rows), bench))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    assert got == brute_passages(rows, items)


def test_passages_in_a_very_long_text(spark):
    items = [(1, " ".join(words(30, 77)))]
    text = " ".join(words(200_000, 5, 9999)) + " " + items[0][1] + " " + "z" * 3_000_000 + " " + " ".join(words(400_000, 6, 9999)) + " " + items[0][1]
    row = decontaminate.passages(docs(spark, [(1, text, "a"), (1, text, "a")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(row) == 2 and row[0]["n_words"] == len(text.split())
    assert sum(s["b"] - s["a"] for s in row[0]["spans"]) == 60 and len(row[0]["spans"]) == 2


def test_pieces_hold_every_word(monkeypatch):
    text = (" ".join(words(3000, 4)) + " end").encode()
    assert len(text) < PIECE_BYTES
    whole = [Words([text]).text(k, k + 1) for k in range(3001)]
    monkeypatch.setattr("graphloom.llm.wordhash.PIECE_BYTES", 101)
    for overlap in (0, 9):
        seen = {}
        for base, w, n in pieces(text, overlap):
            for k in range(n):
                assert seen.setdefault(base + k, w.text(k, k + 1)) == w.text(k, k + 1)
        assert [seen[k] for k in sorted(seen)] == whole


def test_shards_are_even_gapless_and_whole(spark):
    rows = [(k, "t" * (k % 50) if k % 7 else None, "a") for k in range(5000)] + [(None, "no id", "a"), (3, "twice", "b"), (3, "twice", "b"), (6000, "é", None)]
    frame = docs(spark, rows)
    got = sharding.shard_documents(frame).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, sharding.shard_documents(frame.repartition(11)).collect())) == sorted(map(key, got))
    order = [r["doc_id"] for r in sorted((r for r in got if r["shard"] == 0), key=lambda r: r["slot"]) if r["doc_id"] is not None]
    assert order != sorted(order)
    kept = sharding.shuffle_documents(frame)
    assert set(frame.columns) < set(kept.columns) and kept.count() == len(rows) and kept.schema["shard"].dataType.simpleString() == "int"


def test_fewer_rows_than_shards(spark):
    got = sharding.shard_documents(docs(spark, [(1, "a", "s"), (2, "b", "s")])).collect()
    assert sorted(r["slot"] for r in got) == [0, 0] and len({r["shard"] for r in got}) == 2


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    texts = [" ".join(words(60, 60 + k, 10**6)) for k in range(4)]
    rows = [(1, texts[0], "a"), (1, texts[1], "a"), (1, texts[1], "a"), (2, texts[1] + " more", "b"), (3, texts[2], "b"), (4, texts[3], "b"), (2, texts[3].upper(), "c"), (None, texts[2], "c")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", texts[0]), ("1", texts[1]), ("3", texts[2]), ("2", texts[3].upper()), ("None", texts[2])])


def test_the_pipeline_drops_by_fingerprints_and_checks_what_they_join(spark, monkeypatch):
    base, line = words(300, 31, 10**6), " ".join(words(9, 32))
    rows = [(k, " ".join(base[: 40 * k] + [f"own{k}"] + base[40 * k + 1 :]), "a") for k in range(6)]  # one word of 300 changed
    rows += [(10 + k, " ".join([line] * 80 + words(200, 40 + k, 10**6)), "a") for k in range(3)]  # one fingerprint, texts of their own
    rows += [(20, rows[6][1] + " end", "b"), (21, rows[0][1], "b"), (22, None, "b"), (23, "", "b"), (None, rows[0][1], "c")]
    fps = {d: brute_fingerprint(t) for d, t, _ in rows}
    groups, texts = brute_components({d: f for d, f in fps.items() if d is not None}), {d: t for d, t, _ in rows}
    assert groups[11] == groups[12] == groups[20] == 10
    want = {}
    for d, g in groups.items():  # those of one group of fingerprints alone
        same = [(x, texts[x] or "", "") for x in groups if groups[x] == g]
        want[d] = brute_similar(same)[d]
    used = []
    linked = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a: used.append(a) or linked(*a))
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect()
    assert used and sorted(str(r["doc_id"]) for r in got) == sorted([*(str(d) for d in want if want[d] == d), "None"])
    assert {10, 11, 12} <= {r["doc_id"] for r in got} and not {20, 21, 23} & {r["doc_id"] for r in got}


def test_scopes_are_kept_apart(spark):
    text = " ".join(words(50, 51, 10**6))
    rows = spark.createDataFrame([(1, text, 7), (2, text, 8), (3, text + " more", 8), (4, text + " else", 7)], "doc_id long, text string, scope long")
    assert {r["doc_id"]: r["component"] for r in simhash.similar_documents(rows, scope="scope").collect()} == {1: 1, 4: 1, 2: 2, 3: 2}
