"""op1, op2, op3 against brute force and round trips; op4, op6, op8 on held-out rows; the pipeline."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ann, chat, langid, quality, toxicity, warc
from graphloom.llm.common import bounded_sample, fold

DATA = "/root/testdata/sf0.1"


# Nearest by inner product.


def brute_nearest(rows, k=20):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-float((x * q).sum()), j) for j, x in usable if j != i and len(x) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("shard", [ann.SHARD_ROWS, 200])
def test_nearest_has_the_brute_force_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD_ROWS", shard)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=16).astype(np.float32).astype(float).tolist()) for k in range(900)]
    same = rng.normal(size=16).astype(np.float32).astype(float).tolist()
    rows += [(1000 + k, same) for k in range(300)]  # many equal vectors: ties go by id
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [1.0, None] + [0.0] * 14), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (None, same), (2100, []), (2120, [1.0, 2.0]), (2121, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {}
    for r in ann.nearest(frame.unionByName(frame.limit(5))).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert set(got) == {i for i, v in want.items() if v}
    hits = total = 0
    for i, best in want.items():
        mine = [(j, s) for _, j, s in sorted(got.get(i, []))]
        assert [r for r, _, _ in sorted(got.get(i, []))] == list(range(1, len(best) + 1))
        assert all(mine[k][1] >= mine[k + 1][1] for k in range(len(mine) - 1))
        hits, total = hits + len({j for j, _ in mine} & {j for j, _ in best}), total + len(best)
    assert hits / total >= 0.98
    assert [j for _, j, _ in sorted(got[1000])] == list(range(1001, 1021)) and [j for _, j, _ in sorted(got[1020])][:3] == [1000, 1001, 1002]
    assert ann.nearest(frame.limit(0)).count() == 0


def test_chi_square_and_the_stopping_test():
    assert ann.chi_square_cdf(np.array([0.0, 15.507]), 8) == pytest.approx([0, 0.95], abs=1e-4)
    points = np.random.default_rng(3).normal(size=(5000, 4))
    leaves = ann.kd_leaves(points, 64)
    assert sorted(np.concatenate(leaves)) == list(range(5000)) and max(map(len, leaves)) <= 64
    clusters = np.repeat(np.random.default_rng(4).normal(size=(50, 32)) * 5, 100, axis=0) + np.random.default_rng(5).normal(size=(5000, 32)) * 0.1
    index = ann.Index(np.arange(5000), clusters, 20, 8, 1)
    seen = []
    original = index.sorted
    index.sorted = type("Counted", (), {"__getitem__": lambda self, k: seen.append(k.stop - k.start) or original[k]})()
    index.search(clusters[:1], np.array([0]), 20, 0.99)
    assert sum(seen) < 2500  # with clusters, the test stops long before all points


# Chats.

NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "<", "|", "a<", "", None, "\n", "<|", "line\n<|im_end|>\n", "<\\", "é𝄞" * 3]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_come_back_from_what_was_written(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "x\\n", "<|im_start|>", None]), rng.choice(NASTY)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, 1, "user", "lost"), (None, None, "assistant", "found"), (99, 0, "user", "y" * 2_000_000)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]  # one conversation holds most rows
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_log(chat.log_of(frame))).collect()}
    assert got == brute_chat(rows)
    assert chat.read_back(chat.format_log(chat.log_of(frame.limit(0)))).count() == 0


def test_escapes_leave_no_control_string():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\a\n>") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        piece, a, b = chat.render("assistant", text)
        assert chat.parse(piece)[:2] == ("assistant", text) and chat.unescape(piece[a:b]) == text
        assert chat.parse(chat.render(text, "x")[0])[:2] == (text, "x")


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "Hel"), (1, 1, 3, "delta", "assistant", "lo"), (1, 2, 4, "message", "user", "more"), (1, 3, 5, "delta", "assistant", "old answer"),
        (1, 1, 6, "regenerate", "assistant", "Good "), (1, 1, 7, "delta", "assistant", "day"), (1, 2, 8, "message", "user", "again"), (1, 2, 9, "edit", "user", "edited"), (1, 2, 10, "delta", "user", "!"),
        (2, 0, 1, "edit", "user", "from nothing"), (2, 1, 2, "message", "assistant", "a"), (2, 1, 3, "message", "assistant", "b"), (2, 0, 4, "regenerate", "user", "anew"),
    ]
    random.Random(3).shuffle(log)
    frame = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    pieces = chat.format_log(frame).orderBy("conv_id", "piece").collect()
    assert [(p["conv_id"], *chat.parse(p["text"])[:2]) for p in pieces] == [(1, "user", "hi"), (1, "assistant", "Good day"), (1, "user", "edited!"), (2, "user", "anew")]


# WARC.


def test_archives_hold_every_page(spark):
    rng = random.Random(4)
    rows = [(1, "http://a\r\nX: y", None), (2, None, ""), (3, "u", "x" * 3_000_000), (0, "u", "x" * 3_000_000), (7, "u", "é" * 5), (7, "u", "é" * 5), (9, "u", "é" * 5), (None, "u", "only"), (None, "u", "é" * 5), (12, "u", "\r\n\r\n")]
    rows += [(13, "u", "".join(chr(rng.randrange(32, 3000)) for _ in range(700_000))), *[(100 + k, "u", f"p{k % 37}\r\n\r\n") for k in range(300)]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("chunk", F.lit(1))
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, h in payloads:
        if p is not None:
            first[h] = min(first.get(h, p), p)
    revisits = lambda p, h: h in first and first[h] != p
    want = [(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisits(p, h) else "response", first[h] if revisits(p, h) else None) for p, h in payloads]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.archive_pages(frame).collect())
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_chunks_carry_payload_and_digest(spark, tmp_path):
    text = "abc" * 1_000_000
    frame = spark.createDataFrame([(1, "u", text), (2, "u", text), (3, "u", "small")], "page_id long, url string, html string")
    entries = warc.write_archives(warc.chunked(warc.plan_records(frame, least=10)), f"file://{tmp_path}")
    chunks = warc.read_chunks(entries, f"file://{tmp_path}").orderBy("page_id", "chunk").collect()
    parts = [r for r in chunks if r["page_id"] == 1]
    assert b"".join(bytes(r["data"]) for r in parts) == text.encode() and len(parts) == 3 and [r["last"] for r in parts] == [False, False, True]
    assert parts[0]["digest"] == base64.b32encode(hashlib.sha1(text.encode()[: warc.CHUNK_BYTES]).digest()).decode()
    assert {r["page_id"]: r["record_type"] for r in chunks} == {1: "response", 2: "revisit", 3: "response"}


# Classifiers.


def accuracy(found, truth, column):
    joined = found.join(truth, "doc_id").where("held_out")
    n, right, ones, hit = joined.agg(F.count("*"), F.sum((F.col(column) == F.col("want")).cast("int")), F.sum(F.col("want").cast("int")), F.sum((F.col(column) * F.col("want")).cast("int"))).first()
    return n, right / n, hit / max(1, ones)


def odd_documents(spark):
    rows = [(900_001, None, "en"), (900_002, "", None), (900_003, "12 34 !!", "de"), (None, "the and of", "en"), (900_005, "word " * 600_000, "en"), (900_006, "twice", "fr"), (900_006, "twice", "fr"), (900_007, "\x00�", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("label", F.lit("x")).withColumn("predicted", F.lit(2))


def test_toxicity_learns_in_a_task_and_not_in_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the matrix is in the driver")

    for name in ("logistic", "calibrated"):
        monkeypatch.setattr(toxicity, name, refuse)
    rows = [(k, f"you vile rat number {k}" if k % 4 == 0 else f"a kind note number {k}", int(k % 4 == 0)) for k in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(7)
    got = toxicity.scored(made.select("doc_id", "text"), made.select("doc_id", "toxic")).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {k: y for k, _, y in rows}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    n, right, recall = accuracy(toxicity.scored(docs, labels), labels.select("doc_id", F.col("toxic").alias("want")), "predicted")
    assert n > 500 and right > 0.95 and recall > 0.75


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    n, right, _ = accuracy(quality.scored(docs, labels), labels.select("doc_id", F.col("quality").alias("want")), "predicted")
    assert n > 500 and right > 0.97


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.identified(docs).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").where("held_out")
    assert found.where("lang_pred = want").count() / found.count() > 0.98


@pytest.mark.parametrize("labelled", [True, False])
def test_classifiers_take_odd_rows(spark, labelled):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(900_002, 1, 0), (900_005, 0, 1), (900_006, None, None), (None, 1, 1), (5, 1, 1), (900_006, 1, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    for found in (toxicity.scored(docs, labels), quality.scored(docs, labels)):
        rows = found.collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 0 for d in (900_001, 900_002, 900_003, None, 900_005, 900_006, 900_007)}
    assert toxicity.scored(docs.limit(0), labels).count() == 0 and quality.scored(docs.limit(0), labels).count() == 0


def test_languages_of_odd_rows(spark):
    got = langid.identified(odd_documents(spark)).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got if r["doc_id"] in (900_001, 900_002, 900_003, 900_007)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.identified(odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identified(odd_documents(spark).limit(0)).count() == 0


def test_statistics_do_not_depend_on_the_length_of_pieces(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["word", "WORD", "a", "http://x", "Tail.", "y" * 300, "l\nm", " ", "same same"]) for _ in range(800)).encode(), b"z" * 5000, b" \n" * 700, b"\r\nline" * 300]
    whole = [quality.statistics(x) for x in texts]
    assert whole[0][0] > 8 and quality.statistics(None) == quality.statistics(b"")
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        assert [quality.statistics(x) for x in texts] == whole


def test_every_language_is_learned(spark):
    alphabet = [chr(0x4E00 + 7 * k) + chr(0x4E03 + 7 * k) for k in range(300)]
    rows = [(1000 * k + n, alphabet[k] * 40, f"l{k}") for k in range(300) for n in range(2)]
    network = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(network.languages) > 256


def test_label_model_finds_accuracies_and_discounts_echoes():
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.2
    fire = lambda hit, miss: np.where(truth, rng.random(4000) < hit, rng.random(4000) < miss).astype(np.int8)
    good, weak = fire(0.7, 0.02), fire(0.4, 0.2)
    votes = np.column_stack([good, weak, weak, weak, fire(0.6, 0.05), np.where(rng.random(4000) < 0.5, -(~truth).astype(np.int8), 0)])
    gold = np.where(rng.random(4000) < 0.1, truth, np.nan)
    model = toxicity.LabelModel()
    p = model.fit(votes, gold)
    assert ((p > 0.5) == truth).mean() > 0.93
    assert model.accuracy[0] > model.accuracy[4] > model.accuracy[1]
    assert model.correlation[1, 2] > 0.9 and model.correlation[0, 4] < 0.2


def test_trees_are_walked_as_they_were_grown():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = quality.boost(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    for row in x[:20]:
        z = trees.start
        for t in range(len(trees.feature)):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[trees.feature[t, at]] > trees.threshold[t, at] else 1)
            z += trees.value[t, at - (2**quality.DEPTH - 1)]
        assert trees.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_gradients_of_the_network():
    network = langid.Network(["a", "b"], 3)
    x = np.random.default_rng(8).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1])
    loss = lambda: -np.log(network.forward(x)[0][np.arange(4), y]).mean()
    grads = network._gradients(x, y)
    for name in ("filters", "out", "embed", "bias"):
        weights = getattr(network, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), weights.shape)
        keep, step = weights[at], 1e-2
        weights[at] = keep + step
        up = loss()
        weights[at] = keep - step
        down = loss()
        weights[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=0.1)


def test_bounded_sample_is_bounded_and_the_same_again(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    once = {r[0] for r in bounded_sample(df, "doc_id", 500).collect()}
    assert 350 < len(once) <= 750 and once == {r[0] for r in bounded_sample(df.repartition(5), "doc_id", 500).collect()}
    assert df.where(fold("doc_id", 5) == 0).count() == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(20_000))


# The pipeline.


def test_pipeline_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(9)
    clean = " ".join(f"w{rng.randrange(3000)}" for _ in range(400))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    planted = [(10_001, clean, "en", "src1", len(clean)), (10_002, clean, "en", "src2", len(clean)), (10_003, clean.replace("w1 ", "w1x ", 1), "en", "src3", len(clean)), (10_004, f"{' '.join(clean.split()[::-1])} {bench}", "en", "src1", 9), (10_005, None, "en", None, 0), (None, "no id, clean", "en", "src1", 12)]
    current = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in current.select("doc_id").collect()}
    assert {10_001, 10_004, 10_005, None} <= seen["toxicity"]
    assert 10_001 in seen["near_duplicates"] and not {10_002, 10_003} & seen["near_duplicates"] and None in seen["near_duplicates"]
    assert 10_001 in seen["decontamination"] and 10_004 not in seen["decontamination"]
    assert seen["sharding"] == seen["mixing"] and {"shard", "slot"} <= set(current.columns)
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert run.count() > 0 and run.select("shard", "slot").distinct().count() == run.count()


def test_stages_take_clashing_columns_odd_rows_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    clash = ["score", "predicted", "held_out", "shard", "slot", "component", "label", "size", "first", "h", "spans", "n_words", "uses", "token", "cell"]
    rows = [(k, f"some clean text number {k} with words", "en", ["a", "b", None][k % 3], 9) for k in range(40)] + [(None, None, None, None, None), (50, "", "en", "a", 0), (51, None, "en", "b", None), (52, "long " * 300_000, "en", "a", 1), (3, "some clean text number 3 with words", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in clash:
        docs = docs.withColumn(c, F.lit("clash"))
    current, empty = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, sf)
        assert stage(spark, empty, sf).count() == 0
        assert current.count() > 30 and set(docs.columns) <= set(current.columns)
        if name != "sharding":
            assert current.columns == docs.columns
            current = spark.createDataFrame(current.collect(), docs.schema)
