"""Line dedup, scoring, packing, near-dedup, decontamination, page extraction and the pipeline against plain Python."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from test_rows import DOCS, LOW, ODD, SF, WORD, docs_of
from tokenizers import Tokenizer

import corpus_pipeline
from verdictframe.llm import op2_line_dedup, op4_backoff, op5_packing, op7_dart_minhash, op8_suffix, op9_mincut, op10_host_quality, wordhash


def prose(rng, n, size=2000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def joined(rng, words):
    return "".join(w + rng.choice([" ", " ", " ", " ", " ", "\n"]) for w in words).strip()


def brute_runs(rows, min_words):
    """Cut bounds by id: every window of so many words that stands earlier (smaller id, or before it in the text)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        merged = []
        for k in range(len(words) - min_words + 1):
            key = tuple(w for w, _, _ in words[k : k + min_words])
            if key not in seen:
                seen.add(key)
                continue
            start, end = words[k][1], words[k + min_words - 1][2]
            if merged and start <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        out[i] = ",".join(f"{s}-{e}" for s, e in merged)
    return out


def line_fixture():
    rng = random.Random(11)
    passages = [joined(rng, prose(rng, rng.randint(70, 110))) for _ in range(4)]
    texts = []
    for k in range(120):
        bits = [joined(rng, prose(rng, rng.randint(0, 60)))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            bits += [p, joined(rng, prose(rng, rng.randint(0, 60)))]
        texts.append(" ".join(bits).strip())
    texts += texts[5:9] + ["la la " * 100, "é💥 " * 40, "one line\n" * 50]
    return passages, texts


def test_line_dedup_equals_brute_force(spark):
    passages, texts = line_fixture()
    rows = op2_line_dedup.report(docs_of(spark, texts)).collect()
    got = {r["doc_id"]: r["runs"] for r in rows}
    assert got == brute_runs(list(enumerate(texts)), op2_line_dedup.MIN_WORDS)
    left = {r["doc_id"]: " ".join(r["text"].split()) for r in rows}
    for p in passages:
        assert sum(" ".join(p.split()) in x for x in left.values()) <= 1
    assert all(left[124 - 4 + k] == "" for k in range(4) if len(texts[5 + k].split()) > 40)
    for r in rows:
        if not r["runs"]:
            assert r["text"] == texts[r["doc_id"]]


def test_line_dedup_finds_passages_of_21_to_60_words_within_lines(spark):
    rng = random.Random(17)
    texts, want = [], {}
    for k in range(21, 61):
        for _ in range(4):
            p = prose(rng, k, 10**6)
            for copy in range(2):
                left, right = prose(rng, 30, 10**6), prose(rng, 30, 10**6)
                start = len(" ".join(left)) + 1
                want[len(texts)] = f"{start}-{start + len(' '.join(p))}" if copy else ""
                texts.append(" ".join([*left, *p, *right]))
    assert {r["doc_id"]: r["runs"] for r in op2_line_dedup.report(docs_of(spark, texts)).collect()} == want


def test_line_dedup_cuts_only_what_it_reports(spark):
    _, texts = line_fixture()
    for r in op2_line_dedup.report(docs_of(spark, texts)).collect():
        out, at = "", 0
        for run in filter(None, r["runs"].split(",")):
            s, e = map(int, run.split("-"))
            piece = texts[r["doc_id"]][at:s]
            out += piece if at == 0 else piece.lstrip(" \t\n\v\f\r")
            at = e
        rest = texts[r["doc_id"]][at:]
        assert r["text"] == out + (rest if at == 0 else rest.lstrip(" \t\n\v\f\r"))


def test_line_dedup_edges(spark):
    long = joined(random.Random(1), prose(random.Random(1), 60))
    rows = [(None, None, "x"), (None, long, "x"), (3, long, "y"), (3, long, "y"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("n_chars", F.lit(5))
    out = op2_line_dedup.clean(df)
    assert out.columns == df.columns and out.count() == 5
    got = sorted((str(r["doc_id"]), r["text"] is None, (r["text"] or "")[:5]) for r in out.collect())
    assert got == [("3", False, ""), ("3", False, ""), ("4", False, ""), ("None", False, long[:5]), ("None", True, "")]
    assert op2_line_dedup.clean(df.limit(0)).count() == 0


def test_line_dedup_keeps_no_shuffle_files(spark):
    # those of every step used to stay until the driver collected garbage
    def files():
        found, out = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), set()
        while found.hasNext():
            out.add(found.next().getName())
        return {n for n in out if n.startswith("shuffle_")}

    rng = random.Random(3)
    passage = prose(rng, 60)
    df, before = docs_of(spark, [" ".join(prose(rng, 30) + passage + passage + prose(rng, 30)) for _ in range(20)]), files()
    runs = op2_line_dedup.repeated_runs(df)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert runs.count() == 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_line_dedup_sends_few_rows(spark):
    # each window and each fingerprint used to be a row of several shuffles and files
    def records():
        store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() + stages.apply(k).outputRecords() for k in range(stages.size())}

    rng = random.Random(5)
    passages = [prose(rng, 300, 10**6) for _ in range(20)]
    df = docs_of(spark, [" ".join(prose(rng, 30, 10**6) + rng.choice(passages) + prose(rng, 30, 10**6)) for _ in range(200)]).repartition(4).localCheckpoint()
    before = records()
    assert op2_line_dedup.repeated_runs(df).count() == 180
    sent = sum(n for k, n in records().items() if k not in before)
    assert sent < 10_000 < 200 * 281


@pytest.mark.parametrize("block, most", [(1, 10**6), (50, 10), (50, 0), (10**6, 10)])
def test_line_dedup_blocks_and_parts_do_not_matter(block, most, monkeypatch):
    # the same steps in this process: blocks of any size settle the same windows, whatever part they go to
    monkeypatch.setattr(op2_line_dedup, "BLOCK", block)
    rng, n, min_words = random.Random(6), 5, 20
    _, texts = line_fixture()
    texts = [*texts, "a b c " * 9, "la " * 21, " ".join(["x y z"] * 7 + prose(rng, 40) + ["x y z"] * 7), texts[0] + " " + texts[0]]
    texts = [t for t in dict.fromkeys(texts) if len(t.split()) >= min_words]

    def batches(table):
        return iter(table.to_batches(max_chunksize=7))

    def by_part(found, judge):
        t = pa.Table.from_batches(found)
        return pa.concat_tables([judge(t.filter(pc.equal(t["part"], p))) for p in t["part"].unique()])

    ids = pa.array(range(len(texts)), pa.int64())
    whole = pa.Table.from_batches(op2_line_dedup._reader(min_words)(batches(pa.table({"doc_id": ids, "th": ids, "text": texts}))))
    wanted = by_part(op2_line_dedup._print_dealer(n)(batches(whole.select(["th", "prints", "n"]))), op2_line_dedup._print_judge(n, most))
    hot = np.unique(op2_line_dedup._flat(wanted.filter(pc.less(wanted["part"], 0))["prints"], np.uint64))
    assert (len(hot) > 0) == (most <= 10)
    wanted = by_part(wanted.filter(pc.greater_equal(wanted["part"], 0)).to_batches(), op2_line_dedup._gatherer)
    assert len(set(wanted["th"].to_pylist())) == wanted.num_rows
    texts_of = pa.table({"place": wanted["th"], "text": [texts[i] for i in wanted["th"].to_pylist()], "prints": wanted["prints"]})
    texts_of = pa.concat_tables([texts_of, texts_of.slice(0, 20)])  # rows of one id and text
    later = by_part(op2_line_dedup._cutter(min_words, n, hot)(batches(texts_of)), op2_line_dedup._window_judge(n))
    got = {i: [] for i in range(len(texts))}
    for r in by_part(later.to_batches(), op2_line_dedup._grower).to_pylist():
        got[r["place"]].append(f"{r['start']}-{r['stop']}")
    assert {i: ",".join(x) for i, x in got.items()} == brute_runs(list(enumerate(texts)), min_words)


def test_line_dedup_deals_windows_of_a_common_line(spark, monkeypatch):
    # a line in most texts has one fingerprint, whose windows would all go to one part
    monkeypatch.setattr(op2_line_dedup, "HOT", 20)
    monkeypatch.setattr(op2_line_dedup, "PART", 500)
    rng = random.Random(8)
    line, passage = prose(rng, 12), prose(rng, 40)
    texts = [" ".join(prose(rng, 25) + line + prose(rng, 25) + (passage if k % 3 else [])) for k in range(90)]
    assert {r["doc_id"]: r["runs"] for r in op2_line_dedup.report(docs_of(spark, texts)).collect()} == brute_runs(list(enumerate(texts)), op2_line_dedup.MIN_WORDS)
    (_, data, offsets), = wordhash.slices(pa.array(texts))
    common = Counter((op2_line_dedup.Windows(data, offsets).prints()[1] & ~op2_line_dedup.MARK).tolist()).most_common(1)[0][0]
    of = pa.record_batch({"place": pa.array(range(90)), "text": texts, "prints": [common.to_bytes(8, "little")] * 90})
    dealt = []
    for hot in ([], [common]):
        found = [r for b in op2_line_dedup._cutter(20, 50, np.array(hot, np.uint64))(iter([of])) for r in b.to_pylist() if r["part"] < 50]
        dealt.append([len(r["start"]) // 4 for r in found])
    assert len(dealt[0]) == 1 and sum(dealt[1]) == dealt[0][0] and max(dealt[1]) < dealt[0][0] / 10


def test_line_dedup_orders_null_and_negative_ids(spark):
    # a number stands for the text among the windows, in order of id and text
    rng = random.Random(4)
    passage = " ".join(prose(rng, 25))
    rows = [(d, " ".join(prose(rng, 5)) + " " + passage + " " + " ".join(prose(rng, 5))) for d in (5, -7, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in op2_line_dedup.report(df).collect() if r["n_runs"]} == {5, -7, 3}
    assert {r["doc_id"] for r in op2_line_dedup.report(df.where("doc_id is not null")).collect() if r["n_runs"]} == {5, 3}


def test_line_dedup_sends_a_text_once_in_its_row(spark):
    plan = op2_line_dedup.dedup(docs_of(spark, ["a b", "a b"]))._jdf.queryExecution().analyzed().toString()
    rows = [x for x in plan.splitlines() if " AS __l_row" in x]
    assert rows and not any(" AS text#" in x for x in rows)


def test_near_dedup_checks_no_pairs_of_unlinked_copies_outside_blocks(spark, monkeypatch):
    """Copies of one text that differ from each other: their number of checked pairs stays that of bands and members."""
    rng = random.Random(23)
    base, texts = prose(rng, 300, 10**6), []
    for k in range(200):
        own = list(base)
        for at in rng.sample(range(2, 300, 5), 7):
            own[at] = f"own{k}x{at}"
        texts.append(" ".join(own))
    seen, checked = op7_dart_minhash.similar_pairs, []
    monkeypatch.setattr(op7_dart_minhash, "similar_pairs", lambda pairs, *a: (checked.append(pairs.count()), seen(pairs, *a))[1])
    got = {r["class_id"] for r in op7_dart_minhash.report(docs_of(spark, texts)).collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for x in texts)]
    near = [(i, j) for i in range(200) for j in range(i) if 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])]
    root = list(range(200))
    for i, j in near:
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert got == set(root) and sum(checked) < 200 * 32


def brute_backoff(texts, order, alpha=0.4):
    words = [WORD.findall((t or "").translate(LOW)) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [Counter() for _ in range(order + 1)]
    for w in words:
        for n in range(1, order + 1):
            total[n].update(grams(w, n))
    size = sum(map(len, words))
    out = []
    for w in words:
        own = [None] + [grams(w, n) for n in range(1, order + 1)]
        left = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: E731, B023

        def s(i, n):
            if n == 1:
                c = left((w[i],))  # noqa: B023
                return math.log(c / (size - len(w))) if c > 0 else math.log(alpha / (size - len(w) + 1))  # noqa: B023
            g = tuple(w[i - n + 1 : i + 1])  # noqa: B023
            return math.log(left(g) / left(g[:-1])) if left(g) > 0 else math.log(alpha) + s(i, n - 1)

        out.append((len(w), sum(s(i, min(order, i + 1)) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block", [300, 10**9])
def test_backoff_equals_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(op4_backoff, "block_bytes", lambda total: block)
    rng = random.Random(9)
    texts = [" ".join(prose(rng, rng.randint(0, 50), 12)) for _ in range(40)] + ODD + ["w1 w2 w3"] * 3
    got = {r["doc_id"]: r for r in op4_backoff.score(docs_of(spark, texts), order).collect()}
    for i, (n, s) in enumerate(brute_backoff(texts, order)):
        assert got[i]["n_words"] == n and abs(got[i]["log_score"] - s) < 1e-5
        assert (got[i]["mean_log_score"] is None) == (n == 0)


def test_backoff_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumn("block", F.lit(1))
    got = op4_backoff.score(df).collect()
    assert len(got) == 4 and op4_backoff.score(df.limit(0)).count() == 0 and op4_backoff.score(df.where("text is null")).count() == 1


def test_packed_hashes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (op4_backoff.unpack_sorted(op4_backoff.pack_sorted(h)) == h).all()
        c = rng.integers(0, 2**40, n)
        assert (op4_backoff.unpack_counts(op4_backoff.pack_counts(c)) == c).all()


TOKENIZER = Tokenizer.from_file(op5_packing.vocabulary())
SPACED = ["a  b", "a \nb", " a b ", "it's  don't", "x <|endoftext|> y", "１２ ²³ ½", "日本語 テキスト", "a  b", "a　b c", "\x1c x", "é" * 50 + " z", "tab\t x", "! !! ?!"]


def check_packing(rows, texts):
    """Rows against the tokenizer: ids, cuts and places; returns the padded share."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r["start"]):
            piece = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    pad = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return pad / (2048 * len(by_seq)) if by_seq else 0.0


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op5_packing.pack(docs).collect()
    assert check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}) < 0.015


def test_packing_edges(spark):
    texts = SPACED + ODD + ["word " * 5000, "a" * 9000]
    check_packing(op5_packing.pack(docs_of(spark, texts)).collect(), dict(enumerate(texts)))
    df = spark.createDataFrame([(None, "x"), (1, "same"), (1, "same")], "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("lot", F.lit("a"))
    rows = op5_packing.pack(df).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert op5_packing.pack(df.limit(0)).count() == 0


def test_plan_places_every_item_and_is_near_the_bound():
    rng = random.Random(7)
    for capacity, sizes in ((100, [rng.randint(1, 99) for _ in range(3000)]), (2048, [rng.randint(1, 2047) for _ in range(4000)]), (10, [6] * 7), (10, [])):
        histogram = dict(Counter(sizes))
        planned = op5_packing.plan(histogram, capacity)
        placed = Counter()
        for p, times in planned:
            assert times > 0 and sum(x * n for x, n in p.items()) <= capacity
            for x, n in p.items():
                placed[x] += n * times
        assert placed == Counter(sizes)
        bound = max(-(-sum(sizes) // capacity), sum(x * 2 > capacity for x in sizes))
        assert sum(t for _, t in planned) <= bound * 1.01 + 1


def test_knapsack_is_best():
    rng = random.Random(8)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 15), 4)))
        worth = np.array([rng.random() for _ in sizes])
        value, chosen = op5_packing._knapsack(sizes, worth, 20)
        best = max(sum(n * v for n, v in zip(ns, worth)) for ns in itertools.product(range(21), repeat=4) if sum(n * x for n, x in zip(ns, sizes)) <= 20) if max(21 // sizes) < 8 else value
        assert abs(value - best) < 1e-9 and sum(x * n for x, n in chosen.items()) <= 20


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    """Smallest id of the closure of equal texts and similarity of 0.8."""
    sets = {i: shingles(t) for i, t in rows}
    text = {i: t or "" for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if text[a] == text[b] or x and 5 * len(x & y) >= 4 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in sets}


def near_fixture():
    rng = random.Random(21)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(12)]
    texts = []
    for w in base:
        for _ in range(rng.randint(1, 14)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                v[rng.randrange(len(v))] = f"n{rng.randint(0, 10**6)}"
            texts.append(rng.choice([" ", "\n"]).join(v))
    chain = prose(rng, 100)
    for k in range(12):  # each is like the next, the ends are not alike
        texts.append(" ".join([*chain[k * 4 :], *prose(random.Random(k), k * 4)]))
    return texts + ["", None, " ", "a", "A", "b", "one two three four", "One, two; three four"]


def test_near_classes_equal_brute_force(spark):
    texts = near_fixture()
    got = {r["doc_id"]: r["class_id"] for r in op7_dart_minhash.report(docs_of(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_near_classes_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in op7_dart_minhash.report(docs).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(op7_dart_minhash, "BLOCK", 3)
    monkeypatch.setattr(op7_dart_minhash, "_hub_pairs", lambda bands, rooted, turn: bands.select(F.col("node").alias("b"), F.col("node").alias("a")).where("a <> b").distinct())
    texts = near_fixture()
    got = {r["doc_id"]: r["class_id"] for r in op7_dart_minhash.report(docs_of(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_keep_one(spark):
    texts = near_fixture()
    df = docs_of(spark, texts).withColumn("node", F.lit("clash"))
    more = df.unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    out = op7_dart_minhash.keep_one(more)
    want = brute_classes(list(enumerate(texts)))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(want.values()))
    assert op7_dart_minhash.keep_one(df.limit(0)).count() == 0
    alone = docs_of(spark, ["x y", "x y"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert op7_dart_minhash.keep_one(alone).count() == 1


def test_blocks_emit_each_pair_once_where_it_is_grouped(monkeypatch):
    rng = random.Random(4)
    words = prose(rng, 300)
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(5, 295, 10)]
    whole = op7_dart_minhash.signatures

    def shaped(*args):  # the first bands differ, but not in their last eight bits
        sig = whole(*args)
        sig[:, :40] = (np.arange(1, len(sig) + 1, dtype=np.uint64) << np.uint64(8))[:, None]
        return sig

    monkeypatch.setattr(op7_dart_minhash, "signatures", shaped)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [pa.array(texts)], ["doc_id", "node", "text"])
    signed = [r for b in op7_dart_minhash._signer(False)(iter([batch])) for r in b.to_pylist()]
    pairs = Counter()
    for number in range(op7_dart_minhash.BANDS):
        for key in {r["bands"][number] for r in signed}:
            own = [r for r in signed if r["bands"][number] == key]
            side = [[[r[k] for r in own]] for k in ("node", "node", "sig")]
            block = pa.RecordBatch.from_arrays([pa.array(x) for x in [[number], *side, *side]], list("nabcdef"))
            pairs.update(p for b in op7_dart_minhash._block_compare(iter([block])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    grouped = {(i, j) for i, j in itertools.combinations(range(len(signed)), 2) if set(signed[i]["bands"]) & set(signed[j]["bands"])}
    assert len(grouped) > 300 and pairs == Counter({p: 2 for p in grouped})  # a block with itself: each pair from both ends


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_null_and_repeated_ids_name_no_class(spark, kind):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(prose(rng, 60)) for _ in range(5))
    near = b.rsplit(" ", 1)[0]
    rows = [(None, a), (None, a), (None, b), (None, near), (None, None), (7, c), (7, d), (7, d), (2, e), (None, e), (9, f"{e} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    kept = op7_dart_minhash.keep_one(df).collect()
    assert Counter(r["text"] in (b, near) or r["text"] for r in kept) == Counter([a, True, None, c, d, e])
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "7", "7", "None", "None", "None"]
    got = op7_dart_minhash.report(df).collect()
    assert len(got) == len(rows) and None not in {r["class_id"] for r in got} and len({r["class_id"] for r in got}) == 6
    assert Counter(Counter(r["class_id"] for r in got).values()) == Counter([2, 2, 1, 1, 2, 3])
    assert [str(r["class_id"]) for r in got if str(r["doc_id"]) in ("2", "9")] == ["2", "2"]


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    n, k = 60, 4000
    element = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919)
    x, y = rng.uniform(0.1, 3, n), rng.uniform(0.1, 3, n)
    y[:10] = 0.0
    both = y > 0
    doc = np.concatenate([np.zeros(n, int), np.ones(both.sum(), int)])
    sig = op7_dart_minhash.signatures(doc, np.concatenate([element, element[both]]), np.concatenate([x, y[both]]), 2, k)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)
    assert (sig != 0).all()


def test_components_of_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 60)
    links = [(names[i], names[i + 1]) for i in range(39)] + [(names[i], names[i + 1]) for i in range(40, 59)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in op7_dart_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for group in (names[:40], names[40:]):
        assert {got.get(x, x) for x in group} == {min(group)}


def brute_hits(text, items):
    w = WORD.findall((text or "").translate(LOW))
    covered, own = set(), set()
    for i, t in items:
        b = WORD.findall((t or "").translate(LOW))
        k = min(10, len(b))
        for p in range(len(b) - k + 1) if k else ():
            for q in range(len(w) - k + 1):
                if w[q : q + k] == b[p : p + k]:
                    covered |= set(range(q, q + k))
                    own.add(str(i))
    return len(w), len(covered), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(covered)


@pytest.mark.parametrize("block_bytes", [op8_suffix.BLOCK_BYTES, 200])
def test_suffix_hits_equal_brute_force(spark, block_bytes, monkeypatch):
    rng = random.Random(13)
    items = [(i, " ".join(prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]), 40))) for i in range(12)] + [(1, "w1 w2 W3"), (50, None)]
    texts = []
    for _ in range(60):
        w = prose(rng, rng.randint(0, 60), 400)
        for _, t in rng.sample(items, 2):
            b = (t or "").split()
            a = rng.randint(0, max(0, len(b) - 1))
            at = rng.randint(0, len(w))
            w[at:at] = b[a : a + rng.randint(1, 30)]
        texts.append(rng.choice([" ", "\n", "; "]).join(w))
    texts += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op8_suffix, "blocks", lambda b, f=op8_suffix.blocks, **kw: f(b, **{**kw, "block_bytes": block_bytes}))
    got = {r["doc_id"]: tuple(r)[1:] for r in op8_suffix.report(docs_of(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_suffix_longest_matches(spark):
    item = " ".join(f"b{i}" for i in range(30))
    text = "x y " + " ".join(f"b{i}" for i in range(5, 22)) + " z"
    df = op8_suffix.search(docs_of(spark, [text]), spark.createDataFrame([(9, item)], "item_id long, text string"))
    hits = {tuple(h) for h in df.first()["__s_hits"]}
    assert ("9", 2, 5, 17) in hits and max(h[3] for h in hits) == 17


def test_suffix_edges(spark):
    bench = spark.createDataFrame([(1, "only this")], "item_id long, text string")
    df = docs_of(spark, ["now Only-this is", None, ""]).withColumn("__s", F.lit(1)).withColumn("item_id", F.lit(4))
    out = op8_suffix.clean(df, bench)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert op8_suffix.clean(df, bench.limit(0)).count() == 3 and op8_suffix.report(df.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="home">
<header><a href="/">Home</a><p>Site name</p></header><nav><ul><li><a href=/a>A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please.</div><!-- <p>not this</p> -->
<article><h1>The   head&#233;</h1><p>First <b>bold<i> text</b>, with a
line &lt;break&gt;.<br>And more.<p>Second paragraph is &quot;here&quot;.<ul><li>One item of it</li><li>Two</ul><aside>Related: this and that.</aside>
<div class="share">Share it now on our pages, please.</div><blockquote>A quote.</blockquote>
<div id="comments"><p>Great article, thank you so much for it all.</p></div></article>
<form><p>Subscribe to us today, it is free.</p><select><option>x</select></form><aside class="sidebar"><p>More stories that you will like.</p></aside>
<footer>&copy; 2020 &middot; Someone wrote this, all of it.</footer></body></html>"""


def test_page_parts():
    want = ['The headé', 'First bold text, with a line <break>. And more.', 'Second paragraph is "here".', "One item of it", "Two", "A quote."]
    assert op9_mincut.main_text(PAGE).split("\n") == want


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("<p>", ""), ("<article><p>Cut off in a <b>tag.</p><p title='x", "Cut off in a tag."),
    ("<article><p>A &am", "A &am"), ("<article><h1>Only head</h1></article>", "Only head"), ("<script>x", ""), ("<article><p>1 < 2 and 3 > 2.</p></article>", "1 < 2 and 3 > 2."),
    ("<main><div><p>İ one.</p><script>no</SCRIPT><p>Two.</p></div></main>", "İ one.\nTwo."), ("</p></div><article>Text.</article>", "Text."),
    ('<div class="ad">Buy.</div><article><p>x.</p></article>', "x."), ("<article><p title='a>b'>q.</p></article>", "q.")])
def test_odd_pages(page, text):
    assert op9_mincut.main_text(page) == text


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 8)
        score = [rng.uniform(-1.5, 1.5) for _ in range(n)]
        tied = {(a, b): rng.uniform(0, 1.5) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5}

        def cost(label):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(score, label)) + sum(w for (a, b), w in tied.items() if label[a] != label[b])  # noqa: B023

        got = op9_mincut.minimum_cut(score, tied)
        assert abs(cost(got) - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-6


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in op9_mincut.extract(pages).collect()}
    import html
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer|$)", r["html"])[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"(?s)<!--.*?-->", "", body))]
        assert got[r["page_id"]]["text"] == "\n".join(x for x in want if x) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    null = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert [(r["text"], r["n_chars"]) for r in op9_mincut.extract(null).collect()] == [("", 0)] * 2
    assert op9_mincut.extract(null.limit(0)).count() == 0


def test_texts_without_words_in_partitions_of_their_own(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(["", None, "!?", " ", "...", None])], DOCS).repartition(6, "doc_id")
    assert sorted(r["doc_id"] for r in op7_dart_minhash.report(df).collect()) == list(range(6))


def test_pipeline_stages(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns = df.columns
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        df = spark.createDataFrame(out.collect(), out.schema)
        results.append(df)
        if len(results) < 5:
            assert df.columns == columns
    good, lines, near, clean, packed = ({r["doc_id"]: r for r in x.collect()} if i < 4 else x.collect() for i, x in enumerate(results))
    facts = {r["doc_id"]: r for r in op10_host_quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(good) == {i for i, r in facts.items() if r["kept"]}
    runs = brute_runs([(i, r["text"] or "") for i, r in good.items()], op2_line_dedup.MIN_WORDS)
    assert set(lines) == set(good) and all((lines[i]["text"] == good[i]["text"]) == (not runs[i]) for i in good)
    assert set(near) == set(brute_classes([(i, r["text"]) for i, r in lines.items()]).values())
    assert set(clean) == {i for i, r in near.items() if not brute_hits(r["text"], bench)[-1]}
    check_packing(packed, {i: r["text"] for i, r in clean.items()})
    assert docs and corpus_pipeline.run(spark, SF).count() == len(packed)
