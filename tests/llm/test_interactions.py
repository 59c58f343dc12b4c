"""Filter audit, byte-level BPE and prefix trie against plain Python."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from oracle_check import compare, duck
from pyspark.sql import functions as F

from verdictframe.llm import op11_filter_audit, op12_bpe, op13_prefix_trie
from verdictframe.llm.oracles import ORACLE_SQL
from verdictframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit_lists", "op13_prefix_trie_rollup"])
def test_query_equals_sql(spark, name):
    status, detail, _ = compare(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert status == "ok", detail


# ---- filter audit

def brute_audit(rows, labels):
    """Rows (doc_id, source, text) and labels (doc_id, quality, toxic) to the contract's rows, one order at a time."""
    first = {}
    for d, _, t in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    parts = {}
    for d, s, t in rows:
        t = t or ""
        w = t.encode().split()
        bad = {f for f, x in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), d is not None and d > first[t])) if x}
        parts.setdefault(s or "", []).append((bad, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        worth = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order, 1):
                gone, alive = [x for x in alive if f in x[0]], [x for x in alive if f not in x[0]]
                fails = sum(f in x[0] for x in docs)
                worth[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), fails - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(worth[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(spark, rows, labels, ids="long"):
    docs = spark.createDataFrame([(d, s, t, 1, "x") for d, s, t in rows], f"doc_id {ids}, source string, text string, n int, part string")
    known = spark.createDataFrame([(*r, "y") for r in labels], f"doc_id {ids}, quality int, toxic int, fails string")
    got = op11_filter_audit.audit(docs.repartition(5), known).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_audit_is_that_of_each_order_run_alone(spark, monkeypatch, block):
    # workers import the module anew, so the block size is set in the function they receive
    monkeypatch.setattr(op11_filter_audit, "BLOCK_ROWS", block)
    rng = random.Random(3)
    words = ["a", "b", "É", "Ab", "XY", "c#", "d|", "word", "long", " "]
    texts = [" ".join(rng.choice(words) if rng.random() < .6 else f"w{rng.random()}" for _ in range(rng.choice([0, 3, 60, 80]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "", "s", "t"]), rng.choice([*texts, None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    assert audit_rows(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_repeated_ids_texts_and_strange_ids(spark):
    rows = [("k", "s", "same $")] * 30 + [("a", "s", "same $"), (None, "s", "same $"), ("z", None, "x" * 100_000)]
    labels = [("k", 1, 0), ("k", 0, 1)]
    assert audit_rows(spark, rows, labels, "string") == brute_audit(rows, labels)
    assert audit_rows(spark, [], [], "int") == {}


def test_galloping_merges():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(4)]
        assert op11_filter_audit.union(lists).tolist() == sorted(set().union(*map(set, lists)))
        assert op11_filter_audit.difference(lists[0], lists[1]).tolist() == sorted(set(lists[0]) - set(lists[1]))
        assert lists[0][op11_filter_audit.common(lists[0], lists[1])].tolist() == sorted(set(lists[0]) & set(lists[1]))


# ---- byte-level BPE

@pytest.fixture(scope="module")
def vocabulary():
    return op12_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def le(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_bpe_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_of_odd_texts(spark, vocabulary, library):
    rng = random.Random(5)
    texts = ["a" * 5000, " " * 3000 + "x", "=-" * 900, "字" * 700, "   \n\n\t x", "ab" * 33 + " " + "ab" * 32, "'s'S't don't", "\x1f\x1f a\x1fb", "￿\U0001f600" * 50,
             "", None, "é" * 100, "".join(rng.choice("abé字 \n1٣!💥'\x85　") for _ in range(3000)), "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] * 2, "doc_id long, text string, coded string").repartition(3)
    for known in (op12_bpe.HotWords.build([]), None):
        rows = op12_bpe.encode(df, vocabulary, known).select(
            "doc_id", op12_bpe.ids(F.col("coded")).alias("ids"), op12_bpe.ids_as_bytes(F.col("coded")).alias("le"), op12_bpe.decode(F.col("coded"), vocabulary).alias("back")).collect()
        assert len(rows) == 2 * len(texts)
        for r in rows:
            text = texts[r["doc_id"]] or ""
            want = library.encode_ordinary(text)
            assert (r["ids"], bytes(r["le"]), bytes(r["back"])) == (want, le(want), text.encode())
    assert op12_bpe.encode(df.limit(0), vocabulary).collect() == []


def test_rare_words_are_merged_in_batches(spark, vocabulary, library):
    # each used to go through the fold by itself, where it stood
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 64))) for _ in range(9000)] + ["".join(rng.choices("aé字💥\0 ", k=rng.randint(1, 64))) for _ in range(900)]
    got = vocabulary.merges.coded(pa.array(["x", *words])[1:]).to_pylist()
    assert [[ord(c) for c in g] for g in got] == [library._core_bpe.encode_single_piece(w.encode()) for w in words]
    assert vocabulary.merges.coded(pa.array([], pa.string())).to_pylist() == []
    texts = spark.createDataFrame([(i, " ".join(words[i::100]) if i % 7 else None) for i in range(100)], "doc_id long, text string")
    for known in (op12_bpe.HotWords.build([]), None):
        coded = op12_bpe.encode(texts, vocabulary, known)
        assert "aggregate(" not in coded._jdf.queryExecution().optimizedPlan().toString()
        for r in coded.select("text", op12_bpe.ids(F.col("coded")).alias("ids")).collect():
            assert r["ids"] == library.encode_ordinary(r["text"] or "")


def test_places_hold_every_pair(vocabulary):
    table = vocabulary.pairs
    held = {table[i : i + 4]: table[i + 4 : i + 6] for i in range(0, len(table), 6) if table[i : i + 6] != b"\xff" * 6}
    tokens = vocabulary.tokens
    assert all(tokens[int.from_bytes(k[:2])] + tokens[int.from_bytes(k[2:])] == tokens[int.from_bytes(v)] for k, v in held.items())
    assert len(held) == sum(t[:i] in vocabulary.ranks and t[i:] in vocabulary.ranks for t in vocabulary.ranks for i in range(1, len(t)))


# ---- prefix trie

def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, d, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute_trie(built):
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, prior int, key string").repartition(4)
    got = op13_prefix_trie.trie(op13_prefix_trie.rebuilt(df)).collect()
    return sorted(tuple(r[c] for c in TRIE) for r in got)


def shuffled(rows, seed=2):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


def test_trie_of_short_and_odd_conversations(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(4)]) if rng.random() < .2 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é💥", "", None]))
            for c in [*range(60), 100, 101, 130, 205, -5, -100, -130, 12345678901] for t in range(rng.choice([1, 2, 3, 8, 9, 16]))]
    rows += rows[:20] + [(None, 1, "user", "lost")]
    assert trie_rows(spark, shuffled(rows)) == brute_trie(brute_rebuilt(rows))


def test_trie_of_long_conversations(spark):
    """Blocks of eight turns: paths that part inside blocks, at their ends and late, and many equal conversations."""
    rows = []
    for c, (length, fork) in enumerate([(150, 150), (150, 97), (150, 96), (150, 31), (96, 96), (97, 50), (40, 8), (8, 8), (9, 9), (16, 16), (17, 15)]):
        rows += [(c + 1, t, "user", f"t{t}" if t < fork else f"c{c} t{t}") for t in range(length)]
    rows += [(300 + c, t, "user", "same") for c in range(40) for t in range(33)]
    assert trie_rows(spark, shuffled(rows)) == brute_trie(brute_rebuilt(rows))


def test_trie_of_nothing_and_of_one_turn(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(3, None, None, None)]) == brute_trie(brute_rebuilt([(3, None, None, None)]))
