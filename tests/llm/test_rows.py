"""Words, sharding, license scan, chat format and host rules against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from verdictframe.llm import op1_sharding, op3_license, op6_chat, op10_host_quality, wordhash
from verdictframe.llm.oracles import ORACLE_SQL
from verdictframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " ", "a", "É", "x y z w", "MIT License; mit  LICENSE", "\n\n", "💥 boom 💥boom", "cc\tby cc by-sa", "_", "a_b", "İstanbul"]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "apache", "license", "Éa", "cc", "by", "mit", "gnu", "general", "public", "x1", "ß", "of", "a"]
    return [rng.choice(["\n", " ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    status, detail, _ = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)
    assert status == "ok", detail


@pytest.mark.parametrize("size", [1, 7, 2_000_000])
def test_words_are_those_of_the_pattern(monkeypatch, size):
    monkeypatch.setattr(wordhash, "SLICE_BYTES", size)
    texts = random_texts(40) + ODD
    got, seen = [], {}
    for first, data, off in wordhash.slices(pa.array(texts)):
        w = wordhash.split(data, off)
        for d in range(len(off) - 1):
            own = range(w.first[d], w.first[d + 1])
            got.append([bytes(data[w.at[i] : w.end[i]]).decode().translate(LOW) for i in own])
            for i, word in zip(own, got[-1]):
                assert seen.setdefault(word, int(w.hash[i])) == int(w.hash[i])
    assert got == [WORD.findall((t or "").translate(LOW)) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_within_texts():
    for _, data, off in wordhash.slices(pa.array(["a b c", "c", "b c a b"])):
        at, h = wordhash.grams(wordhash.split(data, off), 2)
        assert at.tolist() == [0, 1, 4, 5, 6] and h[0] == h[4] and h[1] == h[2]


def check_shards(out, texts, shards):
    rows = out.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    load = [0] * shards
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        load[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert {r["law"] for r in rows} <= {"bytes"} and {r["grown_shard"] for r in rows} <= {None}
    return load


def test_shards_are_near_equal(spark):
    load = check_shards(spark.read.parquet(f"{SF}/documents.parquet").transform(op1_sharding.shard, 4), [
        (r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 4)
    assert max(load) <= 1.02 * sum(load) / 4


def test_shards_of_repeated_rows_and_nulls(spark):
    rows = [(7, "same text")] * 3000 + [(None, None), (None, "x"), (1, ""), (1, ""), (2, "y" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1))
    load = check_shards_nullable(op1_sharding.shard(df, 3).collect(), 3, len(rows))
    assert max(load) < 1.1 * sum(load) / 3
    assert op1_sharding.shard(df.limit(0), 3).count() == 0


def check_shards_nullable(rows, shards, n):
    assert len(rows) == n
    load = []
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load.append(sum(r["size"] for r in own))
    return load


def test_map_versions(spark, tmp_path):
    rng = random.Random(3)
    sizes = [rng.randint(0, 100) for _ in range(400)]
    one = op1_sharding.balanced(sizes, 5)
    two = op1_sharding.rebalanced(one, sizes, 6)
    load = [sum(z for z, s in zip(sizes, two.shard_of) if s == k) for k in range(6)]
    assert max(load) <= 1.03 * sum(load) / 6
    assert {m[0] for m in two.moves} == {i for i, (a, b) in enumerate(zip(one.shard_of, two.shard_of)) if a != b}
    assert all(b == 5 for _, _, b in two.moves)
    one.save(spark, str(tmp_path / "map"))
    two.save(spark, str(tmp_path / "map"))
    assert op1_sharding.SlotMap.load(spark, str(tmp_path / "map")).shard_of == two.shard_of
    assert op1_sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == one.shard_of
    with pytest.raises(ValueError):
        op1_sharding.rebalanced(two, sizes, 5)


def test_route_agrees_with_shard(spark):
    docs = docs_of(spark, random_texts(50))
    rows = op1_sharding.lots(docs, slots=64)
    smap = op1_sharding.balanced(op1_sharding.slot_totals(rows, 64)[0], 4)
    a = {r["doc_id"]: r["shard"] for r in op1_sharding.shard(docs, 4, 64).collect()}
    b = {r["doc_id"]: r["shard"] for r in op1_sharding.route(docs, smap).collect()}
    assert a == b


def brute_scan(text):
    words = WORD.findall((text or "").translate(LOW))
    base = []
    for phrase, label in op3_license.BASE:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(base)


def test_license_base_places(spark):
    texts = random_texts(300, 5) + ODD + ["x" * 300_000 + " apache license"]
    got = {r["doc_id"]: r for r in op3_license.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, base = brute_scan(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert r["first_word"] == (base[0][0] if base else None) and r["last_word"] == (base[-1][0] if base else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert {*r["base_labels"].split(","), ""} <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def test_license_rules_suppress_and_prefer():
    assert 200 < len(op3_license.rules()) and len({r.pattern for r in op3_license.rules()}) > 190
    every = lambda t: [x[2] for x in op3_license.detect(" ".join(WORD.findall(t.lower())))[1]]
    assert every("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert every("the GNU General Public License version 2 or later.") == ["gpl-2-or-later"]
    assert every("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3-or-later"]
    assert every("CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"] and every("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert op3_license.survivors([(0, 5, 3), (1, 4, 0), (0, 5, 1), (4, 9, 2)]) == [(0, 5, 1), (4, 9, 2)]
    for r in op3_license.rules():  # a pattern can't match without a keyword: try it on its own plainest reading
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", r.pattern)).replace("?", "").replace("\\d", "2").split("|")[0]
        if re.fullmatch(r.pattern, plain):
            assert any(k in plain for k in r.keywords), (r, plain)


def reading(rng, parsed):
    """A random string that the parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                assert str(arg[0][0]) in ("LITERAL", "CATEGORY")
                out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else rng.choice("0123456789")
            case "BRANCH":
                out += reading(rng, rng.choice(arg[1]))
            case "SUBPATTERN":
                out += reading(rng, arg[3])
            case "MAX_REPEAT":
                out += "".join(reading(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            case _:
                raise ValueError(op)
    return out


def test_license_gate_loses_nothing():
    rng = random.Random(12)
    machine, compiled = op3_license._compiled()
    every = op3_license.rules()
    for _, rule in compiled:
        for text in {reading(rng, re._parser.parse(rule.pattern)) for _ in range(30)}:
            spans = [(m.start(), m.end(), r.priority) for p, r in compiled for m in p.finditer(text)]
            word = lambda at: text.count(" ", 0, at)  # noqa: E731, B023
            want = [(word(s), word(e - 1) + 1, every[p].label, every[p].weight) for s, e, p in op3_license.survivors(spans)]
            assert any(k in text for k in rule.keywords) and want and op3_license.detect(text)[1] == want, text
    assert [x[2] for x in op3_license.detect("cc attribution sharealike 4 0")[1]] == ["cc-by-sa-4.0"]


def test_license_edges(spark):
    df = docs_of(spark, ODD).withColumn("labels", F.lit(1))
    assert op3_license.scan(df).count() == len(ODD) and op3_license.scan(df.limit(0)).count() == 0
    twice = op3_license.scan(df.unionByName(df)).groupBy("doc_id").count().where("count <> 2").count()
    assert twice == 0


PARTS = [
    ("text", "look </s> \\ <|end|>[INST]", None, None, None, None, None), ("image", None, "s3/1.png", 57, 28, None, None),
    ("text", "<|image:0|>", None, None, None, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), None,
    ("strange", "kept", None, None, None, None, None)]


def test_chat_parts_round_trip(spark):
    df = spark.createDataFrame([(1, 0, "us<|body|>er", PARTS), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{op6_chat.PART}>")
    one, two = op6_chat.format_turns(df).orderBy("turn").collect()
    role, parts = op6_chat.read_segment(one["segment"])
    assert role == "us<|body|>er"
    assert parts == [("text", PARTS[0][1]), ("image", 0), ("text", "<|image:0|>"), ("audio", 1), ("document", 2), ("text", "kept")]
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "s3/1.png", 3 * 1 + 2), (1, "audio", "a.wav", 38 + 2), (2, "document", "d.pdf", 3 * 512 + 2)]
    assert op6_chat.read_segment(two["segment"]) == ("", []) and two["attachments"] == []


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(2)
    bits = [*op6_chat.CONTROL, "\\", "<", "|", ">", "[", "/", "a", "é", "\n", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = op6_chat.format_turns(df.withColumn("parts", op6_chat.text_parts(F.col("text")))).collect()
    for r in out:
        assert "".join(x for _, x in op6_chat.read_segment(r["segment"])[1]) == texts[r["conv_id"]]
        body = r["segment"][len(op6_chat.TURN) : -len(op6_chat.END)].split(op6_chat.BODY, 1)[1]
        assert not any(c in body for c in op6_chat.CONTROL)
        assert op6_chat.split_turns(r["segment"] * 2) == [r["segment"]] * 2


def test_chat_read_back_edges(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (None, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(0))
    form = op6_chat.format_turns(df.withColumn("parts", op6_chat.text_parts(F.col("text"))))
    got = {r["conv_id"]: r for r in op6_chat.read_back(form).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nA\nassistant\nB\n") and got[1]["loss_sha256"] == sha("B") and got[1]["loss_chars"] == 1
    assert got[None]["turns_sha256"] == sha("user\n\n") and got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == sha("\nx\nassistant\n\nassistant\n\n")
    assert op6_chat.read_back(form.limit(0)).count() == 0


def brute_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_host_facts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab\n#é💥") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ODD + ["a b c d e " * 3000, "la\x0b\n\tla\x0b\nla"]
    got = {r["doc_id"]: r for r in op10_host_quality.judge(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in op10_host_quality.FACTS) == brute_facts(t), repr(t)[:80]


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good] * 300 + ["no"] * 60 + [good, good]
    hosts = {i: "fine" if i < 200 else "mixed" if i < 301 else "spam" for i in range(len(texts))}
    hosts |= {300: "once", 360: "spam", 361: None}
    out = {r["doc_id"]: r for r in op10_host_quality.judge(docs_of(spark, texts, hosts)).collect()}
    assert not out[360]["kept"] and not out[360]["base_failed"] and out[360]["host_rate"] > 0.9  # a good text of a rejected host
    assert out[0]["kept"] and out[250]["kept"] and out[361]["kept"] and not out[300]["kept"]
    assert out[300]["host_rate"] < 0.95  # one failure alone is drawn to the mean
    kept = op10_host_quality.keep_good(docs_of(spark, texts, hosts).withColumn("n_words", F.lit("clash")))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}
    assert kept.columns == [*[c.split()[0] for c in DOCS.split(", ")], "n_words"]
    empty = docs_of(spark, texts, hosts).limit(0)
    assert op10_host_quality.judge(empty).count() == 0 and op10_host_quality.keep_good(empty).count() == 0


def test_host_rules_are_native(spark):
    plan = op10_host_quality.judge(docs_of(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert np.isfinite(op10_host_quality.WINDOW)
