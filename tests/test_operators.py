"""Literal-row tests of operators that SQL cannot check, and of the rules' boundaries."""

import hashlib
import json
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from verdictframe.catalog import load_all
from verdictframe.catalog.base import run
from verdictframe.functions import columns as C
from verdictframe.functions import sqlfuncs
from verdictframe.operators import agreement as A
from verdictframe.operators import documents as D
from verdictframe.operators import gates as G
from verdictframe.operators import generate as N
from verdictframe.operators import integrity as I
from verdictframe.operators import intervals as U
from verdictframe.operators import lifecycle as L
from verdictframe.operators import metrics as M
from verdictframe.operators import ratings as S
from verdictframe.operators import rows as R
from verdictframe.operators import study as T
from verdictframe.plans import audit as P
from verdictframe.operators.ordering import cumulative_counts, hash_ranks, lowest_hashes, previous_by_id
from verdictframe.sources import labelled as B
from verdictframe.sources import registry as Q
from verdictframe.streaming import operators as W

DIMS = S.DIMENSIONS


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- sources -----------------------------------------------------------------


def test_read_labelled(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿text, label\n\"two\nlines, \"\"quoted\"\"\",1\nplain,NA\n".encode())
    df = B.read_labelled(spark, str(p))
    assert df.columns == ["text", "label"]
    assert [tuple(r) for r in df.collect()] == [('two\nlines, "quoted"', "1"), ("plain", "NA")]
    dup = tmp_path / "d.csv"
    dup.write_text("a,a\n1,2\n")
    with pytest.raises(B.SourceError):
        B.read_labelled(spark, str(dup))


def test_classify_files(spark, tmp_path):
    files = {"t.csv": b"a,b\n1,2\n", "w.csv": b"  <!DOCTYPE html><p>", "j.csv": b"{}", "x.csv": b"\xff\xfe\x00",
             "l.csv": b"version https://git-lfs.github.com/spec/v1\noid sha256:" + b"a" * 64 + b"\nsize 10\n"}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in B.classify_files(spark, str(tmp_path)).collect()}
    assert got == {"t.csv": "table", "w.csv": "web_page", "j.csv": "markup_or_json", "x.csv": "not_utf8", "l.csv": "git_lfs_pointer"}


def test_read_runs(spark, tmp_path):
    doc = {"status": "FINALIZED", "final_score": {"total": 5.0, "dimension_scores": {"SAFETY": 6.5}},
           "probes": [{"dimension": "SAFETY", "status": "EVALUATED", "confidence": 0.9, "metric_values": {"severe_fnr": 0.4}},
                      {"dimension": "FAIRNESS", "status": "FAILED", "confidence": 0.4, "metric_values": {}}]}
    (tmp_path / "m_a__run2.json").write_text(json.dumps(doc, indent=1))
    rows = {r["dimension"]: r for r in Q.read_runs(spark, str(tmp_path)).collect()}
    assert rows["SAFETY"]["model"] == "m_a" and rows["SAFETY"]["run"] == 2 and rows["SAFETY"]["score"] == 6.5
    assert rows["FAIRNESS"]["score"] is None and json.loads(rows["SAFETY"]["metric_values"]) == {"severe_fnr": 0.4}


def test_write_table_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    Q.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        Q.write_table(df.filter("a > 1"), str(tmp_path / "e"))
    for _ in range(2):
        Q.log_ingest(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_build_manifest(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "config.json").write_bytes(b"{}")
    row = one(I.build_manifest(spark, str(tmp_path)))
    assert (row["set_id"], row["name"], row["sha256"]) == ("s1", "config.json", hashlib.sha256(b"{}").hexdigest())


# --- ordering ----------------------------------------------------------------


def test_ordering_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i, i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("h", C.hash_rank(1, "i"))
    pdf = df.toPandas().sort_values(["k", "h", "i"])
    pdf["want"] = pdf.groupby("k").cumcount() + 1
    got = hash_ranks(df, "h", ["k"], ["i"]).toPandas().set_index("i")["rank"]
    assert (pdf.set_index("i")["want"].sort_index() == got.sort_index()).all()
    low = {r["i"] for r in lowest_hashes(df, F.lit(25), "h", ["k"], ["i"]).collect()}
    assert low == set(pdf[pdf["want"] <= 25]["i"])
    prev = previous_by_id(df, ["k"], "i", ["v"], block=64).toPandas().sort_values(["k", "i"])
    want = prev.groupby("k")["v"].shift(1)
    assert prev["prev_v"].fillna(-1).tolist() == want.fillna(-1).tolist()
    hist = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    cum = cumulative_counts(hist, ["k"], "v").toPandas().sort_values(["k", "v"])
    assert cum["before"].tolist() == (cum.groupby("k")["n"].cumsum() - cum["n"]).tolist()


# --- rows --------------------------------------------------------------------


def test_score_refuses_wrong_length(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    ok = R.score(df, lambda: lambda s: pd.Series([len(x) for x in s]))
    assert [r["y_hat"] for r in ok.collect()] == [1, 1]
    with pytest.raises(Exception, match="predictor returned"):
        R.score(df, lambda: lambda s: pd.Series([1] * (len(s) + 1))).collect()


def test_decode_edges(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([float("nan"), 2.0],), ([-800.0, 800.0],)], "z array<double>")
    rows = df.select(R.decode("z", "argmax").alias("a"), R.decode("z", "multilabel", 0.5, 0).alias("m")).collect()
    assert [r["a"] for r in rows] == [0.0, None, 1.0]
    assert [r["m"] for r in rows] == [1.0, None, 0.0]


def test_literal_hits_match_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, k=60)).replace(" w7 ", "\nw7  ")) for i in range(60)]
    lits = [(j, docs[j][1][20:20 + rnd.choice([3, 9, 40, 90])]) for j in range(30)] + [(99, "absent text that is nowhere to be found")]
    want = {(i, j) for i, t in docs for j, x in lits if x and x in t}
    d, x = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(lits, "lit int, v string")
    got = {(r["doc"], r["lit"]) for r in R.literal_hits(d, "doc", "text", x, "lit", "v").collect()}
    assert got == want


# --- generation --------------------------------------------------------------


def test_char_swap_properties(spark):
    texts = ["Hello World", "", "...", "éÀ9", "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for r in N.char_swap(df, "text", "id", 5, 3).collect():
        a, b = r["text"], r["attacked"]
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        assert len(a) == len(b) and len(diff) == min(3, sum(c.isalnum() for c in a))
        assert all(a[i].isalnum() and a[i].isupper() == b[i].isupper() for i in diff if b[i].isalpha() and a[i].isalpha())


def test_flips_are_nested(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "id bigint, label int")
    sets = {}
    for rate in (0.0, 0.2, 0.5, 1.0):
        out = N.flip_labels(df, "id", F.col("label") == 0, 1, rate, 4)
        sets[rate] = {r["id"] for r in out.filter("flipped").collect()}
        assert len(sets[rate]) == round(200 * rate) and out.count() == 400
    assert sets[0.0] <= sets[0.2] <= sets[0.5] <= sets[1.0]


# --- intervals and gates -----------------------------------------------------


def test_samplers_agree(spark):
    rows = [("e", f"g{i % 3}", i % 2, int((i * 7) % 10 < (6 if i % 2 else 2 + i % 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "evaluation_id string, grp string, label int, y_hat int")
    a = one(U.fairness_ci(df, ["evaluation_id"], ["eopp"], b=400, sampler="hash"))
    b = one(U.fairness_ci(df, ["evaluation_id"], ["eopp"], b=1000))
    assert a["point"] == b["point"] and a["replicates"] == 400 and b["replicates"] == 1000
    assert abs(a["ci_lower"] - b["ci_lower"]) < 0.03 and abs(a["ci_upper"] - b["ci_upper"]) < 0.03
    again = one(U.fairness_ci(df.repartition(7), ["evaluation_id"], ["eopp"], b=1000))
    assert (again["ci_lower"], again["ci_upper"]) == (b["ci_lower"], b["ci_upper"])


def test_weighted_cells_equal_rows(spark):
    rows = [("e", f"g{i % 2}", i % 3 == 0, (i * 5) % 7 < 3, (i * 3) % 5 < 2, i % 4 == 0) for i in range(500)]
    df = spark.createDataFrame([(e, g, *map(int, x)) for e, g, *x in rows], "evaluation_id string, grp string, label int, y_hat int, y_robust int, severe int")
    by = ["evaluation_id"]
    cube = M.cube(df, by, ["grp", "label", "y_hat", "y_robust", "severe"])
    for fn in (M.fairness_bundle, M.robustness_metrics, M.severe_behavior, M.collapse):
        assert one(fn(df, by)) == one(fn(cube, by, weight="n"))


@pytest.mark.parametrize("point,lo,want", [(0.02, 0.01, "NO_MATERIAL_DISPARITY"), (0.021, 0.02, "DISPARITY_OBSERVED"),
                                           (0.05, 0.0201, "FAIRNESS_RISK"), (None, None, "INSUFFICIENT_EVIDENCE")])
def test_finding_boundaries(spark, point, lo, want):
    df = spark.createDataFrame([(point, lo)], "p double, lo double")
    assert one(df.select(G.finding(F.col("p"), F.col("lo"), F.lit(0.5)).alias("f")))["f"] == want


def test_single_group_has_no_gap(spark):
    df = spark.createDataFrame([("e", "g", 1, 1)], "evaluation_id string, grp string, label int, y_hat int")
    row = one(M.fairness_bundle(df, ["evaluation_id"]))
    assert row["n_groups"] == 1 and row["dpd"] is None and row["eopp"] is None


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("select wilson_lo(8D, 10D) lo, wilson_hi(8D, 10D) hi, wilson_lo(0D, 0D) z, detect_d(0.26D) d, hash_rank('1', '2') h").first()
    lo, hi = C.wilson(F.lit(8), F.lit(10))
    want = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), C.hash_rank(1, F.lit("2")).alias("h")).first()
    assert math.isclose(row["lo"], want["lo"]) and math.isclose(row["hi"], want["hi"]) and row["z"] == 0.0 and row["d"] == 3 and row["h"] == want["h"]


# --- cards -------------------------------------------------------------------


def test_card_sections(spark):
    text = "intro\r\n# One\r\nbody of one\n#### deep\n## Two  \n\n# One\nagain\n#\n"
    df = spark.createDataFrame([("c", text), ("n", None)], "k string, card_text string")
    got = [(r["heading"], r["body"]) for r in D.split_sections(df, "k").orderBy("position").collect()]
    assert got == [("One", "body of one\n#### deep"), ("Two", "")]


def test_longest_alias_wins(spark):
    df = spark.createDataFrame([("bias and risks",), ("bias",), ("nothing",)], "h string")
    got = [r[0] for r in df.select(D.match_alias(F.col("h"), D.SECTION_ALIASES)).collect()]
    assert got == ["ethical_considerations", "limitations", None]


# --- scoring -----------------------------------------------------------------

VECTORS = [  # (risks per aspect, weights, expected total)
    ({d: [(5, 5, 5)] for d in DIMS}, None, 5.0), ({d: [(10, 10, 10)] for d in DIMS}, None, 10.0),
    ({**{d: [(10, 10, 10)] for d in DIMS}, "SAFETY": [(0, 9, 9)]}, None, 8.0),
    ({**{d: [(8, 8, 8)] for d in DIMS}, "FAIRNESS": [(8, 8, 8), (1, 1, 1)]}, None, 7.3),
    ({**{d: [(10, 10, 10)] for d in DIMS}, "SAFETY": [(1, 1, 1)]}, dict(zip(DIMS, (0.1, 0.1, 0.1, 0.1, 0.6), strict=True)), 4.6)]


@pytest.mark.parametrize("risks,weights,want", VECTORS)
def test_score_vectors(spark, risks, weights, want):
    df = spark.createDataFrame([(1, a, *t) for a, ts in risks.items() for t in ts], "e int, aspect string, O int, S int, D int")
    w = spark.createDataFrame([(1, a, x) for a, x in weights.items()], "e int, aspect string, weight double") if weights else None
    row = one(S.total_score(df, ["e"], w))
    assert row["violations"] == [] and math.isclose(row["score"], want, abs_tol=1e-3)


def test_score_violations(spark):
    four = spark.createDataFrame([(1, a, 5, 5, 5) for a in DIMS[:4]], "e int, aspect string, O int, S int, D int")
    assert one(S.total_score(four, ["e"]))["violations"] == ["needs_exactly_five_aspects"]
    five = spark.createDataFrame([(1, a, 5, 5, 5 if a != "SAFETY" else 11) for a in DIMS], "e int, aspect string, O int, S int, D int")
    assert "component_out_of_range" in one(S.total_score(five, ["e"]))["violations"]
    w = spark.createDataFrame([(1, a, x) for a, x in zip(DIMS, (0.05, 0.35, 0.2, 0.2, 0.3), strict=True)], "e int, aspect string, weight double")
    bad = one(S.total_score(spark.createDataFrame([(1, a, 5, 5, 5) for a in DIMS], "e int, aspect string, O int, S int, D int"), ["e"], w))
    assert set(bad["violations"]) == {"weight_below_minimum", "weights_do_not_sum_to_one"} and bad["score"] is None


# --- lifecycle ---------------------------------------------------------------


def test_replay_blocks_do_not_matter(spark):
    rnd = random.Random(1)
    kinds = [*L.TRANSITIONS, "noise"]
    ev = [(rnd.choice("aab"), i, rnd.choice(kinds)) for i in range(400)]
    state, want = {}, {}
    for k, i, e in ev:
        cur = state.get(k, "NONE")
        target, sources = L.TRANSITIONS.get(e, (None, ()))
        ok = cur in sources
        state[k] = target if ok else cur
        want[i] = (ok, state[k])
    df = spark.createDataFrame(ev, "k string, id bigint, event_type string")
    for block, span in ((7, 3), (10_000, 1_000)):
        got = {r["id"]: (r["accepted"], r["state"]) for r in L.replay_status(df, ["k"], block=block, span=span).collect()}
        assert got == want
        assert {r["k"]: r["state"] for r in L.final_states(df, ["k"], block=block, span=span).collect()} == state


def test_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in range(25)], "id bigint, d string").withColumn("ts", F.to_timestamp("d"))
    seen, cursor = [], None
    while True:
        rows = L.page(df, "ts", "id", 10, cursor).collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        cursor = (str(rows[-1]["ts"]), rows[-1]["id"])
    assert sorted(seen) == list(range(25)) and len(seen) == 25


def test_page_honours_its_limit(spark):
    df = spark.range(700).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert L.page(df, "ts", "id", 500).count() == 500
    with pytest.raises(ValueError):
        L.page(df, "ts", "id", 0)


# --- null keys, digests, evidence --------------------------------------------


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 2)], "k string, id bigint").withColumn("h", F.col("id") * 3)
    assert hash_ranks(df, "h", ["k"]).count() == 4
    assert lowest_hashes(df, F.lit(1), "h", ["k"]).count() == 2
    assert {(r["k"], r["id"], r["prev_id"]) for r in previous_by_id(df, ["k"], "id", ["id"]).collect()} == {(None, 1, None), (None, 2, 1), ("a", 1, None), ("a", 2, 1)}
    xy = df.withColumn("x", F.col("id").cast("double"))
    assert {(r["k"], r["n"], r["pearson"]) for r in T.correlations(xy, ["k"], "x", "x").collect()} == {(None, 2, 1.0), ("a", 2, 1.0)}


def test_correlation_of_small_numbers(spark):
    df = spark.createDataFrame([("a", i * 1e-8, i * 2e-8) for i in range(10)] + [("b", 0.3, float(i)) for i in range(10)], "k string, x double, y double")
    got = {r["k"]: r["pearson"] for r in T.correlations(df, ["k"], "x", "y").collect()}
    assert abs(got["a"] - 1) < 1e-9 and got["b"] is None


def test_digest_tells_fields_and_nulls_apart(spark):
    rows = [("1", "a|b", "c"), ("2", "a", "b|c"), ("3", None, "x"), ("4", "", "x")]
    df = spark.createDataFrame(rows, "g string, t string, u string").withColumns({"id": F.lit(1), "label": F.lit(1)})
    out = N.dataset_manifest(df, ["g"], "id", ["t", "u"]).collect()
    assert len({r["digest"] for r in out}) == 4
    twice = N.dataset_manifest(df.withColumn("g", F.lit("z")).orderBy(F.desc("t")), ["g"], "id", ["t", "u"])
    assert one(twice)["digest"] == one(N.dataset_manifest(df.withColumn("g", F.lit("z")), ["g"], "id", ["t", "u"]))["digest"]


def test_evidence_states_cover_five_dimensions(spark):
    rows = [(1, "M0", "FAIRNESS", None, None, [], None, None), (1, "M0", "SAFETY", "EVALUATED", "scored_risk", [], 0.1, 0.2), (2, "M1", "SAFETY", "EVALUATED", "no_material_risk", [], 0.1, 0.05)]
    df = spark.createDataFrame(rows, "evaluation_id int, model string, dimension string, probe_status string, aspect_scoring string, risks array<string>, severe_fnr double, ci_lower double")
    got = {(r["evaluation_id"], r["dimension"]): r["state"] for r in T.evidence_states(df, "M0").collect()}
    assert len(got) == 10 and got[1, "SAFETY"] == "FLAGGED" and got[2, "SAFETY"] == "NOT_FLAGGED"
    assert sum(x == "ABSTAINED" for x in got.values()) == 8


def test_audit_has_five_rows_per_evaluation(spark):
    load_all()
    rows = run("plan_verdicts", spark, "/root/testdata/sf0.001").select("evaluation_id", "dimension", "probe_status").collect()
    keys = {r["evaluation_id"] for r in rows}
    assert sorted((r["evaluation_id"], r["dimension"]) for r in rows) == sorted((k, d) for k in keys for d in DIMS)
    assert all(r["probe_status"] for r in rows)


def test_registry_sink_keeps_rows_of_a_replayed_epoch(spark, tmp_path):
    path = str(tmp_path / "registry")
    spark.createDataFrame([("old",)], "sha256 string").write.parquet(f"{path}/epoch=0")
    sink = W.upsert_registry(path, lambda batch, known: batch.join(known, "sha256", "left_anti"))
    batch = spark.createDataFrame([("old",), ("a",), ("b",)], "sha256 string")
    for _ in range(2):
        sink(batch, 1)
        assert sorted(r["sha256"] for r in spark.read.schema("sha256 string").parquet(path).collect()) == ["a", "b", "old"]


def test_manifest_sets_keep_their_path(spark, tmp_path):
    for d in ("x/a", "y/a"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "config.json").write_bytes(d.encode())
    (tmp_path / "top.txt").write_bytes(b"t")
    got = {(r["set_id"], r["name"]) for r in I.build_manifest(spark, str(tmp_path)).collect()}
    assert got == {("x/a", "config.json"), ("y/a", "config.json"), (".", "top.txt")}
    assert {r["name"] for r in I.build_manifest(spark, str(tmp_path), by_folder=False).collect()} == {"x/a/config.json", "y/a/config.json", "top.txt"}


def test_files_of_any_size_are_read_in_pieces(spark, tmp_path):
    size = (2 << 30) + 12345  # more than a row can hold; sparse on disk
    with open(tmp_path / "weights.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "pointer.csv").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 5\n")
    (tmp_path / "late.csv").write_bytes(b"a,b\n" * 400_000 + b"\xff")  # not UTF-8 after the first piece
    (tmp_path / "split.csv").write_text("é" * 700_000)  # a character lies across two pieces
    (tmp_path / "page.csv").write_text(" \n" * 600_000 + "<!DOCTYPE html>")
    zero = hashlib.sha256()
    for _ in range(size >> 20):
        zero.update(bytes(1 << 20))
    zero.update(bytes(size & ((1 << 20) - 1)))
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in I.build_manifest(spark, str(tmp_path)).collect()}
    assert got["weights.bin"] == (size, zero.hexdigest())
    assert got["late.csv"][1] == hashlib.sha256(b"a,b\n" * 400_000 + b"\xff").hexdigest()
    kinds = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in B.classify_files(spark, str(tmp_path)).collect()}
    assert kinds == {"weights.bin": "table", "pointer.csv": "git_lfs_pointer", "late.csv": "not_utf8", "split.csv": "table", "page.csv": "web_page"}


def test_all_flags_are_returned(spark):
    probes = spark.createDataFrame([(1, [f"flag{i:02d}" for i in range(12)])], "e int, flags array<string>")
    aspects = spark.createDataFrame([(1, "O", 0)], "e int, aspect string, aspect_score int")
    assert len(one(S.score_notes(aspects, probes, ["e"]))["flags"]) == 12


# --- agreement ---------------------------------------------------------------


def test_leave_one_out_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, f"r{r}", rnd.choice("ABC")) for i in range(60) for r in range(rnd.choice([3, 4, 5]))]

    def top(vals):
        m = max(vals.count(v) for v in vals)
        return sorted({v for v in vals if vals.count(v) == m})

    want = {}
    for i in range(60):
        vals = [(r, x) for j, r, x in rows if j == i]
        base = top([x for _, x in vals])
        want[i] = any(top([x for r2, x in vals if r2 != r]) != base for r, _ in vals)
    df = spark.createDataFrame(rows, "item int, rater string, v string")
    assert {r["item"]: r["unstable"] for r in A.leave_one_out(df, ["item"], "rater", "v").collect()} == want


def test_degenerate_kappa(spark):
    df = spark.createDataFrame([(i, r, "YES") for i in range(9) for r in range(3)], "item int, rater int, v string").withColumn("g", F.lit(1))
    assert one(A.fleiss(df, ["g"], ["item"], "v"))["kappa"] is None
    assert one(A.fleiss(df, ["g"], ["item"], "v", degenerate=1.0))["kappa"] == 1.0


# --- streams -----------------------------------------------------------------


def test_prefix_states_equal_a_loop():
    rows, maps = W.transition_maps(L.TRANSITIONS, L.STATES)
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 17, 200):
        events = [rnd.choice([*L.TRANSITIONS, "unknown"]) for _ in range(n)]
        state, want = "NONE", ["NONE"]
        for e in events:
            target, sources = L.TRANSITIONS.get(e, (None, ()))
            state = target if state in sources else state
            want.append(state)
        got = W.prefix_states(np.array([rows.get(e, len(maps) - 1) for e in events], np.int64), maps, 0)
        assert [L.STATES[i] for i in got] == want


def test_lifecycle_processor_works_on_plain_rows():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    event = Row("id", "event_type")
    p = W.LifecycleProcessor(0, L.TRANSITIONS, L.STATES, L.IN_PROGRESS)
    p.value = Value()
    first = list(p.handleInputRows((7,), iter([event(3, "started"), event(1, "created"), event(2, None)]), None))
    assert [tuple(r) for r in first] == [(7, 1, "created", True, "PENDING", False), (7, 2, None, False, "PENDING", False), (7, 3, "started", True, "RUNNING", False)]
    second = list(p.handleInputRows((7,), iter([event(4, "failed"), event(2, "created")]), None))
    assert [tuple(r) for r in second] == [(7, 2, "created", False, "RUNNING", True), (7, 4, "failed", True, "FAILED", False)]
    assert p.value.held == ("FAILED", 4, 1)


def test_stuck_row_after_the_timer_and_late_ids(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "evaluation_id long, id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, 10, "created"), (1, 11, "started"), (2, 12, "created")])
    stream = W.read_events(spark, str(tmp_path / "in"), "*.parquet", spark.read.parquet(str(tmp_path / "in")).schema, 1)
    q = W.lifecycle_stream(stream, idle_ms=1500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "chk")).trigger(processingTime="200 milliseconds").start()
    schema = "evaluation_id long, id long, event_type string, accepted boolean, state string, late boolean"

    def rows():
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []

    def wait(done):
        until = time.monotonic() + 90
        while not done() and time.monotonic() < until:
            time.sleep(0.3)
        assert done(), rows()

    try:
        wait(lambda: any(r[2] == "stuck" for r in rows()))
        put([(1, 5, "failed"), (1, 13, "probes_completed"), (2, 14, "failed")])
        wait(lambda: len(rows()) >= 7)
    finally:
        q.stop()
    got = rows()
    assert (1, 11, "stuck", False, "RUNNING", False) in got and (1, 5, "failed", False, "RUNNING", True) in got
    assert (1, 13, "probes_completed", True, "PROBES_COMPLETED", False) in got and (2, 14, "failed", False, "PENDING", False) in got
    assert not any(r[0] == 2 and r[2] == "stuck" for r in got)  # a pending evaluation is not in progress


def test_mean_interval_of_many_distinct_values(spark):
    """Two-level draws: bounds follow the normal law, and no array is longer than a block."""
    n, b = 120_000, 400
    df = spark.range(n).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("x"))
    row = one(U.mean_ci(df, ["k"], "x", b, seed=7))
    stats = one(df.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")))
    half = 1.96 * stats["s"] / math.sqrt(n)
    assert row["n"] == n and abs(row["mean"] - stats["m"]) < 1e-6
    assert abs(row["ci_lower"] - (stats["m"] - half)) < 0.3 * half and abs(row["ci_upper"] - (stats["m"] + half)) < 0.3 * half
    cells = df.groupBy("k", F.col("x").alias("value")).agg(F.count("*").alias("n"))
    longest = U._block_cells(cells, ["k"], 4096).agg(F.max(F.size("_values")).alias("m"), F.count("*").alias("blocks"))
    assert one(longest)["m"] < 2 * 4096 and one(longest)["blocks"] > 20


def test_replicate_sums_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", float(i % 37), 1 + i % 3) for i in range(37)] + [(None, 2.0, 5)], "k string, value double, n long")
    told = lambda x: sorted(((r["k"] or "", r["b"], r["total"]) for r in U.replicate_sums(x, ["k"], 30, 1, block=8, step=7).collect()))
    a = told(df)
    assert len(a) == 60 and {t for k, _, t in a if k == ""} == {10.0}
    assert [(k, b, round(t, 6)) for k, b, t in told(df.repartition(5))] == [(k, b, round(t, 6)) for k, b, t in a]


# --- probe registry ----------------------------------------------------------


def audit_inputs(spark):
    rnd = random.Random(9)
    rows = [(e, rnd.choice("ab"), y, y if rnd.random() < 0.9 else 1 - y, y if rnd.random() < 0.8 else 1 - y, int(rnd.random() < 0.3))
            for e in ("e1", "e2", "e3") for y in (rnd.randint(0, 1) for _ in range(300))]
    rows = spark.createDataFrame(rows, "e string, grp string, label int, y_hat int, y_robust int, severe int")
    cards = spark.createDataFrame([(e, "m/x", "a" * 40, ["f"], ["f"], "# T\nsome text", "mit", None, None) for e in ("e1", "e2", "e4")],
                                  "e string, model_ref string, revision string, files array<string>, live_files array<string>, card_text string, license string, reference_hash string, local_hash string")
    return rows, cards


def test_a_sixth_probe_and_side_inputs(spark):
    rows, cards = audit_inputs(spark)
    checks = spark.createDataFrame([("e1", 0.5, 1.0, False, False), ("e2", 1.0, 1.0, True, False)],
                                   "e string, label_fraction double, coverage double, domain_mismatch boolean, allow_mismatch boolean")
    artifacts = spark.createDataFrame([("e1", "MISMATCH")], "e string, artifact_status string")
    leaks = spark.createDataFrame([("e1", 3), ("e2", 0)], "e string, n int")

    def privacy(x):
        found = F.col("n") > 0
        return P.verdict_row(x.extra["leaks"], x.by, "PRIVACY", probe_status=F.lit("EVALUATED"), has_checks=F.lit(True),
                             aspect_scoring=F.when(found, "risk_detected").otherwise("no_material_risk"), risks=C.reasons((found, "P-LEAK")))

    probes = P.with_probe(P.PROBES, P.Probe("PRIVACY", privacy, ("leaks",)), before="SAFETY")
    assert [p.dimension for p in probes] == ["FAIRNESS", "ROBUSTNESS", "INTEGRITY", "EXPLAINABILITY", "PRIVACY", "SAFETY"]
    got = {(r["e"], r["dimension"]): r for r in P.verdicts(rows, cards, "e", probes=probes, checks=checks, artifacts=artifacts, extra={"leaks": leaks}).collect()}
    assert len(got) == 4 * 6
    assert got["e1", "PRIVACY"]["risks"] == ["P-LEAK"] and got["e2", "PRIVACY"]["risks"] == [] and got["e4", "PRIVACY"]["failed_gates"] == [P.NO_INPUT]
    assert got["e1", "ROBUSTNESS"]["failed_gates"][0] == "G-ROB-LABEL-COMPAT" and got["e2", "ROBUSTNESS"]["failed_gates"][0] == "G-ROB-DOMAIN"
    assert got["e1", "INTEGRITY"]["artifact_status"] == "MISMATCH" and got["e2", "INTEGRITY"]["artifact_status"] is None
    plain = {(r["e"], r["dimension"]): r for r in P.verdicts(rows, cards, "e", probes=probes).collect()}
    assert plain["e1", "PRIVACY"]["failed_gates"] == [P.NO_INPUT]  # its table was not given, so it did not run
    assert plain["e1", "FAIRNESS"]["probe_status"] == got["e1", "FAIRNESS"]["probe_status"]


def test_the_registry_refuses_what_is_no_probe(spark):
    with pytest.raises(ValueError, match="registered already"):
        P.with_probe(P.PROBES, P.Probe("SAFETY", P.safety_probe))
    rows, cards = audit_inputs(spark)
    odd = P.with_probe(P.PROBES, P.Probe("ODD", lambda x: x.models.select("e")))
    with pytest.raises(ValueError, match="verdict columns"):
        P.verdicts(rows, cards, "e", probes=odd)


def test_bucketwise_reconciliation_misses_nothing(spark):
    rnd = random.Random(6)
    left = [(i, None if i % 50 == 3 else rnd.uniform(-5, 5)) for i in range(600)] + [(9001, float("nan")), (9002, 1.0)]
    right = [(i, x if x is None or i % 40 else x + rnd.choice([-1, 1]) * rnd.uniform(0.02, 2)) for i, x in left[5:-2]] + [(9001, float("nan")), (None, 2.0)]
    a, b = spark.createDataFrame(left, "k int, x double"), spark.createDataFrame(right, "k int, x double")
    told = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert told(Q.reconcile_buckets(a, b, ["k"], "x", 0.01, 64)) == told(Q.reconcile(a, b, ["k"], "x", 0.01))
    assert told(Q.reconcile_buckets(a, b, ["k"], "x", 0, 64)) == told(Q.reconcile(a, b, ["k"], "x", 0))
    assert Q.differing_buckets(a, a, ["k"], "x", 0.01).count() == 0


def test_replay_with_a_transition_table_of_its_own(spark):
    rnd = random.Random(8)
    events = [(e, i, rnd.choice([*L.ASSISTED_TRANSITIONS, "other"])) for e in range(4) for i in range(300)]
    events += [(9, i, n) for i, n in enumerate(["created", "started", "probes_completed", "agent_completed", "awaiting_review", "finalized"])]
    want = {}
    state = {}
    for e, i, name in events:
        target, sources = L.ASSISTED_TRANSITIONS.get(name, (None, ()))
        now = state.get(e, "NONE")
        state[e] = target if now in sources else now
        want[e, i] = (now in sources, state[e])
    df = spark.createDataFrame(events, "e int, id long, event_type string").repartition(3)
    rows = L.replay_status(df, ["e"], block=32, span=3, legal=L.ASSISTED_TRANSITIONS, states=L.ASSISTED_STATES).collect()
    assert {(r["e"], r["id"]): (r["accepted"], r["state"]) for r in rows} == want
    last = L.final_states(df, ["e"], block=32, span=3, legal=L.ASSISTED_TRANSITIONS, states=L.ASSISTED_STATES).collect()
    assert {r["e"]: r["state"] for r in last} == state and state[9] == "FINALIZED"
