"""How filters interact: what each order of filters removes, and what each filter alone is worth.

Every part (source) and filter has a sorted posting list of the documents that fail. Lists are kept by ranges of document
ids: a task reads one range in id order, numbers its rows, and cuts them into blocks of bounded size. In a block the union
of any earlier filters is a merge of their lists, and what the next filter removes is its list without that union. Both
merges gallop: the ids of the shorter list are searched in the longer one, and the runs between hits are copied whole.
Only list sizes leave a block; they are summed per part.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of

FILTERS = "ABCDE"
#: Rows of a block; a block's lists hold at most five entries a row.
BLOCK_ROWS = 1 << 17
_CAPITALS, _MARKS = bytes(range(65, 91)), re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """Bits 0 to 3: filters A to D that the text fails. Words stand between the white space of ASCII."""
    words = text.split()
    chars = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * chars) << 2
            | bool(_MARKS.search(text)) << 3)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("doc_id"), pa.array([failures(t) for t in texts], pa.int32()),
             pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())], ["part", "doc_id", "fails", "digest"])


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Merge of sorted lists without repetition, the longest first; each shorter one is searched and its new ids inserted."""
    out = np.empty(0, np.int64)
    for ids in sorted(lists, key=len, reverse=True):
        at = np.searchsorted(out, ids)
        known = np.zeros(len(ids), bool)
        inside = at < len(out)
        known[inside] = out[at[inside]] == ids[inside]
        out = np.insert(out, at[~known], ids[~known])
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ids that both sorted lists hold; the shorter list is searched in the longer one."""
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        inside = np.flatnonzero(at < len(b))
        return inside[b[at[inside]] == a[inside]]
    at = np.searchsorted(a, b)
    inside = at < len(a)
    at, b = at[inside], b[inside]
    return at[a[at] == b]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.delete(a, common(a, b))


def block_sizes(lists: list[np.ndarray], weights: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(filter, earlier filters as bits, removed, good, toxic) for every filter and set of earlier ones that removes anything.

    Lists hold row numbers; a row's weight is the number of equal rows it stands for.
    """
    for earlier in range(1 << len(lists)):
        gone = union([ids for f, ids in enumerate(lists) if earlier >> f & 1])
        for f, ids in enumerate(lists):
            if not earlier >> f & 1:
                out = difference(ids, gone)
                if len(out):
                    yield f, earlier, int(weights[out].sum()), *(int(weights[out[common(out, x)]].sum()) for x in (good, toxic))


_SIZES = pa.schema([("part", pa.string()), *((n, pa.int64()) for n in ("filter", "earlier", "removed", "good", "toxic"))])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of id, a label row before its documents: sizes per part and block; filter -1 counts all documents."""
    label_id, label, held = object(), (False, False), []

    def close():
        out, parts = [], {}
        for number, (part, *_) in enumerate(held):
            parts.setdefault(part, []).append(number)
        fails, weights, good, toxic = (np.array([r[k] for r in held]) for k in (1, 2, 3, 4))
        for part, rows in parts.items():
            rows = np.array(rows, np.int64)
            lists = [rows[fails[rows] >> f & 1 == 1] for f in range(len(FILTERS))]
            out.append((part, -1, 0, int(weights[rows].sum()), 0, 0))
            out += [(part, *x) for x in block_sizes(lists, weights, rows[good[rows]], rows[toxic[rows]])]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SIZES)], schema=_SIZES)

    for b in batches:
        for doc_id, part, fails, n, good, toxic in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "fails", "n", "good", "toxic"))):
            if part is None:
                label_id, label = doc_id, (good, toxic)
            else:
                held.append((part, fails, n, *(label if doc_id == label_id and doc_id is not None else (False, False))))
                if len(held) >= BLOCK_ROWS:
                    yield close()
    if held:
        yield close()


def posting_sizes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter, earlier, removed, good, toxic: sizes of lists, summed over all ranges of ids."""
    rows = documents.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", text_of().alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    facts = stash(rows.mapInArrow(_facts, f"part string, doc_id {kind}, fails int, digest binary"))
    # the first id of each text passes E; the pair (id, text) is a key without hot values
    first = facts.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    counted = facts.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    repeated = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    lists = counted.join(first, ["doc_id", "digest"], "left").select(
        "doc_id", "part", (F.col("fails") + F.when(repeated, 1 << 4).otherwise(0)).alias("fails"), "n").groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(None)
    both = lists.select("doc_id", "part", "fails", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")).unionByName(
        known.select("doc_id", no.cast("string").alias("part"), no.cast("int").alias("fails"), no.cast("long").alias("n"), "good", "toxic"))
    ordered = both.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "part", "fails")
    sizes = ordered.mapInArrow(_lists, "part string, filter long, earlier long, removed long, good long, toxic long")
    return sizes.groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps, removes, and what it would remove elsewhere.

    A null text is empty, a null source the empty part. A null id is smaller than none and has no label, so it neither
    fails E nor makes another row fail it; equal ids fail E only against a smaller id. Labels of a repeated id count if
    any row has them; null labels count as neither. No document gives no row. Other columns of both tables are not read.
    """
    n = len(FILTERS)
    entry = F.struct((F.col("filter") * 32 + F.col("earlier")).cast("int").alias("k"), F.struct("removed", "good", "toxic").alias("v"))
    # at most 81 entries a part
    lists = posting_sizes(documents, labels).groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("removed", "good", "toxic")])

    def size(f, earlier):
        return F.coalesce(F.element_at("m", (f * 32 + earlier).cast("int")), none)

    # flat arrays of every (filter, earlier) take the place of the map before the orders are listed
    flat = lists.select("part", F.element_at("m", F.lit(-32)).alias("_all"), F.array(*[size(F.lit(f), F.lit(e)) for f in range(n) for e in range(1 << n)]).alias("s"))
    total = F.col("_all")["removed"]

    def at(f, earlier):
        return F.get("s", f * 32 + earlier)

    worth = F.array(*[sum((at(F.lit(f), F.lit(e))["removed"] * (math.factorial(e.bit_count()) * math.factorial(n - 1 - e.bit_count()))
                           for e in range(1 << n) if not e >> f & 1), F.lit(0).cast("long")) for f in range(n)])
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            steps.append(f"{''.join(FILTERS[x] for x in order)} {step + 1} {f} {before}")
            before |= 1 << f
    # the list of steps is a constant; `kept` is a running difference, so the filters before a step are summed from its order
    row = F.explode(F.split(F.lit(";".join(steps)), ";"))
    told = flat.select("part", "s", total.alias("_n"), worth.alias("_worth"), row.alias("_r")).select(
        "*", F.split("_r", " ").alias("_x")).select("part", "s", "_n", "_worth", F.get("_x", F.lit(0)).alias("filter_order"),
                                                    *[F.get("_x", F.lit(k)).cast("int").alias(c) for k, c in ((1, "step"), (2, "_f"), (3, "_e"))])
    failing, now = at(F.col("_f"), F.lit(0))["removed"], at(F.col("_f"), F.col("_e"))
    gone = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("g")), lambda a, k: _next(a, k, at))["g"]
    return told.select(
        "part", "filter_order", "step", F.substr("filter_order", F.col("step"), F.lit(1)).alias("filter"), (F.col("_n") - gone).alias("kept"), now["removed"].alias("removed"),
        (failing - now["removed"]).alias("redundant"), at(F.col("_f"), F.lit((1 << n) - 1) - _bit(F.col("_f")))["removed"].alias("unique_fails"),
        now["good"].alias("good_lost"), now["toxic"].alias("toxic_lost"), F.get("_worth", F.col("_f")).alias("shapley"))


def _bit(f):
    return F.get(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), f)


def _next(a, k, at):
    f = F.ascii(F.substr("filter_order", k, F.lit(1))) - F.lit(ord(FILTERS[0]))
    return F.struct((a["e"] + _bit(f)).alias("e"), (a["g"] + at(f, a["e"])["removed"]).alias("g"))
