"""Packing by cutting stock.

Documents are cut at multiples of the sequence length; what remains of each is an item of a cutting-stock problem over
the histogram of lengths. A linear program over patterns is solved by column generation: a knapsack by dynamic
programming prices new patterns. Rounded-down patterns are laid out one after the other, and the documents of a length,
ranked by hash and id, take the places that the patterns have for it.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import inverse, stash

SEQUENCE = 2048
END_ID = 1
#: Lengths are ranked within so many lots each, so that a frequent length is many tasks.
LOTS = 64


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder(dict):
    """Piece of text -> its token ids as little-endian 32-bit words.

    A text is cut before single spaces between ink, where no token of this vocabulary's split pattern crosses; pieces
    repeat, so most are looked up. Texts with other white space before a space, and those that hold a special token,
    are encoded whole.
    """

    LIMIT = 400_000

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in model.get("added_tokens", ())]
        split_pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in signs)}
        added = set(self.special)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        self.pieces = tiktoken.Encoding("pieces", pat_str=split_pattern, mergeable_ranks=ranks, special_tokens={})
        self.hard = re.compile(r"\s ")

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.pieces.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= 32:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.hard.search(text):
            return np.array(self.pieces.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + x] for x in rest])


@lru_cache(2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, lot int"


def _cutter(path: str | None, sequence: int, end_id: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or vocabulary())
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = own.ids(text or "") + tail
                n = len(ids) // 4
                lot = zlib.crc32(ids) % LOTS
                for start in range(0, n, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    for c, v in zip(cols, (row, start, len(piece) // 4, zlib.crc32(piece), n, lot)):
                        c.append(v)
            take = b.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([take] + [pa.array(c, k) for c, k in zip(cols[1:], kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"])

    return run


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids, the end id included: full sequences, then what remains. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_cutter(path, sequence, end_id), f"doc_id {kind}, {_PIECE}")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The set of lengths, repeats allowed, of the greatest price within ``capacity``."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int) - 1
    useful = np.flatnonzero(prices > 1e-12)
    sizes, worth = lengths[useful], prices[useful]
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes, c, side="right")
        best[c], last[c] = best[c - 1], -1
        if k:
            v = best[c - sizes[:k]] + worth[:k]
            j = int(np.argmax(v))
            if v[j] > best[c] + 1e-15:
                best[c], last[c] = v[j], j
    out, c = Counter(), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[int(sizes[last[c]])] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), out


def _greedy(need: dict[int, float], capacity: int) -> list[tuple[Counter, float]]:
    """First fit by falling length, in whole patterns: each is used until one of its lengths runs out, so there are as
    many patterns as lengths, each with its own that ran out."""
    left, out = dict(need), []
    while left:
        room, pattern = capacity, Counter()
        for x in sorted(left, reverse=True):
            if room >= x:
                pattern[x] = room // x
                room -= pattern[x] * x
        times = min(left[x] / n for x, n in pattern.items())
        gone = [x for x, n in pattern.items() if left[x] <= n * times * (1 + 1e-9)]
        out.append((pattern, times))
        out += [(Counter({x: capacity // x}), 0.0) for x in gone[1:]]
        for x, n in pattern.items():
            left[x] -= n * times
        for x in gone:
            del left[x]
    return out


def patterns(histogram: dict[int, int], capacity: int, rounds: int = 1500, gap: float = 1e-3) -> list[tuple[Counter, float]]:
    """(pattern, how often) of a linear program that covers the histogram with few sequences.

    Revised simplex from a greedy start: the basis has one pattern per length, prices are its dual solution, and the
    knapsack gives the pattern that enters. It ends when no pattern is worth more than 1 + ``gap`` of a sequence, so the
    total is within ``gap`` of the best, or after ``rounds`` patterns. Its size depends on the number of lengths, not of
    documents.
    """
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    row = {int(x): i for i, x in enumerate(lengths)}

    def column(pattern: Counter) -> np.ndarray:
        c = np.zeros(len(lengths))
        for x, n in pattern.items():
            c[row[x]] = n
        return c

    basis = [p for p, _ in _greedy({int(x): float(n) for x, n in zip(lengths, need)}, capacity)]
    undo = inverse(np.array([column(p) for p in basis]).T)
    use = np.maximum((undo * need).sum(axis=1), 0.0)
    for _ in range(rounds):
        value, entering = _knapsack(lengths, np.maximum(undo.sum(axis=0), 0.0), capacity)
        if value <= 1 + gap:
            break
        d = (undo * column(entering)).sum(axis=1)
        ratio = np.where(d > 1e-9, use / np.where(d > 1e-9, d, 1.0), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        use = np.maximum(use - step * d, 0.0)
        use[out] = step
        pivot = undo[out] / d[out]
        undo -= d[:, None] * pivot
        undo[out] = pivot
        basis[out] = entering
    return [(p, float(u)) for p, u in zip(basis, use) if u > 1e-9]


def _take(left: Counter, stock: list[int], room: int) -> Counter:
    """The longest items of ``stock`` (lengths, falling) that fit ``room`` one after the other."""
    chosen: Counter = Counter()
    for x in stock:
        n = min(left[x], room // x)
        if n:
            chosen[x] = n
            room -= n * x
    return chosen


def plan(histogram: dict[int, int], capacity: int, classes: int = 128) -> list[tuple[Counter, int]]:
    """(pattern over exact lengths, how often) that places every item of the histogram exactly once.

    The linear program sees lengths rounded up to ``classes`` steps, which bounds its size. Each pattern is used as
    often as its rounded-down value; its places take the longest items of the class, equal fillings in a row being one
    entry. What is left, a few items per class, goes by best fit. Items below three steps stay out of the program and
    fill the room that is left in sequences, the fullest first.
    """
    step = max(1, capacity // classes)
    up = lambda x: -(-x // step)
    small = {x for x in histogram if x < 3 * step} if capacity >= 8 * classes else set()
    left = Counter({x: n for x, n in histogram.items() if n})
    rough: Counter = Counter()
    stock: dict[int, list[int]] = {}
    for x in sorted(left, reverse=True):
        if x not in small:
            rough[up(x)] += left[x]
            stock.setdefault(up(x), []).append(x)
    out: list[tuple[Counter, int]] = []
    for pattern, use in sorted(patterns(dict(rough), capacity // step) if rough else [], key=lambda p: sorted(p[0].items())):
        times = int(use + 1e-9)
        while times > 0:
            chosen: Counter = Counter()
            for c, n in pattern.items():
                for x in stock.get(c, ()):
                    take = min(n, left[x])
                    if take:
                        chosen[x] += take
                        n -= take
                    if not n:
                        break
            if not chosen:
                break
            # the same filling holds until one of its lengths runs short
            again = min(times, min(left[x] // n for x, n in chosen.items()))
            for x, n in chosen.items():
                left[x] -= n * again
            out.append((chosen, again))
            times -= again
    out += _best_fit(left, [x for x in left if x not in small], capacity)
    size = lambda p: sum(x * n for x, n in p.items())
    fillers, done = sorted(small, reverse=True), []
    for pattern, times in sorted(out, key=lambda e: -size(e[0])):
        while times:
            more = _take(left, fillers, capacity - size(pattern))
            again = min([times, *(left[x] // n for x, n in more.items())])
            for x, n in more.items():
                left[x] -= n * again
            done.append((pattern + more, again))
            times -= again
    while any(left[x] for x in fillers):
        more = _take(left, fillers, capacity)
        again = min(left[x] // n for x, n in more.items())
        for x, n in more.items():
            left[x] -= n * again
        done.append((more, again))
    return done


def _best_fit(left: Counter, lengths: list[int], capacity: int) -> list[tuple[Counter, int]]:
    """Items of ``lengths``, falling, each into the sequence with the least room that takes it."""
    open_at: list[tuple[int, Counter]] = []
    for x in sorted(lengths, reverse=True):
        for _ in range(left[x]):
            i = bisect_left(open_at, x, key=lambda o: o[0])
            room, content = open_at.pop(i) if i < len(open_at) else (capacity, Counter())
            content[x] += 1
            insort(open_at, (room - x, content), key=lambda o: o[0])
        left[x] = 0
    return [(content, 1) for _, content in open_at]


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has at least its end id; null and empty texts are that id alone. Repeated and null doc_ids are rows
    like any other; an empty table gives an empty result. Pieces are written once to the shared folder. The histogram,
    at most ``sequence`` - 1 lengths, comes to the driver; the layout that goes back has a row for each length of each
    pattern. Within a length, documents are ranked by lot, id, checksum and start; lots keep a frequent length apart.
    """
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, sequence, end_id))
    full = cut.where(F.col("length") == sequence)
    rest = cut.where(F.col("length") < sequence)
    counts = {(r["length"], r["lot"]): r["n"] for r in rest.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram: Counter = Counter()
    for (length, _), n in counts.items():
        histogram[length] += n
    layout, sequences = _layout(plan(dict(histogram), sequence))
    before, seen = [], Counter()
    for (length, lot), n in sorted(counts.items()):
        before.append((length, lot, seen[length]))
        seen[length] += n
    in_lot = Window.partitionBy("length", "lot").orderBy("doc_id", "ids_crc32", "start", "doc_tokens")
    starts = spark.createDataFrame(before, "length long, lot int, before long")
    ranked = rest.withColumn("rank", F.row_number().over(in_lot)).join(F.broadcast(starts), ["length", "lot"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank") - 1)
    return _placed(spark, ranked, layout).unionByName(_alone(full, sequences))


def _layout(planned: list[tuple[Counter, int]]) -> tuple[list[tuple], int]:
    """Rows (length, first rank, end rank, places in a sequence, first sequence, first offset) and the number of sequences."""
    rows, used, seq = [], Counter(), 0
    for pattern, times in planned:
        at = 0
        for x, n in sorted(pattern.items(), reverse=True):
            rows.append((x, used[x], used[x] + n * times, n, seq, at))
            used[x] += n * times
            at += n * x
        seq += times
    return rows, seq


def _placed(spark: SparkSession, ranked: DataFrame, layout: list[tuple]) -> DataFrame:
    """Give each ranked piece its sequence and offset: the layout's ranges of a length, in one row, are searched."""
    table = spark.createDataFrame(layout, "length long, low long, high long, places long, first long, at long")
    ranges = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "places", "first", "at"))).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn(
        "own", F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0])
    place = F.col("rank") - F.col("own.low")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("own.first") + F.floor(place / F.col("own.places"))).cast("long").alias("sequence_id"),
        (F.col("own.at") + (place % F.col("own.places")) * F.col("length")).cast("long").alias("offset"))


def _alone(full: DataFrame, first: int) -> DataFrame:
    """Full pieces: a sequence each, numbered on from ``first`` by lot."""
    counts = {r["lot"]: r["n"] for r in full.groupBy("lot").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, total = [], first
    for lot in sorted(counts):
        rows.append((lot, total))
        total += counts[lot]
    starts = full.sparkSession.createDataFrame(rows, "lot int, before long")
    rank = F.row_number().over(Window.partitionBy("lot").orderBy("doc_id", "ids_crc32", "start", "doc_tokens"))
    return full.withColumn("rank", rank).join(F.broadcast(starts), "lot").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank") - 1).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
