"""Benchmark decontamination with suffix arrays of the training texts.

Each batch of training texts is a shard: its words become codes of the benchmark's vocabulary, the suffixes that can
begin a match are sorted, and every suffix of every benchmark item is binary-searched there. A range of equal suffixes
gives all places; comparing on from there gives the longest verbatim match of each place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import slices, split

WINDOW = 10
#: Benchmark texts are broadcast in blocks of at most so many bytes; a block costs one pass inside the same job.
BLOCK_BYTES = 32_000_000


@dataclass
class TestItems:
    """A block of benchmark items: ids, and their words as codes 1.. of the sorted word hashes ``vocabulary``."""

    ids: list
    codes: list[bytes]
    vocabulary: np.ndarray
    window: int

    @staticmethod
    def of(ids: list, texts: list, window: int = WINDOW) -> "TestItems":
        hashes: list[np.ndarray] = []
        for _, data, off in slices(pa.array(texts, pa.string())):
            w = split(data, off)
            hashes += np.split(w.hash, w.first[1:-1])
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        codes = [(np.searchsorted(vocabulary, h) + 1).astype(">u4").tobytes() for h in hashes]
        keep = [i for i, c in enumerate(codes) if c]
        return TestItems([ids[i] for i in keep], [codes[i] for i in keep], vocabulary, window)

    def widths(self) -> list[int]:
        """Window length of each item in words."""
        return [min(self.window, len(c) // 4) for c in self.codes]


def shard_matches(hashes: np.ndarray, doc: np.ndarray, items: TestItems) -> list[tuple[int, int, int, int]]:
    """(first word, number of words, item index, first word in the item): the longest verbatim match from each place
    where a window of an item occurs. Places are word numbers of the shard.

    Words outside the vocabulary can't be in a match, so suffixes start only in runs of known words that are long
    enough, and don't cross texts.
    """
    if not len(items.ids) or not len(hashes):
        return []
    at = np.searchsorted(items.vocabulary, hashes)
    at[at == len(items.vocabulary)] = 0
    known = items.vocabulary[at] == hashes
    code = np.where(known, at + 1, 0)
    widths = items.widths()
    least = min(widths)
    # length of the run of known words of one text that begins at each word
    n = len(code)
    stop = np.flatnonzero(~known | np.append(doc[1:] != doc[:-1], True))
    # a known last word of a text ends its run behind itself, an unknown word ends it before itself
    ends = np.where(known[stop], stop + 1, stop)
    run = ends[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    starts = np.flatnonzero(known & (run >= least))
    if not len(starts):
        return []
    raw = code.astype(">u4").tobytes()
    depth = max(len(c) for c in items.codes) // 4
    suffixes = sorted((raw[4 * s : 4 * (s + min(r, depth))], s) for s, r in zip(starts.tolist(), run[starts].tolist()))
    keys = [k for k, _ in suffixes]
    found = []
    for i, (c, width) in enumerate(zip(items.codes, widths)):
        for p in range(0, len(c) - 4 * width + 4, 4):
            test = c[p:]
            low = bisect_left(keys, test[: 4 * width])
            high = bisect_left(keys, test[: 4 * width] + b"\xff\xff\xff\xff", low)
            for k, s in suffixes[low:high]:
                most = min(len(k), len(test))
                length = 4 * width
                if k[:most] == test[:most]:
                    length = most
                else:
                    while k[length : length + 4] == test[length : length + 4]:
                        length += 4
                found.append((s, length // 4, i, p // 4))
    return found


_HITS = "array<struct<item:string,doc_word:bigint,item_word:bigint,words:bigint>>"
_HIT = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            t = b.schema.get_field_index("__s_text")
            lists, counts = b.column(b.schema.get_field_index("__s_hits")).to_pylist(), []
            for first, data, off in slices(b.column(t)):
                w = split(data, off)
                counts.append(w.counts)
                for s, length, i, p in shard_matches(w.hash, w.doc, items):
                    d = int(w.doc[s])
                    lists[first + d] = (lists[first + d] or []) + [{"item": str(items.ids[i]), "doc_word": int(s - w.first[d]), "item_word": p, "words": length}]
            cols = {f.name: b.column(j) for j, f in enumerate(b.schema)}
            cols["__s_hits"] = pa.array(lists, _HIT)
            cols["__s_words"] = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[TestItems]:
    """The benchmark in blocks of bounded size, so that each broadcast has a bound whatever the benchmark's size."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        if size and size + len(r["t"]) * 4 > block_bytes:
            yield TestItems.of(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"]) * 4
    yield TestItems.of(ids, texts, window)


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``__s_words`` (number of words) and ``__s_hits`` (longest matches: item, word of the
    document, word of the item, number of words).

    A match has ``window`` words, or all words of an item that has fewer; items without words match nothing. Rows are
    searched where they are: no shuffle, and a row's text is held once. Null and empty texts have no words.
    """
    own = docs.columns
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("__s_row"), F.coalesce(F.col(text), F.lit("")).alias("__s_text"),
        F.lit(None).cast(_HITS).alias("__s_hits"), F.lit(0).cast("long").alias("__s_words"))
    for block in blocks(benchmark, window=window, block_bytes=block_bytes):
        df = df.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block)), df.schema)
    return df.select("__s_row.*", "__s_words", "__s_hits")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit, items, digest = [], [], []
        for hits in b.column(2).to_pylist():
            spans = sorted((h["doc_word"], h["doc_word"] + h["words"]) for h in hits or ())
            total, reach = 0, 0
            for s, e in spans:
                total += max(0, e - max(s, reach))
                reach = max(reach, e)
            own = sorted({h["item"] for h in hits or ()})
            hit.append(total)
            items.append(len(own))
            digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated.

    Repeated items count once by id. Repeated and null doc_ids are rows like any other; empty tables give no hits or an
    empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = search(docs.select("doc_id", "text"), benchmark, window=window).select("doc_id", F.col("__s_words").alias("n_words"), "__s_hits")
    return found.mapInArrow(_covered, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any match, with the columns of ``docs``."""
    found = search(docs, benchmark, window=window)
    return found.where(F.coalesce(F.size("__s_hits"), F.lit(0)) <= 0).drop("__s_words", "__s_hits")
