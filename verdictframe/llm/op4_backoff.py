"""Stupid-backoff scores of documents against the rest of the corpus.

Documents are dealt to blocks by hash. A block asks for the corpus counts of its distinct n-grams; the questions are
dealt to hash ranges of n-grams, which hold the count table; each range answers every block; and a block joins the
answers to the n-grams of its documents and sums per document. Questions are counted per block first, so a frequent
n-gram is one entry per block, and n-grams travel sorted and packed instead of one row each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, total_bytes
from .wordhash import ALNUM, U, grams, mix, slices, split

ORDER = 2
ALPHA = 0.4
#: Bytes of text in a block. Large corpora take larger blocks, as blocks times ranges is the number of messages.
BLOCK_BYTES = 6_000_000


def block_bytes(total: int) -> int:
    return max(BLOCK_BYTES, int(math.sqrt(512.0 * total)))


def pack_sorted(h: np.ndarray) -> bytes:
    """Distinct sorted hashes as gaps of as many bytes as the widest needs: the width, the first hash, the gaps."""
    if not len(h):
        return b""
    gaps = np.diff(h)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + h[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    width, rest = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    gaps = np.zeros((len(rest) // width, 8), np.uint8)
    gaps[:, :width] = rest.reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), gaps.reshape(-1).view("<u8")]), dtype=U)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts by byte planes, so that the empty high bytes of small counts compress away."""
    return n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)


class _Grams:
    """n-grams of a block's texts. ``ends[n]``: positions (numbers of words in the block) where an n-gram ends;
    ``ids[n]``: its index in ``distinct``."""

    def __init__(self, texts: pa.ChunkedArray, order: int) -> None:
        doc, words, hashes, ends, base, first = [], 0, [[] for _ in range(order)], [[] for _ in range(order)], 0, 0
        for first, data, off in slices(texts):
            w = split(data, off, kind=ALNUM)
            doc.append(w.doc + first)
            for n in range(1, order + 1):
                at, h = grams(w, n)
                hashes[n - 1].append(mix(h + U(n)))
                ends[n - 1].append(at + n - 1 + base)
            base += len(w.hash)
        self.texts = len(texts)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ends]
        flat = [np.concatenate(x) if x else np.zeros(0, U) for x in hashes]
        self.distinct, ids, self.counts = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
        self.ids = np.split(ids, np.cumsum([len(x) for x in flat])[:-1])

    def bounds(self, ranges: int) -> np.ndarray:
        """Where each hash range begins in ``distinct``."""
        edges = [(i << 64) // ranges for i in range(1, ranges)]
        return np.concatenate([[0], np.searchsorted(self.distinct, np.array(edges, dtype=U)), [len(self.distinct)]])


_ASK = "range int, block long, words long, grams binary, counts binary"
_ANSWER = "block long, range int, words long, totals binary"


def _asker(order: int, ranges: int):
    def ask(key, docs):
        g = _Grams(docs.column("text"), order)
        cut = g.bounds(ranges)
        parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({
            "range": pa.array(range(ranges), pa.int32()), "block": pa.array([key[0].as_py()] * ranges, pa.int64()), "words": pa.array([len(g.doc)] * ranges, pa.int64()),
            "grams": pa.array([pack_sorted(g.distinct[p]) for p in parts], pa.binary()), "counts": pa.array([pack_counts(g.counts[p]) for p in parts], pa.binary())})

    return ask


def _answer(key, asked):
    """The count table of one hash range, looked up for every block: each sends a row, so words add up to the corpus."""
    hashes = [unpack_sorted(x) for x in asked.column("grams").to_pylist()]
    counts = [unpack_counts(x) for x in asked.column("counts").to_pylist()]
    distinct, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(ids, weights=np.concatenate(counts).astype(float), minlength=len(distinct)).astype(np.int64)
    words = sum(asked.column("words").to_pylist())
    answers = np.split(total[ids], np.cumsum([len(h) for h in hashes])[:-1])
    n = len(hashes)
    return pa.table({
        "block": asked.column("block"), "range": pa.array([key[0].as_py()] * n, pa.int32()), "words": pa.array([words] * n, pa.int64()),
        "totals": pa.array([pack_counts(a) for a in answers], pa.binary())})


def backoff_scores(g: _Grams, total: np.ndarray, words: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of log scores, words scored below the highest order) of each text.

    A text's own n-grams are taken off the counts, so it is scored by the other documents. A word whose n-gram is not
    left is scored by the shorter one times ``alpha``; a word that nobody else has scores alpha / (words elsewhere + 1).
    """
    n_words = np.bincount(g.doc, minlength=g.texts)
    left = []
    for n in range(order):
        owner = g.doc[g.ends[n]]
        pair = owner * max(len(g.distinct), 1) + g.ids[n]
        _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
        left.append(total[g.ids[n]] - own[back])
    others = (words - n_words)[g.doc].astype(float)
    with np.errstate(divide="ignore"):
        s = np.where(left[0] > 0, np.log(np.maximum(left[0], 1)) - np.log(np.maximum(others, 1)), math.log(alpha) - np.log(others + 1))
    low = np.zeros(len(g.doc), dtype=bool) | (left[0] <= 0)
    counts = np.zeros(len(g.doc), np.int64)
    counts[g.ends[0]] = left[0]
    for n in range(1, order):
        at, here = g.ends[n], left[n]
        context = counts[at - 1]
        found = here > 0
        s[at] = np.where(found, np.log(np.maximum(here, 1)) - np.log(np.maximum(context, 1)), math.log(alpha) + s[at])
        low[at] = ~found
        counts = np.zeros(len(g.doc), np.int64)
        counts[at] = here
    return n_words, np.bincount(g.doc, weights=s, minlength=g.texts), np.bincount(g.doc[low], minlength=g.texts)


def _scorer(order: int, alpha: float):
    def score(key, docs, answers):
        g = _Grams(docs.column("text"), order)
        answers = answers.sort_by("range")
        total = np.concatenate([unpack_counts(x) for x in answers.column("totals").to_pylist()])
        n, s, low = backoff_scores(g, total, answers.column("words")[0].as_py(), order, alpha)
        mean = [x / k if k else None for x, k in zip(s.tolist(), n.tolist())]
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(np.round(s, 6), pa.float64()),
            "mean_log_score": pa.array([None if m is None else round(m, 6) for m in mean], pa.float64()), "n_backoff": pa.array(low, pa.int64())})

    return score


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural logarithms summed), mean_log_score, n_backoff.

    Null and empty texts have no words, score 0 and no mean. Repeated rows are documents of their own. An empty table
    gives an empty result. Words are runs of letters and digits with A-Z lower-cased. A first word has no context and
    is scored by its count alone. The number of blocks and of hash ranges follows the size of the corpus, so a task
    holds about a block whatever the input; documents go to blocks by hash of id and text, through one exchange that
    both uses share.
    """
    total = total_bytes(docs, text)
    blocks = max(1, -(-total // block_bytes(total)))
    kind = docs.schema[key].dataType.simpleString()
    dealt = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    asked = dealt.groupBy("block").applyInArrow(_asker(order, blocks), _ASK)
    answered = asked.groupBy("range").applyInArrow(_answer, _ANSWER)
    out = f"doc_id {kind}, n_words long, log_score double, mean_log_score double, n_backoff long"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_scorer(order, alpha), out)
