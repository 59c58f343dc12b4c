"""Byte-level BPE encoding and decoding in Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. A word's bytes become ids, and a fold merges the adjacent pair of the
lowest rank, leftmost first, until no pair of neighbours is in the vocabulary. The rank map is a binary literal: a hash of the
two ids names two places, and one of them holds the pair and its rank if the pair can be merged. Frequent distinct words are
folded once, and their ids become a second literal map; the other words go through the same merges in Arrow batches, all
distinct words of a batch at once. Ids are coded as a string with one character per id while they are joined. Decoding joins
the byte strings of the ids.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of, total_bytes

#: A longer word is merged by a heap instead of the fold, whose cost is quadratic in a word's bytes.
LONG_CHARS = 64
#: So many words are merged at once, side by side; a word of LONG_CHARS characters has at most 256 bytes.
SIDE_BY_SIDE = 1 << 13
#: No id, and the key of a pair that can't be merged.
NO_ID, NO_KEY = 0xFFFF, 1 << 30
#: At most this many frequent words are kept as a literal map: about 1 MB of words and as much of ids.
HOT_WORDS = 1 << 16
#: They are counted in a sample of about this many bytes of text.
SAMPLE_BYTES = 64 << 20
#: Joins the literal map's words; a word that holds it is not kept there.
SEPARATOR = "\x1f"
#: Code points of letters and numbers from Unicode 14 on, which Java 17 does not know yet; first-last, hexadecimal.
NEW_LETTERS = (
    "870-887 889-88E 8B5-8B5 8C8-8C9 C5D-C5D CDD-CDD 170D-170D 171F-171F 1B4C-1B4C 1C89-1C8A 2C2F-2C2F 2C5F-2C5F 9FFD-9FFF "
    "A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3-A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 "
    "105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 "
    "10F70-10F81 11071-11072 11075-11075 1123F-11240 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 "
    "113D3-113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02-11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F-1342F 13441-13446 "
    "13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF-18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132-1B132 "
    "1B155-1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0-1E5F0 1E7E0-1E7E6 1E7E8-1E7EB "
    "1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF")
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"

#: Unicode's white space.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern for Java: white space is Unicode's, and letters and numbers include the newer ones."""
    def newer(ranges: str) -> str:
        return "[\\x{800}-\\x{10FFFF}&&[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (r.split("-") for r in ranges.split())) + "]]"

    letters, numbers = "\\p{L}" + newer(NEW_LETTERS), "\\p{N}" + newer(NEW_NUMBERS)
    pattern = pattern.replace(" ?", " ?+").replace("}+", "}++").replace("}]+", "}]++")  # runs of one class end in one place
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return out.replace(r"+\p{L}+", f"+[{letters}]+").replace(r"+\p{N}+", f"+[{numbers}]+")


def _two_places(keys: list[bytes], size: int) -> np.ndarray:
    """A place of its own for each key, one of the two that its hash names; -1 where there is none.

    The hash is what Spark's xxhash64 gives for the bytes. A key that finds both places taken pushes one key on to that
    key's other place; earlier keys of the list are moved no more often than needed.
    """
    ways = np.array([xxhash.xxh64_intdigest(k, seed=42) for k in keys], np.uint64)
    ways = np.stack([ways & np.uint64(size - 1), (ways >> np.uint64(32)) & np.uint64(size - 1)], axis=1).tolist()
    holder: dict[int, int] = {}
    for k in range(len(keys)):
        now, to = k, ways[k][1] if ways[k][0] in holder else ways[k][0]
        for _ in range(200):
            now, last = holder.get(to, -1), now
            holder[to] = last
            if now < 0:
                break
            to = ways[now][1] if to == ways[now][0] else ways[now][0]
    at = np.full(len(keys), -1, np.int64)
    for place, k in holder.items():
        at[k] = place
    return at


def _size(keys: int) -> int:
    return 1 << max(4, (2 * keys).bit_length())


def _places(h: Column, size: int) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(size - 1)).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1)).cast("int")


def _code(rank: int) -> bytes:
    return rank.to_bytes(2, "big")


@dataclass(frozen=True)
class Merges:
    """Ids of the 256 bytes; sorted pairs of ids, each as one number, and their ranks."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 if it can't be merged."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def key(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Smaller for a lower rank, then for a place further left."""
        rank = self.rank(a, b)
        return np.where(rank < 0, NO_KEY, rank << 8 | place).astype(np.int32)

    @cached_property
    def first(self) -> np.ndarray:
        """Ranks of all pairs of bytes."""
        return self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).astype(np.int32)

    def side_by_side(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at ``at``, one word after the other, and how many each has; one merge per word and step."""
        n, high = len(at), int(sizes.max(initial=0))
        place = np.arange(high)[:, None]
        inside = place < sizes
        raw = data[np.minimum(at + place, max(0, len(data) - 1))]
        # a word is a column; the last row stands for what lies beyond either end
        ids = np.full((high + 1, n), NO_ID, np.uint16)
        ids[:high] = np.where(inside, self.byte_ids[raw], NO_ID)
        keys = np.full((high + 1, n), NO_KEY, np.int32)
        rank = self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        keys[: high - 1] = np.where((rank < 0) | ~inside[1:], NO_KEY, rank << 8 | place[:-1])
        after = np.repeat(np.minimum(np.arange(1, high + 2), high).astype(np.int16)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, high, dtype=np.int16)[:, None], n, axis=1)
        own = np.arange(n)
        while True:
            low = keys.min(axis=0)
            k = np.flatnonzero(low < NO_KEY)
            if not len(k):
                break
            if 4 * len(k) < 3 * len(own):
                own, keys, low = own[k], keys[:, k], low[k]
                k = np.arange(len(k))
            w, low = own[k], low[k]
            i, new = low & 255, low >> 8
            j, h = after[i, w], before[i, w]
            beyond = after[j, w]
            ids[i, w], ids[j, w] = new, NO_ID
            after[i, w], before[beyond, w] = beyond, i
            keys[j, k] = NO_KEY
            keys[i, k] = self.key(new, ids[beyond, w], i)
            keys[h, k] = self.key(ids[h, w], new, h.astype(np.int32))
        left = ids[:high].T
        held = left != NO_ID
        return left[held], held.sum(axis=1)

    def coded(self, words: pa.Array) -> pa.Array:
        """The coded ids of each word, by the same merges as :meth:`Vocabulary.fold`."""
        words = words.cast(pa.large_string())
        if not len(words):
            return words
        _, off, data = words.buffers()
        off = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1]
        data, sizes = np.frombuffer(data, np.uint8), np.diff(off)
        order = np.argsort(sizes, kind="stable")
        parts = [self.side_by_side(data, off[o], sizes[o]) for o in np.split(order, range(SIDE_BY_SIDE, len(order), SIDE_BY_SIDE))]
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        ends = np.concatenate([[0], np.cumsum(1 + (ids >= 0x80) + (ids >= 0x800), dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
        text = ids.astype("<u2").tobytes().decode("utf-16-le").encode()
        out = pa.LargeStringArray.from_buffers(len(order), pa.py_buffer(ends.tobytes()), pa.py_buffer(text))
        return out.take(pa.array(np.argsort(order)))


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, each id being its rank, and the pattern that cuts texts into words."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @cached_property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def pairs(self) -> bytes:
        """The rank map: six bytes per place, two ids whose bytes together are a token, and its rank; FF for none."""
        rows = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    rows[_code(a) + _code(b)] = _code(rank)
        at = _two_places(list(rows), _size(len(rows)))
        if (at < 0).any() or len(self.tokens) >= 0xD800:
            raise ValueError("the vocabulary is too large for the rank map")
        table = bytearray(b"\xff" * (6 * _size(len(rows))))
        for (key, rank), p in zip(rows.items(), at.tolist()):
            table[6 * p : 6 * p + 6] = key + rank
        return bytes(table)

    @cached_property
    def merges(self) -> Merges:
        """The rank map for whole arrays of pairs."""
        held = np.frombuffer(self.pairs, ">u2").reshape(-1, 3)
        held = held[held[:, 2] != NO_ID].astype(np.uint32)
        keys = held[:, 0] << np.uint32(16) | held[:, 1]
        order = np.argsort(keys)
        return Merges(np.array([self.ranks[bytes([i])] for i in range(256)], np.uint16),
                      np.append(keys[order], np.uint32(0xFFFFFFFF)), np.append(held[order, 2].astype(np.int32), -1).astype(np.int32))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(java_pattern(self.pattern)), F.lit(0))

    def fold(self, word: Column) -> Column:
        """The coded ids of a word: the leftmost pair of the lowest rank is merged, once per step, until none is left."""
        table = F.lit(self.pairs)  # large, and written out in every plan, so it stands in the expression once
        open_ = F.lit(b"")
        byte_ids = F.lit(b"".join(_code(self.ranks[bytes([i])]) for i in range(256)))

        def let(value, f):
            return F.get(F.transform(F.array(value), f), F.lit(0))

        def rank_of(pair):
            at = F.transform(F.array(*_places(F.xxhash64(pair), len(self.pairs) // 6)), lambda p: F.substring(table, p * 6 + 1, F.lit(6)))
            return let(at, lambda e: F.when(F.substring(F.get(e, F.lit(0)), 1, 4) == pair, F.substring(F.get(e, F.lit(0)), 5, 2))
                       .when(F.substring(F.get(e, F.lit(1)), 1, 4) == pair, F.substring(F.get(e, F.lit(1)), 5, 2)))

        def merge(ids, ranks, low, p):
            """The pair at place p becomes one id; the ranks of its pairs with both neighbours are still to be found."""
            n = F.size(ids)
            return F.array(F.concat(F.slice(ids, 1, p - 1), F.array(low), F.slice(ids, p + 2, n)),
                           F.concat(F.slice(ranks, 1, F.greatest(p - 2, F.lit(0))), F.slice(F.array(open_, open_), 1, F.when(p > 1, 1).otherwise(0) + F.when(p + 1 < n, 1).otherwise(0)),
                                    F.slice(ranks, p + 2, n)))

        def step(state, _):
            ids = F.get(state, F.lit(0))
            found = F.transform(F.get(state, F.lit(1)), lambda r, i: F.when(r == open_, rank_of(F.concat(F.get(ids, i), F.get(ids, i + 1)))).otherwise(r))
            return let(found, lambda ranks: let(F.array_min(ranks), lambda low: F.when(low.isNull(), F.array(ids, ranks)).otherwise(
                let(F.array_position(ranks, low).cast("int"), lambda p: merge(ids, ranks, low, p)))))

        # a byte string read as Latin-1 has one character per byte
        start = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.substring(byte_ids, F.ascii(c) * 2 + 1, F.lit(2)))
        both = let(start, lambda ids: F.array(ids, F.array_repeat(open_, F.size(ids) - 1)))
        folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), both, step)
        return F.decode(F.unhex(F.array_join(F.transform(F.get(folded, F.lit(0)), lambda i: F.hex(i)), "")), "UTF-16BE")


def heap_merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges for a long word, found through a heap: pairs in order of (rank, place), stale ones passed over."""
    parts = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    todo = [(ranks[word[i : i + 2]], i, i + 1, 1, 1) for i in range(len(parts) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(todo)

    def offer(i, j):
        if i >= 0 and j < len(parts) and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(todo, (rank, i, j, len(parts[i]), len(parts[j])))

    while todo:
        _, i, j, a, b = heapq.heappop(todo)
        if len(parts[i]) != a or len(parts[j]) != b or after[i] != j:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [ranks[p] for p in parts if p]


@dataclass(frozen=True)
class HotWords:
    """Coded ids of frequent words as a literal map; a place without a word holds the empty string, which no text has as a word."""

    words: list[str]
    coded: list[str]

    @classmethod
    def build(cls, rows: list[tuple[str, str]]) -> HotWords:
        """From (word, coded ids); the few words for which there is no place are left to the fold."""
        rows = [r for r in rows if SEPARATOR not in r[0]]
        size = _size(len(rows))
        words, coded = [""] * size, [""] * size
        for (word, own), p in zip(rows, _two_places([w.encode() for w, _ in rows], size).tolist()):
            if p >= 0:
                words[p], coded[p] = word, own
        return cls(words, coded)

    def look_up(self, word: Column, otherwise: Column) -> Column:
        words, coded = (F.split(F.lit(mark.join(x)), mark) for mark, x in ((SEPARATOR, self.words), ("\uffff", self.coded)))
        at = F.filter(F.array(*_places(F.xxhash64(word), len(self.words))), lambda p: F.get(words, p) == word)
        return F.coalesce(F.get(coded, F.get(at, F.lit(0))), otherwise)


def hot_words(texts: DataFrame, vocabulary: Vocabulary, text: str = "text", limit: int = HOT_WORDS, sample_bytes: int = SAMPLE_BYTES) -> HotWords:
    """The most frequent distinct words of a sample of about ``sample_bytes``, at most ``limit``, folded once each.

    They save work only: a word that is not among them is folded where it stands, so neither bound changes a result.
    """
    share = min(1.0, sample_bytes / max(1, total_bytes(texts, text)))
    sample = texts if share == 1.0 else texts.sample(share, seed=12)
    counts = stash(sample.select(F.explode(vocabulary.words(text_of(text))).alias("word")).filter(F.length("word") <= LONG_CHARS)
                   .groupBy("word").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(limit).collect()
    least, total = None, 0
    for row in sizes:
        total += row["m"]
        if total > limit:
            break
        least = row["n"]
    if least is None:
        return HotWords.build([])
    rows = counts.filter(F.col("n") >= least).select("n", "word", vocabulary.fold(F.col("word")).alias("coded")).collect()
    return HotWords.build([(r["word"], r["coded"]) for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))])


def encode(texts: DataFrame, vocabulary: Vocabulary, hot: HotWords | None = None, text: str = "text", out: str = "coded") -> DataFrame:
    """``texts`` with a column of coded token ids, as tiktoken's ``encode_ordinary`` gives them; see :func:`ids`.

    A null text counts as empty and has no ids; rows are kept as they are, repeated ones too, and so are other columns,
    except that ``out`` replaces a column of its name. ``hot`` defaults to frequent words of these texts, which the fold has
    merged. All other words go through the same merges in Arrow batches, those of more than ``LONG_CHARS`` characters through a
    heap, each once per batch.
    """
    hot = hot or hot_words(texts, vocabulary, text)
    ranks, merges = vocabulary.ranks, vocabulary.merges
    merges.first  # noqa: B018  computed here, so that it is sent along

    @F.arrow_udf("array<string>")
    def merged(batch: pa.Array) -> pa.Array:
        words = batch.flatten().dictionary_encode()
        long = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False) > LONG_CHARS
        short = merges.coded(words.dictionary.filter(pa.array(~long))).cast(pa.string())
        heaped = pa.array(["".join(map(chr, heap_merge(ranks, w.encode()))) for w in words.dictionary.filter(pa.array(long)).to_pylist()], pa.string())
        # a word's place among the short ones, or behind them among the long ones
        where = np.where(long, len(short) + np.cumsum(long), np.cumsum(~long)) - 1
        flat = pa.concat_arrays([short, heaped]).take(pa.array(where, pa.int64()).take(words.indices))
        return pa.ListArray.from_arrays(pc.subtract(batch.offsets, batch.offsets[0]), flat)

    keep = [c for c in texts.columns if c.lower() != out.lower()]
    cut = texts.select(*keep, vocabulary.words(text_of(text)).alias("_words"))
    cut = cut.withColumn("_known", F.transform("_words", lambda w: hot.look_up(w, F.lit(None).cast("string"))))
    rest = F.transform("_words", lambda w, i: F.when(F.get("_known", i).isNull(), w))
    cut = cut.withColumn("_rest", merged(rest))
    return cut.select(*keep, F.array_join(F.transform("_known", lambda c, i: F.coalesce(c, F.get("_rest", i))), "").alias(out))


def ids(coded: Column) -> Column:
    """Token ids as an array of integers: the code points of the coded string."""
    return F.when(coded == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(coded, ""), lambda c: F.ascii(c)))


def ids_as_bytes(coded: Column) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    return F.unhex(F.regexp_replace(F.hex(F.encode(coded, "UTF-16LE")), "(.{4})", "$10000"))


def decode(coded: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that the ids stand for: their byte strings one after the other."""
    pieces = F.split(F.lit(",".join(t.hex() for t in vocabulary.tokens)), ",")
    return F.unhex(F.array_join(F.transform(ids(coded), lambda i: F.get(pieces, i)), ""))


def digests(texts: DataFrame, vocabulary: Vocabulary, hot: HotWords | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, read from its coded ids."""
    coded = F.col("coded")
    return encode(texts.select("doc_id", "text"), vocabulary, hot).select(
        "doc_id", F.length(coded).cast("long").alias("n_tokens"), F.sha2(ids_as_bytes(coded), 256).alias("ids_sha256"),
        F.sha2(decode(coded, vocabulary), 256).alias("decoded_sha256"))
