"""Line dedup by winnowing.

A window is a run of ``min_words`` words, wherever it stands in its lines. Its fingerprint is the smallest hash of the
runs of GRAM words in it, so equal windows have equal fingerprints and neighbouring windows mostly share theirs. A
fingerprint that stands in one place only can't begin a match; windows at the others are looked up word by word at their
first place in the corpus, so that matches reach to their true ends both ways, and the runs of matched windows are cut
from all but the first place. A text that equals another one is cut as a whole, without its windows.

Fingerprints and windows travel packed: a task settles what it can among BLOCK entries, and sends the rest as one row of
byte strings per part, a range of fingerprints. Parts are as many as keep each at some PART entries; a fingerprint in
more than HOT texts, as of a common line, has its windows dealt to all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of
from .wordhash import INK, U, mix, slices, split

#: A repeated run has at least so many words.
MIN_WORDS = 20
#: Words of a hash that a fingerprint is chosen from.
GRAM = 6
#: Fingerprints or windows that a task gathers before it sends them on, and that a part gets on average; tasks get several parts, so that they are even.
BLOCK, PART = 1 << 20, 1 << 17
#: The windows at a fingerprint that stands in more texts are dealt by their content.
HOT = 1 << 15
#: The lowest bit of a fingerprint is free for a mark.
MARK = U(1)


class Windows:
    """All windows of a slice of texts, in order: ``at`` (first word), ``doc``, ``print`` (fingerprint, unmarked)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS):
        w = self.words = split(data, offsets, kind=INK, lower=False)
        self.min_words, size = min_words, min(GRAM, min_words)
        self.grams = min_words - size + 1
        self.at = np.flatnonzero(w.doc[: max(0, len(w.hash) - min_words + 1)] == w.doc[min_words - 1 :])
        self.doc, self.print = w.doc[self.at], np.zeros(0, U)
        if len(self.at):
            m = len(w.hash) - size + 1
            g = w.hash[:m].copy()
            for k in range(1, size):
                g = mix(g * U(0x9E3779B97F4A7C15) + w.hash[k : k + m])
            self.print = mix(_slide_min(g, self.grams)[self.at]) & ~MARK
        self._hash, self._chars = None, None

    def content(self, own=slice(None)) -> np.ndarray:
        """Hash of the words of each window."""
        self._hash = self._hash or _run_hash(self.words.hash)
        return self._hash(self.at[own], self.at[own] + self.min_words)

    def chars(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code points of each text before a byte of the slice."""
        if self._chars is None:
            self._chars = np.zeros(len(self.words.data) + 1, np.int32)
            np.cumsum((self.words.data & 0xC0) != 0x80, dtype=np.int32, out=self._chars[1:])
        return self._chars[at] - self._chars[self.words.offsets[doc]]

    def bounds(self, own=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Start and size as code points, from the window's first character to the end of its last word."""
        doc, at = self.doc[own], self.at[own]
        start = self.chars(doc, self.words.at[at])
        return start, self.chars(doc, self.words.end[at + self.min_words - 1]) - start

    def stretches(self) -> np.ndarray:
        """Indices of the windows whose fingerprint isn't that of the window before."""
        return _starts(self.doc, self.print)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, fingerprint), each fingerprint once a text, marked if a window of it may stand twice in the text."""
        new = self.stretches()
        # equal windows that share a stretch of the length that one place of a fingerprint can have, or lie in two or a longer one
        twice, content = np.zeros(len(self.at), dtype=bool), self.content()
        for d in range(1, self.grams):
            twice[d:] |= (content[d:] == content[:-d]) & (self.doc[d:] == self.doc[:-d])
        twice = np.logical_or.reduceat(twice, new) | (np.diff(np.append(new, len(self.at))) > self.grams)
        key = mix(self.doc[new].astype(U) + U(1)) + self.print[new]
        order = np.argsort(key)
        group = _starts(key[order])
        twice = np.logical_or.reduceat(twice[order], group) | (np.diff(np.append(group, len(order))) > 1)
        own = np.minimum.reduceat(order, group)
        back = np.argsort(own)
        own = new[own[back]]
        return self.doc[own], self.print[own] | twice[back].astype(U)


def _run_hash(h: np.ndarray):
    """Function of (starts, ends) that hashes runs of ``h``, from prefix sums, so that any run costs the same."""
    odd = 0x9E3779B97F4A7C15
    up, down = (np.full(len(h) + 1, U(x), dtype=U) for x in (odd, pow(odd, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:-1], dtype=U)])
    return lambda a, b: mix((total[b] - total[a]) * down[a] + (b - a).astype(U))


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """min(x[i..i+n-1]) for each i, from minima over powers of two."""
    level, width = x, 1
    while 2 * width <= n:
        level, width = np.minimum(level[:-width], level[width:]), 2 * width
    return np.minimum(level[: len(x) - n + 1], level[n - width :])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Indices at which one of the columns changes, with the first."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _part(key: np.ndarray, n: int) -> np.ndarray:
    """Part 0 to n - 1 of an evenly spread key."""
    return (((key >> U(32)) * U(n)) >> U(32)).astype(np.int32)


def _blocks(entries: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The same columns in blocks of about BLOCK entries."""
    held, n = [], 0

    def cut() -> Iterator[list[np.ndarray]]:
        columns = [np.concatenate(c) for c in zip(*held)]
        for k in range(0, n, 2 * BLOCK):
            yield [c[k : k + 2 * BLOCK] for c in columns]

    for e in entries:
        held.append(e)
        n += len(e[0])
        if n >= BLOCK:
            yield from cut()
            held, n = [], 0
    if n:
        yield from cut()


def _binary(column: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Byte strings of the entries between the bounds."""
    column = np.ascontiguousarray(column)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * column.itemsize).astype(np.int32)), pa.py_buffer(column)])


def _packed(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each part, entries in the order in which they stand."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = _starts(part)
    bounds = np.append(first, len(part))
    return pa.RecordBatch.from_pydict({"part": pa.array(part[first], pa.int32())} | {k: _binary(c[order], bounds) for k, c in columns.items()})


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _reader(min_words: int):
    """Of each text of enough words: the first word's start, the last word's end, the fingerprints and their number."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, off in slices(b.column(2)):
                v = Windows(data, off, min_words)
                if not len(v.at):
                    continue
                w, (doc, prints) = v.words, v.prints()
                own = np.flatnonzero(w.counts >= min_words)
                bounds, take = np.append(np.searchsorted(doc, own), len(doc)), pa.array(own + i)
                start, stop = v.chars(own, w.at[w.first[own]]), v.chars(own, w.end[w.first[own + 1] - 1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), _binary(prints, bounds), pa.array(np.diff(bounds), pa.int64())],
                    ["doc_id", "th", "start", "stop", "prints", "n"])

    return go


def _shared(th: np.ndarray, prints: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each fingerprint begins; whether it is marked or stands in several texts; the columns in order of fingerprint."""
    order = np.argsort(prints | MARK)
    th, prints, *more = (c[order] for c in (th, prints, *more))
    first = _starts(prints | MARK)
    marked = np.bitwise_or.reduceat(prints & MARK, first) > 0 if len(first) else np.zeros(0, dtype=bool)
    several = np.minimum.reduceat(th, first) != np.maximum.reduceat(th, first) if len(first) else marked
    return first, marked | several, th, prints, *more


def _print_dealer(n: int):
    """Each fingerprint once a block to its part, marked if it is shared in the block; then its texts need no answer."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            yield np.repeat(b.column(0).to_numpy().view(U), b.column(2).to_numpy()), _flat(b.column(1), U)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, prints in _blocks(read(batches)):
            first, sure, th, prints = _shared(th, prints)
            texts = np.diff(np.append(first, len(th)))
            done = np.flatnonzero(np.repeat(sure, texts))
            yield _packed(np.concatenate([_part(prints[first], n), n + _part(mix(th[done]), n)]), th=np.concatenate([th[first], th[done]]),
                          prints=np.concatenate([(prints[first] & ~MARK) | sure.astype(U), prints[done] & ~MARK]), texts=np.concatenate([texts, np.zeros(len(done), np.int64)]).astype(np.int32))

    return go


def _print_judge(n: int, most: int):
    """(text, fingerprint) for the shared fingerprints of a part, dealt by text; as part -1 those in more than ``most`` texts."""
    def go(t: pa.Table) -> pa.Table:
        th, prints, hot = _flat(t["th"], U), _flat(t["prints"], U), np.zeros(0, U)
        if t["part"][0].as_py() < n:
            first, sure, th, prints, texts = _shared(th, prints, _flat(t["texts"], np.int32))
            hot = prints[first][np.add.reduceat(texts, first, dtype=np.int64) > most] & ~MARK
            # a marked one has been sent to its texts
            own = np.flatnonzero(np.repeat(sure, np.diff(np.append(first, len(th)))) & ((prints & MARK) == 0))
            th, prints = th[own], prints[own]
        part = np.concatenate([_part(mix(th), n), np.full(len(hot), -1, np.int32)])
        return pa.Table.from_batches([_packed(part, th=np.concatenate([th, hot]), prints=np.concatenate([prints, hot]))])

    return go


def _gatherer(t: pa.Table) -> pa.Table:
    """The shared fingerprints of each text and their number."""
    th, prints = _flat(t["th"], U), _flat(t["prints"], U)
    order = np.argsort(th)
    th = th[order]
    bounds = np.append(_starts(th), len(th))
    return pa.table({"th": pa.array(th[bounds[:-1]].view(np.int64)), "prints": _binary(prints[order], bounds), "n": pa.array(np.diff(bounds), pa.int64())})


def _first(content: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the windows that stand at the first place and start of their content."""
    order = np.argsort(content)
    group = _starts(content[order])
    size = np.diff(np.append(group, len(order)))
    # contents that stand once are the first
    own = order[np.repeat(size > 1, size)]
    out = np.ones(len(content), dtype=bool)
    if len(own):
        size = size[size > 1]
        group = np.cumsum(size) - size
        here = place[own] == np.repeat(np.minimum.reduceat(place[own], group), size)
        at = np.where(here, start[own], np.iinfo(start.dtype).max)
        out[own] = here & (at == np.repeat(np.minimum.reduceat(at, group), size))
    return out


def _joined(place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that overlap or touch the one before become one run: place, start, size."""
    if not len(place):
        return place, start, size
    stop = start + size
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] > stop[:-1] + 1) | (start[1:] < start[:-1])
    first = np.flatnonzero(new)
    return place[first], start[first], stop[np.append(first[1:], len(place)) - 1] - start[first]


def _cutter(min_words: int, n: int, hot: np.ndarray):
    """Windows at the shared fingerprints, first ones of their block by part; the others as runs, which need no answer."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            places = b.column(0).to_numpy()
            for i, data, off in slices(b.column(1)):
                v = Windows(data, off, min_words)
                if not len(v.at):
                    continue
                new = v.stretches()
                wanted = np.isin(v.print[new], _flat(b.column(2).slice(i, len(off) - 1), U))
                own = np.flatnonzero(np.repeat(wanted, np.diff(np.append(new, len(v.at)))))
                content = v.content(own)
                # neighbours mostly go to one part, where they grow to runs
                yield _part(np.where(np.isin(v.print[own], hot), content, v.print[own]) if len(hot) else v.print[own], n), content, places[v.doc[own] + i], *v.bounds(own)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, content, place, start, size in _blocks(read(batches)):
            first = _first(content, place, start)
            own, rest = np.flatnonzero(first), np.flatnonzero(~first)
            done = _joined(place[rest], start[rest], size[rest])
            yield _packed(np.concatenate([part[own], n + _part(mix(done[0].view(U)), n)]), **{k: np.concatenate([c[own], d]) for k, c, d in zip(("place", "start", "size"), (place, start, size), done)},
                          content=np.concatenate([content[own], np.zeros(len(done[0]), U)]))

    return go


def _window_judge(n: int):
    """Runs of the windows of a part that aren't the first of their content, dealt by text."""
    def go(t: pa.Table) -> pa.Table:
        place, start, size = _flat(t["place"], np.int64), _flat(t["start"], np.int32), _flat(t["size"], np.int32)
        if t["part"][0].as_py() < n:
            rest = np.flatnonzero(~_first(_flat(t["content"], U), place, start))
            place, start, size = _joined(place[rest], start[rest], size[rest])
        return pa.Table.from_batches([_packed(_part(mix(place.view(U)), n), place=place, start=start, size=size)])

    return go


def _grower(t: pa.Table) -> pa.Table:
    """Runs of a text that overlap or touch become one run."""
    place, start, size = _flat(t["place"], np.int64), _flat(t["start"], np.int32).astype(np.int64), _flat(t["size"], np.int32)
    order = np.lexsort((start, place))
    place, start, stop = place[order], start[order], (start + size)[order]
    # the greatest stop so far in the text
    text = np.zeros(len(place), np.int64)
    text[_starts(place)] = 1
    base = np.cumsum(text) << 32
    reach = np.maximum.accumulate(base + stop) - base
    new = text > 0
    new[1:] |= start[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    return pa.table({"place": place[first], "start": start[first], "stop": reach[np.append(first[1:], len(place)) - 1]})


def _parts(df: DataFrame, each: int = 1) -> int:
    """So many parts that each gets about PART entries, ``each`` for each that ``n`` counts."""
    return 1 + (stash(df.agg(F.sum("n").alias("n")), free=True).first()["n"] or 0) * each // PART


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), start, stop: runs to cut, as code points, disjoint within a text.

    The first place of a run is the one with the smallest (doc_id, text hash, start); null ids come first. Rows that
    agree in doc_id and text are one document and are cut alike. Texts are read once for their bounds and fingerprints,
    and once for the windows at those that stand in several places; only the last sends a text on, once for all its copies.
    Each step is written, and the files of its shuffles go before the next one starts.
    """
    t = text_of()
    keyed = docs.select("doc_id", F.xxhash64(t).alias("th"), t.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = stash(keyed.mapInArrow(_reader(min_words), f"doc_id {kind}, th long, start long, stop long, prints binary, n long"))
    # the first of equal texts stands for them all, the others are cut from their first word to their last
    first = whole.groupBy("th").agg(F.min(F.struct("doc_id")).alias("f"), F.max(F.struct("doc_id")).alias("l")).select("th", F.col("f.doc_id").alias("f_id"), (~F.col("f").eqNullSafe(F.col("l"))).alias("copied"))
    # a number in order of (doc_id, text hash) stands for the text among the windows
    first = stash(first.orderBy(F.asc_nulls_first("f_id"), "th").withColumn("place", F.monotonically_increasing_id()), free=True)
    copies = whole.join(first.where("copied").select("th", "f_id"), "th").where(~F.col("doc_id").eqNullSafe(F.col("f_id")))
    n, packed = _parts(whole), "part int, th binary, prints binary"
    judged = whole.select("th", "prints", "n").mapInArrow(_print_dealer(n), packed + ", texts binary").groupBy("part").applyInArrow(_print_judge(n, HOT), packed)
    judged = stash(judged, free=True)
    # at most one for each HOT fingerprints of texts
    hot = np.frombuffer(b"".join(r["prints"] for r in judged.where("part < 0").select("prints").collect()), dtype=U)
    wanted = judged.where("part >= 0").groupBy("part").applyInArrow(_gatherer, "th long, prints binary, n long")
    wanted = stash(wanted.join(first.select("th", "f_id", "place"), "th").select(F.col("th").alias("w_th"), "f_id", "place", "prints", "n"), free=True)
    # windows that choose one place of a fingerprint, on average
    n, packed = _parts(wanted, max(1, min_words // 2)), "part int, place binary, start binary, size binary"
    texts = keyed.join(wanted.hint("shuffle_hash"), (keyed["th"] == wanted["w_th"]) & keyed["doc_id"].eqNullSafe(wanted["f_id"])).select("place", "text", "prints")
    later = texts.mapInArrow(_cutter(min_words, n, hot), packed + ", content binary").groupBy("part").applyInArrow(_window_judge(n), packed)
    grown = later.groupBy("part").applyInArrow(_grower, "place long, start long, stop long")
    # rows of one id and text have their windows several times, which grow to the same runs
    runs = grown.join(first, "place").select(F.col("f_id").alias("doc_id"), "th", "start", "stop")
    return stash(runs.unionByName(copies.select("doc_id", "th", "start", "stop").distinct()), free=True)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with ``__l_text`` (the text without its repeated runs) and ``__l_runs`` (start, stop of each).

    A null text is an empty one and stays null in its own column. Every row stays, also if nothing is left of its text.
    The white space after a cut run goes with it. Within one text the first of several equal runs stays. An empty table gives
    an empty result; other columns are carried along under one name, so they can't clash.
    """
    own = docs.columns
    # the text travels once, inside its row
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__l_row"), F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("th"))
    runs = repeated_runs(docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")), min_words)
    per = runs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    per = per.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "runs")
    joined = rows.join(per.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(per["r_id"]) & (rows["th"] == per["r_th"]), "left")
    joined = joined.withColumn("text", F.coalesce(F.col("__l_row").getField(text), F.lit("")))
    runs_of = F.coalesce("runs", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    size = F.char_length("text").cast("long")
    # the gaps between runs: from the end of one to the start of the next, without white space behind a run
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs_of, lambda r: r["stop"]))
    ends = F.concat(F.transform(runs_of, lambda r: r["start"]), F.array(size))
    joined = joined.withColumns({"runs": runs_of, "gaps": F.zip_with(begins, ends, lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))})
    body = F.col("text")
    piece = lambda g: F.substring(body, g["a"] + 1, g["b"] - g["a"])
    left = F.array_join(F.transform("gaps", lambda g: F.when(g["a"] == 0, piece(g)).otherwise(F.regexp_replace(piece(g), r"^[\x20\x09-\x0D]+", ""))), "")
    return joined.select("__l_row.*", F.when(F.size("runs") > 0, left).otherwise(body).alias("__l_text"), F.col("runs").alias("__l_runs"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, the text that stays, its code points, and the runs cut: how many, code points, bounds."""
    done = dedup(docs.select("doc_id", "text"), min_words)
    cut = F.aggregate("__l_runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    bounds = F.array_join(F.transform("__l_runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",")
    return done.select(
        "doc_id", F.col("__l_text").alias("text"), F.char_length("__l_text").cast("long").alias("n_chars"),
        F.size("__l_runs").cast("long").alias("n_runs"), cut.alias("cut_chars"), bounds.alias("runs"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the cut text in ``text`` and, if there, its length in ``n_chars``; untouched rows stay as they are."""
    done = dedup(docs, min_words)
    cut = F.size("__l_runs") > 0
    new = {"text": F.when(cut, F.col("__l_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("__l_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(new).drop("__l_text", "__l_runs")
