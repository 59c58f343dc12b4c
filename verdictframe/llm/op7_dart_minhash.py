"""Near-duplicates with DartMinHash.

A text is a weighted set of word shingles. Darts are thrown, by hash, into the region that each element spans (its
weight times a rank axis); a dart lands on a coordinate of the signature, and each coordinate keeps the dart of the
earliest rank. The chance that two sets keep the same dart is their weighted Jaccard similarity. Only the ranks that a
set needs are thrown, about k log k darts for k coordinates, however many elements it has.

Equal texts are one node. Nodes with an equal band of the signature are linked to the band's hub, the node of most
copies, the link is checked on the shingles themselves, and links are closed to classes. Bands whose members are still
in several classes take other hubs, the most central node first; what is still open then is compared in blocks, so that no class hangs on a hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of
from .wordhash import ALNUM, U, grams, mix, slices, split

SHINGLE = 5
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Similarity as a fraction, so that the exact check is in whole numbers.
SIMILAR = (4, 5)
#: Members of a band are compared in blocks of so many.
BLOCK = 256
#: Pairs of a block are checked on their shingles if so many coordinates agree: 6.4 standard deviations under the mean
#: at the limit. Coordinates are compared in their last eight bits, which can only let more pairs through.
AGREE = int(K * 0.8 - 6.4 * (K * 0.8 * 0.2) ** 0.5)
#: How often bands that are still in several classes take another hub.
HUB_ROUNDS = 3


def weighted_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, multiplicity), sorted by text, of the shingles of a slice of texts.

    A text of fewer words than a shingle, but not none, has all its words as one shingle.
    """
    w = split(data, offsets, kind=ALNUM)
    at, g = grams(w, size)
    doc = w.doc[at]
    counts = w.counts
    for n in range(1, size):
        own = np.flatnonzero(counts == n)
        if len(own):
            a, h = grams(w, n)
            whole = np.isin(w.doc[a], own)
            doc, g = np.concatenate([doc, w.doc[a][whole]]), np.concatenate([g, mix(h[whole] + U(n))])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], g[first], np.diff(np.append(first, len(g)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((h >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """Signatures (texts x k) of weighted sets; a text without elements has zeros.

    The region of an element of weight w is made of cells of width one; a dart in the last, partial cell counts if its
    place there is below the weight. A cell's darts come in order of rank, as the gaps of a Poisson process drawn from
    the hash of (element, cell, number of the dart); each has its place and coordinate from the same hash.
    """
    sig = np.zeros((texts, k), dtype=U)
    if not len(doc):
        return sig
    cells = np.maximum(1, np.ceil(weight)).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.minimum(1.0, weight[owner] - cell)
    seed = mix(element[owner] + cell.astype(U) * U(0x9E3779B97F4A7C15))
    home = doc[owner]
    total = np.bincount(home, weights=width, minlength=texts)
    full = np.flatnonzero(total > 0)
    limit = np.zeros(texts)
    limit[full] = (k * np.log(k) + 2 * k) / total[full]
    todo = np.zeros(texts, dtype=bool)
    todo[full] = True
    best = np.full(texts * k, np.inf)
    while todo.any():
        own = np.flatnonzero(todo[home])
        s, d, rank, keys, ranks, ids = seed[own], home[own], np.zeros(len(own)), [], [], []
        wide, step = width[own], 0
        while len(s):
            step += 1
            h = mix(s + U(step * 0xD1342543DE82EF95 % (1 << 64)))
            rank = rank - np.log(_unit(h))
            near = rank <= limit[d]
            s, d, rank, wide, h = s[near], d[near], rank[near], wide[near], h[near]
            g = mix(h ^ U(0xA0761D6478BD642F))
            hit = _unit(mix(g ^ U(0xE7037ED1A0B428DB))) <= wide
            keys.append(d[hit] * k + (g[hit] % U(k)).astype(np.int64))
            ranks.append(rank[hit])
            ids.append(g[hit])
        key, r, i = np.concatenate(keys), np.concatenate(ranks), np.concatenate(ids)
        np.minimum.at(best, key, r)
        won = r == best[key]
        sig.reshape(-1)[key[won]] = i[won]
        short = np.isinf(best.reshape(texts, k)).any(axis=1) & todo
        todo = short
        limit[short] *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band: the band's number and its coordinates."""
    texts, k = sig.shape
    keys = np.broadcast_to(np.arange(1, k // rows + 1, dtype=U) * U(0x9E3779B97F4A7C15), (texts, k // rows)).copy()
    for j in range(rows):
        keys = mix(keys + sig[:, j::rows])
    return keys


def _lists(values: np.ndarray, lengths: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _signer(weighted: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, off in slices(b.column(2)):
                n = len(off) - 1
                doc, element, count = weighted_sets(data, off)
                sig = signatures(doc, element, count.astype(float) if weighted else np.ones(len(doc)), n)
                some = np.bincount(doc, minlength=n) > 0
                keys = band_keys(sig)[some]
                bands = _lists(keys.reshape(-1).view(np.int64), np.where(some, BANDS, 0), pa.int64())
                short, whole = (sig & U(0xFF)).astype(np.uint8)[some], keys.view(np.uint8).reshape(len(keys), 8 * BANDS)
                both = iter(np.hstack([short, whole]))
                blob = pa.array([next(both).tobytes() if x else b"" for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), bands, blob], ["doc_id", "node", "bands", "sig"])

    return go


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, data, off in slices(b.column(1)):
            n = len(off) - 1
            doc, element, _ = weighted_sets(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), _lists((element >> U(32)).astype(np.uint32).view(np.int32), np.bincount(doc, minlength=n), pa.int32())], ["node", "shingles"])


def nodes_of(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """doc_id, node, bands, sig of every row; ``node`` is the hash of the whole text, null counting as empty.

    ``sig`` has the last eight bits of each coordinate and then the bands' keys, for the comparison in blocks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = text_of()
    return docs.select("doc_id", F.xxhash64(t).alias("node"), t.alias("text")).mapInArrow(
        _signer(weighted), f"doc_id {kind}, node long, bands array<long>, sig binary")


def _central(bands: DataFrame) -> DataFrame:
    """The bands with the order of their nodes by centrality, most central first: an original from which many near copies
    were made shares larger bands, and more of them, than its copies do with each other."""
    size = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    weight = bands.join(size, "band").groupBy("node").agg(F.sum("n").alias("weight"))
    tie = F.xxhash64("node").bitwiseAND(F.lit((1 << 20) - 1))
    return bands.drop("order").join(weight, "node").withColumn("order", tie - F.col("weight") * F.lit(1 << 20)).drop("weight")


def _hub_pairs(bands: DataFrame, rooted: DataFrame | None, turn: int) -> DataFrame:
    """Every member of a band with the band's hub: the node of most copies, then the most central one, then another.

    With ``rooted``, bands whose members are in one class and members of the hub's class are left out. The hub of a
    band combines on the map side.
    """
    if rooted is not None:
        bands = bands.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        bands = _central(bands) if turn == 1 else bands.withColumn("order", F.xxhash64(F.lit(turn), "node"))
    else:
        bands = bands.withColumn("root", F.col("node"))
    hubs = bands.groupBy("band").agg(F.min_by("node", "order").alias("hub"), F.min_by("root", "order").alias("hub_root"), F.min("root").alias("p"), F.max("root").alias("q"))
    hubs = hubs.where("p <> q").select("band", "hub", "hub_root")
    return bands.join(hubs, "band").where("root <> hub_root").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, shingles (their hashes to 32 bits) of the chosen nodes.

    ``chosen``: node and the doc_id of one of its rows; texts are fetched by both, so a text with many copies is read
    from one row and no key is frequent.
    """
    keys = chosen.select(F.col("node").alias("k_node"), F.col("doc_id").alias("k_id"))
    t = text_of()
    rows = docs.select("doc_id", F.xxhash64(t).alias("node"), t.alias("text"))
    texts = rows.join(keys, (rows["node"] == keys["k_node"]) & rows["doc_id"].eqNullSafe(keys["k_id"])).select("node", "text")
    return texts.mapInArrow(_shingler, "node long, shingles array<int>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least the similarity. The set of ``b``, the member, travels with
    the pair; that of ``a``, the hub, is one row."""
    member = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = member.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * similar[1] >= (F.size("x") + F.size("y") - common) * similar[0]).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node) of every linked node: large-star and small-star steps until nothing changes.

    Each step hangs a node's neighbours on the smallest of them, by joins with a minimum per node; no group is
    gathered. The number of steps is about the logarithm of the longest chain.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: neighbours above a node go to the smallest neighbour
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest neighbour
        down = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(down, "u")
        edges = stash(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _block_compare(batches: Iterator[pa.RecordBatch], similar: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Likely pairs of two blocks of a band's members, each pair in the first band whose key it shares.

    With ``similar`` the last two columns hold the members' shingles. Likely pairs are then checked on them here, and of
    the links only those are sent that join classes still apart, so a row sends fewer links than it has members.
    """
    for b in batches:
        a, c = [], []
        for r in range(b.num_rows):
            number = b.column(0)[r].as_py()
            (xn, xr, xk, xs), (yn, yr, yk, ys) = (_members(*(b.column(k)[r].values for k in side)) for side in ((1, 2, 3), (4, 5, 6)))
            xe, ye = (_sets(b.column(k)[r].values) for k in (7, 8)) if similar else ([], [])
            size, joined = np.array([len(e) for e in ye], np.int64), {}
            for i in range(len(xn)):
                near = np.flatnonzero((yr != xr[i]) & ((ys == xs[i]).sum(axis=1) >= AGREE))
                near = near[np.argmax(yk[near] == xk[i], axis=1) == number]
                if similar and len(near):
                    others = np.concatenate([ye[j] for j in near])
                    place = np.minimum(np.searchsorted(xe[i], others), len(xe[i]) - 1)
                    common = np.add.reduceat((xe[i][place] == others).astype(np.int64), np.cumsum(size[near]) - size[near])
                    near = near[common * similar[1] >= (len(xe[i]) + size[near] - common) * similar[0]]
                for j in near:
                    if similar:
                        p, q = (_top(joined, int(root)) for root in (xr[i], yr[j]))
                        if p == q:
                            continue
                        joined[p] = q
                    a.append(min(xn[i], yn[j]))
                    c.append(max(xn[i], yn[j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _members(nodes: pa.Array, roots: pa.Array, sigs: pa.Array) -> tuple[np.ndarray, ...]:
    """Nodes, roots, keys of bands and coordinates of one block."""
    sig = np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(len(sigs), -1)
    return nodes.to_numpy(), roots.to_numpy(), np.ascontiguousarray(sig[:, K:]).view(np.int64), sig[:, :K]


def _sets(shingles: pa.Array) -> list[np.ndarray]:
    at, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    return [np.unique(flat[s:e]) for s, e in zip(at[:-1], at[1:])]


def _top(joined: dict[int, int], root: int) -> int:
    while root in joined:
        root = joined[root]
    return root


def _open_links(bands: DataFrame, rooted: DataFrame, signed: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links within bands whose members are in several classes: members in blocks, blocks against blocks."""
    with_root = bands.join(rooted, "node", "left").select("band", "number", "node", F.coalesce("root", "node").alias("root"))
    stats = with_root.groupBy("band").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count(F.lit(1)).alias("n"))
    mixed = stats.where("p <> q").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    member = with_root.join(mixed, "band").join(signed.join(sets, "node"), "node")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    block = member.groupBy("band", "number", "block").agg(F.collect_list(F.struct("node", "root", "sig", "shingles")).alias("m"), F.first("blocks").alias("blocks"))
    left = block.select("band", "number", F.col("m").alias("x"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    right = block.select("band", F.col("block").alias("other"), F.col("m").alias("y"))
    columns = [f"{side}.{c}" for side in "xy" for c in ("node", "root", "sig")] + ["x.shingles", "y.shingles"]
    both = left.join(right, ["band", "other"]).select("number", *[F.col(c).alias(c.replace(".", "_")) for c in columns])
    return both.mapInArrow(lambda batches: _block_compare(batches, similar), "a long, b long").distinct()


def classes(docs: DataFrame, weighted: bool = False, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, node, root, class_id of every row. The root is the class's smallest node. class_id is the smallest doc_id
    of the class, or the root if that id doesn't name one class: if all are null, or if another class has the same.

    Two texts are linked if their sets of five-word shingles (ASCII letters lower-cased) have a Jaccard similarity of
    0.8 or more; classes are the closure of links. Equal texts are in one class, also empty ones; null is an empty text.
    A text without words is linked to nothing else. ``weighted`` signs multiplicities; the check on sets is the same.
    """
    signed = stash(nodes_of(docs, weighted))
    # one row of all copies of a text
    chosen = stash(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    keys = chosen.select(F.col("node").alias("k_node"), F.col("doc_id").alias("k_id"), "copies")
    reps = signed.join(keys, (signed["node"] == keys["k_node"]) & signed["doc_id"].eqNullSafe(keys["k_id"]))
    order = F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1)) - F.least("copies", F.lit(1 << 22)) * F.lit(1 << 40)
    reps = stash(reps.select("node", order.alias("order"), "bands", "sig"))
    bands = reps.select("node", "order", F.posexplode("bands").alias("number", "band"))
    # bands of several nodes are few; all that follows works on them
    shared = bands.groupBy("band").agg(F.min("node").alias("p"), F.max("node").alias("q")).where("p <> q").select("band")
    bands = stash(bands.join(shared, "band", "left_semi"))
    sets = stash(sets_of(docs, chosen.join(bands.select("node").distinct(), "node", "left_semi")))
    links, rooted = None, None
    for turn in range(HUB_ROUNDS):
        pairs = stash(_hub_pairs(bands, rooted, turn))
        if turn and pairs.isEmpty():
            break
        found = similar_pairs(pairs, sets, similar)
        links = stash(found if links is None else links.unionByName(found))
        rooted = components(links)
    more = stash(_open_links(bands, rooted, reps.select("node", "sig").dropDuplicates(["node"]), sets, similar))
    if not more.isEmpty():
        rooted = components(links.unionByName(more))
    names = chosen.select("node", "doc_id").join(rooted, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = names.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = stash(names.join(_named(least), "root").select("node", "root", "class_id"))
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "node", "root", "class_id")


def _named(least: DataFrame) -> DataFrame:
    """root, class_id: the class's smallest doc_id, or the root itself if that id is null or another class has it too."""
    kind = least.schema["least"].dataType.simpleString()
    kind = "long" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    keyed = least.withColumn("key", F.when(F.col("least").isNull(), F.col("root")).otherwise(F.xxhash64("least")))
    twice = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("twice"))
    own = F.when(F.col("least").isNull() | F.col("twice").isNotNull(), F.col("root").cast(kind)).otherwise(F.col("least").cast(kind))
    return keyed.join(twice, "key", "left").select("root", own.alias("class_id"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and class_id."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the class's smallest doc_id, null after all others.

    Classes are told apart by their roots, so ids may be null or repeated. Among rows of that id the smallest node
    stays, among equal rows any. The texts of all but the kept rows are left
    behind before the shuffle that removes equal rows.
    """
    rooted = classes(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    best = rooted.groupBy("root").agg(first.alias("k"))
    own = docs.columns
    # one key of id and text: the join and the removal of equal rows then share their exchange
    best = best.select(F.xxhash64("k.doc_id", "k.node").alias("__d_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__d_row"), F.xxhash64("doc_id", F.xxhash64(text_of())).alias("__d_key"))
    kept = rows.join(best, "__d_key", "left_semi")
    return kept.groupBy("__d_key").agg(F.first("__d_row").alias("__d_row")).select("__d_row.*")
