"""SimHash near-dedup at a similarity of shingle sets: blocks of wide fingerprints propose pairs, the whole sets decide.

Two sets of equal size with a Jaccard similarity of J differ in acos(2J / (1 + J)) / pi of their fingerprints' bits (in
fewer for other sizes).  The bits of a wide fingerprint are dealt into blocks of `width` bits; sets that share a block
are joined on it and their Hamming distance is verified in the join.  Blocks widen with the number of texts, so that a
block is shared by chance by few, and their number is what finds `recall` of the pairs that are just similar enough;
closer pairs are found more surely.  Every pair that is linked is decided by its whole sets.

Near copies come in groups, and a pair of a group whose members are linked already says nothing new.  So in a few of the
blocks each set is first compared to a few others, of its blocks' centres those with the most candidates.  Of all blocks
a key whose sets these links have joined is then dropped by its sums, so a large group isn't joined once for each block.
Keys of two or three sets give their pairs from their sums, without a join.  Where more than `SMALL` sets share a block
they are compared in tiles, whole sets included, and a tile returns a spanning forest of its links: no more rows than
sets, however many of its pairs are near or alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.components import components
from driftwood.llm.exchange import give_back, join_evenly, mix, staged
from driftwood.llm.simhash import COUNTED, U, Votes, _apart, named, shingle_hashes

#: 64-bit lanes of a fingerprint.
LANES = 24
#: Bits of a block at least, and beyond those that number the sets: a block is shared by chance with a chance of a fourth at most.
WIDTH, SPARE = 23, 2
#: Share of the blocks whose centres sets are compared to first.
FIRST = 0.1
#: Centres that a set is compared to first.
CENTRES = 3
#: Share of the pairs of the least similarity that share a block, about.
RECALL = 0.98
#: Sets that share a block and are still paired one by one, three at most: no more pairs than sets.
SMALL = 3
#: Standard deviations by which the differing bits of a candidate may exceed those expected: of the first lane, of all lanes.
SPREAD, SPREAD_ALL = 5.0, 4.0
#: Sets in a tile of a block that many share, and their hashes.
TILE, TILE_HASHES = 2_000, 2 << 20
#: Pairs with one set that one task confirms.
PAIRS = 500


def differing(similarity: float) -> float:
    """The share of bits in which two equally large sets of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a block and how many blocks, for n sets."""
    width = max(WIDTH, max(n, 1).bit_length() + SPARE)
    return width, math.ceil(math.log(1 - recall) / math.log1p(-((1 - differing(similarity)) ** width)))


def farthest(similarity: float, lanes: int = 1) -> int:
    """Most differing bits of a first lane, or of that many lanes."""
    p, bits = differing(similarity), 64 * lanes
    return min(bits, math.ceil(bits * p + (SPREAD if lanes == 1 else SPREAD_ALL) * math.sqrt(bits * p * (1 - p))))


def _set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(text, k))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _sketches(shingle: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, node, size, prints = batch["text"].cast(pa.binary()), [], [], []
            k = 0
            while k < len(texts):
                sets, n = [], 0
                while k < len(texts) and n < COUNTED:
                    sets.append(_set(texts[k].as_py(), shingle))
                    n += len(sets[-1])
                    k += 1
                node += map(_node, sets)
                size += map(len, sets)
                votes = Votes(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))
                prints.append(np.column_stack([votes.majority(lane) for lane in range(lanes)]).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * lanes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prints])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(node, pa.int64()), pa.array(size, pa.int64()), lists], names=["doc_id", "row", "node", "n", "lanes"])
        give_back()

    return run


def _places(bits: int, width: int, blocks: int) -> np.ndarray:
    """The bits of each block: the fingerprint's bits in one order after another, cut into blocks."""
    if not width:
        return np.zeros((blocks, 0), np.int64)
    per = max(1, bits // width)
    orders = [np.argsort(mix(np.arange(bits, dtype=U) + U(k * bits + 1))) for k in range(-(-blocks // per))]
    return np.concatenate([o[: per * width].reshape(per, width) for o in orders])[:blocks]


def _keys(lanes: int, width: int, blocks: int):
    places = _places(64 * lanes, width, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            prints = batch["lanes"].flatten().to_numpy().view(U).reshape(rows, lanes)
            keys = np.zeros((rows, blocks), U)
            for k in range(0, rows, 1000):
                bits = np.unpackbits(prints[k : k + 1000].view(np.uint8), axis=1).T.astype(U)
                for b, places_of in enumerate(places):
                    key = np.zeros(bits.shape[1], U)
                    for p in places_of:
                        key = key << U(1) | bits[p]
                    keys[k : k + 1000, b] = mix(key + U(b << 48))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * blocks, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            first = pa.array(prints[:, 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], first, batch["label"], lists], names=["node", "n", "lane", "label", "keys"])

    return run


def _close(a: str, b: str, least: Fraction) -> Column:
    """Whether two sets may be similar enough, by their sizes and first lanes."""
    sizes = F.least(f"{a}.n", f"{b}.n") * least.denominator >= F.greatest(f"{a}.n", f"{b}.n") * least.numerator
    return sizes & (F.bit_count(F.col(f"{a}.lane").bitwiseXOR(F.col(f"{b}.lane"))) <= farthest(float(least)))


def _near(t: pa.Table, least: Fraction, lanes: int, k: int, rows: np.ndarray) -> np.ndarray:
    """Those of `rows` that may be similar enough to row k, by their sizes and fingerprints."""
    n = t["n"][rows]
    rows = rows[(np.minimum(n, t["n"][k]) * least.denominator >= np.maximum(n, t["n"][k]) * least.numerator) & (np.bitwise_count(t["lanes"][rows, 0] ^ t["lanes"][k, 0]) <= farthest(float(least)))]
    return rows[np.bitwise_count(t["lanes"][rows] ^ t["lanes"][k]).sum(axis=1) <= farthest(float(least), lanes)]


def _arrays(t: pa.Table, lanes: int) -> dict[str, np.ndarray]:
    out = {c: t[c].to_numpy() for c in ("node", "n", "label")}
    return out | {"lanes": t["lanes"].combine_chunks().flatten().to_numpy().view(U).reshape(len(t), lanes)}


def _with_candidates(least: Fraction, lanes: int):
    """Of a pair of tiles the rows that may be similar enough to one with another label."""

    def run(t: pa.Table) -> pa.Table:
        x, some = _arrays(t, lanes), np.zeros(len(t), bool)
        for k in range(len(t) - 1):
            at = _near(x, least, lanes, k, np.flatnonzero(x["label"][k + 1 :] != x["label"][k]) + k + 1)
            some[at] = True
            some[k] |= len(at) > 0
        return t.filter(pa.array(some))

    return run


def _linked_in_tile(least: Fraction, lanes: int):
    """A spanning forest of the links between the labels in a pair of tiles, decided by the whole sets."""

    def run(t: pa.Table) -> pa.Table:
        x, sets = _arrays(t, lanes), [np.frombuffer(h.as_py(), U) for h in t["hashes"]]
        size = np.array([len(s) for s in sets], np.int64)
        number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        own = np.split(number, np.cumsum(size)[:-1])
        group, held = np.unique(x["label"], return_inverse=True)[1], np.zeros(len(number), bool)
        us, vs = [], []
        for k in range(len(sets) - 1):
            at = _near(x, least, lanes, k, np.flatnonzero(group[k + 1 :] != group[k]) + k + 1)
            if not len(at):
                continue
            held[own[k]] = True
            common = np.array([np.count_nonzero(held[own[j]]) for j in at.tolist()], np.int64)
            held[own[k]] = False
            for j in at[common * (least.numerator + least.denominator) >= least.numerator * (size[at] + size[k])].tolist():
                if group[j] != group[k]:
                    us.append(int(x["node"][k]))
                    vs.append(int(x["node"][j]))
                    group[group == group[j]] = group[k]
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _in_tiles(large: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, least: Fraction, lanes: int) -> DataFrame:
    """Links u, v that join sets with different labels within keys that many sets share; `large`: key, node, n, label, lanes, and the key's sets m and their hashes.

    A set is sent to the pairs of tiles where it has a candidate, and those return at most one link for each label.
    """
    tiles = F.ceil(F.greatest(F.col("m") / TILE, F.col("hashes") / TILE_HASHES)).cast("int")
    rows = large.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "node", "n", "label", "lanes")
    found = staged(rows.groupBy("key", "p", "q").applyInArrow(_with_candidates(least, lanes), rows.schema), "candidates")
    sets = _whole_sets(found.select("node").distinct(), docs, points, shingle)
    return found.join(sets, "node").groupBy("key", "p", "q").applyInArrow(_linked_in_tile(least, lanes), "u long, v long")


def _named_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set(t.as_py(), shingle) for t in batch["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])
        give_back()

    return run


def _confirm(least: Fraction):
    """Of pairs with their sets, those that are as alike as `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a"], batch["b"]):
                a, b = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common * (least.numerator + least.denominator) >= least.numerator * (len(a) + len(b)))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _whole_sets(nodes: DataFrame, docs: DataFrame, points: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of the sets of `nodes` (node), read again from a text of each."""
    wanted = staged(points.select("node", "row").join(nodes, "node", "left_semi"), "wanted")
    texts = docs.select("row", "text").join(wanted, "row").select("node", "text")
    return staged(texts.mapInArrow(_named_sets(shingle), "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes")), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, points: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs u, v whose whole sets are similar enough.  A set that many pairs have as v goes to as many tasks as that takes."""
    pairs = staged(pairs, "pairs")
    sets = _whole_sets(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct(), docs, points, shingle)
    parts = staged(pairs.groupBy("v").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")), "parts")
    of_v = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")).join(parts.drop("n"), "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    told = join_evenly(pairs, parts, "v", "n", pairs.count()).select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    of_u = told.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    return of_u.join(of_v.drop("parts"), ["v", "part"]).select("u", "v", "a", "b").mapInArrow(_confirm(least), "u long, v long")


def _shared_keys(keyed: DataFrame, least: Fraction, label: str = "node", more: tuple[str, ...] = ()) -> DataFrame:
    """key, m (its sets) and the sums `more` of the keys that may hold a link between labels; `keyed`: key, node, n, lane.

    Keys that sets share by chance, which grow faster than their number, nearly all have two sets.  Those are judged
    here, in the sums of a key: two sets' first lanes differ in the bits of their xor.
    """
    # every column is read, so that Spark shuffles `keyed` once for these sums and for the join to them
    nodes = [F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor("node").alias("nodes")]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("few"), F.max("n").alias("many"), F.sum("n").alias("hashes"), F.bit_xor("lane").alias("xor"), F.min(label).alias("lo"), F.max(label).alias("hi"), *nodes)
    two = (F.col("few") * least.denominator >= F.col("many") * least.numerator) & (F.bit_count("xor") <= farthest(float(least)))
    return sizes.where((F.col("lo") < F.col("hi")) & ((F.col("m") > 2) | two) & F.col("high").isNotNull()).select("key", "m", *more)


def _pairs_of_sums(keys: DataFrame) -> DataFrame:
    """The pairs u > v of the sets of keys with two or three, from their sums low, high and nodes (xor)."""
    middle = F.col("nodes").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    low, high = F.col("low"), F.col("high")
    pairs = F.when(F.col("m") == 2, F.array(pair(high, low))).otherwise(F.array(pair(high, low), pair(high, middle), pair(middle, low)))
    return keys.select(F.explode(pairs).alias("p")).select("p.u", "p.v").distinct()


def _to_centres(shared: DataFrame, least: Fraction) -> DataFrame:
    """For each set the CENTRES of its blocks that have the most candidates; a block's centre is its set with the most.

    `shared` has key, node, n, lane, label and m (the key's sets); every row meets its block's centre once.
    """
    scored = shared.join(shared.groupBy("node").agg(F.sum("m").alias("score")), "node")
    centre = scored.groupBy("key").agg(F.max_by(F.struct("node", "n", "lane", "label", "score"), F.struct("score", "node")).alias("c"))
    met = scored.select("key", F.struct("node", "n", "lane", "label").alias("x")).join(centre, "key")
    may = (F.col("x.label") != F.col("c.label")) & _close("x", "c", least)
    best = met.groupBy(F.col("x.node").alias("u")).agg(F.collect_set(F.when(may, F.struct("c.score", "c.node"))).alias("c"))
    return best.select("u", F.explode(F.slice(F.sort_array("c", asc=False), 1, CENTRES)).alias("c")).select("u", F.col("c.node").alias("v"))


def _keyed(sets: DataFrame, lanes: int, width: int, blocks: int) -> DataFrame:
    """A row for each set and block; `sets`: node, n, lanes, label."""
    keyed = sets.select("node", "n", "lanes", "label").mapInArrow(_keys(lanes, width, blocks), "node long, n long, lane long, label long, keys array<bigint>")
    return keyed.select("node", "n", "lane", "label", F.explode("keys").alias("key")).repartition("key")


def _grouped(docs: DataFrame, points: DataFrame, shingle: int, lanes: int, width: int, blocks: int, least: Fraction) -> DataFrame:
    """node and component over all links between the sets of `points` (node, row, n, lanes)."""
    sets = points.where("n > 0").select("node", "n", "lanes", F.col("lanes")[0].alias("lane"))
    keyed = _keyed(sets.withColumn("label", F.col("node")), lanes, width, math.ceil(FIRST * blocks))
    many = staged(keyed.join(_shared_keys(keyed, least).where(F.col("m") > SMALL), "key"), "shared")
    first = staged(_to_centres(many, least), "first")
    labels = components(_confirmed(first, docs, points, shingle, least))
    # what the first links leave apart, in all blocks
    sets = staged(sets.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
    keyed = _keyed(sets, lanes, width, blocks)
    keys = _shared_keys(keyed, least, "label", ("hashes", "low", "high", "nodes"))
    many = keyed.join(keys.where(F.col("m") > SMALL).select("key", "m", "hashes"), "key")
    # one table, so that `keyed` is shuffled once
    shared = staged(many.unionByName(keys.where(F.col("m") <= SMALL), allowMissingColumns=True), "shared")
    few, many = shared.where(F.col("m") <= SMALL), shared.where(F.col("m") > SMALL).select("key", "node", "n", "label", "m", "hashes")
    a, b = sets.alias("a"), sets.alias("b")
    apart = (F.col("a.label") != F.col("b.label")) & _close("a", "b", least) & (_apart(lanes) <= farthest(float(least), lanes))
    pairs = _pairs_of_sums(few).join(a, F.col("u") == F.col("a.node")).join(b, F.col("v") == F.col("b.node")).where(apart).select("u", "v")
    tried = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    more = _in_tiles(many.join(sets.select("node", "lanes"), "node"), docs, points, shingle, least, lanes)
    more = more.unionAll(_confirmed(pairs.join(tried, ["u", "v"], "left_anti"), docs, points, shingle, least))
    return components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more))


def _linked(docs: DataFrame, shingle: int, similarity: float, recall: float, lanes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row, node), sets (node, low, first, weight: least doc_id, first row and number of rows) and node, component."""
    least = Fraction(str(similarity))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    prints = staged(docs.mapInArrow(_sketches(shingle, lanes), "doc_id long, row long, node long, n long, lanes array<bigint>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    points = prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.any_value("n").alias("n"), F.any_value("lanes").alias("lanes"), F.count("*").alias("weight"), first)
    points = staged(points, "points")
    # without a bit in a block all sets share the one block
    width, blocks = plan(points.count(), similarity, recall) if recall < 1 else (0, 1)
    return prints.select("doc_id", "row", "node"), points, _grouped(docs, points, shingle, lanes, width, blocks, least)


def similar_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = RECALL, lanes: int = LANES) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links), one row per input row.

    Texts are lower-cased (A-Z), split at ASCII white space and cut into shingles of `shingle` words; a text with fewer
    words is one shingle.  Texts link if their sets of shingles have a Jaccard similarity of `similarity` at least and
    share a block, which `recall` of the pairs of just that similarity do, and more of those that are closer; or if both
    are without words.  recall=1 compares all pairs of sets in tiles: exact, for tables of some 100,000 texts.  Null
    texts have no words.  Rows that repeat a doc_id are rows of their own.  A null doc_id gets its component's smallest
    id, or null if there is none.  Other columns are ignored; no rows give no rows.
    """
    rows, points, groups = _linked(docs, shingle, similarity, recall, lanes)
    return named(rows.select("doc_id", "node"), points, groups).select("doc_id", "component_id")


def drop_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = RECALL, lanes: int = LANES) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest doc_id, of rows without one the smallest hash.

    Groups are those of similar_copies(), but rows are dropped, not ids: of rows that repeat a doc_id with other texts
    each stays or goes by its own text, and rows without a doc_id are judged like others.  Of rows that agree in doc_id and
    text one stays.  Columns keep their names, types and order; no rows give no rows.
    """
    rows, points, groups = _linked(docs, shingle, similarity, recall, lanes)
    found = staged(points.select("node", "first", "weight").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "found")
    kept = staged(found.groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("members")), "kept")
    of_node = join_evenly(found.select("component", "node", "weight"), kept, "component", "members", points.count())
    told = join_evenly(rows, staged(of_node.select("node", "kept", "weight"), "of_node"), "node", "weight", rows.count())
    gone = staged(told.where(F.col("row") != F.col("kept.row")).select("row").distinct(), "gone")
    twice = staged(told.where(F.col("row") == F.col("kept.row")).groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "twice")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.struct(*names).alias("doc"))
    left = keyed.join(gone, "row", "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, "row", "left_anti").unionAll(left.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return left.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
