"""Similarity join of n-gram sets by PartEnum signatures; every pair that is similar enough is found.

Sets are banded by size, so that similar ones are in one band or in neighbouring ones, and each set makes signatures for
its own band and the next.  Similar sets of a band's instance differ in at most k shingles.  The domain of shingle
hashes is cut into (k + 1) / 2 ranges, so in one range they differ in at most one shingle; that range is cut into three
parts, two of which are then equal.  A signature is the hash of a set's shingles in two of the three parts of a range:
similar sets share one at least, and sets that share none are never compared.

Texts are read a chunk at a time.  Equal sets are one node.  A chunk links the nodes that share a signature by a forest
and sends each signature once to the shard that owns it, which links chunks alike, so a signature that very many sets
share costs a chunk one entry.  The forests tell *candidate groups*; within these, sets are compared in tiles, first by
parity sketches, whose distance never exceeds the sets', then by the whole sets.  A group of more than `WHOLE` sets is
cut by signature instead.  A tile returns a forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.components import components
from driftwood.llm.exchange import firsts, give_back, join_evenly, mix, parts_of, receive, routed, send, staged, text_bytes
from driftwood.llm.simhash import named, shingle_hashes

U = np.uint64
#: Shingles of a chunk of texts, about.
CHUNK = 1 << 20
#: Parts of a range, of which two make a signature.
PARTS = 3
PAIRS_OF_PARTS = ((0, 1), (0, 2), (1, 2))
#: Bytes of text per shard of signatures.
SHARD_BYTES = 12 << 20
#: Bytes of sets, and sets, in a tile.
TILE_BYTES, TILE = 8 << 20, 2_000
#: Sets of a candidate group that are compared as a whole; beyond, those that share a signature.
WHOLE = 50_000
#: Bits of a parity sketch per shingle.
SKETCH = 4


class Bands:
    """Size bands for a least similarity: sets as alike as that are in one band or in neighbouring ones."""

    def __init__(self, least: Fraction, largest: int):
        self.least = least
        ends = [0]
        while ends[-1] < largest * least.denominator // least.numerator + 1:
            ends.append(max(ends[-1] + 1, int((ends[-1] + 1) / least)))
        self.ends = np.array(ends[1:], np.int64)
        # the most shingles in which two similar sets of a band's instance differ
        self.most = self.apart(2 * self.ends)
        self.ranges = (self.most + 2) // 2

    def apart(self, both: np.ndarray) -> np.ndarray:
        """The most shingles in which two similar sets of `both` shingles together differ."""
        return both * (self.least.denominator - self.least.numerator) // (self.least.denominator + self.least.numerator)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, size)


def signatures(sets: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, given one after another as sorted hashes, and the number of each one's set."""
    out, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets + U(0x51ED270B)), dtype=U)])
    first = np.cumsum(size) - size
    for step in (0, 1):
        instance = bands.of(size) + step
        # where no shingle may differ, similar sets are equal and so one node
        own = np.flatnonzero((size > 0) & (bands.most[instance] > 0))
        if not len(own):
            continue
        cells = PARTS * bands.ranges[instance[own]]
        n = size[own]
        place = np.arange(int(n.sum())) + np.repeat(first[own] - (np.cumsum(n) - n), n)
        cell = (sets[place] >> U(32)) * np.repeat(cells.astype(U), n) >> U(32)
        base = np.cumsum(cells) - cells
        held = np.bincount(cell.astype(np.int64) + np.repeat(base, n), minlength=int(cells.sum()))
        # hashes are sorted, so each cell is a run of them
        end = np.cumsum(held) + np.repeat(first[own] - (np.cumsum(n) - n), cells)
        sums = (total[end] - total[end - held]).reshape(-1, PARTS)
        of = np.repeat(np.arange(len(own)), cells // PARTS)
        salt = mix(instance[own][of].astype(U) << U(32) | (np.arange(len(of)) - base[of] // PARTS).astype(U))
        for k, (a, b) in enumerate(PAIRS_OF_PARTS):
            out.append(mix(sums[:, a] + mix(sums[:, b] + U(k)) + salt))
            owner.append(own[of])
    return np.concatenate(out), np.concatenate(owner)


def _grouped(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Per node 0..n-1 the least node that pairs u, v connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest_of(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (signature, node) elements: a forest (u, v) of the nodes that share one, and each signature with one of its nodes."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    names, at = np.unique(node, return_inverse=True)
    start = firsts(sig)
    head = np.repeat(at[start], np.diff(np.append(start, len(sig))))
    apart = at != head
    pairs = np.unique(np.column_stack([head[apart], at[apart]]), axis=0)
    label = _grouped(len(names), pairs[:, 0], pairs[:, 1])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]], sig[start], node[start]


def _set(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


_READ = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("hop", pa.int32()), ("payload", pa.binary())])
_READ_DDL = "doc_id long, row long, node long, n long, u long, v long, hop int, payload binary"


def _rows(**columns) -> pa.RecordBatch:
    """A batch of _READ with these columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _READ], schema=_READ)


def _reader(shingle: int, least: Fraction, shards: int):
    """Per text its node; per chunk a forest of the nodes that share a signature, and the signatures for each shard."""

    def chunk(doc_id: list, row: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(s) for s in sets], np.int64)
        node = np.array([_node(s) for s in sets], np.int64)
        yield _rows(doc_id=doc_id, row=row, node=node, n=size)
        names, at = np.unique(node, return_index=True)
        size = size[at]
        sig, owner = signatures(np.concatenate([sets[k] for k in at]), size, Bands(least, int(size.max(initial=1))))
        u, v, sig, holder = _forest_of(sig, names[owner])
        if len(u):
            yield _rows(u=u, v=v)
        if len(sig):
            shard = (sig >> U(32)) * U(shards) >> U(32)
            order = np.lexsort((sig, holder, shard))
            sent = send([shard[order].astype(np.uint32), holder[order].view(U), sig[order]], shards)
            yield _rows(hop=sent["hop"].combine_chunks(), payload=sent["payload"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id, row, sets, n = [], [], [], 0
        for batch in batches:
            for d, r, t in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["text"].cast(pa.binary())):
                doc_id.append(d)
                row.append(r)
                sets.append(_set(t.as_py(), shingle))
                n += len(sets[-1]) + 16
                if n >= CHUNK:
                    yield from chunk(doc_id, row, sets)
                    doc_id, row, sets, n = [], [], [], 0
        if sets:
            yield from chunk(doc_id, row, sets)
        give_back()

    return run


def _linked(t: pa.Table) -> pa.Table:
    """A shard's forest of the nodes that share a signature."""
    _, node, sig = receive(t)
    u, v, _, _ = _forest_of(sig, node.view(np.int64))
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set(t.as_py(), shingle) for t in batch["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])
        give_back()

    return run


def _signature_rows(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, hashes in zip(batch["node"].to_pylist(), batch["hashes"]):
                s = np.frombuffer(hashes.as_py(), U)
                sig, _ = signatures(s, np.array([len(s)]), Bands(least, len(s)))
                sig = np.unique(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), node), pa.int64()), pa.array(sig)], names=["node", "grp"])

    return run


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parities of the sets' shingles in as many buckets for all; two sketches differ in no more bits than the sets in shingles."""
    bits = 1 << max(6, int(SKETCH * max(map(len, sets))).bit_length())
    out = np.zeros((len(sets), bits // 64), U)
    for k, s in enumerate(sets):
        odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(U)
    return out


def _compared(least: Fraction):
    """Forests of the links within groups, or between two tiles of one; a group's rows are neighbours after sorting."""
    bands = Bands(least, 1)

    def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        size = np.array([len(s) for s in sets], np.int64)
        prints = _sketches(sets) if len(sets) > 4 else None
        label = np.arange(len(sets))
        for i in left.tolist():
            rest = right[(right > i) & (label[right] != label[i])] if left is right else right[label[right] != label[i]]
            allowed = bands.apart(size[rest] + size[i])
            may = np.abs(size[rest] - size[i]) <= allowed
            rest, allowed = rest[may], allowed[may]
            if prints is not None and len(rest):
                near = np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int64) <= allowed
                rest, allowed = rest[near], allowed[near]
            for j, most in zip(rest.tolist(), allowed.tolist()):
                if label[j] != label[i] and size[i] + size[j] - 2 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) <= most:
                    label[label == label[j]] = label[i]
                    yield i, j

    def run(t: pa.Table) -> pa.Table:
        grp, node, side = (t[c].to_numpy() for c in ("grp", "node", "side"))
        order = np.lexsort((node, grp))
        ends = np.append(firsts(grp[order])[1:], len(order))
        us, vs, first = [], [], 0
        for end in ends.tolist():
            own, first = order[first:end], end
            own = own[firsts(node[own])]
            sets = [np.frombuffer(t["hashes"][k].as_py(), U) for k in own.tolist()]
            sides = side[own]
            every = np.arange(len(own))
            left, right = (every, every) if (sides == 0).all() else (every[sides == 1], every[sides == 2])
            for i, j in links(sets, left, right):
                us.append(int(node[own[i]]))
                vs.append(int(node[own[j]]))
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _pairs(groups: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """A forest (u, v) of the links within each group; `groups` has grp and node, `sets` node, n and hashes."""
    rows = groups.join(sets.select("node", "n"), "node")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("m"), F.sum(F.col("n") * 8 + 64).alias("bytes")).where("m > 1")
    sizes = staged(sizes.withColumn("tiles", F.greatest(F.ceil(F.col("bytes") / TILE_BYTES), F.ceil(F.col("m") / TILE)).cast("int")), "sizes")
    total, members = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    # small groups go together by a hash, tiles of larger ones alone
    bins = parts_of(int(total), TILE_BYTES)
    rows = join_evenly(groups, sizes.select("grp", "m", "tiles"), "grp", "m", int(members))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    alone = F.col("tiles") > 1
    side = F.when(~alone | (F.col("tile") == F.col("other")), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    work = [F.when(alone, F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(bins))).alias("a"), F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), F.col("tiles").alias("of")]
    rows = rows.select(*work, "grp", "node", side.alias("side")).join(sets.select("node", "hashes"), "node")
    return rows.groupBy("a", "p", "q", "of").applyInArrow(_compared(least), "u long, v long")


def similar_sets(docs: DataFrame, shingle: int = 3, similarity: float = 0.9) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links), one row per input row.

    Texts are lower-cased (A-Z), split at ASCII white space and cut into shingles of `shingle` words; a document's set has
    the distinct ones, a text of fewer words is one shingle.  Documents link if their sets' Jaccard similarity is
    `similarity` at least; no such pair is missed.  A null or empty text, or one of white space, has no shingles and
    links with nothing: its component is its own doc_id.  Rows that repeat a doc_id are rows of their own.  A null doc_id
    gets its component's smallest id, or null if there is none.  Other columns are ignored; no rows give no rows.
    Shingles, sets and signatures are told apart by 64 bits.
    """
    least = Fraction(str(similarity))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    shards = parts_of(text_bytes(docs), SHARD_BYTES)
    read = staged(docs.mapInArrow(_reader(shingle, least, shards), _READ_DDL), "read")
    sent = read.where("hop is not null").select("hop", "payload")
    linked = routed(sent, shards).groupBy("hop").applyInArrow(_linked, "u long, v long")
    near = staged(components(linked.unionAll(read.where("u is not null").select("u", "v"))), "near")

    # the sets of candidates, and what they are compared with
    rows = read.where("node is not null").select("doc_id", "row", "node", "n")
    points = staged(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.any_value("n").alias("n"), F.count("*").alias("weight")), "points")
    wanted = staged(points.join(near, "node").select("node", "row", "n", "component"), "wanted")
    # texts are shuffled once at every size, and not sorted
    texts = docs.join(wanted.select("node", "row").hint("shuffle_hash"), "row").select("node", "text")
    sets = texts.mapInArrow(_sets_of(shingle), "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes"))
    sets = staged(sets.withColumn("n", (F.octet_length("hashes") / 8).cast("long")), "sets")
    members = wanted.groupBy("component").agg(F.count("*").alias("m"))
    giant = staged(members.where(F.col("m") > WHOLE), "giant")
    groups = wanted.select(F.col("component").alias("grp"), "node")
    if not giant.isEmpty():
        # no more of these than nodes by WHOLE
        of_giants = groups.join(F.broadcast(giant.select(F.col("component").alias("grp"))), "grp", "left_semi").select("node")
        keyed = sets.join(of_giants, "node", "left_semi").select("node", "hashes").mapInArrow(_signature_rows(least), "node long, grp long")
        groups = groups.join(F.broadcast(giant.select(F.col("component").alias("grp"))), "grp", "left_anti").unionByName(keyed)
    links = _pairs(staged(groups, "groups"), sets, least)
    found = named(rows.where("n > 0").select("doc_id", "node", "n"), points, components(links))
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n", "component_id").unionByName(empty).withColumnRenamed("n", "n_shingles")
