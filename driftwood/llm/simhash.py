"""SimHash near-dedup: pigeonhole blocks.

A fingerprint has one or more 64-bit lanes; a bit is set if more than half of the text's shingles set it.  Fingerprints
are split into equal blocks.  Two that differ in at most d of b blocks' worth of bits agree in at least b - d whole
blocks, so rows are joined on every choice of `agree` blocks and the Hamming distance is verified in the join.  Equal
fingerprints are one row throughout.  A choice that more than `SMALL` fingerprints share is not joined pair by pair: it
is cut into tiles, each pair of tiles is one task's work, and a task returns a spanning forest of its links, at most one
row per fingerprint.  `near_copies` links at a few differing bits; `similar` has the way for a similarity of sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.components import components
from driftwood.llm.exchange import give_back, join_evenly, mix, staged

#: Fingerprints that share a choice of blocks and are still joined pair by pair.
SMALL = 16
#: Fingerprints in a tile of a larger choice.
TILE = 8_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 18
#: Hashes whose bits are added up as planes before they are unpacked.
ADDED = 31
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
U = np.uint64
_SPACE = re.compile(rb"[ \t-\r]")


def _word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased (A-Z), a slice at a time."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _windows(words: list[bytes], k: int) -> list[int]:
    """XXH64 (seed 42) of each run of k words."""
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return [h(line[a:z], 42) for a, z in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())]


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of k words, repeats included; a text of fewer words is one shingle, one of none has none."""
    found: list[np.ndarray] = []
    held: list[bytes] = []
    for words in _word_slices(text or b""):
        held += words
        if len(held) >= k:
            found.append(np.array(_windows(held, k), U))
            held = held[len(held) - k + 1 :]
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), 42)] if held else [], U)
    return found[0] if len(found) == 1 else np.concatenate(found)


def _planes(terms: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of the terms' bits, place by place, as binary digits: plane b has the digit of weight 2**b of all places."""
    out = []
    while terms:
        above = []
        while len(terms) > 1:
            x, y, *z = (terms.pop() for _ in range(min(3, len(terms))))
            half = x ^ y
            terms.insert(0, half ^ z[0] if z else half)
            above.append(x & y | half & z[0] if z else x & y)
        out.append(terms[0])
        terms = above
    return out


class Votes:
    """Counts, for texts of `size` hashes each, how many of a text's hashes set each of 64 bits."""

    def __init__(self, hashes: np.ndarray, size: np.ndarray):
        self.size = size
        rows = -(-size // ADDED)
        first = np.cumsum(rows) - rows
        place = np.arange(len(hashes)) + np.repeat(first * ADDED - (np.cumsum(size) - size), size)
        self.hashes, self.own = np.zeros(int(rows.sum()) * ADDED, U), np.zeros(int(rows.sum()) * ADDED, U)
        self.hashes[place], self.own[place] = hashes, ~U(0)
        self.some, self.first = rows > 0, first[rows > 0]

    def majority(self, lane: int) -> np.ndarray:
        """Per text the bits that over half of its hashes set, 0 for none.  Lane 0 takes the hashes as they are, others scramble them."""
        out = np.zeros(len(self.size), U)
        if not len(self.hashes):
            return out
        h = mix(self.hashes + U(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if lane else self.hashes
        columns = np.ascontiguousarray((h & self.own).reshape(-1, ADDED).T)
        votes = 0
        for b, plane in enumerate(_planes(list(columns))):
            votes = votes + (np.unpackbits(plane.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int32) << b)
        votes = np.add.reduceat(votes, self.first, axis=0)
        out[self.some] = np.packbits(votes * 2 > self.size[self.some, None], axis=1).view(">u8").ravel()
        return out


def _fingerprints(shingle: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            found: list[list[np.ndarray]] = [[] for _ in range(lanes)]
            k = 0
            while k < len(texts):
                hashes, n = [], 0
                while k < len(texts) and n < COUNTED:
                    hashes.append(shingle_hashes(texts[k].as_py(), shingle))
                    n += len(hashes[-1])
                    k += 1
                votes = Votes(np.concatenate(hashes), np.array([len(x) for x in hashes], np.int64))
                for lane in range(lanes):
                    found[lane].append(votes.majority(lane))
            columns = [np.concatenate(f).view(np.int64) if f else np.zeros(0, np.int64) for f in found]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(columns).ravel() if len(texts) else np.zeros(0, np.int64)), lanes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "lanes"])
        give_back()

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and lanes (array of 64-bit values): lane 0 takes each shingle's XXH64 (seed 42) as it is, the others scramble it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(shingle, lanes), "doc_id long, lanes array<bigint>")


def _blocks(lanes: int, width: int) -> list[Column]:
    return [F.shiftrightunsigned(F.col("lanes")[k], at).bitwiseAND(F.lit((1 << width) - 1)) for k in range(lanes) for at in range(0, 64, width)]


def _apart(lanes: int) -> Column:
    """Differing bits of a pair."""
    out = F.lit(0)
    for k in range(lanes):
        out = out + F.bit_count(F.col("a.lanes")[k].bitwiseXOR(F.col("b.lanes")[k]))
    return out


def _forest(distance: int):
    """A spanning forest of the links within one pair of tiles.

    Fingerprints are taken up one at a time; each not yet reached is compared to those reached last, so every pair is
    compared at most once and one link is kept per fingerprint.
    """

    def run(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        lanes = t["lanes"].combine_chunks().flatten().to_numpy().reshape(len(node), -1).view(U)
        node, at = np.unique(node, return_index=True)
        lanes = lanes[at]
        left = np.arange(len(node))
        us, vs = [], []
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                me = front.pop()
                near = np.bitwise_count(lanes[left] ^ lanes[me]).sum(axis=1) <= distance
                got = left[near]
                us += node[got].tolist()
                vs += [int(node[me])] * len(got)
                front += got.tolist()
                left = left[~near]
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _in_tiles(large: DataFrame, distance: int) -> DataFrame:
    """Links within choices that many fingerprints share."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = large.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("choice", "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "node", "lanes")
    return rows.groupBy("choice", "key", "p", "q").applyInArrow(_forest(distance), "u long, v long")


def links(points: DataFrame, lanes: int, width: int, agree: int, distance: int) -> DataFrame:
    """Pairs u, v of `points` (node, lanes; distinct in lanes) that agree in `agree` blocks of `width` bits and differ in at most `distance` bits."""
    blocks = _blocks(lanes, width)
    choices = list(combinations(range(len(blocks)), agree))
    keyed = points.select(
        "node", "lanes", F.posexplode(F.array(*[F.xxhash64(*[blocks[k] for k in c]) if agree * width > 64 else _joined([blocks[k] for k in c], width) for c in choices])).alias("choice", "key")
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(sizes, ["choice", "key"]), "shared")
    small = shared.where(F.col("n") <= SMALL).select("choice", "key", "node", "lanes")
    a, b = small.alias("a"), small.alias("b")
    near = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (_apart(lanes) <= distance)
    pairs = a.join(b, near).select(F.col("b.node").alias("u"), F.col("a.node").alias("v"))
    return pairs.unionAll(_in_tiles(shared.where(F.col("n") > SMALL), distance))


def _joined(parts: list[Column], width: int) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.shiftleft(out, width).bitwiseOR(p)
    return out


def near_copies(docs: DataFrame, shingle: int = 3, lanes: int = 1, width: int = 16, agree: int = 2, distance: int = 2) -> DataFrame:
    """doc_id, lanes and component_id (the smallest doc_id reachable over links), one row per input row.

    Texts are lower-cased (A-Z), split at ASCII white space and cut into shingles of `shingle` words, repeats
    included; a text with fewer words is one shingle, one without words has fingerprint zero and links like any other.
    Fingerprints link if they agree in `agree` of their blocks of `width` bits and differ in at most `distance` bits;
    with the defaults (4 blocks, 2 agree) agreement follows from the distance, so all such pairs are found.  With
    lanes=4, agree=1 there are 16 blocks, and agreement follows up to 15 bits.  Null texts have no words.  Rows that
    repeat a doc_id are rows of their own.  A null doc_id gets its component's smallest id, or null if there is none.
    """
    node = F.col("lanes")[0] if lanes == 1 else F.xxhash64("lanes")
    prints = staged(fingerprints(docs, shingle, lanes).withColumn("node", node), "fingerprints")
    points = staged(prints.groupBy("node").agg(F.any_value("lanes").alias("lanes"), F.min("doc_id").alias("low"), F.count("*").alias("weight")), "points")
    groups = components(links(points.select("node", "lanes"), lanes, width, agree, distance))
    return named(prints.select("doc_id", "lanes", "node"), points, groups).drop("node")


def named(rows: DataFrame, points: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` (node and more) with component_id, the least `low` of the node's component; `points`: node, low and weight (its rows), `groups`: node, component."""
    found = staged(points.select("node", "low", "weight").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "found")
    lows = found.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    total = found.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    of_node = join_evenly(found.select("component", "node", "weight"), staged(lows, "lows"), "component", "members", total).drop("component")
    return join_evenly(rows, staged(of_node, "of_node"), "node", "weight", total)
