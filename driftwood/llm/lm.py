"""Language-model scoring: context-tree weighting over bytes.

A byte is eight binary decisions.  Each decision, under each context of the 0 to `DEPTH` bytes before it, is a node with
counts of zeros and ones and a Krichevsky-Trofimov estimate.  A node's weighted probability is half its own estimate
and half the product of its children's (the same decision, one more byte of context), so all depths are mixed by how
well they describe the training texts; a byte's code length follows from the mixture along its context.

The corpus's distinct runs of DEPTH + 1 bytes, with their training counts, are the model; they are gathered by Spark
and grow with the corpus.  What senders have for shards, and shards for blocks, takes a second hop where there are many.
Blocks of documents (see exchange) send distinct runs and words to hash shards, shards add
them up, trees are weighted per last two bytes of context (all deeper nodes of a tree are there), and each block asks
the shards for the code lengths of the runs and the counts of the words that its documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import exchange as X

#: Bytes of context.
DEPTH = 5
#: Bytes of text whose runs are added up before they are sent.
SENT_BYTES = 16 << 20
SHARD_BYTES = 16 << 20
HELD_OUT, FOLDS = 2, 7
U = np.uint64
END = b"\n"
RUNS, WORDS, KINDS = 0, 1, 2
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _runs(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each byte of the lines and the DEPTH bytes before it (a line's first follow ends), and each line's first place.

    From the top: the last byte of context, the one before it, ..., and the byte itself.
    """
    pad = END * DEPTH
    b = np.frombuffer(b"".join([pad + x for x in lines]), np.uint8).astype(U)
    m = max(0, len(b) - DEPTH)
    code = b[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        code |= b[DEPTH - back : DEPTH - back + m] << U(8 * (DEPTH + 1 - back))
    size = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(size + DEPTH) - (size + DEPTH)
    own = np.ones(m + DEPTH, np.int8)
    own[(first[1:, None] - DEPTH + np.arange(DEPTH)).ravel()] = 0  # those that end in padding
    return code[own[:m] > 0], np.cumsum(size) - size


def _line(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((X.mix(keys) >> U(20)) % U(shards)).astype(np.int64)


def _targets(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys, sorted before, by target, and the targets in it: a kind's shards come after those of the kinds before."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, (kind * shards + shard[order]).astype(np.uint32)


def _dealt(parts: dict[int, tuple[np.ndarray, np.ndarray]], shards: int) -> pa.Table:
    """Sorted keys and counts of each kind, sent to their shards."""
    out = [(target, keys[order], counts[order]) for kind, (keys, counts) in sorted(parts.items()) for order, target in [_targets(kind, keys, shards)]]
    return X.send([np.concatenate(x) for x in zip(*out)], KINDS * shards)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order: sorting is faster than np.unique's hash table."""
    keys = np.sort(keys)
    return keys[X.firsts(keys)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = X.firsts(k)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _gather(shards: int):
    """Distinct runs and words of texts with their training counts (0 for those that only held-out texts hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {RUNS: [], WORDS: []}
        size = 0

        def send() -> list[pa.RecordBatch]:
            rows = _dealt({kind: _summed([p[0] for p in parts], [p[1] for p in parts]) for kind, parts in held.items() if parts}, shards)
            for parts in held.values():
                parts.clear()
            return rows.to_batches()

        for batch in batches:
            texts, out = batch["text"].cast(pa.binary()).to_pylist(), batch["held_out"].to_pylist()
            k = 0
            while k < len(texts):
                lines: dict[bool, list[bytes]] = {False: [], True: []}
                words: list[bytes] = []
                a, n = k, 0
                while k < len(texts) and n < X.BLOCK_BYTES // 4:
                    w = _words(texts[k])
                    lines[out[k]].append(_line(w))
                    if not out[k]:
                        words += [*w, END]
                    n += len(lines[out[k]][-1])
                    k += 1
                for side, ls in lines.items():
                    if ls:
                        u, c = np.unique(_runs(ls)[0], return_counts=True)
                        held[RUNS].append((u, c.astype(np.uint32) * (not side)))
                u, c = np.unique(_hashed(words), return_counts=True)
                held[WORDS].append((u, c.astype(np.uint32)))
                size += n
                if size >= SENT_BYTES:
                    yield from send()
                    size = 0
        if size:
            yield from send()

    return run


_SUMS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary()), ("n_keys", pa.int64()), ("n_all", pa.int64())])


def _add_up(shards: int):
    def run(t: pa.Table) -> pa.Table:
        kind, shard = divmod(t["hop"][0].as_py(), shards)
        _, keys, counts = X.receive(t)
        keys, counts = _summed([keys], [counts.astype(np.int64)])
        return pa.table([[kind], [shard], [X.pack(keys, counts)], [int(np.count_nonzero(counts))], [int(counts.sum())]], schema=_SUMS)

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of gamma by Stirling's series, moved up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Counts whose log-gamma values are looked up.
_TABLE = 1 << 16


@lru_cache
def _small(plus: float) -> np.ndarray:
    return _log_gamma(np.arange(_TABLE) + plus)


def _log_gamma_of(n: np.ndarray, plus: float) -> np.ndarray:
    """log of gamma(n + plus) of counts, which are whole numbers of any type."""
    n = n.astype(np.int64)
    out = _small(plus)[np.minimum(n, _TABLE - 1)]
    big = n >= _TABLE
    if big.any():
        out[big] = _log_gamma(n[big] + plus)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return _log_gamma_of(n0, 0.5) + _log_gamma_of(n1, 0.5) - _log_gamma_of(n0 + n1, 1.0) - np.log(np.pi)


def _weighed(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and the share of a node's own estimate in it."""
    own, rest = np.log(0.5) + _log_kt(n0, n1), np.log(0.5) + below
    both = np.logaddexp(own, rest)
    return both, np.exp(own - both)


def _decision(keys: np.ndarray, level: int) -> np.ndarray:
    """A decision's number is 1 for the first bit and, below, the bits so far after a leading 1."""
    return U(1 << level) | (keys & U(255)) >> U(8 - level)


def _bit(keys: np.ndarray, level: int) -> np.ndarray:
    return (keys >> U(7 - level) & U(1)) > 0


class Depth:
    """The nodes of one depth, from distinct sorted (context, byte) keys and counts: per level of decisions `at`, a
    node's first key; `node`, each key's node; `n0` and `n1`; and, once weighed, `share`.

    Keys without training counts have nodes too: with neither zeros nor ones, these give 1/2 and weigh nothing.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.at, self.node, self.n0, self.n1 = keys, [], [], [], []
        for level in range(8):
            at = X.firsts(keys >> U(8 - level))
            first = np.zeros(len(keys), np.int32)
            first[at] = 1
            ones = np.add.reduceat(counts * _bit(keys, level), at)
            self.at.append(at)
            self.node.append(np.cumsum(first, dtype=np.int32) - 1)
            self.n0.append(np.add.reduceat(counts, at) - ones)
            self.n1.append(ones)
        self.share: list[np.ndarray] = []
        self.log: list[np.ndarray] = []

    def weigh(self, below: Depth | None, up: np.ndarray | None) -> None:
        """Logs and shares, from those of the depth below; `up` has the place here of each key there."""
        for level, (n0, n1) in enumerate(zip(self.n0, self.n1)):
            if below is None:
                self.log.append(_log_kt(n0, n1))
                continue
            parent = self.node[level][up[below.at[level]]]
            log, share = _weighed(n0, n1, np.bincount(parent, below.log[level], len(n0)))
            self.log.append(log)
            self.share.append(share)

    def own(self, level: int) -> np.ndarray:
        """Each key's next bit by the estimate of its node."""
        n0, n1, node = self.n0[level], self.n1[level], self.node[level]
        total = n0 + n1 + 1.0
        return np.where(_bit(self.keys, level), ((n1 + 0.5) / total)[node], ((n0 + 0.5) / total)[node])


class Tree:
    """The nodes of depth 2 to DEPTH whose contexts end in given bytes, from distinct sorted codes with counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        below, up = None, None
        self.depths: list[tuple[Depth, np.ndarray]] = []
        keys, n = codes, counts
        for d in range(DEPTH, 1, -1):
            depth = Depth(keys, n)
            depth.weigh(below, up)
            shorter, up = np.unique(keys >> U(16) << U(8) | keys & U(255), return_inverse=True)
            self.depths.append((depth, up))
            below = depth
            keys, n = shorter, np.bincount(up, n, len(shorter)).astype(np.int64)
        #: (last byte of context, byte) of all codes.
        self.last = keys

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By the last byte of context and decision: zeros, ones and the summed logs of depth 2's nodes with training counts."""
        depth = self.depths[-1][0]
        first = [depth.keys[at] for at in depth.at]
        node = np.concatenate([k >> U(16) << U(8) | _decision(k, level) for level, k in enumerate(first)])
        n0, n1, log = (np.concatenate(x) for x in (depth.n0, depth.n1, depth.log))
        seen = n0 + n1 > 0
        parent, at = np.unique(node[seen], return_inverse=True)
        return parent, *(np.bincount(at, x[seen]).astype(float) for x in (n0, n1, log))

    def lengths(self, top: Top) -> np.ndarray:
        """log10 P(byte | context) of each code: from the root down, what shorter contexts leave to longer ones."""
        chance = np.ones(len(self.depths[0][0].keys))
        for level in range(8):
            have, left = top.parts(self.last >> U(8), _decision(self.last, level), _bit(self.last, level))
            for depth, up in reversed(self.depths):
                have, left, own = have[up], left[up], depth.own(level)
                if depth.share:
                    share = depth.share[level][depth.node[level]]
                    have, left = have + left * share * own, left * (1 - share)
                else:
                    have += left * own
            chance *= have
        return np.log10(chance)


def _by_tree(trees: int):
    """A shard's runs by the tree of their last two bytes of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                keys, counts = X.unpack(payload)
                tree = _shard(keys >> U(8 * (DEPTH - 1)), trees)
                order = np.argsort(tree, kind="stable")
                yield from X.send([tree[order].astype(np.uint32), keys[order], counts[order]], trees).to_batches()

    return run


def _runs_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    _, keys, counts = X.receive(t)
    return _summed([keys], [counts])


_TOP = pa.schema([("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("below", pa.float64())])


def _top_sums(t: pa.Table) -> pa.Table:
    """Of a tree: by the last byte of context and decision, counts and the summed logs of its depth-2 nodes."""
    codes, counts = _runs_of(t)
    if not counts.any():
        return _TOP.empty_table()
    node, *sums = Tree(codes, counts).top()
    return pa.table([node.astype(np.int64), *sums], schema=_TOP)


class Top:
    """Depths 1 and 0, at most 256 x 255 nodes and 255, from the sums of depth 2."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        order = np.argsort(node)
        node, n0, n1, below = node[order], n0[order], n1[order], below[order]
        log, share = _weighed(n0, n1, below)
        self.one = (node, n0, n1, share)
        root, at = np.unique(node & U(255), return_inverse=True)
        m0, m1, under = (np.bincount(at, x, len(root)) for x in (n0, n1, log))
        self.zero = (root, m0, m1, _weighed(m0, m1, under)[1])

    @staticmethod
    def _part(node, n0, n1, share, wanted, bit):
        """A depth's own part of P(bit), and what it leaves to longer contexts; 1/2 where it has no such node."""
        if not len(node):
            return np.full(len(bit), 0.5), np.zeros(len(bit))
        at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
        own, has = (np.where(bit, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1), node[at] == wanted
        return np.where(has, share[at] * own, 0.5), np.where(has, 1 - share[at], 0.0)

    def parts(self, last: np.ndarray, decision: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of P(bit), what depths 0 and 1 give, and the weight of the longer contexts."""
        zero, rest = self._part(*self.zero, decision, bit)
        one, left = self._part(*self.one, last << U(8) | decision, bit)
        return zero + rest * one, rest * left


def _lengths(top, shards: int):
    def run(t: pa.Table) -> pa.Table:
        codes, counts = _runs_of(t)
        value = Tree(codes, counts).lengths(top.value)
        order, target = _targets(RUNS, codes, shards)
        return X.send([target, codes[order], value[order]], shards)

    return run


def _ask(shards: int):
    def run(t: pa.Table) -> pa.Table:
        X.give_back()
        words = [_words(x) for x in t["text"].cast(pa.binary()).to_pylist()]
        targets, asked = [], []
        for kind, keys in ((RUNS, _distinct_runs(words)), (WORDS, _distinct(_hashed([*{x for w in words for x in w}, END])))):
            order, target = _targets(kind, keys, shards)
            targets.append(target)
            asked.append(keys[order])
        target = np.concatenate(targets)
        return X.send([target, np.full(len(target), t["block"][0].as_py(), np.uint32), np.concatenate(asked)], KINDS * shards)

    return run


def _distinct_runs(words: list[list[bytes]]) -> np.ndarray:
    found, lines, size = [], [], 0
    for w in words:
        lines.append(_line(w))
        size += len(lines[-1])
        if size >= X.BLOCK_BYTES // 4:
            found.append(_distinct(_runs(lines)[0]))
            lines, size = [], 0
    if lines:
        found.append(_distinct(_runs(lines)[0]))
    return _distinct(np.concatenate(found))


def _answer(shards: int, blocks: int):
    """What a shard knows of the keys that blocks ask for: code lengths or counts, with the keys."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return X.HOP_SCHEMA.empty_table()
        kind = asked["hop"][0].as_py() // shards
        _, block, want = X.receive(asked)
        parts = [X.unpack(x)[-2:] for x in model["payload"].to_pylist()]
        keys, values = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((U, float), zip(*parts))) if parts else (np.zeros(0, U), np.zeros(0))
        got = np.zeros(len(want))
        if len(keys):
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            got = np.where(keys[at] == want, values[at], 0.0)
        # each block's keys came sorted
        order = np.argsort(block, kind="stable")
        return X.send([block[order], np.full(len(want), kind, np.uint8), want[order], got[order]], blocks)

    return run


def _score(train_tokens: int, vocabulary: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        X.give_back()
        _, kind, keys, values = X.receive(answers)
        order = np.argsort(keys, kind="stable")
        known = {want: (keys[order[kind[order] == want]], values[order[kind[order] == want]]) for want in (RUNS, WORDS)}
        del kind, keys, values, order
        words = [_words(x) for x in docs["text"].cast(pa.binary()).to_pylist()]
        # a hash table: places of unsorted keys are found faster than by bisection
        runs, run_value = pd.Index(known[RUNS][0]), known[RUNS][1]
        score, size = np.zeros(len(words)), np.zeros(len(words), np.int64)
        k = 0
        while k < len(words):
            a, lines, n = k, [], 0
            while k < len(words) and n < X.BLOCK_BYTES // 4:
                lines.append(_line(words[k]))
                n += len(lines[-1])
                k += 1
            code, first = _runs(lines)
            score[a:k] = np.add.reduceat(run_value[runs.get_indexer(code)], first)
            size[a:k] = [len(x) for x in lines]
        keys, counts = known[WORDS]
        base = np.log10((counts + 1.0) / (train_tokens + (vocabulary + 1.0)))
        h = _hashed([x for w in words for x in (*w, END)])
        at = pd.Index(keys).get_indexer(h)
        n = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(n) - n
        known_tokens = np.add.reduceat((counts[at] > 0).astype(np.int64), first)
        columns = [docs["doc_id"], docs["held_out"], n, known_tokens, np.full(len(words), train_tokens), np.add.reduceat(base[at], first), score, size]
        return pa.table(columns, schema=_OUT)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Score all texts by a model of those whose crc32(doc_id as text) mod 7 is not 2; one row per input row.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text is its words, joined by one space, and an end.
    Returns doc_id, held_out, n_tokens (words and the end), n_known (those with training counts), train_tokens,
    base_score (add-one unigram log10 probability), score (the context tree's log10 probability), n_bytes (of the text
    scored) and bits_per_byte.  Words are told apart by 64-bit hashes.  Null texts are empty: just an end.  A null
    doc_id counts as training.  Without training texts the tree gives each bit 1/2.  Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "utf-8")) % FOLDS, F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (key == HELD_OUT).alias("held_out"))
    total = X.text_bytes(docs, row=X.ROW_BYTES)
    shards = X.parts_of(total, SHARD_BYTES)
    blocks, both = X.parts_of(total, X.BLOCK_BYTES), KINDS * shards
    sent = X.routed(docs.select("text", "held_out").mapInArrow(_gather(shards), X.HOP), both)
    sums = X.staged(sent.groupBy("hop").applyInArrow(_add_up(shards), "kind int, shard int, payload binary, n_keys long, n_all long"), "sums")
    words = sums.where(F.col("kind") == WORDS)
    vocabulary, train_tokens = words.agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    dealt_trees = sums.where(F.col("kind") == RUNS).select("payload").mapInArrow(_by_tree(shards), X.HOP)
    by_tree = X.staged(X.routed(dealt_trees, shards), "trees").groupBy("hop")
    # at most 256 x 255 rows come to the driver
    tops = by_tree.applyInArrow(_top_sums, "node long, n0 double, n1 double, below double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas()
    top = spark.sparkContext.broadcast(Top(tops["node"].to_numpy().astype(U), *(tops[c].to_numpy(float) for c in ("n0", "n1", "below"))))
    lengths = X.routed(by_tree.applyInArrow(_lengths(top, shards), X.HOP), shards)
    model = X.staged(lengths.unionAll(words.select((F.col("kind") * shards + F.col("shard")).alias("hop"), "payload")), "model")
    dealt = X.blocked(docs, blocks)
    asked = X.routed(dealt.groupBy("block").applyInArrow(_ask(shards), X.HOP), both)
    answers = X.routed(asked.groupBy("hop").cogroup(model.groupBy("hop")).applyInArrow(_answer(shards, blocks), X.HOP), blocks).withColumnRenamed("hop", "block")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(int(train_tokens), int(vocabulary)), OUT)
    return scored.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
