"""Substring dedup: repeated-phrase automata.

Rounds over blocks of documents (see exchange):

1. Every window of `window` words has an anchor, the smallest hash of the `ANCHOR` -word runs in it, so equal windows
   have equal anchors.  Blocks send distinct anchors to shards; anchors that two documents hold go back.
2. Neighbouring windows with one such anchor are a segment.  Blocks send the words of their distinct segments, with the
   smallest document that holds each, to the shard of the anchor.
3. *Confirm recurring passages*: a shard has every window with its anchors, told apart by their words.  Neighbouring
   windows that two documents hold, with one smallest document, make a passage.  Passages are compiled into
   Aho-Corasick automata of bounded size over word codes, and the segments are streamed through the automaton of their
   anchor; where passages occur, and the smallest document of each, goes back to the blocks.
4. Blocks cut the words of every occurrence whose smallest document is an earlier one.

A document visits the automata of its own anchors alone, which are all that can match in it, so work grows with the
input.  An anchor of very many windows would be one shard's work: each of its windows is a segment of its own, dealt by
all its words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm import exchange as X

WINDOW = 13
#: Words in an anchor.
ANCHOR = 5
#: Words of segments whose passages one automaton holds (more for the segments of a single anchor).
AUTOMATON_WORDS = 200_000
#: Windows with an anchor from which on they are dealt one by one.
HOT_WINDOWS = 10_000
#: Bytes of text in a block; smaller than elsewhere, as a block's words are held one by one.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Segments whose words become codes at once.
CODED = 10_000
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
U, U4 = np.uint64, np.uint32
#: The document of windows that do not recur, after all others.
NEVER = np.iinfo(np.int64).max
_RUN, _DEAL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = re.compile(rb"[^ \t-\r]+")


def _dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(40)) % U(shards)).astype(U4)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] of them, for every k in turn."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _ordered(t: pa.Table) -> pa.Table:
    """A block's rows in an order that does not depend on how they arrive: segments are numbered by it more than once."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Block:
    """The documents of a block as one row of words, and its windows."""

    def __init__(self, t: pa.Table, window: int):
        X.give_back()
        self.ids = t["doc_id"].to_pylist()
        self.texts = t["text"].cast(pa.binary()).to_pylist()
        words = [x.split() if x else [] for x in self.texts]
        self.n = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.words = [x for w in words for x in w]
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), U, len(self.words))
        # null ids come after all others and are told apart by nothing: equal texts without an id do not cut each other
        self.doc = np.repeat(np.array([NEVER if i is None else i for i in self.ids], np.int64), self.n)
        self.at = np.repeat(np.arange(len(self.n)), self.n)
        m = max(0, len(self.hash) - window + 1)
        self.valid = self.at[:m] == self.at[window - 1 :]
        self.window = window

    def anchors(self, k: int) -> np.ndarray:
        """The anchor of each window."""
        return X.lowest(X.run_hashes(self.hash, k, _RUN), self.window - k + 1, len(self.valid))


class _Segments:
    """Segments of a block: neighbouring windows with one anchor that is in `shared` (sorted), single ones if it is in `hot`."""

    def __init__(self, b: _Block, anchor: int, shared: np.ndarray, hot: np.ndarray):
        a = b.anchors(anchor)
        near = b.valid & X.among(a, shared)
        alone = X.among(a, hot)
        on = np.zeros(len(near), bool)
        on[1:] = near[1:] & near[:-1] & (a[1:] == a[:-1]) & (b.at[1 : len(near)] == b.at[: max(0, len(near) - 1)]) & ~alone[1:]
        self.first = np.flatnonzero(near & ~on)
        last = np.flatnonzero(near & ~np.append(on[1:], False))
        self.windows = last - self.first + 1
        self.key = np.where(alone[self.first], X.run_hashes(b.hash, b.window, _DEAL)[self.first], X.mix(a[self.first]))
        self.doc = b.doc[self.first]
        line = b" ".join(b.words) + b" "
        place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, b.words), np.int64, len(b.words)) + 1)])
        seen: defaultdict[bytes, int] = defaultdict(count().__next__)
        spans = map(slice, place[self.first].tolist(), place[last + b.window].tolist())
        self.number = np.fromiter(map(seen.__getitem__, map(line.__getitem__, spans)), np.int64, len(self.first))
        #: The words of each distinct segment, each with a space after it.
        self.texts = list(seen)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct segment: key, smallest document, and whether another one has it."""
        low, many = _together(self.number, self.doc, np.zeros(len(self.doc), bool))
        return self.key[np.unique(self.number, return_index=True)[1]], low, many


def _send_anchors(window: int, anchor: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        b = _Block(t, window)
        a, d = b.anchors(anchor)[b.valid], b.doc[: len(b.valid)][b.valid]
        order = np.argsort(a, kind="stable")
        a, d = a[order], d[order]
        at = X.firsts(a)
        many = (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)) if len(at) else np.zeros(0, bool)
        # the smallest document tells blocks that hold rows of one document apart from those that hold two
        low = np.minimum.reduceat(d, at) if len(at) else d
        windows = np.diff(np.append(at, len(a))).astype(U4)
        a = a[at]
        shard = _dealt(a, shards)
        order = np.argsort(shard, kind="stable")
        return X.send([shard[order], np.full(len(a), t["block"][0].as_py(), U4), a[order], low[order], many[order].view(np.uint8), windows[order]], shards)

    return run


def _shared_anchors(hot_windows: int, blocks: int):
    def run(t: pa.Table) -> pa.Table:
        got = [X.unpack(x.as_py()) for x in t["payload"]]
        key = np.concatenate([x[2] for x in got])
        block, low, many, windows = (np.concatenate([x[k] for x in got]) for k in (1, 3, 4, 5))
        order = np.lexsort((low, key))
        key, block, low, many, windows = key[order], block[order], low[order], many[order], windows[order]
        at = X.firsts(key)
        if not len(at):
            return X.HOP_SCHEMA.empty_table()
        size = np.diff(np.append(at, len(key)))
        shared = (np.maximum.reduceat(many, at) > 0) | (low[at] < low[at + size - 1])
        hot = np.repeat(np.add.reduceat(windows.astype(np.int64), at) > hot_windows, size)
        keep = np.repeat(shared, size)
        key, block, hot = key[keep], block[keep], hot[keep]
        order = np.lexsort((key, block))
        return X.send([block[order], key[order], hot[order].view(np.uint8)], blocks)

    return run


def _anchors_of(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's shared anchors, and the hot ones among them."""
    got = [X.unpack(x.as_py()) for x in replies["payload"]]
    keys = np.concatenate([np.zeros(0, U), *[x[1] for x in got]])
    hot = np.concatenate([np.zeros(0, np.uint8), *[x[2] for x in got]]) > 0
    return np.sort(keys), np.sort(keys[hot])


def _send_segments(window: int, anchor: int, shards: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return X.HOP_SCHEMA.empty_table()
        b = _Block(_ordered(docs), window)
        s = _Segments(b, anchor, *_anchors_of(replies))
        key, low, many = s.distinct()
        shard = _dealt(key, shards)
        order = np.argsort(shard, kind="stable")
        texts = [s.texts[k] for k in order.tolist()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        arrays = [shard[order], np.full(len(order), docs["block"][0].as_py(), U4), order.astype(U4), low[order], many[order].view(np.uint8), np.array([len(x) for x in texts], U4), data]
        return X.send(arrays, shards, lengths=5)

    return run


def _letters(codes: np.ndarray) -> str:
    """Word codes as a string, skipping the code points that text can't hold."""
    c = codes.astype(np.uint32) + 1
    return np.where(c >= 0xD800, c + 0x800, c).astype("<u4").tobytes().decode("utf-32-le")


def _recurring(codes: np.ndarray, starts: np.ndarray, low: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """The smallest document of each window that two documents hold, NEVER for the others; windows are told apart by all their codes."""
    first = np.full(len(starts), NEVER, np.int64)
    if not len(starts):
        return first
    h = X.run_hashes(codes.astype(U), window, _DEAL)[starts]
    order = np.lexsort((low, h))

    def changes(order: np.ndarray) -> np.ndarray:
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in range(window):
            c = codes[starts[order] + k]
            new[1:] |= c[1:] != c[:-1]
        return new

    new, apart = changes(order), h[order][1:] != h[order][:-1]
    if (new[1:] & ~apart).any():  # different words with one hash
        order = np.lexsort((low, *[codes[starts + k] for k in range(window)]))
        new = changes(order)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    lows = low[order]
    recurs = (np.maximum.reduceat(many[order], at) > 0) | (lows[at] < lows[at + size - 1])
    first[order] = np.repeat(np.where(recurs, lows[at], NEVER), size)
    return first


def _passages(line: str, starts: np.ndarray, segment: np.ndarray, first: np.ndarray, window: int) -> dict[str, int]:
    """Runs of recurring windows of a segment with one smallest document: their letters, and that document."""
    some = np.flatnonzero(first != NEVER)
    if not len(some):
        return {}
    s, g, f = starts[some], segment[some], first[some]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (g[1:] != g[:-1]) | (f[1:] != f[:-1])]))
    last = np.append(new[1:], len(s)) - 1
    return {line[a:z]: d for a, z, d in zip(s[new].tolist(), (s[last] + window).tolist(), f[new].tolist())}


def _occurrences(line: str, passages: dict[str, int], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows in `line` that a passage covers, with the passage's document, by an automaton over all of them."""
    held = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for p, first in passages.items():
        held.add_word(p, (len(p), first))
    held.make_automaton()
    hits = [(end, n, first) for end, (n, first) in held.iter(line)]
    if hits:
        end, n, first = np.array(hits, np.int64).T
        yield _ranges(end - n + 1, n - window + 1), np.repeat(first, n - window + 1)


def _together(of: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number in `of` the smallest document, and whether there is another."""
    if not len(of):
        return low, many
    order = np.lexsort((low, of))
    at = X.firsts(of[order])
    last = np.append(at[1:], len(order)) - 1
    low, many = low[order], many[order]
    return low[at], (np.maximum.reduceat(many, at) > 0) | (low[at] < low[last])


def _first_anchors(hashes: np.ndarray, codes: np.ndarray, begin: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of the window at each of some places."""
    low = np.full(len(begin), ~U(0))
    for j in range(window - anchor + 1):
        run = np.zeros(len(begin), U)
        for k in range(anchor):
            run = run * U(_RUN) + hashes[codes[begin + (j + k)] - 1]
        low = np.minimum(low, X.mix(run))
    return low


def _locate(window: int, anchor: int, blocks: int):
    """Where passages occur in a shard's segments: per block and segment the smallest document of each window."""

    def run(t: pa.Table) -> pa.Table:
        X.give_back()
        _, block, number, low, many, size, data = X.receive(t)
        place, data = np.concatenate([[0], np.cumsum(size.astype(np.int64))]).tolist(), data.tobytes()
        # many blocks may send one segment
        seen: defaultdict[bytes, int] = defaultdict(count().__next__)
        of = np.fromiter(map(seen.__getitem__, map(data.__getitem__, map(slice, place, place[1:]))), np.int64, len(size))
        del data
        low, many = _together(of, low, many)
        texts = list(seen)
        # code 0 stands between segments
        code: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        words = chain.from_iterable(b"".join(texts[k : k + CODED]).split() for k in range(0, len(texts), CODED))
        codes = np.fromiter(map(code.__getitem__, words), np.int32)
        ends = np.cumsum(np.fromiter((x.count(b" ") for x in texts), np.int64, len(texts)))
        begin = np.concatenate([[0], ends[:-1]])
        del seen, texts
        anchors = _first_anchors(np.fromiter(map(xxhash.xxh64_intdigest, code), U, len(code)), codes, begin, window, anchor)
        order = np.argsort(anchors, kind="stable")
        begin, n = begin[order], (ends - begin)[order]
        cut, passed = [0], 0
        cuts = np.append(np.flatnonzero(anchors[order][1:] != anchors[order][:-1]) + 1, len(order))
        total = np.cumsum(n)
        for c in cuts.tolist():
            if total[c - 1] - passed >= AUTOMATON_WORDS or c == len(order):
                cut.append(c)
                passed = int(total[c - 1])
        found: list[np.ndarray] = []
        for a, z in zip(cut, cut[1:]):
            # the segments of some anchors, each with a 0 after it
            m = n[a:z]
            own = np.zeros(int(m.sum()) + len(m), np.int32)
            place = np.cumsum(m + 1) - (m + 1)
            own[_ranges(place, m)] = codes[_ranges(begin[a:z], m)]
            segment, starts = np.repeat(np.arange(z - a), m - window + 1), _ranges(place, m - window + 1)
            which = order[a:z][segment]
            first = _recurring(own, starts, low[which], many[which], window)
            located = np.full(len(own), NEVER, np.int64)
            line = _letters(own)
            if passages := _passages(line, starts, segment, first, window):
                for at, document in _occurrences(line, passages, window):
                    located[at] = document
            found.append(located[starts])
        first = np.concatenate(found)
        windows = n - window + 1
        begin, some = np.cumsum(windows) - windows, np.zeros(len(order), bool)
        some[order] = np.maximum.reduceat(first != NEVER, begin)
        rank = np.argsort(order)
        back = np.flatnonzero(some[of])
        back = back[np.argsort(block[back], kind="stable")]
        k = rank[of[back]]
        return X.send([block[back], number[back], windows[k].astype(U4), first[_ranges(begin[k], windows[k])]], blocks, lengths=2)

    return run


def _covered(b: _Block, s: _Segments, replies: pa.Table) -> np.ndarray:
    """The words of the block that an occurrence of a passage with an earlier smallest document covers."""
    covered = np.zeros(len(b.hash) + 1, np.int64)
    got = X.receive(replies)
    if got is not None:
        _, number, windows, first = got
        place, reply = np.cumsum(windows.astype(np.int64)) - windows, np.full(len(s.texts), -1, np.int64)
        reply[number] = np.arange(len(number))
        at = np.flatnonzero(reply[s.number] >= 0)
        r = reply[s.number[at]]
        starts, document = _ranges(s.first[at], s.windows[at]), first[_ranges(place[r], s.windows[at])]
        late = starts[document < b.doc[starts]]
        np.add.at(covered, late, 1)
        np.add.at(covered, late + b.window, -1)
    return np.cumsum(covered[:-1]) > 0


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed throughout, as Spark declares results."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without runs of its words and the white space after them (before them, at the end); all else stays as it is."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, z in spans:
        last = z == len(places)
        out.append(text[at : places[a - 1][1] if last and a else places[a][0]])
        at = len(text) if last else places[z][0]
    return b"".join([*out, text[at:]])


def _cut(window: int, anchor: int, layout: bool):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table().append_column("rest", pa.chunked_array([], _nullable(docs.schema.field("rest").type)))
        docs = _ordered(docs)
        b = _Block(docs, window)
        anchors = replies.filter(pa.compute.equal(replies["kind"], 0))
        gone = _covered(b, _Segments(b, anchor, *_anchors_of(anchors)), replies.filter(pa.compute.equal(replies["kind"], 1))) if anchors.num_rows else np.zeros(len(b.hash), bool)
        removed, texts, spans = [], [], []
        for k, text in enumerate(b.texts):
            first, last = int(b.begin[k]), int(b.begin[k + 1])
            g = gone[first:last]
            n = int(np.count_nonzero(g))
            removed.append(n)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).tolist() if n else []
            cut = list(zip(edge[::2], edge[1::2]))
            spans.append([{"start": x, "stop": y} for x, y in cut])
            if layout:
                texts.append(text if not n else _without(text, cut))
            else:
                w = b.words[first:last]
                texts.append(b" ".join([x for x, y in zip(w, g.tolist()) if not y] if n else w))
        texts = [None if x is None else x.decode() for x in texts]
        return pa.table([b.ids, b.n, removed, texts, spans], schema=_OUT).append_column("rest", docs["rest"].cast(_nullable(docs["rest"].type)))

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: Column | None = None, layout: bool = False) -> DataFrame:
    """Cut every word that lies in a `window`-word passage also held by a document with a smaller doc_id.

    Words are runs of characters other than ASCII white space.  Windows are judged on the input.  Returns doc_id,
    n_words, n_removed, kept_text (kept words joined by one space) and spans (cut ranges of word numbers), one row
    per input row.  With `layout`, kept_text is the text as it is but for what is cut and the white space after it, and
    null for a null text.  Null or blank texts have no words; documents with fewer words than a window keep all; rows
    that repeat a doc_id don't cut each other; a null doc_id comes after all others.  Other columns are ignored; what
    `carry` has of each row is returned as `carried`.
    """
    if not 1 <= anchor <= window:
        raise ValueError("anchor must be between 1 and window")
    rest = F.struct((F.lit(0) if carry is None else carry).alias("c0")).alias("rest")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)
    total = X.text_bytes(docs)
    shards, blocks = X.parts_of(total, SHARD_BYTES), X.parts_of(total, BLOCK_BYTES)
    dealt = X.blocked(docs, blocks)
    texts = dealt.groupBy("block")
    anchors = X.routed(texts.applyInArrow(_send_anchors(window, anchor, shards), X.HOP), shards).groupBy("hop").applyInArrow(_shared_anchors(HOT_WINDOWS, blocks), X.HOP)
    shared = X.routed(anchors, blocks).withColumnRenamed("hop", "block")
    segments = X.routed(texts.cogroup(shared.groupBy("block")).applyInArrow(_send_segments(window, anchor, shards), X.HOP), shards, 5)
    located = X.routed(segments.groupBy("hop").applyInArrow(_locate(window, anchor, blocks), X.HOP), blocks, 2).withColumnRenamed("hop", "block")
    replies = shared.select("block", F.lit(0).alias("kind"), "payload").unionAll(located.select("block", F.lit(1), "payload"))
    kind = dealt.schema["rest"].dataType.simpleString()
    out = texts.cogroup(replies.groupBy("block")).applyInArrow(_cut(window, anchor, layout), f"{OUT}, rest {kind}")
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "spans", *([F.col("rest.c0").alias("carried")] if carry is not None else []))
