"""Token counts: rank-synchronous array merging.

Distinct pre-tokens are held as one ragged numpy array of symbols.  In each round every sequence merges all places of
its lowest-rank pair at once; sequences that have no pair left are counted and leave.  What a text counts is the sum
over its pre-tokens, and counts of pieces of text seen before are remembered.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.encode import public_path, slices

LIMIT = 2048
#: Pieces and pre-tokens whose counts are remembered, and the longest of them.
HELD, LONGEST = 400_000, 100
#: Symbols merged at once (more for a longer single pre-token).
SYMBOLS = 1 << 20
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level BPE files: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Merger:
    """Counts the tokens of byte sequences under a list of ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each nonempty sequence of bytes."""
        size = np.array([len(t) for t in tokens], np.int64)
        out = np.ones(len(tokens), np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        of = np.repeat(np.arange(len(tokens)), size)
        symbol = self.inner[raw]
        stop = np.cumsum(size) - 1
        symbol[stop] = self.last[raw[stop]]
        rank = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(of[1:] == of[:-1])
        rank[inside] = self._ranks(symbol[inside], symbol[inside + 1])
        while len(symbol):
            start = np.flatnonzero(np.diff(of, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            n = np.diff(np.append(start, len(of)))
            done = low == NONE
            out[of[start[done]]] = n[done]
            low = np.repeat(low, n)
            keep = low != NONE
            merge = (rank == low) & keep
            # overlapping places (aaa) merge from the left: every other place of a run
            at = np.flatnonzero(merge)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
            at = at[~odd]
            symbol[at] = self.made[rank[at]]
            keep[at + 1] = False
            fresh = np.zeros(len(symbol), bool)
            fresh[at] = True
            symbol, of, rank, fresh = symbol[keep], of[keep], rank[keep], fresh[keep]
            # pairs that begin or end with a new symbol get new ranks
            look = np.flatnonzero(fresh)
            look = np.unique(np.concatenate([look, look[look > 0] - 1]))
            rank[look] = NONE
            look = look[look + 1 < len(symbol)]
            look = look[of[look] == of[look + 1]]
            rank[look] = self._ranks(symbol[look], symbol[look + 1])
        return out


class Counter:
    """Token counts of texts for a tokenizer file of BPE whose pre-tokens end in a suffix and never hold white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or pre[0]["type"] != "Split" or pre[1]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE with an end-of-word suffix can be counted")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.nfc, self.lowers = "NFC" in kinds, "Lowercase" in kinds
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.find = regex.compile(pre[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.pieces: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def _pretokens(self, piece: str) -> tuple[int, list[str]]:
        """Special tokens of a piece, and the pre-tokens of the rest."""
        parts, n = [piece], 0
        if self.special and "<" in piece:
            parts = self.special.split(piece)
            n = len(parts) - 1
        out: list[str] = []
        for p in parts:
            if self.nfc:
                p = unicodedata.normalize("NFC", p)
            if self.lowers:  # letter by letter: a last sigma is a sigma like others
                p = p.lower() if p.isascii() or "Σ" not in p else "".join(map(str.lower, p))
            out += self.find(p)
        return n, out

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        cut = {p: self._pretokens(p) for p in pieces}
        lack = list({t for _, ts in cut.values() for t in ts if t not in self.tokens})
        new: dict[str, int] = {}
        data = [t.encode() for t in lack]
        for a, z in slices(data, SYMBOLS):
            new.update(zip(lack[a:z], self.merger.count(data[a:z]).tolist()))
        if len(self.tokens) + len(new) > HELD:
            known = {t: self.tokens[t] for _, ts in cut.values() for t in ts if t in self.tokens}
            self.tokens.clear()
            self.tokens.update(known)
        out = {p: n + sum(new[t] if t in new else self.tokens[t] for t in ts) for p, (n, ts) in cut.items()}
        self.tokens.update((t, c) for t, c in new.items() if len(t) <= LONGEST)
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = [t.translate(_AS_SPACE).split(" ") if t.isascii() else [p.decode() for p in t.encode().split()] for t in texts]
        got = [list(map(self.pieces.get, p)) for p in cut]
        new = self._learn(list({q for p, g in zip(cut, got) if None in g for q, v in zip(p, g) if v is None}))
        out = [sum(g) if None not in g else sum(new[q] if v is None else v for q, v in zip(p, g)) for p, g in zip(cut, got)]
        if len(self.pieces) + len(new) > HELD:
            self.pieces.clear()
        self.pieces.update((p, c) for p, c in new.items() if len(p) <= LONGEST)
        return out


_AS_SPACE = {ord(c): " " for c in "\t\n\v\f\r"}
_HELD: dict[str, Counter] = {}


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD[path] = Counter(path)
        counter = _HELD[path]
        for batch in batches:
            texts = batch["text"].to_pylist()
            out: list[int] = []
            for a, z in slices(texts):
                out += counter.count([t or "" for t in texts[a:z]])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than `limit` tokens), one row per input row.

    Counts are those of the library without added tokens; special tokens written out in a text count as one.  Null
    texts are empty.  No shuffle: any key may repeat, and other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = docs.mapInArrow(_run(tokenizer or public_path("word_bpe_49k.json")), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
