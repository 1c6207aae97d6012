"""Token ids by the tokenizers library, each distinct piece of text encoded once."""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata

import numpy as np

#: Pieces whose ids a worker remembers (some 250 bytes each), and the longest of them.
PIECES, LONGEST = 600_000, 100
#: Pieces encoded as one text.
AT_ONCE = 1000
#: In place of ids, which take four bytes each.
_LACKS = b"?"
#: Marks that are cut off a word before it is looked up.
_ENDS = ".,;:!?"
_ODD = re.compile(r" (?:\s|\Z)")
_NEXT = re.compile(r"(?= \S)")
#: A character that the tokenizer makes one token of, put between pieces.
_MARK = "\x01"


class _Seen(dict):
    """Ids of pieces; looking up one that isn't there gives `_LACKS`, no ids, and adds it to `lack`."""

    def __missing__(self, piece: str) -> bytes:
        self.lack.append(piece)
        return _LACKS


class Encoder:
    """Encodes texts just as the library does with add_special_tokens=False.

    A text is cut at places that the tokenizer never crosses, and a piece seen before is not encoded again.  Where to
    cut is read from the tokenizer's file: byte-level BPE that puts a space at the front of a word is cut before single
    spaces; BPE that drops white space is cut at ASCII white space; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        steps = pre.get("pretokenizers", [pre])
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec["added_tokens"])
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
            lead = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
            lead[[i for t, i in self.tok.get_vocab().items() if t.startswith("Ġ")]] = True
            self.lead = lead
        elif plain and model.get("end_of_word_suffix") and steps[0].get("behavior") == "Removed" and len(one := self.tok.encode(_MARK, add_special_tokens=False).ids) == 1:
            self.kind, self.mark = "dropped", one[0]
            self.lowers = any(n.get("type") == "Lowercase" for n in (norm or {}).get("normalizers", [norm or {}]))
        else:
            self.kind = "whole"
        self.seen = _Seen()
        self.ends = dict(zip(_ENDS, self._alone(list(_ENDS))))

    @staticmethod
    def _ids(ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [self._ids(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces; one mark after a letter or digit is always a token of its own."""
        # but not after a letter that a normalizer makes a letter and a mark of
        ends = {p: (p[:-1], p[-1]) for p in pieces if p[-1:] in _ENDS and p[-2:-1].isalnum() and (p[-2].isascii() or unicodedata.normalize("NFC", p[-2].lower()).isalnum())}
        bodies = {b for b, _ in ends.values()}
        new = self._encoded([*{p for p in pieces if p not in ends} | {b for b in bodies if b not in self.seen}])
        for p, (b, end) in ends.items():
            new[p] = (new[b] if b in new else self.seen[b]) + self.ends[end]
        return new

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, many of them encoded as one text."""
        new: dict[str, bytes] = {}
        for k in range(0, len(pieces), AT_ONCE):
            part = pieces[k : k + AT_ONCE]
            if self.kind == "spaced":
                a = np.array(self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                start = np.flatnonzero(self.lead[a])
                stop = np.append(start[1:], len(a))
            else:
                a = np.array(self.tok.encode_batch_fast([f" {_MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                stop = np.append(np.flatnonzero(a == self.mark), len(a))
                start = np.append(0, stop[:-1] + 1)
            if len(start) != len(part):  # a piece holds the mark or looks like two
                new.update(zip(part, self._alone([" " * (self.kind == "spaced") + p for p in part])))
                continue
            data = a.tobytes()
            new.update(zip(part, map(data.__getitem__, map(slice, (start * 4).tolist(), (stop * 4).tolist()))))
        return new

    def _pieces(self, text: str) -> tuple[bytes, list[str]]:
        """Ids of what comes first, and the pieces after it."""
        if self.kind == "dropped":
            if text.isascii():
                return b"", (text.lower() if self.lowers and "<" not in text else text).translate(_AS_SPACE).split(" ")
            data = text.encode()
            if self.lowers and "<" not in text and unicodedata.is_normalized("NFC", text):
                low = data.lower().decode()  # A-Z alone
                if unicodedata.is_normalized("NFC", low):
                    data = low.encode()
            return b"", [p.decode() for p in data.split()]
        if _ODD.search(text):
            return b"".join(self._alone(_NEXT.split(text))), []
        head, *rest = text.split(" ")
        return (self._alone([head])[0] if head else b""), rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.kind == "whole":
            return self._alone(texts)
        was = gc.isenabled()
        gc.disable()
        try:
            cut = [self._pieces(t) for t in texts]
            got = []
            for _, p in cut:
                self.seen.lack = lack = []
                got.append((list(map(self.seen.__getitem__, p)), lack))
            new = self._learn(list({q for _, lack in got for q in lack}))
            out = []
            for (head, _), (g, lack) in zip(cut, got):
                k = -1
                for q in lack:
                    k = g.index(_LACKS, k + 1)
                    g[k] = new[q]
                out.append(head + b"".join(g))
            # common pieces come early: those seen first stay
            if len(self.seen) < PIECES:
                self.seen.update((q, v) for q, v in new.items() if len(q) <= LONGEST)
            return out
        finally:
            if was:
                gc.enable()


_AS_SPACE = {ord(c): " " for c in "\t\n\v\f\r"}
_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list, size: int = 2 << 20):
    """Neighbouring texts of about `size` characters together, as (begin, stop)."""
    k = 0
    while k < len(texts):
        a, n = k, 0
        while k < len(texts) and n < size:
            n += len(texts[k] or "")
            k += 1
        yield a, k
