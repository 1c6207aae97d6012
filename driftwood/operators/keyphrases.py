"""Keyphrases by YAKE (Campos et al., 2020): statistics of one text alone, so that texts are shuffled once and nothing else.

A word scores low, which is good, if it is often capitalised, comes early, is frequent, stands among few different
neighbours and in many sentences.  A phrase of up to three words scores by the product of its words' scores; of phrases
that read alike the best stays.  Spark cuts texts into sentences and words and deals documents out; a task counts words,
neighbours and phrases of some documents at once, as numbers in sorted arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.columns import sentences
from driftwood.operators.store import STOPWORDS

#: A word; a word or a mark that parts phrases.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*"
PIECE = WORD + r"|[^\s\p{L}\p{N}]"
#: Words of a phrase, and how alike two phrases may read.
LONGEST, ALIKE = 3, 0.7
#: Pieces that are counted at once; a document of more is counted alone.
AT_ONCE = 1 << 19
#: Pairs of phrases compared at once, and numbers of a table of their edits.
PAIRS, CELLS = 1 << 18, 1 << 21
#: Digits that scores are rounded to before they are ranked.
DIGITS = 9
_KEY, _STOP = "_doc", frozenset(STOPWORDS)


def _said(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_doc and the words of its sentences, "" for a mark; the rows of a document follow each other."""
    rows = docs.select(F.col(f"`{key}`").alias(_KEY), F.col(f"`{text}`").alias("_text")).where(F.col(_KEY).isNotNull() & F.col("_text").isNotNull())
    words = F.transform(sentences(F.col("_text")), lambda s: F.regexp_extract_all(s, F.lit(PIECE.replace(WORD, f"({WORD})")), F.lit(1)))
    return rows.repartition(_KEY).sortWithinPartitions(_KEY).select(_KEY, words.alias("said"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Texts]]:
    """Keys of some documents and their texts; no document is cut."""
    held: list[pa.RecordBatch] = []
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if batch is not None:
            # rows of the last document may go on in the next batch
            last, n = batch[0][-1].as_py(), batch.num_rows - 1
            while n and batch[0][n - 1].as_py() == last:
                n -= 1
            if not n and (not held or held[-1][0][-1].as_py() == last):
                held.append(batch)
                continue
            whole, held = [*held, batch.slice(0, n)], [batch.slice(n)]
        else:
            whole = held
        if not whole:
            continue
        table = pa.Table.from_batches(whole).combine_chunks()
        keys, said = table[0].to_pylist(), table[1].combine_chunks()
        firsts = np.flatnonzero([True, *(a != b for a, b in zip(keys, keys[1:]))])
        n_sentences, n_pieces = pc.list_value_length(said).to_numpy(), pc.list_value_length(said.flatten()).to_numpy()
        upto = np.append(0, np.cumsum(n_pieces))[np.append(0, np.cumsum(n_sentences))[np.append(firsts, len(keys))]]
        at = 0
        while at < len(firsts):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_ONCE, "right")) - 1)
            low, high = firsts[at], firsts[end] if end < len(firsts) else len(keys)
            yield table[0].combine_chunks().take(pa.array(firsts[at:end])), Texts(said.slice(low, high - low), firsts[at:end] - low)
            at = end


def _counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different numbers, where each is first, which of them each is, and how often it occurs."""
    return np.unique(a, return_index=True, return_inverse=True, return_counts=True)


class Texts:
    """The words of some documents and their scores: a `kind` is a word of one document."""

    def __init__(self, said: pa.ListArray, firsts: np.ndarray):
        """`said`: rows of sentences of words; `firsts`: the first row of each document."""
        n_sentences = pc.list_value_length(said).to_numpy()
        n_pieces = pc.list_value_length(said.flatten()).to_numpy()
        doc_of_row = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(said))))
        doc_of_sentence = np.repeat(doc_of_row, n_sentences)
        place = np.arange(len(n_pieces)) - np.repeat(np.cumsum(n_sentences) - n_sentences, n_sentences)
        starts = np.zeros(n_pieces.sum() + 1, bool)
        starts[(np.cumsum(n_pieces) - n_pieces)] = True
        self.docs = len(firsts)
        self._number(said.flatten().flatten(), starts[:-1])
        self.doc, self.sentence = np.repeat(doc_of_sentence, n_pieces)[self.at], np.repeat(place, n_pieces)[self.at]
        #: Of each word, whether the piece after it is a word of the same sentence.
        self.goes_on = np.append((np.diff(self.at) == 1) & ~starts[self.at[1:]], False) if len(self.at) else np.zeros(0, bool)
        self._score(np.bincount(doc_of_sentence, minlength=self.docs))

    def _number(self, pieces: pa.Array, starts: np.ndarray) -> None:
        """Words are numbered in the order of their lower case."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        low = [w.lower() for w in words]
        self.names = sorted({*low} - {""})
        number = dict(zip(self.names, range(len(self.names))))
        whole, capital = np.zeros((2, len(words)), bool)
        for k, (w, t) in enumerate(zip(words, low)):
            if w != t:
                whole[k] = len(w) > 1 and w.upper() == w
                capital[k] = w[0].upper() == w[0] != w[0].lower()
        codes = coded.indices.to_numpy()
        #: Which pieces are words.
        self.at = np.flatnonzero(np.array([w != "" for w in words], bool)[codes])
        codes = codes[self.at]
        self.term = np.array([number.get(t, -1) for t in low], np.int64)[codes]
        self.whole, self.capital = whole[codes], capital[codes] & ~starts[self.at]
        self.stop = np.array([len(t) < 3 or t in _STOP for t in self.names], bool)
        self.figure = np.array([not t[0].isalpha() and all(c in "-'’" or unicodedata.category(c)[0] == "N" for c in t) for t in self.names], bool)

    def _score(self, n_sentences: np.ndarray) -> None:
        kinds, first, self.kind, self.tf = _counted(self.doc * max(1, len(self.names)) + self.term)
        n = len(kinds)
        self.kind_doc, self.kind_term = self.doc[first], self.term[first]
        total = lambda flags: np.bincount(self.kind[flags], minlength=n)
        # the sentences of a word, in order, and the one in the middle
        width = int(self.sentence.max(initial=0)) + 1
        stands = np.unique(self.kind * width + self.sentence)
        sf = np.bincount(stands // width, minlength=n)
        begin = np.cumsum(sf) - sf
        middle = (stands[begin + (sf - 1) // 2] % width + stands[begin + sf // 2] % width) / 2
        # how many different words stand on a side, of all that do
        on = np.flatnonzero(self.goes_on)
        pairs, _, self.pair, self.pair_n = _counted(self.kind[on] * n + self.kind[on + 1])
        spread = np.zeros(n)
        for side in (pairs // max(1, n), pairs % max(1, n)):
            many, different = np.bincount(side, self.pair_n, n), np.bincount(side, minlength=n)
            spread += np.divide(different, many, out=np.zeros(n), where=many > 0)
        sound = ~self.stop[self.kind_term]
        of = self.kind_doc[sound]
        m, one, two = (np.bincount(of, w, self.docs) for w in (None, self.tf[sound], self.tf[sound].astype(np.float64) ** 2))
        mean = np.divide(one, m, out=np.zeros(self.docs), where=m > 0)
        norm = mean + np.sqrt(np.divide(np.maximum(m * two - one * one, 0), m * m, out=np.zeros(self.docs), where=m > 0))
        most = np.zeros(self.docs, np.int64)
        np.maximum.at(most, self.kind_doc, self.tf)
        case = np.maximum(total(self.whole), total(self.capital)) / (1 + np.log(self.tf))
        frequency = np.divide(self.tf, norm[self.kind_doc], out=np.zeros(n), where=norm[self.kind_doc] > 0)
        related = 1 + spread * self.tf / most[self.kind_doc]
        self.score = related * np.log(np.log(3 + middle)) / (case + frequency / related + sf / n_sentences[self.kind_doc] / related)

    def phrases(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each different phrase of a document its kinds (-1 for none), and its score."""
        n = len(self.score)
        fit, stop = ~self.figure[self.term], self.stop[self.term]
        pair = np.full(len(self.term), -1)
        pair[np.flatnonzero(self.goes_on)] = self.pair
        # runs of words that may be part of a phrase: where each begins, and its number
        at, run = np.flatnonzero(fit), self.kind[fit]
        kinds, scores = [np.zeros((0, longest), np.int64)], [np.zeros(0)]
        for size in range(1, longest + 1):
            if size > 1:
                more = np.flatnonzero(self.goes_on[at + size - 2])
                more = more[fit[at[more] + size - 1]]
                at, run = at[more], run[more] * n + self.kind[at[more] + size - 1]
            if size == longest:
                ends = ~stop[at] & ~stop[at + size - 1]
                at, run = at[ends], run[ends]
            _, first, run, kf = _counted(run)
            ends = ~stop[at[first]] & ~stop[at[first] + size - 1]
            begin, kf = at[first][ends], kf[ends]
            members = self.kind[begin[:, None] + np.arange(size)]
            product, total = np.ones(len(begin)), np.ones(len(begin))
            for i in range(size):
                times = plus = self.score[members[:, i]]
                if 0 < i < size - 1:
                    # a stop word within a phrase counts by how surely its neighbours go with it
                    before, after = (self.pair_n[pair[begin + k]] for k in (i - 1, i))
                    unsure = 1 - before / self.tf[members[:, i - 1]] * after / self.tf[members[:, i]]
                    inner = stop[begin + i]
                    times, plus = np.where(inner, 1 + unsure, times), np.where(inner, -unsure, plus)
                product, total = product * times, total + plus
            kinds.append(np.pad(members, ((0, 0), (0, longest - size)), constant_values=-1))
            scores.append(np.round(product / (kf * total), DIGITS))
        return np.concatenate(kinds), np.concatenate(scores)

    def spelt(self, phrases: np.ndarray) -> list[str]:
        names = self.names
        terms = self.kind_term[phrases] if len(self.kind_term) else phrases
        return [" ".join([names[t] for t in row[:n]]) for row, n in zip(terms.tolist(), (phrases >= 0).sum(axis=1).tolist())]

    def letters(self) -> np.ndarray:
        """Of each word, how often it has each of 32 sorts of letters."""
        codes = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32)
        own = np.repeat(np.arange(len(self.names)), [len(t) for t in self.names])
        return np.bincount(own * 32 + codes % 32, minlength=len(self.names) * 32).reshape(-1, 32).astype(np.int32)


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edits from each text to the other of its pair."""
    out = np.zeros(len(a), np.int64)
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    longer = np.maximum(la, lb)
    order, at = np.argsort(longer, kind="stable"), 0
    while at < len(order):
        # pairs of about the same length make a table together
        width = max(8, int(longer[order[at]]) * 5 // 4)
        end = min(int(np.searchsorted(longer[order], width, "right")), at + max(1, CELLS // width))
        part, width = order[at:end], int(longer[order[end - 1]])
        x, y = (np.array([s[k] for k in part], f"U{max(1, width)}").view(np.uint32).reshape(len(part), -1).T.copy() for s in (a, b))
        dtype = np.int16 if width < 1 << 13 else np.int32
        steps = np.arange(width + 1, dtype=dtype)[:, None]
        row = np.repeat(steps, len(part), axis=1)
        m, n = la[part], lb[part]
        ends = {k: np.flatnonzero(m == k) for k in np.unique(m).tolist()}
        for i in range(width + 1):
            if i:
                new = np.empty_like(row)
                new[0] = i
                np.minimum(row[:-1] + (y != x[i - 1]), row[1:] + 1, out=new[1:], casting="unsafe")
                row = np.minimum.accumulate(new - steps, axis=0) + steps
            if i in ends:
                out[part[ends[i]]] = row[n[ends[i]], ends[i]]
        at = end
    return out


def _alike(texts: Texts, phrases: np.ndarray, letters: np.ndarray, items: np.ndarray, alike: float) -> np.ndarray:
    """Per row of `items` (numbers of phrases, -1 for none) whether the phrases at two places read alike."""
    n, m = items.shape
    out = np.zeros((n, m, m), bool)
    used, which = np.unique(items, return_inverse=True)
    which = which.reshape(n, m)
    members = phrases[used]
    sorts = np.zeros((len(used), 32), np.int32)
    for i in range(members.shape[1]):
        there = members[:, i] >= 0
        sorts[there] += letters[texts.kind_term[members[there, i]]]
    sorts[:, 0] += (members[:, 1:] >= 0).sum(axis=1)
    size = sorts.sum(axis=1)
    far, near = np.tril_indices(m, -1)
    for begin in range(0, n, step := max(1, PAIRS // max(1, len(far)))):
        rows = slice(begin, begin + step)
        a, b = which[rows][:, far].ravel(), which[rows][:, near].ravel()
        longer = np.maximum(size[a], size[b])
        # edits are no fewer than letters that one has and the other has not
        left = np.flatnonzero((1 - np.abs(size[a] - size[b]) / np.maximum(longer, 1) > alike) & ((items[rows][:, far] >= 0) & (items[rows][:, near] >= 0)).ravel())
        over = sorts[a[left]] - sorts[b[left]]
        least = np.maximum(np.maximum(over, 0).sum(axis=1), np.maximum(-over, 0).sum(axis=1))
        left = left[1 - least / longer[left] > alike]
        if len(left):
            near_ones, pairs = np.unique(np.stack([a[left], b[left]]), return_inverse=True)
            said = texts.spelt(members[near_ones])
            apart = edits(*([said[k] for k in side] for side in pairs.reshape(2, -1).tolist()))
            left = left[1 - apart / longer[left] > alike]
            out[begin + left // len(far), far[left % len(far)], near[left % len(far)]] = True
    return out


def _best(texts: Texts, phrases: np.ndarray, scores: np.ndarray, top: int, alike: float) -> list[np.ndarray]:
    """Of each document the numbers of its best phrases that do not read like a better one."""
    doc = texts.kind_doc[phrases[:, 0]] if len(phrases) else np.zeros(0, np.int64)
    order = np.argsort(scores, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16) if texts.docs < 1 << 16 else doc[order], kind="stable")]
    ends = np.cumsum(np.bincount(doc, minlength=texts.docs))
    next_ = np.append(0, ends[:-1])
    # where phrases of one document and score end
    last = np.append(np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(scores[order]) != 0)), len(order) - 1) + 1
    held, letters, step = np.full((texts.docs, top), -1), texts.letters(), 2 * top
    while len(active := np.flatnonzero((next_ < ends) & (held[:, -1] < 0))):
        upto = np.minimum(next_[active] + step, ends[active])
        # those of one score are put in the order of their words
        tied = last[np.searchsorted(last, upto)]
        n = tied - next_[active]
        idx = np.repeat(next_[active] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        few = order[idx]
        order[idx] = few[np.lexsort((*phrases[few].T[::-1], scores[few], doc[few]))]
        places = next_[active][:, None] + np.arange(step)
        more = np.where(places < upto[:, None], order[np.minimum(places, len(order) - 1)], -1)
        items = np.concatenate([held[active], more], axis=1)
        same, kept = _alike(texts, phrases, letters, items, alike), np.zeros(items.shape, bool)
        for c in range(items.shape[1]):
            kept[:, c] = (items[:, c] >= 0) & (kept.sum(axis=1) < top) & ~(same[:, c] & kept).any(axis=1)
        count = kept.sum(axis=1)
        held[active] = -1
        row, col = np.nonzero(kept)
        held[active[row], np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = items[row, col]
        next_[active] = upto
        step = min(2 * step, 32 * top)
    return [h[h >= 0] for h in held]


def keyphrases(docs: DataFrame, key: str = "doc_id", text: str = "text", top: int = 20, longest: int = LONGEST, alike: float = ALIKE) -> DataFrame:
    """(key, rank, keyphrase, score): each document's best phrases, rank from 1; lower scores are better, ties by phrase.

    A phrase goes if a better one that stays reads alike: 1 - edits / length of the longer, more than `alike`.  Rows that
    repeat a key are one document; rows without a key, and null, empty or wordless texts, have no phrases.  Scores are
    rounded to 9 digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            phrases, scores = texts.phrases(longest)
            best = _best(texts, phrases, scores, top, alike)
            n = [len(b) for b in best]
            kept = np.concatenate(best)
            ranks = np.concatenate([np.arange(1, k + 1) for k in n])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ranks, pa.int32()), pa.array(texts.spelt(phrases[kept]), pa.string()), pa.array(scores[kept])], names=[key, "rank", "keyphrase", "score"])

    return _said(docs, key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, rank int, keyphrase string, score double")


def term_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, score) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            names = pa.array(texts.names, pa.string()).take(pa.array(texts.kind_term))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(texts.kind_doc)), names, pa.array(texts.tf), pa.array(texts.score)], names=[key, "term", "tf", "score"])

    return _said(docs, key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, tf long, score double")
