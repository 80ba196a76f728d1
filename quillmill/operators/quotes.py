"""Where quotes stand in texts: exactly, but for case or white space, or as the closest window of the text.

`anchor` is one quote in one text, in tiers: exact, case_insensitive, whitespace, whitespace_case_insensitive,
fuzzy (the best window by partial ratio, of a threshold or more, over letters and digits alone). `anchor_quotes` is all
quotes in all texts: quotes are sent to tasks in blocks of a bounded size and texts never move. In a task an
automaton over the quotes, folded in case and white space, finds the candidates of the first four tiers. The
fifth's come from an index of the quotes' rarer q-grams: a window with few edits keeps so many of a quote's q-grams
(a letter less breaks q at most, one more q - 1) that a text, and then a band of its diagonals, with fewer can't hold the quote. What is
left is aligned by bit-parallel longest common subsequence; windows that can't reach the best so far are jumped over.

A window is as long as the quote, or shorter at a text's edges; score = 100 * 2 * lcs / (both lengths). Of equal
scores the first in the order of windows wins: those at the start by length, then by start. A quote longer than
the text has only the whole text as its window. Offsets are code points, half open.

Null and empty texts and quotes have no place; repeated rows give a row each; folding keeps lengths, so a letter
whose lower case is longer stays as it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from quillmill.operators.terms import Automaton, blocks

#: Least length of a quote's letters, digits and inner gaps for the fuzzy tier.
LEAST_FUZZY = 12
SCORES = {"exact": 100.0, "case_insensitive": 98.0, "whitespace": 95.0, "whitespace_case_insensitive": 93.0}


def _plain(c: str) -> str:
    return (low if len(low := c.lower()) == 1 else c) if c.isalnum() else " "


class _Plain(dict):
    def __missing__(self, code: int) -> str:
        self[code] = _plain(chr(code))
        return self[code]


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Letters and digits in lower case, all else a space; of the same length."""
    return text.translate(_PLAIN)


def fold(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def losses(length: int, threshold: float, q: int) -> tuple[int, int]:
    """(most q-grams of a quote that a window of the threshold or more lacks, most that its diagonals are apart).

    Of d letters of the quote that the window lacks each breaks q of its q-grams, of i letters that it has besides each
    breaks q - 1, and neither more than d nor more than i steps lead from one diagonal to another.
    """
    lost = apart = 0
    for n in range(1, length + 1):
        k = math.ceil(threshold * (length + n) / 200 - 1e-9)
        if k <= n:
            lost, apart = max(lost, q * (length - k) + (q - 1) * (n - k)), max(apart, length - k, n - k)
    return lost, apart


@lru_cache(10_000)
def gram_size(length: int, threshold: float) -> tuple[int, int, int]:
    """(q, so many of the quote's q-grams every such window has, within so many diagonals), q as large as the lemma allows."""
    for q in (4, 3, 2, 1):
        lost, apart = losses(length, threshold, q)
        if length >= q and (n := length - q + 1 - lost) > 0:
            return q, n, apart
    raise ValueError("the threshold leaves no common character")


@lru_cache(2)
def _points(text: str) -> np.ndarray:
    """The code points; kept while quotes are held against the same text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def numbered(letters: np.ndarray, q: int, base: int) -> np.ndarray:
    """A number for each q-gram of numbered letters, modulo 2**64."""
    n = max(0, len(letters) - q + 1)
    out = letters[:n]
    for k in range(1, q):
        out = out * np.uint64(base) + letters[k : k + n]
    return out


class Quote:
    """A normalised quote with its bit masks and q-grams."""

    def __init__(self, text: str, threshold: float):
        self.text, self.threshold = text, threshold
        self.q, self.least, self.apart = gram_size(len(text), threshold)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full = (1 << len(text)) - 1
        points = _points(text)
        letters = np.unique(points)
        self.letter = np.zeros(int(letters[-1]) + 2, np.uint64)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        grams = self._grams(points)
        self.places = np.argsort(grams, kind="stable")
        self.grams, self.first, self.count = np.unique(grams[self.places], return_index=True, return_counts=True)

    def _grams(self, points: np.ndarray) -> np.ndarray:
        """A number for each q-gram; letters that the quote lacks are one. In huge alphabets some share one, which adds starts and loses none."""
        return numbered(self.letter[np.minimum(points, len(self.letter) - 1)], self.q, int(self.letter.max()) + 1)

    def lcs(self, window: str) -> int:
        s, masks, full = self.full, self.masks, self.full
        for c in window:
            u = s & masks.get(c, 0)
            s = ((s + u) | (s - u)) & full
        return len(self.text) - s.bit_count()

    def needed(self, length: int) -> int:
        """Least common subsequence with a window of this length that reaches the threshold."""
        return math.ceil(self.threshold * (len(self.text) + length) / 200 - 1e-9)

    def starts(self, text: str) -> list[tuple[int, int]]:
        """Stretches of places where a good window may start, by the diagonals that have enough q-grams in common."""
        own = self._grams(_points(text))
        k = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = np.flatnonzero(self.grams[k] == own)
        n = self.count[k[there]]
        if n.sum() < self.least:
            return []
        hit = np.repeat(self.first[k[there]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        d = np.sort(np.repeat(there, n) - self.places[hit])
        firm = d[: len(d) - self.least + 1][d[self.least - 1 :] - d[: len(d) - self.least + 1] <= self.apart]
        out: list[tuple[int, int]] = []
        for x in np.unique(firm).tolist():
            low, high = max(0, x - self.apart), min(len(text) - 1, x + self.apart)
            if low > high:
                continue
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
        return out

    def best(self, text: str) -> tuple[float, int, int] | None:
        """(score, start, end) of the best window of `text`, if it reaches the threshold."""
        m, n = len(self.text), len(text)
        if n <= m:
            k = self.lcs(text) if n and n >= self.needed(n) else 0
            return (200 * k / (m + n), 0, n) if n and k >= self.needed(n) else None
        best: tuple[float, int, int] | None = None
        for low, high in self.starts(text):
            shortest = math.ceil(m * self.threshold / (200 - self.threshold) - 1e-9)
            if self.lcs(text[low : high + m]) < self.needed(shortest):
                continue
            if low == 0:
                for size in range(shortest, m):
                    k = self.lcs(text[:size])
                    if k >= self.needed(size) and (best is None or 200 * k / (m + size) > best[0]):
                        best = (200 * k / (m + size), 0, size)
            s = low
            while s <= min(high, n - m):
                least = max(self.needed(m), math.floor(best[0] * m / 100 + 1e-9) + 1 if best else 0)
                k = self.lcs(text[s : s + m])
                if k >= least:
                    best = (100 * k / m, s, s + m)
                # From one window to the next the subsequence grows by one at most.
                s += max(1, least - k)
            for s in range(max(low, n - m + 1), min(high, n - shortest) + 1):
                k = self.lcs(text[s:])
                if k >= self.needed(n - s) and (best is None or 200 * k / (m + n - s) > best[0]):
                    best = (200 * k / (m + n - s), s, n)
        return best


@lru_cache(100_000)
def _flexible(quote: str) -> re.Pattern:
    return re.compile(r"\s+".join(re.escape(t) for t in quote.split()))


@lru_cache(100_000)
def _fuzzy(quote: str, threshold: float | None) -> Quote | None:
    q = plain(quote)
    return Quote(q, threshold) if threshold is not None and len(q.strip()) >= LEAST_FUZZY else None


def _search(region: str, quote: str, threshold: float | None) -> tuple[str, float, int, int] | None:
    if (at := region.find(quote)) >= 0:
        return "exact", 100.0, at, at + len(quote)
    low, low_quote = fold(region), fold(quote)
    if (at := low.find(low_quote)) >= 0:
        return "case_insensitive", 98.0, at, at + len(quote)
    if m := _flexible(quote).search(region):
        return "whitespace", 95.0, m.start(), m.end()
    if m := _flexible(low_quote).search(low):
        return "whitespace_case_insensitive", 93.0, m.start(), m.end()
    fuzzy = _fuzzy(quote, threshold)
    hit = fuzzy.best(plain(region)) if fuzzy else None
    return ("fuzzy", *hit) if hit else None


def anchor(text: str | None, quote: str | None, prefix: str | None = None, suffix: str | None = None, threshold: float | None = 90.0, window: int = 2500) -> tuple[str, float, int, int] | None:
    """(method, score, start, end) of a quote; words before and after it bound the part that is searched first."""
    quote = (quote or "").strip()
    if not text or not quote:
        return None
    low, start, end = fold(text), 0, len(text)
    if (p := fold((prefix or "").strip())) and (at := low.find(p)) >= 0:
        start = max(0, at - window)
    if (p := fold((suffix or "").strip())) and (at := low.find(p, start)) >= 0:
        end = min(len(text), at + len(p) + window)
    if (start, end) != (0, len(text)) and (hit := _search(text[start:end], quote, threshold)):
        return hit[0], hit[1], hit[2] + start, hit[3] + start
    return _search(text, quote, threshold)


class _Block:
    """The quotes of a block, ready to meet texts."""

    def __init__(self, rows: list, threshold: float | None):
        self.rows = [(key, (quote or "").strip(), *hints) for key, quote, *hints in rows]
        self.machine = Automaton({squeeze(fold(q)) for _, q, *_ in self.rows})
        self.folded: dict[str, list[int]] = {}
        by_size: dict[int, list[int]] = {}
        found: dict[int, Quote] = {}
        for i, (_, quote, *_) in enumerate(self.rows):
            self.folded.setdefault(squeeze(fold(quote)), []).append(i)
            q = _fuzzy(quote, threshold)
            if q is not None:
                found[i] = q
                by_size.setdefault(q.q, []).append(i)
        self.tables = [_Grams(size, own, [found[i] for i in own]) for size, own in by_size.items()]

    def candidates(self, text: str) -> list[int]:
        """Quotes that may stand in the text: by the automaton, or by q-grams on one diagonal."""
        found = {i for _, term in self.machine.iter(squeeze(fold(text))) for i in self.folded[term]}
        if self.tables:
            t = _plain_codes()[_points(text)]
            for table in self.tables:
                found |= table.candidates(t)
        return sorted(found)


@lru_cache(1)
def _plain_codes() -> np.ndarray:
    """For each code point that of its plain character."""
    return np.fromiter((ord(_plain(chr(c))) for c in range(0x110000)), np.uint32, 0x110000)


class _Grams:
    """An index of the q-grams of quotes, all of one q: for each gram the quotes and places that have it.

    Of a quote's places those of the commonest grams are left out, `SPARED` of the least number that a window has in common with
    it: a window still has the rest of that number among the others, which are far fewer to look up.
    """

    #: Places of a text that are looked up at once, bins that are counted without sorting, grams that are looked up without searching.
    PART, BINS, CODES = 20_000, 4_000_000, 4_000_000
    SPARED = 0.3

    def __init__(self, q: int, rows: list[int], quotes: list[Quote]):
        self.q, self.rows = q, rows
        self.size = np.array([len(x.text) for x in quotes], np.int32)
        self.longest = int(self.size.max())
        width = np.array([x.apart + 1 for x in quotes], np.int32)
        self.beyond = int((self.size + width).max())
        letters = np.array(sorted({ord(c) for x in quotes for c in x.text}), np.int64)
        self.letter = np.zeros(0x110000, np.uint32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        codes = [self._codes(_points(x.text)) for x in quotes]
        grams, number = np.unique(np.concatenate(codes), return_inverse=True)
        quote = np.repeat(np.arange(len(quotes), dtype=np.int32), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])
        least = np.array([x.least for x in quotes])
        spared = (least * self.SPARED).astype(np.int64)
        # The commonest places of each quote first.
        order = np.lexsort((offset, -np.bincount(number)[number], quote))
        first = np.cumsum([0, *[len(c) for c in codes[:-1]]])
        kept = order[np.arange(len(order)) - first[quote[order]] >= spared[quote[order]]]
        kept = kept[np.argsort(number[kept], kind="stable")]
        self.least = least - spared
        self.quote, self.offset = quote[kept], offset[kept]
        self.shift, self.width = self.size[self.quote] - self.offset, width[self.quote]
        self.grams, start = np.unique(number[kept], return_index=True)
        self.grams, self.start = grams[self.grams], start.astype(np.int64)
        self.count = np.diff(np.append(self.start, len(kept)))
        self.direct = None
        if self.base**q <= self.CODES:
            self.direct = np.full(self.base**q, -1, np.int32)
            self.direct[self.grams] = np.arange(len(self.grams))

    def _codes(self, t: np.ndarray) -> np.ndarray:
        """A number for each q-gram. In huge alphabets some share one, which adds candidates and loses none."""
        return numbered(self.letter[t].astype(np.uint64), self.q, self.base)

    def candidates(self, t: np.ndarray) -> set[int]:
        """Rows of the quotes that may have a window in a text of these plain code points."""
        out: set[int] = set()
        codes = self._codes(t)
        for low in range(0, max(1, len(codes)), self.PART):
            # Every window that starts in the part lies in it and what is looked up beyond it.
            own = codes[low : low + self.PART + self.beyond]
            if self.direct is not None:
                ids = self.direct[own]
            else:
                ids = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                ids = np.where(self.grams[ids] == own, ids, -1)
            at = np.flatnonzero(ids >= 0)
            n = self.count[ids[at]]
            total = int(n.sum())
            if not total:
                continue
            hit = np.repeat(self.start[ids[at]] - (np.cumsum(n) - n), n) + np.arange(total)
            # A window's hits lie on diagonals no wider apart than a band, so in two bands side by side.
            band = (np.repeat(at.astype(np.int32), n) + self.shift[hit]) // self.width[hit]
            bands = int(band.max()) + 2
            cell = self.quote[hit].astype(np.int64) * bands + band
            good = self._firm(cell, bands)
            if len(good):
                # A place of a quote counts once in a band, however often its gram stands there.
                near = np.isin(cell, np.append(good, good + 1))
                good = self._firm(np.unique(cell[near] * self.longest + self.offset[hit[near]]) // self.longest, bands)
                out.update(self.rows[k] for k in np.unique(good // bands).tolist())
        return out

    def _firm(self, cell: np.ndarray, bands: int) -> np.ndarray:
        """The cells (quote * bands + band) that have enough hits together with the next."""
        if len(self.rows) * bands <= self.BINS:
            counts = np.bincount(cell, minlength=len(self.rows) * bands + 1)
            return np.flatnonzero((counts[:-1] + counts[1:])[: len(self.rows) * bands].reshape(-1, bands) >= self.least[:, None])
        cells, own = np.unique(cell, return_counts=True)
        # A cell without hits has no more than the next has, which then counts alone.
        after = np.where(np.append(cells[1:] == cells[:-1] + 1, False), np.append(own[1:], 0), 0)
        return cells[own + after >= self.least[cells // bands]]


def anchor_quotes(docs: DataFrame, quotes: DataFrame, threshold: float | None = 90.0, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "item_id", quote_col: str = "text", hints: tuple[str, str] | None = None, block_chars: int = 2_000_000) -> DataFrame:
    """A row for each quote and text that holds it: both ids, method, score, start, end. `hints` names the columns of the words before and after a quote.

    Without a threshold the first four tiers alone are tried.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), quotes.schema[quote_id].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{quote_id}` {kinds[1]}, method string, score double, start int, end int"
    item_type = to_arrow_type(quotes.schema[quote_id].dataType)
    out = None
    for rows in blocks(quotes.select(quote_id, quote_col, *(hints or ())), block_chars, text_at=1):
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                block = block or _Block(sent.value, threshold)
                found = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    for i in block.candidates(text) if text else ():
                        item, quote, *near = block.rows[i]
                        hit = anchor(text, quote, *near, threshold=threshold)
                        if hit:
                            found.append((key, item, *hit))
                columns = list(zip(*found, strict=True)) or [()] * 6
                types = [batch.schema.field(0).type, item_type, pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, quote_id, "method", "score", "start", "end"])

        part = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
