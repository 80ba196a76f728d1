"""LM scoring by online logistic context mixing.

A text is its tokens: words (lower-cased A-Z, runs outside [\\x20\\x09-\\x0D]) and one end, which is the empty
word. Everything is coded bit by bit, and each bit's probability is mixed in the logistic domain from several
predictors, slots of counts hashed from a context and the bits before:

* Symbols. The `MOST_SYMBOLS` commonest training tokens that occur twice or more are symbols, all others
  share one; a symbol's bits are its Huffman code. Contexts: none; the word before; and the two words before,
  whose slot holds the symbol that the most votes have after them, as bits while these agree with the code so far.
* Spelling. A token without a symbol is, under the shared one, either a training token by its discounted
  count or, with what the discount frees, spelled: its bytes and a terminator. Contexts: its last one, two
  and three bytes and all of them.

A weight set gated by place in the code and by how often the two longest contexts were seen mixes the predictors; a second
table, by gate and by the mix's quantised logit, refines the result adaptively. The bits' probabilities multiply.

Learning covers every training document. 1. Tokens are counted into a table, which grows with the corpus.
2. All training texts fill the symbols' slots and all rare training tokens, once each, the spellings'. 3.
Weights and refinement are learned online over all of them: each partition goes through its texts in
mini-batches, every bit seen with its own occurrence left out of a context's counts, and the partitions' results are
averaged by what they saw. Slots grow with the tokens counted, up to 2**`MOST_BITS` for the two words before and half
of that for one: what goes to every task is bounded, and where contexts outgrow it the gates' weights say so.

Only tokens without a symbol are joined with the table of tokens; texts aren't shuffled.

Defined results: null text counts as empty and is the end alone; rows whose id is null are training rows;
without training documents N and V are 0 and bits are one half; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import collect_bounded, load, stored
from quillmill.llm.language_id import held_out
from quillmill.llm.shingles import U, VALUE, _power, buffers, mix, words_of

MOST_SYMBOLS, MOST_BITS = 1 << 16, 23
#: Text that one task counts: its slots leave it once.
COUNT_BYTES = 96 << 20
#: Slots in a row of the table of counts.
CHUNK = 1 << 14
#: Seen counts that part the confidence classes of the two longest contexts.
STEPS = np.array([1, 3, 10, 40])
PLACES = 3
GATES = PLACES * (len(STEPS) + 1) ** 2
BUCKETS = 33
#: Least curvature of a weight, and of a bit: a gate that few bits reach learns slowly and doesn't overshoot.
LEAST_CURVE, LEAST_BIT = 16.0, np.float32(0.05)
END = U(0x656E64)
_SPREAD, _NODE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
U32 = np.uint32
#: The input of an expected bit.
HINT = np.float32(2)
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -11, 11)))


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """node: already times _NODE."""
    at = context ^ node
    at *= _SPREAD
    at >>= U(64 - bits)
    return at.view(np.int64)


#: A seen count, cut off at the last step, to its class.
CLASS = np.searchsorted(STEPS, np.arange(STEPS[-1] + 1), "right").astype(np.uint8)
#: Logits are read to a sixteenth, up to 12.
FINE, EDGE = 16, 12
LEVELS = 2 * FINE * EDGE + 1

#: A symbol's bit has a key: (place, class of the word before, hint, bit). A hint is none, or its class where the expected symbol
#: has this bit, or its class and `len(STEPS)` where it has the other. A key fixes the gate and the hint's input.
HINTS = 2 * len(STEPS) + 1
KEYS = PLACES * (len(STEPS) + 1) * HINTS * 2
_HINT = np.arange(KEYS) // 2 % HINTS
KEY_GATE = np.arange(KEYS) // (2 * HINTS) * (len(STEPS) + 1) + np.where(_HINT > len(STEPS), _HINT - len(STEPS), _HINT)
KEY_BIT = (np.arange(KEYS) % 2).astype(np.float32)
KEY_INPUT = np.where(_HINT == 0, 0, np.where((_HINT <= len(STEPS)) == (KEY_BIT > 0), HINT, -HINT)).astype(np.float32)


def _inputs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logits of slots with their classes in the lowest three bits; none is so near 0 that these would be all of it."""
    x = _LOG[ones] - _LOG[zeros]
    x[(x == 0) & (zeros > 0)] = 1e-6
    both = x.view(U32)
    both &= U32(0xFFFFFFF8)
    both |= CLASS[np.minimum(zeros + ones, STEPS[-1])]
    return x


def _class(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint16)[::2] & np.uint16(7)


def _chance(z: np.ndarray) -> np.ndarray:
    p = np.minimum(z, np.float32(11))
    np.maximum(p, np.float32(-11), out=p)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _level(z: np.ndarray) -> np.ndarray:
    """The quantised logit, from 0."""
    return _rounded(z * np.float32(FINE), FINE * EDGE)


def _bucket(z: np.ndarray) -> np.ndarray:
    return _rounded(z * np.float32(2), BUCKETS // 2)


def _rounded(x: np.ndarray, most: int) -> np.ndarray:
    np.minimum(x, np.float32(most), out=x)
    np.maximum(x, np.float32(-most), out=x)
    np.rint(x, out=x)
    x += np.float32(most)
    return x.astype(np.int64)


class Mixer:
    """Tables of bit counts, mixing weights by gate, refinement by gate and bucket."""

    def __init__(self, counts: np.ndarray, tables: int, votes: np.ndarray | None = None):
        """counts: (2, slots of all tables one after another); larger ones are scaled to 16 bits, and a slot is its zeros and its ones << 16."""
        self.slots = np.zeros(counts.shape[1], np.uint32)
        for k in range(0, counts.shape[1], 1 << 20):
            part = counts[:, k : k + (1 << 20)]
            part = np.rint(part / np.maximum(part.max(0) / np.float32(65535), 1)).astype(np.uint32)
            self.slots[k : k + (1 << 20)] = part[0] | part[1] << np.uint32(16)
        self.tables, self.votes = tables, np.zeros(0, np.uint32) if votes is None else votes
        self.weights = np.full((GATES, tables + 1), 1.2 / tables, np.float32)
        self.weights[:, tables] = 0
        self.curve, self.turn = np.full((GATES, tables + 1), 16.0), 0
        self.refined = np.tile(squash((np.arange(BUCKETS) - BUCKETS // 2) / 2.0), (GATES, 1))

    def __getstate__(self) -> dict:
        """Packed on its way to the tasks: most slots of a small corpus are empty."""
        kept = {n: v for n, v in self.__dict__.items() if n not in ("seen", "without", "table")}
        return kept | {n: zlib.compress(getattr(self, n).tobytes(), 1) for n in ("slots", "votes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {n: np.frombuffer(zlib.decompress(state[n]), np.uint32) for n in ("slots", "votes")}

    @cached_property
    def seen(self) -> np.ndarray:
        """The input of each slot."""
        return _inputs(self.slots & U32(65535), self.slots >> U32(16))

    @cached_property
    def without(self) -> np.ndarray:
        """The inputs of each slot less a zero, and less a one, which is what a bit of training sees: it is in one of the halves itself."""
        out = np.empty((len(self.slots), 2), np.float32)
        for k in range(0, len(self.slots), 1 << 18):
            zeros, ones = self.slots[k : k + (1 << 18)] & U32(65535), self.slots[k : k + (1 << 18)] >> U32(16)
            out[k : k + (1 << 18), 0] = _inputs(zeros - (zeros > 0), ones)
            out[k : k + (1 << 18), 1] = _inputs(zeros, ones - (ones > 0))
        return out.reshape(-1)

    @cached_property
    def table(self) -> np.ndarray:
        """The log10 probability of a bit by gate, quantised logit and bit."""
        z = np.arange(LEVELS) / FINE - EDGE
        at = np.clip(z * 2 + BUCKETS // 2, 0, BUCKETS - 1.001)
        low = at.astype(np.int64)
        p = 0.5 * squash(z) + 0.5 * (self.refined[:, low] * (1 - at + low) + self.refined[:, low + 1] * (at - low))
        p = np.clip(p, 1e-5, 1 - 1e-5)
        return np.log10(np.stack([1 - p, p], 2)).astype(np.float32)

    def learner(self) -> Mixer:
        """One that learns from here; a worker keeps this one as it came, for its next tasks, with what was made of its slots."""
        self.without  # noqa: B018
        own = Mixer.__new__(Mixer)
        own.__dict__ = self.__dict__ | {"weights": self.weights.copy(), "curve": self.curve.copy()}
        return own

    def _gate(self, place: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
        k = len(STEPS) + 1
        return (place * k + seen[0]) * k + seen[1]

    def _dot(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        z = weights[self.tables].take(gate)
        for t in range(self.tables):
            z += weights[t].take(gate) * x[t]
        return z

    def logs(self, slots: list[np.ndarray], place: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The log10 probability of each bit."""
        x = [self.seen.take(s) for s in slots]
        gate = self._gate(place, [_class(y) for y in x[-2:]])
        return self.table.reshape(-1).take((gate * LEVELS + _level(self._dot(x, gate))) * 2 + bit)

    def learn(self, slots: list[np.ndarray], place: np.ndarray, bit: np.ndarray, totals: np.ndarray, hint: tuple | None = None) -> None:
        """One mini-batch, each bit without its own occurrence; totals (2, GATES, BUCKETS) gathers the bits and the ones that the refinement has seen.

        hint: the last table's inputs and classes, where these aren't slots.
        """
        x = []
        for t, s in enumerate(slots):
            # Less the bit itself. Not without a context: codes are made from these counts, so zeros and ones are nearly equal,
            # and what a bit leaves behind would tell it.
            x.append(self.without.take((s << 1) + bit) if t or hint is None else self.seen.take(s))
        seen = [_class(y) for y in x[max(0, self.tables - 2) :]]
        if hint is not None:
            x.append(hint[0])
            seen.append(hint[1])
        gate = self._gate(place, seen)
        z = self._dot(x, gate)
        p = _chance(z)
        error = bit - p
        x.append(np.ones(len(z), np.float32))

        def curves() -> np.ndarray:
            curve = np.maximum(p * (1 - p), LEAST_BIT)  # sure bits count, too: a wrong one moves the weights by little
            return np.array([np.bincount(gate, curve * y * y, GATES) for y in x])

        self._step(np.bincount(gate, minlength=GATES), np.array([np.bincount(gate, error * y, GATES) for y in x]), curves)
        seen_bits = np.bincount((gate * BUCKETS + _bucket(z)) * 2 + bit, minlength=2 * GATES * BUCKETS).reshape(GATES, BUCKETS, 2)
        totals[0] += seen_bits.sum(2)
        totals[1] += seen_bits[:, :, 1]

    def _step(self, bits: np.ndarray, pull: np.ndarray, curves: Callable[[], np.ndarray]) -> None:
        """Moves the weights; bits by gate, pull and curvature by table and gate."""
        if self.turn % 4 == 0 or (bits > self.curve[:, self.tables]).any():
            # The curvature changes slowly: it is measured in every fourth batch, for the four, and where a gate has many bits at once.
            self.curve = np.maximum(0.92 * self.curve + 4 * curves().T, LEAST_CURVE)
        self.turn += 1
        self.weights += pull.T / self.curve

    def plain(self, symbols: Symbols) -> np.ndarray:
        """The input without a context of each place in the codes."""
        slots = self.slots[: symbols.nodes]
        return _inputs(slots & U32(65535), slots >> U32(16))[symbols.node]

    def _keyed(self, plain: np.ndarray, context: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, logit) of symbols' bits; plain, context: their inputs; key: without the class of the context."""
        key = (key + _class(context) * np.uint16(2 * HINTS)).astype(np.int64)
        w = self.weights[KEY_GATE]
        z = (w[:, 2] * KEY_INPUT + w[:, 3]).take(key, mode="clip")  # keys are in range; this spares their check
        for k, x in ((0, plain), (1, context)):
            y = w[:, k].copy().take(key, mode="clip")
            y *= x
            z += y
        return key, z

    def coded_logs(self, plain: np.ndarray, slot: np.ndarray, key: np.ndarray) -> np.ndarray:
        """As logs(), of symbols' bits."""
        key, z = self._keyed(plain, self.seen.take(slot), key)
        level = _level(z)
        key *= LEVELS
        level += key
        return self._key_table.take(level, mode="clip")

    @cached_property
    def _key_table(self) -> np.ndarray:
        return self.table[KEY_GATE[:, None], np.arange(LEVELS), np.arange(KEYS)[:, None] % 2].reshape(-1)

    def learn_coded(self, plain: np.ndarray, slot: np.ndarray, key: np.ndarray, totals: np.ndarray) -> None:
        """As learn(), of symbols' bits; totals is by key and bucket."""
        slot = slot << 1
        slot += key & np.uint16(1)
        context = self.without.take(slot)
        key, z = self._keyed(plain, context, key)
        p = _chance(z)
        error = KEY_BIT.take(key, mode="clip")
        error -= p

        def sums(y: np.ndarray, a: np.ndarray, b: np.ndarray, hint: np.ndarray) -> np.ndarray:
            all_bits = np.bincount(key, y, KEYS)
            return np.array([np.bincount(KEY_GATE, v, GATES) for v in (np.bincount(key, y * a, KEYS), np.bincount(key, y * b, KEYS), all_bits * hint, all_bits)])

        at = key * BUCKETS
        at += _bucket(z)
        seen = np.bincount(at, minlength=KEYS * BUCKETS).reshape(KEYS, BUCKETS)
        totals += seen
        self._step(np.bincount(KEY_GATE, seen.sum(1), GATES), sums(error, plain, context, KEY_INPUT),
                   lambda: sums(np.maximum(p * (1 - p), LEAST_BIT), plain * plain, context * context, KEY_INPUT * KEY_INPUT))

    def state(self, totals: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, weight, weighted value) of all that has been learned, for a sum over partitions."""
        n = totals[0].sum(1)
        for g in np.flatnonzero(n):
            for t in range(self.tables + 1):
                yield int(g * (self.tables + 1) + t), float(n[g]), float(n[g] * self.weights[g, t])
        for g, b in zip(*np.nonzero(totals[0]), strict=True):
            yield int(GATES * (self.tables + 1) + g * BUCKETS + b), float(totals[0, g, b]), float(totals[1, g, b])

    def take(self, cells: list[tuple[int, float, float]], prior: float = 200.0) -> None:
        size = GATES * (self.tables + 1)
        for k, n, v in cells:
            if k < size:
                self.weights.reshape(-1)[k] = v / n
            else:
                p = self.refined.reshape(-1)
                p[k - size] = (v + prior * p[k - size]) / (n + prior)


def huffman(counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each symbol its (node, bit) from the root, of as many symbols less one nodes; ties by symbol."""
    heap = [(max(c, 1), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    made, parent = len(counts), {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (made, 0), (made, 1)
        heapq.heappush(heap, (a[0] + b[0], made, made))
        made += 1
    codes = []
    for i in range(len(counts)):
        own = []
        while i in parent:
            i, bit = parent[i]
            own.append((i - len(counts), bit))
        codes.append(own[::-1])
    return codes


class Symbols:
    """The symbols' hashes and codes. Symbol i is words[i]; the one after the last is all other tokens."""

    def __init__(self, words: list[bytes], counts: list[int], others: int, bits: int):
        hashes = np.array([END if not w else 0 for w in words], U)
        real = [i for i, w in enumerate(words) if w]
        if real:
            column = pa.array([words[i] for i in real], pa.large_binary())
            hashes[real] = np.concatenate([h for _, _, _, h, _, _ in words_of(*buffers(column))])
        self.hashes = hashes
        self.logs = np.log10(np.append(counts, 0) + 1.0)
        codes = huffman([*counts, others])
        self.length = np.array([len(c) for c in codes])
        self.start = np.append(0, np.cumsum(self.length))[:-1]
        flat = [x for c in codes for x in c]
        self.code = np.array([node << 1 | bit for node, bit in flat], np.int32)
        self.nodes, self.bits = len(codes), bits
        self.slots = self.nodes + (1 << bits - 1)

    @property
    def node(self) -> np.ndarray:
        return (self.code >> 1).astype(np.int64)

    @property
    def bit(self) -> np.ndarray:
        return (self.code & 1).astype(np.uint8)

    @property
    def salt(self) -> np.ndarray:
        """What a node adds to a context."""
        return (self.node + 1).view(U) * _NODE

    @cached_property
    def _first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the commonest symbol by the first 20 bits of its hash, the other symbols by hash, their hashes)."""
        n = len(self.hashes)
        first, at = np.full(1 << 20, n, np.int32), (self.hashes >> U(44)).view(np.int64)
        first[at[::-1]] = np.arange(n)[::-1]
        rest = np.flatnonzero(first[at] != np.arange(n))
        rest = rest[np.argsort(self.hashes[rest])]
        return first, rest, self.hashes[rest]

    def find(self, h: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        first, rest, sorted_rest = self._first
        out = first.take((h >> U(44)).view(np.int64)).astype(np.int64)
        left = np.flatnonzero((self.hashes.take(out, mode="clip") != h) & (out < n))
        out[left] = n
        if len(rest) and len(left):
            at = np.minimum(np.searchsorted(sorted_rest, h[left]), len(rest) - 1)
            good = sorted_rest[at] == h[left]
            out[left[good]] = rest[at[good]]
        return out

    @cached_property
    def _by_place(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place in the codes its key without hint and class; of each symbol its code from the highest bit on."""
        inner = np.arange(len(self.code)) - np.repeat(self.start, self.length)
        key = np.minimum(inner >> 2, PLACES - 1) * ((len(STEPS) + 1) * HINTS * 2) + self.bit
        path = np.zeros(self.nodes, U)
        short = inner < 64  # longer codes need some 10**13 tokens; their hints would be of the first 64 bits
        np.add.at(path, np.repeat(np.arange(self.nodes), self.length)[short], self.bit[short].astype(U) << (63 - inner[short]).astype(U))
        return key.astype(np.uint16), path

    def bits_of(self, symbol: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each token, place in the codes, slot of the word before) of the bits of tokens with these symbols and contexts."""
        size = self.length.take(symbol)
        at = np.repeat(self.start.take(symbol) - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        slot = ((self.code.take(at) >> 1) + 1).astype(U)  # less memory to reach into than the salts
        slot *= _NODE
        slot ^= np.repeat(one, size)
        slot *= _SPREAD
        slot >>= U(65 - self.bits)
        slot = slot.view(np.int64)
        slot += self.nodes
        return size, at, slot

    def keys(self, size: np.ndarray, at: np.ndarray, symbol: np.ndarray, two: np.ndarray, votes: np.ndarray, without: bool) -> np.ndarray:
        """The key, without the class of the word before, of each bit, with the symbol that the votes expect; `without`: less each token's own vote."""
        key, path = self._by_place
        vote = votes.take(self.context(two))
        guess, n = (vote >> U32(15)).astype(np.int64), (vote & U32(32767)).astype(np.int64)
        if without:
            n = n + np.where(guess == symbol, -1, n > 0)
        sure = CLASS.take(np.clip(n, 0, STEPS[-1])).astype(np.uint16)
        # Both codes pass the same nodes up to the first bit that differs, and that one's node.
        differ = path.take(symbol) ^ path.take(guess, mode="clip")
        high = differ >> U(32)
        same = np.where(high > 0, 32, 64) - np.frexp(np.where(high > 0, high, differ).astype(np.float64))[1]
        same = np.where(n > 0, np.where(guess == symbol, size, np.minimum(same, size)), 0)
        other = (n > 0) & (same < size)
        kinds, bits = np.zeros((len(symbol), 3), np.uint16), np.empty((len(symbol), 3), np.int64)
        kinds[:, 0], kinds[:, 1] = 2 * sure, 2 * (sure + np.uint16(len(STEPS)))
        bits[:, 0], bits[:, 1], bits[:, 2] = same, other, size - same - other
        out = np.repeat(kinds.reshape(-1), bits.reshape(-1))
        out += key.take(at)
        return out

    def context(self, two: np.ndarray) -> np.ndarray:
        return _slot(two, U(0), self.bits)

    def vote(self, votes: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> None:
        """Adds the votes of tokens: of a slot the symbol with the most, and by how many more than all others together."""
        slot = self.context(two)
        key, n = np.unique(slot << 17 | symbol, return_counts=True)
        slot = key >> 17
        key = (slot << 23 | n) << 17 | key & 131071  # fewer than 2**23 tokens at once
        key.sort()
        slot, n = key >> 40, key >> 17 & 8388607
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        total = np.diff(np.append(0, np.cumsum(n)[last]))
        lead = 2 * n[last] - total
        good = lead > 0
        at = slot[last][good]
        votes[at] = merged_votes(votes[at], ((key[last][good] & 131071) << 15 | np.minimum(lead[good], 32767)).astype(np.uint32))


def merged_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Votes of two tables: equal symbols add up, others take from each other."""
    n, m = (a & U32(32767)).astype(np.int64), (b & U32(32767)).astype(np.int64)
    same = a >> U32(15) == b >> U32(15)
    left = np.where(same, np.minimum(n + m, 32767), np.abs(n - m))
    symbol = np.where(n >= m, a >> U32(15), b >> U32(15)).astype(np.int64)
    return np.where(left > 0, symbol << 15 | left, 0).astype(np.uint32)


def sequences(column: pa.Array) -> Iterator[tuple]:
    """(first document, document after the last, owner, hashes, one, two, begins, ends) of blocks' tokens; an end begins and ends at -1."""
    data, edges = buffers(column)
    for a, b, owner, h, s, e in words_of(data, edges):
        n = np.bincount(owner, minlength=b - a)
        last = np.cumsum(n + 1) - 1
        word = np.ones(len(h) + b - a, bool)
        word[last] = False
        full = np.full(len(word), END, U)
        begin, end = np.full(len(word), -1, np.int64), np.full(len(word), -1, np.int64)
        full[word], begin[word], end[word] = h, s, e
        one = np.append(END, full[:-1])
        before = np.append(END, one[:-1])
        first = np.append(0, last[:-1] + 1)
        before[first] = END  # an end stands before every text
        yield a, b, np.repeat(np.arange(b - a), n + 1), full, mix(one + U(1)), mix(mix(before + U(2)) + one), begin, end


class Spelling:
    """The byte stream of tokens, each with its terminator, and the slots of every bit's contexts."""

    TABLES = 4

    def __init__(self, words: list[bytes], bits: int):
        size = np.array([len(w) + 1 for w in words])
        self.bits = bits
        self.start = np.append(0, np.cumsum(size))[:-1]
        data = self.data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        place = np.arange(len(data)) - np.repeat(self.start, size)
        up, down = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(VALUE[data] * up[: len(data)], out=total[1:])
        at = np.repeat(self.start, size)
        whole = mix((total[:-1] - total[at]) * down[at])
        code = data.astype(U) + U(1)
        orders, h = [], np.zeros(len(data), U)
        for k in range(1, self.TABLES + 1):
            before = np.zeros(len(data), U)
            before[k:] = code[:-k]
            before[place < k] = 0
            h = (h << U(9)) | before
            if k > 1:
                orders.append(mix(h * U(8) + U(k)))
        self.contexts = [*orders, mix(whole + U(77))]
        self.place = np.minimum(place // 2, PLACES - 1)

    def events(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each of the 8 bits of all bytes: (slots by table, bit)."""
        d = self.data.astype(np.uint32)
        for b in range(8):
            node = (np.uint32(1 << b) | (d >> np.uint32(8 - b))).astype(U) * _NODE
            yield [(t << self.bits) + _slot(c, node, self.bits) for t, c in enumerate(self.contexts)], ((d >> np.uint32(7 - b)) & np.uint32(1)).astype(np.uint8)


def spelled(words: list[bytes], mixer: Mixer, bits: int) -> np.ndarray:
    """The log10 probability of each token's bytes by the mixed bits."""
    part = Spelling(words, bits)
    total = np.zeros(len(part.data))
    for slots, bit in part.events():
        total += mixer.logs(slots, part.place, bit)
    return np.add.reduceat(total, part.start)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, occurrences in training) for the distinct tokens of each batch of (training?, text)."""
    for batch in batches:
        train = batch.column(0).fill_null(False)
        text = batch.column(1).fill_null("")
        seen = _words(text.filter(train)).value_counts()
        new = _words(text.filter(pc.invert(train))).unique()
        new = new.filter(pc.invert(pc.is_in(new, seen.field(0))))
        words = pa.concat_arrays([seen.field(0), new]).cast(pa.binary())
        n = pa.concat_arrays([seen.field(1), pa.array(np.zeros(len(new), np.int64))])
        ends = pc.sum(train).as_py() or 0
        words, n = (pa.concat_arrays([x, pa.array([y], x.type)]) for x, y in ((words, b""), (n, ends)))
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([words.slice(i, 100_000), n.slice(i, 100_000)], ["w", "c"])


def _words(text: pa.Array) -> pa.Array:
    words = pc.ascii_split_whitespace(pc.ascii_lower(text)).flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _chunk(k: int, part: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    row = {"k": [k], "t": [TaskContext.get().partitionId()], "w": [part.itemsize], "n": [zlib.compress(part.tobytes(), 1)]}
    return pa.RecordBatch.from_pydict({n: pa.array(v, kind) for (n, v), kind in zip(row.items(), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})


def _filled(events: Iterator[tuple[list[np.ndarray], np.ndarray]], slots: int, votes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, task, bytes of a number, packed numbers) of the bits in each slot; of the votes with negative chunks."""
    counts = np.zeros(2 * slots, np.int32)
    for by_table, bit in events:
        for s in by_table:
            np.add.at(counts, (s << 1) + bit, np.int32(1))
    both = counts.reshape(slots, 2)
    for k in range(0, slots, CHUNK):
        part = both[k : k + CHUNK].T
        if part.any():
            part = part.astype(np.uint16) if part.max() < 1 << 16 else part
            yield _chunk(k, part)
    for k in range(0, 0 if votes is None else len(votes), CHUNK):
        if votes[k : k + CHUNK].any():
            yield _chunk(-1 - k, votes[k : k + CHUNK])


def _add_slots(table: pa.Table) -> pa.Table:
    """One chunk of all tasks, in the order of the tasks."""
    k, total = table["k"][0].as_py(), None
    for _, w, n in sorted(zip(table["t"].to_pylist(), table["w"].to_pylist(), table["n"], strict=True), key=lambda x: x[0]):
        part = np.frombuffer(zlib.decompress(n.as_py()), np.uint16 if w == 2 else np.uint32)
        part = part.astype(np.int64) if k >= 0 else part
        total = part if total is None else total + part if k >= 0 else merged_votes(total, part)
    return pa.table({"k": table["k"].slice(0, 1), "n": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _counts(parts: DataFrame, slots: int, contexts: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sums of _filled's rows, counts and votes, in the driver: (slots + contexts) / CHUNK rows, whatever the corpus."""
    counts, votes = np.zeros((2, slots), np.float32), np.zeros(contexts, np.uint32)
    for r in parts.groupBy("k").applyInArrow(_add_slots, "k long, n binary").toLocalIterator():
        part = zlib.decompress(r.n)
        if r.k < 0:
            votes[-1 - r.k : -1 - r.k + CHUNK] = np.frombuffer(part, np.uint32)
        else:
            part = np.frombuffer(part, np.int64).reshape(2, -1)
            counts[:, r.k : r.k + part.shape[1]] = part
    return counts, votes


def _learned(mixer: Mixer, states: DataFrame) -> None:
    cells = states.groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    mixer.take([(r.k, r.n, r.v) for r in collect_bounded(cells, GATES * (mixer.tables + 1 + BUCKETS), "cells")])


def _by_gate(seen: np.ndarray) -> np.ndarray:
    """Bits by key and bucket as bits and ones by gate and bucket."""
    totals = np.zeros((2, GATES, BUCKETS))
    np.add.at(totals[0], KEY_GATE, seen)
    np.add.at(totals[1], KEY_GATE[1::2], seen[1::2])
    return totals


def _state_rows(mixer: Mixer, totals: np.ndarray) -> pa.RecordBatch:
    k, n, v = zip(*mixer.state(totals), strict=True) if totals[0].any() else ((), (), ())
    return pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "n": pa.array(n, pa.float64()), "v": pa.array(v, pa.float64())})


def _bits(n: int) -> int:
    return min(MOST_BITS, max(12, int(n).bit_length()))


class Model:
    """Both mixers, the symbols, and the counts that the other tokens' probabilities need."""

    def __init__(self, symbols: Symbols, mixer: Mixer, spelling: Mixer, spelling_bits: int, discount: float, others: int, distinct: int):
        self.symbols, self.mixer, self.spelling, self.spelling_bits = symbols, mixer, spelling, spelling_bits
        self.discount, self.others, self.distinct = discount, others, distinct

    def coded(self, symbol: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The log10 probability of each token's symbol in its context."""
        size, at, slot = self.symbols.bits_of(symbol, one)
        if not len(at):
            return np.zeros(len(symbol))  # a lone symbol has no bits; elsewhere every symbol has
        logs = self.mixer.coded_logs(self._plain.take(at), slot, self.symbols.keys(size, at, symbol, two, self.mixer.votes, False))
        return np.add.reduceat(logs, np.cumsum(size) - size, dtype=np.float64)

    @cached_property
    def _plain(self) -> np.ndarray:
        return self.mixer.plain(self.symbols)

    def other(self, words: list[bytes], seen: np.ndarray) -> np.ndarray:
        """The log10 probability of tokens without a symbol, given that; seen: their counts in training."""
        own = spelled(words, self.spelling, self.spelling_bits)
        if not self.others:
            return own
        free = self.discount * self.distinct / self.others
        return np.log10(np.maximum(seen - self.discount, 0) / self.others + free * 10**own)


def train_model(table: DataFrame, texts: DataFrame) -> tuple[Model, int, int]:
    """(model, N, V) of the stored table of tokens (w, c) and the training texts (one column)."""
    spark = table.sparkSession
    learned = table.where("c > 0")
    n_all, n_distinct, n_bytes, once, twice = (x or 0 for x in learned.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.col("c") * (F.octet_length("w") + 1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    common = collect_bounded(learned.where("c > 1").orderBy(F.desc("c"), "w").limit(MOST_SYMBOLS), MOST_SYMBOLS, "symbols")
    words, counts = [bytes(r.w) for r in common], [r.c for r in common]
    symbols = Symbols(words, counts, n_all - sum(counts), _bits(8 * n_all))
    tasks = max(1, -(-n_bytes // COUNT_BYTES))
    shared = spark.sparkContext.broadcast(symbols)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, votes = shared.value, np.zeros(1 << shared.value.bits, np.uint32)

        def events():
            bits = own.bit
            for batch in batches:
                for _, _, _, h, one, two, _, _ in sequences(batch.column(0)):
                    for i in range(0, len(h), 1 << 13):
                        s = slice(i, i + (1 << 13))
                        symbol = own.find(h[s])
                        own.vote(votes, two[s], symbol)
                        _, at, slot = own.bits_of(symbol, one[s])
                        yield [slot], bits.take(at)  # without a context: see below

        return _filled(events(), own.slots, votes)

    counted, votes = _counts(texts.coalesce(tasks).mapInArrow(fill, "k long, t int, w int, n binary"), symbols.slots, 1 << symbols.bits)
    plain = np.zeros((2, symbols.nodes))
    np.add.at(plain, (symbols.bit, symbols.node), np.repeat([*counts, n_all - sum(counts)], symbols.length))
    counted[:, : symbols.nodes] = plain
    mixer = Mixer(counted, 3, votes)
    start = spark.sparkContext.broadcast(mixer)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, code, seen = start.value.learner(), shared.value, np.zeros((KEYS, BUCKETS))
        plain = own.plain(code)
        for batch in batches:
            for _, _, _, h, one, two, _, _ in sequences(batch.column(0)):
                for i in range(0, len(h), 1 << 11):
                    s = slice(i, i + (1 << 11))
                    symbol = code.find(h[s])
                    size, at, slot = code.bits_of(symbol, one[s])
                    if len(at):
                        own.learn_coded(plain.take(at), slot, code.keys(size, at, symbol, two[s], own.votes, True), seen)
        yield _state_rows(own, _by_gate(seen))

    _learned(mixer, texts.mapInArrow(learn, "k int, n double, v double"))

    rare = learned.join(F.broadcast(learned.where("c > 1").orderBy(F.desc("c"), "w").limit(MOST_SYMBOLS).select("w")), "w", "left_anti")
    others, distinct, size = (x or 0 for x in rare.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.octet_length("w") + 1)).first())
    bits = min(20, _bits(size))
    spread = rare.select("w").repartition(max(1, -(-size // (COUNT_BYTES // 8))))

    def fill_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events():
            for batch in batches:
                for i in range(0, len(batch), 5_000):
                    yield from Spelling(batch.column(0).slice(i, 5_000).to_pylist(), bits).events()

        return _filled(events(), Spelling.TABLES << bits)

    spelling = Mixer(_counts(spread.mapInArrow(fill_spelling, "k long, t int, w int, n binary"), Spelling.TABLES << bits)[0], Spelling.TABLES)
    first = spark.sparkContext.broadcast(spelling)

    def learn_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = first.value.learner(), np.zeros((2, GATES, BUCKETS))
        for batch in batches:
            for i in range(0, len(batch), 1_000):
                part = Spelling(batch.column(0).slice(i, 1_000).to_pylist(), bits)
                for slots, bit in part.events():
                    own.learn(slots, part.place, bit, totals)
        yield _state_rows(own, totals)

    _learned(spelling, rare.select("w").mapInArrow(learn_spelling, "k int, n double, v double"))
    return Model(symbols, mixer, spelling, bits, discount, others, distinct), n_all, n_distinct


def score(docs: DataFrame, train: object, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, _train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    `train` is a Column that is true for the documents to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), train.alias("_train"), F.col(text_col).alias("_text"))
    table = stored(rows.select("_train", "_text").mapInArrow(_tokens, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")))
    model, n_all, n_distinct = train_model(table, rows.where("_train").select("_text"))
    shared = spark.sparkContext.broadcast(model)  # of a bounded size: see the module's head
    base = float(np.log10(n_all + n_distinct + 1.0))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, _ = buffers(batch.column(2))
            data = data.tobytes().lower()
            for a, b, owner, h, one, two, begin, end in sequences(batch.column(2)):
                symbol = own.symbols.find(h)
                lp = np.concatenate([own.coded(symbol[i : i + (1 << 12)], one[i : i + (1 << 12)], two[i : i + (1 << 12)]) for i in range(0, len(h), 1 << 12)])
                known = symbol < own.symbols.nodes - 1
                logs = np.where(known, own.symbols.logs[symbol] - base, 0)
                n, total, plain, found = (np.bincount(owner, x, b - a) for x in (None, lp, logs, known))
                size = np.bincount(owner, np.where(begin < 0, 1, end - begin + 1), b - a)
                rest: list[Counter] = [Counter() for _ in range(b - a)]
                at = np.flatnonzero(~known)
                for d, s, e in zip(owner[at].tolist(), begin[at].tolist(), end[at].tolist(), strict=True):
                    rest[d][data[s:e]] += 1  # of an end nothing
                words, times = pa.array([w for r in rest for w in r], pa.binary()), pa.array([k for r in rest for k in r.values()], pa.int32())
                others = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), pa.StructArray.from_arrays([words, times], ["w", "k"]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(plain), pa.array(total), pa.array(size.astype(np.int64)), others],
                    ["_id", "_train", "n", "known", "base", "lp", "size", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    coded_rows = rows.mapInArrow(coded, f"_id {kind}, _train boolean, n long, known long, base double, lp double, size long, others array<struct<w:binary,k:int>>")
    coded_rows = stored(coded_rows.withColumn("_row", F.monotonically_increasing_id()))

    def token_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 5_000):
                part = batch.slice(i, 5_000)
                yield pa.RecordBatch.from_pydict({"w": part.column(0), "c": part.column(1), "lp": pa.array(shared.value.other(part.column(0).to_pylist(), part.column(1).to_numpy()))})

    # Of each document its distinct tokens without a symbol; these alone are looked up.
    wanted = coded_rows.select("_row", F.inline("others"))
    scored = table.where(F.col("c") <= (min(n_all, _least_symbol(model)))).mapInArrow(token_scores, "w binary, c long, lp double")
    k = F.col("k")
    sums = wanted.join(scored, "w").groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("more"), F.sum(k * (F.log10(F.col("c") + 1.0) - base)).alias("plain"), F.sum(k * F.col("lp")).alias("rest"))
    out = coded_rows.drop("others").join(sums.withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left")
    total = F.col("lp") + F.coalesce("rest", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), "_train", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plain", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total / float(np.log10(2)) / F.col("size")).alias("bits_per_byte"))


def _least_symbol(model: Model) -> int:
    """No token without a symbol has a greater count."""
    logs = model.symbols.logs[:-1]
    return int(round(10 ** logs.min())) - 1 if len(logs) == MOST_SYMBOLS else 1


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over all of `documents`."""
    out = score(load(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7))
    return out.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
