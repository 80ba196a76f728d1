"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

The main loop is `merge`: symbols of a piece form a doubly linked list, every adjacent pair that the
vocabulary can merge waits in a heap by (rank, position), and entries whose symbols have changed since
are skipped. Decoding concatenates the vocabulary's strings. Each task keeps a bounded memo from a
piece of text between white space to its ids, so a word is merged once and looked up afterwards.

Defined results: null text counts as empty; an empty text has no ids (n_tokens 0, sha256 of nothing).
Special strings of the vocabulary found in a text become their own ids, as the public library has it.
Repeated rows and ties need no rule (every row is encoded alone); other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import load

#: Unicode White_Space, spelled out since Python's \s also has U+001C to U+001F. Fixed values.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Spans that no piece of the byte-level split crosses: a word with the space before it, or white space.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The byte-level split of the public vocabulary (see its README). Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Memo entries of a generation that a worker keeps; and of a small memo, just below two thirds of 2**17, where a dict doubles.
MEMO, SMALL_MEMO = 350_000, 87_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the rest follow from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def merge(ids: list[int], ranks: dict[int, int], rules: list[tuple[int, int, int]]) -> list[int]:
    """Merges symbols in rank order; of equal ranks the leftmost goes first.

    ranks: rank by left << 20 | right; rules: (left, right, merged) by rank. A heap entry is one integer,
    rank << 32 | position.
    """
    n = len(ids)
    heap, left = [], ids[0]
    for i in range(1, n):
        right = ids[i]
        if (rank := ranks.get(left << 20 | right)) is not None:
            heap.append(rank << 32 | i - 1)
        left = right
    if not heap:
        return ids
    heapq.heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        top = pop(heap)
        left, right, merged = rules[top >> 32]
        i = top & 0xFFFFFFFF
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # stale: one of the two has been merged meanwhile
        ids[i], ids[j] = merged, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := get(merged << 20 | ids[k])) is not None:
                push(heap, rank << 32 | i)
        if (h := before[i]) >= 0 and (rank := get(ids[h] << 20 | merged)) is not None:
            push(heap, rank << 32 | h)
    return [x for x in ids if x >= 0]


class Memo(dict):
    """A bounded memo of two generations: what the last `most` new entries didn't ask for is forgotten."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = {}  # before the copy: no three generations at once
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


class ByteBpe:
    """A byte-level BPE vocabulary in the public library's JSON format."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab = d["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in d["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {left << 20 | right: rank for rank, (left, right, _) in enumerate(self.rules)}
        value = {c: b for b, c in letters.items()}
        self.strings = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"), regex.V0)
        self.chunk = Memo(self._chunk, memo)
        self.decimal = {str(i): s for i, s in self.strings.items()}

    def _chunk(self, chunk: str) -> str:
        out: list[int] = []
        for piece in self.pieces.findall(chunk):
            out += merge([self.first[b] for b in piece.encode()], self.ranks, self.rules)
        return ",".join(map(str, out))

    def encode_chunks(self, text: str) -> list[str]:
        """Ids as decimal strings joined by commas, one string for each span of CHUNKS."""
        if self.cut is None or not any(s in text for s in self.special):
            return list(map(self.chunk.__getitem__, CHUNKS.findall(text)))
        out = []
        for part in self.cut.split(text):
            out += [str(self.special[part])] if part in self.special else map(self.chunk.__getitem__, CHUNKS.findall(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.encode_chunks(text) for i in c.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


_open: dict[tuple[str, int], ByteBpe] = {}


def opened(path: str, memo: int = MEMO) -> ByteBpe:
    if (path, memo) not in _open:
        _open[path, memo] = ByteBpe(path, memo)
    return _open[path, memo]


def closed(path: str, memo: int) -> None:
    """Forgets the vocabulary and its memo."""
    if (bpe := _open.pop((path, memo), None)) is not None:
        bpe.chunk.clear()
        bpe.chunk.make, bpe.chunk.old = None, {}  # no cycle keeps it


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """Encodes every whole text and decodes it again: one row per row of `docs`, without a shuffle.

    Columns: the id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256; with
    `keep_ids` also ids (array<int>) and decoded (string), the operator's real outputs. A smaller `memo` takes less memory and more
    time, and is dropped with the vocabulary at the end of a task: workers serve later stages, too.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path, memo)
        for batch in batches:
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for value in batch.column(1):
                chunks = bpe.encode_chunks(value.as_py() or "")
                joined = ",".join(chunks)
                back = b"".join(map(bpe.decimal.__getitem__, joined.split(","))).decode("utf-8", "replace") if joined else ""
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(i) for i in joined.split(",")] if joined else [])
                    decoded.append(back)
            out = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if keep_ids:
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(out)
        if memo < MEMO:
            closed(path, memo)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests over all of `documents`, with the public byte-level vocabulary."""
    import public_tokenizers

    return encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
