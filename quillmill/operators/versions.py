"""Two versions of a text, such as a file's own text and what scanning its picture gave, merged line by line.

Lines are compared by keys (lower case, marks of no meaning as spaces) and, where they have no equal, by tokens: of
two lines with four tokens or more that share 0.75 of the smaller set one is a near duplicate of the other. The
longest common subsequence of both versions over matching lines aligns them. It is found from the
matching pairs alone, by patience; with an index of tokens no two lines are compared that share none of their rarest.

The first version's lines stay in their order. A line of it that is only the end of a longer line of the other is
replaced by that line; lines of the other that it has in no form go in after the line that the one before them is
aligned with, up to a number. Null is a version without lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 0.75
LEAST_TOKENS = 4
#: A fragment is at most so long, and its whole line longer by so much.
MOST_FRAGMENT, LEAST_MORE = 64, 15


Tokens = frozenset[str]
_NO_MEANING = re.compile(r"[^a-z0-9%:/.,\-]+")
_LETTERED = re.compile("[^ ]*[a-z][^ ]*")


def key(line: str) -> str:
    return _NO_MEANING.sub(" ", line.lower()).strip()


@dataclass(frozen=True)
class Line:
    text: str
    key: str
    tokens: Tokens


def lines(text: str | None) -> list[Line]:
    """The lines with a key, without outer space, each key once."""
    out: dict[str, Line] = {}
    for raw in re.split(r"\r?\n", text or ""):
        k = key(raw)
        if k and k not in out:
            out[k] = Line(raw.strip(), k, frozenset(t for t in _LETTERED.findall(k) if len(t) >= 3))
    return list(out.values())


def near(a: Tokens, b: Tokens) -> bool:
    least = min(len(a), len(b))
    return least >= LEAST_TOKENS and len(a & b) >= NEAR * least


def near_sets(a: set[Tokens], b: set[Tokens]) -> set[tuple[Tokens, Tokens]]:
    """Pairs of near token sets. Of two, the smaller has a shared token among its rarest quarter and one more."""
    if not a or not b:
        return set()
    # A token that only one version has is shared by no two sets; all that need counting are those of the smaller side.
    fewer = a if len(a) < len(b) else b
    known = {t for x in fewer for t in x}
    many = Counter(t for x in (*a, *b) for t in x if t in known)
    rarest = lambda x: sorted(x, key=lambda t: (many[t], t))[: len(x) - -(-3 * len(x) // 4) + 1]
    found = set()
    for one, two, turn in ((a, b, False), (b, a, True)):
        having = defaultdict(list)
        for y in two:
            for t in y & known:
                having[t].append(y)
        for x in one:
            if len(x) >= LEAST_TOKENS:
                for y in {y for t in rarest(x) for y in having.get(t, ())}:
                    if len(y) >= len(x) and near(x, y):
                        found.add((y, x) if turn else (x, y))
    return found


def matches(a: list[Line], b: list[Line]) -> tuple[list[tuple[int, int]], set[int]]:
    """(places of lines that match, places in `b` of lines that stand in `a` in some form).

    Equal lines match. Of the others, of each two near sets of tokens the kth line with the one matches the kth with
    the other, so that lines of one pattern don't all match each other.
    """
    at = {y.key: j for j, y in enumerate(b)}
    equal = [(i, at[x.key]) for i, x in enumerate(a) if x.key in at]
    done, done_b = {i for i, _ in equal}, {j for _, j in equal}
    by_a, by_b = defaultdict(list), defaultdict(list)
    for own, left, by in ((a, done, by_a), (b, done_b, by_b)):
        for i, x in enumerate(own):
            by[x.tokens] += [i] if i not in left else []
    sets = near_sets(set(by_a), {y for y, own in by_b.items() if own})
    pairs = {p for x, y in sets for p in zip(by_a[x], by_b[y])}
    return equal + sorted(pairs), done_b | {j for _, y in sets for j in by_b[y]}


def aligned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest common subsequence: of matching places as many as rise in both versions."""
    ends: list[int] = []  # the least place in b that a chain of each length ends with
    last: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[k], last[k] = j, n
        back.append(last[k - 1] if k else -1)
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def is_fragment(line: str) -> bool:
    return 4 <= len(line) <= MOST_FRAGMENT and bool(re.match("[a-z]", line)) and line[-1] in ".?!" and not re.search("[:;]", line)


def merged(first: str | None, other: str | None, most_inserted: int = 24) -> tuple[str, int, int, int]:
    """(text, lines aligned, lines inserted, lines repaired)."""
    a, b = lines(first), lines(other)
    pairs, known = matches(a, b)
    chain = aligned(pairs)
    repaired: dict[int, Line] = {}
    whole = {j: y for j, y in enumerate(b) if j not in known}
    own = {x.key for x in a}
    used: set[int] = set()
    ending = defaultdict(list)  # lines of the other version alone, by their last word
    for j, y in enumerate(b):
        if y.key not in own:
            ending[y.key.split()[-1]].append(j)
    for i, x in enumerate(a):
        if is_fragment(x.text):
            longer = [j for j in ending[x.key.split()[-1]] if j not in used and b[j].key.endswith(f" {x.key}") and len(b[j].text) >= len(x.text) + LEAST_MORE]
            if longer:
                j = min(longer, key=lambda j: (len(b[j].text), j))
                repaired[i] = b[j]
                used.add(j)
                whole.pop(j, None)
    after: dict[int, list[Line]] = defaultdict(list)
    to, step, inserted = -1, 0, 0
    for j, y in enumerate(b):
        while step < len(chain) and chain[step][1] <= j:
            to = chain[step][0]
            step += 1
        if j in whole and inserted < most_inserted:
            after[to].append(y)
            inserted += 1
    out = [y.text for y in after[-1]]
    for i, x in enumerate(a):
        out.append(repaired[i].text if i in repaired else x.text)
        out += [y.text for y in after[i]]
    return "\n".join(out), len(chain), inserted, len(repaired)


MERGED = "struct<text:string,aligned:int,inserted:int,repaired:int>"


def merge_versions(first: Column, other: Column, most_inserted: int = 24) -> Column:
    def run(firsts: pa.Array, others: pa.Array) -> pa.Array:
        rows = [merged(a, b, most_inserted) for a, b in zip(firsts.to_pylist(), others.to_pylist(), strict=True)]
        text, *counts = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), *[pa.array(c, pa.int32()) for c in counts]], ["text", "aligned", "inserted", "repaired"])

    return F.arrow_udf(run, MERGED)(first, other)
