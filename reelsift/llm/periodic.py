"""Runs of repeated words, by longest common extensions on suffix trees.

Every run contains the longest Lyndon word at one of its positions, by the order of words or by the
reverse order, as one of its periods. These words are read off the order of the suffixes; each is
extended in both directions by one query to the suffix tree of the words and one to that of the words
backwards. A query is the depth of two leaves' lowest common ancestor, a range minimum over the Euler
tour. Ukkonen's construction makes the trees.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import packed, ship

OUTPUTS = ("runs", "collapsed_text")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
EXPONENT, LEAST = 4, 6  # a run has so many periods and so many words
SLICE_BYTES = 1 << 22  # texts handled at once; a longer text is handled by itself


class SuffixTree:
    """The suffixes of ``s``, a list of numbers from 1, in order, with a 0 put behind it."""

    def __init__(self, s: list[int]) -> None:
        s = [*s, 0]
        edges, depth, leaves, base = _ukkonen(s)
        keys, below = (np.fromiter(x, np.int64, len(edges)) for x in (edges.keys(), edges.values()))
        order = np.argsort(keys)
        above = keys[order] // base
        nodes = np.arange(len(depth))
        kids, first, last = below[order].tolist(), np.searchsorted(above, nodes), np.searchsorted(above, nodes, "right")
        first, last = first.tolist(), last.tolist()
        ends = set((below[keys % base == 0]).tolist())  # nodes by a 0: they come first in either order

        suffix = np.full(len(depth), -1)
        suffix[leaves] = np.arange(len(s))
        tour = np.array(_tour(kids, first, last))
        depths = np.array(depth)
        depths[leaves] = len(s) - np.arange(len(s))
        at = np.flatnonzero(suffix[tour] >= 0)
        self.rank = _inverse(suffix[tour[at]])
        self._order_back = lambda: suffix[_last_first(kids, first, last, ends)]
        self._levels = [np.minimum.reduceat(depths[tour], at)[:-1].astype(np.int32)]  # least depth between leaves
        while (half := 1 << (len(self._levels) - 1)) * 2 <= len(self._levels[0]):
            self._levels.append(np.minimum(self._levels[-1][:-half], self._levels[-1][half:]))

    def back_rank(self) -> np.ndarray:
        """Ranks of the suffixes by the reverse order of numbers, shorter ones still first."""
        return _inverse(self._order_back())

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``i`` and at ``j`` (another) agree."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = np.minimum(self._levels[k][low[of]], self._levels[k][high[of] - (1 << k)])
        return out


def _inverse(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _ukkonen(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Children by ``node * base + symbol``, depths of inner nodes, leaves in the order of suffixes."""
    base, n = max(s) + 1, len(s)
    edges: dict[int, int] = {}
    begin, end, depth, link, leaves = [0], [0], [0], [0], []
    node = edge = length = waiting = 0
    for i, symbol in enumerate(s):
        unlinked = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * base + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = at = len(begin)
            else:
                size = min(end[child], i + 1) - begin[child]
                if length >= size:
                    node, edge, length = child, edge + size, length - size
                    continue
                if s[begin[child] + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                edges[key] = cut = len(begin)
                begin.append(begin[child])
                end.append(begin[child] + length)
                depth.append(depth[node] + length)
                link.append(0)
                begin[child] += length
                edges[cut * base + s[begin[child]]] = child
                edges[cut * base + symbol] = at = cut + 1
            leaves.append(at)
            begin.append(i)
            end.append(n)
            depth.append(0)
            link.append(0)
            of = node if child is None else cut
            if unlinked:
                link[unlinked] = of
            unlinked = of
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return edges, depth, leaves, base


def _tour(kids: list[int], first: list[int], last: list[int]) -> list[int]:
    """Nodes as they are entered and come back to, children in order."""
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        if node < 0:
            out.append(~node)
            continue
        out.append(node)
        for k in range(last[node] - 1, first[node] - 1, -1):
            stack.append(~node)
            stack.append(kids[k])
    return out


def _last_first(kids: list[int], first: list[int], last: list[int], ends: set[int]) -> list[int]:
    """Leaves, children in reverse order but for those by a 0."""
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        a, b = first[node], last[node]
        if a == b:
            out.append(node)
        elif kids[a] in ends:
            stack.extend(kids[a + 1 : b])
            stack.append(kids[a])
        else:
            stack.extend(kids[a:b])
    return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank: where its longest Lyndon word ends."""
    values = rank.tolist()
    out, stack = [0] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out[:-1])


def runs_of(s: list[int], exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """``start, length, period`` of the runs in ``s``, numbers from 1, by start and period."""
    n = len(s)
    ahead, behind = SuffixTree(s), SuffixTree(s[::-1])
    i, found = np.arange(n), []
    for rank in (ahead.rank, ahead.back_rank()):
        j = _next_smaller(rank)
        left, right = behind.common(n - i, n - j), ahead.common(i, j)
        run = np.stack([i - left, left + (j - i) + right, j - i], axis=1)
        found.append(run[run[:, 1] >= np.maximum(least, exponent * run[:, 2])])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort([out[:, 2], out[:, 0]])]


def stretches(text: np.ndarray, word: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that a run can hold, and the stretch each is in.

    A run has each of its words ``exponent`` times. So a word that its stretch has less often ends
    it, and what is left on either side is looked at anew, until nothing changes.
    """
    at, of = np.arange(len(word)), text
    while len(at):
        _, back, times = np.unique(of * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        keep = times[back] >= exponent
        left, was = at[keep], of[keep]
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) != 1) | (was[1:] != was[:-1])
        parts = np.cumsum(new) - 1
        long = np.bincount(parts)[parts] >= least if len(parts) else np.zeros(0, bool)
        done = len(at) == long.sum()
        at, of = left[long], parts[long]
        if done:
            break
    return at, of


def _of_texts(texts: list[bytes], exponent: int, least: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed texts."""
    words = [t.split() for t in texts]  # bytes split at the six blanks alone
    sizes = np.array([len(w) for w in words])
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    code = np.fromiter((number[x] for w in words for x in w), np.int64, sizes.sum())
    text = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    found = defaultdict(list)
    at, of = stretches(text, code, exponent, least)
    for piece in np.split(at, np.flatnonzero(np.diff(of)) + 1) if len(at) else ():
        runs = runs_of((np.unique(code[piece], return_inverse=True)[1] + 1).tolist(), exponent, least)
        if len(runs):
            of_text = int(text[piece[0]])
            found[of_text].append(runs + [int(piece[0] - begins[of_text]), 0, 0])
    none, runs, collapsed = np.zeros((0, 3), np.int64), [], []
    for k, w in enumerate(words):
        own = np.concatenate(found[k]) if k in found else none
        if len(own):
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            w = list(compress(w, (np.cumsum(change)[:-1] == 0).tolist()))
        runs.append(own)
        collapsed.append(b" ".join(w))
    return runs, collapsed


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _column(runs: list[np.ndarray], collapsed: list[bytes]) -> pa.StructArray:
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(offsets), each)
    return pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.binary()).view(pa.string())], list(OUTPUTS))


def periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed_text``.

    A run is a stretch of consecutive words with smallest period q, of ``least`` and ``exponent * q`` words
    at least, that no neighbouring word extends. ``runs`` has ``start`` (a word's number), ``length`` and
    ``period``, by start and period. ``collapsed_text`` has the words joined by one blank, without those
    that any run contains after its first period. ``exponent`` is 2 or more.

    Each row is judged by itself, in memory that grows with its longest stretch of repeated words.
    Null and empty texts have no run and an empty collapsed text. Repeated rows stay, empty tables give
    empty results, and input columns named like an output give way to it.
    """
    ship(docs.sparkSession)

    def judge(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for part in _slices([t or b"" for t in texts.cast(pa.binary()).to_pylist()]):
            r, c = _of_texts(part, exponent, least)
            runs += r
            collapsed += c
        return _column(runs, collapsed)

    judged = F.arrow_udf(judge, f"runs array<{RUN}>, collapsed_text string")
    rows = packed(docs, OUTPUTS, _text=text_col)
    return rows.withColumn("_found", judged(F.col("_text").cast("string"))).select("_row.*", "_found.*")
