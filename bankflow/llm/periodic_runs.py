"""Runs of words that repeat with a period, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length at
least ``max(min_length, min_exponent * q)``, which no neighbouring word extends with that period.

Steps, for a batch of documents at once:

1. Every pair of neighbouring words in a run occurs at least twice in it. So texts are cut where a pair
   occurs once, again and again until all pairs that are left repeat inside their stretch; stretches shorter
   than ``min_length`` hold no run. Usual prose is gone after this.
2. Re-Pair: in rounds, repeated pairs of symbols are replaced by a new symbol with a rule. A round takes
   every pair that is more frequent than the pairs it overlaps with, so there are few rounds. At last the
   symbols left of a stretch are joined two by two, which gives each stretch one derivation tree.
3. For each rule, the runs that cross its boundary are looked for once, in the first place where the rule's
   text stands: a period moves the four words beside the boundary onto equal ones, on the longer side of it.
   Extensions to both sides are found by doubling over names of blocks.
4. Rules' runs are translated to all places of the derivation, and pieces of one period that overlap by a
   period or more are merged. Every run is whole at the lowest node of the derivation that contains it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import chunks, mix, packed, slices, with_fields

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SEED = 4  # words that must recur beside a boundary
LEVELS = 14  # blocks of up to 2 ** 13 words have names


def dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def pair_keys(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    return left.astype(np.int64) * n + right


def repeating_stretches(words: np.ndarray, owner: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches (step 1) of ``words``, whose owners (documents) are ascending."""
    at, stretch, before = np.arange(len(words)), owner.astype(np.int64), -1
    while len(at) and len(at) != before:
        before = len(at)
        n = int(words.max()) + 1
        joined = (np.diff(at) == 1) & (stretch[1:] == stretch[:-1])
        # Words and stretch in one key; where keys of two pairs meet, a stretch stays that could go.
        keys = mix(pair_keys(words[at[:-1]], words[at[1:]], n).view(np.uint64) + mix(stretch[1:].view(np.uint64)))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        repeated = np.zeros(len(keys), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        breaks = np.flatnonzero(~(repeated & joined)) + 1
        starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
        kept = ends - starts >= min_length
        number = np.repeat(np.arange(len(starts)), ends - starts)
        at, stretch = at[kept[number]], number[kept[number]].astype(np.int64)
    edges = np.flatnonzero((np.diff(stretch) != 0)) + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return at[np.concatenate([[0], edges])], at[np.concatenate([edges - 1, [len(at) - 1]])] + 1


class Grammar:
    """Rules of all stretches: ``left``, ``right`` and for every symbol its length and first place.

    Symbols below ``terminals`` are words. A stretch ends up as one symbol, listed in ``roots``.
    """

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        # Symbols are words of one stretch, so pairs are counted for each stretch by itself.
        symbols = dense(pair_keys(stretch, dense(words), int(words.max(initial=0)) + 1))
        self.terminals = int(symbols.max(initial=-1)) + 1
        size, place = [np.ones(self.terminals, np.int64)], [np.zeros(self.terminals, np.int64)]
        left, right, total, self.rounds = [], [], self.terminals, []
        at, repeats = np.arange(len(symbols)), True
        while True:
            if repeats:
                chosen, keys = self.choose(symbols, stretch)
                repeats = len(chosen) > 0
            if not repeats:  # no pair repeats any more: join what is left two by two
                chosen = self.neighbours(stretch)
                keys = np.arange(len(chosen))
            if not len(chosen):
                break
            _, first, rule = np.unique(keys, return_index=True, return_inverse=True)
            left.append(symbols[chosen[first]])
            right.append(symbols[chosen[first] + 1])
            lengths = np.concatenate(size)
            size.append(lengths[left[-1]] + lengths[right[-1]])
            place.append(at[chosen[first]])
            symbols[chosen] = total + rule
            self.rounds.append((total - self.terminals, total - self.terminals + len(first)))
            total += len(first)
            kept = np.ones(len(symbols), bool)
            kept[chosen + 1] = False
            symbols, stretch, at = symbols[kept], stretch[kept], at[kept]
        self.left = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.right = np.concatenate(right) if right else np.zeros(0, np.int64)
        self.size, self.place = np.concatenate(size), np.concatenate(place)
        self.roots, self.root_place = symbols, at

    @staticmethod
    def choose(symbols: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the pairs that this round replaces; no two of them overlap."""
        if len(symbols) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = int(symbols.max()) + 1
        pair = dense(pair_keys(symbols[:-1], symbols[1:], n))
        inside = stretch[1:] == stretch[:-1]
        # In a row of one symbol, pairs overlap with themselves: take every other one, from the row's start.
        twin = symbols[:-1] == symbols[1:]
        row_start = np.maximum.accumulate(np.where(twin & np.concatenate([[True], ~twin[:-1]]), np.arange(len(twin)), 0))
        odd = twin & ((np.arange(len(twin)) - row_start) % 2 == 1)
        open_pairs = inside & ~odd
        count = np.bincount(pair[open_pairs], minlength=int(pair.max()) + 1)
        rank = np.where(open_pairs & (count[pair] > 1), count[pair], 0)
        # Ties go by a mixed number of the pair, so that neighbours seldom all wait for each other.
        order = np.lexsort((mix(pair.astype(np.uint64)), rank))
        weight = np.empty(len(rank), np.int64)
        steps = np.concatenate([[False], (np.diff(rank[order]) != 0) | (np.diff(pair[order]) != 0)])
        weight[order] = np.cumsum(steps) + 1
        weight[rank == 0] = 0
        around = np.zeros(len(weight) + 2, np.int64)
        around[1:-1] = weight
        best = (weight > around[:-2]) & (weight > around[2:])
        chosen = np.flatnonzero(best)
        again = np.bincount(pair[chosen], minlength=len(count))
        chosen = chosen[again[pair[chosen]] > 1]
        return chosen, pair[chosen]

    @staticmethod
    def neighbours(stretch: np.ndarray) -> np.ndarray:
        """First of every two neighbours in a stretch, from its start."""
        if len(stretch) < 2:
            return np.zeros(0, np.int64)
        new = np.concatenate([[True], stretch[1:] != stretch[:-1]])
        number = np.arange(len(stretch)) - np.maximum.accumulate(np.where(new, np.arange(len(stretch)), 0))
        return np.flatnonzero((number[:-1] % 2 == 0) & (stretch[1:] == stretch[:-1]))


class Blocks:
    """Names of all blocks of 1, 2, 4, ... symbols: equal names, equal blocks."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [dense(symbols).astype(np.int32)]
        for level in range(1, LEVELS):
            half = 1 << (level - 1)
            if 2 * half > longest:
                break
            below = self.names[-1].astype(np.int64)
            pairs = pair_keys(below[:-half], below[half:], int(below.max(initial=0)) + 1)
            self.names.append(dense(pairs).astype(np.int32))

    def equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks at ``a`` and ``b`` are equal; false where one reaches beyond the end or start."""
        names = self.names[level]
        inside = (a >= 0) & (b >= 0) & (a < len(names)) & (b < len(names))
        found = np.zeros(len(a), bool)
        found[inside] = names[a[inside]] == names[b[inside]]
        return found

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` on are equal, ``limit`` at most; backwards, those before them."""
        length = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.names))):
            step, left = 1 << level, np.arange(len(a))
            while len(left):  # once below the highest level
                left = left[limit[left] - length[left] >= step]
                shift = length[left] if forward else -length[left] - step
                left = left[self.equal(level, a[left] + shift, b[left] + shift)]
                length[left] += step
                if level + 1 < len(self.names):
                    break
        return length


def crossing_runs(
    grammar: Grammar, blocks: Blocks, min_length: int, min_exponent: int, step: int = 2_000_000
) -> tuple[np.ndarray, ...]:
    """Rule, start in its text, length and period of the runs that cross each rule's boundary (step 3)."""
    size, place = grammar.size[grammar.terminals :], grammar.place[grammar.terminals :]
    rules = np.flatnonzero(size >= min_length)
    periods = size[rules] // min_exponent
    found = []
    for a, b in chunks(periods, step):
        rule = np.repeat(rules[a:b], periods[a:b])
        ends = np.cumsum(periods[a:b])
        period = np.arange(1, len(rule) + 1) - np.repeat(ends - periods[a:b], periods[a:b])
        start, end = place[rule], place[rule] + size[rule]
        middle = start + grammar.size[grammar.left[rule]]
        ahead = blocks.equal(2, middle, middle + period) & (middle + period + SEED <= end)
        behind = blocks.equal(2, middle - SEED, middle - period - SEED) & (middle - period - SEED >= start)
        hit = np.flatnonzero(ahead | behind)
        rule, period, start, end, middle = rule[hit], period[hit], start[hit], end[hit], middle[hit]
        # The stretch with this period around the boundary: pairs (i, i + period) from both its sides.
        low = np.maximum(middle - period, start)
        there = blocks.extension(low, low + period, end - low - period, True)
        back = blocks.extension(low, low + period, low - start, False)
        first, last = low - back, low + there + period
        # Where the pair at ``low`` does not hold, a run may still begin behind it, up to the boundary.
        late = (low + there < middle) & (middle + period < end)
        low2 = np.where(late, middle, low)
        there2 = blocks.extension(low2[late], low2[late] + period[late], (end - low2 - period)[late], True)
        back2 = blocks.extension(low2[late], low2[late] + period[late], (low2 - start)[late], False)
        for f, l, r, q, m, s in (
            (first, last, rule, period, middle, start),
            (low2[late] - back2, low2[late] + there2 + period[late], rule[late], period[late], middle[late], start[late]),
        ):
            keep = (l - f >= np.maximum(min_length, min_exponent * q)) & (f < m) & (l > m)
            found.append((r[keep], (f - s)[keep], (l - f)[keep], q[keep]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rule, start, length, period = (np.concatenate(c) for c in zip(*found))
    # A stretch has also the multiples of its smallest period.
    order = np.lexsort((period, length, start, rule))
    rule, start, length, period = rule[order], start[order], length[order], period[order]
    new = np.ones(len(rule), bool)
    new[1:] = (np.diff(rule) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    return rule[new], start[new], length[new], period[new]


def all_places(grammar: Grammar, rule: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray):
    """Runs of rules at every place where the derivation has the rule (step 4), as start, end and period."""
    terminals = grammar.terminals
    holds = np.zeros(len(grammar.size), bool)
    holds[terminals + np.unique(rule)] = True
    for a, b in grammar.rounds:  # parts come before the rules that use them
        holds[terminals + a : terminals + b] |= holds[grammar.left[a:b]] | holds[grammar.right[a:b]]
    first = np.searchsorted(rule, np.arange(len(grammar.left) + 1))
    symbol, at, found = grammar.roots, grammar.root_place, []
    while len(symbol):
        kept = holds[symbol]
        symbol, at = symbol[kept], at[kept]
        r = symbol - terminals
        count = first[r + 1] - first[r]
        which = np.repeat(first[r] + count - np.cumsum(count), count) + np.arange(count.sum())
        found.append((np.repeat(at, count) + start[which], length[which], period[which]))
        left, right = grammar.left[r], grammar.right[r]
        symbol, at = np.concatenate([left, right]), np.concatenate([at, at + grammar.size[left]])
    begin, size, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return begin, begin + size, q


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one period that overlap by a period or more are one run; ordered by start and period."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    out: list[list[int]] = []
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        if out and out[-1][2] == q and s + q <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, q])
    out.sort(key=lambda run: (run[0], run[2]))
    runs = np.array(out, np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]


def find_runs(
    words: np.ndarray, owner: np.ndarray, min_length: int = 24, min_exponent: int = 3
) -> tuple[np.ndarray, ...]:
    """Start (in ``words``), length and period of all runs; ``owner`` is ascending and bounds the texts."""
    begin, end = repeating_stretches(words, owner, min_length)
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    sizes = end - begin
    stretch = np.repeat(np.arange(len(begin)), sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) - offset[stretch] + begin[stretch]
    inner = words[at]
    grammar = Grammar(inner, stretch)
    blocks = Blocks(inner, int(sizes.max()))
    rule, start, length, period = crossing_runs(grammar, blocks, min_length, min_exponent)
    start, end, period = all_places(grammar, rule, start, length, period)
    start, length, period = merged(start, end, period)
    return at[start], length, period


class Numbers(dict):
    """A number for each distinct word of a batch."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that some run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(
    docs: DataFrame, text: str = "text", min_length: int = 24, min_exponent: int = 3
) -> DataFrame:
    """Adds to every row's ``doc`` (all input columns in one struct) its runs and its text without repeats.

    Columns: ``doc``, ``n_words``, ``runs`` (array of start, length and period in words, by start and
    period) and ``collapsed``: the words that no run contains after its first period, joined by one space.
    Words are separated by the six ASCII white space characters. ``min_exponent`` is 3 or more, ``min_length``
    at least 8 times as much (below that, four words need not recur beside a boundary).

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are judged one by one:
    repeated rows and null ids need no care, an empty table gives an empty one, and input columns of any
    name stay inside ``doc``. A text is one unit of work; memory is about 300 bytes a word of the texts that
    are handled together (two million characters, or one longer text).
    """
    if docs.schema[text].dataType.simpleString() != "string":
        raise TypeError("the text must be a string column")
    if min_exponent < 3 or min_length < 8 * min_exponent:
        raise ValueError("min_exponent is at least 3 and min_length 8 times as much")
    boxed = packed(docs)

    def scan(batches):
        for batch in batches:
            texts = batch.column(0).field(text).to_pylist()
            for a, b in slices(texts, 2_000_000):
                split = [t.encode().split() if t else [] for t in texts[a:b]]
                sizes = np.array([len(w) for w in split], np.int64)
                numbers = Numbers()
                words = np.concatenate(
                    [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split] or [np.zeros(0, np.int64)]
                )
                owner = np.repeat(np.arange(len(split)), sizes)
                runs_of: list[list[tuple[int, int, int]]] = [[] for _ in split]
                first = np.concatenate([[0], np.cumsum(sizes)])
                for s, l, q in zip(*(c.tolist() for c in find_runs(words, owner, min_length, min_exponent))):
                    doc = int(owner[s])
                    runs_of[doc].append((s - int(first[doc]), l, q))
                collapsed = []
                for w, runs in zip(split, runs_of):
                    if runs:
                        w = [x for x, keep in zip(w, kept_words(len(w), runs).tolist()) if keep]
                    collapsed.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array([[{"start": s, "length": l, "period": q} for s, l, q in r] for r in runs_of], ARROW_RUNS),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc", "n_words", "runs", "collapsed"],
                )

    return boxed.mapInArrow(scan, with_fields(boxed.schema, f"n_words long, runs array<{RUN}>, collapsed string"))


ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
