"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

Smoothing is Dirichlet: ``P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu)`` with ``h'`` the history without its
first word and add-one unigrams at the bottom. Histories are states. A state has an arc for every word seen
after it and one failure arc, weighted ``mu / (c(h) + mu)``, to the state of the shorter history. A text is
read once from left to right; the state is carried along and log-probabilities are added up.

Counts cover the whole corpus and are never gathered: documents are dealt to blocks of bounded text, each
block asks for the counts of its own n-grams only (packed by hash range, summed over all blocks, sent back)
and builds the part of the automaton that its documents can reach. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import ascii_words, mix, stage, text_bytes, whole_text

BLOCK_BYTES = 8 << 20
SEGMENT = 256
END, START = 0, 1
COUNTS = "part int, block int, is_word boolean, keys binary, counts binary"
TOTALS = "block int, part int, is_word boolean, totals binary, types long, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def planes(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers: leading zero bytes lie together and compress away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


class Grams:
    """N-grams of a block's texts: per level distinct n-grams with hash, prefix, last token and a place."""

    def __init__(self, texts: list[str | None], order: int):
        ids: dict[bytes, int] = {}
        arrays, lengths = [], []
        for text in texts:
            words = ascii_words(text)
            row = np.empty(len(words) + 2, np.int64)
            row[0], row[-1] = START, END
            row[1:-1] = [ids.setdefault(w, len(ids) + 2) for w in words]
            arrays.append(row)
            lengths.append(len(row))
        self.tokens = np.concatenate(arrays)
        self.lengths = np.array(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        inside = np.arange(len(self.tokens)) - self.starts[self.doc]
        names = [b" end", b" start", *ids]  # words hold no space
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        self.size = len(names)
        self.grams = [self.tokens]  # by level: the n-gram that ends at each place, -1 if there is none
        self.hash, self.prefix, self.last, self.place = [hashes], [None], [np.arange(len(names))], [None]
        for k in range(2, order + 1):
            at = np.flatnonzero(inside >= k - 1)
            codes = self.grams[-1][at - 1] * self.size + self.tokens[at]
            unique, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
            level = np.full(len(self.tokens), -1, np.int64)
            level[at] = inverse
            self.grams.append(level)
            self.prefix.append(unique // self.size)
            self.last.append(unique % self.size)
            self.place.append(at[first])
            self.hash.append(
                mix(self.hash[-1][self.prefix[-1]] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.last[-1]])
            )

    def questions(self) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        """Whether they are tokens, sorted distinct hashes, and for each n-gram its place among them."""
        words = np.delete(self.hash[0], START)
        rest = np.concatenate([self.hash[0][[START]], *self.hash[1:]])
        return [(flag, *np.unique(h, return_inverse=True)) for flag, h in ((True, words), (False, rest))]

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Occurrences in training texts by question list, in n-gram order."""
        used = train[self.doc]
        found = []
        for level, hashes in zip(self.grams, self.hash):
            ok = used & (level >= 0)
            found.append(np.bincount(level[ok], minlength=len(hashes)))
        return [np.delete(found[0], START), np.concatenate([found[0][[START]], *found[1:]])]

    def by_level(self, words: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """Totals in n-gram order back to one array a level."""
        first = np.insert(words, START, rest[0])
        sizes = [len(h) for h in self.hash[1:]]
        return [first, *np.split(rest[1:], np.cumsum(sizes)[:-1])] if sizes else [first]


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, mu: float):
        order = len(counts)
        self.size = grams.size
        self.unknown = -np.log10(tokens + types + 1.0)
        base = np.cumsum([1] + [len(h) for h in grams.hash[:-1]])  # first state of each level; 0 is the root
        states = int(base[-1]) if order > 1 else 1
        self.fail = np.zeros(states, np.int64)
        self.fail_weight = np.zeros(states)
        keys, weights, targets = [], [], []
        lower = (counts[0] + 1.0) / (tokens + types + 1.0)
        for k in range(1, order + 1):
            c = counts[k - 1]
            seen = c > 0
            if k == 1:
                p, source, suffix = lower, np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                seen = seen & (np.arange(len(c)) != START)
            else:
                shorter = grams.grams[k - 2][grams.place[k - 1]]
                history = counts[k - 2][grams.prefix[k - 1]]
                p = (c + mu * lower[shorter]) / (history + mu)
                source, suffix = base[k - 2] + grams.prefix[k - 1], base[k - 2] + shorter
            if k < order:
                own = base[k - 1] + np.arange(len(c))
                self.fail[own] = suffix if k > 1 else 0
                self.fail_weight[own] = np.log10(mu / (c + mu))
                target = own
            else:
                target = suffix if k > 1 else np.zeros(len(c), np.int64)
            keys.append((source * self.size + grams.last[k - 1])[seen])
            weights.append(np.log10(p[seen]))
            targets.append(target[seen])
            lower = p
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        self.keys = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.weights = np.append(np.concatenate(weights)[by_key], 0.0)
        self.targets = np.append(np.concatenate(targets)[by_key], 0)
        self.start = int(base[0]) + START if order > 1 and counts[0][START] > 0 else 0

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and log10 probability of one token for many texts."""
        gained = np.zeros(len(state))
        state = state.copy()
        left = np.arange(len(state))
        while len(left):
            wanted = state[left] * self.size + token[left]
            at = np.searchsorted(self.keys, wanted)
            hit = self.keys[at] == wanted
            done = left[hit]
            gained[done] += self.weights[at[hit]]
            state[done] = self.targets[at[hit]]
            left = left[~hit]
            lost = state[left] == 0
            gained[left[lost]] += self.unknown
            left = left[~lost]
            gained[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return state, gained


def traverse(grams: Grams, automaton: Automaton, order: int) -> np.ndarray:
    """Log10 probability of each text.

    All texts are read side by side. A long text is read in segments; as a state depends on the last
    ``order - 1`` tokens only, a segment first reads those from the root and then continues in the same state.
    """
    n = grams.lengths - 1  # tokens after the start
    pieces = np.maximum(1, -(-n // SEGMENT))
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = grams.starts[doc] + 1 + piece * SEGMENT
    stop = np.minimum(begin + SEGMENT, grams.starts[doc] + 1 + n[doc])
    warm = np.where(piece > 0, order - 1, 0)
    state = np.where(piece > 0, 0, automaton.start)
    total = np.zeros(len(doc))
    by_length = np.argsort(-(stop - begin), kind="stable")
    longest = int((stop - begin).max())
    for t in range(order - 1):
        on = np.flatnonzero(warm > 0)
        if len(on):
            state[on], _ = automaton.read(state[on], grams.tokens[begin[on] - (order - 1) + t])
    sizes = (stop - begin)[by_length]
    for t in range(longest):
        on = by_length[: np.searchsorted(-sizes, -t, side="left")]
        state[on], gained = automaton.read(state[on], grams.tokens[begin[on] + t])
        total[on] += gained
    return np.bincount(doc, weights=total, minlength=len(n))


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = 2,
    mu: float = 100.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Score of every row under a model learnt from the rows where ``held_out`` is not true.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are words
    (A-Z lower-cased) and one end a text; null texts are empty and have the end alone. ``base_score`` is the
    add-one unigram score. ``n_known`` counts tokens seen in training. Null ids are kept, and a null
    ``held_out`` counts as training. Repeated rows count and are scored as often as they stand there. An
    empty table gives an empty result; without training rows every token is unknown. Other columns are left
    out. Ids are integers.
    """
    blocks = max(1, -(-text_bytes(docs, text) // block_bytes))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        whole_text(F.col(text)).alias("text"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    parts = blocks

    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table["text"].to_pylist(), order)
        train = ~np.array(table["held_out"].to_pylist(), bool)
        out = []
        for (flag, keys, inverse), found in zip(grams.questions(), grams.counts(train)):
            counts = np.bincount(inverse, weights=found, minlength=len(keys)).astype(np.uint32)
            part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    out.append((k, flag, pack_keys(keys[a:b]), planes(counts[a:b])))
        block = table["block"][0].as_py()
        return pa.table(
            {
                "part": pa.array([o[0] for o in out], pa.int32()),
                "block": pa.array([block] * len(out), pa.int32()),
                "is_word": pa.array([o[1] for o in out], pa.bool_()),
                "keys": pa.array([o[2] for o in out], pa.binary()),
                "counts": pa.array([o[3] for o in out], pa.binary()),
            }
        )

    def add_up(table: pa.Table) -> pa.Table:
        out = []
        for flag in (True, False):
            asked = table.filter(pc.equal(table["is_word"], flag))
            if not len(asked):
                continue
            keys = [unpack_keys(k) for k in asked["keys"].to_pylist()]
            counts = np.concatenate([unplanes(c, np.uint32) for c in asked["counts"].to_pylist()])
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.uint64)
            answers = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
            own = [(int((totals > 0).sum()), int(totals.sum()))] if flag else [(0, 0)]
            for block, answer, (types, tokens) in zip(
                asked["block"].to_pylist(), answers, own + [(0, 0)] * len(answers)
            ):
                out.append((block, asked["part"][0].as_py(), flag, planes(answer), types, tokens))
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
        names = ("block", "part", "is_word", "totals", "types", "tokens")
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    asked = rows.groupBy("block").applyInArrow(ask, COUNTS)
    totals = stage(asked.groupBy("part").applyInArrow(add_up, TOTALS), "ngrams")
    sums = totals.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, tokens = int(sums["types"] or 0), int(sums["tokens"] or 0)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({f.name: pa.array([], f.type) for f in SCORE_SCHEMA})
        grams = Grams(texts["text"].to_pylist(), order)
        found = []
        for flag, _, inverse in grams.questions():
            own = answers.filter(pc.equal(answers["is_word"], flag)).sort_by("part")
            sent = [unplanes(t, np.uint64) for t in own["totals"].to_pylist()]
            found.append(np.concatenate(sent).astype(np.int64)[inverse])
        counts = grams.by_level(*found)
        result = traverse(grams, Automaton(grams, counts, tokens, types, mu), order)
        real = grams.tokens != START
        each = counts[0][grams.tokens]
        base = np.where(real, np.log10((each + 1.0) / (tokens + types + 1.0)), 0.0)
        n = len(texts)
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": pa.array(grams.lengths - 1, pa.int64()),
                "n_known": pa.array(
                    np.bincount(grams.doc[real & (each > 0)], minlength=n).astype(np.int64), pa.int64()
                ),
                "base_score": pa.array(np.bincount(grams.doc, weights=base, minlength=n), pa.float64()),
                "score": pa.array(result, pa.float64()),
            },
            schema=SCORE_SCHEMA,
        )

    scored = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


SCORE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base_score", pa.float64()), ("score", pa.float64())]
)
