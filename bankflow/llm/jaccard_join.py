"""Near-duplicate documents by an exact n-gram Jaccard join over count vectors in R-trees.

Shingles are hashed into groups. The counts of a document's groups are a point; the overlap of two
documents is at most the sum of the smaller counts, and that of two boxes of points at most the sum of the
smaller upper bounds. R-trees over the points are joined by this bound, first without texts: the points alone
leave out the documents that no other document of their block can be linked with. Pairs that survive are
verified on the shingles.

No tree holds the whole corpus. Documents meet in a block only if a whole group of shingles is equal: two
linked documents differ in fewer shingles than there are groups, so one group at least is untouched. The
number of groups follows the document's size class, and a document is dealt to every class below its own in which a
linked one may be.
Blocks are named after their smallest document, so copies of one text share few blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankflow.llm.common import MASK, WordHashes, ascii_words, mix, slices, stage
from bankflow.llm.components import components

CLASS_STEP = 1.6
SEEDS = 8
BLOCK_DOCS = 1_500
GROUP_DOCS = 150
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram."""

    def __init__(self, width: int):
        self.width = width
        self.hashes = WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = ascii_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        h = self.hashes.of(words)
        width = min(self.width, len(words))
        value = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            value = mix(value * C1 + h[k : len(h) - width + k + 1])
        return np.unique(value)


def set_name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Signatures:
    """Keys of a set's groups such that linked sets share at least one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]

    def most_different(self, n: int) -> int:
        """Shingles by which a set may differ from a linked one if the smaller has n."""
        return (100 - self.percent) * n // self.percent

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(np.ceil(self.bounds[-1] * CLASS_STEP))))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def of(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if not n:
            return np.zeros(0, np.int64)
        c = self.size_class(n)
        keys = [self.in_class(shingles, c, self.most_different(n))]
        while c and 100 * (self.bounds[c] - 1) >= self.percent * n:  # a linked smaller set may be in a class below
            c -= 1
            keys.append(self.in_class(shingles, c, self.most_different(n)))
        return np.concatenate(keys)

    def in_class(self, shingles: np.ndarray, c: int, different: int) -> np.ndarray:
        """Keys of the groups that have shingles.

        If as many groups are empty as may be equal, the equal one could be empty; then the set is dealt out
        again with another seed, and after the last seed the empty groups get keys too. A pair is found where
        either set has enough filled groups.
        """
        groups = self.most_different(self.bounds[c + 1] - 1) + 1
        different = min(different, groups - 1)
        out = []
        for seed in range(SEEDS):
            g = (mix(shingles + np.uint64(seed * int(C2) & MASK)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            filled, first = np.unique(g[order], return_index=True)
            sums = np.add.reduceat(mix(shingles ^ C3)[order], first)
            salt = np.uint64((c * SEEDS + seed) * int(C1) & MASK)
            out.append(mix(sums + filled.astype(np.uint64) * C2 + salt))
            if groups - len(filled) < groups - different:
                break
        else:
            empty = np.setdiff1d(np.arange(groups), filled).astype(np.uint64)
            out.append(mix(empty * C2 + salt))
        return (np.concatenate(out) >> np.uint64(16)).astype(np.int64)  # 48 bits: a key only proposes pairs


def needed(a, b, percent: int):
    """Smallest overlap with which sets of a and b shingles are linked."""
    return -(-percent * (a + b) // (100 + percent))


class Box:
    """Node of an R-tree: bounds of its points, its smallest set and its rows or children."""

    __slots__ = ("high", "least", "rows", "children")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, leaf: int):
        self.high = points[rows].max(axis=0)
        self.least = int(sizes[rows].min())
        self.rows, self.children = rows, []
        if len(rows) > leaf:
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            axis = int(spread.argmax())
            by = sizes[rows] if np.ptp(sizes[rows]) >= spread[axis] else points[rows, axis]
            parts = np.array_split(rows[np.argsort(by, kind="stable")], 4)
            self.children = [Box(points, sizes, p, leaf) for p in parts]


class Forest:
    """Union-find with whole-array labels; the smallest id of a component is its root."""

    def __init__(self, ids: np.ndarray):
        self.label = ids.copy()

    def unite(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


def group_count(n: int) -> int:
    """Number of groups for n shingles: a power of two, about four shingles a group."""
    return 1 << int(np.clip(np.ceil(np.log2(max(1, n) / 4)), 5, 12))


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(64 - int(np.log2(groups)))).astype(np.int64), minlength=groups)


def packed_counts(shingles: np.ndarray) -> bytes:
    """A set's count vector in one byte a group, or four where a count is beyond 255."""
    counts = count_vector(shingles, group_count(len(shingles)))
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def unpacked_counts(packed: bytes, n: int, groups: int) -> np.ndarray:
    """Count vector of a set of n shingles, added up to ``groups`` groups."""
    own = group_count(n)
    counts = np.frombuffer(packed, np.uint8 if len(packed) == own else np.uint32)
    return counts.reshape(groups, -1).sum(axis=1)


def open_leaves(points: np.ndarray, sizes: np.ndarray, percent: int, settled, leaf: int = 16):
    """R-tree self-join by summed minima: rows of two leaves and which of their pairs may be linked.

    Boxes for whose rows ``settled(rows, others)`` holds are passed over.
    """
    root = Box(points, sizes, np.arange(len(sizes)), leaf)
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if np.minimum(a.high, b.high).sum() < needed(a.least, b.least, percent) or settled(a.rows, b.rows):
            continue
        if a.children or b.children:
            if a is b:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            elif len(a.rows) >= len(b.rows) and a.children:
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, y) for y in b.children]
            continue
        most = np.minimum(points[a.rows][:, None, :], points[b.rows][None, :, :]).sum(axis=2)
        yield a.rows, b.rows, most >= needed(sizes[a.rows][:, None], sizes[b.rows][None, :], percent)


def join_sets(sets: list[np.ndarray], forest: Forest, percent: int) -> None:
    """Unite all linked sets: the pairs that the R-tree leaves open are verified."""
    sizes = np.array([len(s) for s in sets])
    groups = group_count(sizes.max())
    points = np.zeros((len(sets), groups), np.int32)
    for i, s in enumerate(sets):
        points[i] = count_vector(s, groups)

    def settled(rows, others):
        label = forest.label[rows[0]]
        return (forest.label[rows] == label).all() and (forest.label[others] == label).all()

    for rows, others, may in open_leaves(points, sizes, percent, settled):
        may &= forest.label[rows][:, None] != forest.label[others][None, :]
        for x, y in zip(*np.nonzero(may)):
            i, j = int(rows[x]), int(others[y])
            if forest.label[i] == forest.label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.unite(i, j)


def block_partners(table: pa.Table, percent: int) -> pa.Table:
    """Members that the summed minima leave a partner in their block."""
    hubs, ids, sizes = (np.array(table[c].to_pylist(), np.int64) for c in ("hub", "id", "n"))
    packed = table["counts"]
    out = []
    order = np.argsort(hubs, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
        n = sizes[rows]
        groups = group_count(n.min())
        points = np.zeros((len(rows), groups), np.int32)
        for i, r in enumerate(rows):
            points[i] = unpacked_counts(packed[int(r)].as_py(), int(n[i]), groups)
        found = np.zeros(len(rows), bool)
        for a, b, may in open_leaves(points, n, percent, lambda a, b: found[a].all() and found[b].all()):
            may &= a[:, None] != b[None, :]
            found[a] |= may.any(axis=1)
            found[b] |= may.any(axis=0)
        out.append(rows[found])
    kept = np.concatenate(out)
    return pa.table({"id": pa.array(ids[kept], pa.int64()), "hub": pa.array(hubs[kept], pa.int64())})


def block_links(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Root of every document within each block of one group; ``linked`` rows start as one component."""
    shingler = Shingler(width)
    hubs = np.array(table["hub"].to_pylist(), np.int64)
    ids = np.array(table["id"].to_pylist(), np.int64)
    linked = np.array(table["linked"].to_pylist(), bool)
    texts = table["text"]
    out: list[tuple] = []
    order = np.argsort(hubs, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(hubs[order])) + 1):
        own = ids[rows].copy()
        own[linked[rows]] = hubs[rows[0]]
        forest = Forest(own)
        join_sets([shingler.of(texts[int(r)].as_py()) for r in rows], forest, percent)
        out += zip(hubs[rows].tolist(), ids[rows].tolist(), forest.label.tolist())
    return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("hub", "id", "root"))})


def with_partners(members: DataFrame, vectors: DataFrame, percent: int, block_docs: int) -> DataFrame:
    """``members`` (``id, hub``) without those that no other member of their block can be linked with.

    ``vectors`` has ``id, n, counts``; no text is read. Blocks over ``block_docs`` documents stay whole.
    """
    sized = members.join(members.groupBy("hub").agg(F.count("*").alias("size")), "hub")
    groups = max(1, members.count() // GROUP_DOCS)
    small = sized.where(F.col("size") <= block_docs).withColumn("group", F.pmod(F.xxhash64("hub"), F.lit(groups)))
    rows = vectors.join(small.hint("merge"), "id").select("group", "hub", "id", "n", "counts")
    kept = rows.groupBy("group").applyInArrow(lambda table: block_partners(table, percent), "id long, hub long")
    return kept.distinct().unionByName(sized.where(F.col("size") > block_docs).select("id", "hub"))


def links_between(docs: DataFrame, members: DataFrame, width: int, percent: int, block_docs: int) -> DataFrame:
    """Edges ``a, b`` that connect all linked documents of the blocks in ``members`` (``id, hub``).

    Small blocks share a group. A larger block is split: every part has the block's smallest document and is
    joined by itself; documents that this leaves apart from the smallest one are then joined with all other
    parts, part by part. So no group grows with a block.
    """
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"))
    groups = max(1, members.count() // GROUP_DOCS)
    parts = F.ceil(F.col("size") / block_docs).cast("int")
    sized = members.join(sizes, "hub").withColumn("parts", parts)
    own_part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = sized.withColumn(
        "part",
        F.explode(
            F.when(F.col("parts") == 1, F.array(F.lit(-1)))
            .when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1))
            .otherwise(F.array(own_part))
        ),
    ).withColumn(
        "group", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("hub"), F.lit(groups))).otherwise(F.col("hub"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = stage(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "open-texts")
    rows = texts.join(placed.hint("merge"), "id").withColumn("linked", F.lit(False))
    columns = ["group", "part", "other", "hub", "id", "linked", "text"]
    schema = "hub long, id long, root long"

    def joined(df: DataFrame) -> DataFrame:
        return df.select(*columns).groupBy("group", "part", "other").applyInArrow(
            lambda table: block_links(table, width, percent), schema
        )

    first = stage(joined(rows.withColumn("other", F.lit(-1))), "block-links")
    edges = first.select(F.col("id").alias("a"), F.col("root").alias("b"))
    split = placed.where(F.col("parts") > 1).select("hub", "id", "parts").distinct()
    roots = first.groupBy("hub", "id").agg(F.min("root").alias("root"))
    after = split.join(roots, ["hub", "id"]).withColumn("linked", F.col("root") == F.col("hub"))
    apart = after.where(~F.col("linked"))
    if apart.isEmpty():
        return edges
    many = apart.groupBy("hub").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("others"))
    spread = after.join(many, "hub")
    own_other = F.pmod(F.xxhash64("id", F.lit(1)), F.col("others")).cast("int")
    as_member = spread.withColumn("part", own_part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    )
    as_other = (
        spread.where(~F.col("linked"))
        .withColumn("other", own_other)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    pairs = as_member.unionByName(as_other).dropDuplicates(["hub", "id", "part", "other"])
    second = joined(texts.join(pairs.withColumn("group", F.col("hub")).hint("merge"), "id"))
    return edges.unionByName(second.select(F.col("id").alias("a"), F.col("root").alias("b")))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; the join is exact.

    A document's set are its distinct ``width``-word shingles, A-Z lower-cased; a shorter text is one shingle.
    Two documents are linked when ``100 * |intersection| >= percent * |union|``; ``component_id`` is the smallest
    id reachable by links. Texts without words (null, empty) have no shingles and only themselves. Rows that
    share an id count as one document. Rows without an id join the component of equal texts, else their
    ``component_id`` is null; they link nothing themselves. An empty table gives an empty result. Ids are
    integers; other columns are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def summarise(batches):
        shingler = Shingler(width)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = [shingler.of(t) for t in texts[a:b]]
                arrays = [
                    ids.slice(a, b - a),
                    pa.array([set_name(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([packed_counts(s) for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "set", "n", "counts"])

    def sign(batches):
        shingler, signatures = Shingler(width), Signatures(percent)
        for batch in batches:
            ids, names = batch.column(0), batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                found = []
                for name, text in zip(names[a:b], texts[a:b]):
                    own = shingler.of(text)
                    # Rows that share an id may have other texts than the one asked for.
                    found.append(signatures.of(own) if set_name(own) == name else np.zeros(0, np.int64))
                ends = np.cumsum([0] + [len(f) for f in found])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), keys], names=["doc_id", "keys"])

    sets = stage(rows.mapInArrow(summarise, "doc_id long, set binary, n long, counts binary"), "sets")
    classes = sets.where(F.col("n") > 0).groupBy("set").agg(F.min("doc_id").alias("rep"))
    # One text of each set is shuffled, not the many keys of every document.
    asked = classes.select(F.col("rep").alias("doc_id"), F.col("set").alias("own"))
    once = rows.join(asked.hint("merge"), "doc_id").select("doc_id", "own", "text")
    once = once.mapInArrow(sign, "doc_id long, keys array<long>")
    dealt = once.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    same = W.partitionBy("key")
    met = dealt.select("id", F.min("id").over(same).alias("hub"), F.max("id").over(same).alias("top"))
    members = stage(met.where(F.col("hub") < F.col("top")).select("id", "hub").distinct(), "blocks")
    vectors = sets.where(F.col("n") > 0).select(F.col("doc_id").alias("id"), "n", "counts")
    open_members = stage(with_partners(members, vectors, percent, block_docs), "open-blocks")
    roots = components(links_between(rows, open_members, width, percent, block_docs))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("set").alias("own"), F.coalesce("root", "rep").alias("component_id")
    )
    result = sets.join(named, F.col("set") == F.col("own"), "left")
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
