"""Near duplicates by a MinHash LSH forest, verified exactly.

Equal texts are one node. A node's shingles are its windows of ``SHINGLE`` words
(a shorter text: all its words). Each of ``TREES`` tries orders the nodes by a
label of ``DEPTH`` min-hash symbols, eight bits each.

(1) The labels of every trie are sorted over the cluster; how many labels share a
prefix with one, at each depth, shows in the sorted order. (2) Each node starts
from whole labels in all tries and shortens prefixes, first where that brings the
fewest nodes near, until two texts at the threshold meet in one of its prefixes
with probability ``RECALL``. (3) In the sorted order the subtree under each
shortened prefix is marked; the topmost marked ones are the groups of candidates,
and those of equal members are one. (4) Within a group, in tiles of bounded size,
whole signatures are compared; texts that look at least ``LOOKALIKE`` alike (well
under the threshold, see ``LOOKALIKE``) are joined into provisional classes. (5)
These are cut into tiles, in which shingle sets are intersected exactly. Links
count and join classes; classes are the connected components of verified links,
named by their smallest id.

No pair of rows is ever emitted: a tile sends counts and stars. A text goes once to
each of its class's tile columns. A sorted partition that a subtree spans offers
the subtree at every depth, so groups do not depend on where partitions end.

Defined cases: null and wordless texts are alone in their class, without links;
rows without id get a null class and no links; equal rows link like any copies;
an id that repeats with different texts gathers the links of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import discard, few_samples, materialise, salted_firsts, spread
from tabularium.llm.textkernel import FIXED_KEY, U, draw_key, hash_windows, hash_words, mix, row_batches, split_words, text_bytes, window_starts

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction, so that the comparison is exact
TREES, DEPTH, LEAST_DEPTH, RECALL = 20, 8, 3, 0.999
#: Share of equal symbols below which two signatures are not verified. Of texts at the threshold, fewer than one pair in
#: ten million falls below it by chance (160 symbols; Chernoff's bound).
LOOKALIKE = 0.6
TILE, GROUP_TILE = 256, 1024
SORTED_ROWS = 1_000_000  # labels in a sorted partition, about


def weight(depth: int, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """What a prefix adds to minus the logarithm of the chance to miss a text of this similarity."""
    return -math.log1p(-(similarity**depth))


def chosen_depths(codes: np.ndarray, trees: int = TREES, recall: float = RECALL) -> np.ndarray:
    """The depth of each node's prefix in each trie.

    ``codes[i, t, k]`` tells how many labels share the first ``LEAST_DEPTH + k`` symbols (on a growing scale, 0: no
    other). Steps towards the root are taken in order of what they bring near, until the recall holds.
    """
    n, wide = len(codes), DEPTH - LEAST_DEPTH
    gains = np.array([weight(LEAST_DEPTH + k) - weight(LEAST_DEPTH + k + 1) for k in range(wide)])
    steps = codes[:, :, :wide].astype(np.int64) * DEPTH + (wide - 1 - np.arange(wide))  # ties: longer prefixes first
    order = np.argsort(steps.reshape(n, -1), axis=1, kind="stable")
    have = trees * weight(DEPTH) + np.cumsum(np.tile(gains, trees)[order], axis=1)
    before = np.concatenate([np.full((n, 1), trees * weight(DEPTH)), have[:, :-1]], axis=1)
    taken = np.zeros((n, trees * wide), bool)
    np.put_along_axis(taken, order, before < -math.log1p(-recall), axis=1)
    return DEPTH - taken.reshape(n, trees, wide).sum(2)


def crowd(size: np.ndarray) -> np.ndarray:
    """A byte that grows with the logarithm of a count; 0 for one."""
    return np.minimum(np.floor(6 * np.log2(np.maximum(size, 1))), 255).astype(np.uint8)


def subtree_starts(labels: np.ndarray, depth: int) -> np.ndarray:
    """Where in sorted labels each subtree at a depth begins."""
    top = labels >> np.int64(8 * (DEPTH - depth))
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(top)), bool), top[1:] != top[:-1]]))


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE, key: bytes = FIXED_KEY) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, in order of rows; a text of fewer words has one, of all its words."""
    s, e, row = split_words(data, bounds)
    words = hash_words(data, s, e, key)
    at = window_starts(row, width)
    hashes, rows = hash_windows(words, at, width), row[at]
    sizes = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        first = np.cumsum(sizes) - sizes
        extra = np.array([int(hash_windows(words[first[r] : first[r] + sizes[r]], np.zeros(1, np.int64), int(sizes[r]))[0]) for r in short], U)
        extra = mix(extra ^ sizes[short].astype(U))
        hashes, rows = np.concatenate([hashes, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def labels_of(hashes: np.ndarray, rows: np.ndarray, n: int, trees: int) -> np.ndarray:
    """For each row and trie its ``DEPTH`` symbols, the first in the highest byte; rows without shingles get garbage."""
    full = np.unique(rows)
    first = np.searchsorted(rows, full)
    salt = mix(np.arange(1, 2 * trees * DEPTH + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    out = np.zeros((n, trees), U)
    for t in range(trees):
        label = np.zeros(len(full), U)
        for k in range(t * DEPTH, (t + 1) * DEPTH):
            a, b = salt[2 * k], salt[2 * k + 1]
            low = np.minimum.reduceat((hashes ^ b) * (a << U(1) | U(1)), first) if len(full) else np.empty(0, U)
            label = label << U(8) | mix(low) >> U(56)
        out[full, t] = label
    return out


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, labels`` for every row; ``labels`` is null where there are no shingles."""
    import hashlib

    schema = "doc_id bigint, text_key binary, n_shingles int, labels array<bigint>"

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            counts, labels = [np.empty(0, np.int64)], [np.empty((0, trees), U)]
            for i, j in row_batches(bounds):
                h, r = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                counts.append(np.bincount(r, minlength=j - i))
                labels.append(labels_of(h, r, j - i, trees))
            n, label = np.concatenate(counts), np.concatenate(labels).view(np.int64)
            keys = [hashlib.sha256(data[s:e]).digest()[:16] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * trees, pa.int32()), pa.array(label.ravel()), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), lists], names=["doc_id", "text_key", "n_shingles", "labels"])

    return spread(docs.select("doc_id", "text")).mapInArrow(signed, schema)


def _partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a sorted partition; its size is bounded, as ranges are of the whole row."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _tries(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one trie."""
    tree = table.column("tree").to_numpy()
    cut = np.flatnonzero(np.diff(tree, prepend=-1))
    yield from zip(cut.tolist(), [*cut[1:].tolist(), len(tree)])


def _at_edge(labels: np.ndarray) -> np.ndarray:
    """Rows of the first and the last subtree at the least depth, which may go on in other partitions."""
    top = labels >> np.int64(8 * (DEPTH - LEAST_DEPTH))
    return (top == top[0]) | (top == top[-1])


def crowding(rows: DataFrame, parts: int) -> DataFrame:
    """``node, tree, label, codes`` of the labels that are not alone at the least depth; a byte a depth, the least depth's first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        for i, j in _tries(table) if table else ():
            labels = table.column("label").to_numpy()[i:j]
            codes, near = np.zeros((j - i, 8), np.uint8), _at_edge(labels)
            for d in range(LEAST_DEPTH, DEPTH + 1):
                start = subtree_starts(labels, d)
                size = np.diff(start, append=j - i)
                codes[:, d - LEAST_DEPTH] = np.repeat(crowd(size), size)
            near |= codes[:, 0] > 0
            at = pa.array(np.flatnonzero(near) + i)
            part = table.take(at).combine_chunks()
            yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks() for c in ("node", "tree", "label")] + [pa.array(codes[near].view(np.int64).ravel())], names=["node", "tree", "label", "codes"])

    ordered = rows.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(counted, "node bigint, tree int, label bigint, codes bigint")


def shortened(near: DataFrame, trees: int, recall: float) -> DataFrame:
    """``node, tree, label, depth``: the prefix with which each node looks for others in each trie."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = np.diff(b.column("at").offsets.to_numpy())
            flat = b.column("at").flatten()
            tree, owner = flat.field("tree").to_numpy(), np.repeat(np.arange(b.num_rows), many)
            codes = np.zeros((b.num_rows, trees, 8), np.uint8)
            codes[owner, tree] = flat.field("codes").to_numpy().view(np.uint8).reshape(-1, 8)
            depth = chosen_depths(codes, trees, recall)[owner, tree]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(owner)), pa.array(tree, pa.int32()), flat.field("label"), pa.array(depth, pa.int32())], names=["node", "tree", "label", "depth"])

    by_node = near.groupBy("node").agg(F.collect_list(F.struct("tree", "label", "codes")).alias("at"))  # one entry a trie at most
    return by_node.mapInArrow(chosen, "node bigint, tree int, label bigint, depth int")


def subtrees(asks: DataFrame, parts: int) -> DataFrame:
    """``tree, depth, prefix, node, asked``: the members of the topmost subtrees that some node looks into.

    Where a subtree may go on in another partition, its rows are offered at every depth; ``asked`` tells the rows that look there.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        for i, j in _tries(table) if table else ():
            labels, depth, node = (table.column(c).to_numpy()[i:j] for c in ("label", "depth", "node"))
            edge, open_, rows = _at_edge(labels), np.ones(j - i, bool), []
            for d in range(LEAST_DEPTH, DEPTH + 1):
                start = subtree_starts(labels, d)
                size = np.diff(start, append=j - i)
                looked = np.repeat(np.logical_or.reduceat(depth == d, start) & (size > 1), size)
                at = np.flatnonzero(edge | (open_ & looked))
                open_ &= ~looked
                rows.append((np.full(len(at), d, np.int32), labels[at] >> np.int64(8 * (DEPTH - d)), node[at], (depth[at] == d)))
            d, prefix, member, asked = (np.concatenate(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), table.column("tree")[i].as_py()), pa.int32()), pa.array(d, pa.int32()), pa.array(prefix), pa.array(member), pa.array(asked)], names=["tree", "depth", "prefix", "node", "asked"])

    ordered = asks.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return ordered.mapInArrow(marked, "tree int, depth int, prefix bigint, node bigint, asked boolean")


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components under edges ``i, j``."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def alike(left: np.ndarray, right: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """Which rows of two tables of symbols agree in ``LOOKALIKE`` of them."""
    n, m, k = len(left), len(right), left.shape[1]
    if n * m * k <= most:
        equal = (left[:, None, :] == right[None, :, :]).sum(2)
    else:
        equal = np.zeros((n, m), np.int16)
        for c in range(k):
            equal += left[:, c, None] == right[None, :, c]
    return equal >= LOOKALIKE * k


def lookalikes(members: DataFrame) -> DataFrame:
    """Edges ``a, b`` between nodes whose signatures look alike, a star a component, from rows sorted by tile."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, blocks, labels = None, [], [], []

        def done() -> pa.RecordBatch:
            node, block = np.array(nodes), np.array(blocks)
            sign = np.array(labels).view(np.uint8).reshape(len(node), -1)
            left = np.flatnonzero(block == key[-2])
            right = left if key[-1] == key[-2] else np.flatnonzero(block == key[-1])
            i, j = np.nonzero(alike(sign[left], sign[right]))
            low = stars(len(node), left[i], right[j])
            far = np.flatnonzero(low != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[low[far]])], names=["a", "b"])

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("tree", "depth", "prefix", "ti", "tj")))
            flat = b.column("labels").flatten().to_numpy().reshape(b.num_rows, -1)
            for k, node, block, label in zip(keys, b.column("node").to_pylist(), b.column("block").to_pylist(), flat):
                if k != key:
                    if len(nodes) > 1:
                        yield done()
                    key, nodes, blocks, labels = k, [], [], []
                nodes.append(node)
                blocks.append(block)
                labels.append(label)
        if len(nodes) > 1:
            yield done()

    return members.mapInArrow(compared, "a bigint, b bigint")


def forest_edges(nodes: DataFrame, trees: int = TREES, recall: float = RECALL, tile: int = GROUP_TILE) -> DataFrame:
    """Edges ``a, b`` that join the nodes which meet in the forest and look alike."""
    rows = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() * trees / SORTED_ROWS))
    near = crowding(rows.select("tree", "label", "node"), parts)
    with few_samples(nodes.sparkSession):
        met = materialise(subtrees(shortened(near, trees, recall), parts), "subtrees")
    key = ["tree", "depth", "prefix"]
    groups = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    groups = groups.filter("asked and n > 1").groupBy("n", "x", "y").agg(F.min(F.struct(*key)).alias("g")).select("g.*", F.ceil(F.col("n") / tile).cast("int").alias("n"))
    groups = materialise(groups, "groups")
    cast = met.select(*key, "node").join(groups, key)
    cast = cast.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cast = cast.select(*key, F.least("block", "_j").alias("ti"), F.greatest("block", "_j").alias("tj"), "block", "node").join(nodes.select("node", "labels"), "node")
    order = [*key, "ti", "tj"]
    edges = materialise(lookalikes(cast.repartition(*order).sortWithinPartitions(*order, "node")).distinct(), "alike")
    discard(met, groups)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of undirected edges ``a, b``, by alternating large and small stars; ``root`` is the least node.

    A node's least neighbour is a table of its own: joined back it is broadcast while small, and beyond that both
    sides are plain exchanges, so that adaptive execution may split the edges of a hub among tasks. The rounds end, as
    each lowers some node's root.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")  # u > v, here and in every round

    def marked() -> tuple[int, int | None]:
        seen = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return seen["n"], seen["h"]

    mark = marked()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        large = materialise(e.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        discard(e, low)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialise(small.filter("u != v").distinct(), "edges")
        discard(large, low)
        before, mark = mark, marked()
        if mark == before:  # stars around their least nodes
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Tile:
    """Rows of one tile: block ``ti`` against block ``tj`` of one component."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.copies: list[int] = []
        self.blocks: list[int] = []
        self.sets: list[np.ndarray] = []

    def links(self, ti: int, tj: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Links of each row, weighted by the partner's copies, and stars that connect the linked rows."""
        n = len(self.nodes)
        left = np.array([i for i in range(n) if self.blocks[i] == ti], np.int64)
        right = left if ti == tj else np.array([i for i in range(n) if self.blocks[i] == tj], np.int64)
        count = np.zeros(n, np.int64)
        if not len(left) or not len(right) or n < 2:
            return count, []
        size = np.array([len(s) for s in self.sets], np.int64)
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(n), size)
        _, code, uses = np.unique(flat, return_inverse=True, return_counts=True)
        shared = uses[code] > 1
        code, owner = code[shared], owner[shared]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        code = np.cumsum(np.diff(code, prepend=code[:1]) != 0) if len(code) else code
        both = np.zeros((len(left), len(right)), np.float32)
        at_left, at_right = np.full(n, -1), np.full(n, -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        step, top = 4096, int(code[-1]) + 1 if len(code) else 0
        for c in range(0, top, step):  # exact: counts stay far below 2**24
            s, e = np.searchsorted(code, [c, c + step])
            k, o = code[s:e] - c, owner[s:e]
            x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
            m = at_left[o] >= 0
            x[at_left[o][m], k[m]] = 1
            m = at_right[o] >= 0
            y[at_right[o][m], k[m]] = 1
            both += x @ y.T
        num, den = THRESHOLD
        union = size[left][:, None] + size[right][None] - both
        i, j = np.nonzero(den * both >= num * union)
        i, j = left[i], right[j]
        copies = np.array(self.copies, np.int64)
        other = i != j
        i, j = i[other], j[other]
        np.add.at(count, i, copies[j])
        if ti != tj:
            np.add.at(count, j, copies[i])
        low = stars(n, i, j)
        return count, [(self.nodes[k], self.nodes[low[k]]) for k in np.flatnonzero(low != np.arange(n)).tolist()]


def verify(texts: DataFrame) -> DataFrame:
    """From rows ``root, ti, tj, node, copies, block, text`` sorted by tile: ``node, n_links, other`` (a link, or null)."""
    schema, secret = "node bigint, n_links bigint, other bigint", draw_key()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, Tile()

        def done() -> pa.RecordBatch:
            count, forest = now.links(key[1], key[2])
            some = np.flatnonzero(count)
            nodes = [now.nodes[k] for k in some] + [a for a, _ in forest]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(count[some].tolist() + [0] * len(forest), pa.int64()), pa.array([None] * len(some) + [b for _, b in forest], pa.int64())], names=["node", "n_links", "other"])

        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            meta = list(zip(*(b.column(c).to_pylist() for c in ("root", "ti", "tj", "node", "copies", "block"))))
            for i, j in row_batches(bounds):
                h, r = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], key=secret)
                cut = np.searchsorted(r, np.arange(j - i + 1))
                for k in range(i, j):
                    root, ti, tj, node, copies, block = meta[k]
                    if key != (root, ti, tj):
                        if key is not None:
                            yield done()
                        key, now = (root, ti, tj), Tile()
                    now.nodes.append(node)
                    now.copies.append(copies)
                    now.blocks.append(block)
                    now.sets.append(np.unique(h[cut[k - i] : cut[k - i + 1]]))
        if key is not None:
            yield done()

    return texts.mapInArrow(verified, schema)


def near_duplicates(docs: DataFrame, trees: int = TREES, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row: its class's least id, and how many other rows it links with."""
    slim = materialise(signatures(docs, trees), "forest")
    known = slim.filter(F.col("doc_id").isNotNull() & F.col("labels").isNotNull())
    nodes = materialise(known.groupBy("text_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("labels").alias("labels")), "nodes")

    groups = components(forest_edges(nodes, trees, recall))
    # One row a component, as a table: joined back it meets as many rows as the component has nodes, which AQE can split.
    sizes = materialise(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    tiles = groups.join(sizes, "root").withColumn("n", F.ceil(F.col("size") / tile).cast("int"))
    members = nodes.join(tiles, "node").select("node", "text_key", "copies", "root", "n").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("n")).cast("int"))
    keyed = docs.select(F.col("doc_id").alias("node"), "text", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32)).alias("text_key"))
    texts = keyed.join(members, ["node", "text_key"]).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    texts = texts.select("root", F.least("block", "_j").alias("ti"), F.greatest("block", "_j").alias("tj"), "node", "copies", "block", "text", "text_key")
    texts = texts.repartition("root", "ti", "tj").sortWithinPartitions("root", "ti", "tj", "node", "text_key")
    links = materialise(verify(texts.drop("text_key")), "links")

    counts = links.groupBy("node").agg(F.sum("n_links").alias("links"))
    classes = components(links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = nodes.select("text_key", "node", "copies").join(counts, "node", "left").join(classes, "node", "left")
    info = info.select("text_key", F.coalesce("root", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # Only texts that are linked or copied need the join; the rest answer for themselves.
    info = info.filter("links > 0")
    out = salted_firsts(slim.select("doc_id", "text_key", "n_shingles"), info, "text_key")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **knobs) -> DataFrame:
    """The rows of ``docs`` whose id names their class, and one of each set of equal rows; rows without id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), **knobs)
    gone = found.filter("class_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


#: Exact links and classes in DuckDB's SQL, over all pairs that share a shingle.
ORACLE_SQL = f"""
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as i from w where len(w) > 0)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 5 * k >= 4 * (x.n + y.n - k)),
r as (select doc_id as node, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.node)
select doc_id, (select min(root) from r where node = doc_id) as class_id, (select count(*) from l where a = doc_id) as n_links
from documents"""
