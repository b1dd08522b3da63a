"""Exact Jaccard self-join of documents on word shingles, as classes of linked documents.

1.  Each text becomes a set of shingle hashes; equal sets are one node from there on.
2.  Two sets that link share one of the first n - ceil(t n) + 1 shingles of each, in any fixed order. Shingles common in a part
    of the corpus come last in that order, the rest by hash; the order decides what the join costs, never what it finds.
    Nodes that share such a shingle form a group; groups with the same members are one.
3.  Nodes of a group are compared in tiles of like size. Every node has a bitmap of hashed shingles, as long as its size asks
    for; bits of one bitmap that the other lacks bound the overlap from above. Pairs that pass are verified by intersecting
    the sorted arrays.
4.  Only links between different components can change the classes: a first round compares a group's nodes with one centre,
    the node that shares shingles with most others; later rounds compare only nodes of a group that are still in different
    components, the most promising partners of each component first, until no pair is left that may link.
    A pair that shares many shingles is in many groups; where the few largest groups of both nodes tell that another group has
    both, it is left to that one. So near copies of one text cost about one verification each, however many there are, and yet
    no link between components is missed. Texts of one group that link with nobody, though their bitmaps allow it, are verified
    pair by pair: the exact answer needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, block_shingles, discard, materialise, mix, partitions, runs, split_blocks, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, whole

#: Shingles that the order puts last, at most: a bound for what is broadcast.
COMMON = 1 << 18
#: Shingles that a task holds while it counts them.
COUNTED = 2_000_000
#: Nodes up to which the list of nodes with partners is broadcast; beyond, it is joined by shuffling.
BROADCAST_NODES = 1_000_000
#: Nodes of a tile.
TILE = 512
#: Bits of a bitmap for each shingle, at least: in the first rounds, and in those after, where few nodes are left, each with many
#: partners that shorter bitmaps allow.
BITS, WIDE = 2, 16
#: Groups of a node that go with it to the tiles, the largest ones.
TOP = 4
#: Partners of a component that a tile proposes in the first round; each later round proposes GROWTH times as many.
PARTNERS, GROWTH = 4, 8
#: A table of nodes, or a function that makes and writes one for the nodes of another.
Nodes = DataFrame | Callable[[DataFrame], DataFrame]
#: Text bytes of a block, small as the arrays over a block's words take some forty times as much.
BLOCK = 1 << 20


def _counts(width: int):
    """Shingles that occur in two or more texts of each few thousand, with their counts there."""

    def run(batches):
        hashes, held, size = WordHashes(), [], 0
        for (texts,) in split_blocks(batches, ["text"], BLOCK):
            held.append(block_shingles(texts, hashes, width)[1])
            size += len(held[-1])
            if size >= COUNTED:
                yield _repeated(held)
                held, size = [], 0
        if held:
            yield _repeated(held)

    return run


def _repeated(found: list[np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values[n >= 2].view(np.int64)), pa.array(n[n >= 2])], ["hash", "n"])


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that are frequent in an eighth of the texts, ascending, at most COMMON."""
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0)
    counts = part.mapInArrow(_counts(width), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()  # at most COMMON rows
    return np.sort(top.column("hash").to_numpy().view(np.uint64))


def _nodes(n: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set: the sum of its scrambled hashes."""
    total = np.zeros(len(n), np.uint64)
    some = n > 0
    if len(found):
        starts = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            total[some] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), starts)
            total[some] = mix(total[some] + n[some].astype(np.uint64))
    return total.view(np.int64)


def _prefixes(width: int, percent: int, buckets: int, common):
    def run(batches):
        hashes, last = WordHashes(), common.value
        for (texts,) in split_blocks(batches, ["text"], BLOCK):
            n, found = block_shingles(texts, hashes, width)
            if not len(found):
                continue
            nodes = _nodes(n, found)
            owner = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(found), bool)
            if len(last):
                late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
            start = np.repeat(np.cumsum(n) - n, n)
            early = np.cumsum(~late)
            before = early - ~late  # early ones before this place
            first = before[start]  # and before the set
            early_in_set = np.repeat(np.bincount(owner, weights=~late, minlength=len(n)).astype(np.int64), n)
            rank = np.where(late, early_in_set + (np.arange(len(found)) - start) - (before - first), before - first)
            prefix = n - -(-percent * n // 100) + 1
            at = np.flatnonzero(rank < prefix[owner])
            key, node, size = found[at], nodes[owner[at]], n[owner[at]].astype(np.int32)
            bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
            order = np.lexsort((node, key, bucket))
            order = order[np.r_[True, (np.diff(key[order].view(np.int64)) != 0) | (np.diff(node[order]) != 0)]]
            bucket, key, node, size = bucket[order], key[order], node[order], size[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            out = [(int(bucket[s]), squeeze_sorted(key[s:e]), node[s:e].tobytes(), squeeze(size[s:e])) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "nodes", "sizes"])

    return run


def _groups(percent: int):
    """Nodes that share a prefix shingle and have a partner of fitting size; equal groups of a bucket once."""

    def run(batches):
        for t in runs(batches, "bucket"):
            key = np.concatenate([unsqueeze_sorted(x.as_py()) for x in t.column("keys")])
            node = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("nodes")])
            size = np.concatenate([unsqueeze(x.as_py(), np.int32) for x in t.column("sizes")]).astype(np.int64)
            order = np.lexsort((node, size, key))
            key, node, size = key[order], node[order], size[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, size = key[new], node[new], size[new]
            chained = (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])  # sizes of a group in order: a gap parts it
            starts = np.flatnonzero(np.r_[True, ~chained])
            count = np.diff(np.r_[starts, len(key)])
            with np.errstate(over="ignore"):
                gid = mix(np.add.reduceat(mix(node.view(np.uint64)), starts) + count.astype(np.uint64)).view(np.int64)
            first = np.zeros(len(gid), bool)
            first[np.unique(gid, return_index=True)[1]] = True
            keep = np.repeat(first & (count > 1), count)
            if keep.any():
                columns = (np.repeat(gid, count)[keep], node[keep], size[keep], np.repeat(count, count)[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gid", "node", "n", "members"])

    return run


def bitmap(hashes: np.ndarray, each: int) -> bytes:
    """Hashed bits, at least `each` times as many as hashes; a power of two, so that a longer one can be folded to a shorter one."""
    bits = max(64, 1 << int(each * len(hashes) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bounds(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each row of a and each of b, the largest overlap that their bitmaps allow."""
    only_a = np.zeros((len(a), len(b)), np.int64)
    only_b = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        only_a += np.bitwise_count(x & ~y)
        only_b += np.bitwise_count(y & ~x)
    return np.minimum(na[:, None] - only_a, nb[None, :] - only_b)


def _links(bound, na, nb, percent):
    return (100 + percent) * bound >= percent * (na + nb)  # J >= t exactly when overlap >= t / (1 + t) (na + nb)


def _sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for ids, keys, texts in split_blocks(batches, ["id", "key", "text"], BLOCK):
            n, found = block_shingles(texts, hashes, width)
            nodes, ends = _nodes(n, found), np.cumsum(n)
            first = np.zeros(len(n), bool)  # of equal sets of a block one carries its bitmap
            first[np.unique(nodes, return_index=True)[1]] = True
            for s in range(0, len(n), 500):
                e = min(s + 500, len(n))
                parts = [found[ends[i] - n[i] : ends[i]] if first[i] else found[:0] for i in range(s, e)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[s:e], pa.int64()),
                        pa.array(nodes[s:e], mask=n[s:e] == 0),
                        pa.array(n[s:e]),
                        pa.array(keys[s:e], pa.int64()),
                        pa.array([bitmap(p, BITS) if len(p) else None for p in parts], pa.binary()),
                    ],
                    ["id", "node", "n", "key", "bits"],
                )

    return run


def _hashes(width: int):
    """Names and shingles of sets, of equal ones of a block once."""

    def run(batches):
        hashes = WordHashes()
        for (texts,) in split_blocks(batches, ["text"], BLOCK):
            n, found = block_shingles(texts, hashes, width)
            nodes, ends = _nodes(n, found), np.cumsum(n)
            nodes, first = np.unique(nodes, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([squeeze_sorted(found[ends[i] - n[i] : ends[i]]) for i in first.tolist()], pa.binary())], ["node", "hashes"])

    return run


@dataclass(frozen=True)
class Signature:
    """What tells of two nodes, before they are verified, that they may link. Both functions take lists of signatures and arrays of
    sizes of both sides, and the percentage, and give which may link and how promising they are: `pairs` row by row, `tile` for
    each of one side with each of the other. `longer` makes signatures for later rounds from the sets, if there are such."""

    pairs: Callable
    tile: Callable
    longer: Callable | None = None


def _bitmap_pairs(x: list[bytes], nx: np.ndarray, y: list[bytes], ny: np.ndarray, percent: int):
    bounds = np.zeros(len(x), np.int64)
    for i, (p, q) in enumerate(zip(x, y, strict=True)):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        words = min(len(p), len(q))
        p, q = folded(p, words), folded(q, words)
        bounds[i] = min(nx[i] - int(np.bitwise_count(p & ~q).sum()), ny[i] - int(np.bitwise_count(q & ~p).sum()))
    return _links(bounds, nx, ny, percent), bounds


def _bitmap_tile(x: list[bytes], nx: np.ndarray, y: list[bytes], ny: np.ndarray, percent: int):
    bits = [np.frombuffer(b, np.uint64) for b in (*x, *y)]
    words = min(map(len, bits))
    bits = np.stack([folded(b, words) for b in bits])
    bound = overlap_bounds(bits[: len(x)], nx, bits[len(x) :], ny)
    return _links(bound, nx[:, None], ny[None, :], percent), bound / np.maximum(nx[:, None], ny[None, :])


def _wide(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([bitmap(unsqueeze_sorted(x), WIDE) for x in b.column("hashes").to_pylist()], pa.binary())], ["node", "bits"])


BITMAPS = Signature(_bitmap_pairs, _bitmap_tile, _wide)


def _approve(percent: int, signature: Signature):
    """Of candidate edges with both signatures, those that may link, with how promising they are."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = [b.column(c).to_numpy() for c in ("n_a", "n_b")]
            ok, score = signature.pairs(b.column("bits_a").to_pylist(), sizes[0], b.column("bits_b").to_pylist(), sizes[1], percent)
            got = b.take(pa.array(np.flatnonzero(ok)))
            yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b"), pa.array(score[ok].astype(np.float64))], ["a", "b", "score"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column("hashes_a").to_pylist(), b.column("hashes_b").to_pylist(), strict=True):
                x, y = unsqueeze_sorted(x), unsqueeze_sorted(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _elsewhere(gid: int, tops: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of a group's nodes, whether both nodes are sure to be in a larger group too; `tops` has each node's largest groups."""
    at = tops == gid
    before = (np.cumsum(at, axis=1) == 0) & (tops != 0)  # those before this group in the order of groups
    x, y = np.where(before[i], tops[i], 0), np.where(before[j], tops[j], -1)
    x[x == -1] = 0
    return (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))


def _most_promising(low: np.ndarray, high: np.ndarray, score: np.ndarray, each: int) -> np.ndarray:
    """Which pairs of components are among the `each` best of one of their two components."""
    comp, pair = np.concatenate([low, high]), np.tile(np.arange(len(low)), 2)
    order = np.lexsort((pair, -score[pair], comp))
    comp, pair = comp[order], pair[order]
    start = np.r_[True, comp[1:] != comp[:-1]]
    rank = np.arange(len(comp)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    kept = np.zeros(len(low), bool)
    kept[pair[rank < each]] = True
    return kept


def _tiles(percent: int, each: int, signature: Signature):
    """Compare the two sides of each tile; for each component, the `each` most promising pairs with other ones.

    A tile in which there were more is marked by a row without a, so that it is looked at again when these are verified."""

    def run(batches):
        for t in runs(batches, "tile"):
            side = t.column("side").to_numpy()
            left, right = np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero((side == 1) | (side == 2))
            if not len(left) or not len(right):
                continue
            node, n, comp = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("comp").to_numpy()
            tops = np.zeros((len(node), TOP), np.int64)
            for k, x in enumerate(t.column("tops").to_pylist()):
                tops[k, : len(x)] = x
            bits = t.column("bits").to_pylist()
            ok, score = signature.tile([bits[k] for k in left], n[left], [bits[k] for k in right], n[right], percent)
            ok &= comp[left][:, None] != comp[right][None, :]
            i, j = np.nonzero(ok)
            score, i, j = score[i, j], left[i], right[j]
            new = np.concatenate([~_elsewhere(t.column("gid")[0].as_py(), tops, i[s : s + 65536], j[s : s + 65536]) for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            new &= (side[i] != side[j]) | (i < j)  # a tile of one part with itself has each pair twice
            i, j, score = i[new], j[new], score[new]
            if not len(i):
                continue
            low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            kept = _most_promising(low, high, score, each)
            a, b = np.minimum(node[i], node[j])[kept].tolist(), np.maximum(node[i], node[j])[kept].tolist()
            if not kept.all():
                a, b = [*a, None], [*b, None]
            tile = t.column("tile")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([tile] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["tile", "a", "b"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and comp, the smallest node reachable, for the nodes of edges (a, b); labels spread and jump until none changes."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), name)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("to"))
        onward = labels.select(F.col("node").alias("to"), F.col("comp").alias("onward"))
        new = materialise(spread.join(onward, "to", "left").select("node", F.least("to", F.coalesce("onward", "to")).alias("comp"), (F.least("to", F.coalesce("onward", "to")) != F.col("comp")).alias("moved")), name)
        discard(labels)
        labels = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            discard(both)
            return labels


def jaccard_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs: id, n_shingles and component_id, the smallest id of its class.

    Two texts link when 100 * intersection >= percent * union of their sets of `width`-word shingles (words: runs without ASCII
    white space, A-Z lower-cased; a text with fewer words has one shingle, all of it). Null, empty and blank texts have no
    shingle and link with nothing; their component is their own id. Ids are integers; rows with a null id take part, and a
    class whose ids are all null has component null. Repeated rows stay rows. An empty table gives an empty result.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text"))
    buckets = 2 * partitions(spark)
    common = spark.sparkContext.broadcast(common_shingles(rows.select("text"), width))
    packed = rows.select("text").mapInArrow(_prefixes(width, percent, buckets, common), "bucket int, keys binary, nodes binary, sizes binary")
    groups = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_groups(percent), "gid long, node long, n long, members long")
    groups = materialise(groups.distinct(), "jaccard-groups")
    named = groups
    discard()  # the shuffle of all prefixes, before sets are written
    needed = groups.select("node").distinct().withColumn("needed", F.lit(True))
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    keyed = rows.withColumn("key", F.xxhash64("text"))
    sets = keyed.select("id", "key", "text").mapInArrow(_sets(width), "id long, node long, n long, key long, bits binary").join(needed, "node", "left")
    sets = materialise(sets.select("id", "node", "n", "key", F.when(F.col("needed"), F.col("bits")).alias("bits"), F.monotonically_increasing_id().alias("row")), "jaccard-sets")
    # Of rows with equal sets one stands for the node; by its row number the others are left out of every join without a second
    # table of sets.
    kept = sets.filter(F.col("bits").isNotNull())
    chosen = materialise(kept.groupBy("node").agg(F.min("row").alias("row"), F.min_by("key", "row").alias("key")), "jaccard-chosen")
    groups = materialise(groups.join(_few(chosen, chosen.count()), "node").select("gid", F.col("row").alias("node"), "n", "members"), "jaccard-groups")
    discard(named)
    nodes = kept.select(F.col("row").alias("node"), "n", "bits")

    def asked(wanted: DataFrame) -> DataFrame:
        """Shingles of these nodes, made from their texts again: few are verified, and those of all would take more room than the texts."""
        names = materialise(chosen.join(wanted.withColumnRenamed("node", "row"), "row", "left_semi"), "jaccard-asked")
        count = names.count()
        texts = keyed.join(_few(names.select("key").distinct(), count), "key", "left_semi").select("text")
        made = texts.mapInArrow(_hashes(width), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
        made = materialise(made.join(_few(names.select("node", "row"), count), "node").select(F.col("row").alias("node"), "hashes"), "jaccard-hashes")
        discard(names)
        return made

    found = link_groups(groups, nodes, asked, chosen.select(F.col("row").alias("node")), percent)
    discard(groups)
    names = chosen.select(F.col("row").alias("comp"), F.col("node").alias("comp_node"))
    labels = found.withColumnRenamed("node", "row").join(chosen, "row").join(names, "comp").select("node", F.col("comp_node").alias("comp"))
    member = sets.select("id", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = member.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("id").alias("least"))
    found = member.join(least, "comp", "left")
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def _few(df: DataFrame, count: int) -> DataFrame:
    """For broadcasting where it is small enough, else for a join that shuffles."""
    return F.broadcast(df) if count <= BROADCAST_NODES else df


def _ends(edges: DataFrame, nodes: Nodes, columns: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) with these columns of both nodes, and the tables made for them. Those of each b travel once to its a; an a with many has its own copied to
    parts of them, so that no task gets all partners of a node."""
    sizes = edges.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    dealt = materialise(edges.select("a", "b").join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "jaccard-edges")
    count, made = dealt.count(), [dealt]
    if callable(nodes):
        nodes = nodes(dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct())
        made.append(nodes)
    members = nodes.join(_few(dealt, count), nodes.node == dealt.b).select("a", "part", "b", *[F.col(c).alias(f"{c}_b") for c in columns])
    centres = dealt.select(F.col("a").alias("centre"), "part").distinct()
    centres = nodes.join(_few(centres, count), nodes.node == centres.centre).select(F.col("centre").alias("a"), "part", *[F.col(c).alias(f"{c}_a") for c in columns])
    return members.join(centres, ["a", "part"]).select("a", "b", *[f"{c}_{x}" for c in columns for x in "ab"]), made


def _verified(edges: DataFrame, nodes: Nodes, percent: int) -> DataFrame:
    """Exact verdicts for edges (a, b)."""
    ends, made = _ends(edges, nodes, ["hashes"])
    found = materialise(ends.mapInArrow(_verify(percent), "a long, b long, linked boolean"), "jaccard-verified")
    discard(*made)
    return found


def _star(groups: DataFrame, nodes: DataFrame, percent: int, signature: Signature) -> DataFrame:
    """For each node the most promising of its groups' centres; a centre is the node of a group that shares groups with most others."""
    degree = groups.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = groups.join(degree, "node")
    centre = ranked.groupBy("gid").agg(F.max_by(F.struct(F.col("node").alias("a"), F.col("n").alias("na")), F.struct("degree", "node")).alias("c")).select("gid", "c.*")
    fits = (100 * F.col("na") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("na"))
    star = groups.join(centre, "gid").filter((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b")).distinct()
    ends, made = _ends(star, nodes, ["n", "bits"])
    found = materialise(ends.mapInArrow(_approve(percent, signature), "a long, b long, score double").groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("a")), "jaccard-star")
    discard(*made)
    return found


def _cells(groups: DataFrame, comp: DataFrame, tops: DataFrame, percent: int) -> DataFrame:
    """gid, tile, side, node, n of the groups whose nodes are in different components: nodes of like size, at most TILE on a side."""
    labelled = groups.join(comp, "node").join(tops.select("node", F.col("tops")[0].alias("top")), "node")
    # A group all of whose nodes have one larger group in common is left to that one.
    part = (F.min("top") == F.max("top")) & (F.min("top") != F.col("gid"))
    mixed = labelled.groupBy("gid").agg(((F.min("comp") != F.max("comp")) & ~part).alias("mixed")).filter("mixed").select("gid")
    open_groups = materialise(labelled.join(mixed, "gid", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / percent)) + 1e-9)), "jaccard-open")
    parts = open_groups.groupBy("gid", "band").agg(F.ceil(F.count("*") / TILE).alias("parts"), (F.count("*") == 1).alias("alone"))
    above = parts.select("gid", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("gid", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    dealt = open_groups.join(parts.join(above, ["gid", "band"], "left").join(below, ["gid", "band"], "left"), ["gid", "band"])
    dealt = dealt.filter(~F.col("alone") | F.col("above").isNotNull() | F.col("below").isNotNull())
    # Part p of a band meets the parts from p on of its own band, and all parts of the bands beside it.
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    def tile(b1, p1, b2, p2, side):
        return F.struct(b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"), side.alias("side"))

    band, part = F.col("band"), F.col("part")
    own = F.when(F.col("alone"), F.array()).otherwise(F.transform(upto("parts"), lambda q: tile(band, F.least(part, q), band, F.greatest(part, q), F.when(part == q, 2).when(part < q, 0).otherwise(1))))
    up = F.when(F.col("above").isNotNull(), F.transform(upto("above"), lambda q: tile(band, part, band + 1, q, F.lit(0))))
    down = F.when(F.col("below").isNotNull(), F.transform(upto("below"), lambda q: tile(band - 1, q, band, part, F.lit(1))))
    cells = dealt.select("gid", "node", "n", F.explode(F.concat(own, F.coalesce(up, F.array()), F.coalesce(down, F.array()))).alias("t"))
    cells = cells.select("gid", F.xxhash64("gid", "t.b1", "t.p1", "t.b2", "t.p2").alias("tile"), "t.side", "node", "n")
    found = materialise(cells, "jaccard-cells")
    discard(open_groups)
    return found


def _compared(cells: DataFrame, comp: DataFrame, tops: DataFrame, nodes: DataFrame, sets: Nodes, percent: int, each: int, signature: Signature) -> DataFrame:
    """tile, a, b: pairs of a tile's sides that are in different components and may link by their signatures."""
    wanted = cells.select("node").distinct()
    longer = signature.longer is not None and each > PARTNERS
    made = [sets(wanted)] if longer and callable(sets) else []
    wanted = made[0] if made else (sets if longer else nodes).join(_few(wanted, wanted.count()), "node", "left_semi")
    bits = wanted.select("node", "hashes").mapInArrow(signature.longer, "node long, bits binary") if longer else wanted.select("node", "bits")
    rows = cells.join(bits.join(comp, "node").join(tops, "node"), "node")
    pairs = materialise(rows.repartition(partitions(nodes.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(_tiles(percent, each, signature), "tile long, a long, b long"), "jaccard-pairs")
    if made:
        discard(*made)
    return pairs


def link_groups(groups: DataFrame, nodes: DataFrame, sets: Nodes, names: DataFrame, percent: int, signature: Signature = BITMAPS) -> DataFrame:
    """node and comp of every node that names lists: two nodes of a group are linked if their sets are similar enough.

    groups: gid, node, n (size of the node's set), members (of the group); nodes: node, n, bits (its signature); sets: node, hashes
    (its set, ascending), or a function that makes and writes such a table for the nodes of another. nodes and sets have one row for each node of a group, and may hold further ones."""
    star = _star(groups, nodes, percent, signature)
    tried = _verified(star, sets, percent)
    discard(star)
    found = components(tried.filter("linked"))
    comp = materialise(names.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "jaccard-labels")
    rejected = materialise(tried.filter("not linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "jaccard-rejected")
    discard(found, tried)
    in_order = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("members"), "gid"))), 1, TOP)  # a node's groups: fewer than its shingles
    tops = materialise(groups.groupBy("node").agg(F.transform(in_order, lambda g: g["gid"]).alias("tops")), "jaccard-tops")
    cells, each = _cells(groups, comp, tops, percent), PARTNERS
    while not cells.isEmpty():
        pairs = _compared(cells, comp, tops, nodes, sets, percent, each, signature)
        fresh = pairs.filter("a is not null").select("a", "b").distinct().join(rejected, ["a", "b"], "left_anti")
        tried = _verified(fresh, sets, percent)
        linked = tried.filter("linked")
        if not linked.isEmpty():  # components of components
            ends = [comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
            joined = components(linked.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            merged = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            before, comp = comp, materialise(comp.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "jaccard-labels")
            discard(before, joined)
        # A tile all of whose pairs were tried is done; so each round looks at fewer, and at more pairs of each.
        again = pairs.filter("a is null").select("tile").distinct()
        if again.isEmpty():
            discard(pairs, tried)
            break
        before, rejected = rejected, materialise(rejected.union(tried.filter("not linked").select("a", "b")), "jaccard-rejected")
        dead, cells = cells, materialise(cells.join(again, "tile", "left_semi"), "jaccard-cells")
        discard(before, dead, pairs, tried)
        each *= GROWTH
    discard(cells, rejected, tops)
    return comp
