"""Exact Jaccard join of five-word shingle sets in their metric space, and the components of its links.

The distance of two sets is 1 - Jaccard; a link is a distance of at most 0.25.  Equal sets are one node.

1. First level.  Sets without a common shingle lie at the greatest distance from each other, and so from any
   document as a pivot: Voronoi cells of documents would hold the whole table.  The pivots of the first level are
   therefore single shingles: a set belongs to the regions of its rarest n - ceil(t n) + 1 of n shingles, as sets
   that link share at least ceil(t n).  Word shingles are counted in a table of ``CELLS`` cells (fixed size,
   broadcast as classes of counts), which orders them by rarity; any order gives the same links.  Regions of equal
   nodes are one region.
2. Cells.  The metric of symmetric difference, split by hash over ``PARTS`` parts of the shingle universe, has the
   empty set as a pivot in each part: by the triangle inequality the sum of |distance differences| is at most the
   distance.  Within a region, nodes that this window leaves together, directly or through others, form a cell; its
   pivot is the document next to its median (cells that hold each other's pivots become one).  Both ends of each link lie in a cell.  A cell is sent as a star of
   (pivot, member) rows, never as pairs, and the distance of each member to its pivot is computed exactly.
3. Recursion.  Members that link to a pivot are one cluster.  Only cells whose nodes are in several clusters go on.
   Of these, a cell of more than ``LEAF`` members gets ``PIVOTS`` fresh pivots from its stragglers (the nodes
   outside its largest cluster).  Each member belongs to the Voronoi region of its nearest one, and is replicated to
   those no further away than the nearest by twice the distance of a link, as the triangle inequality asks for.
   This is repeated on the regions; a cell that lies too close together to be halved stays whole.
4. Leaves.  Of a cell still open, stragglers meet all members in pairs of blocks of bounded size, and groups grow in number
   with these pairs, not in size.  There, intersections are counted exactly; what the difference of their distances to the pivot rules out is left out, and one link for each straggler and
   cluster comes back.

Sets are compared by the full 64-bit hashes of their shingles and named by 64 bits too; names that two different
sets share (told by another 64 bits) are replaced by the other hash.

Null or empty text, or one without words: no shingles, linked with nothing.  Fewer than five words: one
shingle, the whole sequence.  Repeated rows are equal sets.  Null ids never lead a component unless it
has no other.  Very long texts are read whole, one in a batch.  Only id and text are read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emulsa.llm.common import cut, distinct, hash_strings, mix, n_buckets, packed, slices, split_words, unpacked
from emulsa.llm.components import components
from emulsa.llm.op3_lm import lower_ascii
from emulsa.llm.sieve import passes, sieve, tally, used_cells

WORDS, SHARE = 5, 75
CELLS, PARTS = 1 << 22, 96
SENT = "bucket int, low binary, high binary, nodes binary"
SLICE = 8 << 20
LEAF, PIVOTS, LEVELS, FEW = 4096, 4, 4, 1 << 18
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 19


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the ascending distinct 64-bit shingle hashes of each text."""
    codes, offsets, words = split_words(lower_ascii(col))
    h = mix(hash_strings(words, 5))[codes]
    full = np.empty(0, np.uint64)
    if len(h) >= WORDS:
        full = np.zeros(len(h) - WORDS + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS):
                full = full * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - WORDS + 1 + k]
        full = mix(full)
    sets = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= WORDS:
            sets.append(distinct(full[s : e - WORDS + 1]))
        elif e > s:
            sets.append(np.array([xxhash.xxh3_64_intdigest(h[s:e].tobytes(), e - s)], np.uint64))
        else:
            sets.append(full[:0])
    return np.concatenate([full[:0], *sets]), np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)].astype(np.int64)


def names_of(h: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each set (0 for an empty one)."""
    return np.array([xxhash.xxh3_64_intdigest(h[s:e].tobytes(), seed) if e > s else 0 for s, e in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)


def nodes_of(h: np.ndarray, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The name of each set, or its other name where it is one of ``shared``."""
    node = names_of(h, at)
    if len(shared) and np.isin(node, shared).any():
        node = np.where(np.isin(node, shared), names_of(h, at, 1), node)
    return node


def cell_of(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(CELLS)).astype(np.int64)


def rarity(rows: DataFrame) -> np.ndarray:
    """The class (0 to 31) of each cell's count over all rows, against the mean count of a cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.uint32)
        for batch in slices(batches, most=SLICE):
            seen += np.bincount(cell_of(shingle_sets(batch.column(0))[0]), minlength=CELLS).astype(np.uint32)
        yield from used_cells(seen)

    fours = tally(rows.select("text").mapInArrow(count, "bucket int, cells binary, counts binary"), CELLS).astype(int)
    mean = 4 * np.log2(np.mean(2 ** (fours / 4)))
    return np.clip(8 + (fours - mean) // 2, 0, 31).astype(np.uint8)


def prefixes(h: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit keys, index of their set): each set's rarest n - ceil(t n) + 1 shingles."""
    key = classes[cell_of(h)].astype(np.uint64) << np.uint64(59) | h >> np.uint64(5)
    kept = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = e - s
        kept.append(np.sort(key[s:e])[: n + (SHARE * -n) // 100 + 1] if n else key[:0])
    keys = np.concatenate([key[:0], *kept])
    return mix(keys) >> np.uint64(16), np.repeat(np.arange(len(kept)), [len(x) for x in kept])


def parts_of(h: np.ndarray) -> bytes:
    """How much of a set lies in each part of the universe; the number of parts doubles with the size from 8 * PARTS on."""
    n = PARTS << max(0, (len(h) // (4 * PARTS)).bit_length() - 1)
    return np.minimum(np.bincount((mix(h ^ np.uint64(77)) % np.uint64(n)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def folded(parts: list[bytes]) -> np.ndarray:
    """The parts as rows of one width, the least of any: part k of few is the sum of those of many that are k modulo the few."""
    width = min(len(x) for x in parts)
    return np.stack([np.frombuffer(x, np.uint8).astype(np.int16).reshape(-1, width).sum(0, dtype=np.int16) for x in parts])


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * both >= SHARE * (n + m - both)


def within(difference: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and at least this symmetric difference can link."""
    return ((100 + SHARE) * difference <= (100 - SHARE) * (n + m)) & (100 * n >= SHARE * m) & (100 * m >= SHARE * n)


def region_lists(rows: DataFrame, shared: np.ndarray, n: int) -> DataFrame:
    """list, node: the distinct lists of nodes that share a region, those of two nodes or more; n buckets."""
    classes = rows.sparkSession.sparkContext.broadcast(rarity(rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            h, at = shingle_sets(batch.column(0))
            node = nodes_of(h, at, shared)
            once = np.zeros(len(node), bool)
            once[np.unique(node, return_index=True)[1]] = True
            key, doc = prefixes(h, at, classes.value)
            key, doc = key[once[doc]], doc[once[doc]]
            yield from packed((mix(key) % np.uint64(n)).astype(np.int32), {"low": key.astype("<u4"), "high": (key >> np.uint64(32)).astype("<u2"), "nodes": node[doc]})

    def lists(table: pa.Table) -> pa.Table:
        node = unpacked(table["nodes"], "<i8")
        key = unpacked(table["high"], "<u2").astype(np.uint64) << np.uint64(32) | unpacked(table["low"], "<u4")
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        several = np.flatnonzero(np.diff(edge) > 1)
        found = {distinct(node[edge[k] : edge[k + 1]]).tobytes() for k in several.tolist()}
        return pa.table({"nodes": pa.array([x for x in found if len(x) > 8], pa.binary())})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                node = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), xxhash.xxh3_64_intdigest(raw), np.uint64).view(np.int64)), pa.array(node)], names=["list", "node"])

    found = rows.select("text").mapInArrow(send, SENT).groupBy("bucket").applyInArrow(lists, "nodes binary")
    return found.distinct().mapInArrow(members, "list long, node long")


def cells_in(table: pa.Table) -> pa.Table:
    """The stars (pivot, node) of the cells of a bucket's regions, and in how many regions n."""
    of, node, n = (table[c].to_numpy() for c in ("list", "node", "n_shingles"))
    sketch = table["parts"].to_pylist()
    by = np.lexsort((node, n, of))
    of, node, n, sketch = of[by], node[by], n[by], [sketch[i] for i in by.tolist()]
    found = [np.empty((0, 2), np.int64)]
    # sizes in a run are near enough for one to follow from the other; where the ratio is broken, no link crosses
    edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (SHARE * n[1:] > 100 * n[:-1]), True])
    for first, end in zip(edge[:-1], edge[1:], strict=True):
        if end - first < 2:
            continue
        parts, base = folded(sketch[first:end]), first
        rest = np.arange(end - first)
        while len(rest) > 1:
            cell, ahead, rest = [rest[:1]], [rest[0]], rest[1:]
            while ahead and len(rest):
                i = ahead.pop()
                ok = within(np.abs(parts[rest] - parts[i]).sum(1, dtype=np.int64), n[base + i], n[base + rest])
                if ok.any():
                    cell.append(rest[ok])
                    ahead += rest[ok].tolist()
                    rest = rest[~ok]
            cell = np.concatenate(cell)
            if len(cell) > 1:
                off = np.abs(parts[cell] - np.median(parts[cell], axis=0)).sum(1)
                pivot = cell[np.lexsort((node[base + cell], off))[0]]
                others = cell[cell != pivot]
                found.append(np.stack([np.full(len(others), node[base + pivot]), node[base + others]], 1))
    stars, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return pa.table({"pivot": pa.array(stars[:, 0], pa.int64()), "node": pa.array(stars[:, 1], pa.int64()), "n": pa.array(n, pa.int64())})


def merged(stars: DataFrame, rounds: int = 2) -> DataFrame:
    """stars (pivot, node, n) with each cell moved as a whole to the most elected pivot among its own nodes.

    The regions of a family may elect different pivots; cells that hold each other's pivots become one.
    """
    stars = cut(stars.groupBy("pivot", "node").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        score = stars.groupBy("pivot").agg(F.sum("n").alias("score"))
        own = stars.select("pivot", "node").union(stars.select("pivot", "pivot").distinct())
        best = own.join(score.select(F.col("pivot").alias("node"), "score"), "node").groupBy("pivot").agg(F.max(F.struct("score", "node"))["node"].alias("best"))
        moved = stars.join(best, "pivot").select("best", "node", "n").union(best.select("best", "pivot", F.lit(1).cast("long")))
        stars = cut(moved.where("best != node").groupBy(F.col("best").alias("pivot"), "node").agg(F.sum("n").alias("n")))
    return stars.select("pivot", "node")


def sets_of(rows: DataFrame, stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes, leads (is a pivot) and follows (is a member) of the stars' nodes.

    Texts are read again, and only these sets are shuffled.
    """
    ends = stars.select("node", F.lit(False).alias("leads"), F.lit(True).alias("follows")).union(stars.select("pivot", F.lit(True), F.lit(False)))
    ends = ends.groupBy("node").agg(F.max("leads").alias("leads"), F.max("follows").alias("follows"))
    wanted = cut(ends.join(nodes.select("node", "key"), "node"))
    bits = rows.sparkSession.sparkContext.broadcast(sieve(wanted.select("key")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            few = whole.filter(pa.array(passes(bits.value, whole.column(0).to_numpy())))
            for batch in slices(iter([few]), most=SLICE):
                h, at = shingle_sets(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "hashes"])

    built = rows.select("key", "text").mapInArrow(build, "key long, hashes binary")
    return cut(wanted.join(built, "key").select("node", "hashes", "leads", "follows").dropDuplicates(["node"]))


def measured(stars: DataFrame, members: DataFrame, pivots: DataFrame) -> DataFrame:
    """stars (with pivot and node) and ``both``, the exact size of the intersection of the two sets."""
    at = len(stars.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), assume_unique=True))
                for x, y in zip(batch.column(at), batch.column(at + 1), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(both, pa.int64())], names=[*batch.schema.names[:at], "both"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stars.schema.fields)
    own = stars.columns
    joined = stars.join(members.select("node", F.col("hashes").alias("y")), "node").join(pivots.select(F.col("node").alias("pivot"), F.col("hashes").alias("x")), "pivot")
    return joined.select(*own, "x", "y").mapInArrow(run, f"{types}, both long")


def still_open(cells: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members (cell, node, gap, n_shingles, label, straggler) of the cells with several clusters.

    A straggler is outside the cell's largest cluster.
    """
    labels = components(edges, 3)
    full = cells.join(nodes.select("node", "n_shingles"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = full.groupBy("cell", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cell").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count("*").alias("clusters")).where("clusters > 1")
    return cut(full.join(largest, "cell").select("cell", "node", "gap", "n_shingles", "label", (F.col("label") != F.col("largest")).alias("straggler")))


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these nodes; at most ``FEW`` names are broadcast, more are joined."""
    nodes = cut(nodes.select("node").distinct())
    return sets.join(F.broadcast(nodes) if nodes.count() <= FEW else nodes, "node", "left_semi").select("node", "hashes")


def divided(cells: DataFrame, sets: DataFrame, nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(cells, links to the fresh pivots): large cells of ``still_open`` as Voronoi regions of fresh pivots.

    A region has those nearest to its pivot and, by the triangle inequality, all that a link of theirs can reach.
    A cell that this doesn't halve, as its members lie within that reach of each other, stays whole.
    """
    large = cells.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > LEAF)
    parts = cut(cells.join(large, "cell"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(level), "node"), "node")
    fresh = parts.where("straggler").select("cell", F.col("node").alias("pivot"), F.row_number().over(order).alias("k")).where(F.col("k") <= PIVOTS)
    fresh = cut(fresh.select("cell", "pivot"))
    stars = parts.select("cell", "node", "gap", "members").join(fresh, "cell")  # PIVOTS rows a member
    counts = measured(stars, only(sets, parts), only(sets, fresh.select(F.col("pivot").alias("node"))))
    size = nodes.select("node", "n_shingles")
    counts = cut(counts.join(size, "node").join(size.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("m")), "pivot"))
    counts = counts.withColumn("distance", 1 - F.col("both") / (F.col("n_shingles") + F.col("m") - F.col("both")))
    near = counts.groupBy("cell", "node").agg(F.min("distance").alias("least"))
    reach = 2 * (1 - SHARE / 100) + 1e-9
    regions = cut(counts.join(near, ["cell", "node"]).where(F.col("distance") <= F.col("least") + reach))
    halved = regions.groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.first("members").alias("members")).groupBy("cell").agg(F.max(F.col("n") * 2 > F.col("members")).alias("whole"))
    gap = F.col("n_shingles") + F.col("m") - 2 * F.col("both")
    new = regions.join(halved.where("not whole"), "cell", "left_semi").select(F.xxhash64("cell", "pivot", F.lit(level)).alias("cell"), "node", gap.alias("gap"))
    old = cells.join(halved.where("not whole"), "cell", "left_anti").select("cell", "node", "gap")
    close = counts.where((F.col("both") * 100 >= SHARE * (F.col("n_shingles") + F.col("m") - F.col("both"))) & (F.col("node") != F.col("pivot")))
    return cut(old.union(new)), close.select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all sets of a with all of b."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64)
    h, g = np.concatenate(a), np.concatenate(b)
    of_h, of_g = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(y) for y in b])
    universe = np.intersect1d(distinct(h), distinct(g), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    at_h, at_g = np.searchsorted(universe, h), np.searchsorted(universe, g)
    ok_h, ok_g = (universe[np.minimum(at, len(universe) - 1)] == x if len(universe) else np.zeros(len(x), bool) for at, x in ((at_h, h), (at_g, g)))
    at_h, of_h, at_g, of_g = at_h[ok_h], of_h[ok_h], at_g[ok_g], of_g[ok_g]
    step = 4096
    by_h, by_g = np.argsort(at_h, kind="stable"), np.argsort(at_g, kind="stable")
    at_h, of_h, at_g, of_g = at_h[by_h], of_h[by_h], at_g[by_g], of_g[by_g]
    for s in range(0, len(universe), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        i, j = np.searchsorted(at_h, (s, s + step)), np.searchsorted(at_g, (s, s + step))
        x[of_h[i[0] : i[1]], at_h[i[0] : i[1]] - s] = 1
        y[of_g[j[0] : j[1]], at_g[j[0] : j[1]] - s] = 1
        out += x @ y.T
    return out.astype(np.int64)


def leaf_links(table: pa.Table) -> pa.Table:
    """Of each pair of blocks, a link for each straggler and each other cluster that it has a link to."""
    key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cell", "left", "right")], 1)
    node, n, gap, label = (table[c].to_numpy() for c in ("node", "n_shingles", "gap", "label"))
    first = table["first"].to_numpy(zero_copy_only=False).astype(bool)
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["hashes"]]
    by = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    key = key[by]
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True]) if len(key) else np.zeros(1, np.int64)
    found = [np.empty((0, 2), np.int64)]
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        a, b = by[s:e][first[by[s:e]]], by[s:e][~first[by[s:e]]]
        may = within(np.abs(gap[a][:, None] - gap[b]), n[a][:, None], n[b]) & (label[a][:, None] != label[b])
        a, may = a[may.any(1)], may[may.any(1)]
        b, may = b[may.any(0)], may[:, may.any(0)]
        if not len(a):
            continue
        both = intersections([sets[i] for i in a], [sets[j] for j in b])
        i, j = np.nonzero(may & linked(both, n[a][:, None], n[b]))
        if len(i):
            one = np.unique(np.stack([node[a[i]], label[b[j]]], 1), axis=0, return_index=True)[1]
            found.append(np.stack([node[a[i[one]]], node[b[j[one]]]], 1))
    out = np.concatenate(found)
    return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})


def leaves(cells: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between stragglers and others of the cells of ``still_open``, compared in pairs of blocks."""

    def blocks(nodes, shingles):
        return F.ceil(F.greatest(nodes / BLOCK_NODES, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")

    straggler = F.col("straggler")
    sizes = cells.groupBy("cell").agg(
        blocks(F.count_if(straggler), F.sum(F.when(straggler, F.col("n_shingles")).otherwise(0))).alias("lefts"),
        blocks(F.count("*"), F.sum("n_shingles")).alias("rights"),
    )
    placed = cells.join(sizes, "cell")
    # as many groups as hold two blocks' rows each, so that a group stays as small however many pairs of blocks there are
    sent = placed.agg(F.sum(F.when(straggler, F.col("rights")).otherwise(0) + F.col("lefts")).alias("rows"), F.sum((F.when(straggler, F.col("rights")).otherwise(0) + F.col("lefts")) * F.col("n_shingles")).alias("shingles")).first()
    n = max(n, -(-(sent.rows or 0) // (2 * BLOCK_NODES)), -(-(sent.shingles or 0) // (2 * BLOCK_SHINGLES)))
    at = F.xxhash64("node")
    own = ["cell", "node", "n_shingles", "gap", "label"]
    left = placed.where(straggler).select(*own, F.pmod(at, "lefts").cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"), F.lit(True).alias("first"))
    right = placed.select(*own, F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), F.pmod(at, "rights").cast("int").alias("right"), F.lit(False).alias("first"))
    bucket = F.pmod(F.xxhash64("cell", "left", "right"), F.lit(n)).alias("bucket")
    rows = left.union(right).join(only(sets, cells), "node").withColumn("bucket", bucket)
    return rows.groupBy("bucket").applyInArrow(leaf_links, "a long, b long").distinct()


def links(rows: DataFrame, nodes: DataFrame, shared: np.ndarray) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links; rows has key and text."""
    n = n_buckets(rows)
    bucket = F.pmod("list", F.lit(n)).alias("bucket")
    lists = region_lists(rows, shared, n).join(nodes.select("node", "n_shingles", "parts"), "node").withColumn("bucket", bucket)
    stars = merged(lists.groupBy("bucket").applyInArrow(cells_in, "pivot long, node long, n long"))
    sets = sets_of(rows, stars, nodes)
    size = nodes.select("node", "n_shingles")
    counted = measured(stars, sets.where("follows"), sets.where("leads")).join(size, "node").join(size.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("m")), "pivot")
    counted = cut(counted.withColumn("linked", 100 * F.col("both") >= SHARE * (F.col("n_shingles") + F.col("m") - F.col("both"))))
    edges = counted.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    gap = (F.col("n_shingles") + F.col("m") - 2 * F.col("both")).alias("gap")
    cells = counted.select(F.col("pivot").alias("cell"), "node", gap).union(counted.select("pivot", "pivot", F.lit(0).cast("long")).distinct())
    cells = still_open(cells, edges, nodes)
    most = 0
    for level in range(LEVELS):
        last, most = most, cells.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        if most <= LEAF or most == last:
            break
        parts, close = divided(cells, sets, nodes, level)
        edges = cut(edges.union(close))
        cells = still_open(parts, edges, nodes)
    return edges.union(leaves(cells, sets, n))


def node_table(rows: DataFrame) -> DataFrame:
    """doc_id, key, node, twin (another hash), n_shingles, parts and further columns of every row; rows has key and text."""
    more = [c for c in rows.columns if c not in ("doc_id", "key", "text")]
    types = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            h, at = shingle_sets(batch.column(2))
            parts = [parts_of(h[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names_of(h, at)), pa.array(names_of(h, at, 1)), pa.array(np.diff(at), pa.int64()), pa.array(parts, pa.binary()), *batch.columns[3:]], names=["doc_id", "key", "node", "twin", "n_shingles", "parts", *more])

    return rows.select("doc_id", "key", "text", *more).mapInArrow(run, "doc_id long, key long, node long, twin long, n_shingles long, parts binary" + types)


def join_components(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    With ``row``, a column that tells rows apart, it is returned too, and ``label``: equal within a component
    even where all its ids are null, and null for a text without shingles, which is like no other.
    """
    more = [row] if row else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    named = cut(node_table(rows))
    once = named.where("n_shingles > 0").groupBy("node", "twin").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("parts").alias("parts"))
    once = cut(once)
    shared = np.array([r.node for r in once.groupBy("node").count().where(F.col("count") > 1).select("node").collect()], np.int64)  # chance alone: a handful at 10^10 sets
    name = F.when(F.col("node").isin(shared.tolist()), F.col("twin")).otherwise(F.col("node")) if len(shared) else F.col("node")
    nodes = once.withColumn("node", name).drop("twin")
    full = nodes.select("node", "first").join(components(links(rows, nodes, shared)), "node", "left")
    label = F.coalesce("label", "node")
    least = full.groupBy(label.alias("label")).agg(F.min("first").alias("component_id"))
    full = cut(full.select("node", label.alias("label")).join(least, "label").select("node", "component_id", "label"))
    out = named.withColumn("node", name).join(full, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *([row, "label"] if row else []))
