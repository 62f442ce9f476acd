"""Near-duplicate components by HyperMinHash.

A document is its set of distinct shingles of `words` words (two unless told otherwise), each a 64-bit hash
(two words of one document clash with a chance below 1e-9). Its sketch has 512 registers: a shingle's hash picks one, and the register keeps
the smallest remaining hash as a leading-zero count (6 bits) and the 10 bits after the first one.

1. Documents with equal sets form a class; one row a class goes on, so exact copies are never paired.
2. Bands of registers are hashed. Sets of 512 shingles and more have 64 bands of 8 registers. Smaller sets fill
   few registers, so their bands are cut by size: sets of like size (levels a quarter apart; a set joins its
   own level and that of a set four fifths as large) spread the registers over as many bands as sets with
   similarity 0.8 can have different elements, plus one, again and again until there are 48. Bands with fewer
   than four filled registers are left out, as common word pairs alone would fill them. Two sets of 32 and
   more shingles with similarity 0.8 share no band with a chance of about 2e-5 or less. Registers of smaller
   sets are mostly empty, so those have the n - ceil(0.8 n) + 1 smallest of their n hashes as bands, and so
   has a set that is up to a quarter larger than 31: two sets with similarity 0.8 always share one of these
   (both would else lack more than a fifth of the other's hashes), at the level of the smaller set.
3. Every class is compared with the smallest member of each of its bands, each pair once. Bands whose members
   are then still in several components are settled in blocks: their members' sets (as 32-bit hashes) meet in
   groups of at most 2048 by 2048, where products of incidence matrices find similar pairs across components;
   only links that join something leave a block. A larger band is dealt to every pair of its blocks, so no
   band is capped and no task holds more than two blocks.
4. Before a pair's texts meet, the similarity estimated from the registers, corrected for the chance
   agreement of compressed registers, must come within six standard errors of the limit. Then the full sets
   decide: 100 * intersection >= 80 * union.
5. Links become components by large-star and small-star rounds, a table a round. The links of the blocks join
   components, so only these go through rounds again.

Every text moves once, into a table bucketed by row number; later steps take from it the columns and rows that
they need without moving the rest. Joins of texts and sketches on hot keys have plain exchanges on both sides, so
adaptive execution splits them; windows over bands and nodes see rows of a few numbers. Nothing of the corpus
is collected: the driver only counts.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer
words than a shingle is a set of one; every row is a document, also rows that repeat a doc_id, whose texts may differ; a
component is named by its smallest doc_id; a row without doc_id links with nothing (null component, kept); extra
columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import delete, scratch, shared_folder, shuffle_partitions, text_of, written

REGISTERS, BANDS = 512, 64
#: Below SMALL shingles the smallest hashes are the bands; a band of registers needs LEAST filled ones; from LONG on there is one level for all.
SMALL, LONG, LEAST = 32, 512, 4
SMALLER_BANDS = 48
MANTISSA_BITS, ZERO_BITS = 10, 6
U64 = np.uint64
#: Odd constants of a 64-bit mixer.
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Members of a band that meet in one block.
BLOCK = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), U64(base))
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(text: str, words: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_LOWER), dtype=np.uint8)
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[raw]
    edges = np.diff(word)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return np.empty(0, dtype=U64)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw))[: len(raw)], out=total[1:])
    hashes = mixed((total[end] - total[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(U64))
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    out = hashes[:n]
    for i in range(1, width):
        out = mixed(out * U64(3) + mixed(hashes[i : i + n] + U64(7)))
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """512 registers of 16 bits: 1 + leading zeros, then mantissa; 0 where no shingle fell."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(hashes):
        return out
    index = (hashes & U64(REGISTERS - 1)).astype(np.intp)
    rest = mixed(hashes) >> U64(1)  # 63 bits, independent of the index
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=U64)
    np.minimum.at(least, index, rest)
    held = least != np.iinfo(np.uint64).max
    x = least[held]
    bits = np.zeros(len(x), dtype=np.int64)  # position of the first one, from below
    probe = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = probe >= U64(1 << step)
        bits += step * more
        probe = np.where(more, probe >> U64(step), probe)
    zeros = np.minimum(62 - bits, (1 << ZERO_BITS) - 2)
    shift = bits - MANTISSA_BITS
    part = np.where(shift >= 0, x >> np.maximum(shift, 0).astype(U64), x << np.maximum(-shift, 0).astype(U64))
    out[held] = ((zeros + 1) << MANTISSA_BITS) | (part & U64((1 << MANTISSA_BITS) - 1)).astype(np.int64)
    return out


def _boundaries() -> list[int]:
    """First sizes of the levels: sets with similarity 0.8 are in one level or in neighbours."""
    out = [1]
    while out[-1] < LONG:
        size = out[-1] + 1
        while -(-4 * size // 5) < out[-1]:
            size += 1
        out.append(size)
    return [x for x in out if x < LONG] + [LONG]


LEVELS = _boundaries()


def _plan(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers in the order of their bands, where each band starts, a salt for each band."""
    if level == len(LEVELS) - 1:
        order, starts = np.arange(REGISTERS), np.arange(0, REGISTERS, REGISTERS // BANDS)
    else:
        largest = LEVELS[level + 1] - 1
        n = largest // 4 + 1
        times = -(-SMALLER_BANDS // n)
        shuffled = [np.argsort(mixed(np.arange(REGISTERS, dtype=U64) + U64(1009 * (t + 1) * (level + 1))), kind="stable") for t in range(times)]
        first = np.arange(n) * REGISTERS // n
        order = np.concatenate(shuffled)
        starts = np.concatenate([first + t * REGISTERS for t in range(times)])
    salt = mixed(np.arange(len(starts), dtype=U64) + U64((level + 1) << 20))
    return order, starts, salt


_PLANS: list = []


def prefix(hashes: np.ndarray) -> np.ndarray:
    """The smallest of a set's sorted hashes, of which similar sets share one; none if no similar set is below SMALL."""
    n = len(hashes)
    least = -(-4 * n // 5)
    return hashes[: n - least + 1] if least < SMALL else hashes[:0]


def bands(sketch: np.ndarray, n: int, first: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys of the bands of a set of n shingles whose prefix is `first`."""
    if not _PLANS:
        _PLANS.extend(_plan(level) for level in range(len(LEVELS)))
    levels = {bisect_right(LEVELS, n) - 1, bisect_right(LEVELS, -(-4 * n // 5)) - 1}
    out = [mixed(first + mixed(U64([(level + 1) << 40]))) for level in levels]
    if n < SMALL:
        return np.concatenate(out).view(np.int64)
    filled = sketch != 0
    part = np.where(filled, mixed(sketch.astype(U64) + (np.arange(1, REGISTERS + 1, dtype=U64) << U64(20))), U64(0))
    for level in levels:
        order, starts, salt = _PLANS[level]
        sums = np.add.reduceat(part[order], starts)
        held = np.add.reduceat(filled[order].astype(np.int64), starts)
        out.append(mixed(sums + salt)[held >= LEAST])
    return np.concatenate(out).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, int]:
    """(similarity, registers used): agreement less what unrelated sets of these sizes agree by chance."""
    used = int(((a != 0) | (b != 0)).sum())
    if not used:
        return 0.0, 0
    same = int(((a == b) & (a != 0)).sum())
    chance = used * _chance(n_a, n_b)
    return max(0.0, (same - chance) / max(1.0, used - chance)), used


def _chance(n_a: int, n_b: int) -> float:
    """Chance that a register of two disjoint sets agrees: both minima fall in one cell of the code."""
    per_a, per_b = max(n_a, 1) / REGISTERS, max(n_b, 1) / REGISTERS
    out, cells = 0.0, 1 << MANTISSA_BITS
    for z in range(24):
        low, width = 2.0 ** -(z + 1), 2.0 ** -(z + 1) / cells
        for x in (low * 1.125, low * 1.375, low * 1.625, low * 1.875):  # four points of each octave
            p = per_a * math.exp(-per_a * x) * width * per_b * math.exp(-per_b * x) * width
            out += p * cells / 4
    return min(out, 0.5)


_SKETCHED = ["row", "doc_id", "text", "n_shingles", "set_key", "sketch", "bands"]


def sketches(documents: DataFrame, words: int = 2) -> DataFrame:
    """row, doc_id, text, n_shingles, set_key (128-bit hash of the set), sketch, bands, in one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"]:
                h = shingles(text, words)
                if not len(h):
                    out.append((0, None, None, None))
                    continue
                first, second, sketch = mixed(h), mixed(h ^ U64(0xD6E8FEB86659FD93)), registers(h)
                key = f"{int(first.sum(dtype=U64)):016x}{int(second.sum(dtype=U64)):016x}"
                out.append((len(h), key, sketch.tobytes(), bands(sketch, len(h), prefix(h))))
            n, keys, held, cut = zip(*out, strict=True) if out else ((), (), (), ())
            yield rows.assign(n_shingles=n, set_key=keys, sketch=held, bands=cut)[_SKETCHED]

    rows = text_of(documents).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(run, "row long, doc_id long, text string, n_shingles long, set_key string, sketch binary, bands array<long>")


class Store:
    """Texts and sketches in a table bucketed by row number: rows are picked by number without moving the others."""

    def __init__(self, documents: DataFrame, words: int = 2):
        self.spark, self.words = documents.sparkSession, words
        self.name = f"strandline_sketches_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self.buckets = n = shuffle_partitions(self.spark)
        (
            sketches(documents, words).repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd").option("path", self.path)
            .format("parquet").saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def pick(self, ids: DataFrame, *columns: str) -> DataFrame:
        """(node, columns) of the documents whose row number is in `ids` (row)."""
        found = self.read().select("row", *columns).join(ids.hint("merge"), "row", "left_semi")
        return written(found.withColumnRenamed("row", "node"), "picked")

    def beside(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """The distinct pairs (a, b) of row numbers with the columns of both rows, named column_a and column_b."""

        def side(x: str) -> DataFrame:
            return self.read().select(F.col("row").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

        # dealt by b as the table is, which serves distinct as well; a is often the same and computed, so that its join has plain exchanges
        with_b = pairs.select("a", "b").repartition(self.buckets, "b").distinct().join(side("b"), "b")
        hubs = side("a").join(pairs.select("a").distinct(), "a", "left_semi").withColumn("a", F.abs("a"))
        return with_b.join(hubs, "a")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _band_rows(classes: DataFrame) -> DataFrame:
    return classes.select("node", F.explode("bands").alias("band"))


def confirmed(pairs: DataFrame, store: Store, percent: int) -> DataFrame:
    """The (written) pairs (a, b) whose full shingle sets are similar enough; sketches rule most others out first."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for sa, sb, na, nb in zip(rows["sketch_a"], rows["sketch_b"], rows["n_shingles_a"], rows["n_shingles_b"], strict=True):
                if 100 * min(na, nb) < percent * max(na, nb):  # their sizes alone rule it out
                    keep.append(False)
                    continue
                s, used = estimate(np.frombuffer(sa, dtype=np.uint16), np.frombuffer(sb, dtype=np.uint16), na, nb)
                limit = percent / 100
                keep.append(s >= limit - 6 * math.sqrt(limit * (1 - limit) / max(used, 1)) - 2 / max(used, 1))
            yield rows.loc[keep, ["a", "b"]]

    candidates = written(store.beside(pairs, "n_shingles", "sketch").mapInPandas(likely, "a long, b long"), "likely")
    words = store.words

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for rows in batches:
            keep = []
            for a, text_a, text_b in zip(rows["a"], rows["text_a"], rows["text_b"], strict=True):
                if a != last:
                    last, held = a, shingles(text_a, words)
                other = shingles(text_b, words)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield rows.loc[keep, ["a", "b"]]

    return written(store.beside(candidates, "text").mapInPandas(similar, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links: component is the smallest node that it reaches."""
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    of_v = Window.partitionBy("v")
    while not _is_settled(edges):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour, or to the node
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.withColumn("m", F.least("v", F.min("u").over(of_v))).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # small star: a node and its smaller neighbours are tied to the smallest of them
        small = large.withColumn("m", F.min("u").over(of_v))
        tied = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))
        edges = written(small.select(F.inline(tied)).where("u < v").distinct(), "edges")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which only nodes hang that nothing hangs on."""
    sides = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.lit(None).cast("long").alias("u")))
    nodes = sides.groupBy("v").agg(F.count("u").alias("up"), F.count(F.when(F.col("u").isNull(), 1)).alias("down"))
    return nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _labelled(rows: DataFrame, parts: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """The rows with the component that each node is in so far."""
    found = rows.join(parts.toDF(node, component), node, "left")
    return found.withColumn(component, F.coalesce(component, node))


def linked_components(store: Store, heads: DataFrame, percent: int) -> DataFrame:
    """(node, component) over classes with a link; see the steps in the module's description."""
    classes = store.read().select("row", "bands").join(heads.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")
    of_band = Window.partitionBy("band")  # a class has one row in each of its bands, so no band has many of all rows
    members = _band_rows(classes.withColumnRenamed("row", "node")).select(
        "band", "node", F.min("node").over(of_band).alias("hub"), F.count(F.lit(1)).over(of_band).alias("n")
    )
    members = written(members.where("n > 1"), "members")
    links = confirmed(members.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")), store, percent)
    parts = components(links)

    # bands whose members are still in several components
    several = written(_labelled(members.where("n > 2").select("band", "node", "n"), parts), "several")
    open_bands = several.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    open_bands = written(open_bands.select("band"), "open")  # so that the join below has plain exchanges
    rows = written(several.join(open_bands, "band"), "rows")
    if rows.isEmpty():
        return parts
    pairs = written(_settled(rows, store, percent), "pairs")
    return parts if pairs.isEmpty() else _joined(parts, confirmed(pairs, store, percent))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """`parts` after links between nodes of different components."""
    ends = _labelled(_labelled(links, parts, "a", "x"), parts, "b", "y")
    above = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # a node of `above` was the smallest of its component, so it is none of those in `parts`
    moved = parts.join(above.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(above)


def _settled(rows: DataFrame, store: Store, percent: int) -> DataFrame:
    """Pairs (a, b) that join components of the (band, node, component, n) rows, by blocks of each band."""
    wanted, words = rows.select(F.col("node").alias("row")).distinct(), store.words

    def short_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            held = [np.unique((shingles(t, words) >> U64(32)).astype(np.uint32)).tobytes() for t in texts["text"]]
            yield pd.DataFrame({"node": texts["node"], "held": held})

    sets = written(store.pick(wanted, "text").mapInPandas(short_sets, "node long, held binary"), "sets")
    blocks = F.ceil(F.col("n") / BLOCK)
    large = rows.where(F.col("n") > BLOCK).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = (
        large.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
        .unionByName(rows.where(F.col("n") <= BLOCK).select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "component"))
        .join(sets, "node")
    )

    def joins(group: pa.Table) -> pa.Table:  # Arrow, as most of the groups are so small that pandas would take most of the time
        found = joining_pairs(group["node"].to_numpy(), group["component"].to_numpy(), group["held"].to_pylist(), percent)
        return pa.table({x: pa.array([pair[i] for pair in found], pa.int64()) for i, x in enumerate("ab")})

    found = dealt.groupBy("band", "i", "j").applyInArrow(joins, "a long, b long")
    return found.distinct()


def joining_pairs(nodes: np.ndarray, parts: np.ndarray, held: list[bytes], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Similar pairs of different parts, as many as it takes to join the parts that similar pairs join."""
    sets = [np.frombuffer(h, dtype=np.uint32) for h in held]
    size = np.array([len(x) for x in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place, often = column[1], column[2]
    row = np.repeat(np.arange(len(sets)), size)
    common = often[place] > 1  # what one set alone holds is in no intersection
    label = np.cumsum(often > 1) - 1
    row, at = row[common], label[place[common]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    shared_by = int((often > 1).sum())
    columns = max(1, min(columns, shared_by))
    for left in range(0, shared_by, columns):  # bounded memory, whatever the sets hold
        part_of = slice(*np.searchsorted(at, [left, left + columns]))
        grid = np.zeros((len(sets), columns), dtype=np.float32)
        grid[row[part_of], at[part_of] - left] = 1
        shared += grid @ grid.T
    names = {p: i for i, p in enumerate(dict.fromkeys(parts.tolist()))}
    part = np.array([names[p] for p in parts.tolist()])
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    union = size[:, None] + size[None, :] - shared
    near = (100 * shared >= percent * union) & (part[:, None] < part[None, :])
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = find(part[i]), find(part[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    return out


def _rows(documents: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles, set_key, t: a hash of the text) of every document, and the component_id of every set; both written."""
    spark = documents.sparkSession
    with scratch(spark):
        store = Store(documents, words)
        thin = written(store.read().select("row", "doc_id", "n_shingles", "set_key", F.xxhash64("text").alias("t")), "thin", keep=True)
        # sets of one key are equal: only the first row of each goes on
        heads = thin.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"))
        heads = written(heads, "heads")
        parts = linked_components(store, heads, percent)
        held = written(heads.join(parts, "node", "left").select("set_key", "low", F.coalesce("component", "node").alias("component")), "held")
        least = held.groupBy("component").agg(F.min("low").alias("component_id"))
        named = written(held.join(least, "component").select("set_key", "component_id"), "named", keep=True)
        store.drop()
    return thin, named


def near_components(documents: DataFrame, percent: int = 80, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; shingles are of `words` words."""
    thin, named = _rows(documents, percent, words)
    joined = thin.where("set_key IS NOT NULL").join(named, "set_key", "left").unionByName(
        thin.where("set_key IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def survivors(documents: DataFrame, percent: int = 80, words: int = 2) -> DataFrame:
    """The rows of `documents` that stay, with all their columns: one document of each component.

    Rows of one doc_id and text fare alike; rows without doc_id all stay.
    """
    thin, named = _rows(documents, percent, words)
    dropped = thin.where("doc_id IS NOT NULL").join(named, "set_key").where("doc_id <> component_id")
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__t"))
    return documents.join(dropped, same, "left_anti").select(*documents.columns)
