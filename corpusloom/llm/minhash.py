"""Near-duplicate groups by min-max hashing.

Each of PERMUTATIONS hash functions is evaluated once for every word shingle of a text and gives two signature
values, its smallest and its largest hash. For a random permutation both coincide in two texts with probability equal
to the Jaccard similarity of their shingle sets, so the mean of the 2 * PERMUTATIONS agreements is an unbiased
estimate; as minimum and maximum are negatively correlated, its variance is lower than with as many independent
minima, at half of the evaluations (Ji et al., "Min-Max Hash for Jaccard Similarity", ICDM 2013).

Plan: each task signs a text once, however often it reads it, and the signatures are written once to the shared folder;
bands of ROWS values or fewer are shuffled as (bucket, text) pairs without signatures. There is one band more than values
may differ at the threshold, so similar texts always share one. The pairs are sorted by range over all buckets, so that
a bucket that holds a third of the corpus is spread over many tasks; each text is joined to the first one of its bucket
in its task and to the one before it in the order of another part of the signature, and the firsts of a bucket's tasks
are joined in turn. So thousands of copies cost a linear number of edges and no bucket is cut.
Edges are verified on whole signatures, and groups are the connected components of what remains.

These edges don't try all pairs of a bucket. Where a bucket still has texts of several groups, every pair of different
groups in it is compared, in tiles of TILE texts a side; the links that are found join groups. So two texts are in one
group exactly if a chain of texts leads from one to the other in which neighbours are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Words of a shingle; hash functions; values of a band at most; estimated similarity from which texts are near copies.
SHINGLE, PERMUTATIONS, ROWS, THRESHOLD = 3, 64, 4, 0.7

_MULTIPLY = (np.random.default_rng(20).integers(0, 1 << 32, 4096, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = np.random.default_rng(21).integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32)
_BLOCK = 1 << 15
#: Texts of a bucket that are compared with as many others at once.
TILE = 2048


def shingles(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, flat, and their offsets. Fewer words than a shingle make one shorter shingle; no word, none."""
    data, offsets = common.flat(column)
    starts, ends = common.words(data)
    h = common.hash_spans(data, starts, ends)
    first = common.counts_by_row(starts, offsets)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(len(n)), n)
    at = first[:-1][rows] + np.arange(out_first[-1]) - out_first[:-1][rows]
    last = first[1:][rows]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(shingle, np.uint64)])
    for k in range(shingle):
        there = np.where(at + k < last, padded[at + k], np.uint64(k + 1))
        out = out * np.uint64(0x100000001B3) + there
    return common.mix(out), out_first


def signatures(column: pa.Array, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> np.ndarray:
    """One row a text: the minima under each permutation, then the maxima, as uint32. Texts without a word have zeros."""
    h, first = shingles(column, shingle)
    n = len(first) - 1
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((n, 2 * permutations), np.uint32)
    if not len(some):
        return out
    # Blocks that stay in the cache for all permutations.
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = first[:-1][some]
    block_first = np.searchsorted(starts, np.arange(0, len(x), _BLOCK), side="right") - 1
    low = np.full((len(some), permutations), 0xFFFFFFFF, np.uint32)
    high = np.zeros((len(some), permutations), np.uint32)
    buffer = np.empty(_BLOCK, np.uint32)
    for b, begin in enumerate(range(0, len(x), _BLOCK)):
        end = min(len(x), begin + _BLOCK)
        a = block_first[b]
        z = np.searchsorted(starts, end, side="left")
        cuts = np.maximum(starts[a:z] - begin, 0)
        part, got = x[begin:end], buffer[: end - begin]
        for k in range(permutations):
            np.multiply(part, _MULTIPLY[k], out=got)
            got += _ADD[k]
            low[a:z, k] = np.minimum(low[a:z, k], np.minimum.reduceat(got, cuts))
            high[a:z, k] = np.maximum(high[a:z, k], np.maximum.reduceat(got, cuts))
    out[some, :permutations] = low
    out[some, permutations:] = high
    return out


def least_agreements(threshold: float, width: int) -> int:
    """How many of width values must agree for verified()."""
    return int(np.ceil((threshold - 1e-9) * width))


def band_cuts(width: int, rows: int = ROWS, threshold: float = THRESHOLD) -> np.ndarray:
    """Where the bands of a signature begin, and its end. Bands have `rows` values, or fewer so that there is one band more than values may differ at the threshold: then similar texts share one band at least, whatever values differ."""
    bands = min(max(width // rows, width - least_agreements(threshold, width) + 1), width)
    return np.arange(bands + 1) * width // bands


def band_keys(signature: np.ndarray, rows: int = ROWS, threshold: float = THRESHOLD) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature; the values are taken in the order of the permutations, of each the minimum and then the maximum."""
    n, width = signature.shape
    cuts = band_cuts(width, rows, threshold).tolist()
    keys = np.empty((n, len(cuts) - 1), np.uint64)
    for b, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        k = np.full(n, b + 1, np.uint64)
        for v in range(begin, end):
            k = common.mix(k * np.uint64(37 if v % 2 else 31) + signature[:, v // 2 + v % 2 * (width // 2)])
        keys[:, b] = k
    return keys


def _sign(permutations: int, shingle: int, rows: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in common.slices(batch, 1):
                # Equal texts of a task are signed once.
                new = [h not in seen and not seen.add(h) for h in part.column(0).to_pylist()]
                part = part.filter(pa.array(new, pa.bool_()))
                s = signatures(part.column(1), permutations, shingle)
                some = s.any(axis=1)
                if not some.any():
                    continue
                keep, s = part.column(0).filter(pa.array(some)), np.ascontiguousarray(s[some])
                keys = common.signed(band_keys(s, rows, threshold))
                n = len(s)
                yield pa.record_batch(
                    [
                        keep,
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(s.shape[1] * 4), n, [None, pa.py_buffer(s.tobytes())]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))),
                    ],
                    names=["h", "signature", "keys"],
                )

    return run


def text_key(text: str = "text") -> Column:
    """The identity of a content: equal texts share it. Null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def verified(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return (a == b).mean(axis=1) >= threshold - 1e-9


_JOINED = "a long, b long, key long"
#: The bits of a bucket's key that give way to bits of another band, by which the bucket is ordered: 48 bits tell the buckets apart, and two that fall together only cost comparisons.
_ORDER = 0xFFFF


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, h) in the order of key, of which the lowest bits don't count (_ORDER): (first of the key, h, key) for each further h; pairs of each h with the one before it, without key; and, for the first and the last key of the task, which may go on in other tasks, its first h twice and the key."""
    last = first = before = None
    edge: list[tuple[int, int]] = []

    def out(a, b, key=None):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, h = (batch.column(k).to_numpy() for k in (0, 1))
        key = key & ~np.int64(_ORDER)
        if last is None:
            edge.append((int(key[0]), int(h[0])))
        new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        hub = h[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        if not new[0]:
            hub[: starts[0] if len(starts) else len(h)] = first
        previous = np.concatenate([[h[0] if new[0] else before], h[:-1]])
        previous[new] = h[new]
        some = hub != h
        yield out(hub[some], h[some], key[some])
        some &= (previous != h) & (previous != hub)
        yield out(np.minimum(previous, h)[some], np.maximum(previous, h)[some])
        last, first, before = int(key[-1]), int(hub[-1]), int(h[-1])
    if last is not None:
        edge.append((last, first))
        yield out([x for _, x in edge], [x for _, x in edge], [k for k, _ in edge])


def candidates(signed: DataFrame, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, joined): distinct pairs (a, b), a < b, of contents that share a bucket and are next to each other or to the bucket's first; the contents (key, h) of all buckets of several; the table that both are read from."""
    buckets = signed.select("h", F.posexplode("keys").alias("band", "key"), F.element_at("keys", -1).alias("by_last"), F.element_at("keys", 1).alias("by_first"))
    by = F.when(F.col("band") * 2 < bands, F.col("by_last")).otherwise(F.col("by_first"))
    buckets = buckets.filter("key is not null").select(F.col("key").bitwiseAND(~_ORDER).bitwiseOR(by.bitwiseAND(_ORDER)).alias("key"), "h")
    ordered = buckets.repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    joined = common.materialise(ordered.mapInArrow(_join_up, _JOINED), "minhash-joined")
    # A bucket that goes over several tasks: its firsts are joined to the least of them.
    firsts = joined.filter("key is not null and a = b").select("key", F.col("a").alias("h")).distinct()
    least = firsts.groupBy("key").agg(F.min("h").alias("least"))
    across = firsts.join(least, "key").filter("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    within = joined.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = joined.filter("key is not null").select("key", F.explode(F.array("a", "b")).alias("h")).distinct()
    return within.unionByName(across).distinct(), members, joined


#: Bits of a map of contents, as a power of 2: 16 to 32 a content and 16 MB at most. If there are more contents, more of the others pass, too.
_MAP = 27


def signatures_of(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, signature) of the contents of wanted (h, repeated or not). Signatures pass a bit map of them before they are shuffled."""
    spark = signed.sparkSession
    mask = (1 << min(_MAP, max(16, (16 * wanted.count() - 1).bit_length()))) - 1
    place = F.col("h").bitwiseAND(mask)
    words = wanted.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros((mask + 1) // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & mask
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    passed = signed.select("h", "signature").filter(may_be("h"))
    return passed.join(wanted.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("signature").alias("signature"))


def links(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, need: int) -> set[tuple[int, int]]:
    """Pairs of groups that at least one pair of similar texts joins: of a text of left and one of right, or of two of left if right is None. Each side is (groups, signatures); need values must agree.

    The number of values that differ is a metric, so texts whose distances from a third one differ by more than is allowed are
    not compared. Others are compared by one byte of each value first, which never takes similar texts for different ones.
    """
    far = left[1].shape[1] - need
    pivot = left[1][0]

    def ordered(side):
        group, s = side
        d = (s != pivot).sum(axis=1)
        by = np.argsort(d, kind="stable")
        return group[by], s[by], d[by]

    g, s, d = ordered(left)
    og, os, od = (g, s, d) if right is None else ordered(right)
    # The value's bytes added up, as the highest ones of a minimum are all alike.
    low, olow = (np.ascontiguousarray((x.view(np.uint8).reshape(*x.shape, 4).sum(axis=2, dtype=np.uint8))) for x in (s, os))
    olow = np.ascontiguousarray(olow.T)
    counter = np.uint8 if len(olow) < 256 else np.uint32
    begin, end = np.searchsorted(od, d - far), np.searchsorted(od, d + far, side="right")
    if right is None:
        begin = np.maximum(begin, np.arange(len(d)) + 1)
    found: set[tuple[int, int]] = set()
    for i in range(len(d)):
        if begin[i] >= end[i]:
            continue
        w = slice(begin[i], end[i])
        agree = np.add.reduce((olow[:, w] == low[i][:, None]).view(np.uint8), axis=0, dtype=counter)
        at = np.flatnonzero((agree >= need) & (og[w] != g[i])) + begin[i]
        if len(at):
            for o in np.unique(og[at[(os[at] == s[i]).sum(axis=1) >= need]]).tolist():
                found.add((min(int(g[i]), o), max(int(g[i]), o)))
    return found


def _compare(need: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, i, j, side, root, signature) in the order of (key, i, j): links of the groups of each tile."""
        tile, rows = None, []

        def close():
            side, root, s = (np.concatenate([r[k] for r in rows]) for k in range(3))
            two = side.any() and not side.all()
            first = side == side[0]
            return links((root[first], s[first]), (root[~first], s[~first]) if two else None, need)

        found: set[tuple[int, int]] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, side, root = (batch.column(k).to_numpy() for k in range(5))
            s = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(-1, width)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                here = (int(key[a]), int(i[a]), int(j[a]))
                if tile is not None and here != tile:
                    found |= close()
                    rows = []
                tile = here
                rows.append((side[a:b], root[a:b], s[a:b]))
        if tile is not None:
            found |= close()
        if found:
            a, b = zip(*sorted(found))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tiles(least: int) -> Column:
    """The tiles (i, j, side) in which a row of a bucket is compared. A bucket of at most `least` rows is one tile. Else its largest group is not compared in itself: its blocks i meet the blocks j of all others, and the others' blocks meet each other."""
    tile = "struct(cast({} as long) as i, cast({} as long) as j, cast({} as long) as side)"
    one = f"array({tile.format(0, 0, 0)})"
    own = "pmod(h, {})"
    large = f"transform(sequence(0L, others - 1), k -> {tile.format(own.format('blocks'), 'k', 0)})"
    mine = own.format("others")
    other = f"transform(sequence(0L, blocks - 1), k -> {tile.format('k', mine, 1)})"
    each = f"transform(sequence(0L, others - 1), k -> {tile.format(f'-1 - least(k, {mine})', f'greatest(k, {mine})', f'if({mine} > k, 1, 0)')})"
    return F.expr(f"case when n <= {least} then {one} when root = largest then {large} else concat({other}, {each}) end")


def between_groups(members: DataFrame, rooted: DataFrame, signed: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b), a < b: roots of groups that a similar pair in one bucket joins. members has (key, h), rooted (v, root); a content that isn't in rooted is its own group."""
    labelled = members.join(rooted.withColumnRenamed("v", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    labelled = common.materialise(labelled, "minhash-members")
    by_group = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_group.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("groups"))
    # Two contents of a bucket have been compared as its first and the next.
    mixed = mixed.filter("groups > 1 and n > 2").select("key", "n", F.col("most.root").alias("largest"), F.ceil(F.col("most.n") / TILE).alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / TILE).alias("others"))
    tiled = labelled.join(mixed, "key").select("key", "h", "root", _tiles(TILE).alias("tiles"))
    tiled = common.materialise(tiled, "minhash-tiles")
    whole = signatures_of(signed, tiled.select("h"))
    rows = tiled.join(whole, "h").select("key", F.explode("tiles").alias("t"), "root", "signature").select("key", "t.i", "t.j", "t.side", "root", "signature")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = common.materialise(rows.mapInArrow(_compare(least_agreements(threshold, width), width), "a long, b long").distinct(), "minhash-links")
    common.discard(labelled, tiled)
    return found


def rooted(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = ROWS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(contents, roots): contents has (h, doc_id, copies, chars): each distinct text once, under its smallest id; roots has (v, root) of every content that is similar to another one."""
    common.small_batches(docs.sparkSession)
    named = docs.select("doc_id", "text")
    signed = named.filter(F.length("text") > 0).select(text_key().alias("h"), "text").mapInArrow(_sign(permutations, shingle, rows, threshold), "h long, signature binary, keys array<long>")
    signed = common.materialise(signed, "minhash-signatures")
    pairs, members, joined = candidates(signed, len(band_cuts(2 * permutations, rows, threshold)) - 1)
    pairs = common.materialise(pairs, "minhash-candidates")
    one = signatures_of(signed, pairs.select(F.explode(F.array("a", "b")).alias("h")))
    left, right = one.select(F.col("h").alias("a"), F.col("signature").alias("sa")), one.select(F.col("h").alias("b"), F.col("signature").alias("sb"))
    width = 2 * permutations

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, width) for k in (2, 3))
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(verified(a, b, threshold)))

    found = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")
    contents = named.groupBy(text_key().alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    found = common.materialise(found, "minhash-edges")
    common.discard(pairs)
    roots = components(found)
    more = between_groups(members, roots, signed, threshold, width)
    common.discard(signed, joined, found)
    if more.limit(1).count():
        again = components(more)
        common.discard(more)
        moved = roots.join(again.select(F.col("v").alias("root"), F.col("root").alias("least")), "root", "left").select("v", F.coalesce("least", "root").alias("root"))
        roots = moved.union(again.join(roots.select("v"), "v", "left_anti").select("v", "root"))
    return contents, roots


def _lower(pairs: DataFrame, to_itself: bool) -> DataFrame:
    """(v, m): the least neighbour of each vertex, or itself. By partial minima, so that a vertex with very many neighbours doesn't meet in one task."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return least.select(F.col("a").alias("v"), F.least("a", "m").alias("m") if to_itself else F.col("m"))


def components(pairs: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each vertex's connected component, by alternating large-star and small-star rounds until nothing changes."""
    current, tables = pairs.select("a", "b"), []
    for _ in range(60):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every greater neighbour is joined to the least of the neighbourhood.
        large = both.filter("b > a").join(_lower(both, True).withColumnRenamed("v", "a"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the vertex and its smaller neighbours are joined to the least of them.
        least = large.join(_lower(large, False).withColumnRenamed("v", "a"), "a")
        small = least.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        new = common.materialise(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "components")
        common.discard(*tables)
        tables = [new]
        # A star forest: each greater vertex has one edge, and no root is a greater vertex.
        state = new.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
        chained = new.select(F.col("a").alias("v")).join(new.select(F.col("b").alias("v")), "v", "left_semi").limit(1).count()
        current = new
        if (state.n or 0) <= 1 and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct()
    return roots.union(current.select(F.col("b").alias("v"), F.col("a").alias("root")))


def groups(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(h, root, doc_id, copies, group_id, group_rows, winner): every content in a group of two rows or more; group_id is the smallest doc_id of the group, winner the content that stays."""
    contents, roots = rooted(docs, threshold, permutations, rows, shingle)
    contents = contents.filter("chars > 0")
    grouped = contents.join(roots.withColumnRenamed("v", "h"), "h", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "h"))
    # By partial aggregates: a group may be very large.
    best = grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.sum("copies").alias("group_rows"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("h"))).getField("h").alias("winner"))
    return grouped.join(best, "root").select("h", "root", "doc_id", "copies", "group_id", "group_rows", "winner")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, group_id, group_size, kept) for every document in a group of near or exact copies; group_id is the smallest doc_id of the group and the one that is kept.

    Null and empty texts and texts without a word character belong to no group, unless the latter are equal. Repeated
    rows count as copies of each other: all of them are listed and one is kept. Equal ids with different texts in one
    group: that with the least content hash is kept. A null doc_id is listed as null and kept only if no other row of
    the group has an id. Very long texts are signed whole. Further columns are ignored. An empty table gives no row.
    """
    found = common.materialise(groups(docs, **options), "minhash-groups")
    ids = docs.select("doc_id", text_key().alias("h"))
    # Rows that are alike (same id and text) are counted, and listed as often again: one of those that stay is kept.
    alike = ids.join(found.select("h", "group_id", "group_rows", "winner"), "h").groupBy("doc_id", "h", "group_id", "group_rows", "winner").agg(F.count("*").alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("h") == F.col("winner"))
    listed = alike.select("doc_id", "group_id", F.col("group_rows").alias("group_size"), stays.alias("stays"), F.explode(F.expr("sequence(1L, n)")).alias("i"))
    return listed.select("doc_id", "group_id", "group_size", (F.col("stays") & (F.col("i") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row of each group, all input columns unchanged, whatever their names; the row with the smallest doc_id stays, of rows alike any one. Nulls and texts in no group stay, as near_duplicates says."""
    h, group, winner = common.unused(docs, "_cl_h", "_cl_id", "_cl_winner")
    found = common.materialise(groups(docs, **options).select("h", "group_id", "winner").toDF(h, group, winner), "minhash-verdicts")
    joined = docs.withColumn(h, text_key()).join(common.broadcast_if_small(found, found.count() * 24), h, "left")
    columns = [common.column(c) for c in docs.columns]
    alone = joined.filter(F.col(winner).isNull()).select(*columns)
    best = joined.filter(F.col(winner).isNotNull() & (F.col(h) == F.col(winner)) & F.col("doc_id").eqNullSafe(F.col(group)))
    return alone.union(best.dropDuplicates([h]).select(*columns))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_minhash_near_dedup": op6_minhash}
ORACLE: dict[str, str] = {}
