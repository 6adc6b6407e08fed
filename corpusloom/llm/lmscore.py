"""Bits per byte under online logistic context mixing.

Predictors: for each order in ORDERS the preceding bytes are a context, and the bits of the next byte, first the
highest, are predicted from how often a 0 and a 1 came there, at the node (context, bits of this byte so far), in the
corpus. A further predictor follows long matches: at anchors, where a hash of the last ANCHOR bytes has zeros at its
end, the text is expected to go on as it did after the same bytes elsewhere, until it doesn't.
Counts are gathered over all documents, and grow with them: none is left out, and order, context and byte fit in 64
bits as they are, so nothing collides (the ANCHOR bytes are hashed to 64 bits).

What is held out: documents are spread over parts of about PART_BYTES (FOLDS at least) by a hash of id and text, and a
part's documents are predicted from the counts of all other parts. So the predictors of a document are fixed before it
is read, no text predicts itself or what follows in it, and what they say of a node hangs only on bytes that have
passed: the probabilities of the 256 next bytes add up to 1, and the sum over all bits is a code length.

Mixing: the predictors' log odds are weighed and added; the weights are chosen by a gate (place of the bit, the longest
context that other parts know, whether a match is followed) and learn online while a document is read, by the gradient
of its code length, in blocks of BLOCK bytes: a block is coded with what the blocks before it taught. Refinement: an
adaptive map from the mixed odds to how often such odds were right in this document so far is averaged with the mix;
odds of 0 stay even.

Log odds are kept relative to the bit that came (positive if the predictor leant to it), which changes nothing in the
sums: mix, weights' gradient and refinement are symmetric in the two values of a bit. So one lookup by (context, byte)
gives the eight log odds of a byte, packed in a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import common

#: Bytes of context of each predictor (6 at most, to fit a key); bytes coded between two updates.
ORDERS, BLOCK = (1, 2, 3, 4, 6), 64
#: Estimator's added count; step of the weights; their first value; buckets of the refinement (odd: the middle one is for even odds) and the weight of what it starts with.
DELTA, RATE, FIRST, BUCKETS, TRUST = 0.4, 0.002, 0.35, 33, 16.0
#: Gates: none or the shortest order known, up to the middle, the longest, a match. Log odds of a match, in sixteenths, and the first value of its weight.
GATES, MATCH_ODDS, MATCH_FIRST = 4, 80, 0.6
#: Bytes of an anchor; zero bits of its hash (one position in 2**ANCHOR_BITS is an anchor); bytes that are expected after it.
ANCHOR, ANCHOR_BITS, FOLLOWER = 24, 5, 48
#: Bytes of text that are coded side by side, and that are counted at once; a longer text is taken in pieces of GROUP_BYTES.
GROUP_BYTES, COUNT_BYTES = 1 << 20, 1 << 19
#: Bytes of text that are looked up or hashed at once, and texts of a block whose odds are worked on at once: what a step reads is then still in the processor's cache. No result hangs on them.
RUN, TEXTS = 1 << 16, 64
#: Bytes of text of a part, about, and parts at least; buckets of contexts for each part.
PART_BYTES, FOLDS, SPLIT = 16 << 20, 8, 2
_SCALE = np.float32(1 / 16)


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte a word of it (lowest) and the 7 bytes before it; bytes before a text count as 0."""
    n = len(data)
    padded = np.zeros(n + 7, np.uint8)
    padded[7:] = data
    out = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    begin = offsets[:-1][np.diff(offsets) > 0]
    end = np.append(begin[1:], n)
    for j in range(min(7, n)):  # not beyond the beginning of a text
        at = begin + j
        out[at[at < end]] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return out


def _key(i: int, window: np.ndarray) -> np.ndarray:
    """The key of a predictor's number, context and byte."""
    key = window & np.uint64((1 << (8 * ORDERS[i] + 8)) - 1)
    key |= np.uint64(i << 56)
    return key


def contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each predictor its number and, for each byte, the key of number, context and the byte itself, as uint64."""
    window = windows(data, offsets)
    for i in range(len(ORDERS)):
        yield i, _key(i, window)


_SPREAD = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the anchors: the ANCHOR bytes before a position, of the same text, have a hash that ends in zeros."""
    n = len(data)

    def joined(long: np.ndarray, short: np.ndarray, size: int) -> np.ndarray:
        """The hash of `size` bytes more, those before; entry i is of the bytes that end at i."""
        out = long.copy()
        out[size:] += short[: len(short) - size] * np.uint64(pow(_STEP, size, 1 << 64))
        return out

    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for begin in range(ANCHOR, n, RUN):
        one = _SPREAD[data[begin - ANCHOR : min(begin + RUN, n) - 1]]
        two = joined(one, one, 1)
        four = joined(two, two, 2)
        eight = joined(four, four, 4)
        h = joined(joined(eight, eight, 8), eight, 16)[ANCHOR - 1 :]
        at = np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ANCHOR_BITS) == 0)
        found.append((at + begin, h[at]))
    at, h = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at - offsets[row] >= ANCHOR
    return at[inside], common.mix(h[inside])


def followers(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The FOLLOWER bytes from each position, 0 beyond the text's end."""
    end = offsets[np.searchsorted(offsets, at, side="right")]
    place = at[:, None] + np.arange(FOLLOWER)
    return np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(data, offsets, skip, more): whole texts, unless there is but one and it is longer than `most`: then runs of it, each after `skip` bytes that were in the run before."""
    most = most or GROUP_BYTES
    if len(offsets) != 2 or len(data) <= most:
        yield data, offsets, 0, False
        return
    step = max(most // BLOCK, 2) * BLOCK
    for a in range(0, len(data), step):
        skip = min(a, ANCHOR + FOLLOWER)
        part = data[a - skip : a + step]
        yield part, np.array([0, len(part)]), skip, a + step < len(data)


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of n (or how many) for each."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)
    return key[first], total


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts, end to end, and their offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _packed(key: np.ndarray) -> bytes:
    """Ascending keys as bytes: their differences, the lowest bytes of all first, compressed."""
    return pa.compress(np.ascontiguousarray(np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, n * 8, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(flat.T).view(np.uint64)[:, 0], dtype=np.uint64)


def _planes(n: np.ndarray) -> np.ndarray:
    """The bytes of counts, the lowest of all first."""
    return np.ascontiguousarray(n.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _counts_of(blob: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, size * 8, "zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(flat.T).view(np.int64)[:, 0]


def _squeezed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(x).data.cast("B") if x.size else b"", asbytes=True)


def _runs(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(data, offsets, skip, places of anchors, anchors) of the texts, in runs."""
    for batch in pa.table({"text": column}).to_batches():
        for part in common.slices(batch, 0, COUNT_BYTES):
            for data, offsets, skip, more in pieces(*text_bytes(part.column(0))):
                at, anchor = anchors(data, offsets)
                # What follows an anchor may lie beyond a run of a long text: then it is taken with the next run.
                ready = at <= (len(data) - FOLLOWER if more else len(data))
                yield data, offsets, skip, at[ready], anchor[ready]


def _least(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors, ascending, and the least follower of each."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros((0, FOLLOWER), np.uint8)
    anchor, after = np.concatenate([k for k, _ in found]), np.concatenate([f for _, f in found])
    order = np.lexsort((*np.ascontiguousarray(after[:, ::-1]).view(np.uint64).T, anchor)) if after.shape[1] else np.argsort(anchor)
    anchor, after = anchor[order], after[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    return anchor[first], after[first]


def following(column: pa.ChunkedArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a column of texts that are wanted (ascending), and the least follower of each."""
    found = []
    for data, offsets, _, at, anchor in _runs(column):
        asked = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
        found.append((anchor[asked], followers(data, offsets, at[asked])))
    return _least(found)


def distinct(column: pa.ChunkedArray, followed: bool = True) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of a column of texts: the distinct keys, ascending, and how often each occurs; the distinct anchors and, if followed, the least follower of each (else none of its bytes)."""
    have: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(parts):
        return _counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])) if len(parts) > 1 else parts[0]

    longest = len(ORDERS) - 1
    for data, offsets, skip, at, anchor in _runs(column):
        found.append((anchor, followers(data, offsets, at) if followed else np.zeros((len(at), 0), np.uint8)))
        have.append(_counted(_key(longest, windows(data, offsets)[skip:])))
        if len(have) == 16:
            have = [merged(have)]
    # The counts of the longest contexts are those of the shorter ones, added up.
    got = [merged(have)] if have else [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i in range(longest)[::-1]:
        key, n = got[0]
        got.insert(0, _counted(_key(i, key), n))
    keys = np.concatenate([k for k, _ in got]), np.concatenate([n for _, n in got])
    return keys, _least(found)


#: Rows between the steps: kind 0 has keys and counts (then odds), kind 1 anchors and followers; where followers are asked for, anchors and the parts that ask, if they are known. `bucket` is of contexts.
_COUNTS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int8()), ("size", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
_COUNTS_SQL = "part int, bucket int, kind byte, size int, keys binary, values binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows)], schema=_COUNTS) if rows else _COUNTS.empty_table()


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text) to (part, texts): the rows of a part that are read one after the other, compressed together for the shuffle."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).min))
        parts, blobs = [], []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sink = pa.BufferOutputStream()
            rows = table.select(["doc_id", "text"]).take(pa.array(order[a:z])).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            parts.append(int(part[order[a]]))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "texts"])

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= PART_BYTES:
            yield packed()
            waiting, size = [], 0
    if waiting:
        yield packed()


def _unpack_texts(table: pa.Table) -> pa.Table:
    """(doc_id, text) of a part."""
    return pa.concat_tables(pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("texts"))


def _count(buckets: int, followed: bool = True):
    """The counts and anchors of a part's texts, with followers or without, split by bucket. Only buckets that get something have a row."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = []
        column = _unpack_texts(table).column("text") if "texts" in table.column_names else table.column("text")
        for kind, (key, values) in enumerate(distinct(column, followed)):
            bucket = (common.mix(key if kind else key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, values, bucket = key[order], values[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows.append((part, int(bucket[a]), kind, z - a, _packed(key[a:z]), _squeezed(values[a:z] if kind else _planes(values[a:z]))))
        return _table(rows)

    return run


def levels(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For ascending keys, 9 rows: how often the context came (first), the context with the first bit of the byte, with the first two bits and so on."""
    out = np.empty((9, len(key)), np.int64)
    for j in range(9):
        g = key >> np.uint64(8 - j)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out[j] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key))))
    return out


def odds(counts: np.ndarray) -> np.ndarray:
    """levels() to the eight log odds of a byte's bits, in sixteenths, as the bytes of a word: positive if the bit that came is the likelier one."""
    out = np.empty((counts.shape[1], 8), np.int8)
    for j in range(8):
        there, other = counts[j + 1], counts[j] - counts[j + 1]
        out[:, j] = np.clip(np.rint(16 * np.log((there + DELTA) / (other + DELTA))), -127, 127)
    return out.view(np.int64)[:, 0]


def _told(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors and their parts, in this order: the rows that are told what follows, and the rows that tell it."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    # The next row of the same anchor, or from the last one the first; those that only ask (they come first) aren't told of.
    begin = np.repeat(first, np.diff(np.append(first, len(key))))
    begin = begin + np.repeat(np.add.reduceat(owner < 0, first), np.diff(np.append(first, len(key))))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    there = np.arange(len(key)) + 1
    there = np.where((there >= end) | (owner < 0), begin, there)
    told = (there < end) & (there != np.arange(len(key)))
    return np.flatnonzero(told), there[told]


def _add_up(table: pa.Table) -> pa.Table:
    """The counts of a bucket, from all parts, to what each part asked for: the odds by the counts of the other parts; and after an anchor what follows it in the next part (in a circle) that has it. Parts below 0 only ask."""
    part, bucket, kind, size, blobs, values = (table.column(c).to_pylist() for c in _COUNTS.names)
    rows = []
    mine = [i for i, k in enumerate(kind) if k == 0]
    keys = [_unpacked(blobs[i], size[i]) for i in mine]
    counts = [_counts_of(values[i], size[i]) * (part[i] >= 0) for i in mine]
    if mine:
        key, n = _counted(np.concatenate(keys), np.concatenate(counts))
        whole = levels(key, n)
        for i, k, own in zip(mine, keys, counts):
            word = odds(whole[:, np.searchsorted(key, k)] - levels(k, own))
            known = word != 0
            if known.any():
                rows.append((part[i], bucket[i], 0, int(known.sum()), blobs[i] if known.all() else _packed(k[known]), _squeezed(word[known])))
    mine = [i for i, k in enumerate(kind) if k == 1]
    if mine:
        key = np.concatenate([_unpacked(blobs[i], size[i]) for i in mine])
        after = np.concatenate([np.frombuffer(pa.decompress(values[i], size[i] * FOLLOWER, "zstd"), np.uint8).reshape(-1, FOLLOWER) for i in mine])
        owner = np.repeat([part[i] for i in mine], [size[i] for i in mine])
        order = np.lexsort((owner, key))
        key, after, owner = key[order], after[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at, there = _told(key, owner)
        at, there = at[np.argsort(owner[at], kind="stable")], there[np.argsort(owner[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(owner[at], prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).min)) if len(at) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows.append((int(owner[at[a]]), bucket[0], 1, z - a, _packed(key[at[a:z]]), _squeezed(after[there[a:z]])))
    return _table(rows)


def _odds(table: pa.Table) -> pa.Table:
    """_add_up() of the counts alone."""
    return _add_up(table.filter(pc.equal(table.column("kind"), 0)))


def _ask(table: pa.Table) -> pa.Table:
    """From the anchors of a bucket, of all parts: for each part those whose followers other parts need, and who needs them. So only followers that a match can use are sent."""
    table = table.filter(pc.equal(table.column("kind"), 1))
    part, bucket, _, size, blobs, _ = (table.column(c).to_pylist() for c in _COUNTS.names)
    if not part:
        return _COUNTS.empty_table()
    key, owner = np.concatenate([_unpacked(b, n) for b, n in zip(blobs, size)]), np.repeat(np.array(part, np.int32), size)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    at, there = _told(key, owner)
    order = np.argsort(owner[there], kind="stable")
    at, there = at[order], there[order]
    tells = owner[there]
    cuts = np.flatnonzero(np.diff(tells.astype(np.int64), prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
    return _table([(int(tells[a]), bucket[0], 1, z - a, _packed(key[at[a:z]]), _squeezed(owner[at[a:z]])) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())])


def _answer(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """The followers that were asked of a part by _ask(), for the parts that need them."""
    if not texts.num_rows or not asked.num_rows:
        return _COUNTS.empty_table()
    size, blobs, values = (asked.column(c).to_pylist() for c in ("size", "keys", "values"))
    key = np.concatenate([_unpacked(b, n) for b, n in zip(blobs, size)])
    asks = np.concatenate([np.frombuffer(pa.decompress(v, n * 4, "zstd"), np.int32) for v, n in zip(values, size)])
    anchor, after = following(_unpack_texts(texts).column("text"), np.unique(key))
    order = np.lexsort((key, asks))
    key, asks = key[order], asks[order]
    there = np.searchsorted(anchor, key)
    cuts = np.flatnonzero(np.diff(asks.astype(np.int64), prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).min))
    return _table([(int(asks[a]), 0, 1, z - a, _packed(key[a:z]), _squeezed(after[there[a:z]])) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())])


class Model:
    """What a part got: open-addressed tables, one a predictor, of keys and the log odds of their bytes' bits (0 odds where nothing is known), and what follows anchors. A table has a third more places than keys or more, and no key is left out."""

    def __init__(self, key: np.ndarray, path: np.ndarray, anchor: np.ndarray, after: np.ndarray):
        order = (key >> np.uint64(56)).astype(np.int64)
        self.tables = [self._table(key[order == i], path[order == i]) for i in range(len(ORDERS))]
        by = np.argsort(anchor, kind="stable")
        self.anchor, self.after = anchor[by], after[by]

    @classmethod
    def of(cls, known: pa.Table) -> Model:
        """From the rows of _add_up() for a part."""
        kind, size, blobs, values = (known.column(c).to_pylist() for c in ("kind", "size", "keys", "values"))
        keys, after = ([i for i, k in enumerate(kind) if k == x] for x in (0, 1))
        none = np.zeros(0, np.uint64)
        return cls(
            np.concatenate([none, *(_unpacked(blobs[i], size[i]) for i in keys)]),
            np.concatenate([none.view(np.int64), *(np.frombuffer(pa.decompress(values[i], size[i] * 8, "zstd"), np.int64) for i in keys)]),
            np.concatenate([none, *(_unpacked(blobs[i], size[i]) for i in after)]),
            np.concatenate([np.zeros((0, FOLLOWER), np.uint8), *(np.frombuffer(pa.decompress(values[i], size[i] * FOLLOWER, "zstd"), np.uint8).reshape(-1, FOLLOWER) for i in after)]),
        )

    @staticmethod
    def _place(key: np.ndarray, bits: int) -> np.ndarray:
        h = key ^ (key >> np.uint64(29))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - bits)
        return h.view(np.int64)

    def _table(self, key: np.ndarray, path: np.ndarray) -> tuple[int, np.ndarray]:
        """The bits of a place, and by place the key and its word side by side, so that a look-up reads one place of memory."""
        bits = max(4, (len(key) * 3 // 2).bit_length())
        keys, words = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, np.int64)
        at, left = self._place(key, bits), np.arange(len(key))
        taken = np.zeros(1 << bits, bool)
        while len(left):
            left = left[np.argsort(taken[at[left]], kind="stable")]
            free = left[~taken[at[left]]]
            keys[at[free]] = key[free]  # of several, one stays
            won = free[keys[at[free]] == key[free]]
            words[at[won]] = path[won]
            taken[at[won]] = True
            left = left[keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return bits, np.stack([keys.view(np.int64), words], axis=1).view(np.complex128)[:, 0]

    def look_up(self, i: int, key: np.ndarray) -> np.ndarray:
        bits, table = self.tables[i]
        at = self._place(key, bits)
        found = table.take(at).view(np.uint64).reshape(-1, 2)  # taken as one number of 16 bytes
        there, out = found[:, 0], found[:, 1].astype(np.int64)
        other = np.flatnonzero(there != key)
        out[other] = 0
        other = other[there[other] != np.uint64(0xFFFFFFFFFFFFFFFF)]
        at = at[other]
        while len(other):  # the next place, until the key or a free one is met
            at = (at + 1) & ((1 << bits) - 1)
            found = table.take(at).view(np.uint64).reshape(-1, 2)
            there = found[:, 0]
            same = there == key[other]
            out[other[same]] = found[same, 1]
            go = ~same & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            other, at = other[go], at[go]
        return out

    def expected(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The byte that a match expects at each place, 0 for none: what follows the latest anchor there, unless that has failed before."""
        out = np.zeros(len(data), np.uint8)
        if not len(self.anchor):
            return out
        at, key = anchors(data, offsets)
        place = np.minimum(np.searchsorted(self.anchor, key), len(self.anchor) - 1)
        known = self.anchor[place] == key
        at, after = at[known], self.after[place[known]]
        right = np.logical_and.accumulate(after == followers(data, offsets, at), axis=1)
        holds = after != 0
        holds[:, 1:] &= right[:, :-1]
        where = at[:, None] + np.arange(FOLLOWER)
        holds &= where < offsets[np.searchsorted(offsets, at, side="right")][:, None]
        out[where[holds]] = after[holds]  # places ascend from anchor to anchor, so the latest one stays
        return out


#: By the bits in which the expected byte and the one that came differ: the log odds of a match, until the first wrong bit.
_MATCH = np.zeros((256, 8), np.int8)
for _x in range(256):
    for _j in range(8):
        if _x >> (8 - _j) == 0:
            _MATCH[_x, _j] = MATCH_ODDS if not (_x >> (7 - _j)) & 1 else -MATCH_ODDS
_MATCH = _MATCH.view(np.int64)[:, 0]


def predictions(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of log odds: predictors x bytes and one for what is beyond a text; gates). Nothing in a gate hangs on the byte that it is for."""
    k = len(ORDERS)
    path = np.zeros((k + 1, len(data) + 1), np.int64)
    gate = np.zeros(len(data) + 1, np.uint8)
    window = windows(data, offsets)
    for begin in range(0, len(data), RUN):
        here = slice(begin, min(begin + RUN, len(data)))
        for i in range(k):
            path[i, here] = word = model.look_up(i, _key(i, window[here]))
            if i:  # the lowest byte of a word is the odds of the first bit: the same for all bytes of a context
                gate[here][word.view(np.int8)[::8] != 0] = 1 if i <= k // 2 else 2
    byte = model.expected(data, offsets)
    at = np.flatnonzero(byte)
    path[k, at] = _MATCH[byte[at] ^ data[at]]
    gate[at] = 3
    return path, gate


#: How often odds of a bucket were right; the mirrored bucket has the bits that such odds got wrong. Buckets are half a unit of the mixed log odds wide.
_START = TRUST / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))


class Coder:
    """Weights and refinement of n texts. Weights are of odds in sixteenths, as they come."""

    def __init__(self, n: int):
        self.weights = np.full((len(ORDERS) + 1, n * GATES, 8), FIRST * _SCALE, np.float32)
        self.weights[-1] = MATCH_FIRST * _SCALE
        self.hits = np.tile(_START, (n, 1))

    def code(self, path: np.ndarray, gate: np.ndarray, starts: np.ndarray, sizes: np.ndarray, costs: np.ndarray | None = None) -> np.ndarray:
        """Bits of texts in descending order of size, which are coded side by side. costs: gets the bits of each byte."""
        n = len(sizes)
        bits = np.zeros(n)
        room = np.empty((len(path) + 6, min(n, TEXTS) * BLOCK * 8), np.float32)
        for a in range(0, n, TEXTS):
            z = min(n, a + TEXTS)
            self._code(path, gate, starts[a:z], sizes[a:z], costs, self.weights[:, a * GATES : z * GATES], self.hits[a:z], bits[a:z], room)
        return bits / np.log(2)

    @staticmethod
    def _code(path, gate, starts, sizes, costs, weights, hits, bits, room) -> None:
        """code() of some of the texts; weights, hits and bits are changed, room is overwritten."""
        k, n, beyond = len(path), len(sizes), path.shape[1] - 1
        inside = np.arange(BLOCK)
        for begin in range(0, int(sizes[0]) if n else 0, BLOCK):
            m = int(np.searchsorted(-sizes, -begin, side="left"))  # texts longer than begin
            full = int(np.searchsorted(-sizes, -(begin + BLOCK), side="right"))
            at = starts[:m, None] + (begin + inside)
            if full < m:
                at[full:][begin + inside >= sizes[full:m, None]] = beyond
            rows = np.arange(m, dtype=np.int64)[:, None]
            g = gate[at]
            flat, chosen = at.reshape(-1), (rows * GATES + g).reshape(-1)
            size = m * BLOCK * 8
            x, (dot, w, p, final, error, step) = room[:k, :size], room[k:, :size]
            for i in range(k):
                np.copyto(x[i], path[i].take(flat).view(np.int8))
                weights[i].take(chosen, axis=0, out=w.reshape(-1, 8), mode="clip")
                if i:
                    w *= x[i]
                    dot += w
                else:
                    np.multiply(w, x[i], out=dot)
            np.clip(dot, -20, 20, out=dot)
            np.negative(dot, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            dot *= 2
            np.rint(dot, out=dot)
            np.clip(dot, -(BUCKETS // 2), BUCKETS // 2, out=dot)
            bucket = dot.astype(np.int64).reshape(m, -1)
            bucket += rows * BUCKETS + BUCKETS // 2
            bucket = bucket.reshape(-1)
            rate = (hits[:m] / (hits[:m] + hits[:m, ::-1])).astype(np.float32)
            rate.reshape(-1).take(bucket, out=final, mode="clip")
            final += p
            final *= np.float32(0.5)
            np.clip(final, np.float32(1 / 65536), np.float32(1 - 1 / 65536), out=final)
            np.log(final, out=final)
            lengths = final.reshape(m, -1)
            if costs is not None:
                there = at != beyond
                costs[at[there]] = -lengths.reshape(m, BLOCK, 8).sum(axis=2, dtype=np.float64)[there] / np.log(2)
            bits[:full] -= lengths[:full].sum(axis=1, dtype=np.float64)
            for r in range(full, m):  # a text's last block
                bits[r] -= lengths[r, : (int(sizes[r]) - begin) * 8].sum(dtype=np.float64)
            if not full:
                continue
            # What the block teaches the texts that go on.
            z = full * BLOCK * 8
            hits[:full] += np.bincount(bucket[:z], minlength=full * BUCKETS).reshape(full, BUCKETS)
            error, step = error[:z], step[:z]
            np.multiply(p[:z], np.float32(RATE), out=error)
            np.subtract(np.float32(RATE), error, out=error)
            error *= _SCALE * _SCALE
            gates = (g[:full, None, :] == np.arange(GATES, dtype=np.uint8)[:, None]).astype(np.float32)
            for i in range(k):
                np.multiply(x[i, :z], error, out=step)
                weights[i, : full * GATES] += np.matmul(gates, step.reshape(full, BLOCK, 8)).reshape(-1, 8)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, costs: np.ndarray | None = None) -> np.ndarray:
    """Bits of each text, each coded with weights of its own. costs: gets the bits of each byte of data."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    coder, out, done = Coder(len(sizes)), np.zeros(len(sizes)), 0
    for part, cuts, skip, _ in pieces(data, offsets):
        path, gate = predictions(model, part, cuts)
        own = np.zeros(len(part)) if costs is not None else None
        out[order] += coder.code(path, gate, cuts[:-1][order] + skip, np.diff(cuts)[order] - skip, own)
        if costs is not None:
            costs[done : done + len(part) - skip] = own[skip:]
            done += len(part) - skip
    return out


def scored(docs: DataFrame, corpus: DataFrame | None = None, bits: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, total_bits, bits_per_byte) for every document, over its whole text.

    Counts come from `corpus` (columns doc_id and text; no part of it is left out), or from the documents themselves,
    where each is predicted from all parts but its own. Null and empty texts have 0 bytes, 0 bits and a null ratio. Very
    long texts are coded in pieces, with the same result. Repeated rows fall into one part: they don't teach each other,
    but others, and are listed each, all alike. Equal texts under other ids teach each other, unless they fall into one
    part. A null doc_id is listed as null. Further columns are ignored; an empty table gives no row. `bits`, once the
    size of a table of slots, is taken but has no effect.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, total_bits double, bits_per_byte double"
    teachers = docs if corpus is None else corpus
    size = teachers.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(FOLDS, -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    # With another corpus the documents only ask: their parts have numbers below 0, and what they have counts nothing.
    packed = lambda df, part: df.select(part.alias("part"), "doc_id", "text").mapInArrow(_pack_texts, "part int, texts binary")
    spread = packed(docs, part if corpus is None else -1 - part)
    # Counting and coding group the same columns by the same key, so that texts are shuffled once.
    count = _count(parts * SPLIT, followed=False)
    counted = spread.groupBy("part").applyInArrow(count, _COUNTS_SQL)
    sources = spread
    if corpus is not None:
        sources = packed(corpus, part)
        counted = counted.unionByName(sources.groupBy("part").applyInArrow(count, _COUNTS_SQL))
    # Both read the same shuffled rows.
    known, asked = (counted.groupBy("bucket").applyInArrow(step, _COUNTS_SQL) for step in (_odds, _ask))
    known = known.unionByName(sources.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_answer, _COUNTS_SQL))

    ids = pa.field("doc_id", to_arrow_type(docs.schema["doc_id"].dataType))
    empty = pa.schema([ids, ("n_bytes", pa.int64()), ("total_bits", pa.float64()), ("bits_per_byte", pa.float64())]).empty_table()

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        model, out = Model.of(known), []
        if not texts.num_rows:  # counts for a part without texts
            return empty
        texts = _unpack_texts(texts)
        # Texts of like length are coded side by side.
        texts = texts.take(pc.sort_indices(pc.binary_length(texts.column("text")), sort_keys=[("", "descending")]))
        for batch in texts.select(["doc_id", "text"]).combine_chunks().to_batches():
            for part in common.slices(batch, 1, GROUP_BYTES):
                data, offsets = text_bytes(part.column(1))
                total = code_lengths(model, data, offsets)
                n = np.diff(offsets)
                ratio = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
                out.append(pa.record_batch([part.column(0), pa.array(n.astype(np.int64)), pa.array(total), ratio], names=["doc_id", "n_bytes", "total_bits", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    return spread.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(score, schema)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_scoring": op4_lm_score}
ORACLE: dict[str, str] = {}
