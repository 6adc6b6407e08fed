"""Benchmark decontamination by templates.

Both sides are canonicalised: numbers, units after numbers and names (capitalised words within a sentence) become typed
placeholders, all else is lower-cased words. Texts are read in up to three ways, so that a name may also begin a
sentence, or be written as a plain word. Every window of WINDOW template tokens is hashed, document windows are
hash-joined with benchmark windows, and on each alignment of a document with an item the slots are compared: a copy has
the same fillers, a re-parameterised question has others, but each of the item's fillers must correspond to one and the
same filler of the document throughout. An item leaks into a document if the windows of its consistent alignments cover
at least COVERAGE of the item's tokens.

Document windows pass a bit map of the benchmark's window hashes in the Python worker that reads the text, so that only
possible hits are shuffled for the exact join. The map has a fixed number of bits a window; a benchmark of more than
MAP_WINDOWS windows is joined without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Template tokens of a window; shortest item that is searched for; share of an item's tokens that must be covered.
WINDOW, SHORTEST, COVERAGE = 8, 4, 0.6
#: Share of an alignment's slots that must map consistently.
CONSISTENT = 0.8
#: Windows up to which the bit map is made and broadcast (16 to 32 places a window, one byte each: 128 MB at most).
MAP_WINDOWS = 4_000_000
UNITS = "km m cm mm kg g mg t lb lbs oz ft mi mile miles inch inches meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms gram grams liter liters litre litres l ml s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds usd eur degree degrees kmh mph hz khz mhz kb mb gb tb watt watts volt volts".split()
_UNIT = np.sort(np.array([common.hash_word(u) for u in UNITS], np.uint64))
#: Template hashes of the placeholders.
_NUM, _NAME, _UNITS = (np.uint64(common.hash_word(f"<{k}>")) for k in ("number", "name", "unit"))


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, filler, slot, first): for each token its template hash, the hash of its own lower-case form, whether it is a slot; and the first token of each text (rows + 1)."""
    return _tokens(column, False)[:4]


def _tokens(column: pa.Array, whole_numbers: bool = True) -> tuple[np.ndarray, ...]:
    """templates(), and for each token whether it is a name within a sentence, and a capitalised word that begins one. whole_numbers: a number with a point, or commas before three digits, is one token."""
    raw, offsets = common.flat(column, lower=False)
    starts, ends = common.words(raw)
    if whole_numbers and len(starts):
        figures = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        whole = figures[ends] - figures[starts] == ends - starts
        sign = raw[np.minimum(ends[:-1], len(raw) - 1)]
        join = whole[:-1] & whole[1:] & (starts[1:] == ends[:-1] + 1) & ((sign == 46) | ((sign == 44) & (ends[1:] - starts[1:] == 3)))
        starts, ends = starts[np.append(True, ~join)], ends[np.append(~join, True)]
    first = common.counts_by_row(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), first, np.zeros(0, bool), np.zeros(0, bool)
    # Lower case in place: A-Z, and the capitals of Latin-1, Greek and Cyrillic that keep their length.
    data = raw.copy()
    big = (raw >= 65) & (raw <= 90)
    data[big] += 32
    c3 = np.zeros(len(raw), bool)
    c3[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    data[c3] += 32
    filler = common.hash_spans(data, starts, ends)
    head = raw[starts]
    digit = (head >= 48) & (head <= 57)
    after = raw[np.minimum(starts + 1, len(raw) - 1)]
    latin = (head == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    second = raw[np.minimum(starts + np.where(latin, 2, 1), len(raw) - 1)]
    small = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    capital = (((head >= 65) & (head <= 90)) | latin) & small & (ends - starts > 1)
    # A sentence begins after . ! ? : " or a line break, looking back over spaces.
    before = raw[np.maximum(starts - 1, 0)]
    earlier = raw[np.maximum(starts - 2, 0)]
    space = before == 32
    mark = np.where(space, earlier, before)
    opening = np.isin(mark, np.frombuffer(b".!?:\n\r\t\"'()[]*#>|-", np.uint8))
    at_start = np.zeros(len(starts), bool)
    at_start[first[:-1][first[:-1] < first[1:]]] = True
    name = capital & ~opening & ~at_start
    unit = np.zeros(len(starts), bool)
    unit[1:] = digit[:-1] & _in(filler[1:], _UNIT)
    row_start = np.zeros(len(starts), bool)
    row_start[first[:-1][first[:-1] < len(starts)]] = True
    unit &= ~row_start
    template = np.where(digit, _NUM, np.where(unit, _UNITS, np.where(name, _NAME, filler)))
    name &= ~digit & ~unit
    return template, filler, digit | name | unit, first, name, capital & ~name & ~digit & ~unit


def _readings(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(template, filler, slot, first, changed) of each reading: names within a sentence are placeholders; so are words that begin one and are such names elsewhere in the text; names are words, as in a copy in lower case or capitals. changed: the tokens that differ from the first reading."""
    template, filler, slot, first, name, initial = _tokens(column)
    yield template, filler, slot, first, None
    row = np.searchsorted(first, np.arange(len(filler)), side="right").astype(np.uint64)
    word = common.mix(filler + row * np.uint64(0x9E3779B97F4A7C15))
    more = initial & _in(word, np.unique(word[name]))
    if more.any():
        yield np.where(more, _NAME, template), filler, slot | more, first, more
    if name.any():
        yield np.where(name, filler, template), filler, slot & ~name, first, name


def window_hashes(template: np.ndarray, size: int) -> np.ndarray:
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= np.uint64(0x100000001B3)
        h += template[k : k + n]
    return common.mix(h)


def _rows(column: pa.Array, sizes: list[int], bits: np.ndarray | None, whole_short: bool):
    """(row, pos, size, hash, fillers of the slots) of the windows of a batch. whole_short: texts shorter than the window count as one window of their own size."""
    for reading in _readings(column):
        yield from _read_rows(*reading, sizes, bits, whole_short)


def _read_rows(template, filler, slot, first, changed, sizes, bits, whole_short):
    """_rows() of one reading; of a further one the windows in which it differs."""
    n_words = np.diff(first)
    changes = None if changed is None else np.concatenate([[0], np.cumsum(changed)])
    slots_before = np.concatenate([[0], np.cumsum(slot)])
    # The slots of a window; of one that is found by its fillers the numbers, which don't hang on what is around it.
    number = template == _NUM
    numbers_before = np.concatenate([[0], np.cumsum(number)]) + slots_before[-1]
    fill = np.concatenate([filler[slot], filler[number]])
    for size in sizes:
        h = window_hashes(template, size)
        if not len(h):
            continue
        # Placeholders of a window of which more than half are such say too little: it is found by its fillers, as an exact copy.
        rich = (slots_before[size:] - slots_before[:-size]) * 2 > size
        if rich.any():
            h[rich] = common.mix(window_hashes(filler, size)[rich])
        if bits is not None:
            at = np.flatnonzero(bits[(h >> np.uint64(64 - (len(bits) - 1).bit_length())).astype(np.int64)])
        else:
            at = np.arange(len(h))
        row = np.searchsorted(first, at, side="right") - 1
        ok = at + size <= first[row + 1]
        if changes is not None:
            ok &= changes[at + size] > changes[at]
        if whole_short and size < sizes[-1]:
            ok &= n_words[row] == size
        at, row = at[ok], row[ok]
        a, b = (np.where(rich[at], numbers_before[x], slots_before[x]) for x in (at, at + size))
        yield row, at - first[row], size, h[at], a, b, fill


def _windows(sizes: list[int], bits, whole_short: bool, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                for row, pos, size, h, a, b, fill in _rows(part.column(1), sizes, bits.value if hasattr(bits, "value") else bits, whole_short):
                    if len(row):
                        lengths = np.concatenate([[0], np.cumsum(b - a)])
                        flat = np.repeat(a - lengths[:-1], b - a) + np.arange(lengths[-1])
                        slots = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(common.signed(fill[flat])) if len(flat) else pa.array([], pa.int64()))
                        yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(row), size, np.int32)), pa.array(common.signed(h)), slots], names=[key, "pos", "size", "hash", "slots"])

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, item_pos, size, hash, item_slots, item_tokens): the items' windows; one with fewer tokens than a window is a single one, with fewer than `shortest` none."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    sizes = list(range(shortest, window + 1))
    got = benchmark.select("item_id", "text").filter("item_id is not null").mapInArrow(_windows(sizes, None, True, "item_id"), f"item_id {kind}, pos int, size int, hash long, slots array<long>")
    got = got.distinct()
    covered = Window.partitionBy("item_id")
    return got.select("item_id", F.col("pos").alias("item_pos"), "size", "hash", F.col("slots").alias("item_slots"), (F.max(F.col("pos") + F.col("size")).over(covered)).alias("item_tokens"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, coverage, slots, changed_slots) for each item that leaks into a document.

    Rows with a null doc_id or item_id, or a null or empty text, take no part; items of fewer than `shortest` words are
    never found, and windows made mostly of placeholders only as exact copies. Repeated rows, and passages that a document repeats, give one row for
    each (doc_id, item_id); equally good items are all listed. Further columns are ignored; with an empty table on
    either side there is no row.
    """
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = common.materialise(benchmark_windows(benchmark, window, shortest), "benchmark-windows")
    stats = items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(stats.sizes or [window])
    bits = None
    if stats.n <= MAP_WINDOWS:
        width = max(16, (16 * max(stats.n, 1) - 1).bit_length())
        table = np.zeros(1 << width, bool)
        hashes = items.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        table[(hashes >> np.uint64(64 - width)).astype(np.int64)] = True
        bits = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select(F.col("doc_id"), F.col("text")).filter("doc_id is not null and length(text) > 0")
    hits = named.mapInArrow(_windows(sizes, bits, False, "doc_id"), f"doc_id {kind}, pos int, size int, hash long, slots array<long>")
    joined = hits.join(items, ["hash", "size"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    # Each alignment: the slots of its windows, pairwise.
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    aligned = joined.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set(F.struct("item_pos", "size")).alias("at"), F.flatten(F.collect_set(pairs)).alias("pairs"), F.first("item_tokens").alias("item_tokens")
    )
    pairs = F.array_distinct("pairs")
    n_values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    aligned = aligned.withColumn("slots", n_values).withColumn("mapped", F.size(pairs)).withColumn("changed", F.size(F.filter(pairs, lambda p: p["i"] != p["d"])))
    # Consistent: hardly more (item filler, document filler) pairs than item fillers.
    aligned = aligned.filter(F.col("slots") >= F.col("mapped") * consistent)
    token = aligned.select("doc_id", "item_id", "item_tokens", "slots", "changed", F.explode("at").alias("a"))
    token = token.select("doc_id", "item_id", "item_tokens", "slots", "changed", F.explode(F.sequence(F.col("a.item_pos"), F.col("a.item_pos") + F.col("a.size") - 1)).alias("t"))
    out = token.groupBy("doc_id", "item_id").agg(F.countDistinct("t").alias("covered"), F.first("item_tokens").alias("item_tokens"), F.max("slots").alias("slots"), F.max("changed").alias("changed_slots"))
    out = out.withColumn("coverage", F.col("covered") / F.col("item_tokens"))
    return out.filter(F.col("coverage") >= coverage).select("doc_id", "item_id", "covered", "item_tokens", "coverage", "slots", "changed_slots")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaks, all columns unchanged, whatever their names. Rows that leaks() leaves out (null ids, null or empty texts) stay; rows of one id go together. Very long texts are searched whole; an empty table gives an empty one."""
    (name,) = common.unused(docs, "_cl_id")
    bad = common.materialise(leaks(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct(), "leaking-documents")
    return docs.join(common.broadcast_if_small(bad, bad.count() * 16), F.col("doc_id") == F.col(name), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
