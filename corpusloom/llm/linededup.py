"""Line deduplication over the whole corpus.

Lines are normalised (white space runs become one space, trimmed, lower case) and hashed; a line hash that occurs in
more than MAX_DOCS distinct documents is dropped from every document, and the remaining lines are put together again
in their order. Texts are read once to hash their lines, which are kept as (document, position, hash).

The count doesn't bend to a line that all documents share: how many rows have a line is added up before the shuffle,
which leaves out lines in too few rows; for the others the distinct (line, document) pairs are spread by both, and
counted with partial sums. The texts themselves are read a second time and joined with the few positions to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

#: Documents that a line may occur in.
MAX_DOCS = 2
#: Share of a copy's lines that recur elsewhere, and of the lines of two copies together that both have.
COPY_SHARE, COPY_OVERLAP = 0.9, 0.7


_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def hashed_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of the lines of a batch of texts that aren't blank."""
    data, offsets = common.flat(column)  # lower case, a line feed after each text
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pos = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[row]
    # Runs of blanks become one space; none is left at either end of a line.
    blank = _BLANK[data]
    solid = ~blank & (data != 10)
    keep = solid.copy()
    keep[1:] |= blank[1:] & solid[:-1]
    kept = np.where(blank, np.uint8(32), data)[keep]
    place = np.concatenate([[0], np.cumsum(keep)])
    a, z = place[starts], place[ends]
    z = z - ((z > a) & (kept[np.maximum(z - 1, 0)] == 32))
    some = z > a
    row, pos, a, z = row[some], pos[some], a[some], z[some]
    return row, pos, common.hash_spans(kept, a, z)


def _content() -> tuple[Column, Column]:
    """What equal texts share: a hash and the length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text), F.octet_length(text)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, pos, line_hash) for each line that isn't blank. Texts are read once and lines leave Python as hashes."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 3):
                row, pos, line = hashed_lines(part.column(3))
                at = pa.array(row)
                yield pa.record_batch([*(part.column(k).take(at) for k in range(3)), pa.array(pos, pa.int32()), pa.array(common.signed(line))], names=["doc_id", "h", "n", "pos", "line_hash"])

    h, n = _content()
    named = docs.filter("length(text) > 0").select("doc_id", h.alias("h"), n.alias("n"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, h long, n int, pos int, line_hash long")


def frequent_lines(hashes: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(line_hash, n_docs) of the lines in more than max_docs distinct documents; a null doc_id counts as one document."""
    # Documents of a line can't be more than its occurrences: few lines are left, by partial sums.
    often = hashes.groupBy("line_hash").agg(F.count("*").alias("rows")).filter(F.col("rows") > max_docs).select("line_hash")
    often = common.materialise(often, "lines-in-many-rows")
    pairs = hashes.select("line_hash", "doc_id").join(common.broadcast_if_small(often, often.count() * 16), "line_hash", "left_semi")
    return pairs.distinct().groupBy("line_hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, positions: pd.Series) -> pd.Series:
    def one(t, p):
        if t is None or p is None:
            return None
        gone = set(p.tolist() if hasattr(p, "tolist") else p)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([one(t, p) for t, p in zip(text, positions)], dtype=object)


def copies(flagged: DataFrame, share: float = COPY_SHARE, overlap: float = COPY_OVERLAP) -> DataFrame:
    """(h, n) of the contents that are copies: of their distinct lines `share` or more are frequent, and with one other content (or another document with the same) they have `overlap` of the lines in common.

    flagged: (doc_id, h, n, line_hash, bad) for each line. Contents that share the least line of one of three orders are
    compared with the first and the last such content, so that a crowd costs a linear number of comparisons; what
    isn't found so isn't a copy.
    """
    lines = flagged.groupBy("h", "n").agg(F.sort_array(F.collect_set("line_hash")).alias("lines"), F.sum(F.col("bad").cast("int")).alias("bad"), F.count("*").alias("all"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    likely = lines.filter(F.col("bad") >= F.col("all") * share)
    likely = common.materialise(likely.select("h", "n", "lines", (F.col("low") < F.col("high")).alias("twice")), "likely-copies")
    # The least line by three different orders; spread by it, contents of one sort with the same least line meet.
    orders = F.array(*[F.expr(f"array_min(transform(lines, x -> xxhash64(x, {k})))") for k in range(3)])
    keyed = likely.select("h", "n", F.explode(orders).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("h", "n")).alias("hub"), F.max(F.struct("h", "n")).alias("end"))
    met = keyed.join(first, "key").select("h", "n", F.explode(F.array("hub", "end")).alias("other")).filter("h <> other.h or n <> other.n").distinct()
    met = met.select("h", "n", F.col("other.h").alias("h2"), F.col("other.n").alias("n2"))
    both = met.join(likely.select("h", "n", "lines"), ["h", "n"]).join(likely.select(F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("lines").alias("lines2")), ["h2", "n2"])
    near = both.filter(F.size(F.array_intersect("lines", "lines2")) >= overlap * F.size(F.array_union("lines", "lines2")))
    near = near.select(F.explode(F.array(F.struct("h", "n"), F.struct(F.col("h2").alias("h"), F.col("n2").alias("n")))).alias("c")).select("c.h", "c.n")
    return near.union(likely.filter("twice").select("h", "n")).distinct()


def dedup_lines(docs: DataFrame, max_docs: int = MAX_DOCS, spare_copies: bool = False) -> DataFrame:
    """The documents without the lines that occur in more than max_docs documents, and a column lines_dropped.

    Every line that isn't blank counts, however short. All occurrences go, also repeated ones within a text. n_chars is
    set to the new length. With spare_copies, a document that copies() finds to be a copy of another one is left whole,
    for a near-duplicate step to decide about. A null text stays null with 0 lines dropped and an empty one empty; a
    document all of whose lines go has an empty text. Rows with the same doc_id count as one document; equal lines of
    repeated rows are dropped alike. There are no ties: a line in just max_docs documents stays. Very long texts are
    taken whole, and a text without a line break is one line. Further columns pass through, whatever their names; if
    one is called lines_dropped, it stays as it is and the count isn't given. An empty table gives an empty one.
    """
    wide = {c.lower() for c in docs.columns}
    hashes = common.materialise(line_hashes(docs), "line-hashes")
    frequent = common.materialise(frequent_lines(hashes, max_docs), "frequent-lines")
    size = frequent.count() * 24
    hits = hashes.join(common.broadcast_if_small(frequent.select("line_hash"), size), "line_hash", "left_semi")
    drops = hits.groupBy("h", "n").agg(F.collect_set("pos").alias("pos"))
    if spare_copies:
        marks = frequent.select("line_hash", F.lit(True).alias("bad"))
        flagged = hashes.join(common.broadcast_if_small(marks, size), "line_hash", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
        spared = common.materialise(copies(flagged), "copies")
        drops = drops.join(common.broadcast_if_small(spared, spared.count() * 24), ["h", "n"], "left_anti")
    drops = common.materialise(drops, "line-drops")
    common.discard(hashes, frequent)
    size = drops.agg(F.sum(F.size("pos") * 4 + 64)).first()[0] or 0
    h, n, pos = common.unused(docs, "_cl_h", "_cl_n", "_cl_pos")
    keyed = docs.withColumns(dict(zip((h, n), _content())))
    joined = keyed.join(common.broadcast_if_small(drops.toDF(h, n, pos), size), [h, n], "left")
    (short,) = common.unused(joined, "_cl_short")
    joined = joined.withColumn(short, _without(F.when(F.col(pos).isNotNull(), F.col("text")), F.col(pos)))
    text = F.when(F.col(pos).isNull(), F.col("text")).otherwise(F.col(short))
    columns = []
    for c in docs.columns:
        if c.lower() == "text":
            columns.append(text.alias(c))
        elif c.lower() == "n_chars":
            columns.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(common.column(c))
    if "lines_dropped" not in wide:
        columns.append(F.coalesce(F.size(pos), F.lit(0)).alias("lines_dropped"))
    return joined.select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE = {
    "op10_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, text, pos, line, lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) > 0))
), looked AS (
  SELECT * FROM lines WHERE length(norm) > 0
), bad AS (
  SELECT norm FROM looked GROUP BY norm HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) > {MAX_DOCS}
), marked AS (
  SELECT l.doc_id, l.text, l.pos, l.line,
         l.norm IN (SELECT norm FROM bad) AS gone
  FROM lines l
), again AS (
  SELECT doc_id, text AS old, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS dropped
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, CASE WHEN a.old IS NULL THEN d.text ELSE a.text END AS text, d.lang, d.source,
       length(CASE WHEN a.old IS NULL THEN d.text ELSE a.text END) AS n_chars, CAST(coalesce(a.dropped, 0) AS INTEGER) AS lines_dropped
FROM documents d LEFT JOIN again a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.text = a.old
"""
}
