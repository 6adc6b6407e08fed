"""Dictionary files as relations. Every reader gives ENTRY rows: the values that a search compares, and what it shows.

A gzip file is read as one partition, so that the ids that Spark gives its lines increase in their order.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "source string, authority string, part int, ord bigint, values array<string>, whole string, term string, detail string"


def entry(source: str, authority: str, ord_: Column, values: Column, term: Column | None, detail: Column, part: int = 0, whole: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        F.lit(source).alias("source"), F.lit(authority).alias("authority"), F.lit(part).cast("int").alias("part"), ord_.cast("long").alias("ord"), values.alias("values"),
        (none if whole is None else whole).alias("whole"), (none if term is None else term).alias("term"), detail.alias("detail"),
    ]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of a text file, also a compressed one."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def _fields(line: str = "line") -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda x: x != "")


def optional(read, spark: SparkSession, path: str) -> DataFrame:
    """What a reader gives, or no row where the file is absent."""
    q = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = q.getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    return read(spark, path) if there else spark.createDataFrame([], ENTRY)


def frequencies(spark: SparkSession, path: str, source: str, authority: str, note: str, least: int = 1, part: int = 0, category: str | None = None) -> DataFrame:
    """Word lists: a word, then how frequent it is."""
    f = F.col("f")
    lead = f"category={category}; " if category else ""
    detail = F.concat(F.lit(lead + "frequency="), F.coalesce(F.get(f, F.lit(1)), F.lit("unknown")), F.lit("; " + note))
    return lines(spark, path).select("ord", _fields().alias("f")).filter(F.size("f") >= least).select(*entry(source, authority, F.col("ord"), F.slice(f, 1, 1), F.get(f, F.lit(0)), detail, part))


def cedict(spark: SparkSession, path: str) -> DataFrame:
    """Lines `traditional simplified [reading] /meanings/`."""
    p = r"^(\S+) (\S+) \[([^\]]+)\] /(.*)/\s*$"
    got = lines(spark, path).filter(F.col("line").rlike(p)).select("ord", *[F.regexp_extract("line", p, i + 1).alias(c) for i, c in enumerate(("t", "s", "reading", "gloss"))])
    return got.select(*entry("cc-cedict", "general-dictionary", F.col("ord"), F.array("t", "s"), F.concat_ws(" / ", "t", "s"), F.concat_ws("; ", "reading", F.substring("gloss", 1, 180))))


def terminology_csv(spark: SparkSession, path: str, columns: tuple[str, str, str]) -> DataFrame:
    """English, Taiwan and Mainland forms; several forms in a cell stand between semicolons. A byte order mark is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns]).withColumn("ord", F.monotonically_increasing_id())
    forms = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[；;]"), lambda x: F.trim(x)), lambda x: x != "")
    en, tw, cn = columns
    got = raw.select("ord", F.coalesce(F.col(en), F.lit("")).alias("en"), forms(tw).alias("tw"), forms(cn).alias("cn"))
    detail = F.concat(F.lit("zh-TW="), F.array_join("tw", "；"), F.lit("; zh-CN="), F.array_join("cn", "；"))
    return got.select(*entry("naer", "official-terminology", F.col("ord"), F.concat(F.array("en"), "tw", "cn"), F.col("en"), detail))


def php_tables(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """part, table, ord, key, value of arrays `NAME = [` ... in a PHP file."""
    text = spark.read.text(path, wholetext=True)
    p = r"'([^']+)' => '([^']*)'"
    out = None
    for i, t in enumerate(tables):
        body = F.substring_index(F.element_at(F.split("value", rf"\Q{t} = [\E", 2), 2), "\n\t];", 1)
        one = text.filter(F.col("value").contains(f"{t} = [")).select(F.posexplode(F.regexp_extract_all(body, F.lit(p), F.lit(0))).alias("ord", "m"))
        one = one.select(F.lit(i).alias("part"), F.lit(t).alias("table"), F.col("ord").cast("long"), F.regexp_extract("m", p, 1).alias("key"), F.regexp_extract("m", p, 2).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def conversions(tables: DataFrame, locales: dict[str, str]) -> DataFrame:
    """Entries of php_tables(); locales names that of each table."""
    locale = F.element_at(F.create_map(*[F.lit(x) for kv in locales.items() for x in kv]), F.col("table"))
    cols = entry("zhconversion", "regional-vocabulary", F.col("ord"), F.array("key", "value"), F.concat_ws(" → ", "key", "value"), F.concat(locale, F.lit(" table")))
    return tables.select(*[c for i, c in enumerate(cols) if i != 2], "part").selectExpr("source", "authority", "cast(part as int) part", "ord", "values", "whole", "term", "detail")


def zip_lines(spark: SparkSession, path: str, ending: str = ".txt", member: str | None = None) -> DataFrame:
    """member, part, ord, line of the text files in ZIP archives, in the archive's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for part, n in enumerate(n for n in z.namelist() if (n == member if member else n.endswith(ending))):
                        got = z.read(n).decode().splitlines()
                        yield pa.record_batch([pa.array([n] * len(got), pa.string()), pa.array([part] * len(got), pa.int32()), pa.array(range(len(got)), pa.int64()), pa.array(got, pa.string())], names=["member", "part", "ord", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, part int, ord long, line string")


def conversion_archive(spark: SparkSession, path: str) -> DataFrame:
    v = F.split("line", "\t")
    cols = entry("opencc", "conversion", F.col("ord"), v, F.array_join(v, " → "), F.col("member"))
    return zip_lines(spark, path).select(*[c for i, c in enumerate(cols) if i != 2], "part").select("source", "authority", "part", "ord", "values", "whole", "term", "detail")


def variants(spark: SparkSession, path: str, member: str = "Unihan_Variants.txt") -> DataFrame:
    """Entries of characters, by code point."""
    got = zip_lines(spark, path, member=member).select("ord", F.split(F.rtrim("line"), "\t").alias("f")).filter(F.size("f") == 3)
    f = F.col("f")
    return got.select(*entry("unihan", "character-data", F.col("ord"), F.slice(f, 1, 1), F.get(f, F.lit(0)), F.concat_ws("=", F.get(f, F.lit(1)), F.get(f, F.lit(2)))))


def candidates(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """Input method data, (path, label): a search compares fields or the whole line, and shows the query itself."""
    out = None
    for part, (path, label) in enumerate(paths):
        one = lines(spark, path).filter(~F.col("line").startswith("#"))
        one = one.select(*entry("mcbopomofo", "candidate-corpus", F.col("ord"), _fields(), None, F.concat(F.lit(label + ": "), F.substring(F.trim("line"), 1, 180)), part, F.col("line")))
        out = one if out is None else out.unionByName(one)
    return out


def titles(spark: SparkSession, path: str, source: str, note: str, tabbed: bool = False) -> DataFrame:
    """Article titles: whole lines, or what stands before the tab of lines that have one and are no comments."""
    got = lines(spark, path)
    if tabbed:
        got = got.filter(~F.col("line").startswith("#") & F.col("line").contains("\t")).withColumn("line", F.substring_index("line", "\t", 1))
    return got.select(*entry(source, "candidate-corpus", F.col("ord"), F.array("line"), F.col("line"), F.lit(note)))


def name(path: str) -> str:
    return PurePosixPath(path).name
