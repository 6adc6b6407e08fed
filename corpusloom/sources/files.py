"""Files as documents: which are read, and what is told of those that can't be."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import java
from corpusloom.operators import kinds

#: Bytes of a file of unknown kind that are looked at.
SNIFF = 8192
FOUND = "path string, line int, code string, severity string, message string, sample string"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a glob matches the whole path or its last part."""
    globs = [java(r"\A" + fnmatch.translate(p)) for p in patterns]
    return reduce(lambda a, g: a | path.rlike(g) | name_of(path).rlike(g), globs, F.lit(False))


def is_text(content: Column) -> Column:
    """No NUL and valid UTF-8 in the first SNIFF bytes; a character that the cut splits makes it invalid."""
    begin = F.substring(content, 1, SNIFF)
    return F.is_valid_utf8(begin.cast("string")) & (F.instr(F.decode(begin, "ISO-8859-1"), "\0") == 0)


def read(spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """path, text, valid of the files under the paths, searched to any depth. text is null where the bytes aren't UTF-8.

    Folders of version control and of dependencies are passed over; files of unknown suffix are read if they are text.
    Missing paths have no row here, but a finding in missing().
    """
    there, _ = present(spark, paths)
    if not there:
        return spark.createDataFrame([], "path string, text string, valid boolean")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    path = F.regexp_replace("path", "^file:/+", "/")
    skipped = "/(?:" + "|".join(f.replace(".", r"\.") for f in kinds.SKIPPED_FOLDERS) + ")/"
    raw = raw.select(path.alias("path"), "content").filter(~F.col("path").rlike(skipped) & ~excluded(F.col("path"), exclude))
    raw = raw.filter(kinds.known(F.col("path")) | is_text(F.col("content")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(valid, F.col("content").cast("string")).alias("text"), valid.alias("valid"))


def present(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """The paths that exist and those that don't."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = {p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q) for p in paths}
    return [p for p in paths if there[p]], [p for p in paths if not there[p]]


def missing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A finding at line 0 for each path that doesn't exist."""
    return spark.createDataFrame([(p, 0, "input.missing", "error", "there is no such file or folder", "") for p in present(spark, paths)[1]], FOUND)


def unreadable(files: DataFrame) -> DataFrame:
    """A finding at line 0 for each file that isn't UTF-8."""
    told = [F.lit(x).alias(c) for c, x in (("line", 0), ("code", "io.read"), ("severity", "error"), ("message", "the file isn't valid UTF-8"), ("sample", ""))]
    return files.filter(~F.col("valid")).select("path", *told)


def write_fixed(fixed: DataFrame, folder: str) -> None:
    """The changed documents as a table in another folder: the inputs stay, and a reader never sees half of a change."""
    fixed.filter("changed").select("path", "text").write.mode("overwrite").option("compression", "gzip").json(folder)
