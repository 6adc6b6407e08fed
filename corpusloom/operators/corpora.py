"""Style corpora: patterns and the sources that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE = "struct<locale:string,path:string,commit:string,blob:string,date:string,url:string>"
SOURCE = f"struct<id:string,repository:string,path:string,commit:string,blob:string,date:string,url:string,workflow:string,files:array<{FILE}>,use_for:array<string>,avoid:array<string>>"
PATTERN = "struct<id:string,origin:string,surface:string,evidence:array<string>,shape:string,required:array<string>,use_when:string>"
SCHEMA = f"schema int, verified string, sources array<{SOURCE}>, live_contracts array<{SOURCE}>, patterns array<{PATTERN}>, professional_patterns array<{PATTERN}>"


def load(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """One row: the corpus of a JSON file, under its name."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.lit(corpus).alias("corpus"), "*")


def _listed(corpora: DataFrame, groups: list[str], name: str) -> DataFrame:
    out = None
    for i, g in enumerate(groups):
        one = corpora.select("corpus", F.lit(i).alias("part"), F.lit(g).alias("group"), F.posexplode(g).alias("ord", name))
        out = one if out is None else out.unionByName(one)
    return out


def list_patterns(corpora: DataFrame) -> DataFrame:
    """corpus, group, ord, id, origin, surface of every pattern."""
    return _listed(corpora, ["patterns", "professional_patterns"], "p").select("corpus", "group", "part", "ord", "p.id", "p.origin", "p.surface")


def pattern(corpora: DataFrame, id_: str | None = None, locale: str | None = None) -> DataFrame:
    """corpus, group, id, place, source_id, repository, url, files: the evidence of one pattern or of all, in its order.

    With a locale, a source's files are those of the locale, and sources of files that have none are left out. Where
    an id is in several groups, the first counts.
    """
    p = _listed(corpora, ["patterns", "professional_patterns"], "p")
    if id_ is not None:
        p = p.filter(F.col("p.id") == id_)
    p = p.select("corpus", "group", "part", "p.id", "p.evidence", F.min("part").over(Window.partitionBy("corpus", "p.id")).alias("least")).filter("part = least")
    cited = p.select("corpus", "group", "id", F.posexplode("evidence").alias("place", "source_id"))
    s = _listed(corpora, ["sources"], "s").select("corpus", F.col("s.id").alias("source_id"), "s.repository", "s.url", "s.files")
    got = cited.join(s, ["corpus", "source_id"])
    if locale is not None:
        got = got.withColumn("files", F.filter("files", lambda f: f["locale"] == locale)).filter("files is null or size(files) > 0")
    return got.select("corpus", "group", "id", "place", "source_id", "repository", "url", F.transform("files", lambda f: F.struct(f["locale"].alias("locale"), f["url"].alias("url"))).alias("files"))


def source(corpora: DataFrame, id_: str) -> DataFrame:
    """corpus, type, source: a source by its id; sources come before live contracts."""
    s = _listed(corpora, ["sources", "live_contracts"], "s").filter(F.col("s.id") == id_)
    first = s.groupBy("corpus").agg(F.min_by(F.struct("part", "s"), "part").alias("x"))
    return first.select("corpus", F.when(F.col("x.part") == 0, "source").otherwise("live_contract").alias("type"), F.col("x.s").alias("source"))


def one(df: DataFrame, id_: str) -> DataFrame:
    """df itself; KeyError where it is empty."""
    if df.isEmpty():
        raise KeyError(id_)
    return df


def pinned(corpora: DataFrame) -> DataFrame:
    """corpus, source_id, repository, path, commit, blob, date, url of every pinned file: a source's files, or the source itself."""
    s = _listed(corpora, ["sources"], "s").select("corpus", "s.*")
    own = F.array(F.struct(F.lit(None).cast("string").alias("locale"), "path", "commit", "blob", "date", "url"))
    return s.select("corpus", F.col("id").alias("source_id"), "repository", F.explode(F.coalesce("files", own)).alias("f")).select("corpus", "source_id", "repository", "f.path", "f.commit", "f.blob", "f.date", "f.url")
