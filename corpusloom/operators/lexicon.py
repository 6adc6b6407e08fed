"""Dictionary lookup and regional vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.plans import pack as packs
from corpusloom.sources.lexicons import ENTRY

#: Sources in the order in which results are listed.
SOURCES = "technical naer zhconversion opencc cc-cedict unihan mcbopomofo moegirl zhwiki jieba thuocl rime-essay".split()
LIMIT = 8
#: Bytes of queries, as counted, up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


def _grams(x: Column, n: int) -> Column:
    """The distinct runs of n characters (one or two) of a text. It is cut into characters once, as finding the i-th one takes a walk over those before it."""
    signs = F.filter(F.split(x, ""), lambda c: c != "")
    if n == 1:
        return F.array_distinct(signs)
    return X.let(signs, lambda cs: F.array_distinct(F.zip_with(F.slice(cs, F.lit(1), F.greatest(F.size(cs) - 1, F.lit(0))), F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(0))), lambda a, b: F.concat(a, b))))


def technical(spark: SparkSession, pack: packs.Pack) -> DataFrame:
    """Entries of the pack itself: preserved identifiers, then the terms that aren't among them."""
    kept = pack.terms.get("preserve", [])
    rows = [("technical", "project-policy", 0, i, [t], None, t, "preserve this identifier") for i, t in enumerate(kept)]
    for i, t in enumerate(pack.terms.get("terms", [])):
        if t["en"] not in set(kept):
            rows.append(("technical", "local-default", 1, i, [t["en"], t["zh-CN"], t["zh-TW"]], None, t["en"], f"zh-CN={t['zh-CN']}; zh-TW={t['zh-TW']}; domain={t['domain']}"))
    return spark.createDataFrame(rows, ENTRY)


def code_point(ch: Column) -> Column:
    """U+ and four hex digits at least, five or six beyond the basic plane."""
    code = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code))


def _matches(query: Column, contains: bool) -> Column:
    """Characters are looked up by code point and only exactly; a whole line, where there is one, is what a substring is sought in."""
    codes = F.transform(F.filter(F.split(query, ""), lambda c: c != ""), code_point)
    is_character = F.col("source") == "unihan"
    if contains:
        return ~is_character & F.when(F.col("whole").isNotNull(), F.contains("whole", query)).otherwise(F.exists("values", lambda v: F.contains(v, query)))
    return F.when(is_character, F.arrays_overlap("values", codes)).otherwise(F.array_contains("values", query))


def _first(found: DataFrame, limit: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys, "source").orderBy("part", "ord")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def _check(sources: Sequence[str] | None, limit: int) -> list[str]:
    if limit < 1:
        raise ValueError("the limit must be positive")
    if unknown := set(sources or ()) - set(SOURCES):
        raise ValueError(f"unknown sources: {', '.join(sorted(unknown))}")
    return list(sources or SOURCES)


def _place(sources: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, sources)), F.col("source"))


def lookup(entries: DataFrame, query: str, sources: Sequence[str] | None = None, contains: bool = False, limit: int = LIMIT) -> DataFrame:
    """source, authority, term, detail of the entries that match, at most `limit` of each source, in the order of sources and files."""
    wanted = _check(sources, limit)
    q = F.lit(query)
    found = _first(entries.filter(F.col("source").isin(wanted) & _matches(q, contains)), limit)
    return found.orderBy(_place(wanted), "part", "ord").select("source", "authority", F.coalesce("term", q).alias("term"), "detail")


def lookup_many(entries: DataFrame, queries: DataFrame, sources: Sequence[str] | None = None, contains: bool = False, limit: int = LIMIT) -> DataFrame:
    """query, source, n, authority, term, detail for every row of queries(query); exact lookups are a hash join on the listed values. Null queries match nothing, repeated ones count once.

    With contains, queries meet only values that have their first two characters (or the one that they have), by a hash
    join, and are then sought in those; an empty query matches nothing.
    """
    wanted = _check(sources, limit)
    asked = queries.select("query").filter("query is not null").distinct()
    some = entries.filter(F.col("source").isin(wanted))
    if contains:
        sought = F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.col("values"))
        parts = F.flatten(F.transform(sought, lambda v: F.concat(_grams(v, 1), _grams(v, 2))))
        keyed = some.filter("source <> 'unihan'").select("*", F.explode(F.array_distinct(parts)).alias("key"))
        begun = asked.filter("query <> ''").select("query", F.substring("query", 1, 2).alias("key"))
        # The entries, once for each key, are never what is sent to all: Spark would judge them by the size of their compressed file.
        size = begun.agg(F.sum(F.octet_length("query") + 64).alias("size")).first().size or 0
        begun = F.broadcast(begun) if size <= BROADCAST_BYTES else begun
        found = (keyed if size <= BROADCAST_BYTES else keyed.hint("merge")).join(begun, "key").filter(_matches(F.col("query"), True))
    else:
        keyed = some.select("*", F.explode(F.array_distinct("values")).alias("key"))
        words = keyed.filter("source <> 'unihan'").join(asked, F.col("key") == F.col("query"))
        signs = asked.select("query", F.explode(F.array_distinct(F.filter(F.split("query", ""), lambda c: c != ""))).alias("ch")).select("query", code_point(F.col("ch")).alias("code"))
        found = words.unionByName(keyed.filter("source = 'unihan'").join(signs, F.col("key") == F.col("code")).drop("code"))
    return _first(found, limit, "query").select("query", "source", "n", "authority", F.coalesce("term", "query").alias("term"), "detail")


def references(catalog: DataFrame) -> DataFrame:
    """Sources that are only pointed to, of (id, authority, role, url, license, checked, note)."""
    told = F.concat_ws("; ", "role", "url", F.when(F.col("license") != "", F.concat(F.lit("license="), "license")), F.when(F.col("checked") != "", F.concat(F.lit("checked="), "checked")), F.when(F.col("note") != "", F.col("note")))
    return catalog.select(F.col("id").alias("source"), "authority", F.col("id").alias("term"), told.alias("detail"))


# ---- regional vocabulary --------------------------------------------------------------------------


def regional_pairs(phrases: DataFrame, characters: DataFrame, pack: packs.Pack, locale: str) -> DataFrame:
    """(wrong, preferred): words of another region in the script of the locale.

    phrases(part, ord, key, value) are conversions, characters(ch, target) converts single characters. Left out are
    words of one character, those that stay the same or hold each other, and what the pack decides about; of several
    conversions to one wrong form the first counts.
    """
    decided = sorted(pack.maintained(locale) | set(pack.wording.get("regional_exceptions", {}).get(locale, [])))
    first = F.substring_index("value", " ", 1)
    named = phrases.filter("length(value) > 0").select("part", "ord", "key", first.alias("preferred"))
    signs = named.select("part", "ord", "key", "preferred", F.posexplode(F.split("key", "")).alias("i", "ch")).join(characters.select("ch", F.substring_index("target", " ", 1).alias("to")), "ch", "left")
    spelled = signs.groupBy("part", "ord", "key", "preferred").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("to", "ch").alias("c")))), lambda x: x["c"]), "").alias("wrong"))
    fit = spelled.filter((F.length("wrong") >= 2) & ~F.col("wrong").isin(decided) & ~F.contains("wrong", "preferred") & ~F.contains("preferred", "wrong"))
    return fit.withColumn("n", F.row_number().over(Window.partitionBy("wrong").orderBy("part", "ord"))).filter("n = 1").select("wrong", "preferred")


def regional_findings(ruled: DataFrame, pairs: DataFrame, words: DataFrame | None, o) -> DataFrame:
    """Findings of regional vocabulary in views (path, rule), but for hits that a longer dictionary word covers."""
    from corpusloom.operators import lint

    # Lines meet the words with whose first two characters they have, by a hash join on keys alone. No word goes over a
    # line feed. Lines without ideographs take part only if there is a word without them.
    texts = ruled.filter(F.col("rule").rlike(X.CJK))
    begun = pairs.select("wrong", "preferred", F.substring("wrong", 1, 2).alias("key"))
    plain = pairs.agg(F.coalesce(F.bool_or(~F.col("wrong").rlike(X.CJK)), F.lit(False))).scalar()
    pieces = X.let(X.segments(F.col("rule")), lambda all_: F.filter(all_, lambda s: s["text"].rlike(X.CJK)))
    lines = texts.select("path", F.inline(F.when(plain, X.segments(F.col("rule"))).otherwise(pieces))).withColumnsRenamed({"line": "at_line", "text": "window"})
    maybe = lines.select("path", "at_line", F.explode(_grams(F.col("window"), 2)).alias("key")).join(begun, "key").select("path", "at_line", "wrong", "preferred").distinct()
    met = lines.join(maybe, ["path", "at_line"]).filter(F.contains("window", "wrong"))
    hits = met.select("*", F.explode(X.lined(F.col("window"), F.concat(F.lit("\\Q"), F.col("wrong"), F.lit("\\E")))).alias("m"))
    f = lint.finding(F.col("at_line") + F.col("m.line") - 1, "terminology.regional", F.concat(F.lit("say "), F.col("preferred"), F.lit(f" in {o.locale}")), F.col("wrong"), window=F.col("window"), at=F.col("m.pos"))
    found = hits.select("path", f.alias("f")).select("path", "f.*")
    own = pairs.sparkSession.createDataFrame([(w,) for w in o.pack.words()], "word string")
    every = (own if words is None else own.unionByName(words.select("word"))).distinct()
    held = every.select("word", F.explode(_grams(F.col("word"), 2)).alias("key")).join(begun.select("key", F.col("wrong").alias("term")), "key")
    covering = held.filter(F.contains("word", "term") & (F.length("word") > F.length("term"))).select("term", "word").distinct()
    return lint.drop_covered(found, covering).select(*lint.COLUMNS)
