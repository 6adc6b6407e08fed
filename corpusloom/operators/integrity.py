"""Constraints as queries: snapshots against their manifest, rule packs, counts for maintenance, and digests of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def git_blob(content: Column) -> Column:
    """The hash that git gives a file of this content (binary)."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def rate_limited(status: Column, remaining: Column, body: Column) -> Column:
    return (status == 429) | ((status == 403) & (F.coalesce(remaining == "0", F.lit(False)) | F.lower(F.coalesce(body, F.lit(""))).contains("rate limit")))


def verify_blobs(pinned: DataFrame, fetched: DataFrame) -> DataFrame:
    """source_id, path, state (ok, changed, rate-limited, missing): pinned(source_id, path, url, blob) against fetched(url, status, remaining, content)."""
    f = pinned.join(fetched, "url", "left")
    body = F.col("content").cast("string")
    state = F.when(F.col("status").isNull(), "missing").when(rate_limited(F.col("status"), F.col("remaining"), body), "rate-limited").when(F.col("status") != 200, "missing").when(git_blob(F.col("content")) == F.col("blob"), "ok").otherwise("changed")
    return f.select("source_id", "path", state.alias("state"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reconcile(config: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(check, subject): how a snapshot differs from what it should be.

    config(source, bundled, path, pinned), manifest(source, path, stored, bytes) and disk(path, stored, bytes) have a
    row for each file. Sources and files are compared by full outer joins, then the digests and sizes of what is on
    both sides.
    """
    told = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).alias("subject")).distinct()
    cs = config.groupBy("source").agg(F.bool_or(F.coalesce("bundled", F.lit(True))).alias("bundled"))
    ms = manifest.select("source").distinct().withColumn("recorded", F.lit(True))
    s = cs.join(ms, "source", "full_outer")
    c = config.filter(F.coalesce("bundled", F.lit(True))).select("path", "pinned", F.lit(True).alias("wanted"))
    m = manifest.select("path", F.col("stored").alias("m_stored"), F.col("bytes").alias("m_bytes"), F.lit(True).alias("recorded"))
    d = disk.select("path", F.col("stored").alias("d_stored"), F.col("bytes").alias("d_bytes"), F.lit(True).alias("there"))
    f = c.join(m, "path", "full_outer").join(d, "path", "full_outer")
    parts = [
        told(s.filter("bundled and recorded is null"), "missing source", "source"),
        told(s.filter("bundled is null"), "unknown source", "source"),
        told(s.filter("not bundled and recorded"), "non-bundled source", "source"),
        told(repeated(manifest, "path"), "duplicate file", "path"),
        told(f.filter("wanted and recorded is null"), "missing file in manifest", "path"),
        told(f.filter("recorded and wanted is null"), "unknown file in manifest", "path"),
        told(f.filter("recorded and there is null"), "missing file", "path"),
        told(f.filter("there and recorded is null"), "unrecorded file", "path"),
        told(f.filter("m_stored <> d_stored"), "stored digest changed", "path"),
        told(f.filter("m_bytes <> d_bytes"), "stored size changed", "path"),
        told(f.filter("pinned <> d_stored"), "pinned digest changed", "path"),
    ]
    return reduce(DataFrame.unionByName, parts)


def on_disk(files: DataFrame) -> DataFrame:
    """path, stored, bytes of files(path, content)."""
    return files.select("path", F.sha2("content", 256).alias("stored"), F.octet_length("content").cast("long").alias("bytes"))


def term_violations(terms: DataFrame, preserved: DataFrame) -> DataFrame:
    """(check, subject) of a table of terms (en, zh_cn, zh_tw, enforce, reject) and of preserved(term)."""
    told = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"))
    bad = terms.select("en", "zh_cn", "zh_tw", F.explode("reject").alias("locale", "forms")).select("*", F.explode("forms").alias("form"))
    own = bad.filter("(locale = 'zh-CN' and form = zh_cn) or (locale = 'zh-TW' and form = zh_tw)")
    preferred = terms.select(F.col("en").alias("other"), F.explode(F.create_map(F.lit("zh-CN"), "zh_cn", F.lit("zh-TW"), "zh_tw")).alias("locale", "form"))
    parts = [
        told(repeated(terms, "en"), "repeated term", "en"),
        told(repeated(preserved, "term"), "repeated identifier", "term"),
        told(terms.join(preserved, terms["en"] == preserved["term"], "left_semi"), "term is preserved", "en"),
        told(terms.filter("coalesce(zh_cn, '') = '' or coalesce(zh_tw, '') = ''"), "incomplete term", "en"),
        told(own, "preferred form is rejected", "en"),
        told(bad.join(preferred, ["locale", "form"]).filter("other <> en"), "rejected form is preferred elsewhere", "en"),
    ]
    return reduce(DataFrame.unionByName, parts)


def wording_violations(literals: DataFrame, rules: DataFrame) -> DataFrame:
    """(check, subject): repeated literals and ids, and ids that are no slugs."""
    ids = literals.select(F.col("group_id").alias("id")).distinct().unionByName(rules.select("id"))
    told = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).alias("subject"))
    return told(repeated(literals, "term"), "repeated literal", "term").unionByName(told(repeated(ids, "id"), "repeated id", "id")).unionByName(told(ids.filter("id not rlike '^[a-z0-9]+(-[a-z0-9]+)*$'"), "id is no slug", "id"))


def pinned_violations(pinned: DataFrame, cutoff: str) -> DataFrame:
    """(check, subject) of pinned(source_id, commit, blob, date): hashes of 40 hex digits, and real dates up to the cutoff."""
    real = F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "yyyy-MM-dd") == F.col("date")
    bad = F.array_compact(F.array(F.when(~F.col("commit").rlike("^[0-9a-f]{40}$"), "commit"), F.when(~F.col("blob").rlike("^[0-9a-f]{40}$"), "blob"), F.when(~F.coalesce(real, F.lit(False)) | (F.col("date") > cutoff), "date")))
    return pinned.select(F.explode(bad).alias("check"), F.col("source_id").alias("subject"))


def counts_by_category(cases: DataFrame, categories: DataFrame) -> DataFrame:
    """category, cases: also those that have none."""
    return categories.select("category").distinct().join(cases, "category", "left").groupBy("category").agg(F.count("case_id").alias("cases"))


def report(pack, spark) -> DataFrame:
    """(section, metric, value): what a pack holds."""
    w = pack.wording
    sizes = {k: len(w[s]) for k, s in (("literal_groups", "literal_groups"), ("regex", "regex_rules"), ("grammar", "grammar_rules"), ("consistency_groups", "consistency_groups"))}
    rows = [("rules", k, n) for k, n in sizes.items()] + [("rules", "total", sum(sizes.values()))]
    literal = pack.literal_terms(spark).agg(F.count("*").alias("value")).select(F.lit("rules").alias("section"), F.lit("literal_terms").alias("metric"), "value")
    terms = pack.term_table(spark).groupBy("domain").agg(F.count("*").alias("value")).select(F.lit("terms").alias("section"), F.col("domain").alias("metric"), "value")
    return spark.createDataFrame(rows, "section string, metric string, value long").unionByName(literal).unionByName(terms)


def _told(df: DataFrame, check: str, subject: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject")).distinct()


def rule_violations(rules: DataFrame, styles: DataFrame, limits: DataFrame, groups: DataFrame) -> DataFrame:
    """(check, subject): rules(id, pattern, styles), styles(style), limits(style, name, value) and groups(id, forms) of a pack.

    Patterns must compile, styles must be known, limits positive, and a group needs two forms or more. Null styles
    mean all; a null limit is none. Patterns are compiled once a distinct one, in Python.
    """

    @F.pandas_udf("boolean")
    def compiles(patterns):
        import re

        def one(p):
            try:
                return p is not None and bool(re.compile(p))
            except re.error:
                return False

        return patterns.map(one)

    used = rules.select("id", F.explode("styles").alias("style"))
    parts = [
        _told(rules.filter(~compiles("pattern")), "pattern doesn't compile", "id"),
        _told(used.join(styles, "style", "left_anti"), "unknown style", "id"),
        _told(limits.filter("value <= 0").withColumn("at", F.concat_ws(".", "style", "name")), "limit isn't positive", "at"),
        _told(groups.filter(F.size(F.array_distinct(F.coalesce("forms", F.array().cast("array<string>")))) < 2), "group of fewer than two forms", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def case_violations(cases: DataFrame, least: int = 3, longest: int = 160) -> DataFrame:
    """(check, subject) of cases(id, category, prompt_locale, prompt, should_trigger) of an evaluation.

    Ids are unique; each category has `least` cases or more and either all or none trigger; prompts have a text of at
    most `longest` characters; both answers and every locale of one answer occur with the other, too.
    """
    by = cases.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("should_trigger").alias("answers"))
    locales = cases.groupBy("prompt_locale").agg(F.countDistinct("should_trigger").alias("answers"))
    parts = [
        _told(repeated(cases, "id"), "repeated case", "id"),
        _told(by.filter(F.col("n") < least), "too few cases", "category"),
        _told(by.filter("answers > 1"), "category of both answers", "category"),
        _told(cases.filter("prompt is null or trim(prompt) = ''"), "empty prompt", "id"),
        _told(cases.filter(F.length("prompt") > longest), "long prompt", "id"),
        _told(locales.filter("answers < 2"), "locale of one answer", "prompt_locale"),
    ]
    return reduce(DataFrame.unionByName, parts)


def source_violations(files: DataFrame) -> DataFrame:
    """(check, subject) of the files(source, path, url, sha256, rolling, relaxed_tls) of a catalogue of sources.

    A path is listed once and is a plain name; addresses are https; a digest of 64 hex digits is required unless the
    file rolls on, and always where certificates aren't checked.
    """
    digest = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    parts = [
        _told(repeated(files, "path"), "path is listed twice", "path"),
        _told(files.filter("path rlike '[/\\\\\\\\]' or path in ('', '.', '..')"), "path is no plain name", "path"),
        _told(files.filter("url not like 'https://%'"), "address isn't https", "path"),
        _told(files.filter(~digest & ~F.coalesce("rolling", F.lit(False))), "digest is missing", "path"),
        _told(files.filter(F.coalesce("relaxed_tls", F.lit(False)) & ~digest), "unchecked certificate without digest", "path"),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_violations(patterns: DataFrame, sources: DataFrame, least: int = 2) -> DataFrame:
    """(check, subject) of the patterns(id, evidence) and sources(id, repository) of a style corpus: evidence of `least` different sources, all known, of `least` owners."""
    cited = patterns.select("id", F.explode(F.array_distinct("evidence")).alias("source_id"))
    known = cited.join(sources.select(F.col("id").alias("source_id"), F.substring_index("repository", "/", 1).alias("owner")), "source_id", "left")
    by = known.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))
    counted = patterns.select("id").join(by, "id", "left").fillna(0, ["n", "owners"])
    parts = [
        _told(repeated(patterns, "id"), "repeated pattern", "id"),
        _told(repeated(sources, "id"), "repeated source", "id"),
        _told(known.filter("owner is null"), "unknown source", "id"),
        _told(counted.filter(F.col("n") < least), "too little evidence", "id"),
        _told(counted.filter((F.col("n") >= least) & (F.col("owners") < least)), "evidence of one owner", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def corpus_report(pinned: DataFrame) -> DataFrame:
    """corpus, files, verified, optional: how many files of pinned(corpus, state, optional) there are, how many are verified, and how many may be absent."""
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return pinned.groupBy("corpus").agg(F.count("*").alias("files"), count_if(F.col("state") == "ok").alias("verified"), count_if(F.coalesce("optional", F.lit(False))).alias("optional"))


def checks_hold(violations: DataFrame) -> DataFrame:
    """One row: whether there is no violation, and the sorted distinct names of the checks that fail."""
    return violations.agg((F.count("*") == 0).alias("holds"), F.array_join(F.array_sort(F.collect_set("check")), ", ").alias("failing"))
