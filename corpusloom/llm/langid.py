"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte bigrams and trigrams of its lower-case UTF-8 form, (1 + log tf) * idf, of unit
length. Document frequencies are counted over all documents. Each language has up to CLUSTERS centroids, found by
spherical k-means over at most SAMPLE labelled documents of that language (the bound of the fit), one task a language;
what is collected is a language's centroids and thresholds. Outlying training texts, and clusters of few texts (junk
under a language's label), are left out. A text gets the language of the centroid with the greatest cosine; it is
rejected if that cosine is below the threshold for texts of its length, which is taken from how far pieces of training
texts of that length lie from their own language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Hash buckets; centroids a language; labelled documents a language that the fit reads at most.
BUCKETS, CLUSTERS, SAMPLE = 4096, 4, 400
#: Share of training pieces of a length that may lie below its threshold; share of a language's training texts that are outliers, and of a cluster at least; what of that quantile is the threshold, as new texts lie farther off than those that made the centroids.
TAIL, OUTLIERS, LEAST, MARGIN = 0.005, 0.03, 0.05, 0.8
_LENGTHS = 18  # thresholds for 2**0 .. 2**17 n-grams and more


def counts(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """N-gram counts, rows x buckets. Runs of anything but letters count as one space, so digits and signs say nothing."""
    data, offsets = common.flat(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, buckets), np.float32)
    letter = common._WORD[data] & ~((data >= 48) & (data <= 57))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each run
    kept = np.where(letter, data, np.uint8(32))[keep]
    sizes = np.concatenate([[0], np.cumsum(keep)])[offsets]
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(sizes))
    if len(kept) < 2:
        return np.zeros((n, buckets), np.float32)
    c = kept.astype(np.uint32)
    two = c[:-1] * np.uint32(0x01000193) + c[1:]
    shift = np.uint32(32 - (buckets - 1).bit_length())
    bi = ((two * np.uint32(0x9E3779B1)) >> shift).astype(np.int64) + rows[:-1] * buckets
    ok = rows[:-1] == rows[1:]
    total = np.bincount(bi[ok], minlength=n * buckets)
    if len(kept) > 2:
        three = two[:-1] * np.uint32(0x01000193) + c[2:]
        tri = ((three * np.uint32(0x85EBCA77)) >> shift).astype(np.int64) + rows[:-2] * buckets
        total += np.bincount(tri[rows[:-2] == rows[2:]], minlength=n * buckets)
    return total.reshape(n, buckets).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros_like(tf)
    np.log(tf, out=out, where=tf > 0)
    out += tf > 0
    out *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.maximum(norm, 1e-12)[:, None]
    return out


def _length(tf: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(tf.sum(axis=1), 1)).astype(np.int64), _LENGTHS - 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * clusters) x buckets
    owner: np.ndarray  # language of each centroid
    thresholds: np.ndarray  # by log2 of the number of n-grams

    def classify(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine, lead over the best centroid of another language, accepted."""
        n = len(tf)
        if not len(self.languages):
            return np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        cosine = vectors(tf, self.idf) @ self.centroids.T
        by = np.full((n, len(self.languages)), -1.0, np.float32)
        for k in range(len(self.languages)):
            by[:, k] = cosine[:, self.owner == k].max(axis=1)
        best = by.argmax(axis=1)
        top = by[np.arange(n), best].astype(np.float64)
        by[np.arange(n), best] = -1
        lead = top - (by.max(axis=1) if by.shape[1] > 1 else 0)
        accepted = (tf.sum(axis=1) > 0) & (top >= self.thresholds[_length(tf)])
        return best, top, lead, accepted


def k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = 15) -> np.ndarray:
    """Spherical k-means with k-means++ seeding; fewer rows than k give as many centroids."""
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        d = np.maximum(1 - (x @ np.array(centers).T).max(axis=1), 0) + 1e-9
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
    c = np.array(centers)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                v = x[own == j].sum(axis=0)
                c[j] = v / max(np.linalg.norm(v), 1e-12)
    return c


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """How many texts have each n-gram, over all documents, and how many documents there are. Each task adds up its own; one row a task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in common.slices(batch, 0):
                total += (counts(part.column(0), buckets) > 0).sum(axis=0)
                rows += part.num_rows
        yield pa.record_batch([pa.array(np.arange(-1, buckets, dtype=np.int32)), pa.array(np.concatenate([[rows], total]))], names=["k", "n"])

    got = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, np.int64)
    out[got.k.to_numpy(np.int64) + 1] = got.n.to_numpy(np.int64)
    return out[1:], int(out[0])


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): at most `sample` texts of each label, those with the smallest hash of (doc_id, text): a fixed, even choice. Only keys are ranked; texts are fetched for the chosen."""
    labelled = docs.filter("lang is not null and length(text) > 0").select("lang", F.xxhash64("doc_id", "text").alias("k"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # A hash below a bound that lets about twice the sample through, then the exact smallest.
    bound = F.lit(None).cast("long")
    for lang, n in sizes.items():
        share = min(1.0, 2.0 * sample / max(n, 1) + 20 / max(n, 1))
        bound = F.when(F.col("lang") == lang, F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)).otherwise(bound)
    chosen = docs.filter("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("k")).filter(F.col("k") <= bound)
    w = Window.partitionBy("lang").orderBy("k", "text")
    return chosen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sample).select("lang", "text", "r")


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)


def fit_language(texts: list[str], idf: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, thresholds by log2 of the number of n-grams; NaN where there are too few pieces) of one language."""
    buckets = len(idf)
    x = vectors(np.concatenate([counts(pa.array(texts[i : i + 50]), buckets) for i in range(0, len(texts), 50)]), idf)

    def nearest(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = x @ c.T
        return cosine.argmax(axis=1), cosine.max(axis=1)

    # Texts that lie far from all others make clusters of their own, which go; then the outliers of what is left.
    c = k_means(x, clusters)
    own, _ = nearest(c)
    sizes = np.bincount(own, minlength=len(c))
    large = sizes >= min(LEAST * len(x), sizes.max())
    inside = large[own]
    c = k_means(x[inside], int(large.sum()))
    _, near = nearest(c)
    inside &= near >= np.quantile(near[inside], OUTLIERS)
    c = k_means(x[inside], len(c))
    rng = np.random.default_rng(3)
    pieces = []
    for t in np.array(texts, object)[inside].tolist():
        for size in (4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048):
            if len(t) > size:
                at = int(rng.integers(0, len(t) - size + 1))
                pieces.append(t[at : at + size])
        pieces.append(t)
    seen: list[list[float]] = [[] for _ in range(_LENGTHS)]
    for i in range(0, len(pieces), 200):
        tf = counts(pa.array(pieces[i : i + 200]), buckets)
        for b, cosine in zip(_length(tf), (vectors(tf, idf) @ c.T).max(axis=1)):
            seen[b].append(float(cosine))
    return c, np.array([MARGIN * np.quantile(v, TAIL) if len(v) >= 20 else np.nan for v in seen])


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, buckets: int = BUCKETS) -> Model:
    df, n = document_frequencies(docs, buckets)
    idf = _idf(df, n)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        c, limits = fit_language(table.column("text").to_pylist(), idf, clusters)
        return pa.table({"lang": table.column("lang").slice(0, 1), "centroids": [c.astype(np.float32).tobytes()], "limits": [limits.tobytes()]})

    rows = training_texts(docs, sample).groupBy("lang").applyInArrow(run, "lang string, centroids binary, limits binary").collect()
    return assembled({r.lang: (np.frombuffer(r.centroids, np.float32).reshape(-1, buckets), np.frombuffer(r.limits)) for r in rows}, idf)


def assembled(fitted: dict[str, tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """The model of fitted languages. A length's threshold is the least of the languages'; where none has one, that of the next shorter length."""
    languages = sorted(fitted)
    centroids = np.concatenate([fitted[k][0] for k in languages]) if languages else np.zeros((0, len(idf)), np.float32)
    owner = np.repeat(np.arange(len(languages)), [len(fitted[k][0]) for k in languages]) if languages else np.zeros(0, np.int64)
    thresholds = np.zeros(_LENGTHS)
    for b in range(_LENGTHS):
        known = [fitted[k][1][b] for k in languages if not np.isnan(fitted[k][1][b])]
        thresholds[b] = min(known) if known else thresholds[b - 1] if b else 0.0
    return Model(languages, idf, centroids, owner, np.maximum(thresholds, 0.01))


def _classify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, part_column(batch)):
                tf = counts(part.column(part_column(batch)), len(model.idf))
                best, top, lead, ok = model.classify(tf)
                names = pa.array(model.languages, pa.string()).take(pa.array(best)) if model.languages else pa.nulls(len(best), pa.string())
                some = tf.sum(axis=1) > 0
                names = pa.compute.if_else(pa.array(some), names, pa.scalar(None, pa.string()))
                yield pa.record_batch([*part.columns, names, pa.array(top), pa.array(lead), pa.array(ok)], names=[*part.schema.names, "_cl_lang", "_cl_cosine", "_cl_lead", "_cl_ok"])

    def part_column(batch: pa.RecordBatch) -> int:
        return batch.schema.names.index("text")

    return run


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """(doc_id, predicted, cosine, lead, accepted) for every document.

    A null or empty text, or one without a letter, has predicted null and is rejected. Very long texts are read whole. Ties go to the language that
    sorts first. Repeated rows get equal answers; null ids and labels pass (unlabelled rows aren't trained on). With no
    labelled row every text is rejected. Further columns are ignored; an empty table gives no row.
    """
    common.small_batches(docs.sparkSession)
    model = model or fit(docs, **options)
    run = _classify(model)

    def lean(batches):
        for b in run(batches):
            yield b.select(["doc_id", "_cl_lang", "_cl_cosine", "_cl_lead", "_cl_ok"]).rename_columns(["doc_id", "predicted", "cosine", "lead", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean, f"doc_id {kind}, predicted string, cosine double, lead double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """The documents whose language is accepted, all columns unchanged. As identify() says of nulls and empty texts, which go."""
    common.small_batches(docs.sparkSession)
    model = model or fit(docs, **options)

    @F.pandas_udf("boolean")
    def ok(texts):
        import pandas as pd

        batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
        return pd.Series(np.concatenate([model.classify(counts(p.column(0), len(model.idf)))[3] for p in common.slices(batch, 0)] or [np.zeros(0, bool)]))

    return docs.filter(ok(F.col("text")))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_language_id": op5_langid}
ORACLE: dict[str, str] = {}
