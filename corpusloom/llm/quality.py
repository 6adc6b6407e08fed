"""Document quality by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Documents are grouped by their pattern of votes, which is all that
expectation-maximisation needs: it estimates how often each rule is right on good documents and on each kind of bad
ones (junk of one kind breaks other rules than junk of another), and their shares, over all documents. The posterior probability of being good then follows from a document's votes by a sum
of log odds, and replaces a filter that every rule must pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Posterior probability from which a document is kept; rounds of expectation-maximisation at most.
KEEP, ROUNDS = 0.5, 200
#: Kinds of bad documents at most.
KINDS = 6

#: rule: (feature, votes bad below, votes bad above, votes good from, votes good to, words that it needs).
RULES: dict[str, tuple[str, float, float, float, float, int]] = {
    "symbols": ("symbol_share", -1, 0.08, 0, 0.02, 3),
    "capitals": ("capital_share", -1, 0.30, 0, 0.12, 5),
    "repeats": ("repeat_share", -1, 0.15, 0, 0.02, 10),
    "word_length": ("word_length", 2.0, 13.0, 3.0, 9.0, 10),
    "bars": ("bar_share", -1, 0.10, 0, 0.0, 5),
    "shouting": ("shout_share", -1, 0.10, 0, 0.01, 5),
    "stop_words": ("stop_share", 0.01, 2, 0.05, 1, 20),
    "sentences": ("end_share", 0.02, 2, 0.05, 0.5, 30),
    "digits": ("digit_share", -1, 0.20, 0, 0.05, 3),
    "same_lines": ("same_line_share", -1, 0.30, 0, 0.0, 30),
    "variety": ("variety", 0.15, float("inf"), 0.25, float("inf"), 30),
    "marks": ("mark_share", -1, 0.9, 0, 0.4, 5),
}
NAMES = list(RULES)
STOP_WORDS = "the of and to in is that for on with as by at from this it be are was he an or le la les de des du et en un une que qui dans pour par sur est au aux der die das und zu den von mit ist im für auf ein eine nicht sich el los las del y se con para su al lo como una por es".split()
_STOP = np.sort(np.unique(np.array([common.hash_word(w) for w in STOP_WORDS], np.uint64)))


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """The measured features of each text and its number of words; a text without words has zeros."""
    raw, offsets = common.flat(column, lower=False)
    n = len(offsets) - 1
    data = raw.copy()
    big = (raw >= 65) & (raw <= 90)
    data[big] += 32
    starts, ends = common.words(data)
    first = common.counts_by_row(starts, offsets)
    n_words = np.diff(first)
    per_word = 1 / np.maximum(n_words, 1)

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(np.float64)

    def words_where(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[first]).astype(np.float64)

    char = (raw & 0xC0) != 0x80
    space = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    solid = np.maximum(bytes_where(char & ~space), 1)
    letter = ((data >= 97) & (data <= 122)) | (char & (raw >= 0x80))
    h = common.hash_spans(data, starts, ends)
    row = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at = np.minimum(np.searchsorted(_STOP, h), len(_STOP) - 1)
    stop = _STOP[at] == h
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][new], minlength=n) if len(h) else np.zeros(n)
    bang = raw == 33
    shout = bang.copy()
    shout[1:] &= bang[:-1]
    # Lines, with the repeated ones within a text.
    cut = np.flatnonzero(raw == 10)
    begin = np.concatenate([[0], cut[:-1] + 1]) if len(cut) else np.zeros(0, np.int64)
    lh = common.hash_spans(data, begin, cut)
    lrow = np.searchsorted(offsets, begin, side="right") - 1
    filled = cut > begin
    lh, lrow = lh[filled], lrow[filled]
    lorder = np.lexsort((lh, lrow))
    lnew = np.ones(len(lh), bool)
    lnew[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (lrow[lorder][1:] != lrow[lorder][:-1])
    lines = np.bincount(lrow, minlength=n) if len(lh) else np.zeros(n)
    kinds_of_lines = np.bincount(lrow[lorder][lnew], minlength=n) if len(lh) else np.zeros(n)
    word_chars = np.diff(np.concatenate([[0], np.cumsum(char)])[np.stack([starts, ends])], axis=0)[0] if len(starts) else np.zeros(0)
    return {
        "n_words": n_words.astype(np.float64),
        "symbol_share": bytes_where(np.isin(raw, np.frombuffer(b"#$%&*@^~<>{}[]\\|=+_", np.uint8))) / solid,
        "capital_share": bytes_where(big) / np.maximum(bytes_where(letter), 1),
        "repeat_share": words_where(same) * per_word,
        "word_length": np.bincount(row, weights=word_chars, minlength=n) * per_word if len(row) else np.zeros(n),
        "bar_share": bytes_where(raw == 124) * per_word,
        "shout_share": bytes_where(shout) * per_word,
        "stop_share": words_where(stop) * per_word,
        "end_share": bytes_where((raw == 46) | (raw == 63) | bang) * per_word,
        "digit_share": bytes_where((raw >= 48) & (raw <= 57)) / solid,
        "same_line_share": (lines - kinds_of_lines) / np.maximum(lines, 1),
        "variety": kinds / np.maximum(n_words, 1) ** 0.75,
        "mark_share": bytes_where(char & ~space & ~letter & ~((raw >= 48) & (raw <= 57))) * per_word,
    }


def votes(column: pa.Array) -> np.ndarray:
    """rows x rules: 1, 0 or -1."""
    f = features(column)
    out = np.zeros((len(column), len(RULES)), np.int8)
    for k, (name, low, high, good_low, good_high, least) in enumerate(RULES.values()):
        x, enough = f[name], f["n_words"] >= least
        out[enough & (x >= good_low) & (x <= good_high), k] = 1
        out[enough & ((x < low) | (x > high)), k] = -1
    return out


_PLACES = 3 ** np.arange(len(RULES), dtype=np.int64)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): a document's votes as one number in base 3. A null text votes like an empty one: every rule abstains."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                yield pa.record_batch([part.column(0), pa.array((votes(part.column(1)) + 1).astype(np.int64) @ _PLACES)], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pattern long")


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // _PLACES % 3 - 1).astype(np.int8)


def _votes_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v == 1).astype(float), (v == -1).astype(float)


def _logs(v: np.ndarray, good: float, right_good: np.ndarray, right_bad: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log likelihood of each vote pattern with each class: the good ones, then the kinds of bad ones."""
    up, down = _votes_of(v)
    of_good = np.log(good) + up @ np.log(right_good) + down @ np.log(1 - right_good)
    of_bad = [np.log((1 - good) * s) + up @ np.log(1 - r) + down @ np.log(r) for s, r in zip(shares, right_bad)]
    return np.stack([of_good, *of_bad], axis=1)


def _maximise(v: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int, prior: float) -> tuple[float, tuple]:
    """(log likelihood, model) from first probabilities of the classes, patterns x classes."""
    up, down = _votes_of(v)
    before = -np.inf
    for _ in range(rounds):
        w = n[:, None] * p
        total = w.sum(axis=0)
        good = float((total[0] + 0.8 * prior) / (total.sum() + prior))
        shares = (total[1:] + 1) / (total[1:] + 1).sum()
        right_good = (w[:, 0] @ up + 0.8 * prior) / (w[:, 0] @ (up + down) + prior)
        right_bad = (w[:, 1:].T @ down + 0.5 * prior) / (w[:, 1:].T @ (up + down) + prior)
        # Better than chance: a vote never speaks for the other class.
        right_bad = np.clip(np.maximum(right_bad, 1 - right_good + 1e-4), 1e-6, 1 - 1e-6)
        model = good, np.clip(right_good, 1e-6, 1 - 1e-6), right_bad, shares
        logs = _logs(v, *model)
        each = np.logaddexp.reduce(logs, axis=1)
        p = np.exp(logs - each[:, None])
        now = float(n @ each)
        if abs(now - before) <= 1e-10 * abs(now):
            break
        before = now
    return now, model


def _starts(v: np.ndarray, n: np.ndarray, kinds: int) -> Iterator[np.ndarray]:
    """First probabilities of the classes for 1 kind of bad documents up to `kinds`: a bad vote makes a document bad, of the kind of the most frequent rule that says so."""
    down = v == -1
    left, seeds = n * down.any(axis=1), []
    while len(seeds) < kinds and left.sum() >= max(3, 1e-4 * n.sum()):
        seeds.append(int((left @ down).argmax()))
        left = left * ~down[:, seeds[-1]]
    for m in range(1, len(seeds) + 1):
        p = np.zeros((len(v), 1 + m))
        p[:, 0] = 0.9
        kind = np.full(len(v), -1)
        for j in range(m)[::-1]:
            kind[down[:, seeds[j]]] = j
        kind[down.any(axis=1) & (kind < 0)] = 0
        p[kind >= 0, 0] = 0.1
        p[:, 1:] = (1 - p[:, :1]) * 0.1 / m
        p[kind >= 0, 1 + kind[kind >= 0]] += (1 - p[kind >= 0, 0]) * 0.9
        yield p / p.sum(axis=1, keepdims=True)


def mixture(v: np.ndarray, n: np.ndarray, kinds: int = KINDS, rounds: int = ROUNDS, prior: float = 4.0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(share of good, P(vote good | good) by rule, P(vote bad | bad) by kind and rule, shares of the kinds) from distinct vote patterns and how many documents have each.

    Bad documents are of several kinds, each of which breaks rules of its own; as many kinds are taken, `kinds` at most,
    as the likelihood pays for (by Akaike's criterion), and each must have a rule that mostly votes
    bad. Abstaining says nothing. `prior` pseudo-votes keep a rule that hardly votes near 0.8 (good) and 0.5 (bad).
    """
    best = None
    for p in _starts(v, n, kinds):
        likelihood, model = _maximise(v, n, p, rounds, prior)
        used = p.shape[1] - 1
        score = likelihood - used * (v.shape[1] + 1)
        if (best is None or score > best[0]) and (used == 1 or (model[2].max(axis=1) >= 0.5).all()):
            best = score, model
    if best is None:  # no bad vote at all
        m = v.shape[1]
        return 1 - 1e-6, np.full(m, 0.8), np.full((1, m), 0.5), np.ones(1)
    return best[1]


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, prior: float = 4.0) -> tuple[float, np.ndarray, np.ndarray]:
    """mixture() of one kind: (share of good, P(vote good | good), P(vote bad | bad)). Of three starts (a bad vote, two, or more bad than good ones make a document bad) the likeliest end counts."""
    bad, many = (v == -1).sum(axis=1), (v == 1).sum(axis=1)
    firsts = [np.where(x, 0.1, 0.9) for x in (bad >= 1, bad >= 2, bad > many)]
    _, model = max((_maximise(v, n, np.stack([p, 1 - p], axis=1), rounds, prior) for p in firsts), key=lambda x: x[0])
    return model[0], model[1], model[2][0]


def weights(good: float, right_good: np.ndarray, right_bad: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of being good against each kind of bad: at no vote, added by a good vote of each rule, added by a bad one."""
    return np.log(good / ((1 - good) * shares)), np.log(right_good / (1 - right_bad)), np.log((1 - right_good) / right_bad)


def posterior(v: np.ndarray, good: float, right_good: np.ndarray, right_bad: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
    right_bad = np.atleast_2d(right_bad)
    base, up, down = weights(good, right_good, right_bad, np.ones(1) if shares is None else shares)
    odds = base + (v == 1) @ up.T + (v == -1) @ down.T
    return 1 / (1 + np.exp(-odds).sum(axis=1))


def fit(patterns: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """mixture() over all documents: what is collected is one row a pattern, 3 ** 12 at most."""
    counted = patterns.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    return mixture(unpacked(counted["pattern"].to_numpy(np.int64)), counted["n"].to_numpy(float))


def _posterior(pattern: Column, model: tuple[float, np.ndarray, np.ndarray, np.ndarray]) -> Column:
    base, up, down = weights(*model)
    odds = F.lit(0.0)
    for j in range(len(base)):
        total = F.lit(float(base[j]))
        for k in range(len(RULES)):
            vote = F.expr(f"(pattern div {int(_PLACES[k])}) % 3")
            total = total + F.when(vote == 2, F.lit(float(up[j, k]))).when(vote == 0, F.lit(float(down[j, k]))).otherwise(F.lit(0.0))
        odds = odds + F.exp(-total)
    return 1 / (1 + odds)


def quality(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, posterior, keep, votes_good, votes_bad) for every document.

    On a null or empty text all rules abstain, so it gets the share of good documents. Repeated rows count and are
    listed each; ties of the posterior can't matter, as rows are judged one by one. A null doc_id is listed as null.
    Further columns are ignored; an empty table gives no row.
    """
    patterns = common.materialise(vote_patterns(docs), "vote-patterns")
    p = _posterior(F.col("pattern"), fit(patterns))
    digits = [F.expr(f"(pattern div {int(x)}) % 3") for x in _PLACES]
    count = lambda d: sum(((x == d).cast("int") for x in digits[1:]), (digits[0] == d).cast("int"))
    return patterns.select("doc_id", p.alias("posterior"), (p >= keep).alias("keep"), count(2).alias("votes_good"), count(0).alias("votes_bad"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality_rules": op9_quality}
ORACLE: dict[str, str] = {}
