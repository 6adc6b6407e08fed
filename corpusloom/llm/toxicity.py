"""Toxic clauses by a composed weighted finite-state grammar.

Words are read as symbols (insult, weak insult, household word, threat verb, target, will, negation, verb of thinking,
reporting verb, determiner, boundary, other) and pass five deterministic transducers: the first reads household words
after a determiner ("the trash") as plain words, negation marks the insults and threats in its scope (a negated "think"
carries it on), reported speech those it reports, target those aimed at somebody, and the last one weighs what is left.
A threat needs a verb of intent before it and somebody as its object; weak insults, household words and words learned
from labels stay below the threshold unless they are aimed at somebody or come together. The transducers are composed
into one table before any text is read; a clause's score is the weight of its path.

A document is toxic for one clause of THRESHOLD or more, or if its clauses of FLOOR or more add up to THRESHOLD, and to
more in a long text: by 1 for each WORDS words.

Weak insults are the seed words below and, where labels are given, whole words and beginnings of inflected words that
are learned from at most SAMPLE labelled documents of each class (the bound of the fit): those whose presence makes a
document far more likely toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Labelled documents of each class that the fit reads at most; clause score from which a clause is toxic.
SAMPLE, THRESHOLD = 3000, 1.0
#: Clause score that counts for a document; words of a text for which the sum must be greater by 1.
FLOOR, WORDS = 0.55, 4000
#: Words after a negation that it reaches; words between a target and an insult; words after a threat in which its object comes.
SCOPE, REACH, OBJECT = 3, 4, 3
#: Letters of a learned beginning at least, and different words that it must have.
STEM, FORMS = 5, 2

SEEDS = {
    "insult": "idiot idiots moron morons scum imbecile imbeciles cretin cretins dimwit dimwits bastard bastards".split(),
    "weak": "stupid dumb loser losers worthless pathetic disgusting".split(),
    "household": "trash garbage clown clowns vermin filth".split(),
    "threat": "kill hurt destroy murder stab strangle burn shoot beat crush".split(),
    "target": "you yours yourself u ya he she they them him those these people women men".split(),
    "possessive": "your her".split(),
    "will": "will shall gonna ll going must should".split(),
    "negation": "not no never isn aren wasn ain don doesn didn without hardly nicht kein keine nie nunca jamais ne pas".split(),
    "think": "think thinking believe believing mean meaning consider feel suggest suggesting".split(),
    "report": "said says say wrote writes claimed claims quoted called reported according stated alleged shouted dit dijo sagte".split(),
    "determiner": "the a an this that my his its our their some any more much of and or with from into".split(),
}
SYMBOLS = ("other", "insult", "threat", "target", "will", "negation", "report", "end")
OTHER, INSULT, THREAT, TARGET, WILL, NEGATION, REPORT, END = range(8)
#: Further symbols; 8 to 63 are marked insults and threats.
WEAK, HOUSEHOLD, THINK, DETERMINER, POSSESSIVE = 64, 65, 66, 67, 68
_NUMBER = {k: i for i, k in enumerate(SYMBOLS)} | {"weak": WEAK, "household": HOUSEHOLD, "think": THINK, "determiner": DETERMINER, "possessive": POSSESSIVE}
_HOT = (INSULT, THREAT, WEAK, HOUSEHOLD)


@dataclass
class Transducer:
    """A deterministic weighted transducer over integer symbols: step[state, symbol] = (next state, output symbol, weight)."""

    step: dict[tuple[int, int], tuple[int, int, float]]
    start: int = 0

    def run(self, symbols: list[int]) -> tuple[list[int], float]:
        s, out, total = self.start, [], 0.0
        for x in symbols:
            s, y, w = self.step[s, x]
            out.append(y)
            total += w
        return out, total


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Feeds a's output to b; weights add. Only states that can be reached are made."""
    number = {(a.start, b.start): 0}
    todo, step = [(a.start, b.start)], {}
    inputs = sorted({x for _, x in a.step})
    while todo:
        p, q = todo.pop()
        for x in inputs:
            if (p, x) not in a.step:
                continue
            p2, y, w = a.step[p, x]
            q2, z, v = b.step[q, y]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            step[number[p, q], x] = (number[p2, q2], z, w + v)
    return Transducer(step)


#: An insult or threat is carried through as a symbol with marks: a base of its kind, and bits for negated, reported and aimed.
_BASE = {INSULT: 8, THREAT: 9, WEAK: 32, HOUSEHOLD: 48}
_KIND = {v: k for k, v in _BASE.items()}


def marked(kind: int, negated: bool = False, reported: bool = False, aimed: bool = False) -> int:
    return _BASE[kind] + 2 * negated + 4 * reported + 8 * aimed


def unmarked(x: int) -> tuple[int, bool, bool, bool]:
    """Kind, negated, reported, aimed."""
    marks = (x - 8 if x < 32 else x) & 14
    return _KIND[x - marks], bool(marks & 2), bool(marks & 4), bool(marks & 8)


def _mark(x: int, bit: int) -> int:
    kind, negated, reported, aimed = unmarked(x)
    return marked(kind, negated or bit == 2, reported or bit == 4, aimed or bit == 8)


_MARKED = [marked(k, n, r, t) for k, n, r, t in product(_HOT, (False, True), (False, True), (False, True))]
_PLAIN = [*range(8), WEAK, HOUSEHOLD, THINK]
_ALL = [*range(8), *_MARKED]


def household() -> Transducer:
    """A household word after a determiner or possessive is a plain word; a determiner is one too, a possessive a target."""
    step = {}
    for s in (0, 1):
        for x in (*_PLAIN, DETERMINER, POSSESSIVE):
            out = TARGET if x == POSSESSIVE else OTHER if x == DETERMINER or (x == HOUSEHOLD and s) else x
            step[s, x] = (int(x in (DETERMINER, POSSESSIVE)), out, 0.0)
    return Transducer(step)


def negation(scope: int = SCOPE) -> Transducer:
    step = {}
    for left in range(scope + 3):
        for x in _PLAIN:
            after = max(0, left - 1)
            if x == END:
                step[left, x] = (0, x, 0.0)
            elif x == NEGATION:
                step[left, x] = (scope, x, 0.0)
            elif x in _HOT:
                step[left, x] = (after, marked(x, negated=left > 0), 0.0)
            elif x == THINK:
                step[left, x] = (scope + 2 if left else 0, OTHER, 0.0)
            else:
                step[left, x] = (after, x, 0.0)
    return Transducer(step)


def reported() -> Transducer:
    """From a reporting verb to the end of the clause."""
    step = {}
    for on in (0, 1):
        for x in _ALL:
            out = _mark(x, 4) if on and x >= 8 else x
            step[on, x] = (0 if x == END else 1 if x == REPORT else on, out, 0.0)
    return Transducer(step)


def target(reach: int = REACH) -> Transducer:
    step = {}
    for left in range(reach + 1):
        for x in _ALL:
            if x == END:
                step[left, x] = (0, x, 0.0)
            elif x == TARGET:
                step[left, x] = (reach, x, 0.0)
            else:
                step[left, x] = (max(0, left - 1), _mark(x, 8) if x >= 8 and left > 0 else x, 0.0)
    return Transducer(step)


#: Weight of each kind by itself, and what a target adds: to an insult on either side, to a threat as its object.
ALONE, AIMED = {INSULT: 1.0, WEAK: 0.6, HOUSEHOLD: 0.3, THREAT: 0.3}, {INSULT: 0.5, WEAK: 0.5, HOUSEHOLD: 0.8, THREAT: 1.2}
#: Weight of a threat with intent; what is left of a weight if it is negated, and if it is reported.
INTENT, NEGATED, REPORTED = 0.4, 0.15, 0.35


def scoring(reach: int = REACH, object_reach: int = OBJECT) -> Transducer:
    """Weights. States: nothing, an intent before a threat, or a kind that waits for a target, and for how many words."""
    states = [None, WILL, *((k, left) for k in _HOT for left in range(1, (object_reach if k == THREAT else reach) + 1))]
    number = {s: i for i, s in enumerate(states)}
    step = {}
    for s in states:
        waits = isinstance(s, tuple)
        fade = (s[0], s[1] - 1) if waits and s[1] > 1 else None
        for x in _ALL:
            weight, then = 0.0, fade
            if x == END:
                then = None
            elif x == WILL:
                then = WILL
            elif x == TARGET and waits:
                weight, then = AIMED[s[0]], None
            elif x >= 8:
                kind, neg, rep, aimed = unmarked(x)
                if kind == THREAT:
                    weight, open_ = (INTENT if s == WILL else ALONE[kind]), s == WILL
                else:
                    weight, open_ = ALONE[kind] + (AIMED[kind] if aimed else 0), not aimed
                weight *= (NEGATED if neg else 1.0) * (REPORTED if rep else 1.0)
                then = (kind, object_reach if kind == THREAT else reach) if open_ and not neg and not rep else None
            elif s == WILL:
                then = None if x == OTHER else WILL
            step[number[s], x] = (number[then], OTHER, weight)
    return Transducer(step)


def grammar(scope: int = SCOPE, reach: int = REACH) -> Transducer:
    """The whole grammar as one transducer."""
    return compose(compose(compose(compose(household(), negation(scope)), reported()), target(reach)), scoring(reach))


@dataclass
class Lexicon:
    """Symbol of each word hash, and weights of insults; stems are looked up by their first bytes."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def tables(self):
        h = np.array([common.hash_word(w) for w in self.words], np.uint64)
        order = np.argsort(h)
        symbols = np.array(list(self.words.values()), np.int8)[order] if len(h) else np.zeros(0, np.int8)
        by: dict[int, list[int]] = {}
        for stem in self.stems:
            by.setdefault(len(stem.encode()), []).append(common.hash_word(stem))
        return h[order], symbols, {k: np.sort(np.array(v, np.uint64)) for k, v in sorted(by.items())}


def seeded() -> Lexicon:
    """The words of SEEDS; of two symbols a word has the first."""
    return Lexicon({w: _NUMBER[k] for k, ws in reversed(SEEDS.items()) for w in ws})


_LETTERS = re.compile(r"[^\W\d_]+")


_SEEDED = frozenset(w for ws in SEEDS.values() for w in ws)


def stems(text: str | None) -> set[str]:
    """The words of a text that aren't seeds, marked by =, and their beginnings of STEM to 12 letters."""
    out: set[str] = set()
    for w in set(_LETTERS.findall((text or "").lower())) - _SEEDED:
        if len(w) >= 4:
            out.add("=" + w)
            out.update(w[:k] for k in range(STEM, min(12, len(w)) + 1))
    return out


def learn(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least_docs: int = 4, share: float = 0.003, odds: float = 25.0) -> tuple[list[str], list[str]]:
    """(words, stems) that are at least `odds` times as frequent in toxic documents. A stem must begin FORMS words or more; shorter stems first; what they cover isn't listed again."""
    enough = max(least_docs, share * toxic)
    forms = Counter(s[1 : 1 + k] for s in counts if s[0] == "=" for k in range(STEM, min(12, len(s) - 1) + 1))
    good = [s for s, (t, c) in counts.items() if t >= enough and (t / max(toxic, 1)) / ((c + 0.5) / max(clean, 1)) >= odds and t >= 3 * c]
    kept: set[str] = set()
    for s in sorted((s for s in good if s[0] != "="), key=lambda s: (len(s), s)):
        if forms[s] >= FORMS and not any(s[:k] in kept for k in range(STEM, len(s))):
            kept.add(s)
    words = [s[1:] for s in sorted(good) if s[0] == "=" and not any(s[1 : 1 + k] in kept for k in range(STEM, len(s)))]
    return words, sorted(kept)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The seed lexicon and what is learned from at most `sample` labelled documents of each class, those with the smallest hash of their id. Of several labels of an id the greatest counts; null ids and labels don't."""
    lexicon = seeded()
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [ids.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (1, 0)]
    both = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_cl_id"), F.col("toxic").alias("_cl_toxic"))
    texts = docs.select("doc_id", "text").join(F.broadcast(both), F.col("doc_id") == F.col("_cl_id")).select("text", "_cl_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if x == 1 else clean).update(stems(t))
                n[int(x == 1)] += 1
        keys = list(toxic | clean)
        yield pa.record_batch([pa.array(["", *keys], pa.string()), pa.array([n[1], *(toxic[k] for k in keys)], pa.int64()), pa.array([n[0], *(clean[k] for k in keys)], pa.int64())], names=["stem", "t", "c"])

    counted = texts.mapInArrow(run, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    got = {r.stem: (r.t, r.c) for r in counted.filter("t >= 2 or stem = ''").collect()}
    toxic, clean = got.pop("", (0, 0))
    if toxic and clean:
        words, found = learn(got, toxic, clean)
        lexicon.words |= {w: WEAK for w in words if w not in lexicon.words}
        lexicon.stems = {s: ALONE[WEAK] for s in found}
    return lexicon


class Scorer:
    """Scores texts of a batch; words of texts without an insult or threat are never looped over."""

    def __init__(self, lexicon: Lexicon, scope: int = SCOPE, reach: int = REACH):
        self.hashes, self.symbols, self.stems = lexicon.tables()
        g = grammar(scope, reach)
        self.step, self.start = g.step, g.start

    def symbolise(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int8)
        h = common.hash_spans(data, starts, ends)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.symbols[at[hit]]
        for size, table in self.stems.items():
            long = np.flatnonzero(ends - starts >= size)
            h = common.hash_spans(data, starts[long], starts[long] + size)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            out[long[(table[at] == h) & (out[long] == OTHER)]] = WEAK
        return out

    def batch(self, column: pa.Array) -> list[tuple[int, float, float, int, list[str], bool]]:
        """(row, total of the clauses that count, worst clause, how many count, their texts, whether it is toxic) of the texts with an insult or threat."""
        data, offsets = common.flat(column)
        starts, ends = common.words(data)
        symbols = self.symbolise(data, starts, ends)
        first = common.counts_by_row(starts, offsets)
        hot = np.flatnonzero(np.isin(symbols, _HOT))
        if not len(hot):
            return []
        # Clause boundaries before each word: one of . ! ? ; or a line break between it and the word before.
        stop = np.isin(data, np.frombuffer(b".!?;\n", np.uint8))
        passed = np.concatenate([[0], np.cumsum(stop)])
        rows = np.unique(np.searchsorted(first, hot, side="right") - 1)
        out = []
        step = self.step
        for row in rows.tolist():
            a, z = int(first[row]), int(first[row + 1])
            clause = passed[starts[a:z]]
            wanted = np.unique(clause[hot[np.searchsorted(hot, a) : np.searchsorted(hot, z)] - a])
            begin, end = np.searchsorted(clause, wanted, side="left"), np.searchsorted(clause, wanted, side="right")
            total = worst = 0.0
            n, said = 0, []
            for b, e in zip(begin.tolist(), end.tolist()):
                state, score = self.start, 0.0
                for x in symbols[a + b : a + e].tolist():
                    state, _, w = step[state, x]
                    score += w
                if score >= FLOOR - 1e-9:
                    total += score
                    n += 1
                    said.append(bytes(data[starts[a + b] : ends[a + e - 1]]).decode("utf-8", "replace"))
                worst = max(worst, score)
            enough = worst >= THRESHOLD - 1e-9 or total >= THRESHOLD + (z - a) / WORDS - 1e-9
            out.append((row, total, worst, n, said, enough))
        return out


def toxic_documents(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, score, worst_clause, n_clauses, clauses) of the toxic documents: with a clause that scores THRESHOLD or more, or clauses that add up to it (see above).

    score adds up the clauses of FLOOR or more, whose lower-case texts are listed in their order. Null and empty texts
    have none. A very long text is read whole; one without any full stop is one clause. A score of just THRESHOLD is
    toxic. Repeated rows are listed each; a null doc_id is listed as null. Further columns are ignored; an empty table
    gives no row.
    """
    common.small_batches(docs.sparkSession)
    lexicon = lexicon or seeded()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for part in common.slices(batch, 1):
                got = [r for r in scorer.batch(part.column(1)) if r[5]]
                if got:
                    row, total, worst, n, said, _ = zip(*got)
                    yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(total), pa.array(worst), pa.array(n, pa.int32()), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "score", "worst_clause", "n_clauses", "clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, worst_clause double, n_clauses int, clauses array<string>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxic_documents(docs, fit(docs, common.table(spark, sf_dir, "labels")))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
