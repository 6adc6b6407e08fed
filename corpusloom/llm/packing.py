"""Best-fit packing of documents into training sequences, by bin completion.

Documents are spread over shards by a hash, each shard is packed by itself, and a bin holds at most CAPACITY tokens.
Longer documents are cut into full sequences, which are bins of their own, and a rest that is packed. In a shard,
best-fit decreasing gives the first incumbent. If that uses more bins than a lower bound says are needed, a
branch-and-bound search goes on: the largest remaining piece opens a bin, the undominated fillings around it (of two
fillings in which each piece of one fits into the place of pieces of the other, only the better is tried) are walked
lazily, those with the least waste first, and a branch ends when its waste exceeds what an improvement could afford.
No filling is left out by its number of pieces or its place in that order; what ends a search early is only the number
of fillings looked at (NODES a shard), and then the incumbent stands.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, tokencounts

#: Tokens of a bin; documents of a shard, about; fillings the search of a shard may try before it keeps the incumbent.
CAPACITY, SHARD_DOCS, NODES = 4096, 2048, 4000
#: Bins opened last whose walks are kept; those of earlier ones are walked again when the search comes back to them.
_KEPT = 64
#: Further bins after which the first way down is finished best-fit, for an incumbent.
_STRIDE = 8


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each size goes into the fullest bin that has room. Bins of sizes."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, (s, -1))
        if i == len(rooms):
            bins.append([s])
            bisect.insort(rooms, (capacity - s, len(bins) - 1))
        else:
            room, b = rooms.pop(i)
            bins[b].append(s)
            bisect.insort(rooms, (room - s, b))
    return bins


def dominated(a: list[int], b: list[int]) -> bool:
    """Whether filling a is dominated by b: the pieces of a can be shared out among the pieces of b without overfilling one."""
    if sum(a) > sum(b):
        return False
    a = sorted(a, reverse=True)

    def share(i: int, rooms: list[int]) -> bool:
        if i == len(a):
            return True
        at = bisect.bisect_left(rooms, a[i])
        for k in range(at, len(rooms)):  # the tightest room first; of equal ones one is enough
            if k > at and rooms[k] == rooms[k - 1]:
                continue
            rest = rooms[:k] + rooms[k + 1 :]
            bisect.insort(rest, rooms[k] - a[i])
            if share(i + 1, rest):
                return True
        return False

    return share(0, sorted(b))


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound on the bins (with Martello and Toth's L2: for each limit k, bins of pieces over half, and what pieces of k or more can't share with them)."""
    sizes = sorted(sizes)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    half = bisect.bisect_right(sizes, capacity // 2)
    best = max(-(-sums[-1] // capacity), len(sizes) - half)
    # Of pieces over 1 / (n + 1) of the capacity a bin has n at most.
    for n in range(2, min(len(sizes), 64)):
        best = max(best, -(-(len(sizes) - bisect.bisect_right(sizes, capacity // (n + 1))) // n))
    for k in sorted({s for s in sizes[:half]}):
        alone = bisect.bisect_right(sizes, capacity - k)  # from here on with room for less than k
        middle = sums[max(alone, half)] - sums[half]
        room = (max(alone, half) - half) * capacity - middle
        rest = sums[half] - sums[bisect.bisect_left(sizes, k)]
        best = max(best, len(sizes) - half + max(0, -(-(rest - room) // capacity)))
    return best


def exact_fillings(sizes: list[int], left: Counter, room: int, most_waste: int) -> Iterator[list[int]]:
    """All ways to fill `room` from the ascending distinct `sizes`, of which left[s] remain, with `most_waste` or less: least waste first, then the larger pieces first.

    Bit t of reach[i] tells whether pieces of the i smallest sizes can add up to t, so every step leads to a filling.
    """
    sizes = sizes[: bisect.bisect_right(sizes, room)]
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        bits = reach[-1]
        n = min(left[s], room // s)
        k = 1
        while n > 0:  # 1, 2, 4 ... copies at once
            k = min(k, n)
            bits |= (bits << (s * k)) & mask
            n -= k
            k *= 2
        reach.append(bits)

    def walk(target: int, top: int, used: int) -> Iterator[list[int]]:
        """Fillings of just `target` by sizes up to the index `top`, of which `used` are taken."""
        if not target:
            yield []
            return
        for i in range(min(top, bisect.bisect_right(sizes, target) - 1), -1, -1):
            s = sizes[i]
            copies = left[s] - (used if i == top else 0)
            if copies <= 0:
                continue
            rest = target - s
            if any(reach[i] >> (rest - m * s) & 1 for m in range(min(copies - 1, rest // s) + 1)):
                for more in walk(rest, i, (used if i == top else 0) + 1):
                    yield [s, *more]

    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            yield from walk(room - waste, len(sizes) - 1, 0)


def fillings(sizes: list[int], left: Counter, room: int, most_waste: int | None = None) -> Iterator[list[int] | None]:
    """The undominated ones of exact_fillings(), in its order; None for each one that is passed over. What dominates a filling comes before it in that order."""
    most_waste = room if most_waste is None else most_waste
    if left[room] > 0:  # a piece that fits exactly dominates all else
        yield [room]
        return
    tried: list[list[int]] = []
    for f in exact_fillings(sizes, left, room, most_waste):
        if any(dominated(f, g) for g in tried):
            yield None
        else:
            tried.append(f)
            yield f


class _Bin:
    """An opened bin of the search: its largest piece, the waste before it, and the walk over its fillings."""

    def __init__(self, piece: int, before: int):
        self.piece, self.before, self.chosen = piece, before, None
        self.walk: Iterator | None = None
        self.seen = 0

    def following(self, sizes: list[int], left: Counter, room: int, afford: int) -> Iterator[list[int] | None]:
        """The walk, begun again where it was dropped. The affordable waste only shrinks, so the order stays."""
        if self.walk is None:
            self.walk = fillings(sizes, left, room, afford)
            for _ in range(self.seen):
                next(self.walk, None)
        return self.walk


def pack(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins of sizes (all positive, none over the capacity): bin completion with the best-fit solution as the incumbent."""
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    lower = least_bins(sizes, capacity)
    left = Counter(sizes)
    free = sorted(left)
    spent = 0
    stack: list[_Bin] = []

    def take(pieces: list[int]) -> None:
        for s in pieces:
            left[s] -= 1
            if not left[s]:
                del left[s]
                free.pop(bisect.bisect_left(free, s))

    def give(pieces: list[int]) -> None:
        for s in pieces:
            if s not in left:
                bisect.insort(free, s)
            left[s] += 1

    def finish() -> None:
        """The bins so far, with the rest packed best-fit, are the incumbent if they are fewer."""
        nonlocal incumbent, spent
        spent += 1
        rest = best_fit([s for s in free for _ in range(left[s])], capacity)
        if len(stack) + len(rest) < len(incumbent):
            incumbent = [[b.piece, *b.chosen] for b in stack] + rest

    waste = deepest = 0
    while len(incumbent) > lower and spent < nodes:
        if len(stack) >= deepest + _STRIDE:
            deepest = len(stack)
            finish()
            if len(incumbent) <= lower:
                break
        if free:
            stack.append(_Bin(free[-1], waste))
            take([free[-1]])
            if len(stack) > _KEPT:
                stack[-_KEPT - 1].walk = None
        else:
            incumbent = [[b.piece, *b.chosen] for b in stack]
            if len(incumbent) <= lower:
                break
        # The next filling of the bin opened last, or, when it has none that can still improve, of an earlier one.
        while stack and spent < nodes:
            b = stack[-1]
            if b.chosen is not None:
                give(b.chosen)
                b.chosen = None
            room = capacity - b.piece
            afford = (len(incumbent) - 1) * capacity - total - b.before
            pick = None
            if afford >= 0:
                for pick in b.following(free, left, room, afford):
                    b.seen += 1
                    spent += 1
                    if pick is not None or spent >= nodes:
                        break
            if pick is not None and room - sum(pick) <= afford:
                take(pick)
                b.chosen, waste = pick, b.before + room - sum(pick)
                break
            give([b.piece])
            stack.pop()
        else:
            break
    return incumbent


def _pack_shard(capacity: int, nodes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="last")
        rows: list[tuple] = []
        waiting: dict[int, list[tuple]] = {}
        n_bins = 0
        for doc, n in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
            doc = None if pd.isna(doc) else int(doc)
            whole, rest = divmod(n, capacity)
            for k in range(whole):
                rows.append((shard, n_bins, doc, k, k * capacity, capacity, 0))
                n_bins += 1
            if rest:
                waiting.setdefault(rest, []).append((doc, whole))
        sizes = [s for s, docs in waiting.items() for _ in docs]
        for docs in waiting.values():
            docs.reverse()
        for pieces in pack(sizes, capacity, nodes):
            at = 0
            for s in pieces:
                doc, k = waiting[s].pop()
                rows.append((shard, n_bins, doc, k, k * capacity, s, at))
                at += s
            n_bins += 1
        out = pd.DataFrame(rows, columns=["shard", "bin", "doc_id", "piece", "doc_start", "n_tokens", "bin_start"])
        return out.astype({"doc_id": "Int64"})

    return run


SCHEMA = "shard long, bin long, doc_id long, piece long, doc_start long, n_tokens long, bin_start long"


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, nodes: int = NODES) -> DataFrame:
    """Packs (doc_id, n_tokens) rows: one row for each piece with its bin and its places in the document and in the bin."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    lengths = common.materialise(lengths, "token-lengths")
    shards = max(1, -(-lengths.count() // shard_docs))
    keyed = lengths.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(_pack_shard(capacity, nodes), SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, nodes: int = NODES, folder: str = tokencounts.TOKENIZERS, vocabulary: str = tokencounts.VOCABULARY) -> DataFrame:
    """Packs whole documents by their encoded length.

    Null and empty texts have no tokens and get no row. Repeated rows are packed each for itself; a null doc_id is
    packed and listed as null. Equal lengths are told apart by doc_id, so that the result is the same in every run.
    Further columns are ignored. An empty table gives no row.
    """
    return pack_lengths(tokencounts.token_lengths(docs, folder, vocabulary), capacity, shard_docs, nodes)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_packing}
ORACLE: dict[str, str] = {}
