"""Problem 2: long spans that records share, exactly or nearly.

Method: collinear chaining. Shared k-mer seeds join the records, the matches of a pair are chained in order with gap
costs through a Fenwick tree, and the chains are aligned base by base between their seeds to find passages; an exact
check of the aligned stretches follows where only verbatim spans count.

Seeds are minimizers: of every ``window`` successive k-mers the one with the smallest hash is taken. With k + window - 1
as the length asked for, two records that share a span of that length share a seed inside it, whatever stands around it.
Records with the very same text form one class and are compared once. A seed alone may be a common phrase, so it is not
what pairs of classes meet on: they meet on a seed together with the whole span of full length around it (verbatim) or
with another seed at about the same distance behind it (alike). Only classes that really share that much meet, at every
size, and no seed is left out however common. Keys held by the same classes are one key, and a key of many classes is
split into blocks, so no task holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.leakage import hashes
from bidloom.session import materialize

GAP_COST = 0.05  # of a chain, per character that one side has more than the other between two seeds


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of every ``window`` successive hashes."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(w)) + window - 1 - w.argmin(axis=1))


class Fenwick:
    """Prefix maxima of (value, payload)."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: float, payload: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, payload)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out, i = (float("-inf"), -1), i + 1
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chains(matches: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of k-mer matches (i, j) that together hold every match, the best chain first.

    A match may follow another if it starts later in both records. Going from one to the next costs GAP_COST for each
    character the two gaps differ by. As the cost is linear in i - j on either side of the diagonal, the best
    predecessor is a prefix maximum over j, once for predecessors on a smaller and once on a larger diagonal; taking
    the better of the two needs no test of the side, since the other side's value only underestimates it.
    """
    left = sorted(set(matches))
    rank = {j: r for r, j in enumerate(sorted({j for _, j in left}))}
    below, above = Fenwick(len(rank)), Fenwick(len(rank))
    score, back, waiting = [0.0] * len(left), [-1] * len(left), 0
    for n, (i, j) in enumerate(left):
        while left[waiting][0] < i:  # matches that start earlier in the left record
            a, b = left[waiting]
            below.put(rank[b], score[waiting] + GAP_COST * (a - b), waiting)
            above.put(rank[b], score[waiting] - GAP_COST * (a - b), waiting)
            waiting += 1
        score[n] = k * 1.0
        for tree in (below, above):
            _, m = tree.upto(rank[j] - 1) if rank[j] else (float("-inf"), -1)
            if m >= 0:
                a, b = left[m]
                new = min(k, i - a, j - b) + score[m] - GAP_COST * abs((i - j) - (a - b))
                if new > score[n]:
                    score[n], back[n] = new, m
    found, used = [], [False] * len(left)
    for n in sorted(range(len(left)), key=score.__getitem__, reverse=True):
        chain = []
        while n >= 0 and not used[n]:
            used[n] = True
            chain.append(left[n])
            n = back[n]
        if chain:
            found.append(chain[::-1])
    return found


def aligned_gap(a: str, b: str, band: int = 32) -> int:
    """How many characters agree in the best alignment of two stretches between seeds, within a band of diagonals around
    the straight way; one row a character, each row a vector operation."""
    if not a or not b:
        return 0
    x, y = code_points(a), code_points(b)
    if len(x) > len(y):
        x, y = y, x
    lead = len(y) - len(x)
    width = lead + 2 * band + 1
    padded = np.full(len(y) + 2 * width, -1, np.int64)
    padded[width : width + len(y)] = y
    row = np.zeros(width + 1, np.int32)  # row[d]: most agreements so far where y is d - band ahead of x
    for i in range(len(x)):
        same = padded[width + i - band : width + i - band + width] == x[i]
        new = np.maximum(row[:width] + same, row[1:])
        np.maximum.accumulate(new, out=new)
        row[:width] = new
        row[width] = 0
    return int(row.max())


def aligned_blocks(a: str, b: str, chain: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Verbatim stretches (start in a, start in b, length) through the seeds of a chain, each as long as it can be."""
    blocks: list[tuple[int, int, int]] = []
    for i, j in chain:
        if blocks and i - j == blocks[-1][0] - blocks[-1][1] and i + k <= blocks[-1][0] + blocks[-1][2]:
            continue
        x, y = i, j
        while x and y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        n = i - x + k
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
        if a[i : i + k] == b[j : j + k]:  # hashes may agree by chance
            blocks.append((x, y, n))
    return blocks


def aligned_passages(a: str, b: str, blocks: list[tuple[int, int, int]], farthest: int = 50) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(start in a, end, start in b, end, agreeing, columns) of the passages that verbatim blocks and what is aligned
    between them make up. A gap longer than ``farthest`` of which less than half agrees ends a passage."""
    held: list[int] = []
    for x, y, n in blocks:
        if not held:
            held = [x, x + n, y, y + n, n, n]
            continue
        cut = max(0, held[1] - x, held[3] - y)  # blocks on different diagonals may overlap
        x, y, n = x + cut, y + cut, n - cut
        if n <= 0:
            continue
        ga, gb = a[held[1] : x], b[held[3] : y]
        columns = max(len(ga), len(gb))
        agree = aligned_gap(ga, gb)
        if columns > farthest and agree < columns / 2:
            yield tuple(held)
            held = [x, x + n, y, y + n, n, n]
            continue
        held = [held[0], x + n, held[2], y + n, held[4] + agree + n, held[5] + columns + n]
    if held:
        yield tuple(held)


def text_classes(records: DataFrame, rec_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, text; members: rep, rec_id). The smallest rec_id of equal texts stands for all of them."""
    once = records.select(F.col(rec_id).alias("rec_id"), F.col(text).alias("text")).where("rec_id is not null and text is not null").dropDuplicates(["rec_id"])
    keyed = materialize(once.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)))
    reps = keyed.groupBy("h").agg(F.min("rec_id").alias("rep"))
    members = materialize(keyed.select("h", "rec_id").join(reps, "h").select("rep", "rec_id"))
    classes = materialize(keyed.join(members.where("rep = rec_id").select("rec_id"), "rec_id", "left_semi").select(F.col("rec_id").alias("rep"), "text"))
    return classes, members


def _postings(gram: int, window: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seeds, reps, places = [], [], []
            for rep, text in zip(batch["rep"], batch["text"], strict=True):
                if len(text) >= gram + window - 1:
                    h = hashes(code_points(text), gram)
                    at = minimizers(h, window)
                    seeds.append(h[at].view(np.int64))
                    reps.append(np.full(len(at), rep))
                    places.append(at.astype(np.int32))
            if seeds:
                yield pd.DataFrame({"seed": np.concatenate(seeds), "rep": np.concatenate(reps), "pos": np.concatenate(places)})

    return emit


def _whole_spans(gram: int, length: int):
    """(key, rep): the spans of full length around each place of a shared seed."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, reps = [], []
            for rep, text, places in zip(batch["rep"], batch["text"], batch["places"], strict=True):
                h = hashes(code_points(text), length)
                around = np.zeros(len(h) + 1, np.int64)  # +1 where the spans around a seed begin, -1 where they end
                for pos in places:
                    around[max(0, pos + gram - length)] += 1
                    around[min(len(h), pos + 1)] -= 1
                kept = np.unique(h[np.cumsum(around)[:-1] > 0]).view(np.int64)
                keys.append(kept)
                reps.append(np.full(len(kept), rep))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "rep": np.concatenate(reps)})

    return emit


def _seed_pairs(gram: int, window: int, length: int, reach: int, bucket: int):
    """(key, rep): each seed with every seed that ends ``length`` to ``length + reach`` behind its start, and about how far
    apart they are; a distance counts for its bucket and the next, so an edit between them does not part two texts."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, reps = [], []
            for rep, text in zip(batch["rep"], batch["text"], strict=True):
                h = hashes(code_points(text), gram)
                at = minimizers(h, window)
                if len(at) < 2:
                    continue
                lo, hi = np.searchsorted(at, at + length - gram, "left"), np.searchsorted(at, at + length - gram + reach, "right")
                count = hi - lo
                first = np.repeat(np.arange(len(at)), count)
                second = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                apart = ((at[second] - at[first]) // bucket).astype(np.uint64)
                with np.errstate(over="ignore"):
                    both = h[at[first]] * np.uint64(0x9E3779B97F4A7C15) + h[at[second]] * np.uint64(0xC2B2AE3D27D4EB4F)
                    each = np.concatenate([both + (apart + np.uint64(d)) * np.uint64(0x165667B19E3779F9) for d in (0, 1)])
                    kept = np.unique(each ^ (each >> np.uint64(31))).view(np.int64)
                keys.append(kept)
                reps.append(np.full(len(kept), rep))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "rep": np.concatenate(reps)})

    return emit


def meeting_pairs(keyed: DataFrame, block: int = 500) -> DataFrame:
    """(rep1, rep2), rep1 < rep2: classes that hold a key together; keyed: (key, rep).

    Keys that the very same classes hold (all keys inside one passage) are one: each set of classes is kept once, told by
    its size and two sums of hashes. A key of more than ``block`` classes is split: its classes fall into blocks and every
    pair of blocks meets by itself.
    """
    once = keyed.distinct()
    sets = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("s")).where("n > 1")
    kept = sets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = once.join(kept, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("key", F.col("own").alias("b1"), F.col("rep").alias("rep1"), every.alias("b2"))
    right = rows.select("key", F.col("own").alias("b2"), F.col("rep").alias("rep2"), every.alias("b1"))
    return left.join(right, ["key", "b1", "b2"]).where("rep1 < rep2").select("rep1", "rep2").distinct()


def shared_passages(records: DataFrame, rec_id: str, text: str, length: int = 50, gram: int = 24, alike: bool = False, alike_gram: int = 16, least_identity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(passages, members): passages has, for each pair of text classes rep1 < rep2 and each passage,
    (rep1, rep2, chain_score, start1, end1, start2, end2, identity, runs: array<struct<s1, s2, n>>).

    runs are the verbatim stretches of the passage of at least ``length`` code points. Pairs of classes are those that
    share such a stretch; with ``alike`` also those that share two seeds of ``alike_gram`` at about the same distance, and
    then passages without runs are kept if they are ``length`` long and at least ``least_identity`` of their aligned
    columns agree. identity is that share. Null texts and null ids are left out, repeated ids count once, texts shorter
    than ``length`` share nothing. Passages are found between different texts; records with the same text are in one class
    of ``members``.
    """
    window = length - gram + 1
    classes, members = text_classes(records, rec_id, text)
    placed = materialize(classes.mapInPandas(_postings(gram, window), "seed long, rep long, pos int"))
    shared = placed.groupBy("seed").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("seed")
    places = placed.join(shared, "seed", "left_semi").groupBy("rep").agg(F.collect_set("pos").alias("places"))
    keyed = places.join(classes, "rep").mapInPandas(_whole_spans(gram, length), "key long, rep long")
    if alike:
        keyed = keyed.unionByName(classes.mapInPandas(_seed_pairs(alike_gram, alike_gram, length, 64, 16), "key long, rep long"))
    met = materialize(meeting_pairs(materialize(keyed)))
    t1, t2 = classes.select(F.col("rep").alias("rep1"), F.col("text").alias("text1")), classes.select(F.col("rep").alias("rep2"), F.col("text").alias("text2"))
    pairs = met.join(t1, "rep1").join(t2, "rep2")
    size, span = (alike_gram, alike_gram) if alike else (gram, window)

    def seeds(t: str, known: dict[str, dict[int, list[int]]]) -> dict[int, list[int]]:
        if t not in known:
            if len(known) > 2000:
                known.clear()
            h = hashes(code_points(t), size)
            known[t] = {}
            for p in minimizers(h, span).tolist():
                known[t].setdefault(int(h[p]), []).append(p)
        return known[t]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[int, list[int]]] = {}
        for batch in batches:
            rows = []
            for rep1, rep2, a, b in zip(batch["rep1"], batch["rep2"], batch["text1"], batch["text2"], strict=True):
                one, two = seeds(a, known), seeds(b, known)
                matches = [(i, j) for h in one.keys() & two.keys() for i in one[h] for j in two[h]]
                for c in chains(matches, size):
                    blocks = list(dict.fromkeys(aligned_blocks(a, b, c, size)))
                    for s1, e1, s2, e2, agree, columns in aligned_passages(a, b, blocks):
                        runs = [{"s1": x, "s2": y, "n": n} for x, y, n in blocks if n >= length and s1 <= x < e1 and s2 <= y < e2]
                        if runs or alike and columns >= length and agree >= least_identity * columns:
                            rows.append((rep1, rep2, float(agree), s1, e1, s2, e2, agree / columns, runs))
            yield pd.DataFrame(rows, columns=["rep1", "rep2", "chain_score", "start1", "end1", "start2", "end2", "identity", "runs"])

    schema = "rep1 long, rep2 long, chain_score double, start1 int, end1 int, start2 int, end2 int, identity double, runs array<struct<s1:int,s2:int,n:int>>"
    return pairs.select("rep1", "rep2", "text1", "text2").mapInPandas(chain, schema), members


def sharing_pairs(passages: DataFrame, members: DataFrame, classes_long: DataFrame) -> DataFrame:
    """(id1, id2), id1 < id2: records with a verbatim span in common, copies of one text included.

    classes_long: (rep) of the classes whose text is long enough for its copies to share a span with each other.
    """
    verbatim = passages.where(F.size("runs") > 0).select("rep1", "rep2").distinct()
    m1, m2 = members.select(F.col("rep").alias("rep1"), F.col("rec_id").alias("i")), members.select(F.col("rep").alias("rep2"), F.col("rec_id").alias("j"))
    between = verbatim.join(m1, "rep1").join(m2, "rep2").select(F.least("i", "j").alias("id1"), F.greatest("i", "j").alias("id2"))
    copied = members.join(classes_long, "rep", "left_semi")
    again = copied.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copied = copied.join(again, "rep", "left_semi")
    within = copied.select("rep", F.col("rec_id").alias("id1")).join(copied.select("rep", F.col("rec_id").alias("id2")), "rep").where("id1 < id2").select("id1", "id2")
    return between.unionByName(within)


def shared_amount(records: DataFrame, rec_id: str, text: str, passages: DataFrame, members: DataFrame, length: int = 50) -> DataFrame:
    """(rec_id, n_chars, n_shared, share): how many of a record's code points also stand in another record.

    Counted over verbatim spans of at least ``length``; a record whose whole text has a copy is shared in whole if it is
    that long. Spans are merged per class with a running maximum, never collected into one value.
    """
    a = passages.select(F.col("rep1").alias("rep"), F.explode("runs").alias("r")).select("rep", F.col("r.s1").alias("s"), (F.col("r.s1") + F.col("r.n")).alias("e"))
    b = passages.select(F.col("rep2").alias("rep"), F.explode("runs").alias("r")).select("rep", F.col("r.s2").alias("s"), (F.col("r.s2") + F.col("r.n")).alias("e"))
    spans = a.unionByName(b).groupBy("rep", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    covered = spans.select("rep", new.alias("c")).groupBy("rep").agg(F.sum("c").alias("c"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    once = records.select(F.col(rec_id).alias("rec_id"), F.length(text).alias("n_chars")).where("rec_id is not null and n_chars is not null").dropDuplicates(["rec_id"])
    rows = once.join(members, "rec_id").join(copies, "rep").join(covered, "rep", "left")
    shared = F.when((F.col("copies") > 1) & (F.col("n_chars") >= length), F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("long")
    return rows.select("rec_id", F.col("n_chars").cast("long").alias("n_chars"), shared.alias("n_shared"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))

