"""Problem 8: evaluation items that stand, wholly or partly, in training documents.

Method: rare n-gram seeds join training passages to items, then a Smith-Waterman alignment scores each passage. The
rarest gram, by its count in all documents, of every stretch of ``run - gram + 1`` gram positions of an item is a seed;
so every ``run`` successive characters of the item contain at least one whole seed and no exact copy of that length is
missed, whatever else is edited. Grams and seeds are compared by 64-bit hashes and then character by character.

The items are few and do not grow with the corpus; their number and size are checked before they are sent to the
executors, and more of them go in parts. For edited copies the seeds are short and dense (``edited_leaks``), and the
alignment decides.
Documents are never shuffled: each is hashed where it is read, whole, with vector operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -2, -3


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Code point -> its lower-case, half-width form if it is a letter, digit or ideograph, else 0."""
    table = np.zeros(0x110000, np.uint32)
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    for cp in range(0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if 0xFF00 <= cp <= 0xFFEF:
            ch = unicodedata.normalize("NFKC", ch)
        if len(ch) == 1 and unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            table[cp] = ord(low if len(low) == 1 else ch)
    return table


def letters(text: str) -> np.ndarray:
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    return codes[codes != 0]


def hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` successive codes; built by doubling, so its cost grows with log(gram)."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, base = (codes.astype(np.uint64) + np.uint64(0x5BD1)) * np.uint64(0xD6E8FEB86659FD93), 1, BASE
        out, done, shift = None, 0, np.uint64(1)
        while True:
            if gram & width:
                part = h[done : done + n]
                out = part.copy() if out is None else out * base + part
                done += width
            if width * 2 > gram:
                break
            h = h[: len(h) - width] * base + h[width:]
            width, base = width * 2, base * base
        del shift
        return out ^ (out >> np.uint64(29))


@dataclass
class Filter:
    """Membership of hashes: a bit table first, the sorted hashes for what passes it."""

    values: np.ndarray  # sorted, distinct
    bits: int

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.values & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, indices into values)"""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[i] == h[at]
        return at[ok], i[ok]


def _bits(n: int) -> int:
    return min(26, max(16, int(n).bit_length() + 5))


def _blocks(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, codes, starts): documents joined, a code of its own between them, about ``most`` characters at once."""
    first = 0
    while first < len(texts):
        last, n, parts = first, 0, []
        while last < len(texts) and (n < most or last == first):
            c = letters(texts[last]) if texts[last] else np.zeros(0, np.uint32)
            parts += [c, np.array([0x10FFFF + 1 + (last & 0xFFFF)], np.uint32)]
            n += len(c) + 1
            last += 1
        starts = np.cumsum([0] + [len(a) + 1 for a in parts[::2]])
        yield first, last, np.concatenate(parts), starts
        first = last


def gram_counts(documents: DataFrame, text: str, grams: np.ndarray, gram: int) -> np.ndarray:
    """How often each of the hashes ``grams`` occurs in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = Filter(shared.value, _bits(len(shared.value)))
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, codes, _ in _blocks(list(batch["text"])):
                total += np.bincount(wanted.hits(hashes(codes, gram))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "n": total[some]})

    rows = documents.select(F.col(text).alias("text")).mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # at most one row per gram of the items
    out = np.zeros(len(grams), np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return out


@dataclass
class Seeds:
    """Seeds of all items, by hash, with every place they stand at."""

    ids: list[int]
    items: list[np.ndarray]
    values: np.ndarray
    first: np.ndarray  # of each value, into places
    places: np.ndarray  # (item, position)


def choose_seeds(ids: list[int], items: list[np.ndarray], counts: dict[int, int], gram: int, run: int) -> Seeds:
    stretch = run - gram + 1
    rows = []
    for k, codes in enumerate(items):
        h = hashes(codes, gram)
        n = np.array([counts.get(int(x), 0) for x in h])
        chosen: set[int] = set()
        for lo in range(0, len(h) - stretch + 1):
            if not any(lo <= c < lo + stretch for c in (max(chosen, default=-1),)):
                w = n[lo : lo + stretch]
                chosen.add(lo + int(np.flatnonzero(w == w.min())[-1]))  # the rarest, the last of equals
        rows += [(int(h[p]), k, p) for p in chosen]
    rows.sort()
    if not rows:
        return Seeds(ids, items, np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64))
    values, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
    return Seeds(ids, items, values, np.append(first, len(rows)), np.array([r[1:] for r in rows], np.int64))


def exact_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """How far a[i:] and b[j:] agree to the left and to the right."""
    n = min(i, j)
    left = a[i - n : i][::-1] != b[j - n : j][::-1]
    m = min(len(a) - i, len(b) - j)
    right = a[i : i + m] != b[j : j + m]
    return (int(left.argmax()) if left.any() else n), (int(right.argmax()) if right.any() else m)


def align(items: list[np.ndarray], passages: list[np.ndarray], diagonals: list[int], band: int = 24) -> list[int]:
    """Smith-Waterman score of each passage against its item, within ``band`` of the diagonal (passage minus item
    position); all pairs of a batch advance together, one item character a step, so each step is a vector operation."""
    p, width = len(items), 2 * band + 1
    if not p:
        return []
    rows = max(map(len, items))
    left = band + rows + max(0, *(-d for d in diagonals))
    cols = max(max(len(x) for x in passages), max(diagonals) + rows) + band + left + 2
    grid = np.full((p, cols), 0xFFFFFFFF, np.uint32)
    for k, x in enumerate(passages):
        grid[k, left : left + len(x)] = x
    text = np.full((p, rows), 0xFFFFFFFE, np.uint32)
    for k, x in enumerate(items):
        text[k, : len(x)] = x
    start = np.array(diagonals) + left - band
    view = as_strided(grid, (p, cols - width + 1, width), (grid.strides[0], grid.strides[1], grid.strides[1]))
    ramp = (np.arange(width) * -GAP).astype(np.int32)
    h, best, pick = np.zeros((p, width + 1), np.int32), np.zeros(p, np.int32), np.arange(p)
    for i in range(rows):
        same = view[pick, start + i] == text[:, i : i + 1]
        t = np.maximum(h[:, :width] + np.where(same, MATCH, MISMATCH).astype(np.int32), h[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        t = np.maximum.accumulate(t + ramp, axis=1) - ramp
        h[:, :width] = t
        np.maximum(best, t.max(axis=1), out=best)
    return best.tolist()


def edited_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 22, gram: int = 11, columns: int = 40, similarity: float = 0.8) -> DataFrame:
    """leaks with short seeds, one in every ``run - gram + 1`` positions, so a copy needs only ``run`` successive characters
    as they were between its edits. What a seed joins is accepted by its alignment: by the score that ``similarity`` of
    ``columns`` characters have if they agree, what differs among them not made up for; so shorter common phrases do not
    count, and an edited passage has to be somewhat longer than an exact one."""
    found = leaks(documents, doc_id, text, items, item_id, item_text, run, gram)
    return found.where(F.col("score") >= round(columns * similarity * MATCH))


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 40, gram: int = 20, most_items: int = 50_000, most_chars: int = 50_000_000, aligned: bool = True) -> DataFrame:
    """(doc_id, item_id, longest_run, score, share): each document and item that a seed joins.

    longest_run: the most successive characters of the item, through a seed, that the document has; only letters,
    digits and ideographs count, case and width do not. score: of the best local alignment of the passage with the
    item (edited copies keep a high score where the longest run is short); share: score by that of the whole item.
    Null and empty texts have no grams and appear nowhere; items shorter than ``run`` cannot leak by this measure and
    have no seeds. Repeated items are compared once per item_id. Documents of any length are read whole.
    """
    once = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").dropDuplicates(["i"])
    size = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    parts = max(1, -(-size["n"] // most_items), -(-size["c"] // most_chars))
    if parts > 1:  # more items than one broadcast holds: part by part, each against all documents
        share = [once.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) for k in range(parts)]
        each = [leaks(documents, doc_id, text, p, "i", "t", run, gram, 2 * most_items, 2 * most_chars, aligned) for p in share]
        return reduce(DataFrame.unionByName, each)
    rows = sorted(once.collect(), key=lambda r: r["i"])  # within both bounds
    ids, texts = [r["i"] for r in rows], [letters(r["t"]) for r in rows]
    all_grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(hashes(t, gram) for t in texts if len(t) >= run)]))
    counted = gram_counts(documents, text, all_grams, gram)
    seeds = choose_seeds(ids, texts, dict(zip(all_grams.tolist(), counted.tolist(), strict=True)), gram, run)
    shared = documents.sparkSession.sparkContext.broadcast(seeds)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s: Seeds = shared.value
        wanted = Filter(s.values, _bits(len(s.values)))
        for batch in batches:
            docs = batch["doc_id"].to_numpy()
            out: list[tuple[int, int, int, int]] = []
            todo: list[tuple[np.ndarray, np.ndarray, int]] = []
            for first, _, codes, starts in _blocks(list(batch["text"])):
                at, which = wanted.hits(hashes(codes, gram))
                if not len(at):
                    continue
                of = np.searchsorted(starts, at, "right") - 1
                best: dict[tuple[int, int], tuple[int, int]] = {}
                seen: dict[tuple[int, int, int], int] = {}
                for a, v, d in zip(at.tolist(), which.tolist(), of.tolist(), strict=True):
                    for k, pos in s.places[s.first[v] : s.first[v + 1]].tolist():
                        if a < seen.get((d, k, a - pos), -1):
                            continue
                        left, right = exact_run(s.items[k], pos, codes, a)
                        seen[d, k, a - pos] = a + right
                        if right >= gram:
                            best[d, k] = max(best.get((d, k), (0, 0)), (left + right, a - pos))
                for (d, k), (length, diagonal) in best.items():
                    lo, hi = max(int(starts[d]), diagonal - 40), min(int(starts[d + 1]) - 1, diagonal + len(s.items[k]) + 40)
                    out.append((docs[first + d], s.ids[k], length, k))
                    todo.append((s.items[k], codes[lo:hi].copy(), diagonal - lo))
            score = [x for i in range(0, len(todo), 256) for x in align(*map(list, zip(*todo[i : i + 256], strict=True)))] if aligned else [0] * len(out)
            yield pd.DataFrame(
                {
                    "doc_id": np.array([o[0] for o in out], np.int64), "item_id": np.array([o[1] for o in out], np.int64), "longest_run": np.array([o[2] for o in out], np.int32), "score": np.array(score, np.int32),
                    "share": np.array([x / (MATCH * max(1, len(s.items[o[3]]))) for x, o in zip(score, out, strict=True)], np.float64),
                }
            )

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").mapInPandas(search, "doc_id long, item_id long, longest_run int, score int, share double")
