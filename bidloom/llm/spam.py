"""Problem 9: pages of stuffed keywords, links, navigation or tags instead of sentences.

Method: pointwise mutual information (PMI) of neighbouring words, from corpus counts. Where its mean over a window around
a word is low, the words stand next to each other by chance (word salad, tag and link lists). Excessively repeated
collocations are flagged beside it: windows in which nearly all words of a language with blanks belong to pairs of high
PMI that come again in the same window, and windows in which nearly all Chinese text is made of words that come again
(a word of several ideographs is a collocation of them by itself). A document is spam if the flagged words hold at least
``share`` of its text.

A word is a run of letters between marks or blanks: a word of English, a clause, cell or tag of Chinese. So Chinese
sentences consist of words that are rare as a whole and of high PMI, whereas keywords are frequent and combine freely; in
English it is the other way round inside a keyword phrase, so there its repetition tells. Figures at the end of a Chinese
word are not part of it; a link is one word.

Counts are exact and taken over all documents: documents go into blocks, each block's words and pairs are summed with those
of all other blocks, and each block gets the sums of its own back. ``mean_pmi`` is the PMI of these counts. For the
thresholds each count is raised by the same share of the corpus (``added`` a character, one in ten million), whatever its
size: without it the PMI of a pair that is seen once sinks as the corpus grows, and on 100,000 documents 39 pages of
content more were flagged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK = re.compile(r'<a href="[^"]*">|</a>|(?:https?://|www\.)[^\s)\]<>"，。；]+')
LINK_WORD, LINK_WEIGHT = 0xE000, 4
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
SEP, HAN, LETTER, DIGIT = 0, 1, 2, 3
ALL = np.uint64(0)  # stands for any word among the hashes
BLOCK = 8_000_000  # characters


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kind[0x20000:0x323B0] = HAN
    kind[LINK_WORD] = HAN
    for cp in range(0x10000):
        ch = chr(cp)
        c = unicodedata.category(ch)
        if c == "Lo":
            kind[cp] = HAN if cp >= 0x2E80 else LETTER
        elif c[0] == "L":
            kind[cp] = LETTER
            if len(ch.lower()) == 1:
                low[cp] = ord(ch.lower())
        elif c == "Nd":
            kind[cp] = DIGIT
    return kind, low


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: hash, length, and what they are made of; of[i] is the text a word stands in."""

    def __init__(self, texts: list[str | None]) -> None:
        plain = [LINK.sub(f" {chr(LINK_WORD)} ", t) if "://" in t or "www." in t or "</a>" in t else t for t in ((t or "").replace(chr(LINK_WORD), " ") for t in texts)]
        raw = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in plain])
        kinds, low = classes()
        kind, codes = kinds[raw], low[raw].astype(np.uint64)
        inner = np.flatnonzero((kind[1:-1] == SEP) & (kind[:-2] != SEP) & (kind[2:] != SEP) & ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2D) | (raw[1:-1] == 0x2C))) + 1
        dots = inner[(raw[inner] != 0x2D) & (kind[inner - 1] == DIGIT) & (kind[inner + 1] == DIGIT)]
        dash = inner[(raw[inner] == 0x2D) & (kind[inner - 1] >= LETTER) & (kind[inner + 1] >= LETTER)]
        kind[dots], kind[dash] = DIGIT, LETTER
        on = kind != SEP
        cut = np.zeros(len(kind) + 1, bool)
        cut[1:-1] = (kind[1:] + kind[:-1] == HAN + LETTER) & on[1:] & on[:-1]  # between scripts
        link = raw == LINK_WORD
        cut[1:-1] |= link[1:] | link[:-1]
        before = np.append(False, on)
        after = np.append(on, False)
        first = np.flatnonzero(after & (~before | cut))
        last = np.flatnonzero(before & (~after | cut))
        place = np.arange(len(kind))
        sign = np.maximum.accumulate(np.where(on & (kind != DIGIT), place, -1))[last - 1]
        lettered = sign >= first
        stop = np.where(lettered & (kind[np.maximum(sign, 0)] == HAN), sign + 1, last)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(len(codes), STEP)))
            sums = np.append(np.uint64(0), np.cumsum((codes + np.uint64(0x1F123BB5)) * power[:-1]))
            back = np.cumprod(np.append(np.uint64(1), np.full(len(codes), BACK)))
            self.hash = mix((sums[stop] - sums[first]) * back[first] + (stop - first).astype(np.uint64))
        self.length = last - first
        self.link = link[first]
        digits = np.append(0, np.cumsum(kind == DIGIT))
        han = np.append(0, np.cumsum(kind == HAN))
        self.digit = digits[last] > digits[first]
        self.han = (han[last] > han[first]) & ~self.link
        self.latin = lettered & ~self.han & ~self.link
        self.length[self.link] = LINK_WEIGHT
        self.of = np.searchsorted(ends, first, "right")

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of neighbours in one text."""
        i = np.flatnonzero(self.of[1:] == self.of[:-1])
        with np.errstate(over="ignore"):
            return i, mix(self.hash[i] * np.uint64(0xD6E8FEB86659FD93) + self.hash[i + 1] * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def blocks(texts: list[str | None], most: int = 300_000) -> Iterator[list[str | None]]:
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t or "") + 1
        if n >= most:
            yield texts[start : i + 1]
            start, n = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)


def _counted(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, numbers) of the words, of the pairs and of all words."""
    return [np.unique(w.hash, return_counts=True), np.unique(w.pairs()[1], return_counts=True), (np.array([ALL]), np.array([len(w.hash)]))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h, n) of each word and pair of a block; one row a hash and block, unless a block is huge."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def out(block: int) -> pa.RecordBatch:
        h, n = _merge(held.pop(block))
        return pa.record_batch({"block": np.full(len(h), block, np.int32), "h": h.view(np.int64), "n": n})

    for batch in batches:
        of, texts = batch.column("block").to_numpy(), np.array(batch.column("text").to_pylist(), object)
        for block in np.unique(of).tolist():
            for some in blocks(list(texts[of == block])):
                held[block] += _counted(Words(some))
            if sum(len(h) for h, _ in held[block]) > 4_000_000:
                yield out(block)
    for block in list(held):
        yield out(block)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h, n): the sum over all blocks for each block that has the hash, unless it has all of them itself."""
    parts = [tuple(b.column(c).to_numpy() for c in ("block", "h", "n")) for b in batches]
    if parts:
        block, h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)[inverse]
        more = total != n
        yield pa.record_batch({"block": block[more], "h": h[more], "n": total[more]})


def _corpus_counts(words: list[Words], sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's words and pairs and their numbers in the whole corpus."""
    h, n = _merge([part for w in words for part in _counted(w)])
    more = sums["h"].to_numpy().view(np.uint64)
    i = np.searchsorted(h, more)
    if len(more) and (i.max() == len(h) or (h[i] != more).any()):
        raise ValueError("the documents are not the same when they are read again")
    n[i] = sums["n"].to_numpy()
    return h, n.astype(np.float64)


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a repartition into ``n`` puts into one partition each."""
    return [r.k for r in spark.range(40 * n).selectExpr("int(id) k").groupBy(F.expr(f"pmod(hash(k), {n})")).agg(F.min("k").alias("k")).collect()]


def _windows(of: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of about ``size`` within a text; a short last stretch joins the one before."""
    before = np.cumsum(length) - length
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    text = np.cumsum(np.append(True, of[1:] != of[:-1])) - 1
    at = before - before[first][text]
    whole = np.add.reduceat(length, first)
    count = np.maximum(1, (whole + size // 2) // size)
    return (np.cumsum(count) - count)[text] + np.minimum(at // size, count[text] - 1)


def text_scores(w: Words, n_texts: int, known: np.ndarray, numbers: np.ndarray, added: float, low_pmi: float, low_latin: float = 1.8, half: int = 4) -> dict[str, np.ndarray]:
    """Of each text: mean PMI of its neighbouring words, share of text of low local PMI, share of repeated collocations,
    share flagged in all. ``known`` has the hashes of all its words and pairs, sorted; ``added`` is what each number is
    raised by for the shares."""
    n = len(w.hash)
    weight = np.bincount(w.of, w.length, n_texts)
    out = {"pmi": np.full(n_texts, np.nan), "low": np.zeros(n_texts), "repeated": np.zeros(n_texts), "flagged": np.zeros(n_texts)}
    if not n:
        return out
    i, h = w.pairs()
    everything, single, both = (numbers[np.searchsorted(known, x)] for x in (ALL, w.hash, h))
    exact = np.log(both * everything / (single[i] * single[i + 1]))
    pmi = np.log((both + added) * everything / ((single[i] + added) * (single[i + 1] + added)))
    low = np.zeros(n, bool)
    latin = w.latin[i] & w.latin[i + 1]
    for chosen, limit, here in ((latin, low_latin, w.latin), (~latin, low_pmi, ~w.latin)):  # pairs of English among themselves
        value, has = np.zeros(n + 1), np.zeros(n + 1)
        value[i[chosen] + 1], has[i[chosen] + 1] = pmi[chosen], 1  # at the second word of the pair
        values, having = np.cumsum(value), np.cumsum(has)
        first = np.searchsorted(w.of, w.of, "left")
        final = np.searchsorted(w.of, w.of, "right") - 1
        place = np.arange(n)
        lo, hi = np.maximum(first, place - half - 1), np.minimum(final, place + half + 1)
        pairs = having[hi] - having[lo]
        local = np.where(pairs >= 5, (values[hi] - values[lo]) / np.maximum(1, pairs), np.inf)
        low |= (local < limit) & here & (having[final] - having[first] >= 10)  # too few pairs say nothing
    repeated = _repeated_words(w) | _repeated_pairs(w, i[latin & (pmi >= low_pmi)], h[latin & (pmi >= low_pmi)])
    all_pairs = np.bincount(w.of[i], minlength=n_texts)
    out["pmi"] = np.where(all_pairs > 0, np.bincount(w.of[i], exact, n_texts) / np.maximum(1, all_pairs), np.nan)
    for name, marked in (("low", low), ("repeated", repeated), ("flagged", low | repeated)):
        out[name] = np.bincount(w.of, w.length * marked, n_texts) / np.maximum(1, weight)
    return out


def _times(hash_: np.ndarray, window: np.ndarray) -> np.ndarray:
    """How often each hash occurs in its window."""
    with np.errstate(over="ignore"):
        key = mix(hash_ + window.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[inverse]


def _repeated_words(w: Words, size: int = 300, least: int = 50, share: float = 0.6) -> np.ndarray:
    """Chinese words in windows of about ``size`` characters of which at least ``share`` stand in words that come again."""
    out = np.zeros(len(w.hash), bool)
    chosen = np.flatnonzero(w.han & ~w.digit)
    if len(chosen):
        window = _windows(w.of[chosen], w.length[chosen], size)
        held = np.bincount(window, w.length[chosen])
        again = np.bincount(window, w.length[chosen] * (_times(w.hash[chosen], window) > 1))
        out[chosen] = ((again >= share * held) & (held >= least))[window]
    return out


def _repeated_pairs(w: Words, i: np.ndarray, h: np.ndarray, size: int = 120, least: int = 20) -> np.ndarray:
    """English words in windows of about ``size`` words of which nearly all belong to collocations (pairs of high PMI, i and
    h) that come again in the window: 0.8 of a whole window, somewhat less of a short one, where fewer can come again."""
    out = np.zeros(len(w.hash), bool)
    chosen = np.flatnonzero(w.latin)
    if len(chosen) and len(i):
        window = np.zeros(len(w.hash), np.int64)
        window[chosen] = _windows(w.of[chosen], np.ones(len(chosen), np.int64), size)
        again = i[_times(h, window[i]) > 1]
        covered = np.zeros(len(w.hash), bool)
        covered[again] = covered[again + 1] = True
        held = np.bincount(window[chosen])
        share = np.bincount(window[chosen], covered[chosen]) / np.maximum(1, held)
        out[chosen] = ((share >= 0.6 + 0.2 * np.minimum(1, held / size)) & (held >= least))[window[chosen]]
    return out


def spam_scores(documents: DataFrame, doc_id: str, text: str, added: float = 1e-7, low_pmi: float = 4.4, low_latin: float = 1.8) -> DataFrame:
    """(doc_id, mean_pmi, low_share, repeated_share, flagged_share) of each document; spam from a flagged_share of 0.5.

    ``low_pmi`` is for corpora of some ten thousand words and more. PMI cannot exceed the logarithm of the number of
    words, so for a smaller corpus it has to be lower. ``low_latin`` is for neighbours that are both words of a language
    with blanks, which are more frequent: on the larger test tables ten of them have a mean of 2.4 at least in sentences
    and of 1.3 at most, but for one in a hundred, in the same words shuffled.

    Null texts are left out; texts without words have shares of 0 and no mean. Texts are judged whole, whatever their
    length. Documents are shuffled once, into blocks of about ``BLOCK`` characters by their place, so that many equal rows
    are no large block; nothing is collected.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text").cast("double"))).first()[0] or 0.0
    n = max(spark.sparkContext.defaultParallelism, round(chars / BLOCK))
    keys = _even_keys(spark, n)
    placed = rows.withColumn("block", F.expr(f"array({','.join(map(str, keys))})[int(pmod(xxhash64(monotonically_increasing_id()), {len(keys)}))]")).repartition(n, "block")
    counts = placed.mapInArrow(_count, "block int, h long, n long").repartition(n, "h")
    sums = counts.mapInArrow(_total, "block int, h long, n long").repartition(n, "block")
    more = chars * added

    def score(mine: pa.Table, of_all: pa.Table) -> pa.Table:
        parts = [(Words(t), len(t)) for t in blocks(mine["text"].to_pylist())]
        known, numbers = _corpus_counts([w for w, _ in parts], of_all)
        got = [text_scores(w, size, known, numbers, more, low_pmi, low_latin) for w, size in parts]
        return pa.table({"doc_id": mine["doc_id"], **{new: pa.array(np.concatenate([p[old] for p in got]), from_pandas=True) for old, new in (("pmi", "mean_pmi"), ("low", "low_share"), ("repeated", "repeated_share"), ("flagged", "flagged_share"))}})

    return placed.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, "doc_id long, mean_pmi double, low_share double, repeated_share double, flagged_share double")
