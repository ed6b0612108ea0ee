"""Text that two documents have in common: exact segments, near-duplicate paragraphs, and what is subtracted from them.

Exact text in common is found on diagonals: every gram of one text that stands in the other gives a point, points in a
row on one diagonal are a maximal run, and the segments are chosen among the runs. Near-duplicate paragraphs are
candidates by bands of length and by an upper bound on the characters they can share, both native; only what passes is
compared in detail, each pair of forms once.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.functions.text import FOLD_FROM, FOLD_TO, SKIPPED, match_form
from bidloom.session import is_empty, materialize

_DOTS = re.compile("[.．…]{2,}")
_SKIP = re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SKIPPED[:-1]))
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_MEANING = re.compile("[一-鿿A-Za-z0-9]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def match_map(text: str) -> tuple[str, list[int]]:
    """The match form and, of each of its characters, the place in the text."""
    spaced = _DOTS.sub(lambda m: " " * len(m[0]), text)
    places = [i for i, c in enumerate(spaced) if not _SKIP.match(c)]
    return "".join(spaced[i] for i in places).translate(_FOLD), places


def gram_hashes(form: str, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` successive characters."""
    codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h = h * _ODD + codes[k : len(codes) - n + 1 + k] + np.uint64(0x5BD1)
        return h ^ (h >> np.uint64(29))


def common_runs(a: str, b: str, least: int = 15, block: int = 2_000_000) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of all maximal common runs of at least ``least`` characters.

    Grams are compared by hash and runs then by character. Places of b are taken in blocks whose points number about
    ``block``, so repetitive texts need time but no more memory; a run over the edge of blocks is put together again.
    """
    ha, hb = gram_hashes(a, least), gram_hashes(b, least)
    if not len(ha) or not len(hb):
        return []
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    count = hi - lo
    at = np.flatnonzero(count)
    done: dict[tuple[int, int], int] = {}  # (diagonal, place after its last point) -> start of the run in b
    out: list[tuple[int, int, int]] = []
    edges = np.searchsorted(np.cumsum(count[at]), np.arange(block, int(count.sum()) + block, block), "left") + 1
    start = 0
    for end in edges:
        some = at[start:end]
        start = end
        if not len(some):
            continue
        j = np.repeat(some, count[some])
        k = np.arange(len(j)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        i = order[np.repeat(lo[some], count[some]) + k]
        turn = np.lexsort((j, i - j))
        i, j = i[turn], j[turn]
        first = np.flatnonzero(np.append(True, (np.diff(i - j) != 0) | (np.diff(j) != 1)))
        last = np.append(first[1:], len(j)) - 1
        fresh: dict[tuple[int, int], int] = {}
        for s, e in zip(first.tolist(), last.tolist(), strict=True):
            d = int(i[s] - j[s])
            begin = done.pop((d, int(j[s])), int(j[s]))
            fresh[d, int(j[e]) + 1] = begin
        out += [(begin + d, begin, stop - begin + least - 1) for (d, stop), begin in done.items()]
        done = fresh
    out += [(begin + d, begin, stop - begin + least - 1) for (d, stop), begin in done.items()]
    return sorted((x, y, n) for x, y, n in out if a[x : x + n] == b[y : y + n])


def chosen_runs(runs: list[tuple[int, int, int]], least: int) -> Iterator[tuple[int, int, int]]:
    """Runs, cut where needed, that use no place of either text twice: along b, always the one that reaches farthest.
    The caller answers each with whether it counts (``send``); what does not is passed over but leaves a free."""
    waiting = sorted(runs, key=lambda r: (r[1], r[0]), reverse=True)
    active: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []  # of a, sorted and disjoint
    j = 0
    while waiting or active:
        while waiting and waiting[-1][1] <= j:
            active.append(waiting.pop())
        active = [r for r in active if r[1] + r[2] - j >= least]
        best, soonest = (0, 0), waiting[-1][1] if waiting else None
        for x, y, n in active:
            i = x + j - y
            k = bisect_right(taken, (i, 1 << 60))
            free = i if not k or taken[k - 1][1] <= i else taken[k - 1][1]
            if free > i:
                soonest = min(free - x + y, soonest if soonest is not None else free - x + y)
                continue
            until = min(x + n, taken[k][0] if k < len(taken) else x + n)
            if until - i > best[0]:
                best = (until - i, i)
        n, i = best
        if n >= least:
            counts = yield i, j, n
            if counts:
                insort(taken, (i, i + n))
            j += n
        elif soonest is None:
            if not active:
                break
            j += 1
        else:
            j = max(j + 1, soonest) if not active else j + 1


def common_segments(left: str, right: str, least: int = 15, context: int = 100) -> list[tuple[int, int, int, str, str, str]]:
    """(start in left, start in right, length, segment, context left, context right) of maximal common segments.

    Compared in match form; length is that of the match form, starts and segments are of the texts as they are, always
    in the order left, right. Neither text is used twice. Segments with few letters and figures do not count.
    """
    a, at_a = match_map(left)
    b, at_b = match_map(right)
    out = []
    picks = chosen_runs(common_runs(a, b, least), least)
    counts: bool | None = None
    while True:
        try:
            x, y, n = picks.send(counts)
        except StopIteration:
            return out
        counts = len(_MEANING.findall(a[x : x + n])) >= max(5, least // 2)
        if counts:
            s, e, s2, e2 = at_a[x], at_a[x + n - 1] + 1, at_b[y], at_b[y + n - 1] + 1
            out.append((s, s2, n, left[s:e], left[max(0, s - context) : e + context], right[max(0, s2 - context) : e2 + context]))


def compared_pairs(pairs: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(left, right, text1, text2) of given pairs with both texts; each pair once, whatever its order."""
    ordered = pairs.where("left <> right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    known = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").dropDuplicates(["key"])
    return ordered.join(known.select(F.col("key").alias("left"), F.col("text").alias("text1")), "left").join(known.select(F.col("key").alias("right"), F.col("text").alias("text2")), "right").select("left", "right", "text1", "text2")


def candidate_pairs(texts: DataFrame, key: str, text: str, least: int = 15) -> DataFrame:
    """(left, right), left < right: texts that can have ``least`` successive characters in common, in match form.

    Of every ``least`` characters the gram with the smallest hash is kept (half of ``least`` long), so texts with that
    much in common share a kept gram. Equal forms are one class while they meet, grams of one class go before the join.
    """
    n = least // 2 + 1

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seeds, of = [], []
            for c, form in zip(batch["c"], batch["form"], strict=True):
                h = gram_hashes(form, n)
                if len(h) >= least - n + 1:
                    w = np.lib.stride_tricks.sliding_window_view(h, least - n + 1)
                    kept = np.unique(w.min(axis=1)).view(np.int64)
                    seeds.append(kept)
                    of.append(np.full(len(kept), c, object))
            if seeds:
                yield pd.DataFrame({"seed": np.concatenate(seeds), "c": np.concatenate(of)})

    once = texts.select(F.col(key).alias("k"), match_form(F.col(text)).alias("form")).where("k is not null and form <> ''").withColumn("c", F.sha2(F.col("form").cast("binary"), 256))
    classes = once.groupBy("c").agg(F.first("form").alias("form"))
    seeds = classes.mapInPandas(emit, "seed long, c string")
    several = seeds.groupBy("seed").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("seed")
    kept = seeds.join(several, "seed", "left_semi")
    met = kept.withColumnRenamed("c", "c1").join(kept.withColumnRenamed("c", "c2"), "seed").where("c1 < c2").select("c1", "c2").distinct()
    members = once.select("c", "k")
    between = met.join(members.select(F.col("c").alias("c1"), F.col("k").alias("i")), "c1").join(members.select(F.col("c").alias("c2"), F.col("k").alias("j")), "c2").select("i", "j")
    within = members.withColumnRenamed("k", "i").join(members.withColumnRenamed("k", "j"), "c").where("i < j").select("i", "j")
    return between.unionByName(within).select(F.least("i", "j").alias("left"), F.greatest("i", "j").alias("right")).distinct()


def runs_of_pairs(compared: DataFrame, least: int = 15) -> DataFrame:
    """(left, right, pos1, pos2, length): all maximal common runs of each pair, by places in match form, from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.left, r.right, *s) for r in batch.itertuples(index=False) for s in common_runs(match_map(r.text1)[0], match_map(r.text2)[0], least)]
            yield pd.DataFrame(rows, columns=["left", "right", "pos1", "pos2", "length"])

    return compared.mapInPandas(run, "left string, right string, pos1 int, pos2 int, length int")


def segments_of_pairs(compared: DataFrame, least: int = 15) -> DataFrame:
    """(left, right, pos1, pos2, length, segment, ctx1, ctx2): the common segments of each pair, an Arrow batch a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.left, r.right, *s) for r in batch.itertuples(index=False) for s in common_segments(r.text1, r.text2, least)]
            yield pd.DataFrame(rows, columns=["left", "right", "pos1", "pos2", "length", "segment", "ctx1", "ctx2"])

    return compared.mapInPandas(run, "left string, right string, pos1 int, pos2 int, length int, segment string, ctx1 string, ctx2 string")


# --- near duplicates

BINS = 48


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _histogram(form: pd.Series) -> pd.Series:
    """How many characters fall into each of a fixed number of bins; the smaller of two histograms bounds what two
    forms can have in common from above."""
    return form.map(lambda f: np.bincount(np.frombuffer(f.encode("utf-32-le", "surrogatepass"), "<u4") % BINS, minlength=BINS).astype(np.int16))


def paragraph_forms(texts: DataFrame, key: str, text: str, low: int = 40, high: int = 500) -> DataFrame:
    """(key, ord, paragraph, form, n, h): the paragraphs of low to high characters in match form; h is a digest."""
    split = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("ord", "paragraph")).withColumn("paragraph", F.trim("paragraph"))
    formed = split.withColumn("form", match_form(F.col("paragraph"))).withColumn("n", F.length("form"))
    return formed.where(F.col("n").between(low, high)).withColumn("h", F.xxhash64("form"))


def paragraph_bands(pairs: DataFrame, forms: DataFrame, width: int = 25, apart: float = 0.3) -> DataFrame:
    """(left, right, ord, h1, h2): paragraphs of given pairs whose lengths lie at most ``apart`` of the longer one from
    each other; an equi-join on bands of length."""
    p = pairs.select("left", "right").where("left <> right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    band = F.floor(F.col("n") / width)
    a = forms.select(F.col("key").alias("left"), "ord", F.col("h").alias("h1"), F.col("n").alias("n1"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = forms.select(F.col("key").alias("right"), F.col("h").alias("h2"), F.col("n").alias("n2"), band.alias("band")).distinct()
    met = p.join(a, "left").join(b, ["right", "band"])
    return met.where(F.abs(F.col("n1") - F.col("n2")) <= apart * F.greatest("n1", "n2")).select("left", "right", "ord", "h1", "h2")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out, matcher, second = [], difflib.SequenceMatcher(None, autojunk=False), None
    for x, y in zip(a, b, strict=True):
        if y != second:
            matcher.set_seq2(y)
            second = y
        matcher.set_seq1(x)
        out.append(matcher.ratio() if matcher.quick_ratio() >= 0.8 else 0.0)
    return pd.Series(out, dtype="float64")


def near_paragraphs(pairs: DataFrame, texts: DataFrame, key: str, text: str, low: float = 0.8, high: float = 0.98) -> DataFrame:
    """(left, right, paragraph1, paragraph2, ratio): of each paragraph the most similar one of the other text, for ratios
    from low to below high, in match form. Candidates carry digests only; each pair of forms is compared once."""
    forms = paragraph_forms(texts, key, text)
    bands = paragraph_bands(pairs, forms).where("h1 <> h2")
    distinct = forms.groupBy("h").agg(F.first("form").alias("form"), F.first("n").alias("n"))
    distinct = distinct.withColumn("bins", _histogram("form"))
    a, b = (distinct.select(*[F.col(c).alias(f"{c}{i}") for c in distinct.columns]) for i in (1, 2))
    todo = bands.select("h1", "h2").distinct().join(a, "h1").join(b, "h2")
    shared = F.aggregate(F.zip_with("bins1", "bins2", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
    possible = todo.where(2.0 * shared >= low * (F.col("n1") + F.col("n2"))).repartition(F.col("h2"))
    scored = possible.select("h1", "h2", _ratio("form1", "form2").alias("ratio")).where((F.col("ratio") >= low) & (F.col("ratio") < high))
    best = bands.join(scored, ["h1", "h2"]).groupBy("left", "right", "ord").agg(F.max_by(F.struct("h2", "ratio"), F.struct("ratio", "h2")).alias("b"))
    named = forms.groupBy("key", "h").agg(F.min("paragraph").alias("paragraph"))
    out = best.join(forms.select(F.col("key").alias("left"), "ord", F.col("paragraph").alias("paragraph1")), ["left", "ord"])
    out = out.select("left", "right", "paragraph1", F.col("b.h2").alias("h"), F.round("b.ratio", 3).alias("ratio"))
    return out.join(named.select(F.col("key").alias("right"), "h", F.col("paragraph").alias("paragraph2")), ["right", "h"]).select("left", "right", "paragraph1", "paragraph2", "ratio")


# --- templates and references


def template_windows(texts: DataFrame, scope: str, group: str, text: str, width: int = 100, step: int = 50, least: int = 3, ratio: float = 0.5) -> DataFrame:
    """(scope, form, n_groups, n_all): windows of text, in match form, that at least ``ratio`` of a scope's groups have,
    and at least ``least``. Windows start at multiples of ``step``; forms of fewer than 30 characters do not count."""
    rows = texts.select(F.col(scope).alias("scope"), F.col(group).alias("group"), F.col(text).alias("text")).where("scope is not null and group is not null and text is not null")
    everyone = rows.groupBy("scope").agg(F.countDistinct("group").alias("n_all"))
    starts = F.explode(F.when(F.length("text") >= width, F.sequence(F.lit(0), F.length("text") - width, F.lit(step))).otherwise(F.array().cast("array<int>")))
    windows = rows.select("scope", "group", "text", starts.alias("s")).select("scope", "group", match_form(F.substring("text", F.col("s") + 1, F.lit(width))).alias("form")).where(F.length("form") >= 30)
    return windows.groupBy("scope", "form").agg(F.countDistinct("group").alias("n_groups")).join(everyone, "scope").where(F.col("n_groups") >= F.greatest(F.lit(least), F.ceil(F.col("n_all") * ratio)))


def containments(needles: DataFrame, hay: DataFrame, gram: int, most: int = 1_000_000) -> DataFrame:
    """(needle, hay): ids of needles (id, form) that stand in a hay (id, form); needles shorter than ``gram`` in none.

    The hash of the first ``gram`` characters of a needle meets that of every place of a hay, then the whole needle is
    compared at that place. If the hay has at most ``most`` places their hashes are sent out and only needles that begin
    like one go on; if at most ``most`` needles go on theirs are sent out and only places that hit are kept. Beyond both
    bounds the two sides are joined. Forms are shuffled only for what hits.
    """
    spark, needle_kind, hay_kind = hay.sparkSession, dict(needles.dtypes)["id"], dict(hay.dtypes)["id"]
    hay = hay.where(F.length("form") >= gram).select("id", "form")

    def sent(hashes: DataFrame) -> object | None:
        some = hashes.limit(most + 1).toArrow().column(0).to_numpy()
        return spark.sparkContext.broadcast(np.sort(some)) if len(some) <= most else None

    def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def places(known: object | None):  # noqa: ANN202
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, at, grams = [], [], []
                for k, form in zip(batch["id"], batch["form"], strict=True):
                    h = gram_hashes(form, gram).view(np.int64)
                    hit = np.arange(len(h)) if known is None else np.flatnonzero(among(h, known.value))
                    ids += [k] * len(hit)
                    at.append(hit + 1)
                    grams.append(h[hit])
                if ids:
                    yield pd.DataFrame({"hay": ids, "p": np.concatenate(at).astype(np.int32), "g": np.concatenate(grams)})

        return hay.mapInPandas(emit, f"hay {hay_kind}, p int, g long")

    n_places = hay.agg(F.coalesce(F.sum(F.length("form") - (gram - 1)), F.lit(0)).alias("n")).first()["n"]
    beginnings = sent(places(None).select("g").distinct()) if n_places <= most else None

    def heads_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = np.array([gram_hashes(f[:gram], gram)[0] for f in batch["form"]], np.uint64).view(np.int64)
            on = among(g, beginnings.value) if beginnings is not None else np.ones(len(g), bool)
            if on.any():
                yield pd.DataFrame({"needle": batch["id"][on], "nf": batch["form"][on], "g": g[on]})

    heads = materialize(needles.where(F.length("form") >= gram).select("id", "form").mapInPandas(heads_of, f"needle {needle_kind}, nf string, g long"))
    met = places(sent(heads.select("g").distinct())).join(heads, "g")
    whole = met.join(hay.withColumnRenamed("id", "hay"), "hay")
    return whole.where(F.substring("form", F.col("p"), F.length("nf")) == F.col("nf")).select("needle", "hay").distinct()


def contained_in(segments: DataFrame, key: str, text: str, references: DataFrame, reference: str, least: int = 12) -> DataFrame:
    """(key) of segments whose match form stands in a reference text; forms shorter than ``least`` never do."""
    refs = references.select(match_form(F.col(reference)).alias("form")).where("form <> ''").distinct().withColumn("id", F.xxhash64("form"))
    rows = materialize(segments.select(F.col(key), match_form(F.col(text)).alias("form")).distinct().where(F.length("form") >= least))
    found = containments(rows.select("form").distinct().withColumn("id", F.xxhash64("form")), refs, least)
    return rows.withColumn("needle", F.xxhash64("form")).join(found.select("needle").distinct(), "needle", "left_semi").select(key)


def in_template(segments: DataFrame, key: str, scope: str, text: str, windows: DataFrame, least: int = 20) -> DataFrame:
    """(key) of segments whose match form is a window of their scope's template, stands in one or holds one; the last two
    only from ``least`` characters. windows: (scope, form). The scope is part of what is compared."""
    rows = materialize(segments.select(F.col(key).alias("key"), F.col(scope).alias("scope"), match_form(F.col(text)).alias("form")).where("scope is not null and form <> ''"))
    windows = materialize(windows.select("scope", "form").distinct())
    if is_empty(windows):
        return rows.select(F.col("key").alias(key)).limit(0)
    own, other = (df.select("scope", "form").distinct().withColumn("id", F.xxhash64("scope", "form")) for df in (rows, windows))
    same = rows.join(windows, ["scope", "form"], "left_semi").select("key")

    def within_scope(found: DataFrame) -> DataFrame:
        a, b = own.select(F.col("id").alias("o"), F.col("scope").alias("s1")), other.select(F.col("id").alias("w"), F.col("scope").alias("s2"))
        return found.join(a, "o").join(b, "w").where("s1 = s2").select("o").distinct()

    held = within_scope(containments(own, other, least).select(F.col("needle").alias("o"), F.col("hay").alias("w")))
    holds = within_scope(containments(other, own, least).select(F.col("needle").alias("w"), F.col("hay").alias("o")))
    part = rows.withColumn("o", F.xxhash64("scope", "form")).join(held.unionByName(holds).distinct(), "o", "left_semi").select("key")
    return same.unionByName(part).distinct().withColumnRenamed("key", key)


def paragraphs(texts: DataFrame, key: str, text: str, low: int = 40, high: int = 500, most: int = 120) -> DataFrame:
    """(key, ord, paragraph, n_form, rank): a text's longest paragraphs, by the length of their match form."""
    split = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("ord", "paragraph")).withColumn("paragraph", F.trim("paragraph"))
    sized = split.withColumn("n_form", F.length(match_form(F.col("paragraph")))).where(F.col("n_form").between(low, high))
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_form"), "ord"))).where(F.col("rank") <= most)


def text_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, n_texts) of match forms that several texts have; one row a class, named by its smallest key."""
    forms = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.sha2(match_form(F.col(text)).cast("binary"), 256).alias("h")).distinct()
    return forms.groupBy("h").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("rep", "n_texts")
