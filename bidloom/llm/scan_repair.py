"""Problem 1: text from scanned pages made readable again.

Method: the lines of a text are labelled by a hidden Markov model as header, break (page number), table row, line that
its paragraph continues after, or line that ends a paragraph, from layout features; paragraphs are put together
accordingly. The model's probabilities are counted over all texts: first from the lines that are plain by themselves,
then from all lines with the labels that the model itself gives (two rounds of Viterbi training); the lines that are not
plain (short open lines, titles that stand once, lines before something that reads like a beginning) only the model
decides. Misread characters are repaired in
the joined text, from counts over all texts: words and characters in context that are rare become the look-alike that
is frequent there. Identity numbers are repaired by the same marks (breaks, gaps, page numbers, letters read for digits).

What is no scan damage stays as it is: a single title at the top, table rows, section numbers, page references inside
sentences, and forms of characters (full width, invisible characters and so on), which are only looked through.
A record is damaged exactly if the repair changes it.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.llm.lookalikes import plain_form
from bidloom.session import SizeBoundExceeded, bounded_rows, materialize

HEADER, BREAK, TABLE, GOES_ON, ENDS = range(5)
HAN = "㐀-䶿一-鿿"
# How page numbers stand on a line of their own, for text and for a number broken by one.
PAGE = re.compile(r"(?:第\s?[\dlIO]{1,4}\s?页(?:[,，]?\s?共\s?[\dlIO]{1,4}\s?页)?|共\s?\d{1,4}\s?页|[Pp]age\s[\dlIO]{1,4}(?:\sof\s[\dlIO]{1,4})?|[-–—~]\s?[\dlIO]{1,4}\s?[-–—~]|\[[\dlIO]{1,4}\]|[\dlIO]{1,4}/[\dlIO]{1,4}|[·•]\s?[\dlIO]{1,4}\s?[·•]|[\dlIO]{1,4})")
CLOSED = re.compile(r"[。．.!！?？;；:：)）】》」』”\"]$")
HYPHEN = re.compile(r"(?<=[A-Za-z])[-‐¬­]\s*$")
# Ideographs (and kana) that scanning confuses, misread first.
CONFUSED = {
    "末": "未", "未": "末", "入": "人", "人": "入", "曰": "日", "日": "曰", "囗": "口", "口": "囗", "贡": "质", "没": "设", "侧": "测", "测": "侧", "科": "料", "料": "科", "士": "土", "土": "士", "木": "术", "术": "木",
    "己": "已", "已": "己", "エ": "工", "カ": "力", "ロ": "口", "ニ": "二", "白": "自", "自": "白", "大": "太", "太": "大", "干": "于", "于": "干", "天": "夫", "夫": "天", "千": "干", "拔": "拨", "拨": "拔", "申": "甲", "甲": "申",
    "目": "日", "刀": "力", "巳": "已", "午": "牛", "牛": "午", "兔": "免", "免": "兔", "戌": "成", "戍": "成", "治": "冶", "冶": "治", "仑": "仓", "今": "令", "令": "今", "乌": "鸟", "鸟": "乌", "候": "侯", "侯": "候", "微": "徽", "徽": "微",
}
DIGIT_TWIN = str.maketrans("OoQDlI|iSsBZz", "0000111155822"[:13])
MISREAD_NUMBER = re.compile(r"(?<![A-Za-z0-9/\-_.,])(?=[\d.,]*[OoQlI|SBZ])(?=[OoQlI|SBZ.,]*\d)[\dOoQlI|SBZ]+(?:[.,][\dOoQlI|SBZ]+)*(?![A-Za-z0-9/_\-])")
OTHER_LETTER, ATTACHED = r"[^\W\d_\u3400-\u4dbf\u4e00-\u9fff]", r"[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]"  # ATTACHED: accents, invisible characters
WORD = re.compile(rf"(?<!{OTHER_LETTER})(?<!{ATTACHED})(?<![A-Za-z0-9])[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?![A-Za-z0-9]|{OTHER_LETTER}|{ATTACHED})")
LETTER_TWINS = {"1": "lI", "0": "oO", "5": "sS", "8": "B", "l": "1", "O": "0", "I": "1l", "S": "5", "B": "8", "c": "e", "e": "c", "o": "0", "Z": "2"}
ONE_TWIN = str.maketrans("lIoOsSBe2", "1100558cZ")
CONTEXT = re.compile(f"[{''.join(CONFUSED)}]")
COUNTED = re.compile(f"[{''.join(set(CONFUSED) | set(CONFUSED.values()))}]")


def squeezed(line: str) -> str:
    """A line by what a header repeats: without blanks, look-alike readings made one, figures as one sign."""
    s = "".join(CONFUSED.get(c, c) if c in "末入曰囗贡没侧科士木己エカロ" else c for c in re.sub(r"\s+", "", line))
    return re.sub(r"[0O]", "o", re.sub(r"[1lI|]", "l", s)).lower().replace("c", "e")


SIZES = (4, 3, 2, 3, 3, 4, 3, 2)  # values of each feature
CONTINUES = re.compile(f"[a-z{HAN}]")
MIXED = re.compile(f"[A-Za-z]{{2}}[{HAN}]|[{HAN}][A-Za-z]{{2}}")  # as inside a sentence
BEGINS = re.compile(r"(?:第[一二三四五六七八九十\d]+[章节条]|[一二三四五六七八九十]{1,3}[、.]|\d{1,2}(?:\.\d{1,2})*[、.\s]|[（(][一二三四五六七八九十\d]{1,2}[)）])")


def observe(lines: list[str]) -> list[tuple[int, ...]]:
    """The layout features of each line: what it looks like (blank, page number, table row, text), whether it comes again in
    the text (as it is, nearly so), whether it reads like a title, how it ends (closed, open, hyphen), how wide it is for its text, where on its
    page it stands (first line, after or before a page number, elsewhere), how the next line begins (as a continuation,
    as something new, not at all), whether marks of sentences stand inside it."""
    inner = [plain_form(x.rstrip("­¬")).strip() if x.isascii() is False else x.strip() for x in lines]
    page = [bool(PAGE.fullmatch(x)) for x in inner]
    short = [bool(x) and len(x) <= 48 and "|" not in x and not p and not re.search(r"[。，,;；]", x) for x, p in zip(inner, page, strict=True)]
    bare = [squeezed(x) if s else "" for x, s in zip(inner, short, strict=True)]
    again = Counter(b for b in bare if b)
    near = _near_repeats(Counter(b for b in again if not MIXED.search(b)))
    widths = sorted(len(x) for x in inner if x and "|" not in x)
    wide = widths[len(widths) * 3 // 4] if widths else 0
    filled = [n for n, x in enumerate(inner) if x]
    before = dict(zip(filled[1:], filled, strict=False))
    after = dict(zip(filled, filled[1:], strict=False))
    out = []
    for n, (x, s) in enumerate(zip(inner, short, strict=True)):
        shape = 0 if not x else 1 if page[n] else 2 if x.count("|") else 3
        repeats = (2 if again[bare[n]] > 1 else 1 if bare[n] in near else 0) if s and len(x) >= 4 else 0
        title = s and bool(re.fullmatch(f"(?:\\d{{1,2}}(?:\\.\\d{{1,2}}){{0,3}}\\s+)?[{HAN}A-Za-z0-9]{{2,24}}(?:\\s+[{HAN}A-Za-z0-9\\-]{{1,16}}){{1,5}}", x)) and not CLOSED.search(x) and not MIXED.search(x)
        end = 2 if HYPHEN.search(lines[n]) else 0 if CLOSED.search(x) or not x else 1
        width = 2 if len(x) >= 0.75 * wide else 1 if len(x) >= 0.5 * wide else 0
        place = 0 if n == 0 else 1 if n in before and page[before[n]] else 2 if n in after and page[after[n]] else 3
        following = inner[after[n]] if n in after else ""
        ahead = 0 if not following else 2 if BEGINS.match(following) else 1 if CONTINUES.match(following) else 0
        out.append((shape, repeats, int(title), end, width, place, ahead, int(bool(re.search(r"[。，,;；]", x[:-1])))))
    return out


def _near_repeats(lines: Counter[str], least: float = 0.75) -> set[str]:
    """The short lines that are nearly another one, as misread running headers are."""
    out: set[str] = set()
    by_length = sorted((b for b in lines if len(b) >= 4), key=len)
    for i, a in enumerate(by_length):
        for b in by_length[i + 1 :]:
            if len(b) > len(a) * (2 - least) / least:
                break
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            if (a not in out or b not in out) and m.quick_ratio() >= least and m.ratio() >= least:
                out |= {a, b}
    return out


def suggested(symbols: list[tuple[int, ...]]) -> list[int]:
    """Labels of the lines that are plain by themselves, -1 for those that the model must learn to tell: open lines that
    are short for their text, titles that do not come again, and lines before something that reads like a beginning."""
    out = []
    for shape, repeats, title, end, width, place, ahead, _ in symbols:
        if shape == 1:
            out.append(BREAK)
        elif shape == 2:
            out.append(TABLE)
        elif repeats == 2 and title or title and place == 0:
            out.append(HEADER)
        elif shape == 0 or end == 0:
            out.append(ENDS)
        elif title or width < 2 and end == 1 or ahead == 2:
            out.append(-1)
        else:
            out.append(GOES_ON)
    return out


@dataclass
class Model:
    """Counts of a hidden Markov model whose features are independent given the label; unseen events have a small count."""

    start: list[float] = field(default_factory=lambda: [0.1] * 5)
    step: list[list[float]] = field(default_factory=lambda: [[0.1] * 5 for _ in range(5)])
    emit: list[list[list[float]]] = field(default_factory=lambda: [[[0.1] * n for n in SIZES] for _ in range(5)])

    def add(self, kind: str, a: int, b: int, n: float) -> None:
        if kind == "start":
            self.start[a] += n
        elif kind == "step":
            self.step[a][b] += n
        else:
            self.emit[a][b // 8][b % 8] += n

    def logs(self) -> tuple[list[float], list[list[float]], list[list[list[float]]]]:
        log = lambda row: [math.log(x / sum(row)) for x in row]
        return log(self.start), [log(row) for row in self.step], [[log(f) for f in of] for of in self.emit]


def viterbi(symbols: list[tuple[int, ...]], logs: tuple) -> list[int]:
    start, step, emit = logs
    if not symbols:
        return []
    seen: dict[tuple[int, ...], list[float]] = {}

    def of(o: tuple[int, ...]) -> list[float]:
        if o not in seen:
            seen[o] = [sum(e[f][v] for f, v in enumerate(o)) for e in emit]
            for label in range(5):  # page numbers and table rows show by their form, and a header reads like a title or comes again
                possible = (label == BREAK) == (o[0] == 1) and (label == TABLE) == (o[0] == 2) and (label != HEADER or o[1] or o[2])
                if not possible:
                    seen[o][label] = -1e9
        return seen[o]

    score = [start[k] + of(symbols[0])[k] for k in range(5)]
    back = []
    for o in symbols[1:]:
        e = of(o)
        best = [max(range(5), key=lambda j, k=k: score[j] + step[j][k]) for k in range(5)]
        score = [score[best[k]] + step[best[k]][k] + e[k] for k in range(5)]
        back.append(best)
    k = max(range(5), key=score.__getitem__)
    out = [k]
    for best in reversed(back):
        k = best[k]
        out.append(k)
    return out[::-1]


def joined(text: str, logs: tuple) -> str:
    """The text in whole paragraphs: page numbers and running headers away, broken lines put together."""
    lines = text.split("\n")
    if len(lines) < 2:
        return text
    symbols = observe(lines)
    labels = viterbi(symbols, logs)
    out: list[str] = []
    pending = False  # the last line of out goes on
    for n, (line, label) in enumerate(zip(lines, labels, strict=True)):
        if label == BREAK or (label == HEADER and n > 0):
            continue
        if not line.strip():
            if not pending:
                out.append(line)
            continue
        if pending and label in (GOES_ON, ENDS):
            out[-1] = glue(out[-1], line)
        else:
            out.append(line)
        pending = label == GOES_ON
    return "\n".join(out)


def glue(left: str, right: str) -> str:
    """Two halves of a broken line: hyphenated words and codes without, words of a language with blanks with a blank."""
    right = right.lstrip()
    if HYPHEN.search(left) and right[:1].isascii() and right[:1].isalpha():
        return HYPHEN.sub("", left) + right
    left = left.rstrip()
    if not re.search(r"[A-Za-z0-9.,;:)]$", left) or not re.match(r"[A-Za-z0-9(]", right):
        return left + right
    if re.search(r"\d$", left) and right[:1].isdigit() or re.search(r"(?:^|[^A-Za-z0-9])[A-Z0-9/\-]*[A-Z/\-][A-Z0-9/\-]*$", left) and re.match(r"[A-Z0-9/\-]+(?![a-z])", right) or re.search(r"\d[.,]$", left) and right[:1].isdigit():
        return left + right
    return left + " " + right


def neighbour(c: str) -> str:
    """What stands beside a character: a figure as one sign, styled forms as plain."""
    c = plain_form(c)
    return "0" if c and (c.isdigit() or c in "OlISB") else c


def contexts(text: str, of: re.Pattern[str]) -> Iterator[tuple[int, str, str, str]]:
    """(place, before, character, after) of each character that could be a misreading (or the reading of one)."""
    for m in of.finditer(text):
        i = m.start()
        yield i, neighbour(text[i - 1 : i] if i else ""), m[0], neighbour(text[i + 1 : i + 2])


@dataclass
class Corpus:
    """Frequent words and frequent characters in context, with their counts."""

    words: dict[str, int]
    around: dict[str, int]
    least: float
    known: dict[str, str] = field(default_factory=dict)
    alike: dict[str, list[str]] = field(default_factory=dict)  # words by what they are with twins made one

    def __post_init__(self) -> None:
        for w in self.words:
            self.alike.setdefault(w.translate(ONE_TWIN), []).append(w)

    def read_word(self, word: str) -> str:
        """The far more frequent word that this one is a misreading of, or the word itself."""
        if len(word) < 3 or not any(c.islower() for c in word) and "-" not in word:
            return word
        if word in self.known:
            return self.known[word]
        if len(self.known) > 200_000:
            self.known.clear()
        have, new = self.words.get(word, 0), word
        fit = max(self.least, 10 * max(1, have))
        found: list[tuple[int, int, str]] = []
        for o in self.alike.get(word.translate(ONE_TWIN), ()):
            changed = [(c, t) for c, t in zip(word, o, strict=True) if c != t]
            if 1 <= len(changed) <= 3 and self.words[o] >= fit and any(c.isalpha() for c in o) and all(t in LETTER_TWINS.get(c, "") for c, t in changed):
                found.append((-len(changed), self.words[o], o))
        if found:
            new = max(found)[2]
        self.known[word] = new
        return new

    def read_character(self, a: str, c: str, b: str) -> str:
        twin = CONFUSED[c]
        if c in "エカロニ":
            return twin if re.match(f"[{HAN}]", a or "x") or re.match(f"[{HAN}]", b or "x") else c
        have, other = self.around.get(a + c + b, 0), self.around.get(a + twin + b, 0)
        if other >= self.least and other >= 4 * max(1, have):
            return twin
        for key, rival in ((f"{a}{c}", f"{a}{twin}"), (f"{c}{b}", f"{twin}{b}")):  # one neighbour may be misread too
            if len(key) == 2 and have == 0 and self.around.get("2" + key, 0) <= self.least / 4 and self.around.get("2" + rival, 0) >= 40 * max(self.least / 4, self.around.get("2" + key, 0)):
                return twin
        return c


def reread(text: str, corpus: Corpus) -> str:
    """Misread characters put right. Works on the characters as they are; forms are looked through only for words."""
    text = MISREAD_NUMBER.sub(lambda m: m[0].translate(DIGIT_TWIN), text)
    text = WORD.sub(lambda m: corpus.read_word(m[0]), text)
    out, at = [], 0
    for i, a, c, b in contexts(text, CONTEXT):
        new = corpus.read_character(a, c, b)
        if new != c:
            out += [text[at:i], new]
            at = i + 1
    return "".join(out) + text[at:] if out else text


GAP = re.compile(f"(?<=[{HAN}])[ \t]+(?=[{HAN}])")


def reread_lines(whole: str, corpus: Corpus) -> str:
    """The joined text with misread characters put right and gaps between ideographs closed in its sentences."""
    lines = reread(whole, corpus).split("\n")
    for n, line in enumerate(lines):
        if CLOSED.search(line.strip()) and "|" not in line and not PAGE.fullmatch(line.strip()):
            lines[n] = GAP.sub("", line)
    return "\n".join(lines)


def repaired_number(value: str) -> str:
    """An identity number in whole: gaps, line ends, hyphens at them and page numbers between its parts away, letters read
    for figures put right. Proper ones of any kind stay: 15 or 18 characters, masked, other papers' numbers."""
    parts = [p for p in re.split(r"[\r\n]+", value) if not PAGE.fullmatch(p.strip()) or (len(p.strip()) > 0 and p.strip().isdigit() and "\n" in value)]
    bare = "".join(re.sub(r"[-‐¬­]\s*$", "", p) if n < len(parts) - 1 else p for n, p in enumerate(parts))
    bare = re.sub(r"\s+", "", bare)
    if len(bare) in (15, 18):
        read = bare[:17].translate(DIGIT_TWIN) + (bare[17:] if bare[17:] in "Xx" else bare[17:].translate(DIGIT_TWIN))
        if re.fullmatch(r"\d{15}|\d{17}[\dXx]", read):
            return read
    return bare if re.fullmatch(r"[\dA-Za-z*]+", bare) else value


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text the features of its lines, a number in base 8 for each line."""
    for batch in batches:
        yield pd.DataFrame({"symbols": [[sum(v << 3 * f for f, v in enumerate(o)) for o in observe(t.split("\n"))] for t in batch["text"]]})


def _label_counts(logs: tuple | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for packed in batch["symbols"]:
                symbols = [tuple(int(p) >> 3 * f & 7 for f in range(len(SIZES))) for p in packed]
                labels = suggested(symbols) if logs is None else viterbi(symbols, logs)
                if labels[0] >= 0:
                    c["start", labels[0], 0] += 1
                c.update(("step", a, b) for a, b in zip(labels, labels[1:], strict=False) if a >= 0 and b >= 0)
                for (a, o), n in Counter(zip(labels, symbols, strict=True)).items():
                    if a >= 0:
                        for f, v in enumerate(o):
                            c["emit", a, 8 * f + v] += n
        yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "a", "b", "n"])

    return count


def line_model(texts: DataFrame, text: str, rounds: int = 2) -> Model:
    """The model from all texts: first from the lines that are plain by themselves, then from all lines as the model labels
    them. Its size does not depend on the texts (5 labels, 24 values of features); features are taken once for all rounds."""
    rows = materialize(texts.select(F.col(text).alias("text")).where("text is not null").mapInPandas(_symbols, "symbols array<int>"))
    model = None
    for _ in range(rounds + 1):
        counts = rows.mapInPandas(_label_counts(model.logs() if model else None), "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        model = Model()
        for r in bounded_rows(counts, 10_000, "line labels"):
            model.add(r["kind"], r["a"], r["b"], r["n"])
    return model


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    c: Counter[tuple[int, str]] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "term", "n"])

    for batch in batches:
        for text in batch["text"]:
            whole = plain_form(text)
            c.update((0, w) for w in WORD.findall(whole) if len(w) >= 3)
            for _, a, x, b in contexts(whole, COUNTED):
                c.update(((1, a + x + b), (1, f"2{a}{x}"), (1, f"2{x}{b}")))
        if len(c) > 500_000:
            yield out()
            c.clear()
    yield out()


def corpus_terms(texts: DataFrame, text: str, least: int = 3, most: int = 4_000_000) -> Corpus:
    """Words and characters in context of joined texts that stand at least ``least`` times in all texts, whatever their number. More
    than ``most`` of them are an error, never left out."""
    rows = texts.select(F.col(text).alias("text")).where("text is not null")
    sums = rows.mapInPandas(_term_counts, "kind int, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))
    table = sums.where(F.col("n") >= least).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise SizeBoundExceeded(f"more than {most} frequent terms")
    words, around = {}, {}
    for part in table.to_batches():
        for kind, term, n in zip(*(part[c].to_pylist() for c in ("kind", "term", "n")), strict=True):
            (around if kind else words)[term] = n
    return Corpus(words, around, 4.0)


def repaired_texts(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, repaired, damaged): each record's text in continuous paragraphs.

    Null stays null and empty stays empty, undamaged; repeated records are repaired alike. Texts are handled whole,
    whatever their length.
    """
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared_logs = rows.sparkSession.sparkContext.broadcast(line_model(rows, "text").logs())

    @F.pandas_udf(T.StringType())
    def join(s: pd.Series) -> pd.Series:
        return s.map(lambda t: joined(t, shared_logs.value) if t else t, na_action="ignore")

    rows = materialize(rows.withColumn("whole", join("text")))
    shared = rows.sparkSession.sparkContext.broadcast(corpus_terms(rows, "whole"))

    @F.pandas_udf(T.StringType())
    def repair(s: pd.Series) -> pd.Series:
        return s.map(lambda t: reread_lines(t, shared.value) if t else t, na_action="ignore")

    out = rows.withColumn("repaired", repair("whole"))
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "repaired", F.coalesce(F.col("text") != F.col("repaired"), F.lit(False)).alias("damaged"))


@F.pandas_udf(T.StringType())
def repaired_number_udf(s: pd.Series) -> pd.Series:
    return s.map(repaired_number, na_action="ignore")


def repaired_numbers(records: DataFrame, key: str, values: str) -> DataFrame:
    """(key, value, repaired, damaged): one row a value of the array; null and empty arrays and null values give none."""
    rows = records.select(F.col(key).alias(key), F.explode(values).alias("value")).where("value is not null")
    return rows.withColumn("repaired", repaired_number_udf("value")).withColumn("damaged", F.col("value") != F.col("repaired"))
