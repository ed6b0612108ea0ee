"""Problem 6: bring text that looks the same to the same characters.

Method: script-aware repair. Single characters are first brought to one form by rule (styled, full-width and
half-width forms, compatibility ideographs and radicals, composed accents, invisible characters, kinds of blank and
hyphen). Then the scripts of the letters of each whole token decide. In a token of two or three scripts (Latin, Cyrillic,
Greek) the letters that look like letters of its dominant script, or else of the record's, are replaced if the result is
of that one script and a word of the corpus vocabulary. Two kinds of token need more than that and are treated so:

* A token wholly of a script that is not the record's (nothing in it is mixed by itself) counts as mixed only where the
  record uses that script in no other way: no letter of it in the record is without a look-alike, and other letters are
  in the majority. It still must read as a word of the vocabulary in the record's script. So names and abbreviations of
  a text in Cyrillic or Greek stay, and so does a single foreign abbreviation that is no word of the corpus.
* A serial number (with a digit, or mixed and of capitals only) is in no vocabulary, being a word of its own; it is
  accepted by its shape, towards the record's script, under the same conditions.

Nothing is folded that can be told apart in print: case, digit grouping, circled or raised numbers stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.session import materialize

# Letters that look like a Latin letter, and kana that look like an ideograph.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗасеоруѕіјхԛԝһ", "ABESIJKMHOPCTYX3aceopysijxqwh", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲ", "ABEZHIKMNOPTYXovic", strict=True))
KANA = dict(zip("エカロニハタトチミ", "工力口二八夕卜千彡", strict=True))
LATIN_TWIN = CYRILLIC | GREEK
KEPT_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"}

LATIN, CYRILLIC_SCRIPT, GREEK_SCRIPT = "L", "C", "G"
INTO = {LATIN: {}, CYRILLIC_SCRIPT: {v: k for k, v in CYRILLIC.items()}, GREEK_SCRIPT: {v: k for k, v in GREEK.items()}}  # from a Latin letter
TOKEN = re.compile("[A-Za-z0-9À-ɏͰ-ԯ]+")
FOREIGN = re.compile("[Ͱ-ԯ]")
HAN = "㐀-䶿一-鿿"
KANA_SUSPECT = re.compile(f"(?<=[{HAN}])[{''.join(KANA)}](?![぀-ヿ])|(?<![぀-ヿ])[{''.join(KANA)}](?=[{HAN}])")
KANA_WORD = re.compile(f"(?=([{HAN}][{''.join(KANA.values())}]|[{''.join(KANA.values())}][{HAN}]))")


@lru_cache(1)
def one_form() -> dict[int, str]:
    """Code point -> replacement, by rule from the character database."""
    table: dict[int, str] = {}
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" or ch in "͏ᅟᅠㅤﾠ" or 0xFE00 <= cp <= 0xFE0F or cp >= 0xE0100:
            table[cp] = ""
        elif kind == "Zs":
            table[cp] = " "
        elif ch in "‐‑":
            table[cp] = "-"
        elif parts := unicodedata.decomposition(ch):
            tag = parts.split(" ", 1)[0]
            if not tag.startswith("<"):
                new = unicodedata.normalize("NFC", ch)
            elif tag in KEPT_TAGS and not (0x2474 <= cp <= 0x24B5 or 0x3200 <= cp <= 0x32FF) and kind != "No":
                new = unicodedata.normalize("NFKC", ch)
                if new[:1] == " ":  # a spacing accent is not a blank
                    new = ch
            else:
                new = ch
            if new != ch:
                table[cp] = new
    return table


def plain_form(text: str) -> str:
    if text.isascii():
        return text
    text = text.translate(one_form())
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def script(c: str) -> str:
    """Of a letter: Latin, Cyrillic or Greek; nothing of other characters."""
    cp = ord(c)
    return LATIN if cp < 0x250 and c.isalpha() else GREEK_SCRIPT if 0x370 <= cp < 0x400 and c.isalpha() else CYRILLIC_SCRIPT if 0x400 <= cp < 0x530 and c.isalpha() else ""


def reading(token: str, target: str) -> str | None:
    """The token with look-alikes of other scripts in letters of ``target``; None if a letter of another script is left."""
    out = []
    for c in token:
        own = script(c)
        if own and own != target:
            latin = c if own == LATIN else LATIN_TWIN.get(c)
            c = latin if target == LATIN else INTO[target].get(latin, None)
            if not c:
                return None
        out.append(c)
    return "".join(out)


def has_digit(token: str) -> bool:
    return any(c.isdigit() for c in token)


@dataclass(frozen=True)
class Scripts:
    """Of a record: the script most of its letters are in, and the scripts that stand only in look-alikes."""

    main: str
    borrowed: frozenset[str]

    @classmethod
    def of(cls, text: str) -> Scripts:
        count: Counter[str] = Counter()
        genuine = set()
        for c, n in Counter(text).items():
            s = script(c)
            count[s] += n if s else 0
            if s in (CYRILLIC_SCRIPT, GREEK_SCRIPT) and c not in LATIN_TWIN:
                genuine.add(s)
        known = {s: n for s, n in count.items() if s}
        trusted = {s: n for s, n in known.items() if s == LATIN or s in genuine}
        main = max(trusted, key=lambda s: (trusted[s], s == LATIN)) if trusted else LATIN
        return cls(main, frozenset(s for s in (CYRILLIC_SCRIPT, GREEK_SCRIPT) if s != main and s not in genuine))


def options(token: str, scripts: Scripts) -> tuple[list[str], str | None]:
    """(readings that count if the vocabulary has them, in order; the reading that counts by its shape)."""
    count = Counter(s for c in token if (s := script(c)))
    if len(count) > 1:
        dominant = max(count, key=lambda s: (count[s], s == scripts.main))
        targets = dict.fromkeys((dominant, scripts.main))
        serial = has_digit(token) or (len(token) > 1 and token.isupper())
    elif count and next(iter(count)) in scripts.borrowed:
        targets = dict.fromkeys((scripts.main,))
        serial = has_digit(token)
    else:
        return [], None
    read = [r for t in targets if (r := reading(token, t)) is not None and r != token]
    by_shape = reading(token, scripts.main) if serial else None
    return ([] if by_shape else read), by_shape


@F.pandas_udf(T.StringType())
def plain_form_udf(s: pd.Series) -> pd.Series:
    return s.map(plain_form, na_action="ignore")


def _contexts(text: str, at: int, twin: str) -> list[str]:
    return ([text[at - 1] + twin] if at else []) + ([twin + text[at + 1]] if at + 1 < len(text) else [])


def _readings(text: str) -> set[str]:
    """What the vocabulary must be asked for to repair a text in plain form."""
    found: set[str] = set()
    if FOREIGN.search(text):
        scripts = Scripts.of(text)
        for token in set(TOKEN.findall(text)):
            if FOREIGN.search(token):
                found.update(options(token, scripts)[0])
    for m in KANA_SUSPECT.finditer(text):
        found.update(_contexts(text, m.start(), KANA[m[0]]))
    return found


def _wanted(text: str) -> set[str]:
    return _readings(text) if not text.isascii() else set()


def _words(text: str) -> set[str]:
    """The words of a text in plain form that are of one script, which the text does not only borrow, and no serial
    numbers; and ideographs side by side."""
    words = {w for w in TOKEN.findall(text) if not has_digit(w)}
    if text.isascii():
        return words
    if FOREIGN.search(text):
        borrowed = Scripts.of(text).borrowed
        words = {w for w in words if w.isascii() or len(s := {x for c in w if (x := script(c))}) == 1 and not s & borrowed}
    return words | set(KANA_WORD.findall(text))


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(asked, reading): the readings that suspect tokens of the texts would have, and the words of the texts."""
    done: tuple[set[str], set[str]] = (set(), set())
    for batch in batches:
        new: tuple[set[str], set[str]] = (set(), set())
        for t in batch["t"].dropna():
            plain = plain_form(t)
            new[0].update(_words(plain))
            new[1].update(_wanted(plain))
        rows = []
        for asked, (known, fresh) in enumerate(zip(done, new, strict=True)):
            fresh -= known
            if len(known) < 200_000:  # only spares repeats within a task; distinct() follows
                known |= fresh
            rows += [(bool(asked), r) for r in sorted(fresh)]
        yield pd.DataFrame({"asked": pd.Series([r[0] for r in rows], dtype="bool"), "reading": pd.Series([r[1] for r in rows], dtype="object")})


def _repair(text: str, known: set[str] | frozenset[str]) -> str:
    """A text in plain form with the look-alikes of its tokens put right; ``known`` are the readings the corpus has."""

    def kana(m: re.Match) -> str:
        return KANA[m[0]] if any(c in known for c in _contexts(text, m.start(), KANA[m[0]])) else m[0]

    out = KANA_SUSPECT.sub(kana, text)
    if not FOREIGN.search(out):
        return out
    scripts = Scripts.of(text)

    def token(m: re.Match) -> str:
        if not FOREIGN.search(m[0]):
            return m[0]
        readings, by_shape = options(m[0], scripts)
        return by_shape or next((r for r in readings if r in known), m[0])

    return TOKEN.sub(token, out)


def uniform_text(records: DataFrame, key: list[str], text: str, out: str = "uniform", most_known: int = 500_000) -> DataFrame:
    """(key..., text, out): each record's text in its one consistent form.

    Repeated rows stay repeated. Null stays null and empty stays empty. The vocabulary is every word of all records; it is
    never collected: only the readings that some suspect token would have are looked up in it. Those the corpus has are
    sent to the executors if they are at most ``most_known``; more come back to their records by a join on the key. Texts
    are never shuffled in the first case and not written anywhere in either; their plain form is derived where it is read.
    """
    texts = records.select(F.col(text).alias("t")).where("t is not null")
    found = texts.mapInPandas(_vocabulary, "asked boolean, reading string")
    known = materialize(found.groupBy("reading").agg(F.max("asked").alias("asked"), F.min("asked").alias("only_asked")).where("asked and not only_asked").select("reading"))
    rows = known.limit(most_known + 1).collect()
    if len(rows) <= most_known:
        shared = records.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in rows))

        @F.pandas_udf(T.StringType())
        def repair(s: pd.Series) -> pd.Series:
            return s.map(lambda t: t if t.isascii() else _repair(plain_form(t), shared.value), na_action="ignore")

        return records.select(*key, text, repair(F.col(text)).alias(out))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def readings(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(_wanted(plain_form(t))) if t is not None else [])

    @F.pandas_udf(T.StringType())
    def repair_by(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or t.isascii() else _repair(plain_form(t), frozenset(x) if x is not None else frozenset()) for t, x in zip(s, k, strict=True)])

    asks = records.select(*key, F.explode(readings(F.col(text))).alias("reading")).distinct()
    answers = asks.join(known, "reading").groupBy(*key).agg(F.collect_set("reading").alias("_known"))
    return records.select(*key, text).join(answers, key, "left").select(*key, text, repair_by(F.col(text), F.col("_known")).alias(out))


def digest(c: Column) -> Column:
    """128 bits of a text."""
    return F.substring(F.unhex(F.sha2(c.cast("binary"), 256)), 1, 16)


def equal_looking_pairs(uniform: DataFrame, src: str, rec_id: str, text: str, form: str = "uniform") -> DataFrame:
    """(src, id1, id2), id1 < id2: records of one source that differ in code points but not in form.

    Null and (after the repair) empty fields look like nothing and pair with nothing. Records with the very same
    value form one class and are not paired with each other. Classes, not records, are paired first, so a value that a
    third of all rows share costs its own rows times the rows of its variants, which is the result itself.
    """
    rows = uniform.where(F.length(form) > 0).select(F.col(src).alias("src"), F.col(rec_id).alias("id"), digest(F.col(form)).alias("f"), digest(F.col(text)).alias("v"))
    rows = materialize(rows.distinct())
    classes = rows.groupBy("src", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("src", "f").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    kept = materialize(classes.join(several, ["src", "f"], "left_semi").select("src", "f", "v"))
    variants = kept.join(kept.withColumnRenamed("v", "w"), ["src", "f"]).where("v < w")
    one = rows.join(variants, ["src", "f", "v"]).select("src", "f", "w", F.col("id").alias("i"))
    both = one.join(rows.select("src", "f", F.col("v").alias("w"), F.col("id").alias("j")), ["src", "f", "w"])
    return both.select("src", F.least("i", "j").alias("id1"), F.greatest("i", "j").alias("id2")).where("id1 < id2").distinct()


def look_classes(uniform: DataFrame, src: str, rec_id: str, text: str, form: str = "uniform") -> DataFrame:
    """(src, id, class_id, n_records, n_values): each record that looks like another one with other characters, with its
    class, named by its smallest id; the number of records and of different values in the class. One row a record."""
    rows = uniform.where(F.length(form) > 0).select(F.col(src).alias("src"), F.col(rec_id).alias("id"), digest(F.col(form)).alias("f"), digest(F.col(text)).alias("v")).distinct()
    rows = materialize(rows)
    partial = rows.groupBy("src", "f", "v").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    classes = partial.groupBy("src", "f").agg(F.min("m").alias("class_id"), F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    return rows.join(classes, ["src", "f"]).select("src", "id", "class_id", "n_records", "n_values")
