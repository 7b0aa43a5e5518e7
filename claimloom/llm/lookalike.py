"""Visually identical text with different characters (problem 10)."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut
from claimloom.plans.ship import ship
from claimloom.plans.skew import hot_from_counts, salted_join

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
    "ѡ": "w",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o", "Օ": "O",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Latin extensions
    "ɑ": "a", "ɡ": "g",
    # Signs
    "µ": "μ", "‐": "-", "‑": "-",
}

# Ranges of characters that are not shown (default-ignorable code points).
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
JOINER, NON_JOINER = "\u200d", "\u200c"
#: Stand for joiners that are kept; code points that are never characters.
KEPT = {JOINER: "\ufdd0", NON_JOINER: "\ufdd1"}
_BACK = {ord(v): k for k, v in KEPT.items()}


def read_confusables(path: str) -> dict[str, str]:
    """Look-alikes from a file in the format of the Unicode consortium's confusables.txt: ``from ; to ; class``, in hexadecimal code points."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = line.split("#")[0].split(";")
            if len(parts) >= 2:
                a, b = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
                if len(a) == 1 and not (a.isascii() and a.isalnum()):
                    out[a] = b
    return out


def _tables() -> tuple[dict, set, set, re.Pattern]:
    """Translation before decomposition (ignorables, white space, shown forms), the letters that join the next or the one before, and what finds a character to translate."""
    before: dict[int, str | None] = {c: None for a, b in IGNORABLE for c in range(a, b + 1)}
    joins_next, joins_last = set(), set()
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind == "Zs":
            before[c] = " "
        elif kind in ("Zl", "Zp") or c == 0x85:
            before[c] = "\n"
        elif 0xFF01 <= c <= 0xFFEE or 0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F:
            if c not in before:  # full- and half-width forms, Latin ligatures, Roman numerals
                before[c] = unicodedata.normalize("NFKC", chr(c))
        elif 0xFB50 <= c <= 0xFEFC:  # shapes of letters say which of them join
            shape, *letters = unicodedata.decomposition(chr(c)).split() or [""]
            if len(letters) == 1 and shape in ("<initial>", "<medial>", "<final>"):
                (joins_last if shape == "<final>" else joins_next).add(chr(int(letters[0], 16)))
    changed = sorted(c for c, to in before.items() if to != chr(c))
    ends = [(a, b) for a, b in zip([None, *changed], [*changed, None], strict=True) if a is None or b is None or b > a + 1]
    runs = zip([b for _, b in ends[:-1]], [a for a, _ in ends[1:]], strict=True)
    return before, joins_next, joins_last, re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


_TABLES: tuple[dict, set, set, re.Pattern] | None = None


class Letters:
    """Look-alike letters as a translation, and what finds one."""

    def __init__(self, look_alikes: dict[str, str]):
        self.to = {ord(a): b for a, b in look_alikes.items()}
        self.found = re.compile(f"[{re.escape(''.join(sorted(look_alikes)))}]").search


_BUILT_IN = Letters(LOOK_ALIKES)


def look(text: str, letters: Letters = _BUILT_IN) -> str:
    """The text as it looks: one sequence of characters for all that are shown alike.

    Characters that are not shown are removed (but joiners that change what is
    shown: in sequences of symbols, after a virama, and where they make or break a
    join of cursive letters); every kind of space is a plain one; full-width forms
    and ligatures are written out; letters of other scripts are the Latin letters
    they look like (``letters``); accents are composed.  Letter case
    and the numbers of spaces and line breaks stay.
    """
    global _TABLES
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    if _TABLES is None:
        _TABLES = _tables()
    joined = JOINER in text or NON_JOINER in text
    if joined:
        text = _keep_shown_joiners(text)
    plain = (text.translate(_TABLES[0]) if _TABLES[3].search(text) else text).replace("\r\n", "\n")
    if joined:
        plain = plain.translate(_BACK)
    if plain.isascii():
        return plain
    apart = unicodedata.normalize("NFD", plain)
    return unicodedata.normalize("NFC", apart.translate(letters.to) if letters.found(apart) else apart)


def _keep_shown_joiners(text: str) -> str:
    """Joiners that change what is shown as private characters, so that they are not removed."""
    _, joins_next, joins_last, _ = _TABLES
    out = list(text)
    for i, c in enumerate(text):
        if c not in KEPT:
            continue
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        symbols = c == JOINER and after and unicodedata.category(after) == "So" and before and (unicodedata.category(before) in ("So", "Sk") or before == "\ufe0f")
        virama = before and unicodedata.combining(before) == 9
        j = i - 1
        while j > 0 and unicodedata.category(text[j]) == "Mn":  # marks don't end a join
            j -= 1
        left, right = j >= 0 and text[j] in joins_next, after in joins_last or after in joins_next
        if symbols or virama or (left and right if c == NON_JOINER else left != right):
            out[i] = KEPT[c]
    return "".join(out)


def form(text: str, letters: Letters = _BUILT_IN) -> str:
    """The one consistent form: compatibility composition of the look, full case folding, single spaces."""
    return form_of_look(look(text, letters))


def form_of_look(shown: str) -> str:
    if shown.isascii():
        return " ".join(shown.lower().split())
    folded = unicodedata.normalize("NFKC", shown).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def _each(texts: pd.Series, f) -> pd.Series:
    """``f`` of every text, once per distinct value; null stays null."""
    codes, values = pd.factorize(texts)  # null gets -1
    done = [f(v) for v in values]
    return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)


def _letters(confusables: str | None) -> Letters:
    """Look-alike letters: the built-in ones, and those of a file, which is read on the driver."""
    return _BUILT_IN if confusables is None else Letters(LOOK_ALIKES | read_confusables(confusables))


def consistent_form(text: Column, confusables: str | None = None) -> Column:
    """Column of the consistent form of ``text``; null stays null, blank becomes empty."""
    ship(SparkSession.active())
    letters = _letters(confusables)

    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield _each(texts, lambda v: form(v, letters))

    return forms(text)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def keys(text: Column, confusables: str | None = None) -> Column:
    """Digests (128 bits) of a text's consistent form, its look and its characters; null for blank texts."""
    ship(SparkSession.active())
    letters = _letters(confusables)

    @F.pandas_udf("struct<form: binary, look: binary, raw: binary>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            codes, values = pd.factorize(texts)
            rows = []
            for v in values:
                shown = look(v, letters)
                rows.append((_digest(form_of_look(shown)), _digest(shown), _digest(v)) if shown.strip() else (None, None, None))
            rows.append((None, None, None))
            yield pd.DataFrame([rows[c] for c in codes], columns=["form", "look", "raw"])

    return digests.asNondeterministic()(text)  # so that the optimiser doesn't repeat it in a filter


def _mixed(documents: DataFrame, confusables: str | None) -> DataFrame:
    """(doc_id, look, raw) of the documents whose consistent form is also that of a different text; written once."""
    keyed = documents.where("doc_id is not null and text is not null").select("doc_id", keys(F.col("text"), confusables).alias("k")).select("doc_id", "k.form", "k.look", "k.raw").where("raw is not null")
    now = cut(keyed)
    forms = now.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("a"), F.max("raw").alias("b"))
    total = now.count()
    hot = hot_from_counts(forms, ["form"], "n", total)
    return cut(salted_join(now, forms.where("a <> b").select("form"), ["form"], "left_semi", total=total, hot=hot).drop("form"))


def look_classes(documents: DataFrame, *, confusables: str | None = None) -> DataFrame:
    """(doc_id, class_id, n_docs, n_texts): one row per document whose text looks like a different one.

    class_id is the smallest doc_id that looks so, n_docs the number of documents
    and n_texts that of different texts of that look.  Null and blank texts are no
    case; classes are joined back by a salted join.
    """
    mixed = _mixed(documents, confusables)
    texts = mixed.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    classes = texts.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    total = mixed.count()
    hot = hot_from_counts(classes, ["look"], "n_docs", total)
    return salted_join(mixed, classes.where("n_texts > 1"), ["look"], "inner", total=total, hot=hot).select("doc_id", "class_id", "n_docs", "n_texts").distinct()


def look_alikes(documents: DataFrame, *, confusables: str | None = None) -> DataFrame:
    """(doc_a, doc_b): documents whose texts look the same but differ in their characters.

    Texts are brought to one consistent form (compatibility composition, full case
    folding, mapped white space, no default-ignorable characters, look-alike letters
    mapped) and classed by it; only classes with several different texts go on.  In
    them an exact check follows: the look of the texts, in which case and the numbers
    of spaces and line breaks stay, must be the same.  Different texts are paired
    first, one row per text; their documents are joined to these pairs afterwards,
    by salted joins, so copies of one text are never compared with each other.  All
    pairs are asked for here; ``look_classes`` says the same in one row per document.

    Null and blank texts (also such that show nothing) are no case; exact copies are
    no pair of each other, but each pairs with every document of a different text of
    the same look.  doc_a is the smaller.  Empty input gives no rows.  Texts are taken
    whole; only digests are shuffled.  ``confusables`` is a file of further look-alikes
    (``read_confusables``).
    """
    mixed = _mixed(documents, confusables)
    some = mixed.count()
    texts = cut(mixed.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n")))
    one, other = (texts.select("look", F.col("raw").alias(f"raw_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = cut(salted_join(one, other, ["look"], "inner", total=texts.count()).where("raw_a < raw_b").select("raw_a", "raw_b", "n_a", "n_b"))
    a = salted_join(mixed.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("x")), pairs.select("raw_a", "raw_b"), ["raw_a"], "inner", total=some)
    n_rows = pairs.agg(F.coalesce(F.sum("n_a"), F.lit(0))).first()[0]
    hot = hot_from_counts(pairs.groupBy("raw_b").agg(F.sum("n_a").alias("n")), ["raw_b"], "n", n_rows)
    b = salted_join(a, mixed.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("y")), ["raw_b"], "inner", total=n_rows, hot=hot)
    return b.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a < doc_b").distinct()
