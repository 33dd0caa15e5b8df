"""One consistent form for text that looks the same but holds different characters.

Most text is already in that form. The quick-check properties of Unicode tell
which characters can take part in any change; only the segments around them
are normalised, together with the stable character before (the boundary
context a combining accent needs), and spliced back between the unchanged
stretches. Text of plain printable ASCII with single inner blanks never leaves
the JVM; the rest is normalised once per distinct value.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinfold.session import ship

# Letters of other alphabets that show as one Latin letter, all of them in Unicode's table of confusables (UTS 39).
# Left out are Latin letters themselves (a dotless i shows its missing dot) and small Greek ones of another shape (alpha, iota).
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Һ": "H",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "Օ": "O", "Տ": "S", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n", "զ": "q",
    "ⅼ": "l", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮓ": "Z",
}

# Kinds of compatibility mapping that keep the shown text: width, joined letters, typeface, presentation forms.
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


# Characters outside the format category that show nothing.
_HIDDEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"


@lru_cache(maxsize=1 << 16)
def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in _HIDDEN or "\ufe00" <= c <= "\ufe0f" or 0xE0100 <= ord(c) <= 0xE01EF


def _blank(c: str) -> bool:
    return c.isspace() or unicodedata.category(c)[0] == "Z" or c == "\u2800"


@lru_cache(maxsize=1 << 16)
def _unfold(c: str) -> str:
    """What one character shows, fully decomposed: letters and accents apart, blanks as U+0020, nothing for the invisible."""
    if _invisible(c):
        return ""
    if _blank(c):
        return " "
    mapping = unicodedata.decomposition(c)
    if mapping:
        kind, _, rest = mapping.rpartition("> ") if mapping.startswith("<") else ("", "", mapping)
        if kind and kind + ">" not in _SAME_LOOK:
            return c
        return "".join(_unfold(chr(int(x, 16))) for x in rest.split())
    hangul = unicodedata.normalize("NFD", c)
    if hangul != c:
        return hangul
    return LOOK_ALIKE.get(c, c)


@lru_cache(maxsize=1 << 16)
def _unstable(c: str) -> bool:
    """Whether the character can change or be changed by the one after it: it fails one of the quick checks."""
    return (
        unicodedata.combining(c) != 0 or unicodedata.category(c)[0] == "M" or _invisible(c) or (_blank(c) and c != " ")
        or not unicodedata.is_normalized("NFKC", c) or c in LOOK_ALIKE or 0x1160 <= ord(c) <= 0x11FF
        or unicodedata.normalize("NFC", _unfold(c)) != c
    )


#: A stretch outside printable ASCII with the character before it, or more than one blank; all else is stable.
_STRETCH = re.compile("[ -~]?[^ -~]+|  +")


def _spliced(stretch: re.Match[str]) -> str:
    """The stretch with its unstable segments, each with the stable character before it, in normal form."""
    text = stretch[0]
    out, done, at = [], 0, 0
    while at < len(text):
        if not _unstable(text[at]):
            at += 1
            continue
        begin = max(done, at - 1)
        while at < len(text) and _unstable(text[at]):
            at += 1
        out += [text[done:begin], _normalised(text[begin:at])]
        done = at
    return "".join(out) + text[done:] if out else text


def _normalised(segment: str) -> str:
    while True:  # accents in canonical order before composing; a composed letter may itself be a look-alike's host
        apart = "".join(_unfold(c) for c in unicodedata.normalize("NFD", segment))
        together = unicodedata.normalize("NFC", unicodedata.normalize("NFD", apart))
        if together == segment:
            return together
        segment = together


def canonical(text: str | None) -> str | None:
    """The form in which all texts that show the same are equal; null stays null, text that shows nothing becomes empty.

    Width of characters, the encoding of accents and joined letters, look-alike
    letters of other alphabets, invisible characters, and kind, number and outer
    position of blanks make no difference. Case, accents, punctuation and the
    order of words do.
    """
    if text is None:
        return None
    spliced = _STRETCH.sub(_spliced, text)
    if "  " in spliced:
        spliced = re.sub("  +", " ", spliced)
    return spliced.strip(" ")


#: Java's ``$`` would also match before a final line end.
STABLE = r"^[!-~]+( [!-~]+)*\z"


def canonical_values(df: DataFrame, text_col: str) -> DataFrame:
    """(``value``, ``form``) of every distinct value that is not null."""
    ship(df.sparkSession)
    values = df.select(F.col(text_col).alias("value")).where(F.col("value").isNotNull()).distinct()

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["value"], "form": [canonical(v) for v in pdf["value"]]})

    stable = F.col("value").rlike(STABLE)
    return values.where(stable).select("value", F.col("value").alias("form")).union(
        values.where(~stable).mapInPandas(normalise, "value string, form string")
    )


def same_look_pairs(df: DataFrame, text_col: str) -> DataFrame:
    """(``name_a``, ``name_b``): two different stored values that show the same text, smaller first in code point order.

    Nulls and values that show nothing take no part; repeated rows count once.
    The values of one form are few (ways to write it), whatever the number of
    rows that hold them, since pairs are formed over distinct values.
    """
    forms = canonical_values(df, text_col).where(F.col("form") != "")
    a, b = forms.withColumnRenamed("value", "name_a"), forms.withColumnRenamed("value", "name_b")
    return a.join(b, "form").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
