"""Scalar cleaning of names and addresses as column expressions: no Python in the hot path."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# The members of Unicode's White_Space property, as a regex class that Java and RE2 read alike.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: A remark in parentheses, the blank before it and the character before that, which stays.
PARENS = r"([^(])\s\([^)]+\)"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): what every character becomes when it is taken apart, loses its accents and is put together again.

    ``from`` begins with the characters that become the one at the same place
    of ``to``; the rest of ``from`` is deleted. ``longer`` holds the few that
    become several characters.
    """
    one, gone, longer = [], [], []
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        if unicodedata.category(c) == "Mn":
            gone.append(c)
            continue
        apart = unicodedata.normalize("NFD", c)
        if apart == c:
            continue
        plain = unicodedata.normalize("NFC", "".join(x for x in apart if unicodedata.category(x) != "Mn"))
        if plain == c:
            continue
        (one if len(plain) == 1 else longer if plain else gone).append(c if not plain else (c, plain))
    return "".join(c for c, _ in one) + "".join(gone), "".join(p for _, p in one), tuple(longer)


def strip_accents(c: Column) -> Column:
    """Without nonspacing marks, letters recomposed. Sequences that would only recompose across characters stay as they are."""
    source, target, longer = accent_table()
    out = F.translate(c, source, target)
    for a, b in longer:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(c)  # most values are plain and need none of it


def lower(c: Column) -> Column:
    """Lower case letter by letter: a final sigma is no special case."""
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def collapse_blanks(c: Column) -> Column:
    """Every run of white space, of any kind, as one ordinary space."""
    return F.regexp_replace(c, BLANK, " ")


def tidy(c: Column, to_lower: bool = True) -> Column:
    """Trimmed, blanks collapsed, lower case unless told otherwise."""
    return F.trim(collapse_blanks(lower(c) if to_lower else c))


def clean(c: Column) -> Column:
    """The form in which names and addresses are compared: no accents, lower case, single blanks; null stays null."""
    return tidy(strip_accents(c))


clean_name = clean
clean_email = clean


def changes_when_cleaned(c: Column) -> Column:
    """Whether lower case or blanks, not accents, make the cleaned value differ: the value counted as not clean."""
    plain = strip_accents(c)
    return tidy(plain) != plain


def remove_parens(c: Column) -> Column:
    """A remark in parentheses after a text is dropped, wherever one stands."""
    return F.regexp_replace(c, PARENS, "$1")


def name_key(name: Column, repo: Column) -> Column:
    """The name itself, or ``{name, repo}`` for a name that counts only within one repository."""
    return F.when(repo == "", name).otherwise(F.concat(F.lit("{"), name, F.lit(", "), repo, F.lit("}")))


def person_label(external_id: Column, name_keys: Column, emails: Column) -> Column:
    """``id:name|name||mail|mail``, sorted; a blank id is spelled out."""
    shown = F.when(external_id == "", "<no external id>").otherwise(external_id)
    return F.concat(shown, F.lit(":"), F.concat_ws("|", F.array_sort(name_keys)), F.lit("||"), F.concat_ws("|", F.array_sort(emails)))


def signature_label(repo: Column, name: Column, email: Column, commit_hash: Column, when: Column) -> Column:
    """``[repo name email hash time]`` with blank parts spelled out."""
    parts = [F.when(c == "", f"<no {what}>").otherwise(c) for what, c in (("repo", repo), ("name", name), ("email", email), ("hash", commit_hash))]
    shown = F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("<no time>"))
    return F.concat(F.lit("["), F.concat_ws(" ", *parts, shown), F.lit("]"))


def unique_sorted(values: Column) -> Column:
    """Distinct elements in byte order."""
    return F.array_sort(F.array_distinct(values))


def is_capitalized(c: Column) -> Column:
    """Whether the first character is an upper-case letter; false for the empty string."""
    return c.rlike(r"^\p{Lu}")


def has_latin_letters(c: Column) -> Column:
    """Whether any of the letters a to z occurs, in either case."""
    return c.rlike("[a-zA-Z]")
