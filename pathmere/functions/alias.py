"""Transliterated name forms ("aliases").

Latin, Cyrillic and similar letters map one to one (or to a short group) and stay native
expressions. Han characters need a reading table, which the caller supplies as a DataFrame;
see :func:`pathmere.operators.aliases.with_alias_forms`.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathmere.functions.paths import strip

HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
NON_ASCII = r"[^\x{0}-\x{7F}]"

# Letters that become more than one letter, or that have no decomposition.
LETTER_GROUPS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": "'",
}
SINGLE_LETTERS = {
    "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "з": "z", "и": "i",
    "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "ы": "y", "э": "e",
}


def _accented_latin() -> dict[str, str]:
    """Lower-case Latin letters whose canonical decomposition starts with an ASCII letter."""
    found = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii():
            found[letter] = base
    return found


_MAP = {**_accented_latin(), **SINGLE_LETTERS}
TRANSLATE_FROM = "".join(_MAP)
TRANSLATE_TO = "".join(_MAP.values())


def alias_need(s: Column) -> Column:
    """'chinese' when any Han character occurs, 'multilingual' for other non-ASCII, else 'none'."""
    ascii_only = F.octet_length(s) == F.length(s)  # cheaper than a pattern, and most names are
    return F.when(ascii_only, "none").when(s.rlike(HAN), "chinese").when(s.rlike(NON_ASCII), "multilingual").otherwise("none")


def transliterate(s: Column) -> Column:
    """Lower-case ASCII spelling without blanks."""
    out = F.translate(F.lower(s), TRANSLATE_FROM, TRANSLATE_TO)
    for letter, group in LETTER_GROUPS.items():
        out = F.replace(out, F.lit(letter), F.lit(group))
    return F.replace(out, F.lit(" "), F.lit(""))


def latin_reading(name: Column, mode: str = "multilingual") -> Column:
    """Reading of names without Han characters; the name itself when nothing changes."""
    if mode != "multilingual":
        return name
    form = F.when(alias_need(name) == "multilingual", transliterate(name))
    return F.coalesce(F.nullif(form, F.lit("")), name)  # the form is computed once


def search_text(name: Column, reading: Column, initials: Column) -> Column:
    """Aliases to store for a name: forms that differ from the name and from each other."""
    low = F.lower(strip(name))
    first = F.when(reading != low, reading)
    second = F.when((initials != low) & (initials != reading), initials)
    return F.when(alias_need(name) == "none", F.lit("")).otherwise(F.concat_ws(" ", first, second))
