"""Text functions that stay in the JVM: white space, lines, and the search tokenizer.

The tokenizer lowers case, takes the marks off letters that decompose into an ASCII letter and
marks, and splits at everything but letters, numbers and private-use characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}\p{Co}]+"
#: White space as the trim functions of the index see it.
SPACE = r"[\t\n\x0B\f\r \x85\xA0\p{Z}]"
NO_SPACE = SPACE.replace("[", "[^")


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters without, from their decompositions."""
    plain, bare = [], []
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and c == c.lower():
            plain.append(c)
            bare.append(base[0].lower())
    return "".join(plain), "".join(bare)


def folded(text: Column) -> Column:
    """Lower case without marks; texts of ASCII letters skip the character table."""
    lower = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), lower).otherwise(F.translate(lower, *fold_tables()))


def tokens(text: Column) -> Column:
    """The search terms of a text, in order.  Of ASCII texts the letters and numbers are named, which is
    cheaper than asking for the category of each character."""
    plain = F.when(F.octet_length(text) == F.char_length(text), F.split(F.lower(text), "[^a-z0-9]+")).otherwise(F.split(folded(text), SPLIT))
    return F.array_remove(plain, "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NO_SPACE)


# -- the same in Python, for parsing queries and for snippets -----------------------------

_FOLD = str.maketrans(*fold_tables())


def is_token_char(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


def spans(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of each token of a text, by code points."""
    out, start = [], -1
    for i, c in enumerate(text):
        if is_token_char(c):
            if start < 0:
                start = i
        elif start >= 0:
            out.append((text[start:i].lower().translate(_FOLD), start, i))
            start = -1
    if start >= 0:
        out.append((text[start:].lower().translate(_FOLD), start, len(text)))
    return out


def terms_of(text: str) -> list[str]:
    return [t for t, _, _ in spans(text)]


def trim(text: str) -> str:
    return re.sub(r"^\s+|\s+$", "", text)
