"""Letters and digits as the tokenizer libraries know them.

The libraries' patterns use the letters (L) and numbers (N) of Unicode 16, and their lower case is that of Unicode 17. The installed `regex` knows later versions, so a
pattern meant for the libraries must leave out what came later. The tests compare every code point with the libraries, so a
change of version on either side is seen.
"""

from __future__ import annotations

import regex

# Letters and numbers of Unicode versions after 16, as ranges of code points.
LATER_LETTERS = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 "
    "AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capitals that came with Unicode 16 and 17 and their small letters; ranges and how far their small letters are.
LATER_CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B"
LATER_ALPHABETS = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))

_SMALL = {int(a, 16): int(b, 16) for a, b in (x.split(":") for x in LATER_CAPITALS.split())} | {c: c + far for first, last, far in LATER_ALPHABETS for c in range(first, last + 1)}
_capital = regex.compile("[" + "".join(map(chr, _SMALL)) + "]").search


def lowered(text: str) -> str:
    """Lower case as the libraries know it; Python's own tables are older."""
    out = text.lower()
    return out.translate(_SMALL) if _capital(out) else out


def _class(ranges: str) -> str:
    return "".join("\\U" + "-\\U".join(x.rjust(8, "0") for x in r.split("-")) for r in ranges.split())


_LATER = _class(LATER_LETTERS + " " + LATER_NUMBERS)
#: Finds a character that is a letter or number only for the installed `regex`.
later = regex.compile(f"[{_LATER}]").search


def plain(pattern: str) -> str:
    """The libraries' pattern, with their white space, for texts without later letters and numbers."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def exact(pattern: str) -> str:
    """The same for all texts: slower, with the later ones taken for neither letters nor numbers."""
    letter, number = rf"(?:(?![{_class(LATER_LETTERS)}])\p{{L}})", rf"(?:(?![{_class(LATER_NUMBERS)}])\p{{N}})"
    other = r"[^\p{White_Space}\p{L}\p{N}]"
    out = plain(pattern).replace(other, "\0").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    return out.replace(r"\p{L}", letter).replace(r"\p{N}", number).replace("\0", f"(?:[{_LATER}]|{other})")


class Finder:
    """All matches of a library's pattern in a text."""

    def __init__(self, pattern: str):
        self.plain, self.exact = regex.compile(plain(pattern)).findall, regex.compile(exact(pattern)).findall

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not later(text) else self.exact(text)
