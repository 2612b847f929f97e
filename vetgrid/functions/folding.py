"""One spelling for all texts that a Python pattern of plain letters matches without regard to case."""

from __future__ import annotations

import _sre
import re
from dataclasses import dataclass
from functools import lru_cache
from re import _casefix

_CASED = 0x20000  # no letter from here on has a case
_ONE_WORD = re.compile(r"\\b(\w+)\\b")


@dataclass(frozen=True)
class Spellings:
    table: dict[int, int]  # one form for each set of characters that match each other
    odd: frozenset[str]  # characters that have none
    special: re.Pattern  # finds the characters whose form is not their lower case

    def fold(self, text: str) -> str:
        """``text`` with one form for each set of characters; its length, its lines and its words stay."""
        return text.lower() if text.isascii() or self.special.search(text) is None else text.translate(self.table)

    def word_of(self, pattern: str) -> str | None:
        r"""The folded word of a pattern ``\bword\b``, or null for other patterns.

        Searched without regard to case, such a pattern matches where a run of word characters folds to this word.
        """
        found = _ONE_WORD.fullmatch(pattern)
        if found is None or not (found[1].isascii() or self.odd.isdisjoint(found[1])):
            return None
        return self.fold(found[1])


@lru_cache(1)
def spellings() -> Spellings:
    """How ``re.IGNORECASE`` compares characters: by simple lower cases, some of which it takes as equal (s and long s).

    Sets with characters that are no word characters (iota below) or match in one direction only are left as odd.
    """
    sets: dict[int, list[int]] = {}
    for c in range(_CASED):
        lower = _sre.unicode_tolower(c)
        first = min(lower, *_casefix._EXTRA_CASES.get(lower, (lower,)))
        if first != c:
            sets.setdefault(first, [first]).append(c)
    table, odd = {}, set()
    for first, members in sets.items():
        if all(chr(c).isalnum() and _sre.unicode_iscased(c) for c in members):
            table.update(dict.fromkeys(members[1:], first))
        else:
            odd.update(map(chr, members))
    cased = {*table, *table.values()}
    # The lower case of a capital sigma depends on the letters next to it.
    special = [chr(c) for c in cased if chr(c).lower() != chr(table.get(c, c))] + ["\u03a3"]
    return Spellings(table, frozenset(odd), re.compile("[" + "".join(special) + "]"))
