"""Texts cut where no token can reach across, and a bounded memory of what the pieces gave.

Byte-level vocabularies cut words so that white space other than one leading space stands apart from what follows, and
letters stand apart from punctuation. So no token reaches across: the place before a space or line end that follows a
visible ASCII character or Latin letter; the place between a letter and a common punctuation mark; the place between a
lone line end and a letter. What a tokenizer gives for a text is then what it gives for its pieces, one after another,
and it need see each distinct piece only once while the worker remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

#: Pieces remembered at most (a batch of texts may go beyond), of at most PIECE characters each.
REMEMBERED, PIECE = 400_000, 64

_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = re.compile(rf"(?<=[!-~{_LETTER}])(?=[ \n])|(?<=[{_LETTER}])(?=[,.!?;:])|(?<=[!-~{_LETTER}]\n)(?=[{_LETTER}])")
_UNSAFE = re.compile(rf"[^!-~{_LETTER}] ")


class Memory:
    """values(texts) gives for each text what its pieces gave, put together."""

    def __init__(self, work: Callable[[list[str]], list], together: Callable[[Any], Any]):
        self.work, self.together = work, together
        self.plain: dict[str, Any] = {}  # by piece
        self.spaced: dict[str, Any] = {}  # by what follows a leading space

    def values(self, texts: list[str]) -> list:
        if len(self.plain) + len(self.spaced) > REMEMBERED:
            self.plain.clear()
            self.spaced.clear()
        cuts = []
        for t in texts:
            if t.startswith(" ") or _UNSAFE.search(t):
                cuts.append((_CUT.split(t), ()))
            else:  # every space is such a place
                first, *rest = t.split(" ")
                cuts.append(((first,), rest))
        new = set().union(*[c[0] for c in cuts]).difference(self.plain)
        new_spaced = set().union(*[c[1] for c in cuts]).difference(self.spaced)
        parts = {p: _CUT.split(p) for p in new} | {f" {p}": _CUT.split(f" {p}") for p in new_spaced}
        fine = list({x for ps in parts.values() for x in ps}.difference(self.plain))
        self.plain.update(zip(fine, self.work(fine), strict=True))
        got = {p: self.together([self.plain[x] for x in ps]) for p, ps in parts.items()}
        self.plain.update((p, got[p]) for p in new)
        self.spaced.update((p, got[f" {p}"]) for p in new_spaced)
        plain, spaced, together = self.plain.__getitem__, self.spaced.__getitem__, self.together
        out = [together([*map(plain, a), *map(spaced, b)]) for a, b in cuts]
        for known, added in ((self.plain, new.union(fine)), (self.spaced, new_spaced)):
            for p in added:
                if len(p) > PIECE:
                    del known[p]
        return out
