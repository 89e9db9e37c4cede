"""Lexical similarity of two texts, from profiles that are built once a text."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import repeat
from operator import mul

from attestor.functions.lexicon import STOP, SUFFIXES, SYNONYMS

#: Leaves a-z and 0-9 in lower-cased text; bytes of all other letters part words as marks do.
_KEPT = bytes(i if i in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for i in range(256))
_SPACE = re.compile(r"\s+")
GRAM = 4


def stem(word: str) -> str:
    if not word.endswith(SUFFIXES):
        return word
    if len(word) > 5 and word.endswith("ies"):
        return word[:-3] + "y"
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 3), word)


def term_of(word: str) -> str | None:
    """The word's term: its stem, or the first word of the group that has it; None for what doesn't count."""
    term = stem(word)
    return SYNONYMS.get(term, term) if len(term) > 1 and term not in STOP else None


_term = lru_cache(1 << 16)(term_of)


def terms(text: str) -> list[str]:
    return [t for t in map(_term, words(text)) if t]


def words(text: str) -> list[str]:
    """What terms are made of, each by itself."""
    return text.lower().encode("utf-8", "replace").translate(_KEPT).decode("ascii").split()


def plain(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def _length(bag: Counter) -> float:
    return math.sqrt(sum(map(mul, bag.values(), bag.values())))


class Profile:
    """A text's terms as a bag, its long terms, and its runs of GRAM characters as a bag."""

    __slots__ = ("bag", "bag_length", "grams", "grams_length", "long", "order")

    def __init__(self, text: str, flat: str | None = None) -> None:
        self.order = terms(text)
        self.bag = Counter(self.order)
        self.long = [t for t in self.order if len(t) > 2]
        flat = plain(text) if flat is None else flat
        self.grams = Counter([flat[i : i + GRAM] for i in range(max(1, len(flat) - GRAM + 1))] if flat else ())
        self.bag_length, self.grams_length = _length(self.bag), _length(self.grams)


profile = lru_cache(1 << 12)(Profile)


def angle(a: Counter, la: float, b: Counter, lb: float) -> float:
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return min(1.0, sum(map(mul, a.values(), map(b.get, a, repeat(0)))) / (la * lb))


def share_of_terms(asked: Profile, text: Profile) -> float:
    """How many of the asked text's long terms, repeats counted, the text has."""
    return sum(map(text.bag.__contains__, asked.long)) / len(asked.long) if asked.long else 0.0


@lru_cache(1 << 10)
def similarity(asked: Profile, text: Profile) -> float:
    """0.48 angle of terms, 0.18 overlap of terms, 0.20 angle of character runs, 0.14 share of terms. Not symmetric."""
    both = len(asked.bag.keys() & text.bag.keys())
    either = len(asked.bag) + len(text.bag) - both
    overlap = both / either if asked.bag and text.bag else 0.0
    total = 0.48 * angle(asked.bag, asked.bag_length, text.bag, text.bag_length) + 0.18 * overlap
    total += 0.20 * angle(asked.grams, asked.grams_length, text.grams, text.grams_length) + 0.14 * share_of_terms(asked, text)
    return max(0.0, min(1.0, total))


def best_similarity(asked: list[Profile], text: Profile) -> float:
    """Of several texts the closest; 0 where there is none."""
    return max((similarity(a, text) for a in asked), default=0.0)
