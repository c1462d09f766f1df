"""Many words in one pass over a text: an Aho-Corasick automaton whose hits are bits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a long; the sign stays free.
BITS = 62

_automata: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once by each worker process."""
    if words not in _automata:
        own = ahocorasick.Automaton()
        for bit, w in enumerate(words):
            own.add_word(w, bit)
        own.make_automaton()
        _automata[words] = own
    return _automata[words]


def found_bits(text: str, words: tuple[str, ...]) -> int:
    """A bit for each word that text has as a substring, overlapping ones too."""
    return sum(1 << bit for bit in {bit for _, bit in automaton(words).iter(text)})


class Lexicon:
    """Words that predicates ask for. Each word is a bit; texts are searched for all of them at once.

    Predicates may ask for words before the hits are computed: hits() holds all
    words known when it is called.
    """

    def __init__(self, words: Sequence[str] = ()):
        self.places: dict[str, int] = {}
        self.add(words)

    def add(self, words: Sequence[str]) -> None:
        for w in words:
            if not w:
                raise ValueError("an empty word is in every text")
            self.places.setdefault(w, len(self.places))

    def masks(self, words: Sequence[str]) -> list[tuple[int, int]]:
        """(place of a long, its bits) of the words."""
        self.add(words)
        out: dict[int, int] = {}
        for w in dict.fromkeys(words):
            at, bit = divmod(self.places[w], BITS)
            out[at] = out.get(at, 0) | 1 << bit
        return sorted(out.items())

    def any_of(self, hits: Column, words: Sequence[str]) -> Column:
        """Whether the text has one of the words; null for a null text."""
        return reduce(Column.__or__, (hits[at].bitwiseAND(F.lit(mask)) != 0 for at, mask in self.masks(words)), F.lit(False))

    def count_of(self, hits: Column, words: Sequence[str]) -> Column:
        """How many of the words the text has; 0 for a null text."""
        return sum((F.coalesce(F.bit_count(hits[at].bitwiseAND(F.lit(mask))), F.lit(0)) for at, mask in self.masks(words)), F.lit(0))

    def hits(self, text: Column) -> Column:
        """The bits of a text, as longs; null for a null text. Equal texts of a batch are searched once."""
        words = tuple(self.places)
        longs = max(1, -(-len(words) // BITS))

        @F.arrow_udf("array<bigint>")
        def search(texts: pa.Array) -> pa.Array:
            each = texts.dictionary_encode()
            rows = []
            for t in each.dictionary.to_pylist():
                found = found_bits(t, words) if words else 0
                rows.append([found >> (BITS * i) & ((1 << BITS) - 1) for i in range(longs)])
            return pa.array(rows, pa.list_(pa.int64())).take(each.indices)

        return search(text)
