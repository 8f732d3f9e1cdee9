"""Event similarity over feature structs (see text.features), as column expressions and, for Arrow batches, over Python sets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import text as tx


def same_event(a: Column, b: Column) -> Column:
    """Whether two texts tell of the same event: token overlap, with compatible numbers."""
    meet = F.arrays_overlap(a["specific"], b["specific"])  # either way needs one; most pairs end here
    numbers = (F.size(a["numbers"]) == 0) | (F.size(b["numbers"]) == 0) | F.arrays_overlap(a["numbers"], b["numbers"])
    shared = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    specific = F.size(F.array_intersect(a["specific"], b["specific"]))
    return F.coalesce(meet & numbers & tells(shared, specific, F.size(a["tokens"]) + F.size(b["tokens"]) - shared), F.lit(False))


def tells(shared: Column, specific: Column, total: Column) -> Column:
    """The overlap of one event, of tokens shared (all, specific) and in total; tokens are sets."""
    share = F.try_divide(shared, total)
    tight = (share >= fixed.JACCARD) & (specific >= fixed.SPECIFIC_MIN)
    loose = (share >= fixed.LOOSE_JACCARD) & (specific >= fixed.LOOSE_SPECIFIC_MIN)
    return tight | loose


def adds_content(new: Column, old: Column, least: int = fixed.NEW_TOKENS_MIN) -> Column:
    """Whether `new` has a number, or at least `least` specific tokens, that `old` doesn't have."""
    return (F.size(F.array_except(new["numbers"], old["numbers"])) > 0) | (F.size(F.array_except(new["specific"], old["specific"])) >= least)


def material_update(is_update: Column, reason: Column, reason_features: Column, old: Column) -> Column:
    """Whether a marked update's reason adds a number, or is long enough and adds specific tokens."""
    r = tx.stripped(F.coalesce(reason, F.lit("")))
    number = F.size(F.array_except(reason_features["numbers"], old["numbers"])) > 0
    tokens = F.size(F.array_except(reason_features["specific"], old["specific"])) >= fixed.NEW_TOKENS_MIN
    return F.coalesce(is_update, F.lit(False)) & (r != "") & (number | ((F.length(r) >= 10) & tokens))


class Sets(NamedTuple):
    """A text's features as sets."""

    numbers: set[str]
    tokens: set[str]
    specific: set[str]

    @classmethod
    def of(cls, text: str | None) -> Sets:
        numbers, tokens = tx.sets_of(tx.fold(text))
        return cls(numbers, tokens, tx.specific_of(tokens))

    def same_event(self, other: Sets) -> bool:
        """As same_event()."""
        a, b = len(self.tokens), len(other.tokens)
        if min(a, b) < fixed.LOOSE_JACCARD * max(a, b) or (self.numbers and other.numbers and self.numbers.isdisjoint(other.numbers)):
            return False
        shared = len(self.tokens & other.tokens)
        share = shared / (a + b - shared) if shared else 0.0
        if share < fixed.LOOSE_JACCARD:
            return False
        specific = len(self.specific & other.specific)
        return (share >= fixed.JACCARD and specific >= fixed.SPECIFIC_MIN) or (share >= fixed.LOOSE_JACCARD and specific >= fixed.LOOSE_SPECIFIC_MIN)

    def adds_to(self, other: Sets, least: int = fixed.NEW_TOKENS_MIN) -> bool:
        """As adds_content(self, other, least)."""
        return not self.numbers <= other.numbers or len(self.specific - other.specific) >= least
