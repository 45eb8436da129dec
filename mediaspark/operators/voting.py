"""Consensus of voters as column expressions: no row ever leaves its task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(label: Column, classes: list[str]) -> Column:
    return F.coalesce(label.isin(classes), F.lit(False))


def _votes(labels: list[Column], of: Column) -> Column:
    """How many of the labels are that one."""
    return reduce(lambda a, b: a + b, [F.when(x == of, 1).otherwise(0) for x in labels])


def four_voters(a: Column, b: Column, c: Column, big: Column, classes: list[str]) -> tuple[Column, Column]:
    """(consensus, majority): three small voters that agree; else with the big one a label of three votes, or of two where no other has two."""
    small = valid(a, classes) & valid(b, classes) & valid(c, classes)
    agree = small & (a == b) & (b == c)
    labels = [a, b, c, big]
    votes = [_votes(labels, x) for x in labels]
    most = F.greatest(*votes)
    pairs = reduce(lambda x, y: x + y, [F.when(v == 2, 1).otherwise(0) for v in votes])  # two for each label of two votes
    top = F.coalesce(*[F.when(v == most, x) for v, x in zip(votes, labels)])
    majority = F.when(agree, a).when(small & valid(big, classes) & ((most >= 3) | (most == 2) & (pairs == 2)), top)
    return F.when(agree, a), majority


def quorum(labels: list[Column], classes: list[str], least: int = 3) -> Column:
    """The valid label of most votes, the first in order among equals, if it has that many.

    The labels are bound once as an array, so the expression stays small however they are made.
    """
    own = F.filter(F.array(*labels), lambda x: x.isin(classes))

    def top(all_: Column) -> Column:
        counts = F.transform(all_, lambda x: F.size(F.filter(all_, lambda y: y == x)))
        most = F.array_max(counts)
        return F.when(most >= least, F.get(all_, (F.array_position(counts, most) - 1).cast("int")))

    return F.get(F.transform(F.array(own), top), F.lit(0))


def disagree(a: Column, b: Column, c: Column, big: Column, classes: list[str]) -> Column:
    """Three valid labels that are not all the same, and no word of the big voter yet."""
    return valid(a, classes) & valid(b, classes) & valid(c, classes) & big.isNull() & ~((a == b) & (b == c))


def invalid_labels(classes: list[str], **labels: Column) -> Column:
    """array of (column, value) with the labels that are set and none of the classes."""
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), v.alias("value")) for k, v in labels.items()])
    return F.filter(pairs, lambda p: p["value"].isNotNull() & ~p["value"].isin(classes))


def tiebreak(first: Column, second: Column, third: Column) -> tuple[Column, Column, Column]:
    """(status, confidence, value) of two answers and a third that settles their disagreement; null answers are equal to null ones."""
    same, with_first, with_second = first.eqNullSafe(second), first.eqNullSafe(third), second.eqNullSafe(third)
    pick = lambda a, b, c, d: F.when(same, a).when(with_first, b).when(with_second, c).otherwise(d)
    return pick("agreed", "tiebreaker_first", "tiebreaker_second", "no_consensus"), pick("high", "medium", "medium", "low"), F.when(same | with_first | ~with_second, first).otherwise(second)


def next_voter(before: list[Column], own: Column, settled: Column) -> Column:
    """Whether a further voter is to be asked: all before it have said something, it hasn't, and nothing is settled."""
    out = own.isNull() & settled.isNull()
    for c in before:
        out = out & c.isNotNull()
    return out
