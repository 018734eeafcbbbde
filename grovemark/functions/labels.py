"""Column expressions over class labels and their ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_subtree(number: Column, root: str) -> Column:
    """Whether a dotted tree number is the root or lies below it."""
    return (number == root) | number.startswith(root + ".")


def is_exact_class(ui: Column, target: str) -> Column:
    return (ui == target).cast("int")


def is_class_or_below(ui: Column, ancestors: Column, target: str) -> Column:
    """Whether the class is the target or has it among its ancestors."""
    return (ui == target) | F.coalesce(F.array_contains(ancestors, target), F.lit(False))


def single_label(labels: Column) -> Column:
    """The only label of a list, or null when the list has another length."""
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0)))


def is_eligible(headings: Column, abstract: Column, restricted: Column) -> Column:
    """An article with headings, an abstract and at least one heading of the wanted classes."""
    return headings.isNotNull() & abstract.isNotNull() & F.coalesce(F.size(restricted) > 0, F.lit(False))


def completion_date(completed: Column, revised: Column) -> Column:
    """Date completed, else date revised, each a struct of Year, Month and Day; else null."""

    def as_date(part: Column) -> Column:
        return F.make_date(
            part.getField("Year").cast("int"), part.getField("Month").cast("int"), part.getField("Day").cast("int")
        )

    return F.coalesce(as_date(completed), as_date(revised))
