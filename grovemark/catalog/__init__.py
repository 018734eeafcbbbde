"""Queries over the given tables, each with the SQL that states the same result where SQL can."""

from grovemark.catalog import clusters, labels, records, texts, trees
from grovemark.catalog.registry import Entry

ENTRIES: dict[str, Entry] = {}
for _module in (texts, labels, trees, clusters, records):
    ENTRIES.update(_module.ENTRIES)
