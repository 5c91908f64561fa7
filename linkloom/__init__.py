"""Linked-document publishing on Spark: crawl, publish and keep in step.

Three pipelines, each a function from DataFrames to a DataFrame:

* ``discover`` — seed URLs to an inventory, following the document link graph;
* ``convert`` — inventory and texts to a cross-linked Markdown tree;
* ``sync`` — existing Markdown files and fresh metadata to updated files.
"""

from linkloom.plans.convert import convert
from linkloom.plans.discover import discover
from linkloom.plans.sync import sync

__all__ = ["convert", "discover", "sync"]
