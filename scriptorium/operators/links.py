"""The link graph of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.urls import name_of, resolved
from scriptorium.plans.store import counted, materialise, scoped

#: Page names up to this number are broadcast (about 100 bytes each).
NAMES = 200_000


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, target): a row per href, repeats included."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))


@scoped
def resolved_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, dst): a row per href, with the least page_id of those whose url has
    the name of the target, seen from the page it stands on; null where the link dangles.
    Names ignore the case of scheme and host, dot segments and fragments."""
    names = pages.where("url is not null").groupBy(name_of(F.col("url")).alias("name")).agg(F.min("page_id").alias("dst")).where("name is not null")
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))
    named = found.select("page_id", "target", name_of(resolved(F.col("target"), F.col("url"))).alias("name"))
    return named.join(counted(materialise(names, "page-names"), NAMES), "name", "left").select("page_id", "target", "dst")


def backlink_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.count("*").alias("n"))


def orphan_notes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents without an annotation."""
    return documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
