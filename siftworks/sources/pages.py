"""Records from web pages by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def records(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, links) of pages (page_id, url, html)."""
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit(r"<a[ >]")).alias("links"),
    )


def leaves(df: DataFrame, identity: str, json: str) -> DataFrame:
    """(identity, path, value) of every leaf of a JSON column; arrays are leaves, paths are joined by dots.

    Objects are opened level by level until no value opens; an empty object has no leaves.
    """
    kind = "map<string,string>"
    level = df.select(F.col(identity), F.explode(F.from_json(json, kind)).alias("path", "value"))
    done = None
    while True:
        opened = F.when(F.ltrim("value").startswith("{"), F.from_json("value", kind))
        leaf = level.where(opened.isNull() & F.col("value").isNotNull())
        done = leaf if done is None else done.unionByName(leaf)
        deeper = level.where(opened.isNotNull())
        if deeper.isEmpty():
            return done
        inner = deeper.select(identity, F.col("path").alias("_outer"), F.explode(opened).alias("path", "value"))
        level = inner.select(identity, F.concat_ws(".", "_outer", "path").alias("path"), "value")
