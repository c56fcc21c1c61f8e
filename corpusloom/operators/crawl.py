"""Breadth-first expansion of a crawl."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, PAGES, PER_PAGE = 15, 100_000, 50


def breadth_first(links: DataFrame, roots: DataFrame, depth: int = DEPTH, pages: int = PAGES, per_page: int = PER_PAGE) -> DataFrame:
    """url, depth of what links (page, pos, url) reach from roots (url), at most ``per_page`` links of a page.

    One join per level, of the newest pages only; each level's pages are checkpointed, which ends
    their lineage. Stops at the depth, at the number of pages, or when nothing new comes.
    """
    from pyspark.sql import Window

    sc = links.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(folder)
    rank = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    few = links.withColumn("r", rank).where(F.col("r") <= per_page).select("page", "url")
    newest = roots.select("url", F.lit(0).alias("depth")).distinct().checkpoint()
    seen, n = newest, newest.count()
    for level in range(1, depth + 1):
        reached = few.join(newest.select(F.col("url").alias("page")), "page", "left_semi").select("url").distinct()
        newest = reached.join(seen, "url", "left_anti").orderBy("url").limit(max(0, pages - n)).withColumn("depth", F.lit(level)).checkpoint()
        if not (more := newest.count()):
            break
        n += more
        seen = seen.unionByName(newest)
    return seen
