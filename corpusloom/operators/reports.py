"""Reports on crawls, inventories, metadata, conversions and transfers: small tables from large ones by one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crawl_report(pages: DataFrame) -> DataFrame:
    """visited, failed, remaining and the end of a crawl's pages (status, at)."""
    n = lambda status: F.count_if(F.col("status") == status)
    return pages.agg(n("visited").alias("visited"), n("failed").alias("failed"), n("queued").alias("remaining"), F.max("at").alias("ended"))


def inventory_totals(files: DataFrame) -> DataFrame:
    """files, dirs (all folders above a file), bytes, errors (no size) and the largest file of files (path, size)."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    dirs = files.select(F.explode(above).alias("dir")).agg(F.count_distinct("dir").alias("dirs"))
    largest = F.min_by("path", F.when(F.col("size").isNotNull(), F.struct(-F.col("size"), F.col("path"))))
    per = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("size").isNull()).alias("errors"), largest.alias("largest"))
    return per.join(dirs)


def key_frequency(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """key, n, pct: how many of the rows have a key in their map; a null map has none."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    per = rows.select(F.explode(F.map_keys(metadata)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.join(total).select("key", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))


def missing_samples(rows: DataFrame, fields: list[str], id_: str = "node_id", samples: int = 5) -> DataFrame:
    """field, missing, samples (first ids) of fields that are null or empty."""
    absent = F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias("absent")) for f in fields])
    each = rows.select(F.col(id_).alias("id"), F.explode(absent).alias("x")).where("x.absent").select("id", "x.field")
    first = F.row_number().over(Window.partitionBy("field").orderBy("id"))
    few = each.withColumn("r", first).where(F.col("r") <= samples).groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("missing")).join(few, "field")


def backfill_report(rows: DataFrame) -> DataFrame:
    """outcome, nodes, files of backfilled nodes (file_name, outcome)."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_name").alias("files"))


def unfixable_files(rows: DataFrame) -> DataFrame:
    """Files (file_name, nodes) that no sidecar gives a URL."""
    return rows.where("outcome = 'unfixable'").groupBy("file_name").agg(F.count(F.lit(1)).alias("nodes"))


def kv_cache_stats(sized: DataFrame, by: str = "dtype") -> DataFrame:
    """<by>, n, least, most, mean of megabytes (mb) of sized models."""
    return sized.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("mb").alias("least"), F.max("mb").alias("most"), F.round(F.avg("mb"), 2).alias("mean"))


def largest_models(sized: DataFrame, k: int = 10) -> DataFrame:
    return sized.orderBy(F.desc("bytes"), "name").limit(k)


def conversion_stats(sources: DataFrame, missing: DataFrame) -> DataFrame:
    """ext, files, converted, missing, pct of sources (path, ext) and those that are missing (path)."""
    lost = missing.select("path", F.lit(1).alias("_lost")).distinct()
    per = sources.join(lost, "path", "left").groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.count("_lost").alias("missing"))
    done = F.col("files") - F.col("missing")
    return per.select("ext", "files", done.alias("converted"), "missing", F.round(done * 100.0 / F.col("files"), 4).alias("pct"))


def conversion_report(found: DataFrame) -> DataFrame:
    """outcome, n, chars of converted files (outcome, markdown)."""
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("markdown")).alias("chars"))


IMAGE_MODES = ("placeholder", "referenced", "embedded")


def images_as(markdown: Column, mode: str) -> Column:
    """Embedded images as a placeholder, as a file's name (its contents' hash) or as they are."""
    pattern = r"!\[([^\]]*)\]\(data:image/([a-z+]+);base64,([A-Za-z0-9+/=]+)\)"
    if mode == "placeholder":
        return F.regexp_replace(markdown, pattern, "<!-- image -->")
    if mode == "referenced":
        found = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(3))
        kinds = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(2))
        names = F.zip_with(found, kinds, lambda data, kind: F.struct(data.alias("data"), F.concat(F.lit("images/"), F.sha2(data, 256), F.lit("."), kind).alias("name")))
        start = F.regexp_replace(markdown, r"\(data:image/[a-z+]+;base64,([A-Za-z0-9+/=]+)\)", "($1)")
        return F.aggregate(names, start, lambda text, x: F.replace(text, F.concat(F.lit("("), x["data"], F.lit(")")), F.concat(F.lit("("), x["name"], F.lit(")"))))
    if mode == "embedded":
        return markdown
    raise ValueError(f"not an image mode: {mode}")


def transfer_plan(folders: DataFrame, seconds: Column | None = None, ok: Column | None = None) -> DataFrame:
    """folders (folder, n, bytes) in order, with running bytes, pct, speed (bytes a second) and eta (seconds at the mean speed so far); those that failed move nothing.

    One row a folder of a depth, so the running sums are over few rows.
    """
    seconds, ok = F.lit(None).cast("double") if seconds is None else seconds, F.lit(True) if ok is None else ok
    upto = Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, 0)
    rows = folders.withColumn("outcome", F.when(ok, "moved").otherwise("failed")).withColumn("_seconds", seconds)
    moved = F.when(F.col("outcome") == "moved", F.col("bytes")).otherwise(0)
    done, time, total = F.sum(moved).over(upto), F.sum("_seconds").over(upto), F.sum("bytes").over(Window.partitionBy())
    rows = rows.withColumns({"running": done, "pct": F.round(done * 100.0 / total, 4), "speed": F.round(F.try_divide(moved.cast("double"), F.col("_seconds")), 4)})
    eta = F.try_divide((total - F.col("running")) * time, F.col("running").cast("double"))
    return rows.withColumn("eta", F.round(eta, 2)).drop("_seconds")


def transfer_outcomes(plan: DataFrame) -> DataFrame:
    """outcome, folders, bytes of a transfer's plan."""
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("folders"), F.sum("bytes").alias("bytes"))


def anchor_rates(found: DataFrame) -> DataFrame:
    """anchor_type, n, pct of located nodes; text_fragment is the success."""
    per = found.groupBy("anchor_type").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))
