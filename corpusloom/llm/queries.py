"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, decontam, htmlmain, langid, lmscore, mixing, neardup, periodic, pii, quality, tokenfile, toxicity, whitening
from .common import WORD, crc_fold, table, word_count

#: Where the public vocabularies lie; a parameter of the token query.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(~toxicity.fold_out(F.col("doc_id"))))
    return toxicity.score(docs, lexicon).select("doc_id", toxicity.fold_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~langid.fold(F.col("doc_id"))))
    return found.select("doc_id", langid.fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_documents(spark, sf_dir, "doc_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(), END_ID)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), shingle=3, threshold_pct=85)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "text")
    plan, more, sizes = mixing.plan_mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.apply_mix(sizes, plan, more)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(_documents(spark, sf_dir, "doc_id", "text"), target).select("doc_id", *lmscore.RESULTS)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlmain.extract(pages).select("page_id", "url", "text", "n_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly", "rule")


def _periodic_tenth(docs: DataFrame) -> DataFrame:
    """The documents, of which about every tenth (crc32 of the id) repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, g = F.greatest(F.size("words"), F.lit(1)), F.floor(h / 10)
    own = docs.withColumn("words", words).withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.size("words") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    repeated = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    return own.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_periodic_tenth(_documents(spark, sf_dir, "doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.short")
    return shown.select(
        "doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    each = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_private_data": op4_private_data,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_source_mix": op7_source_mix,
    "op8_lm_score": op8_lm_score,
    "op9_main_text": op9_main_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

MIX_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
 w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM s),
 l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER (), 0) * w) AS target FROM l),
 q AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS reps FROM t),
 r AS (SELECT *, greatest(0, target - reps * source_size) AS quota FROM q),
 j AS (SELECT d.*, source_size, target, reps, quota FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
 big AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n, quota * sum(size) OVER (PARTITION BY source) / source_size AS most,
  source_size - sum(size) OVER (PARTITION BY source ORDER BY h, doc_id) AS later FROM j WHERE size * 100 > source_size),
 f AS (SELECT source, doc_id, n, size <= most OR quota > later AND size - quota < quota - later AS took, CASE WHEN size <= most OR quota > later AND size - quota < quota - later THEN size ELSE 0 END AS used FROM big WHERE n = 1 UNION ALL
  SELECT source, doc_id, n, took, CASE WHEN took THEN used + size ELSE used END FROM (SELECT b.source, b.doc_id, b.n, b.size, f.used,
   f.used + b.size <= b.most OR quota > f.used + later AND f.used + b.size - quota < quota - (f.used + later) AS took FROM f JOIN big b ON b.source IS NOT DISTINCT FROM f.source AND b.n = f.n + 1)),
 u AS (SELECT r.source, r.quota - coalesce((SELECT max(used) FROM f WHERE f.source IS NOT DISTINCT FROM r.source), 0) AS rest FROM r),
 m AS (SELECT *, h >> 16 AS b FROM j WHERE size * 100 <= source_size),
 c AS (SELECT source, b, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY b) AS cum FROM m GROUP BY source, b),
 e AS (SELECT u.source, u.rest, min(c.b) AS b0, min(c.cum - c.own) AS below FROM u LEFT JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cum > u.rest GROUP BY u.source, u.rest),
 x AS (SELECT m.doc_id, m.b < coalesce(e.b0, 65536) OR m.b = e.b0 AND sum(m.size) OVER (PARTITION BY m.source, m.b ORDER BY m.h, m.doc_id) - m.size / 2.0 <= e.rest - e.below AS took FROM m JOIN e ON m.source IS NOT DISTINCT FROM e.source
  UNION ALL SELECT doc_id, took FROM f)
 SELECT j.doc_id, j.size, j.source_size, j.target, CASE WHEN j.size > 0 THEN j.size * (j.reps + CASE WHEN x.took THEN 1 ELSE 0 END) ELSE 0 END AS taken FROM j LEFT JOIN x ON j.doc_id = x.doc_id"""

#: The others have no SQL: tests hold them against brute-force versions or held-out labels.
SQL: dict[str, str] = {"op7_source_mix": MIX_SQL}
