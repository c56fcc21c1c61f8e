"""Personal data, found by patterns and by what other terms disclose (DataFrame operations only).

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and
non-overlapping per kind. Keys and tokens are protected as well: runs of letters and digits that carry
much information by themselves (length, changes of character class, bits a character), as spans of
kind ``secret``. All of these are entities.

Statistics count distinct texts, so repeated rows change nothing, and whole texts. A term t discloses an
entity e by PMI(e; t) / IC(e), where IC(e) = log(N / df(e)) and PMI(e; t) = log(N * df(e, t) / (df(e) * df(t))):
1 means that the term gives the entity away, 0 that it says nothing. PMI is shrunken, df(e, t) being
lowered by ``SHRINK``, and needs a support of ``SUPPORT`` texts, so words that are merely rare disclose
nothing. Texts that are variants of each other are no independent evidence: an entity is left out if more
than ``FEW`` terms, and more than ``VARIANT`` of the terms that its texts have on average, would disclose it.
Disclosing terms are spans of kind ``term`` wherever they occur, in texts without the entity too, but for
occurrences that overlap other spans. They are removed at ``REMOVE`` and generalised (digits, words)
at ``GENERALISE``.

Entities that occur in exactly the same texts have equal statistics and are counted as one class, so a
text with very many addresses of its own adds one class. Pairs are counted for texts with entities that
recur; the terms of all texts are counted only if they are candidates. Whether a table of terms is
broadcast depends on its size. Positions are running sums of piece and match lengths, so offsets count
code points; overlaps are found by a sweep over each text's sorted spans. Patterns are possessive: very
long runs neither overflow the stack nor take quadratic time.

A null text is empty. Rows that repeat id and text share their result; ids may be null. Empty
tables give empty results. ``sanitised`` changes the text and carries all other columns along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE = KINDS[:4]
SUPPORT, SHRINK = 2, 0.25
FEW, VARIANT = 20, 0.1
REMOVE, GENERALISE = 0.95, 0.8
#: Least length, changes of character class and bits a character of a secret.
KEY_LENGTH, KEY_CHANGES, KEY_BITS = 20, 4, 3.0
#: Terms that are broadcast; larger tables are joined by a shuffle.
FEW_TERMS = 200_000

# The contract's patterns; (?<!..)|\G keeps a failing run from being tried again at each of its characters.
_LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ \-]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9\-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+])[A-Za-z0-9_+]{%d,}+" % KEY_LENGTH,
}
#: What a text must have for a pattern to be tried.
_HINTS = {"email": r"@[A-Za-z0-9\-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ \-]?[0-9][ \-]?[0-9][ \-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_+]{%d}" % KEY_LENGTH}
TERM = r"[\p{L}\p{N}][\p{L}\p{N}_'\-]*+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass; every second digit from the right is doubled."""
    ints = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(ints, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _bits(value: Column) -> Column:
    """Entropy of a value's characters, in bits a character."""
    chars = F.split(value, "")
    n = F.size(chars)

    def plus(acc: Column, c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), plus)


def _secret(value: Column) -> Column:
    changes = F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"))
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (changes >= KEY_CHANGES), _bits(value) >= KEY_BITS).otherwise(False)


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    octets = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(_secret(value))
    )


def _pieces(text: Column, rx: str, kind: str) -> Column:
    """Array of (kind, pos, skipped, value): every match and the length of what precedes it."""
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    zipped = F.slice(F.arrays_zip(F.split(text, rx, -1).alias("piece"), found.alias("value")), 1, F.size(found))
    return F.transform(zipped, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("pos"), F.length(x["piece"]).alias("skipped"), x["value"].alias("value")))


def _placed(rows: DataFrame) -> DataFrame:
    """Start and end from the running sums of what lies between the matches of a text."""
    own = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("skipped") + F.length("value")).over(own).cast("int"))
    return ends.withColumn("start", F.col("end") - F.length("value"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _apart(spans: DataFrame, loose: str) -> DataFrame:
    """The spans without those of kind ``loose`` that overlap another kind's: a sweep over each text in either direction."""
    own = Window.partitionBy("doc_id", "h")
    fixed = F.col("kind") != loose
    reached = F.max(F.when(fixed, F.col("end"))).over(own.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0))
    # a frame that ends at the last row would take quadratic time; sorted the other way round it is a running one
    coming = F.min(F.when(fixed, F.col("start"))).over(own.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("hit", F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False)))
    return marked.where(fixed | ~F.col("hit")).drop("hit")


def _matched(docs: DataFrame) -> DataFrame:
    """doc_id, h, found, terms of the texts that any pattern matches."""
    text = F.coalesce("text", F.lit(""))
    found = F.flatten(F.array_compact(F.array(*[F.when(text.rlike(_HINTS[k]), _pieces(text, PATTERNS[k], k)) for k in PATTERNS])))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), found.alias("found"), text.alias("text")).where(F.size("found") > 0)
    return rows.select("doc_id", "h", "found", _terms(F.col("text")).alias("terms"))


def _entities(matched: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end, value of every base span and secret."""
    rows = matched.select("doc_id", "h", F.explode("found").alias("m")).select("doc_id", "h", "m.*").distinct()
    own = _placed(rows).where(_valid(F.col("kind"), F.col("value"))).select("doc_id", "h", "kind", "start", "end", "value")
    return _apart(own, "secret")


def disclosing_terms(docs: DataFrame, matched: DataFrame, entities: DataFrame) -> DataFrame:
    """term, disclosure of the terms that exceed GENERALISE for any entity; ``docs`` has h and text."""
    held = entities.select("h", F.xxhash64("kind", F.lower("value")).alias("entity")).distinct()
    # entities of exactly the same texts are one class
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("texts")).where(F.col("df_e") >= SUPPORT)
    classed = written(held.join(often.withColumn("class", F.xxhash64("df_e", "texts")), "entity").select("h", "class", "df_e").distinct(), "pii-classes")
    texts = matched.join(classed.select("h").distinct(), "h", "left_semi").select("h", "terms").dropDuplicates(["h"])
    n = F.lit(float(max(1, docs.select("h").distinct().count())))
    pairs = texts.select("h", F.explode("terms").alias("term")).join(classed, "h").groupBy("class", "df_e", "term").agg(F.count(F.lit(1)).alias("df_et"))
    # a term has at least the texts with it among those that a pattern matches: with so many already, few terms can still disclose
    least = matched.dropDuplicates(["h"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("least_t"))
    most = n * (F.col("df_et") - SHRINK) / F.col("df_e") * F.pow(F.col("df_e") / n, F.lit(GENERALISE))
    pairs = pairs.where(F.col("df_et") >= SUPPORT).join(least, "term").where(F.col("least_t") <= most * 1.000001).drop("df_e", "least_t")
    pairs = written(pairs, "pii-pairs")
    asked = written(pairs.select("term").distinct(), "pii-asked")
    words = docs.select("h", F.explode(_terms(F.col("text"))).alias("term"))
    near = F.broadcast(asked) if asked.count() <= FEW_TERMS else asked
    df_term = words.join(near, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    sizes = texts.select("h", F.size("terms").alias("size")).join(classed, "h").groupBy("class", "df_e").agg(F.avg("size").alias("usual"))
    told = pairs.join(df_term, "term").join(sizes, "class")
    pmi = F.log(n * (F.col("df_et") - SHRINK) / (F.col("df_e") * F.col("df_t")))
    told = told.withColumn("disclosure", F.try_divide(pmi, F.log(n / F.col("df_e")))).where(F.col("disclosure") >= GENERALISE)
    told = told.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("class"))).where((F.col("all") <= FEW) | (F.col("all") <= VARIANT * F.col("usual")))
    return told.groupBy("term").agg(F.least(F.lit(1.0), F.max("disclosure")).alias("disclosure"))


def _term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, h, start, end, disclosure of every occurrence of the terms."""
    known = F.broadcast(told) if told.count() <= FEW_TERMS else told
    words = docs.select("h", F.explode(_terms(F.col("text"))).alias("term"))
    hit = written(words.join(known.select("term"), "term", "left_semi").select("h").distinct(), "pii-hit")
    rows = docs.join(hit, "h", "left_semi").distinct().select("doc_id", "h", F.explode(_pieces(F.col("text"), TERM, "term")).alias("m")).select("doc_id", "h", "m.*")
    return _placed(rows).withColumn("term", F.lower("value")).join(known, "term").select("doc_id", "h", "start", "end", "disclosure")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id and h, and the spans: doc_id, h, kind, start, end, disclosure (null but for terms)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    matched = written(_matched(docs), "pii-matched")
    entities = written(_entities(matched), "pii-entities")
    told = written(disclosing_terms(docs, matched, entities), "pii-told")
    terms = _term_spans(docs, told).select("doc_id", "h", F.lit("term").alias("kind"), "start", "end", "disclosure")
    spans = entities.select("doc_id", "h", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure")).unionByName(terms)
    return docs.select("doc_id", "h"), _apart(spans, "term")


def _ordered(only_base: bool = False) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "end", "kind")
    return F.sort_array(F.collect_list(F.when(F.col("kind").isin(*BASE), one) if only_base else one))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secrets, n_terms, n_spans; one row per document row."""
    rows, spans = find(docs)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    per = spans.groupBy("doc_id", "h").agg(*[count(k) for k in KINDS], F.count(F.lit(1)).alias("n_spans"), _listing(_ordered(True)).alias("_base"), _listing(_ordered()).alias("spans"))
    per = per.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    both = rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (rows["h"] == per["_h"]), "left")
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return both.select(
        "doc_id", *[number(f"n_{k}", f"n_{k}") for k in BASE], F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        number("n_secret", "n_secrets"), number("n_term", "n_terms"), number("n_spans", "n_spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with spans replaced in text: <kind> for entities, <removed>, or <word> and <number> for generalised terms."""
    _, spans = find(docs)
    own, per_id, per_h, cuts = fresh(docs, "own", "per_id", "per_h", "cuts")
    text = F.coalesce("text", F.lit(""))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ahead = Window.partitionBy("doc_id", "h").orderBy("start", rank, "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(ahead), F.lit(0)))).where("from < end")
    note = F.when(F.col("kind") != "term", F.concat(F.lit("<"), "kind", F.lit(">"))).when(F.col("disclosure") >= REMOVE, "<removed>")
    per = cut.groupBy(F.col("doc_id").alias(per_id), F.col("h").alias(per_h)).agg(F.sort_array(F.collect_list(F.struct("from", "end", note.alias("note")))).alias(cuts))
    left = docs.withColumn(own, F.xxhash64(text))
    both = left.join(per, left["doc_id"].eqNullSafe(per[per_id]) & (left[own] == per[per_h]), "left")

    def part(c: Column, k: Column) -> Column:
        prior = F.when(k == 0, 0).otherwise(F.element_at(cuts, F.greatest(k, F.lit(1)))["end"])
        value = F.substring(text, c["from"] + 1, c["end"] - c["from"])
        label = F.coalesce(c["note"], F.when(value.rlike("^[0-9]"), "<number>").otherwise("<word>"))
        return F.concat(F.substring(text, prior + 1, c["from"] - prior), label)

    tail = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
    clean = F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(cuts, part), ""), tail)).otherwise(text)
    return both.withColumn("text", clean).drop(own, per_id, per_h, cuts)
