"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders: a number
has digits or is a number word; a unit is a unit word right behind a number; a name is capitalised.
Names of up to ``MOST_NAMES`` words and numbers of several number words are one token, if only blanks stand
between; a number is parted from the word a hyphen ties to it ('5-year-old').
At the start of a sentence or line a capital says little: there a word is a name unless the benchmark
has it capitalised too and it is common in lower case: in all documents and items together (counted in
Spark) at least ``COMMON`` times a text.

Windows of ``WINDOW`` tokens are read in two ways, as templates and by their own tokens (lower-cased,
letters and digits), and those of documents and benchmark items are joined on their 64-bit hashes.
Within an occurrence of an item in a document, slot values that align in joined windows must map
consistently: one value of the item to one of the document and, but for numbers, back. An occurrence contaminates if
joined windows cover at least ``COVERAGE`` of the item's windows, or ``RUN`` of them, and at least
``CONSISTENT`` of the slots whose values recur agree; so a question with other numbers and names is
caught, and chance matches of bare templates are not. An unbroken run of ``VERBATIM`` equal tokens
contaminates too.

Templates of windows with fewer than ``LITERALS`` literal tokens, and of items with fewer than
``MIN_TOKENS`` tokens, say nothing; such windows match by their own tokens only, so copies of short
items and of windows full of numbers and names match. Coverage is the higher one of template windows
alone and of all windows.

Occurrences are the diagonals (place in the document less place in the item) of joined windows, the
groups of diagonals less than half an item's length apart (insertions move the diagonal), and all of a
document's joined windows of the item together (excerpts far apart). One that passes is enough; a row
gives the figures of the one with the highest coverage, then consistency, then fewest changed values.

Before the join a bit table of the benchmark's window hashes, ``BITS_EACH`` bits a window (at most
2 ** ``MOST_BITS``, beyond which more pass), drops windows of documents that can't match. What passes
is joined in Spark, so the benchmark may be of any size; hashes that very many documents have are
dealt to several tasks. Python works on a batch of texts at a time.

Documents and items are told apart by their texts, never by ids: rows of one text share a decision,
rows that share an id (or have none) are decided each by its own text. Null and empty texts have no
windows; items shorter than a window are one window of their own length, so a copy of even a one-word
item is reported. Results have one row per doc_id and item_id, the best of the texts under these ids;
null ids are reported as null. Empty tables give empty results. Other columns are ignored, and kept
by ``decontaminated`` whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, digest, small_batches, trim, written
from .words import among, lowered, points, run_hashes, table

WINDOW, COVERAGE, RUN, CONSISTENT = 8, 0.5, 24, 0.8
#: How often a text has a common word in lower case, at least.
COMMON = 0.001
#: Capitalised words of the benchmark that are broadcast to count them; of more, all words are counted before the join.
FEW_WORDS = 100_000
BITS_EACH, MOST_BITS = 64, 29
#: Fewest literal tokens in a window, and fewest tokens of an item, whose template can be told from chance.
LITERALS, MIN_TOKENS = 4, 5
#: Tokens of an excerpt that is reported at any coverage.
VERBATIM = 13
#: Longer runs of capitalised words are headings or lists, not a name.
MOST_NAMES = 3
#: Document windows of one hash that a task joins.
HOT = 20_000

# Number words and units (English, German, French, Spanish).
_EN_ONES, _DE_ONES, _FR_ONES, _ES_ONES = (
    x.split() for x in ("one two three four five six seven eight nine", "ein zwei drei vier fünf sechs sieben acht neun", "un deux trois quatre cinq six sept huit neuf", "uno dos tres cuatro cinco seis siete ocho nueve")
)
_EN_TENS, _DE_TENS, _FR_TENS, _ES_TENS = (
    x.split()
    for x in (
        "twenty thirty forty fifty sixty seventy eighty ninety", "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "vingt trente quarante cinquante soixante quatrevingt",
        "treinta cuarenta cincuenta sesenta setenta ochenta noventa",
    )
)
_TEENS = (
    "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "dix onze douze treize quatorze quinze seize dixsept dixhuit dixneuf diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve"
).split()
_SCALES = "hundred thousand million billion hundert tausend cent cents mille quatrevingts cien ciento doscientos trescientos quinientos mil veinte".split()
_NO_NUMBERS = frozenset("un uno ein".split())  # articles and pronouns as well
# Compounds up to 99, by rule, as letters without hyphens.
NUMBER_WORDS = frozenset(
    [*_EN_ONES, *_DE_ONES, *_FR_ONES, *_ES_ONES, *_EN_TENS, *_DE_TENS, *_FR_TENS, *_ES_TENS, *_TEENS, *_SCALES]
    + [t + o for t in _EN_TENS for o in _EN_ONES]
    + [f"{o}und{t}" for t in _DE_TENS for o in _DE_ONES]
    + [t + o for t in _FR_TENS for o in (*_FR_ONES, "etun", "dix", "onze", "etonze", "douze", "treize", "quatorze", "quinze", "seize", "dixsept", "dixhuit", "dixneuf")]
    + [f"veinti{o}" for o in ("uno", "ún", "dós", "trés", "cuatro", "cinco", "séis", "siete", "ocho", "nueve")]
) - _NO_NUMBERS
UNITS = frozenset(
    "km m cm mm kg g mg lb lbs oz l ml mile miles meter meters metre metres inch inches foot feet yard yards gram grams liter liters litre litres pound pounds ounce ounces hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees volt volts watt watts mph kmh stunde stunden tag tage jahr jahre heure heures jour jours an ans hora horas día días año años".split()
)
_GLUED = re.compile(r"(?:km|kg|cm|mm|mg|ml|lbs?|oz|m|g|l|hrs?|min|sec|mph|%)(?!\w)")
_BORDER = "\x02"
_CHUNK = 1 << 18
_SPACE, _WORD, _DIGIT, _LOWER, _QUOTE, _STOP, _BREAK, _GLUE = (1 << k for k in range(8))
_classes: list[np.ndarray] = []
_WEIGHTS = np.array([(k & _DIGIT > 0) + ((k & _LOWER > 0) << 21) for k in range(256)], np.int64)


def _kinds() -> np.ndarray:
    """What a character is, by code point."""
    if not _classes:
        kinds = table(str.isalnum) * np.uint8(_WORD) | table(str.isdigit) * np.uint8(_DIGIT) | table(str.islower) * np.uint8(_LOWER)
        for chars, kind in ((ASCII_SPACE, _SPACE), ("\"')]»”’", _QUOTE), (".!?:…", _STOP), ("\n" + _BORDER, _SPACE | _BREAK), ("kcmlohsg%", _GLUE)):
            kinds[[ord(c) for c in chars]] |= np.uint8(kind)
        _classes.append(kinds)
    return _classes[0]


class Tokens:
    """The tokens that have a word of several texts: template code, own hash, whether a slot; ``text`` tells whose they are."""

    def __init__(self, texts: list[str | None], common: np.ndarray) -> None:
        joined = _BORDER.join(t.replace(_BORDER, " ") if t and _BORDER in t else t or "" for t in texts)
        chars, self.low = points(joined), points(lowered(joined))
        kind = _kinds()[chars]
        space = (kind & _SPACE) > 0
        border = np.flatnonzero(chars == ord(_BORDER))
        # a unit glued to a number is a token of its own
        begins = space.astype(np.int32)
        for k in np.flatnonzero((kind[:-1] & _DIGIT > 0) & (kind[1:] & _GLUE > 0)).tolist():
            begins[k + 1] += _GLUED.match(joined, k + 1) is not None
        # and so is a number that a hyphen ties to a word
        ties = np.flatnonzero(chars[1:-1] == ord("-")) + 1
        begins[ties[(kind[ties - 1] & _DIGIT > 0) & (kind[ties + 1] & (_WORD | _DIGIT) == _WORD)]] += 1
        self.at = at = np.flatnonzero(kind & _WORD)
        token = np.cumsum(begins, dtype=np.int32)[at]
        self.runs = runs = np.flatnonzero(np.diff(token, prepend=-1)) if len(at) else np.empty(0, np.int64)
        start, size = at[runs], np.diff(runs, append=len(at))
        self.own = run_hashes(self.low[at], runs)
        changed = chars != self.low
        # digits, lower-case and upper-case letters of each token, counted at once
        marks = _WEIGHTS[kind[at]] + (changed[at].astype(np.int64) << 42)
        counts = np.add.reduceat(marks, runs) if len(runs) else np.empty(0, np.int64)
        digits, lower, upper = counts & (1 << 21) - 1, counts >> 21 & (1 << 21) - 1, counts >> 42
        capital = changed[start] & (upper == 1) & (lower > 0)
        # sentences end with a line, a text, or a stop that ends a token but for quotes
        stops = np.flatnonzero(kind & _STOP)
        behind = stops + 1
        padded = np.append(kind, np.uint8(_SPACE))
        for _ in range(3):
            behind += padded[behind] & _QUOTE > 0
        ends = np.sort(np.concatenate([stops[padded[behind] & _SPACE > 0], np.flatnonzero(kind & _BREAK)]))
        before = np.searchsorted(ends, start)
        opens = np.ones(len(runs), bool)
        opens[1:] = before[1:] > before[:-1]
        name = capital.copy()
        doubtful = np.flatnonzero(capital & opens)
        name[doubtful] = ~among(self.own[doubtful], common)
        number = (digits > 0) & (2 * digits >= size) | among(self.own, _NUMBERS)
        name &= ~number
        # words with nothing but blanks between that make one name or number
        blank = np.cumsum(~space | (kind & _BREAK > 0), dtype=np.int32)
        one = np.zeros(len(runs), bool)
        one[1:] = (blank[start[1:] - 1] == blank[at[runs[1:] - 1]]) & (name[1:] & name[:-1] | number[1:] & number[:-1] & (digits[1:] == 0))
        whole = np.cumsum(~one) - 1
        if one.any():
            one &= ~(name & (np.bincount(whole)[whole] > MOST_NAMES))
            name, number, start = name[~one], number[~one], start[~one]
            self.runs = runs = runs[~one]
            self.own = run_hashes(self.low[at], runs)
        self.text = np.searchsorted(border, start)
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        unit = among(self.own, _UNITS)
        unit[1:] &= number[:-1] & (self.text[1:] == self.text[:-1])
        unit[:1] = False
        unit &= ~number
        self.code = self.own.copy()
        self.code[name], self.code[number], self.code[unit] = NAME, NUM, UNIT
        self.slot = name | number | unit

    def value(self, k: int) -> str:
        """Letters and digits of the k-th token, in lower case."""
        end = self.runs[k + 1] if k + 1 < len(self.runs) else len(self.at)
        return "".join(map(chr, self.low[self.at[self.runs[k] : end]].tolist()))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes, own hashes, and 0 / 1 / 2 by start: crosses texts / own tokens only / template as well."""
        n = max(0, len(self.code) - size + 1)
        within = self.text[:n] == self.text[size - 1 : size - 1 + n]
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        enough = (literal[size : size + n] - literal[:n] >= LITERALS) & (size >= MIN_TOKENS)
        return _hashed(self.code, n, size, size), _hashed(self.own, n, size, size + (1 << 32)), within.astype(np.int8) * (1 + enough)


def word_codes(words: Iterable[str]) -> np.ndarray:
    """Sorted own hashes of lower-case words of letters."""
    held = sorted(words)
    ends = np.cumsum([0, *map(len, held)])
    return np.sort(run_hashes(points("".join(held)), ends[:-1])) if held else np.empty(0, np.uint64)


_NUMBERS, _UNITS = word_codes(NUMBER_WORDS), word_codes(UNITS)
NUM, NAME, UNIT = (run_hashes(points(x), np.zeros(1, np.int64))[0] for x in ("<num>", "<name>", "<unit>"))


def _hashed(code: np.ndarray, n: int, size: int, start: int) -> np.ndarray:
    x = np.full(n, start, np.uint64)
    for k in range(size):
        x = (x ^ code[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


class BitTable:
    """Whether hashes may be among the benchmark's: two places of each, in a table of 2 ** bits bits."""

    def __init__(self, bits: int, places: np.ndarray) -> None:
        self.bits = bits
        self.packed = np.zeros(1 << bits - 3, np.uint8)
        np.bitwise_or.at(self.packed, places >> 3, np.left_shift(np.uint8(1), (places & 7).astype(np.uint8)))

    @classmethod
    def of(cls, windows: DataFrame) -> BitTable:
        bits = min(MOST_BITS, max(10, math.ceil(math.log2(BITS_EACH * max(1, windows.count())))))
        place = lambda h: F.shiftrightunsigned(h, 64 - bits)
        # at most two places a window, and at most 2 ** MOST_BITS
        found = windows.select(F.explode(F.array(place(F.col("hash")), place(F.shiftleft("hash", 32)))).alias("k")).distinct()
        return cls(bits, found.toArrow().column(0).to_numpy())

    def _has(self, places: np.ndarray) -> np.ndarray:
        places = places.astype(np.int64)
        return (self.packed[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be among them."""
        shift = np.uint64(64 - self.bits)
        k = np.flatnonzero(self._has(hashes >> shift))
        return k[self._has(hashes[k] << np.uint64(32) >> shift)]


def common_words(docs: DataFrame, benchmark: DataFrame, share: float = COMMON) -> list[str]:
    """The benchmark's capitalised words that all texts together have in lower case ``share`` times a text or more."""
    split = lambda df: df.select(F.explode(F.split("text", "[ \\n]")).alias("word"))
    capital = F.regexp_extract("word", r"^[^\p{L}\p{N}]*(\p{Lu}[\p{Ll}'’]+)", 1)
    asked = written(split(benchmark).select(F.lower(F.regexp_replace(capital, "['’]", "")).alias("asked")).where("asked <> ''").distinct(), "bench-capitals")
    words, texts = split(docs.select("text").unionByName(benchmark.select("text"))), docs.count() + benchmark.count()
    if asked.count() <= FEW_WORDS:
        counted = words.join(F.broadcast(asked), F.col("word") == F.col("asked"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(asked, F.col("word") == F.col("asked"), "left_semi")
    # no more words than the benchmark has
    return counted.where(F.col("n") >= max(1, math.ceil(share * texts))).select("word").toArrow().column(0).to_pylist()


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters; a longer one is alone."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > _CHUNK:
            yield start, k
            start, size = k, 0
        size += n
    if texts:
        yield start, len(texts)


def _slots(tokens: Tokens, at: int, size: int) -> list[str]:
    return [f"{k}:{tokens.value(at + k)}" for k in np.flatnonzero(tokens.slot[at : at + size]).tolist()]


def benchmark_windows(benchmark: DataFrame, common: list[str], window: int = WINDOW) -> DataFrame:
    """item (digest), at, hash, exact, slots, of, width, tokens; both readings of every window of every distinct item text."""
    spark = benchmark.sparkSession
    shared = spark.sparkContext.broadcast(word_codes(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = Tokens([text.as_py()], shared.value)
                if not (n := len(tokens.code)):
                    continue
                size = min(window, n)
                template, own, kind = tokens.windows(size)
                of = int((kind == 2).sum())
                for at in range(len(own)):
                    slots = _slots(tokens, at, size)
                    if kind[at] == 2:
                        rows.append((key, at, int(template[at].view(np.int64)), False, slots, of, size, n))
                    rows.append((key, at, int(own[at].view(np.int64)), True, slots, of, size, n))
            yield _batch(rows, ("item", *_SHAPE, "of", "width", "tokens"))

    return benchmark.select(digest().alias("item"), "text").distinct().mapInArrow(run, _ITEM_SCHEMA)


_SHAPE = ("at", "hash", "exact", "slots")
_TYPES = {"item": pa.string(), "text": pa.string(), "at": pa.int32(), "hash": pa.int64(), "exact": pa.bool_(), "slots": pa.list_(pa.string()), "of": pa.int32(), "width": pa.int32(), "tokens": pa.int32()}
_ITEM_SCHEMA = "item string, at int, hash long, exact boolean, slots array<string>, of int, width int, tokens int"


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), _TYPES[n]) for n, c in zip(names, columns)], names=list(names))


def document_windows(docs: DataFrame, table: BitTable, widths: list[int], common: list[str]) -> DataFrame:
    """doc_id, text (digest), at, hash, exact, slots of the documents' windows that the table lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast((table, word_codes(common)))
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, usual = shared.value
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, at_row = [], []
            for low, high in _chunks(texts):
                tokens = Tokens(texts[low:high], usual)
                for size in widths:
                    template, own, kind = tokens.windows(size)
                    for exact, hashes in ((False, template), (True, own)):
                        able = np.flatnonzero(kind > 0 if exact else kind > 1)
                        for at in able[passes(hashes[able])].tolist():
                            k = int(tokens.text[at])
                            rows.append((keys[low + k], at - int(tokens.first[k]), int(hashes[at].view(np.int64)), exact, [] if exact else _slots(tokens, at, size)))
                            at_row.append(low + k)
            out = _batch(rows, ("text", *_SHAPE))
            ids = batch.column(0).take(pa.array(at_row, pa.int64()))
            yield pa.record_batch([ids, *out.columns], names=["doc_id", *out.schema.names])
        trim()

    texts = docs.select("doc_id", digest().alias("digest"), "text")
    return texts.mapInArrow(run, f"doc_id {kind_of_id}, text string, at int, hash long, exact boolean, slots array<string>")


def _met(found: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of equal hashes; a hash that very many documents have is dealt to several tasks."""
    often = found.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = found.join(often, "hash", "left").withColumn("part", F.pmod(F.xxhash64("text", "at"), parts).cast("int")).drop("parts")
    named = items.select("hash", "exact", "item", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("of").alias("item_of"), F.col("tokens").alias("item_tokens"), F.col("width").alias("item_width"))
    spread = named.join(often, "hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = dealt.join(spread, ["hash", "exact", "part"])
    # equal tokens have equal values
    return met.withColumn("slots", F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots"))).drop("hash", "part")


LEVELS = "array<struct<level:int,k:bigint>>"


def _occurrences(met: DataFrame) -> DataFrame:
    """Joined windows once per occurrence (``occ``) they belong to: diagonal, its neighbours, all together, run of equal tokens."""
    met = met.distinct().withColumn("line", F.col("at") - F.col("item_at"))
    along = Window.partitionBy("text", "item").orderBy("line")
    whole = Window.partitionBy("text", "item")
    apart = F.col("line") - F.lag("line").over(along) > F.greatest(F.lit(1), F.col("item_tokens") / 2)
    met = met.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    met = met.withColumn("near", F.sum("apart").over(along.rangeBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("several", F.min("line").over(whole) < F.max("line").over(whole))
    met = met.withColumn("equal", F.col("slots") == F.col("item_slots"))
    run = F.dense_rank().over(Window.partitionBy("text", "item", "line", "equal").orderBy("at"))
    met = met.withColumn("run", F.col("at") - run)
    occ = lambda level, k: F.struct(F.lit(level).alias("level"), k.cast("long").alias("k"))
    own = F.array(occ(0, F.col("line")))
    wider = F.when(F.col("several"), F.array(occ(1, F.col("near")), occ(2, F.lit(0)))).otherwise(F.array().cast(LEVELS))
    equal = F.when(F.col("equal"), F.array(occ(3, F.shiftleft(F.col("line").cast("long"), 32) + F.col("run")))).otherwise(F.array().cast(LEVELS))
    return met.withColumn("occ", F.explode(F.concat(own, wider, equal))).drop("line", "apart", "near", "several", "equal", "run")


def _matches(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The passing pairs of texts and items by digest, with their figures; and doc_id, text of documents with joined windows."""
    small_batches(docs.sparkSession)
    common = common_words(docs, benchmark)
    items = written(benchmark_windows(benchmark, common, window), "bench-windows")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # from 1 to window
    found = written(document_windows(docs, BitTable.of(items), widths, common), "bench-found")
    met = written(_occurrences(_met(found.drop("doc_id").distinct(), items)), "bench-met")
    key = ("text", "item", "occ")
    cover = met.groupBy(*key).agg(
        F.countDistinct("item_at").alias("n_windows"),
        F.countDistinct(F.when(~F.col("exact"), F.col("item_at"))).alias("n_templates"),
        F.max("item_of").alias("item_of"),
        F.max(F.col("item_tokens") - F.col("item_width") + 1).alias("item_all"),
    )
    share = F.greatest(F.col("n_windows") / F.col("item_all"), F.coalesce(F.try_divide("n_templates", "item_of"), F.lit(0.0)))
    # a slot value with its place in the item and in the document, so that a slot seen by many windows counts once
    pair = F.explode(F.arrays_zip("item_slots", "slots")).alias("p")
    place = lambda c, at: F.col(at) + F.substring_index(F.col(f"p.{c}"), ":", 1).cast("int")
    value = lambda c: F.substring_index(F.col(f"p.{c}"), ":", -1)
    slots = (
        met.select(*key, "at", "item_at", pair)
        .select(*key, place("item_slots", "item_at").alias("ip"), place("slots", "at").alias("dp"), value("item_slots").alias("iv"), value("slots").alias("dv"))
        .distinct()
    )
    mapped = slots.groupBy(*key, "iv", "dv").agg(F.count(F.lit(1)).alias("n"))
    # of the values that one maps to, in either direction, the most frequent is taken as its mapping
    top = mapped.groupBy(*key, "iv").agg(F.max_by("dv", F.struct("n", "dv")).alias("to"), F.sum("n").alias("n_iv"))
    back = mapped.groupBy(*key, "dv").agg(F.max_by("iv", F.struct("n", "iv")).alias("from"), F.sum("n").alias("n_dv"))
    m = mapped.join(top, [*key, "iv"]).join(back, [*key, "dv"])
    # a value met once can't contradict itself; two numbers of an item may happen to be one in the document
    shared = (F.col("n_dv") > 1) & ~F.col("dv").rlike("[0-9]")
    tested = (F.col("n_iv") > 1) | shared
    agrees = (F.col("to") == F.col("dv")) & (~shared | (F.col("from") == F.col("iv")))
    agreed = m.groupBy(*key).agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when(tested, F.col("n")).otherwise(0)).alias("n_tested"),
        F.sum(F.when(tested & agrees, F.col("n")).otherwise(0)).alias("n_agreed"),
        F.sum(F.when(F.col("iv") != F.col("dv"), F.col("n")).otherwise(0)).alias("n_changed"),
    )
    none = F.lit(0).cast("long")
    out = cover.join(agreed, [*key], "left").select(
        *key, "n_windows", share.alias("coverage"),
        F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("n_changed", none).alias("n_changed"),
        F.coalesce(F.try_divide("n_agreed", "n_tested"), F.lit(1.0)).alias("consistency"),
    )
    excerpt = (F.col("occ.level") == 3) & (F.col("n_windows") >= max(1, VERBATIM - window + 1))
    out = out.where(((F.col("coverage") >= COVERAGE) | (F.col("n_windows") >= RUN) | excerpt) & (F.col("consistency") >= CONSISTENT))
    best = F.max(F.struct("coverage", "consistency", (-F.col("n_changed")).alias("same"), "n_windows", "n_slots", "n_changed")).alias("best")
    return written(out.groupBy("text", "item").agg(best), "bench-pairs"), found.select("doc_id", "text").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, n_changed, consistency, kind of every contamination."""
    pairs, ids = _matches(docs, benchmark, window)
    named = benchmark.select("item_id", digest().alias("item")).distinct()
    rows = ids.join(pairs, "text").join(named, "item").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    out = rows.select("doc_id", "item_id", *[f"best.{c}" for c in ("n_windows", "coverage", "n_slots", "n_changed", "consistency")])
    return out.withColumn("kind", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no benchmark item contaminates, each decided by its own text; columns are untouched."""
    pairs, _ = _matches(docs, benchmark, window)
    hit = pairs.select(F.col("text").alias("hit")).distinct()
    return docs.join(hit, F.md5(F.coalesce(docs["text"], F.lit(""))) == hit["hit"], "left_anti")
