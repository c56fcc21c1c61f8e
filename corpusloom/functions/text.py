"""Text functions as Column expressions; all but the fragments of words stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import arrow_function

# French stop words of the keyword query.
FRENCH_STOPWORDS = (
    "je tu il elle on nous vous ils elles me te se moi toi lui leur eux ce ceci cela ca le la les l un une des du de d au aux "
    "mon ton son ma ta sa mes tes ses notre votre nos vos leurs cet cette ces et ou mais donc or ni car a à dans par pour en vers "
    "avec sans sous sur chez est sont suis es etes etais etait faut doit ai as ont avons avez avoir etre faire aller comment "
    "pourquoi quand qui que quoi quel quelle quels quelles est-ce qu'est-ce s'il plait bonjour merci salut chercher trouver"
).split()

#: Letters, digits, listed accents, white space, basic punctuation, curly apostrophes.
CLEAN = r"""[a-zA-Z0-9àâäéèêëïîôùûüÿæœçÀÂÄÉÈÊËÏÎÔÙÛÜŸÆŒÇ\s.,;:!?'"()\-‘’]"""
PUNCTUATION = r"""[.,;:!?'"()\-]"""


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_for_comparison(c: Column) -> Column:
    """Markdown marks and non-word characters become single spaces; lower case."""
    c = _chain(c, (r"(?m)^#+\s*", ""), (r"\||-{3,}|\.{4,}|={3,}", " "))
    return collapse(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def normalize_query(c: Column) -> Column:
    return collapse(F.lower(c))


def punctuation_spacing(c: Column) -> Column:
    """No white space in front of commas and full stops, single spaces elsewhere."""
    return collapse(F.regexp_replace(c, r"(?U)\s+([,.])", "$1"))


def slug(c: Column, most: int = 50) -> Column:
    c = _chain(F.lower(c), (r"(?U)[^\w\s-]", ""), (r"(?U)[-\s]+", "-"))
    return F.substring(c, 1, most)


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def safe_category(c: Column, default: str = "General") -> Column:
    named = F.replace(F.trim(F.regexp_replace(c, r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))
    return F.coalesce(named, F.lit(default))


def kb_ids(c: Column) -> Column:
    """A list written with brackets, quotes and blanks as plain comma-separated ids."""
    return F.coalesce(F.regexp_replace(c, r"""[\[\]'" ]""", ""), F.lit(""))


def human_bytes(c: Column, largest: str = "TB") -> Column:
    """Sizes in units of 1,024, up to the ``largest`` one in use."""
    sizes = ["B", "KB", "MB", "GB", "TB"]
    sizes = sizes[: sizes.index(largest) + 1]
    out = F.lit("0 B")
    x = c.cast("double")
    ladder = F.when(c == 0, out)
    for k, unit in enumerate(sizes):
        form = F.format_string(f"%.2f {unit}", F.bround(x / float(1024**k), 2))
        ladder = ladder.when(x < float(1024 ** (k + 1)), form) if k < len(sizes) - 1 else ladder.otherwise(form)
    return ladder


def file_type(name: Column) -> Column:
    """Lower-cased extension without its dot; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^\.*[^.].*?\.([^.]*)$", 1))


def deep_link(url: Column, kind: Column, page: Column) -> Column:
    missing = F.lit("URL not found")
    return F.when(url.isNull() | (url == "") | (url == missing), missing).when((kind == "pdf") & (page > 0), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def breadcrumb(header_path: Column) -> Column:
    inner = F.replace(F.regexp_replace(header_path, "^/+|/+$", ""), F.lit("/"), F.lit(" > "))
    return F.when(F.coalesce(header_path, F.lit("/")) == "/", "Root").otherwise(inner)


def rerank_context(file_name: Column, header_path: Column, text: Column) -> Column:
    name = F.coalesce(file_name, F.lit("Unknown"))
    return F.concat(F.lit("[Document: "), name, F.lit(" | Section: "), breadcrumb(header_path), F.lit("]\n\n"), text)


def header_breadcrumbs(source: Column, headers: Column) -> Column:
    """Source name and the Header* values of a metadata map, in the order of their keys."""
    keys = F.array_sort(F.filter(F.map_keys(headers), lambda k: F.startswith(k, F.lit("Header"))))
    return F.concat_ws(" > ", source, F.transform(keys, lambda k: headers[k]))


def kb_chunk(title: Column, number: Column, content: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nKB: "), number, F.lit("\nContent: "), content)


def keywords(query: Column, stop: list[str] | None = None) -> Column:
    """The query without stop words; unchanged if nothing is left."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1))
    drop = F.array(*[F.lit(w) for w in (stop or FRENCH_STOPWORDS)])
    kept = F.filter(words, lambda w: ~F.array_contains(drop, w))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def is_clean(c: Column) -> Column:
    return c.rlike(rf"^{CLEAN}+$")


def has_punctuation(c: Column) -> Column:
    return c.rlike(PUNCTUATION)


def token_estimate(*columns: Column) -> Column:
    """Aggregate: a quarter of all characters, rounded down."""
    chars = sum((F.length(F.coalesce(c, F.lit(""))) for c in columns[1:]), F.length(F.coalesce(columns[0], F.lit(""))))
    return F.floor(F.coalesce(F.sum(chars), F.lit(0)) / 4).cast("long")


_MARKED = re.compile(PUNCTUATION)
_ALL_CLEAN = re.compile(CLEAN + "+")


def fragments(value: str | None, window: int = 5) -> tuple[str | None, str | None]:
    """First and last runs of ``window`` words free of punctuation; both are one run where they would overlap.

    Texts of fewer than 15 words have one run; longer ones without any try smaller windows, down to 2.
    """
    words = re.sub(r"\s+([,.])", r"\1", value or "").split()
    plain = [not _MARKED.search(w) for w in words]
    for size in range(window, 1, -1):
        runs = [k for k in range(len(words) - size + 1) if all(plain[k : k + size])]
        if len(words) < size:
            whole = " ".join(words) if words and all(plain) else None
            return whole, whole
        if runs:
            first, last = (" ".join(words[k : k + size]) for k in (runs[0], runs[-1]))
            if len(words) < 15:
                return first, first
            if runs[0] + size > runs[-1]:
                span = " ".join(words[runs[0] : runs[-1] + size])
                return (span, span) if len(span) < 200 and _ALL_CLEAN.fullmatch(span) else (first, first)
            return first, last
        if len(words) < 15:
            break
    return None, None


@arrow_function("struct<start:string,end:string>")
def start_end_fragments(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fragments(t) for t in texts], columns=["start", "end"], dtype=object)


def longest_clean(c: Column, least: int = 20) -> Column:
    """The longest clean sentence, else the longest run of clean words of the longest sentence."""
    parts = F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    rank = lambda xs: F.reduce(xs, F.lit("").cast("string"), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    clean = rank(F.filter(parts, lambda s: (F.length(s) >= least) & is_clean(s)))
    runs = F.transform(
        F.split(F.array_join(F.transform(F.split(rank(parts), r"(?U)\s+"), lambda w: F.when(is_clean(w), w).otherwise("\x01")), " "), "\x01"),
        lambda s: F.trim(s),
    )
    run = rank(runs)
    return F.when(F.length(clean) > 0, punctuation_spacing(clean)).when(F.length(run) >= least, punctuation_spacing(run))


def truncate_middle(c: Column, most: int = 8000) -> Column:
    """First and last halves of a long text around a note of how many characters went."""
    half = most // 2
    note = F.concat(F.lit("\n\n[... "), (F.length(c) - most).cast("string"), F.lit(" chars removed ...]\n\n"))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, half), note, F.right(c, F.lit(half))))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other text is unchanged."""
    fits = ~c.rlike(r"[^\x00-\xFF]") & c.rlike(r"[\xC2-\xF4][\x80-\xBF]")
    again = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return F.when(fits, F.coalesce(again, c)).otherwise(c)


def score_rounded(c: Column) -> Column:
    """Scores as they are kept: two decimals, ties to the even one."""
    return F.bround(c, 2)
