"""URL, path and hash functions."""

from __future__ import annotations

import os
import re
import unicodedata
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import arrow_function

# What is never crawled, what is downloaded, and MIME types by extension.
EXCLUDED = (
    r"\.(jpg|jpeg|png|gif|svg|ico|webp|bmp)$", r"\.(mp4|avi|mov|wmv|flv|webm)$", r"\.(mp3|wav|ogg|flac)$", r"\.(zip|rar|tar|gz|7z|bz2|xz)$",
    r"/logout", r"/signout", r"/deconnexion", r"mailto:", r"tel:",
)
DOWNLOADABLE = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "csv")
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt": "application/vnd.ms-powerpoint",
    "html": "text/html", "htm": "text/html", "json": "application/json", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "xml": "application/xml",
}


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def under_prefix(url: Column, prefix: str | None) -> Column:
    """Whether the URL's path starts with /prefix/; without a prefix every URL does."""
    inner = (prefix or "").strip("/")
    return F.startswith(url_path(url), F.lit(f"/{inner}/")) if inner else F.lit(True)


def normalized(url: Column) -> Column:
    """No fragment, query parameters sorted by name (stable)."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.transform(F.split(query, "&"), lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("at"), p.alias("pair")))
    ordered = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["pair"]), "&")
    return F.when(query == "", bare).otherwise(F.concat(F.substring_index(bare, "?", 1), F.lit("?"), ordered))


@arrow_function("string")
def normalized_strict(urls: pd.Series) -> pd.Series:
    """With scheme and host in lower case, default ports dropped and parameters encoded again."""

    def one(url: str | None) -> str | None:
        try:
            u = urlsplit(url)
            port = "" if u.port in (None, {"http": 80, "https": 443}.get(u.scheme)) else f":{u.port}"
            if not u.scheme or not u.hostname:
                return url
            query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True), key=lambda x: x[0]))
            return urlunsplit((u.scheme, u.hostname + port, u.path or "/", query, ""))
        except (ValueError, TypeError, AttributeError):
            return url

    return urls.map(one)


@arrow_function("string")
def resolved(links: pd.Series, bases: pd.Series) -> pd.Series:
    def one(link: str | None, base: str | None) -> str | None:
        try:
            return urljoin(base, link)
        except (ValueError, TypeError):
            return None

    return pd.Series([one(a, b) for a, b in zip(links, bases)], dtype=object)


@arrow_function("string")
def safe_filename(names: pd.Series) -> pd.Series:
    """ASCII letters, digits, dots, underscores and hyphens; the extension stays as it is."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        stem, extension = os.path.splitext(unquote(name))
        plain = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode()
        return re.sub(r"_+", "_", re.sub(r"[^\w.-]", "_", plain, flags=re.ASCII)).strip("_") + extension

    return names.map(one)


def under_roots(url: Column, roots: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: F.startswith(normalized(url), r)) if roots else F.lit(False)


def crawlable(url: Column, roots: list[str]) -> Column:
    return under_roots(url, roots) & ~url.rlike("(?i)" + "|".join(EXCLUDED))


def downloadable(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(rf"\.({'|'.join(DOWNLOADABLE)})$")


def followable(href: Column) -> Column:
    """Links that lead to a page: no script, mail or telephone scheme."""
    return ~href.rlike("(?i)^(javascript|mailto|tel):")


def folder_path(url: Column) -> Column:
    """Safe folder names of the path, a trailing page name left out, and 8 hex digits of the URL's md5."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    last_page = (F.size(parts) > 0) & F.element_at(F.concat(parts, F.array(F.lit(""))), F.greatest(F.size(parts), F.lit(1))).rlike(r"(?i)\.(html?|php|asp)$")
    parts = F.when(last_page, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    safe = F.transform(parts, lambda p: F.substring(F.regexp_replace(p, "(?i)[^a-z0-9_-]", "_"), 1, 100))
    return F.array_join(F.concat(safe, F.array(F.substring(F.md5(url), 1, 8))), "/")


def file_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1), "(?i)[^a-z0-9_.-]", "_")


def page_file_name(url: Column) -> Column:
    return F.concat(F.lit("page_"), F.substring(F.md5(url), 1, 8), F.lit(".html"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(query: Column, index: Column, groups: Column, url_filter: Column, top_k: Column | None = None) -> Column:
    """16 hex digits over the normalised request; top_k is part of it, so that a hit has the size asked for."""
    from .text import normalize_query

    parts = [normalize_query(query), index, F.array_join(F.array_sort(groups), ","), F.regexp_replace(F.coalesce(url_filter, F.lit("")), "^/+|/+$", "")]
    if top_k is not None:
        parts.append(top_k.cast("string"))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def relative_to(path: Column, base: str) -> Column:
    inner = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(inner)), F.substring(path, len(inner) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1))


def mime_type(name: Column, default: str = "application/octet-stream") -> Column:
    from .text import file_type

    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(table, file_type(name)), F.lit(default))
