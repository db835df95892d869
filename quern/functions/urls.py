"""URL and HTML functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip

#: Elements whose content is no text of the page.
DROPPED_TAGS = ["script", "style", "nav", "footer", "header", "noscript"]
#: Named character references that are decoded (the ampersand last).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def mirror_path(url: Column) -> Column:
    """Where a page is stored: ``markdown/<publication>/<path>``; one segment alone belongs to ``general``."""
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"^/en/", "/"), r"^/+", "")
    return F.when(F.contains(path, F.lit("/")), F.concat(F.lit("markdown/"), path)).otherwise(F.concat(F.lit("markdown/general/"), path))


def resolve(base: Column, link: Column) -> Column:
    """A link seen from a base URL: absolute, scheme-relative, root-relative or relative, dots removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    clean = lambda path: _dots(path)
    relative = F.concat(root, clean(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link)))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link == "", base)
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link))
        .when(link.startswith("/"), F.concat(root, clean(link)))
        .otherwise(relative)
    )


def _dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; what follows a ``?`` or ``#`` is left alone."""
    bare = F.regexp_extract(path, r"^([^?#]*)", 1)
    rest = F.substring(path, F.length(bare) + 1, F.length(path))
    parts = F.split(bare, "/")
    step = lambda s, p: F.when(p == ".", s).when((p == "..") & (F.size(s) > 1), F.slice(s, F.lit(1), F.size(s) - 1)).when(p == "..", s).otherwise(F.concat(s, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(bare.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), ends, rest)


def links(text: Column, base: Column) -> Column:
    """Absolute ``.md`` targets of the bullet links of an index, in document order."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    bullets = F.filter(lines, lambda x: x.rlike(r"^- \[.*?\]\((.*?)\)"))
    targets = F.transform(bullets, lambda x: resolve(base, F.regexp_extract(x, r"^- \[.*?\]\((.*?)\)", 1)))
    return F.filter(targets, lambda u: u.endswith(".md"))


def main_text(html: Column) -> Column:
    """Readable text of a page: of ``main``, else ``article``, else ``body``, else all; one line per piece."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)<!doctype[^>]*>", "")
    for tag in DROPPED_TAGS:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    inner = bare
    for tag in ("body", "article", "main"):  # the last that is there wins
        part = rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"
        inner = F.when(bare.rlike(rf"(?i)<{tag}\b"), F.regexp_extract(bare, part, 1)).otherwise(inner)
    pieces = F.split(inner, r"(?s)<[^>]*>")

    def decoded(piece: Column) -> Column:
        for name, char in ENTITIES.items():
            piece = F.replace(piece, F.lit(name), F.lit(char))
        return strip(piece)

    return F.array_join(F.filter(F.transform(pieces, decoded), lambda p: p != ""), "\n")
