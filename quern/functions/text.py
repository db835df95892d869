"""Text functions as column expressions: tokens, query variants, markdown sections, splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 8000
OVERLAP_CHARS = 150
H2 = r"(?md)^##\s+(.+?)\s*$"
FRONTMATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"
#: White space as a Python string strips it.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+", "")


def newlines(text: Column) -> Column:
    """All line ends as line feeds, as text files are read."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words with ``_`` and ``#``; all else separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9_#]++"), F.lit(0))


def query_words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"(?U){SPACE}+"), lambda t: t != ""))


def _cut(t: Column, n: int) -> Column:
    """All but the last ``n`` characters."""
    return F.left(t, F.length(t) - n)


def expand(tokens: Column) -> Column:
    """Tokens with English variants (plural, -ing, -e, -ed) of those longer than three letters."""
    none = F.array().cast("array<string>")
    e = F.lit("e")

    def variants(t: Column) -> Column:
        number = F.when(t.endswith("s"), F.array(_cut(t, 1))).otherwise(F.array(F.concat(t, F.lit("s"))))
        ing = F.array(_cut(t, 3), F.concat(_cut(t, 3), e))
        from_e = F.array(F.concat(_cut(t, 1), F.lit("ing")), F.concat(t, F.lit("d")))
        verb = F.when(t.endswith("ing") & (F.length(t) > 4), ing).when(t.endswith("e"), from_e).otherwise(none)
        past = F.when(t.endswith("ed"), F.array(_cut(t, 2), F.concat(_cut(t, 2), e))).otherwise(none)
        return F.when(F.length(t) > 3, F.concat(F.array(t), number, verb, past)).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(tokens, variants)))


def substring_hits(text: Column, words: Column) -> Column:
    """How many of the words occur in the text (null text: none)."""
    return F.size(F.filter(words, lambda w: F.coalesce(F.contains(text, w), F.lit(False))))


def has_fence(text: Column) -> Column:
    """Whether a line starts with a code fence."""
    return text.rlike(r"(?md)^`{3}")


_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\.)*+"', r"'(?:[^']|'')*+'"
_FLOW = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*+\]|\{[^{}]*\}"
_FIRST = r"""[^\s\-?:,\[\]{}#&*!|>'"%@`]"""
_PLAIN = rf"(?:{_FIRST}|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*"
_KEY = rf"(?:{_DOUBLE}|{_SINGLE}|{_FIRST}[^:#\n]*?)"
#: Lines of a block that maps keys to values: blank, comment, indented, list item, key with or without value.
_LINE = rf"\s*(?:#.*)?|(?: +|- |-$)\S?.*|{_KEY} *:(?: +(?:{_DOUBLE}|{_SINGLE}|{_FLOW}|[|>][-+0-9]*|{_PLAIN}))?\s*(?: +#.*)?"


def well_formed(meta: Column) -> Column:
    """Whether all lines of a front matter block can stand in a map of keys: quotes and brackets closed, one colon a key.

    The subset of YAML that is known: scalars plain, quoted on one line, or in a block; lists and maps
    in brackets or indented, whose inside is not looked into; comments.
    """
    first = F.regexp_extract(meta, r"\A(?:\s*(?:#.*)?\n)*+(.?)", 1)
    return ~first.rlike(r"^[-\s]$") & F.forall(F.split(meta, "\n"), lambda x: x.rlike(rf"\A(?:{_LINE})\z"))


def frontmatter(text: Column) -> Column:
    """Strict front matter: (meta, body); without a leading block, or with a malformed one, meta is null and body the text."""
    meta = F.regexp_extract(text, FRONTMATTER, 1)
    found = text.rlike(FRONTMATTER) & well_formed(meta)
    return F.struct(F.when(found, meta).alias("meta"), F.when(found, F.regexp_extract(text, FRONTMATTER, 2)).otherwise(text).alias("body"))


def fields(meta: Column) -> Column:
    """Map of the keys of a well-formed block to their values as text; of repeated keys the last counts.

    Quotes and comments go. A block scalar is its lines, folded ones joined by spaces, without the
    line end behind it; a list is ``[a, b]`` however it was written; a map inside is its lines.
    """
    entries = F.filter(F.split(F.coalesce(meta, F.lit("")), r"\n(?=[^\s#\-])"), lambda e: e.rlike(rf"\A{_KEY} *:"))

    def unquoted(x: Column) -> Column:
        inside = F.regexp_replace(F.regexp_extract(x, rf"\A({_DOUBLE}|{_SINGLE})", 1), r"\A.|.\z", "")
        double, single = F.regexp_replace(inside, r'\\(["\\/])', "$1"), F.replace(inside, F.lit("''"), F.lit("'"))
        return F.when(x.startswith('"'), double).when(x.startswith("'"), single).otherwise(strip(F.regexp_replace(x, r"(?:\A|\s+)#.*", "")))

    def value(e: Column) -> Column:
        head = F.regexp_extract(e, rf"\A{_KEY} *: *([^\n]*)", 1)
        tail = F.filter(F.transform(F.slice(F.split(e, "\n"), 2, 1 << 20), strip), lambda x: x != "")
        bare = F.filter(tail, lambda x: ~x.startswith("#"))
        items = F.concat(F.lit("["), F.array_join(F.transform(bare, lambda x: unquoted(F.regexp_replace(x, r"\A-\s*", ""))), ", "), F.lit("]"))
        listed = (F.size(bare) > 0) & F.forall(bare, lambda x: x.rlike(r"\A-(\s|\z)"))
        empty = F.regexp_replace(head, r"\A#.*", "") == ""
        return (
            F.when(head.startswith("|"), F.array_join(tail, "\n"))
            .when(head.startswith(">"), F.array_join(tail, " "))
            .when(empty & listed, items)
            .when(empty, F.array_join(bare, "\n"))
            .when(head.rlike(r"""\A['"]"""), unquoted(head))
            .otherwise(F.array_join(F.concat(F.array(unquoted(head)), bare), " "))
        )

    pair = lambda e: F.struct(unquoted(F.regexp_extract(e, rf"\A({_KEY}) *:", 1)).alias("key"), value(e).alias("value"))
    last_first = F.reverse(F.transform(entries, pair))
    keys = F.array_distinct(F.transform(last_first, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(last_first, lambda p: p["key"] == k), F.lit(0))))


def lenient_frontmatter(text: Column) -> Column:
    """Front matter between the first two ``---`` of a text that starts with one: (meta, body)."""
    parts = F.split(text, "---", 3)
    found = text.startswith("---") & (F.size(parts) >= 3)
    return F.struct(F.when(found, F.get(parts, F.lit(1))).alias("meta"), F.when(found, strip(F.get(parts, F.lit(2)))).otherwise(text).alias("body"))


def simple_fields(meta: Column) -> Column:
    """Map of the ``key: value`` lines of a flat front matter block, quotes removed."""
    lines = F.filter(F.split(F.coalesce(meta, F.lit("")), "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(strip(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("value"))
    last_first = F.reverse(F.transform(lines, pair))
    keys = F.array_distinct(F.transform(last_first, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(last_first, lambda p: p["key"] == k), F.lit(0))))


def sections(body: Column) -> Column:
    """Array of (heading, text): what stands before the first H2 is ``Overview``; blank sections drop out."""
    heads = F.concat(F.array(F.lit("Overview")), F.regexp_extract_all(body, F.lit(H2), F.lit(1)))
    texts = F.transform(F.split(body, H2), strip)
    pairs = F.transform(heads, lambda h, i: F.struct(h.alias("heading"), F.get(texts, i).alias("text")))
    kept = F.filter(pairs, lambda p: p["text"] != "")
    alone = F.array(F.struct(F.lit("Overview").alias("heading"), strip(body).alias("text")))
    return F.when(F.size(heads) == 1, alone).otherwise(kept)


def section_tail(text: Column, n: int = OVERLAP_CHARS) -> Column:
    """About the last ``n`` characters, from a paragraph or word start on; a short text whole."""
    tail = lstrip(F.right(text, F.lit(n)))
    half = F.floor(F.length(tail) / 2)
    after = lambda mark: F.instr(tail, mark) - 1
    inside = lambda at: (at > 0) & (at < half)
    cut = F.when(inside(after("\n\n")), F.substring(tail, after("\n\n") + 3, F.length(tail))).when(inside(after(" ")), F.substring(tail, after(" ") + 2, F.length(tail))).otherwise(tail)
    return F.when(F.length(text) <= n, text).otherwise(cut)


def _last(window: Column, mark: str, width: int) -> Column:
    """0-based place of the last ``mark`` in a window of ``width`` characters, -1 if there is none."""
    r = F.instr(F.reverse(window), mark)
    return F.when(r == 0, F.lit(-1)).otherwise(width - r - len(mark) + 1)


def hard_split(text: Column, width: int = MAX_CHARS) -> Column:
    """Pieces of at most ``width`` characters, cut at a blank line, else a line end, else anywhere."""
    state = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"]
        window = F.left(rest, F.lit(width))
        blank, line = _last(window, "\n\n", width), _last(window, "\n", width)
        cut = F.when(blank >= width // 2, blank).when(line >= width // 2, line).otherwise(F.lit(width))
        long = F.length(rest) > width
        piece = F.when(long, strip(F.left(rest, cut))).otherwise(rest)
        left = F.when(long, strip(F.substring(rest, cut + 1, F.length(rest)))).otherwise(F.lit(""))
        return F.when(rest == "", s).otherwise(F.struct(left.alias("rest"), F.concat(s["parts"], F.array(piece)).alias("parts")))

    steps = F.sequence(F.lit(1), (F.ceil(F.length(text) / F.lit(width // 2)) + 1).cast("int"))
    split = F.aggregate(steps, state, step, lambda s: F.filter(s["parts"], lambda p: p != ""))
    return F.when(F.length(text) <= width, F.array(text)).otherwise(split)
