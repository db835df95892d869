"""Front matter with types: nested maps and lists, numbers, truth values and dates, as a variant.

The block is read in Arrow batches by recursive descent over its lines, for indentation nests to any
depth and so no expression of fixed size can follow it. What is known of YAML: maps and lists,
indented or in brackets, scalars plain, in quotes or in blocks, comments. Anchors, tags and documents
behind the first are malformed; numbers to the base of sixty and endless ones are text.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import FRONTMATTER

#: How deep values may nest.
DEPTH = 64

# Plain scalars that are not text, and escapes between double quotes.
NONE = {"", "~", "null", "Null", "NULL"}
TRUE = {"true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"}
FALSE = {"false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"}
INTEGER = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)")
NUMBER = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+][0-9]+)?")
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0"}

_QUOTED = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'""")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`](?:[^:#]|:(?=\S)|(?<=\S)#)*?|[-?:](?=\S)(?:[^:#]|:(?=\S)|(?<=\S)#)*?)(?<!\s)\s*:(?:\s+|$)""")
_COMMENT = re.compile(r"(?:(?<!\s)\s+|\A)#.*")
_FLOW_PLAIN = re.compile(r"""[^\s,\[\]{}:#&*!|>'"%@`](?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*""")
_FORBIDDEN = tuple("&*!%@`,]}|>")


class Malformed(ValueError):
    """The block can't be read."""


def _unquoted(m: re.Match) -> str:
    if m[2] is not None:
        return m[2].replace("''", "'")

    def one(e: re.Match) -> str:
        if code := e[1] or e[2] or e[3]:
            if int(code, 16) > 0x10FFFF or 0xD800 <= int(code, 16) < 0xE000:
                raise Malformed("no such character")
            return chr(int(code, 16))
        if e[4] not in ESCAPES:
            raise Malformed("unknown escape")
        return ESCAPES[e[4]]

    return _ESCAPE.sub(one, m[1])


def scalar(text: str):
    """The value of a plain scalar; dates and times stay text in their own form."""
    if text in NONE:
        return None
    if text in TRUE or text in FALSE:
        return text in TRUE
    digits = text.replace("_", "").lower()
    if INTEGER.fullmatch(text):
        bare, sign = digits.lstrip("+-"), -1 if digits.startswith("-") else 1
        base = {"0b": 2, "0x": 16}.get(bare[:2], 8 if bare.startswith("0") and len(bare) > 1 else 10)
        bare = bare[2:] if base in (2, 16) else bare
        return sign * int(bare, base) if bare else text
    if NUMBER.fullmatch(text):
        return float(digits)
    return text


def _end(rest: str) -> None:
    """Nothing but a comment may follow a closed value."""
    if _COMMENT.sub("", rest).strip():
        raise Malformed("text behind a closed value")


def _flow(text: str, at: int, depth: int = 0) -> tuple[object, int]:
    """The value in brackets, quotes or plain that starts at a place of one line, and the place behind it."""
    if depth > DEPTH:
        raise Malformed("too deep")
    skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip())
    at = skip(at)
    if (opened := text[at : at + 1]) in ("[", "{") and opened:
        close, out, at = {"[": "]", "{": "}"}[opened], [], skip(at + 1)
        while text[at : at + 1] != close:
            value, at = _flow(text, at, depth + 1)
            at = skip(at)
            if text[at : at + 1] == ":":
                key = value
                value, at = (None, at + 1) if text[skip(at + 1) : skip(at + 1) + 1] in (",", close) else _flow(text, at + 1, depth + 1)
                value = {_name(key): value} if opened == "[" else (_name(key), value)
            elif opened == "{":
                value = (_name(value), None)
            out.append(value)
            at = skip(at)
            if text[at : at + 1] == ",":
                at = skip(at + 1)
            elif text[at : at + 1] != close:
                raise Malformed("bracket not closed")
        return (out if opened == "[" else dict(out)), at + 1
    if quoted := _QUOTED.match(text, at):
        return _unquoted(quoted), quoted.end()
    plain = _FLOW_PLAIN.match(text, at)
    if not plain:
        raise Malformed("value expected")
    return scalar(plain[0].rstrip()), plain.end()


def _name(key: object) -> str:
    """A key as text: keys of a variant have no other type."""
    if isinstance(key, (list, dict)):
        raise Malformed("key is not a scalar")
    return key if isinstance(key, str) else json.dumps(key)


class _Lines:
    """The lines of a block, read from the top."""

    def __init__(self, block: str) -> None:
        self.lines, self.at = block.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """(indent, content) of the next line that is neither blank nor a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            content = line.lstrip(" ")
            if content.strip() and not content.startswith("#"):
                if content.startswith("\t"):
                    raise Malformed("indented by a tab")
                return len(line) - len(content), content.rstrip()
            self.at += 1
        return None

    def node(self, least: int, depth: int = 0) -> object:
        """The value whose lines are indented by at least so much; None if there is none."""
        if depth > DEPTH:
            raise Malformed("too deep")
        line = self.peek()
        if line is None or line[0] < least:
            return None
        indent, content = line
        if _item(content):
            return self.items(indent, depth)
        if _KEY.match(content):
            return self.entries(indent, depth)
        self.at += 1
        return self.value(content, least - 1, depth)

    def items(self, indent: int, depth: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and _item(line[1]):
            rest = line[1][1:].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1, depth + 1))
            elif _item(rest) or _KEY.match(rest):
                inner = indent + len(line[1]) - len(rest)
                self.lines[self.at] = " " * inner + rest
                out.append(self.node(inner, depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest, indent, depth))
        if line and line[0] > indent:
            raise Malformed("indented without a reason")
        return out

    def entries(self, indent: int, depth: int) -> dict:
        out: dict[str, object] = {}
        while (line := self.peek()) and line[0] == indent and not _item(line[1]):
            key = _KEY.match(line[1])
            if not key:
                raise Malformed("key expected")
            quoted = _QUOTED.fullmatch(key[1])
            name, rest = _unquoted(quoted) if quoted else _name(scalar(key[1])), line[1][key.end() :]
            self.at += 1
            if rest and not rest.startswith("#"):
                out[name] = self.value(rest, indent, depth)
                continue
            below = self.peek()
            same = below is not None and below[0] == indent and _item(below[1])
            out[name] = self.node(indent if same else indent + 1, depth + 1)
        if line and (line[0] > indent or _item(line[1]) and line[0] == indent):
            raise Malformed("indented without a reason")
        return out

    def value(self, rest: str, indent: int, depth: int) -> object:
        """What stands behind a key or a dash, whose lines go on where they are indented by more than these."""
        if rest[0] in "|>":
            return self.block(rest, indent)
        if rest[0] in "[{":
            try:
                found, end = _flow(rest, 0, depth)
            except Malformed:
                rest = self.folded(rest, indent)
                found, end = _flow(rest, 0, depth)
            _end(rest[end:])
            return found
        if rest[0] in "\"'":
            rest = rest if _QUOTED.match(rest) else self.folded(rest, indent)
            if not (quoted := _QUOTED.match(rest)):
                raise Malformed("quote not closed")
            _end(rest[quoted.end() :])
            return _unquoted(quoted)
        parts, done = [], False
        while not done:
            parts.append(_COMMENT.sub("", rest))
            start, line = self.at, None if _COMMENT.search(rest) else self.peek()
            done = line is None or line[0] <= indent
            if not done:
                gap = self.lines[start : self.at]
                if any(x.strip() for x in gap):
                    raise Malformed("text behind a comment")
                parts.append("\n" * len(gap) or " ")
                rest, self.at = line[1], self.at + 1
        text = "".join(parts)
        if text in ("-", "?") or text.startswith((*_FORBIDDEN, '"', "'", "- ", "? ")) or ": " in text or text.endswith(":"):
            raise Malformed("not a plain scalar")
        return scalar(text)

    def folded(self, first: str, indent: int) -> str:
        """A line with all that follow it and are indented by more, joined by a space, or by the line ends of blank ones between."""
        parts, run = [first], 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            content = line.strip()
            if content and len(line) - len(line.lstrip(" ")) <= indent:
                break
            self.at += 1
            if not content:
                run += 1
                continue
            last = parts[-1]
            if first[0] == '"' and (len(last) - len(last.rstrip("\\"))) % 2:
                parts[-1] = last[:-1] + "\n" * run
            else:
                parts.append("\n" * run or " ")
            parts.append(content)
            run = 0
        return "".join(parts)

    def block(self, head: str, indent: int) -> str:
        """A block scalar: its lines kept, or folded where they are not blank or indented by more."""
        style = re.fullmatch(r"([|>])(?:([-+]?)([1-9]?)|([1-9])([-+]))(?:\s+#.*)?", head)
        if not style:
            raise Malformed("unknown block")
        lines, deep = [], int(style[3] or style[4] or 0) + max(indent, 0) if style[3] or style[4] else 0
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip("\r")
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                deep = deep or lead
                if lead < deep or deep <= indent:
                    break
            lines.append(line[deep:] if deep else "")
            self.at += 1
        body = len(lines)
        while body and not lines[body - 1]:
            body -= 1
        kept, keep = lines[:body], (style[2] or style[5] or "")
        text = kept[0] if kept else ""
        run = 0  # blank lines since the last line
        for before, line in zip(kept, kept[1:]):
            if style[1] == "|":
                text += "\n" + line
            elif not line:
                run += 1
            else:
                loose = line[0] in " \t" or text.rsplit("\n", 1)[-1][:1] in (" ", "\t")
                text += ("\n" * (run + loose) if run or loose else " ") + line
                run = 0
        tail = {"-": "", "+": "\n" * (len(lines) - body + 1 if kept else len(lines))}.get(keep, "\n" if kept else "")
        return text + tail


def _item(content: str) -> bool:
    return content == "-" or content.startswith(("- ", "-\t"))


def read(block: str) -> dict:
    """The map of a front matter block; raises :class:`Malformed`. A block without a key is an empty map."""
    lines = _Lines(block)
    found = lines.node(0)
    if lines.peek() is not None or not isinstance(found, dict | None):
        raise Malformed("not a map of keys")
    return found or {}


def _json(block: str | None) -> str | None:
    try:
        return None if block is None else json.dumps(read(block), allow_nan=False)
    except ValueError:  # malformed, or a number that no double holds
        return None


def variant(meta: Column) -> Column:
    """A front matter block as a variant, read by paths such as ``$.authors[0].name``; null if it is malformed or null.

    Of repeated keys the last counts. A date is text in the variant; ``variant_get(v, path, 'date')``
    reads it as one.
    """

    @F.pandas_udf("string")
    def as_json(blocks: pd.Series) -> pd.Series:
        return blocks.map(_json)

    return F.try_parse_json(as_json(meta))


def frontmatter(text: Column) -> Column:
    """(data, body): a leading block as a variant and what follows it; data is null and the body the text if there is none or it is malformed."""
    data = variant(F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 1)))
    return F.struct(data.alias("data"), F.when(data.isNotNull(), F.regexp_extract(text, FRONTMATTER, 2)).otherwise(text).alias("body"))
