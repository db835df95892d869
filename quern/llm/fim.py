"""Fill-in-middle transformation, with cuts found by rank and select over packed boundary bits.

A text is cut at two places into prefix, middle and suffix, and written either as
``<P>prefix<S>suffix<M>middle`` (psm) or as ``<S>suffix<P>prefix<M>middle`` (spm); some texts
stay plain. The places and the form come from a hash of a seed and the row's key, so a rerun
gives the same and no row depends on another: nothing is shuffled.

Units are code points. For the UTF-8 bytes of a few megabytes of texts at a time a bit vector has
a one for each byte that starts a code point; it is packed into 64-bit words, and a directory has the
number of ones before each block of 512 bits (:class:`Boundaries`). The ones between a text's ends
are its length n, and a cut after k units is the place of a text's k-th one: a binary search
in the directory, a look at the eight words of the block, and one at the bits of a word. Texts are
never decoded.

Defined results: a null text is an empty one, and that stays plain, as does a text that holds one of the
marks; a null key counts as an empty one. Equal texts of different keys are cut at different places; repeated
rows give equal rows. A very long text is a slice of its own (its bits take an eighth of it). An empty
table gives an empty one. Other columns pass through, whatever their names; those named n, form,
prefix_chars, middle_chars or output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import over_batches

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a block of the directory, in words of 64.
WORDS = 8
#: Bytes of texts whose boundaries are packed at a time; a longer text is packed alone.
BYTES_AT_ONCE = 1 << 22


class Boundaries:
    """The starts of code points in UTF-8 bytes as a packed bit vector with a directory of its blocks' ones."""

    def __init__(self, data: np.ndarray):
        size = -(-(len(data) + 1) // (64 * WORDS)) * 64 * WORDS  # a bit more than bytes, so the end has a place
        bits = np.zeros(size, bool)
        bits[: len(data)] = (data & 0xC0) != 0x80
        self.words = np.packbits(bits, bitorder="little").view(np.uint64).reshape(-1, WORDS)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.inside = np.cumsum(ones, axis=1) - ones  # of a block, before each of its words
        self.directory = np.concatenate(([0], np.cumsum(ones.sum(axis=1))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before the bytes ``at``."""
        block, word, bit = at // (64 * WORDS), at // 64 % WORDS, at % 64
        below = self.words[block, word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.directory[block] + self.inside[block, word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Bytes at which the code points number ``k`` (from 0) start."""
        block = np.searchsorted(self.directory, k, "right") - 1
        left = k - self.directory[block]
        word = (self.inside[block] <= left[:, None]).sum(axis=1) - 1
        left -= self.inside[block, word]
        ones = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = np.argmax(np.cumsum(ones, axis=1) == left[:, None] + 1, axis=1)
        return block * (64 * WORDS) + word * 64 + bit


def draws(key: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cuts(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts between ``ends`` of the bytes: n, the units before the two cuts, and the cuts' bytes (rows of two)."""
    bounds = Boundaries(data)
    ranks = bounds.rank(ends)
    n = ranks[1:] - ranks[:-1]
    units = np.sort(np.stack([first % (n + 1), second % (n + 1)], axis=1), axis=1)
    at = np.repeat(ends[1:, None], 2, axis=1)
    inner = units < n[:, None]
    at[inner] = bounds.select((ranks[:-1, None] + units)[inner])
    return n, units[:, 0], units[:, 1], at


def _slices(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", output: str = "output", seed: int = 1, percent: int = 90, spm_percent: int = 20, keep_text: bool = True) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and ``output``; ``percent`` of the rows are cut, ``spm_percent`` of these as spm."""
    long = T.LongType()
    added = [("n", long), ("form", T.StringType()), ("prefix_chars", long), ("middle_chars", long), (output, T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in {*dict(added), *([] if keep_text else [text])}]
    needed = list(dict.fromkeys([key, text, *[f.name for f in kept]]))
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            column = batch.column(text).cast(pa.large_string()).fill_null("")
            every = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            drawn = np.array([draws(k, seed) for k in batch.column(key).to_pylist()], np.int64).reshape(-1, 4)
            for lo, hi in _slices(every, BYTES_AT_ONCE):
                data, h = whole[every[lo] : every[hi]], drawn[lo:hi]
                ends = every[lo : hi + 1] - every[lo]
                n, before, upto, at = cuts(data, ends, h[:, 0], h[:, 1])
                raw, forms, out = data.tobytes(), [], []
                for i in range(hi - lo):
                    a, (b, c), d = int(ends[i]), at[i].tolist(), int(ends[i + 1])
                    body = raw[a:d]
                    if not body or h[i, 2] % 100 >= percent or any(x in body for x in marks):
                        forms.append("plain")
                        out.append(body)
                    elif h[i, 3] % 100 < spm_percent:
                        forms.append("spm")
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                    else:
                        forms.append("psm")
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                plain = np.array([f == "plain" for f in forms])
                found = [pa.array(n), pa.array(forms), pa.array(before, mask=plain), pa.array(upto - before, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(lo, hi - lo) for f in kept], *found], names=schema.names)

    return over_batches(df.select(*needed), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    def behind(x: Column, mark: str) -> Column:
        return F.substring(x, F.instr(x, mark) + len(mark), F.length(x))

    psm = F.concat(before(behind(output, PREFIX), SUFFIX), behind(output, MIDDLE), before(behind(output, SUFFIX), MIDDLE))
    spm = F.concat(before(behind(output, PREFIX), MIDDLE), behind(output, MIDDLE), before(behind(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
