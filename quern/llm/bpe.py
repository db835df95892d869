"""BPE encoding and decoding by batched merge rounds in numpy.

The merges of many words run at once: the symbols of all words lie in one flat array,
adjacent symbols of a word form pair keys, and a binary search over the sorted keys of the
merge table finds each pair's rank. Each round merges, in every word, the pair of lowest
rank wherever it stands, until no word has a pair of the table. Only the merge loop is
ours; which vocabulary to use is a parameter (a ``tokenizers`` JSON file of a BPE model
with byte-level symbols and a word end).

Defined results: null and empty texts give no ids and an empty decoded text; of equal ranks in a
word all are merged from the left; repeated rows give equal rows; a very long text is encoded whole,
chunk by chunk between white space; an empty table gives an empty one. Other columns of the input
are kept, and those named like a result are replaced. A file whose added tokens strip white space
or need word ends raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import over_batches, slices, strings

#: What a worker remembers of chunks between white space, in chunks (about 150 bytes each).
CACHE = 120_000

#: White space to str.split() that is no white space to the pre-tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class BpeModel:
    """Vocabulary, merge table and splitting rules of one tokenizer file."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("the file must hold a plain BPE model")
        if any(x.get(flag) for x in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens must stand for themselves alone")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        every = self.vocab | self.special
        self.names = [""] * (max(every.values()) + 1)
        for s, i in every.items():
            self.names[i] = s
        left, right, made = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left[k], right[k], made[k] = self.vocab[a], self.vocab[b], self.vocab[a + b]
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        # bytes_char of byte-level vocabularies: printable Latin-1 stays, the rest moves up in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbols = {b: chr(b) for b in printable}
        for n, b in enumerate(b for b in range(256) if b not in symbols):
            symbols[b] = chr(256 + n)
        self.symbols = symbols
        self.inner = np.array([self.vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[symbols[b] + self.end] for b in range(256)], np.int64)
        #: Chunks that need no library: Latin letters and then ASCII marks, if the file's own rules agree.
        self.simple = re.compile(r"([A-Za-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
        letters = [chr(c) for c in range(0x41, 0x100) if self.simple.fullmatch(chr(c))]
        marks = [chr(c) for c in range(33, 127) if self.simple.fullmatch("a" + chr(c))]
        probes = [a + b + m for a, b in zip(letters, letters[1:] + letters[:1], strict=True) for m in ("", *marks, "?!", "...")]
        if any(self._simply(x) != self._by_library(x) for x in probes):
            self.simple = re.compile(r"(?!)")
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None

    def pieces(self, chunk: str) -> list[bytes]:
        """The words of a chunk without white space, as bytes after normalisation."""
        return self._simply(chunk) or self._by_library(chunk)

    def _simply(self, chunk: str) -> list[bytes] | None:
        m = self.simple.fullmatch(chunk)
        return m and [x.lower().encode() for x in m.groups() if x]

    def _by_library(self, chunk: str) -> list[bytes]:
        normal = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
        back = self._bytes_of
        return [bytes(back[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    @property
    def _bytes_of(self) -> dict[str, int]:
        if not hasattr(self, "_back"):
            self._back = {c: b for b, c in self.symbols.items()}
        return self._back

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        ids[ends[lengths > 0]] = self.last[flat[ends[lengths > 0]]]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_ids, done_owner = [], []
        none = len(self.keys)
        # rank and result of the pair that starts at each symbol; only pairs with a new symbol are looked up again
        rank = np.full(len(ids), none, np.int32)
        made = np.zeros(len(ids), np.int64)
        stale = np.arange(len(ids) - 1)
        while len(ids):
            if len(stale):
                key = (ids[stale] << 32) | ids[stale + 1]
                at = np.minimum(np.searchsorted(self.keys, key), none - 1)
                found = (self.keys[at] == key) & (owner[stale] == owner[stale + 1])
                rank[stale] = np.where(found, self.ranks[at], none)
                made[stale] = self.made[at]
            rank[-1] = none
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            starts = np.flatnonzero(first)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            keep = best < none
            pos = np.flatnonzero(keep & (rank == best))
            if not keep.all():  # finished words leave the array
                done_ids.append(ids[~keep])
                done_owner.append(owner[~keep])
            # of overlapping hits (one symbol three times in a row) the first, third, ... count
            if len(pos) > 1:
                new_run = np.concatenate(([True], np.diff(pos) != 1))
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run_start) % 2 == 0]
            ids[pos] = made[pos]
            changed = np.zeros(len(ids), bool)
            changed[pos] = True
            keep[pos + 1] = False
            ids, owner, rank, made, changed = ids[keep], owner[keep], rank[keep], made[keep], changed[keep]
            stale = np.flatnonzero(changed[:-1] | changed[1:])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes and decodes texts in batches; remembers what the first CACHE chunks gave."""

    def __init__(self, path: str):
        self.model = BpeModel(path)
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of the chunks that are not remembered; while there is room, they will be."""
        new = [c for c in chunks if c not in self.known]
        got: dict[str, bytes] = {}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            pieces = [self.model.pieces(c) for c in part]
            ids, counts = self.model.merge([w for ws in pieces for w in ws])
            per_word = np.concatenate(([0], np.cumsum(counts)))
            edges = (4 * per_word[np.concatenate(([0], np.cumsum([len(ws) for ws in pieces])))]).tolist()
            raw = ids.astype("<u4").tobytes()
            got.update(zip(part, map(raw.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True))
        for c in new[: max(0, CACHE - len(self.known))]:
            self.known[c] = got[c]
        return got

    def _chunks(self, text: str) -> list[str | int]:
        """Chunks between white space; a special token in the text is its id."""
        if not any(map(text.__contains__, self.model.special)):
            return self._plain(text)
        out: list[str | int] = []
        at = 0
        for m in self.model.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.model.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATORS):
            gap = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in SEPARATORS)
            return [c for c in re.split(f"[{re.escape(gap)}]+", text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        out = []
        for a, b in slices(texts, 1 << 20):
            split = [self._chunks(t) for t in texts[a:b]]
            new = self._learn({c for c in set().union(*split) if isinstance(c, str)})
            for s, t in zip(split, texts[a:b], strict=True):
                got = map(self.known.get, s, map(new.get, s))
                if any(map(t.__contains__, self.model.special)):
                    got = (c.to_bytes(4, "little") if isinstance(c, int) else g for c, g in zip(s, got, strict=True))
                raw = b"".join(got)
                out.append((raw, self.decode(raw)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, as a tokenizer without a decoder gives it: tokens joined by spaces."""
        return " ".join(map(self.model.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str, text: str = "text", with_ids: bool = True, with_decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` and the text ``decoded`` from them.

    ``path`` is the tokenizer file, on every executor at the same place.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_decoded:
        added.append(T.StructField("decoded", T.StringType()))
    names = {f.name for f in added} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            texts = strings(batch.column(text))
            for a, b in slices(texts, 1 << 20):
                part = batch.slice(a, b - a)
                got = coder.encode(texts[a:b])
                columns = [part.column(f.name) for f in kept]
                columns += [pa.array([len(r) // 4 for r, _ in got], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r, _ in got], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in got], pa.string())]
                if with_ids:
                    flat = np.frombuffer(b"".join(r for r, _ in got), "<u4").astype(np.int32)
                    edges = np.concatenate(([0], np.cumsum([len(r) // 4 for r, _ in got]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)))
                if with_decoded:
                    columns.append(pa.array([t for _, t in got], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    needed = [text, *[f.name for f in kept if f.name != text]]
    return over_batches(df.select(*needed), run, schema)
