"""Language identification by nearest centroids of character n-grams.

A text is a vector of hashed letter n-grams (one to three, with word boundaries), damped,
weighted by inverse document frequency and normalised. Each language is described by several
centroids, found by spherical k-means over a bounded sample of its labelled texts. The
language of the centroid with the largest cosine is predicted. A text is rejected if its largest
cosine lies below 0.7 of what 99.5 % of the sample texts of that language reach, each measured
with centroids of the other parts of the sample. Short texts reach less, so there is a limit for
each of ``FLOORS`` letters, and a text has that of the largest floor it reaches: below the last
floor it is 0.7 of what all sample texts of such a length and 97 % of as short beginnings of
longer ones reach. No limit is below 0.2 of what whole sample texts reach.

The sample is ``cap`` texts a language (documented bound: at most 1000 languages, and
``sample_chars`` characters of all texts in it); everything else runs over all rows.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0 and is
rejected. A text with letters always gets a learned language. Equal cosines go to the language
that sorts first. Without labelled rows every text is ``und`` and rejected. Repeated rows get
equal results, whatever stands beside them. A very long text is counted whole, in blocks. An empty
table gives an empty one. Other columns pass through, those named lang_pred, score or rejected
are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import middle, over_batches, slices, stratified, strings, within_budget

DIMS = 4096
UNKNOWN = "und"
#: Letters from which a limit of its own holds.
FLOORS = (1, 8, 16, 32, 64, 128, 256)
FOLDS = 4


@cache
def letters() -> np.ndarray:
    """For every code point the code of its lower-case letter, 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def blocks(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut where no letter stands on either side.

    So the parts have the n-grams of the whole; only a run of letters longer than a part is cut
    inside, and loses the few n-grams that reach over the cut.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut > at and text[cut].isalpha():
            cut -= 1
        stop = cut if cut > at else at + size
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def counts(texts: list[str], block: int = 1 << 19) -> np.ndarray:
    """Hashed n-gram counts of each text, one row each; a long text is counted in blocks."""
    out = np.zeros((len(texts), DIMS), np.float32)
    part: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in blocks(text, block):
            if part and held + len(piece) > block:
                _count(part, out)
                part, held = [], 0
            part.append((i, piece))
            held += len(piece)
    if part:
        _count(part, out)
    return out


def _count(parts: list[tuple[int, str]], out: np.ndarray) -> None:
    """Add the n-grams of texts (row of ``out``, text) to their rows."""
    codes = [letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for _, t in parts]
    # a boundary before each text and one behind the last; a run of what is no letter is one boundary
    flat = np.concatenate([x for c in codes for x in (np.zeros(1, np.uint32), c)] + [np.zeros(1, np.uint32)])
    starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    keep[starts] = True
    edges = (np.cumsum(keep) - 1)[starts].tolist()
    c = flat[keep]
    real = c != 0
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(33 - DIMS.bit_length())
    g1, g2, g3 = ((x >> shift).astype(np.int64) for x in (one, two, three))
    some = real[:-1] | real[1:]
    for (row, _), a, b in zip(parts, edges[:-1], edges[1:], strict=True):
        # places a to b: the text's boundaries and all between; three-grams are kept round each letter
        if b - a > 1:
            grams = (g1[a:b][real[a:b]], g2[a:b][some[a:b]], g3[a : b - 1][real[a + 1 : b]])
            out[row] += np.bincount(np.concatenate(grams), minlength=DIMS)


def letter_ends(text: str) -> np.ndarray:
    """The place after each letter of a text."""
    return np.flatnonzero(letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]) + 1


def letter_count(text: str, block: int = 1 << 19) -> int:
    return sum(len(letter_ends(text[at : at + block])) for at in range(0, len(text), block))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each, of length 1
    of: np.ndarray  # language of each centroid
    least: np.ndarray  # a language's smallest accepted cosine from each of FLOORS letters

    def vectors(self, texts: list[str]) -> np.ndarray:
        v = np.log1p(counts(texts)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether each text is rejected."""
        n = len(texts)
        lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        if not self.languages:
            return lang, score, rejected
        for a, b in slices(texts, 1 << 19):
            for lo in range(a, b, 512):
                part = texts[lo : min(b, lo + 512)]
                spoken = np.array([letter_count(t) for t in part])
                floor = np.maximum(np.searchsorted(FLOORS, spoken, "right") - 1, 0)
                cos = self.vectors(part) @ self.centroids.T
                best = np.full((len(part), len(self.languages)), -1.0)
                for k, language in enumerate(self.of):
                    best[:, language] = np.maximum(best[:, language], np.round(cos[:, k], 6))
                top = best.argmax(axis=1)
                value = best[np.arange(len(part)), top]
                for i in np.flatnonzero(spoken).tolist():
                    lang[lo + i] = self.languages[top[i]]
                    score[lo + i] = min(1.0, max(0.0, float(value[i])))
                    rejected[lo + i] = value[i] < self.least[top[i], floor[i]]
        return lang, score, rejected


def fit(texts: list[str], langs: list[str], clusters: int = 4, rounds: int = 10, accept: float = 0.995, slack: float = 0.7, accept_begun: float = 0.97, weakest: float = 0.2, seed: int = 7) -> LanguageModel:
    """Centroids of the languages; ``slack`` times the cosine that ``accept`` of the sample reaches unseen is the least accepted."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, len(FLOORS))))
    counted = lambda ts: np.concatenate([counts(ts[a:b]) for a, b in slices(ts, 1 << 19)])
    raw = counted(texts)
    idf = (np.log((1 + len(texts)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)

    def vectors(n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    v = vectors(raw)
    which = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)

    def means(own: np.ndarray) -> np.ndarray:
        c = own[rng.permutation(len(own))[:clusters]]
        for _ in range(rounds):
            nearest = (own @ c.T).argmax(axis=1)
            sums = np.stack([own[nearest == j].sum(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        return c

    centroids, of, least = [], [], np.zeros((len(names), len(FLOORS)))
    for k in range(len(names)):
        at = np.flatnonzero(which == k)
        centroids.append(means(v[at]))
        of += [k] * len(centroids[-1])
        fold = rng.permutation(len(at)) % FOLDS
        others = [means(v[at[fold != f]]) for f in range(FOLDS)] if len(at) >= 2 * FOLDS else [centroids[-1]] * FOLDS
        reached = lambda x, of_text, others=others, fold=fold: np.array([(u @ others[fold[i]].T).max() for u, i in zip(x, of_text, strict=True)])
        whole = reached(v[at], range(len(at)))
        ends = [letter_ends(texts[i]) for i in at]
        size = np.array([len(e) for e in ends])
        for j, (low, high) in enumerate(zip(FLOORS, (*FLOORS[1:], None), strict=True)):
            if high is None:
                seen = whole[size >= low] if (size >= low).any() else whole
                least[k, j] = slack * np.quantile(seen, 1 - accept)
                continue
            least[k, j] = slack * whole[(size >= low) & (size < high)].min(initial=1.0)
            if longer := np.flatnonzero(size >= high).tolist():
                begun = vectors(counted([texts[at[i]][: ends[i][low - 1]] for i in longer]))
                least[k, j] = min(least[k, j], slack * np.quantile(reached(begun, longer), 1 - accept_begun))
        least[k] = np.minimum(least[k], least[k, -1])
        least[k] = np.maximum(least[k], weakest * np.quantile(whole, 1 - accept))
    return LanguageModel(names, idf, np.concatenate(centroids).astype(np.float32), np.array(of), least)


def learn(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", cap: int = 400, sample_chars: int = 8_000_000, longest: int = 20_000) -> LanguageModel:
    """Fit on about ``cap`` labelled texts of each language, at most ``sample_chars`` characters in all.

    The sample is bounded, what is learned is used on whole texts: no more than 20,000 texts come to
    the driver, of a text longer than ``longest`` that many characters from its middle. Each language
    may take an even share of ``sample_chars``, in order of a hash of its rows.
    """
    known = labelled.where(F.col(lang).isNotNull()).select(key, lang, middle(text, longest).alias(text))
    rows = stratified(known, key, lang, cap).select(key, lang, text).collect()
    chosen = [r for r in within_budget(rows, lang, text, sample_chars) if any(map(str.isalpha, r[text]))]
    return fit([r[text] for r in chosen], [r[lang] for r in chosen])


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score and rejected."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in added} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few centroids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = shared.value.predict(strings(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return over_batches(df.select(text, *[f.name for f in kept if f.name != text]), run, schema)
