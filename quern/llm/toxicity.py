"""Toxicity scores by a small convolutional text classifier, trained and applied in numpy.

A word is the sum of hashed embeddings of itself and of its five-byte pieces. Filters of one,
two and three words run over the text, each is pooled by its maximum, and a logistic layer
reads the maxima. In training, gradients flow through the winning positions only. Because a
filter over words is a sum of one product per word, scoring projects each distinct word once
and adds looked-up rows.

The logit at which a text counts as toxic is calibrated on held-back examples for each
language; the language of a text is read off its own function words, so neither it nor any
other column enters a score. The score is 0.7 at the calibrated logit and grows with the logit.

The classifier is fitted on a bounded sample (``cap`` labelled rows a class, ``sample_chars``
characters); scoring reads whole texts, long ones in blocks. Defined results: null, empty and
wordless texts score 0; repeated rows get equal scores; a score of exactly 0.7 is toxic; without
examples of both classes every score is 0. Of languages whose function words are equally frequent
the first counts. An empty table gives an empty one. Other columns pass through, those named score
or predicted are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import middle, over_batches, stratified, strings, within_budget

BUCKETS, DIM, WIDTHS, FILTERS, PIECE = 1 << 15, 16, (1, 2, 3), 8, 5
COLUMNS = FILTERS * sum(WIDTHS)
THRESHOLD = 0.7

#: Common function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "are", "this", "be", "by"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "du", "que", "est", "dans", "pour", "qui", "sur", "au"],
    "de": ["der", "die", "und", "das", "von", "zu", "den", "mit", "ist", "nicht", "auf", "für", "ein", "eine", "im"],
    "es": ["el", "los", "las", "que", "y", "en", "del", "por", "con", "para", "su", "una", "se", "lo", "como"],
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

#: Words that are scored at a time.
WORDS_AT_ONCE = 1 << 17

#: ASCII marks and controls part words; letters, digits and bytes beyond ASCII make them.
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_GAPS).split()


def pieces(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of whole words; buckets of five-byte pieces and the words they belong to."""
    n = len(distinct)
    flat = np.frombuffer(b"<" + b"><".join(distinct) + b">", np.uint8).astype(np.uint32) + np.uint32(1)
    length = np.fromiter(map(len, distinct), np.int64, n) + 2
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    place = np.arange(len(flat)) - start[owner]
    power = np.full(int(length.max()), 0x01000193, np.uint32)
    power[0] = 0x9E3779B1
    power = np.cumprod(power, dtype=np.uint32)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    whole = mix(np.add.reduceat(flat * power[place], start, dtype=np.uint32))
    if len(flat) < PIECE:
        return whole.astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = flat[: len(flat) - PIECE + 1].copy()
    for k in range(1, PIECE):
        g = g * np.uint32(0x01000193) + flat[k : len(flat) - PIECE + 1 + k]
    inside = owner[: len(g)] == owner[PIECE - 1 :]
    return whole.astype(np.int64), mix(g[inside]).astype(np.int64), owner[: len(g)][inside]


def blocks(text: str, size: int) -> Iterator[tuple[list[bytes], int, bool]]:
    """Words of a text in blocks of about ``size`` characters, how many of them end the block before, and whether more come."""
    at, before = 0, []
    while len(text) - at > size:
        stop = at + size
        while stop > at and ord(text[stop]) < 128 and text[stop].isalnum() or ord(text[stop]) >= 128 and stop > at:
            stop -= 1
        stop = stop if stop > at else at + size  # a word longer than a block is cut
        own = words(text[at:stop])
        yield before + own, len(before), True
        before, at = (before + own)[-(max(WIDTHS) - 1) :], stop
    yield before + words(text[at:] if at else text), len(before), False


def indexed(split: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the texts as their places one after the other, and each text's length.

    Place 0 is padding; every text ends with as much of it as the widest filter needs.
    """
    place: dict[bytes, int] = {b"": 0}
    for ws in split:
        for w in dict.fromkeys(ws):
            place.setdefault(w, len(place))
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    lengths = np.array([len(ws) + len(pad) for ws in split])
    ids = np.concatenate([x for ws in split for x in (np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)), pad)])
    return list(place), ids, lengths


def embed(table: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    whole, piece, owner = pieces(distinct)
    out = table[whole]
    if len(owner):
        first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
        out[owner[first]] += np.add.reduceat(table[piece], first, axis=0)
    return out


def spans() -> Iterator[tuple[int, int, slice]]:
    """For each filter group and word in it: the width, the word's place, its columns."""
    at = 0
    for w in WIDTHS:
        for j in range(w):
            yield w, j, slice(at, at + FILTERS)
            at += FILTERS


def convolve(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filter values at every place; none at padding, where a filter would reach into the next text."""
    out = np.zeros((len(ids), FILTERS * len(WIDTHS)), np.float32)
    for w, j, cols in spans():
        k = WIDTHS.index(w)
        out[: len(ids) - j, k * FILTERS : (k + 1) * FILTERS] += rows[:, cols][ids[j:]]
    out[ids == 0] = -np.inf
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray
    project: np.ndarray
    weights: np.ndarray
    bias: float
    levels: dict[str, float]
    trained: bool = True

    def logits(self, texts: list[str], block: int = 1 << 20) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Logit and guessed language of each text, and whether it has a word.

        A long text is read in blocks, each with the words before it that a filter may reach over.
        """
        peak = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        hits = np.zeros((len(texts), len(FUNCTION_WORDS)), np.float32)
        part: list[tuple[int, list[bytes], int, bool]] = []
        held = 0
        for i, text in enumerate(texts):
            for piece in blocks(text, block):
                if held and held + len(piece[0]) > WORDS_AT_ONCE:
                    self._read(part, peak, hits)
                    part, held = [], 0
                part.append((i, *piece))
                held += len(piece[0])
        if part:
            self._read(part, peak, hits)
        best = hits.argmax(axis=1)
        guess = [LANGUAGES[b] if h else "other" for b, h in zip(best.tolist(), (hits.max(axis=1) > 0).tolist(), strict=True)]
        return np.maximum(peak, 0) @ self.weights + self.bias, guess, np.isfinite(peak).any(axis=1)

    def _read(self, part: list[tuple[int, list[bytes], int, bool]], peak: np.ndarray, hits: np.ndarray) -> None:
        """Raise the filters' peaks and count the function words of blocks (row, words, words read before, more to come)."""
        distinct, ids, lengths = indexed([own for _, own, _, _ in part])
        rows = np.concatenate([embed(self.table, distinct[i : i + 50_000]) @ self.project for i in range(0, len(distinct), 50_000)])
        rows[0] = 0
        starts = np.cumsum(lengths) - lengths
        row = np.array([p[0] for p in part])
        values = convolve(rows, ids)
        for end, (_, own, _, more) in zip((starts + lengths - max(WIDTHS) + 1).tolist(), part, strict=True):
            for k, w in enumerate(WIDTHS):
                if more and w > 1:  # the next block has what a filter reads from the last words on
                    values[end - min(w - 1, len(own)) : end, k * FILTERS : (k + 1) * FILTERS] = -np.inf
        np.maximum.at(peak, row, np.maximum.reduceat(values, starts, axis=0))
        known = np.zeros((len(distinct), len(FUNCTION_WORDS)), np.float32)
        place = {w: i for i, w in enumerate(distinct)}
        for k, ws in enumerate(FUNCTION_WORDS.values()):
            for w in ws:
                if (i := place.get(w.encode())) is not None:
                    known[i, k] = 1
        new = known[ids]
        for start, (_, _, carried, _) in zip(starts.tolist(), part, strict=True):
            new[start : start + carried] = 0
        np.add.at(hits, row, np.add.reduceat(new, starts, axis=0))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        z, guess, worded = self.logits(texts)
        z = (z - np.array([self.levels[g] for g in guess])) + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(worded, np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6), 0.0)


def untrained() -> ToxicityModel:
    return ToxicityModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, COLUMNS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, dict.fromkeys(LANGUAGES, 0.0), trained=False)


def level(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit in the middle of the gap where the weighted F1 is highest."""
    order = np.argsort(z)
    z, y, weight = z[order], y[order], weight[order]
    hits = np.cumsum((weight * y)[::-1])[::-1]
    wrong = np.cumsum((weight * (1 - y))[::-1])[::-1]
    f1 = 2 * hits / (hits + wrong + hits[0])
    gap = np.diff(np.concatenate(([z[0] - 1], z)))
    at = max(range(len(z)), key=lambda i: (round(f1[i], 9), gap[i]))
    return float(z[at] - gap[at] / 2)


def fit(texts: list[str], toxic: list[int], ratio: float = 1.0, steps: int = 900, batch: int = 32, rate: float = 0.15, seed: int = 3) -> ToxicityModel:
    """Train on the examples; ``ratio`` is how many times rarer good examples are here than among all rows."""
    y = np.array(toxic, float)
    if len(set(toxic)) < 2:
        return untrained()
    rng = np.random.default_rng(seed)
    model = ToxicityModel((rng.normal(size=(BUCKETS, DIM)) * 0.05).astype(np.float32), (rng.normal(size=(DIM, COLUMNS)) * 0.3).astype(np.float32), np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0, dict.fromkeys(LANGUAGES, 0.0))
    order = rng.permutation(len(texts))
    back, train = order[: len(order) // 5], order[len(order) // 5 :]
    acc_t, acc_p, acc_w, acc_b = np.full(BUCKETS, 1e-3), np.full(model.project.shape, 1e-3), np.full(model.weights.shape, 1e-3), 1e-3
    prior = (y[train] == 0).sum() / max(1, (y[train] == 1).sum())
    parts = list(spans())
    for _ in range(max(6, min(40, steps * batch // len(train)))):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            own = train[at : at + batch]
            distinct, ids, lengths = indexed([words(texts[i]) for i in own])
            emb = embed(model.table, distinct)
            emb[0] = 0
            rows = emb @ model.project
            values = convolve(rows, ids)
            starts = np.cumsum(lengths) - lengths
            where = np.stack([s + values[s : s + n].argmax(axis=0) for s, n in zip(starts, lengths, strict=True)])
            peak = np.take_along_axis(values, where, axis=0)
            z = np.maximum(peak, 0) @ model.weights + model.bias
            weight = np.where(y[own] == 1, min(prior, 10.0), 1.0)
            d = (1 / (1 + np.exp(-z)) - y[own]) * weight / len(own)
            g_w, g_b = np.maximum(peak, 0).T @ d, d.sum()
            g_peak = np.outer(d, model.weights) * (peak > 0)
            g_rows = np.zeros_like(rows)
            for w, j, cols in parts:
                k = WIDTHS.index(w)
                lo = np.arange(cols.start, cols.stop)
                spot = np.minimum(where[:, k * FILTERS : (k + 1) * FILTERS] + j, len(ids) - 1)
                np.add.at(g_rows, (ids[spot], np.broadcast_to(lo, spot.shape)), g_peak[:, k * FILTERS : (k + 1) * FILTERS])
            g_rows[0] = 0
            used = np.flatnonzero(np.abs(g_rows).sum(axis=1) > 0)
            g_project = emb.T @ g_rows
            if len(used):
                g_emb = g_rows[used] @ model.project.T
                whole, piece, owner = pieces([distinct[i] for i in used])
                bucket = np.concatenate((whole, piece))
                rows_of = np.concatenate((np.arange(len(used)), owner))
                touched, inverse = np.unique(bucket, return_inverse=True)
                g_table = np.zeros((len(touched), DIM), np.float32)
                np.add.at(g_table, inverse, g_emb[rows_of])
                acc_t[touched] += (g_table**2).mean(axis=1)
                model.table[touched] -= (rate * g_table / np.sqrt(acc_t[touched])[:, None]).astype(np.float32)
            acc_p += g_project**2
            acc_w += g_w**2
            acc_b += g_b**2
            model.project -= (0.3 * rate * g_project / np.sqrt(acc_p)).astype(np.float32)
            model.weights -= (0.3 * rate * g_w / np.sqrt(acc_w)).astype(np.float32)
            model.bias -= float(0.3 * rate * g_b / np.sqrt(acc_b))
    z, guess, _ = model.logits([texts[i] for i in back])
    held = y[back]
    weight = np.where(held == 1, 1.0, ratio)
    common = level(z, held, weight) if 0 < held.sum() < len(held) else 0.0
    for name in LANGUAGES:
        own = np.array([g == name for g in guess], bool)
        enough = own.any() and 8 <= held[own].sum() <= own.sum() - 8
        model.levels[name] = level(z[own], held[own], weight[own]) if enough else common
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", cap: int = 1200, sample_chars: int = 8_000_000, longest: int = 20_000) -> ToxicityModel:
    """Fit on about ``cap`` labelled rows of each class, at most ``sample_chars`` characters in all.

    The sample is bounded, what is learned is used on whole texts: of a sampled text longer than
    ``longest`` so many characters from its middle come to the driver. Each class may take an even
    share of ``sample_chars``, in order of a hash of its rows.
    """
    known = labels.where(F.col(label).isNotNull()).select(key, label)
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().limit(100).collect()}
    sample = stratified(known, key, label, cap)
    rows = docs.select(key, middle(text, longest).alias(text)).join(F.broadcast(sample), key)
    unit = F.xxhash64(F.lit("toxicity"), F.col(key), F.col(text))
    rows = rows.orderBy(unit, label).limit(4 * cap).select(text, label).collect()  # a key may stand in many rows
    chosen = within_budget(rows, label, text, sample_chars)
    taken = Counter(r[label] for r in chosen)
    rarer = (sizes.get(0, 0) / max(1, taken[0])) / (sizes.get(1, 1) / max(1, taken[1])) if sizes.get(1) else 1.0
    return fit([r[text] for r in chosen], [int(r[label]) for r in chosen], rarer)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.7 on)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    names = {f.name for f in added} | (set() if keep_text else {text})
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(strings(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return over_batches(df.select(text, *[f.name for f in kept if f.name != text]), run, schema)
