"""Plain versions that several tests hold the operators against: no Spark, no batches, no shards."""

import math
from collections import Counter

import numpy as np

from quern.llm import toxicity
from quern.llm.langid import DIMS, FLOORS, UNKNOWN
from quern.llm.simhash import shingle_hashes

def jaccard(a, b):
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n)


def plain_groups(j, n, similarity=0.8):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), v in j.items():
        if v >= similarity:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def all_pairs(texts):
    sets = [np.unique(shingle_hashes(t, 5)) for t in texts]
    return {(a, b): jaccard(sets[a], sets[b]) for a in range(len(texts)) for b in range(a)}


TRIM = " \t\x0b\x0c\r"


def plain_lines(rows, max_ratio, min_pages, spare=False):
    pages, holding = Counter(h for h, _ in rows), Counter()
    for h, text in rows:
        holding.update({(h, x.strip(TRIM)) for x in (text or "").split("\n") if x.strip(TRIM)})
    out = []
    for h, text in rows:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        bad = lambda x: x.strip(TRIM) and holding[h, x.strip(TRIM)] >= min_pages and holding[h, x.strip(TRIM)] > max_ratio * pages[h]
        kept = [x for x in lines if not bad(x)]
        out.append("\n".join(kept) if not spare or any(x.strip(TRIM) for x in kept) else text)
    return out


def plain_language(model, text):
    """(language, cosine, rejected) from the definition: letter n-grams with boundaries, TF-IDF, nearest centroid."""
    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    n = sum(x > 0 for x in letters)
    if not n or not model.languages:
        return UNKNOWN, 0.0, True
    symbols = [0]
    for x in [*letters, 0]:
        if x or symbols[-1]:
            symbols.append(x)
    word = lambda x: x & 0xFFFFFFFF
    place = lambda h: h >> (33 - DIMS.bit_length())
    counts = Counter()
    for i, x in enumerate(symbols):
        if x:
            counts[place(word(x * 0x9E3779B1))] += 1
        if i + 1 < len(symbols):
            two = word((word(x * 0x9E3779B1) ^ word(symbols[i + 1] * 0x85EBCA77)) * 0xC2B2AE3D)
            counts[place(two)] += 1
            if i + 2 < len(symbols) and symbols[i + 1]:
                counts[place(word((two ^ word(symbols[i + 2] * 0x27D4EB2F)) * 0x165667B1))] += 1
    v = {k: math.log1p(c) * float(model.idf[k]) for k, c in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    cosine = [sum(x * float(c[k]) for k, x in v.items()) / length for c in model.centroids]
    best, lang = max((round(max(c for c, of in zip(cosine, model.of, strict=True) if of == k), 6), -k) for k in range(len(model.languages)))
    floor = max(i for i, f in enumerate(FLOORS) if f <= n or i == 0)
    return model.languages[-lang], best, best < model.least[-lang, floor]


def plain_toxicity(model, text):
    """The score from the definition: hashed embeddings summed a word, filters slid, maxima pooled, a logistic layer."""
    words, run = [], b""
    for b in text.lower().encode() + b" ":
        if b >= 128 or chr(b).isalnum():
            run += bytes([b])
        elif run:
            words.append(run)
            run = b""
    if not words or not model.trained:
        return 0.0

    def bucket(h):
        return (((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - toxicity.BUCKETS.bit_length() + 1)

    def embedded(word):
        symbols = [b + 1 for b in b"<" + word + b">"]
        power, whole = 0x9E3779B1, 0
        for x in symbols:
            whole = (whole + x * power) & 0xFFFFFFFF
            power = power * 0x01000193 & 0xFFFFFFFF
        out = model.table[bucket(whole)].astype(float)
        for i in range(len(symbols) - toxicity.PIECE + 1):
            h = 0
            for x in symbols[i : i + toxicity.PIECE]:
                h = (h * 0x01000193 + x) & 0xFFFFFFFF
            out = out + model.table[bucket(h)]
        return out

    vectors = [embedded(w) for w in words]
    peaks, at = [], 0
    for width in toxicity.WIDTHS:
        filters = model.project[:, at : at + width * toxicity.FILTERS].astype(float)
        at += width * toxicity.FILTERS
        values = []
        for i in range(len(words)):
            parts = [vectors[i + j] @ filters[:, j * toxicity.FILTERS : (j + 1) * toxicity.FILTERS] for j in range(width) if i + j < len(words)]
            values.append(sum(parts))
        peaks += np.max(values, axis=0).tolist()
    counts = {lang: sum(w.decode("utf-8", "replace") in own for w in words) for lang, own in toxicity.FUNCTION_WORDS.items()}
    lang = max(counts, key=lambda k: counts[k])
    level = model.levels[lang if counts[lang] else "other"]
    z = np.maximum(peaks, 0) @ model.weights.astype(float) + model.bias
    return 1 / (1 + math.exp(-(z - level + math.log(0.7 / 0.3))))
