"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed letter n-grams (1 to 3; what is not a letter counts as a space). Each
language has several centroids, found by spherical k-means on its own vectors. A text gets the language of the
centroid with the largest cosine; one that is farther from all centroids than nearly all training texts of that
language were is marked as rejected.

Defined results: a null text or one without a letter is ``und`` with score 0; without training rows so is every text;
ties go to the language first in code-point order.

Rows that repeat a doc_id, or have none, are identified each; a text of any length is read whole; an empty table gives no
rows; other columns are left alone.

Fitting uses a sample of at most about PER_LANGUAGE labelled texts of each language and MOST_TEXTS of all, whole texts
each, and of their vectors at most about MOST_BYTES. A model has at most MOST_NUMBERS numbers: with very many languages,
n-grams are hashed to fewer bits, and then each language has one centroid; beyond that, fitting is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import map_arrow, materialize, release
from axiloom.llm.sampling import sample_by_class

BITS, LEAST_BITS, PER_LANGUAGE, MOST_TEXTS, CENTROIDS, SHARPNESS = 14, 10, 300, 6000, 3, 25.0
MOST_BYTES, MOST_NUMBERS = 1 << 26, 1 << 24
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(hashed n-grams, how often each occurs); None if the text has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.concatenate(([32], np.where(letter, c, 32), [32])).astype(np.uint32)
    near = (c[1:] != 32) | (c[:-1] != 32)
    one = c[c != 32] * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B) + c[1:]) * np.uint32(0xC2B2AE35)
    three = (two[:-1] + c[2:]) * np.uint32(0x27D4EB2F)
    grams = np.concatenate((one, two[near], three[near[:-1] & near[1:]])) >> np.uint32(32 - BITS)
    counts = np.bincount(grams, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def folded(at: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same counts by fewer bits of the hash."""
    if bits == BITS:
        return at, n
    at, where = np.unique(at >> (BITS - bits), return_inverse=True)
    return at, np.bincount(where, n).astype(n.dtype)


def shape(languages: int, centroids: int) -> tuple[int, int]:
    """(bits, centroids of a language) of a model within MOST_NUMBERS."""
    for k in dict.fromkeys((centroids, 1)):
        for bits in range(BITS, LEAST_BITS - 1, -1):
            if languages * k << bits <= MOST_NUMBERS:
                return bits, k
    raise ValueError(f"{languages} languages are too many for one model")


@dataclass
class Centroids:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    idf: np.ndarray
    vectors: np.ndarray  # n-gram by centroid
    floor: np.ndarray  # least usual cosine of each language
    bits: int = BITS

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        found = ngram_counts(text) if text and self.languages else None
        if found is None:
            return UNDETERMINED, 0.0, True
        at, n = folded(*found, self.bits)
        v = (1 + np.log(n)) * self.idf[at]
        cos = v @ self.vectors[at] / np.sqrt(v @ v)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.of, cos)
        k = int(best.argmax())
        share = np.exp(SHARPNESS * (best - best[k]))
        return self.languages[k], float(1 / share.sum()), bool(best[k] < self.floor[k])


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those already chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, most: int = MOST_TEXTS) -> Centroids:
    """Fit on the rows (doc_id, text, lang) whose lang and text are not null, or a sample of them."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    chosen = sample_by_class(rows, "lang", F.col("doc_id"), per_language, most)

    def vectors(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if (found := ngram_counts(text.as_py())) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found[0].astype("<i4").tobytes()]), pa.array([found[1].astype("<i4").tobytes()])], ["lang", "at", "n"])

    packed = materialize(map_arrow(chosen.select("lang", "text"), vectors, "lang string, at binary, n binary"), "vectors")
    size = packed.agg(F.coalesce(F.sum(F.octet_length("at") + F.octet_length("n")), F.lit(0))).first()[0]
    thin = F.pmod(F.xxhash64("at", "n"), F.lit(1 << 30)) < int(min(1.0, MOST_BYTES / max(1, size)) * (1 << 30))
    got = [(r["lang"], bytes(r["at"]), bytes(r["n"])) for r in packed.where(thin).collect()]
    release(packed)
    languages = sorted({lang for lang, _, _ in got}, key=lambda s: s.encode())
    bits, centroids = shape(len(languages), centroids)
    counted = sorted((lang, *(x.tobytes() for x in folded(np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4"), bits))) for lang, at, n in got)
    df = np.zeros(1 << bits)
    for _, at, _ in counted:
        df[np.frombuffer(at, "<i4")] += 1
    idf = np.log((1 + len(counted)) / (1 + df)) + 1
    of, parts, floor = [], [], []
    for k, lang in enumerate(languages):
        own = [(at, n) for x, at, n in counted if x == lang]
        x = np.zeros((len(own), 1 << bits), np.float32)
        for i, (at, n) in enumerate(own):
            at = np.frombuffer(at, "<i4")
            x[i, at] = (1 + np.log(np.frombuffer(n, "<i4"))) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = _clustered(x, centroids)
        parts.append(c)
        of += [k] * len(c)
        floor.append(float(np.quantile((x @ c.T).max(axis=1), 0.01)) * 0.8)
    vectors_ = np.concatenate(parts).T.copy() if parts else np.zeros((1 << bits, 0), np.float32)
    return Centroids(languages, np.array(of, int), idf, vectors_, np.array(floor), bits)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 * MOST_NUMBERS bytes

    def run(batches):
        own = shared.value
        for b in batches:
            got = [own.predict(t.as_py()) for t in b.column(1)]
            lang, score, out = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
