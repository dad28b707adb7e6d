"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so words are labelled first: a word of a toxic text is toxic if it, or a beginning of it,
stands in new surroundings in text after toxic text and in next to none of the others. Asking for new surroundings
keeps what copies of one text repeat, and what one long text repeats, from looking like evidence. A two-state CRF then
learns from windows of labelled words: the word, its beginnings and its neighbours, and how states follow each other.
Forward-backward gives each word's marginal. Words over one half form the spans; the largest marginal, the number of
toxic words and their share, calibrated on texts held back, make the document's score.

Defined results: texts without words (null, empty, blank) get the score of a text without evidence; without training
rows of both classes every score is the share of toxic ones, or 0; a text of any length is scored whole; rows that repeat
a doc_id, or have none, are scored each; of rows with equal texts, the label of one is used, toxic if any is; a doc_id
with several marks is fitted with each; an empty table gives no rows; other columns are left alone.

Fitting uses a sample of at most about PER_CLASS texts of each class, whole texts each, and of the windows they give at
most about WINDOWS; both are chosen by a hash over all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import map_arrow, materialize, release
from axiloom.llm.sampling import sample_by_class

PER_CLASS, WINDOWS, AROUND, LEAST_PLACES, ROUNDS = 1500, 12_000, 8, 5, 120
#: One in so many texts of the sample trains no weights but calibrates the scores.
HELD_BACK = 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGE = bytes(b for b in range(128) if not chr(b).isalnum())
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK = 128
#: On the weights of the word's units and of its neighbours: these are mostly seen once, and say little.
PENALTY = (0.2, 5.0)
#: Lengths of beginnings, in characters, and how many words a worker remembers the weight of.
BEGINNINGS, MEMO = (3, 4, 5, 6, 7), 400_000


def tokens(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) for w in text.translate(_LOWER).split()]


def marginal_logits(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Log odds of state 1 at each place of chains that lie one after the other.

    e: log odds of each place alone; first: whether a chain begins there; trans: log weights [from, to]. The places are
    cut into blocks; products of the steps of each block, all blocks at once, give the state at every block's edge,
    and a second pass fills in the places, again all blocks at once.
    """
    n = len(e)
    if not n:
        return e
    t = np.exp(trans)
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    x = np.exp(np.clip(np.concatenate((e, np.zeros(pad))), -60, 60)).reshape(rows, BLOCK)
    f = np.concatenate((first, np.ones(pad, bool))).reshape(rows, BLOCK)
    s = np.exp(start)
    last = np.concatenate((f.ravel()[1:], [True])).reshape(rows, BLOCK)

    def scan(step) -> np.ndarray:
        """step(k, a0, a1): the two weights after place k of each block from those before it, for arrays of any shape."""
        u = [np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]
        for k in range(BLOCK):
            for v in u:
                v[0], v[1] = step(k, v[0], v[1])
            top = np.maximum(np.maximum(u[0][0], u[0][1]), np.maximum(u[1][0], u[1][1]))
            for v in u:
                v[0] /= top
                v[1] /= top
        a, b = np.empty(rows), np.empty(rows)
        p, q = 0.5, 0.5
        for r in range(rows):
            a[r], b[r] = p, q
            p, q = p * u[0][0][r] + q * u[1][0][r], p * u[0][1][r] + q * u[1][1][r]
            p, q = p / (p + q), q / (p + q)
        out = np.empty((rows, BLOCK))
        for k in range(BLOCK):
            a, b = step(k, a, b)
            top = a + b
            a, b = a / top, b / top
            out[:, k] = np.log(np.maximum(b, 1e-300)) - np.log(np.maximum(a, 1e-300))
        return out

    def ahead(k, a, b):
        new0 = np.where(f[:, k], a + b, a * t[0, 0] + b * t[1, 0])
        new1 = np.where(f[:, k], (a + b) * s, a * t[0, 1] + b * t[1, 1]) * x[:, k]
        return new0, new1

    alpha = scan(ahead)
    # backwards: weights after the places to the right; a chain's last place has none
    xr, lr = x[::-1, ::-1], last[::-1, ::-1]
    nxt = np.concatenate(([1.0], xr.ravel()[:-1])).reshape(rows, BLOCK)

    def back(k, a, b):
        new0 = np.where(lr[:, k], a + b, t[0, 0] * a + t[0, 1] * nxt[:, k] * b)
        new1 = np.where(lr[:, k], a + b, t[1, 0] * a + t[1, 1] * nxt[:, k] * b)
        return new0, new1

    beta = scan(back)[::-1, ::-1]
    return (alpha.ravel() + beta.ravel())[:n]


def units(word: bytes) -> list[str]:
    """What evidence and weights attach to: the word itself, marked by its end, and its beginnings."""
    w = word.decode("utf-8", "replace")
    return [w + "$", *(w[:k] for k in BEGINNINGS if len(w) > k)]


class _Memo(dict):
    """Weights of words, computed once for as many words as MEMO holds."""

    def __init__(self, weight):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.weight(word)
        return value


@dataclass
class Tagger:
    """Weights of units of the word itself, and of the words before and after, by id (0 being unknown)."""

    units: dict[str, int]
    own: np.ndarray
    words: dict[bytes, int]
    near: np.ndarray
    bias: float
    trans: np.ndarray
    start: float
    slope: np.ndarray = field(default_factory=lambda: np.zeros(3))
    offset: float = 0.0

    def weight(self, word: bytes) -> float:
        return float(sum(self.own[self.units[u]] for u in units(word) if u in self.units)) if word else 0.0

    def logits(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        sizes = [len(w) for w in texts]
        n = sum(sizes)
        if not n:
            return [np.zeros(0)] * len(texts)
        if "_memo" not in self.__dict__:
            self.__dict__["_memo"] = _Memo(self.weight)
        memo, get = self.__dict__["_memo"].__getitem__, self.words.get
        own = np.fromiter((memo(w) for ws in texts for w in ws), float, n)
        ids = np.fromiter((get(w, 0) for ws in texts for w in ws), np.int64, n)
        ends = np.cumsum(sizes)
        first = np.zeros(n, bool)
        first[[e - s for e, s in zip(ends.tolist(), sizes) if s]] = True
        before = np.where(first, 0, np.concatenate(([0], ids[:-1])))
        after = np.where(np.concatenate((first[1:], [True])), 0, np.concatenate((ids[1:], [0])))
        e = self.bias + own + self.near[0, before] + self.near[1, after]
        return np.split(marginal_logits(e, first, self.trans, self.start), ends[:-1])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def score(self, logits: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(evidence(logits) @ self.slope + self.offset))))


def evidence(logits: np.ndarray) -> np.ndarray:
    """What a document's score is made of: the largest marginal, how many words are toxic, and what share of all."""
    if not len(logits):
        return np.array([-12.0, 0.0, 0.0])
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    p = np.where(p < 0.05, 0.0, p)
    return np.array([max(-12.0, min(12.0, float(logits.max()))), np.log1p(p.sum()), np.log1p(100 * p.mean())])


def _text_id(text: Column) -> Column:
    """A number of its own for each text, whatever its rows: it orders texts and decides which are held back."""
    return F.xxhash64(F.lit("toxicity"), text)


def _places(texts: DataFrame) -> DataFrame:
    """(y, unit, around, id): the units of each text (y, text, id) and the surroundings they stand in, each once."""

    def run(batches):
        names = ["y", "unit", "around", "id"]
        for b in batches:
            for y, text, ident in zip(*(c.to_pylist() for c in b.columns)):
                ws = tokens(text)
                found = {(w, xxhash.xxh64_intdigest(a + b" " + c) >> 1) for a, w, c in zip([b"", *ws[:-1]], ws, [*ws[1:], b""]) if w}
                rows = {(u, around) for w, around in found for u in units(w)}
                if rows:
                    u, around = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(y, pa.int32()), len(u)), pa.array(u, pa.string()), pa.array(around, pa.int64()), pa.repeat(pa.scalar(ident, pa.int64()), len(u))], names)

    return map_arrow(texts.select("y", "text", "id"), run, "y int, unit string, around long, id long")


def toxic_units(texts: DataFrame) -> set[str]:
    """Units that stand in new surroundings in text after toxic text, and in next to none of the others.

    A text counts once for a unit, and only if it has it in surroundings that no earlier text of its class had. A unit
    must count so often that among as many units as there are, chance would hardly bring forth one by itself. All of it
    is counted on the executors; the driver gets the units that pass.
    """
    size = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return set()
    places = materialize(_places(texts), "places")
    often = places.where("y = 1").groupBy("unit").agg(F.count_distinct("id").alias("n"))
    vast, few = often.count(), often.where(F.col("n") >= LEAST_PLACES).select("unit")
    first = places.join(few, "unit").groupBy("y", "unit", "around").agg(F.min("id").alias("id"))
    counts = first.groupBy("unit").agg(*[F.count_distinct(F.when(F.col("y") == k, F.col("id"))).alias(f"n{k}") for k in (0, 1)])
    least = max(LEAST_PLACES, math.log(20 * (vast + 1)) / -math.log(bad / (bad + good)))
    found = {r["unit"] for r in counts.where((F.col("n1") >= least) & (F.col("n1") * good >= 20 * bad * F.col("n0"))).select("unit").collect()}
    release(places)
    return found


def windows_of(y: int, ident: int, ws: list[bytes], bad: set[str]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Stretches of a text to train on, with their labels: around all its words that look toxic, once where they meet,
    and in a clean text around one place that follows from its number. Long ones are cut."""
    alike = [any(u in bad for u in units(w)) if w else False for w in ws]
    at = [i for i, x in enumerate(alike) if x] + ([] if y or not ws else [ident % len(ws)])
    inside = np.zeros(len(ws), bool)
    for i in at:
        inside[max(0, i - AROUND) : i + AROUND + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for k in range(start, end, 2 * AROUND + 1):
            part = slice(k, min(end, k + 2 * AROUND + 1))
            yield ws[part], [int(y and x) for x in alike[part]]


def fit(docs: DataFrame, marks: DataFrame, per_class: int = PER_CLASS, most_windows: int = WINDOWS) -> Tagger:
    """Fit on docs (doc_id, text) whose doc_id has a mark (doc_id, toxic 0 or 1), or on a sample of the marks.

    The sample is drawn from the marks, so that only its texts meet them: a join with a side of at most a few thousand
    rows, checked here by the sample's bound. Texts stay on the executors; the driver gets toxic units, windows and what
    the scores of the texts held back are made of.
    """
    few = sample_by_class(marks.where("toxic in (0, 1)"), "toxic", F.col("doc_id"), per_class)
    chosen = docs.join(F.broadcast(few), "doc_id").select("toxic", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = chosen.groupBy("text").agg(F.max("toxic").cast("int").alias("y")).withColumn("id", _text_id(F.col("text")))
    texts = materialize(once.repartition(parts, "id"), "labelled-texts")
    bad = toxic_units(texts)
    held = F.pmod("id", F.lit(HELD_BACK)) == 0
    model = _fitted(texts.where(~held), bad, most_windows)
    share = texts.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0]
    if not bad or not 0 < share < 1:
        model.offset = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    else:
        _calibrate(model, texts.where(held))
    release(texts)
    return model


def _fitted(texts: DataFrame, bad: set[str], most: int) -> Tagger:
    """A tagger trained on at most about ``most`` windows of the texts, chosen by their place."""

    def run(batches):
        for b in batches:
            for y, text, ident in zip(*(c.to_pylist() for c in b.columns)):
                found = [(xxhash.xxh64_intdigest(f"{ident} {k}") >> 2, ws, m) for k, (ws, m) in enumerate(windows_of(y, ident, tokens(text), bad))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())))], ["at", "words", "marks"])

    windows: list[tuple[list[bytes], list[int]]] = []
    if bad:
        all_ = materialize(map_arrow(texts.select("y", "text", "id"), run, "at long, words array<binary>, marks array<int>"), "windows")
        limit = int(min(1.0, most / max(1, all_.count())) * (1 << 62))
        windows = [([bytes(w) for w in r["words"]], list(r["marks"])) for r in sorted(all_.where(F.col("at") <= limit).collect(), key=lambda r: r["at"])]
        release(all_)
    vocabulary = sorted({w for ws, _ in windows for w in ws})
    known = {u: i for i, u in enumerate(sorted({u for w in vocabulary if w for u in units(w)}), 1)}
    words = {w: i for i, w in enumerate(vocabulary, 1)}
    model = Tagger(known, np.zeros(len(known) + 1), words, np.zeros((2, len(words) + 1)), -4.0, np.zeros((2, 2)), 0.0)
    if windows:
        _train(model, windows)
    return model


def _calibrate(model: Tagger, held: DataFrame) -> None:
    """Fit the weights of what a score is made of, none below zero, on texts that trained nothing else."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = shared.value.logits([tokens(t) for t in b.column(1).to_pylist()])
            x = np.array([evidence(v) for v in found]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["y", "a", "b", "c"])

    rows = sorted(tuple(r) for r in map_arrow(held.select("y", "text"), run, "y int, a double, b double, c double").collect())
    y, x = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows], float).reshape(-1, 3)
    if not 0 < y.sum() < len(y):
        model.slope, model.offset = np.array([1.0, 0.0, 0.0]), 0.0
        return
    mean, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, a, b = (x - mean) / width, np.zeros(3), 0.0
    for _ in range(3000):
        g = 1 / (1 + np.exp(-(z @ a + b))) - y
        a, b = np.maximum(0.0, a - 0.3 * (z.T @ g / len(y) + 1e-3 * a)), b - 0.3 * g.mean()
    model.slope, model.offset = a / width, float(b - (a * mean / width).sum())


def _train(model: Tagger, windows: list[tuple[list[bytes], list[int]]]) -> None:
    """Adagrad on the conditional log likelihood of the windows, with an L2 penalty; gradients by forward-backward."""
    n, wide = 2 * AROUND + 1, 1 + len(BEGINNINGS)
    ids, parts = np.zeros((len(windows), n), np.int64), np.zeros((len(windows), n, wide), np.int64)
    y, there = np.zeros(ids.shape), np.zeros(ids.shape, bool)
    of = {w: [model.units[u] for u in units(w)] if w else [] for w in model.words}
    for k, (ws, marks) in enumerate(windows):
        ids[k, : len(ws)], y[k, : len(ws)], there[k, : len(ws)] = [model.words[w] for w in ws], marks, True
        for j, w in enumerate(ws):
            parts[k, j, : len(of[w])] = of[w]
    before = np.concatenate((np.zeros((len(ids), 1), int), ids[:, :-1]), axis=1)
    after = np.concatenate((ids[:, 1:], np.zeros((len(ids), 1), int)), axis=1)
    sq_o, sq_n, sq_t, sq_b, sq_s = np.full(model.own.shape, 1e-6), np.full(model.near.shape, 1e-6), np.full((2, 2), 1e-6), 1e-6, 1e-6
    pair = there[:, 1:]
    y0, y1 = y[:, :-1][pair], y[:, 1:][pair]
    seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
    for _ in range(ROUNDS):
        e = np.where(there, model.bias + model.own[parts].sum(axis=2) + model.near[0, before] + model.near[1, after], 0.0)
        x = np.exp(np.clip(e, -30, 30))
        t = np.exp(model.trans)
        alpha, beta, scale = np.empty((n, len(ids), 2)), np.ones((n, len(ids), 2)), np.empty((n, len(ids), 1))
        for k in range(n):
            a = np.stack((np.ones(len(ids)), np.full(len(ids), np.exp(model.start))), axis=1) if k == 0 else np.where(there[:, k, None], alpha[k - 1] @ t, alpha[k - 1])
            a = a * np.stack((np.ones(len(ids)), x[:, k]), axis=1)
            scale[k] = a.sum(axis=1, keepdims=True)
            alpha[k] = a / scale[k]
        for k in range(n - 2, -1, -1):
            b = (np.stack((np.ones(len(ids)), x[:, k + 1]), axis=1) * beta[k + 1]) @ t.T
            beta[k] = np.where(there[:, k + 1, None], b, beta[k + 1]) / scale[k + 1]
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(axis=2)).T
        expected = np.zeros((2, 2))
        for k in range(1, n):
            joint = alpha[k - 1][:, :, None] * t[None] * (np.stack((np.ones(len(ids)), x[:, k]), axis=1) * beta[k])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint[there[:, k]].sum(axis=0)
        g = np.where(there, p - y, 0.0)
        go = np.bincount(parts.ravel(), np.repeat(g.ravel(), wide), len(model.own)) + PENALTY[0] * model.own
        gn = np.stack([np.bincount(i.ravel(), g.ravel(), model.near.shape[1]) for i in (before, after)]) + PENALTY[1] * model.near
        go[0], gn[:, 0] = 0, 0
        gt, gb, gs = expected - seen + 0.1 * model.trans, g.sum(), g[:, 0].sum()
        sq_o, sq_n, sq_t, sq_b, sq_s = sq_o + go**2, sq_n + gn**2, sq_t + gt**2, sq_b + gb**2, sq_s + gs**2
        model.own -= 0.5 * go / np.sqrt(sq_o)
        model.near -= 0.5 * gn / np.sqrt(sq_n)
        model.trans = model.trans - 0.2 * gt / np.sqrt(sq_t)
        model.bias -= 0.2 * gb / np.sqrt(sq_b)
        model.start -= 0.2 * gs / np.sqrt(sq_s)


def spans_of(text: str, logits: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in characters of the stretches of words over one half."""
    out: list[list[int]] = []
    before = False
    for m, x in zip(_WORD.finditer(text), logits.tolist()):
        if x > 0 and before:
            out[-1][1] = m.end()
        elif x > 0:
            out.append([m.start(), m.end()])
        before = x > 0
    return [(a, b) for a, b in out]


def score(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, score, spans (array of [start, end] in characters) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of the training windows: a bounded sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def run(batches):
        own = shared.value
        for b in batches:
            for k in range(0, max(1, b.num_rows), 256):
                part = b.slice(k, 256)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                logits = own.logits([tokens(t) for t in texts])
                spans = [spans_of(t.decode("utf-8", "replace"), v) if len(v) and v.max() > 0 else [] for t, v in zip(texts, logits)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(v) for v in logits], pa.float64()), pa.array(spans, schema.types[2])], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, score double, spans array<array<int>>")
