"""Removal of long repeated byte strings with a sparse suffix array, sorted by a distributed merge.

Every string of LENGTH bytes that starts at two places or more is removed wherever it covers. Not every suffix is
sorted, only those at anchors: among the GRAM-byte strings inside any LENGTH-byte string, the leftmost of least hash.
Equal strings choose the same anchor at the same place in them, so two equal strings always meet as two anchor
suffixes with a common prefix of GRAM bytes. Anchors whose gram occurs once are dropped before any text is looked at
again. Each anchor has a context: up to LENGTH - GRAM bytes before it and LENGTH bytes from it on.

The sort: each task makes, per bucket of grams, a run of its distinct contexts, sorted by the bytes from the anchor
on and front-coded (length of the prefix shared with the one before, and the rest). Runs of a bucket are merged by a
loser tree over common prefix lengths: two suffixes are compared from where they are known to differ at the earliest,
and often not at all. The merged order comes with the common prefix of each neighbour pair. From it, for each offset
of a LENGTH-byte string relative to the anchor, neighbours that share enough to the right form blocks, and inside a
block those that also share the bytes to the left are the same string.

Defined results: a null text is empty; texts under LENGTH bytes lose only what they share from LENGTH bytes on, that
is nothing; each row is a text of its own, so rows that repeat a long text, or a doc_id with its text, lose all of it;
rows without a doc_id are treated like any other; a text of any length is hashed in pieces and cut once; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import map_arrow, materialize, release

LENGTH, GRAM = 200, 100
#: Texts are hashed in pieces of so many bytes, which overlap.
CHUNK = 1 << 20
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string of data, by prefix sums of a polynomial."""
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * down[: len(data)], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1])


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Places that are the leftmost least of some window of ``width`` hashes, in order.

    The low bits of each hash give way to its place, so that one number orders by hash and then by place; the least of
    each window is that of a suffix of one block and a prefix of the next.
    """
    low = np.uint64(CHUNK - 1)
    blocks = -(-len(h) // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    grid = keys.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    places = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of a text. """
    places, hashes = [], []
    step = CHUNK - length + 1
    for at in range(0, max(1, len(text) - length + 1), step):
        data = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)
        if len(data) < length:
            break
        h = _gram_hashes(data, gram)
        got = _least_places(h, length - gram + 1)
        places.append(got + at)
        hashes.append(h[got])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


# runs ---------------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``at`` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while True:
        step = min(32, n - at)
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            z = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + (8 * step - z.bit_length()) // 8
        at += step


def front_code(run: list[tuple[bytes, bytes, int]]) -> bytes:
    """A sorted run of (right, left, count) as bytes: prefix shared with the one before, rest, left side, count."""
    out, before = [], b""
    for right, left, count in run:
        k = common(before, right)
        out += [k.to_bytes(2, "little"), len(right).to_bytes(2, "little"), right[k:], len(left).to_bytes(2, "little"), left, min(count, 2).to_bytes(1, "little")]
        before = right
    return b"".join(out)


def decode(run: bytes):
    """(prefix shared with the one before, right, left, count) of each entry of a front-coded run."""
    at, before = 0, b""
    while at < len(run):
        k, n = int.from_bytes(run[at : at + 2], "little"), int.from_bytes(run[at + 2 : at + 4], "little")
        right = before[:k] + run[at + 4 : at + 4 + n - k]
        at += 4 + n - k
        m = int.from_bytes(run[at : at + 2], "little")
        left, count = run[at + 2 : at + 2 + m], run[at + 2 + m]
        at += m + 3
        yield k, right, left, count
        before = right


def merge(runs: list):
    """Merge decoded runs with a loser tree; yields (prefix shared with the last one out, right, left, count).

    Every loser keeps how much it shares with the one that beat it. The next to challenge it comes from the same
    path, so both prefixes are relative to the last one out: the longer one wins unread, and only equal ones are
    compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = None, b"", b"", 0
    sources = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(s, ends) for s in sources]
    heads = [(0, *h[1:]) if h[0] is not None else ends for h in heads]
    losers: list[tuple[int, int]] = [(0, 0)] * k

    def play(i: int, pi: int, j: int, pj: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix)."""
        if heads[j][0] is None:
            return i, pi, j, pj
        if heads[i][0] is None:
            return j, pj, i, pi
        if pi != pj:
            return (i, pi, j, pj) if pi > pj else (j, pj, i, pi)
        a, b = heads[i][1], heads[j][1]
        p = common(a, b, pi)
        if a[p : p + 1] <= b[p : p + 1]:
            return i, pi, j, p
        return j, pj, i, p

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (i, pi), (j, pj) = build(2 * node), build(2 * node + 1)
        w, pw, x, px = play(i, pi, j, pj)
        losers[node] = (x, px)
        return w, pw

    w, p = build(1)
    while heads[w][0] is not None:
        yield p, *heads[w][1:]
        heads[w] = next(sources[w], ends)
        p = heads[w][0] or 0
        node = (w + k) // 2
        while node:
            j, pj = losers[node]
            w, p, x, px = play(w, p, j, pj)
            losers[node] = (x, px)
            node //= 2


def repeated_spans(merged, length: int = LENGTH, gram: int = GRAM):
    """From contexts in merged order, (right, left, most bytes before, least bytes before) of the repeated strings that
    hold the anchor; the strings start that many bytes before it. Contexts without any are left out."""
    rows = list(merged)
    if not rows:
        return
    shared = np.array([r[0] for r in rows], np.int64)
    n, reach = len(rows), length - gram
    before = np.array([len(r[2]) for r in rows])
    after = np.array([len(r[1]) for r in rows])
    many = np.array([r[3] > 1 for r in rows])
    lefts = np.zeros((n, reach), np.uint8)  # column k: the byte k + 1 before the anchor
    joined = np.frombuffer(b"".join(r[2][::-1] for r in rows), np.uint8)
    lefts[np.arange(reach)[None, :] < before[:, None]] = joined
    most, least = np.full(n, -1), np.full(n, length)
    side = np.zeros(n, np.uint64)
    for o in range(reach + 1):
        if o:
            side = side * _BASE + _BYTE[lefts[:, o - 1]]
        able = (before >= o) & (after >= length - o)
        block = np.cumsum(shared < length - o).astype(np.uint64)
        at = np.flatnonzero(able)
        if not at.size:
            continue
        key = _mixed(side[at] + _mixed(block[at] + np.uint64(o)))
        order = np.argsort(key, kind="stable")
        v = key[order]
        same = np.concatenate(([False], v[1:] == v[:-1]))
        same[:-1] |= same[1:]
        hit = np.zeros(n, bool)
        hit[at[order[same]]] = True
        hit[at] |= many[at]
        most[hit] = o
        least[hit] = np.minimum(least[hit], o)
    for i in np.flatnonzero(most >= 0):
        yield rows[i][1], rows[i][2], int(most[i]), int(least[i])


def context(text: bytes, place: int, length: int = LENGTH, gram: int = GRAM) -> tuple[bytes, bytes]:
    """(right, left) of an anchor."""
    return text[place : place + length], text[max(0, place - (length - gram)) : place]


def context_key(right: bytes, left: bytes) -> bytes:
    return hashlib.blake2b(right + b"\0" + len(left).to_bytes(2, "little") + left, digest_size=16).digest()


# distributed --------------------------------------------------------------------------------------------------------

#: A task turns its contexts into runs when it holds so many; a merge is cut between grams after so many; and a bucket
#: of grams is to have at most about so many.
HELD, BLOCK, BUCKET = 100_000, 50_000, 400_000


def _batches(schema: pa.Schema, rows, size: int = 2048):
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _repeated_grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(did, places): the anchors of each text whose gram occurs twice or more anywhere."""

    def find(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for did, body in zip(b.column(0).to_pylist(), b.column(1)):
                p, h = anchors(body.as_py(), length, gram)
                out[0].append(h.view(np.int64))
                out[1].append(np.full(len(p), did))
                out[2].append(p.astype(np.int32))
            arrays = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "did", "place"])

    found = materialize(map_arrow(texts.select("did", "body"), find, "gram long, did long, place int"), "anchors")
    # counted before the shuffle, so that a gram of a third of all anchors is one row per task; those anchors then meet
    # their gram in a join that adaptive execution splits
    often = materialize(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    met = found.join(often.hint("merge"), "gram", "left_semi")
    places = materialize(met.groupBy("did").agg(F.collect_set("place").alias("places")), "places")
    release(found, often)
    return places


def _runs(texts: DataFrame, places: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Two kinds of rows: (bucket, run) with a sorted front-coded run, and (did, h, place, context) for each anchor."""
    kinds = "bucket int, run binary, did long, h long, place int, context binary"
    schema = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("did", pa.int64()), ("h", pa.int64()), ("place", pa.int32()), ("context", pa.binary())])

    def flush(held):
        split: dict[int, list] = {}
        for entry in held.values():
            split.setdefault(zlib.crc32(entry[0][:gram]) % buckets, []).append(entry)
        for bucket, run in split.items():
            yield bucket, zlib.compress(front_code(sorted(run)), 1), None, None, None, None
        held.clear()

    def rows(batches):
        held: dict[bytes, tuple[bytes, bytes, int]] = {}
        for b in batches:
            for did, h, body, at in zip(*(b.column(k).to_pylist() for k in range(4))):
                for place in sorted(at):
                    if place + gram > len(body):
                        continue
                    right, left = context(body, place, length, gram)
                    key = context_key(right, left)
                    held[key] = (right, left, held[key][2] + 1 if key in held else 1)
                    yield None, None, did, h, place, key
                if len(held) >= HELD:
                    yield from flush(held)
        yield from flush(held)

    met = texts.join(places, "did").select("did", "h", "body", "places")
    return map_arrow(met, lambda batches: _batches(schema, rows(batches)), kinds)


def _merged_spans(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(context, most, least) of the contexts with repeated strings, from the runs of each bucket merged."""
    schema = pa.schema([("context", pa.binary()), ("most", pa.int32()), ("least", pa.int32())])

    def collapsed(merged):
        """Equal contexts of several runs as one, and their counts added; the prefix is that with the one before.
        Contexts with equal right sides come in any order of the left, so they are gathered first."""
        group: dict[bytes, list] = {}
        for shared, right, left, count in merged:
            if group and not (shared == len(right) == size):
                yield from map(tuple, group.values())
                group = {}
            size = len(right)
            if left in group:
                group[left][3] += count
            else:
                group[left] = [shared, right, left, count]
        yield from map(tuple, group.values())

    def blocks(merged):
        held: list = []
        for r in merged:
            if r[0] < gram and len(held) >= BLOCK:
                yield held
                held = []
            held.append(r)
        yield held

    def spans(runs: list[bytes]):
        for block in blocks(collapsed(merge([decode(zlib.decompress(r)) for r in runs]))):
            for right, left, most, least in repeated_spans(block, length, gram):
                yield context_key(right, left), most, least

    def rows(batches):
        bucket, own = None, []
        for b in batches:
            for k, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != bucket and own:
                    yield from spans(own)
                    own = []
                bucket = k
                own.append(run)
        if own:
            yield from spans(own)

    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(dealt, lambda batches: _batches(schema, rows(batches)), "context binary, most int, least int")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (doc_id, did, h, body) of all rows; spans (did, h, spans) of texts with repeated strings."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    # two hashes name a row: neither many rows of one doc_id, or of none, nor copies of a text become one group
    texts = texts.select("doc_id", F.xxhash64("doc_id", "body").alias("did"), F.xxhash64(F.lit("row"), "body", "doc_id").alias("h"), "body")
    long = texts.where(F.octet_length("body") >= length)
    places = _repeated_grams(long, length, gram)
    anchors_left = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), anchors_left // BUCKET)
    both = materialize(_runs(long, places, buckets, length, gram), "runs")
    release(places)
    spans = materialize(_merged_spans(both.where("run is not null").select("bucket", "run"), length, gram), "spans")
    met = both.where("run is null").select("did", "h", "place", "context").join(spans.hint("merge"), "context")
    span = F.struct((F.col("place") - F.col("most")).alias("a"), (F.col("place") - F.col("least") + length).alias("b"))
    return texts, met.groupBy("did", "h").agg(F.collect_set(span).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, spans and the kept bytes."""
    texts, spans = repeated_spans_of(docs, length, gram)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<int>>, kept binary" * keep_text
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())] * keep_text)

    def rows(batches):
        for b in batches:
            for k in range(b.num_rows):
                doc, body, found = (b.column(i)[k].as_py() for i in range(3))
                gone = union([(x["a"], x["b"]) for x in found or ()])
                kept, at = [], 0
                for x, y in gone:
                    kept.append(body[at:x])
                    at = y
                rest = b"".join([*kept, body[at:]])
                out = doc, len(body), len(body) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()
                yield (*out, gone, rest) if keep_text else out

    # a text without spans, most often the case, needs no meeting: but which those are is known only after the join
    met = texts.join(spans, ["did", "h"], "left").select("doc_id", "body", "spans")
    return map_arrow(met, lambda batches: _batches(schema, rows(batches)), kinds)
