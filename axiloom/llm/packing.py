"""Packing token pieces into fixed windows by minimum bin slack.

Documents are tokenised once; each is cut into full windows and one remainder. The remainders are packed by length
only: the driver gets how many there are of each length, never more numbers than a window has tokens. While some are
left, a subset-sum dynamic program over bit sets finds the multiset of lengths that holds the longest one and fills a
window closest to its capacity; backtracking gives the count of each length, and the pattern is used as often as the
counts allow. Pieces then find their place by their rank among those of their length, by binary search in the patterns.

A rank is the number of pieces of that length in the tasks before, and in the task itself; tasks count as they cut, so
nothing is sorted, and the length that most pieces have, the full window, is numbered like any other.

Defined results: a null text is empty, and an empty text is the end token alone; rows that repeat a doc_id are packed
each, as do rows without one; a text of any length gives as many pieces as it fills windows; an empty table gives no
pieces; other columns are left alone. Sequences whose content is a power of two long need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiloom.llm.common import map_arrow, materialize

WINDOW = 2048
END = 1
#: Words whose ids a worker remembers, rows of a batch that are worked on at a time, and words encoded together.
CACHE_WORDS, ROWS, TOGETHER = 1_200_000, 128, 256
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MARK_BYTES = frozenset(_MARKS)
_state: dict = {}


def _ends_in_letter(word: bytes) -> bool:
    """Whether the tokenizer, which lower-cases, sees a letter at the end: of a capital I with a dot, it sees the dot."""
    last = word[-4:].decode("utf-8", "ignore")[-1:]
    return word.endswith(last.encode()) and last.lower()[-1:].isalpha()


def _ids_of(path: str):
    """A function from a list of texts (bytes) to a list of packed little-endian 32-bit ids.

    The tokenizer never joins what ASCII white space separates, so a text's ids are those of its words in turn. Words
    come from a bounded cache; what is missing is encoded a few hundred texts at a time.
    """
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        bare = Tokenizer.from_file(path)
        bare.normalizer = None  # which leaves lower-case ASCII as it is
        _state[path] = (Tokenizer.from_file(path), bare, {})
    tokenizer, bare, cache = _state[path]
    (zero,) = tokenizer.encode("0", add_special_tokens=False).ids

    def put(part: list[bytes], ids: np.ndarray, ends: np.ndarray, between: int) -> None:
        if len(ends) != len(part):
            raise ValueError("the tokenizer joins words")
        packed, at = ids.tobytes(), 0
        for w, end in zip(part, (4 * ends).tolist()):
            cache[w] = packed[at:end]
            at = end + 4 * between

    def learn(missing: set[bytes]) -> None:
        """Put words into the cache. A word that ends in ASCII punctuation after a letter or digit is cut there, where
        the tokenizer would cut it too."""
        ending = [w for w in missing if w[-1] in _MARK_BYTES and b"<|" not in w]
        cut = [(w, base) for w in ending if (base := w.rstrip(_MARKS)) and (base[-1:].isalnum() or base[-1] > 127 and _ends_in_letter(base))]
        whole = missing.difference(w for w, _ in cut)
        whole |= {part for w, base in cut for part in (base, w[len(base) :])}.difference(cache)
        plain = [w for w in whole if b"0" not in w and b"<|" not in w]
        for own, words in ((bare, [w for w in plain if w.isascii()]), (tokenizer, [w for w in plain if not w.isascii()])):
            for k in range(0, len(words), TOGETHER):
                # a lone 0 between words: its id comes from nothing else, as no other word here has that digit
                part = words[k : k + TOGETHER]
                (got,) = own.encode_batch_fast([b" 0 ".join(part).decode("utf-8", "replace")], add_special_tokens=False)
                ids = np.array(got.ids, "<u4")
                put(part, ids, np.append(np.flatnonzero(ids == zero), len(ids)), 1)
        other = list(whole.difference(plain))
        for k in range(0, len(other), 2048):
            part = other[k : k + 2048]
            got = tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
            put(part, np.array(got.ids, "<u4"), np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))), 0)
        for w, base in cut:
            cache[w] = cache[base] + cache[w[len(base) :]]

    def encode(texts: list[bytes]) -> list[bytes]:
        # the tokenizer lower-cases; only its special strings, which are looked for before that, must stay as they are
        split = [[w if b"<|" in w else w.translate(_LOWER) for w in t.split()] if b"<|" in t else t.translate(_LOWER).split() for t in texts]
        words = set().union(*split)
        new = words.difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = words
        learn(new)
        get = cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Cut the token ids of each text, with the end token, into windows: doc_id, start, length, ids_crc32, doc_tokens,
    part (the task), nth (how many of its length the task had cut before) and, with keep_ids, ids."""
    end = END.to_bytes(4, "little")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")
    fields = [pa.field(n, pa.int64()) for n in names]
    schema = pa.schema([*fields, *([pa.field("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def cut(batches):
        encode, task, seen = _ids_of(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        own = ids[4 * at : 4 * (at + window)]
                        length = len(own) // 4
                        row = [doc, at, length, zlib.crc32(own), n, task, seen[length]]
                        seen[length] += 1
                        for column, value in zip(out, [*row, pa.array(memoryview(own).cast("i")) if keep_ids else None]):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in c] if n == len(names) else c, schema.types[n]) for n, c in enumerate(out)], schema=schema)

    kinds = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), cut, kinds)


def fill(counts: dict[int, int], capacity: int) -> tuple[int, "OrderedDict[int, int]"]:
    """The multiset closest to ``capacity`` that holds the longest length left: (its sum, copies by length)."""
    longest = max(counts)
    room = capacity - longest
    reach, full, steps = 1, 1 << room, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, step = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach & full:
            take = min(step, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & ((full << 1) - 1)
            left, step = left - take, step * 2
        if reach & full:
            break
    best = reach.bit_length() - 1
    copies, at = OrderedDict({longest: 1}), best
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            copies[length] = copies.get(length, 0) + take
            at -= length * take
    return longest + best, copies


def patterns(counts: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Pack the lengths: rows (length, first rank, end rank, copies, first sequence, offset in it).

    Each round leaves some length with fewer items than the pattern had copies of it, so there are at most
    sum(1 + capacity / length) rounds, whatever the counts: some 18,000 for a window of 2,048.
    """
    left, used = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left:
        _, copies = fill(left, capacity)
        times, offset = min(left[k] // c for k, c in copies.items()), 0
        for length, c in copies.items():
            rows.append((length, used[length], used[length] + c * times, c, sequence, offset))
            used[length] += c * times
            offset += length * c
            left[length] -= c * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every piece with its place: the columns of pieces() but part and nth, and sequence_id, offset."""
    cut = materialize(pieces(docs, tokenizer, window, keep_ids), "pieces")
    totals = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths-by-task")
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = counts.pop(window, 0)
    rows = [(window, 0, whole, 1, 0, 0), *((k, a, b, c, s + whole, o) for k, a, b, c, s, o in patterns(counts, window))]
    # a few of each length and round: bounded by the window, see patterns()
    table = np.array(sorted(r for r in rows if r[1] < r[2]) or [(0, 0, 0, 1, 0, 0)], np.int64)
    heads = {int(k): (int(a), int(b)) for k, a, b in zip(*_runs(table[:, 0]))}
    shared = docs.sparkSession.sparkContext.broadcast((table, heads))
    kinds = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        table, heads = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for k, a, b in zip(*_runs(length[order])):
            first, end = heads[int(k)]
            own = order[a:b]
            at[own] = first + np.searchsorted(table[first:end, 1], rank[own], side="right") - 1
        _, low, _, copies, sequence, offset = table[at].T
        return pa.StructArray.from_arrays([pa.array(sequence + (rank - low) // copies), pa.array(offset + (rank - low) % copies * length)], fields=list(kinds))

    found = F.arrow_udf(place, "sequence_id long, offset long")
    # a task's base: the pieces of that length in the tasks before
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases.hint("merge"), ["length", "part"]).withColumn("at", found("length", F.col("base") + F.col("nth")))
    return ranked.select(*[c for c in cut.columns if c not in ("part", "nth")], "at.sequence_id", "at.offset")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of each stretch of equal values."""
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[cuts], cuts, np.append(cuts[1:], len(x))
