"""SimHash near-dedup: segment popcounts as an embedding, a grid join on them, and an exact check.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments are its point in the
embedding. Two bits differ in count by no more than they differ in bits, so the Manhattan distance of points is a
lower bound of the Hamming distance. Sorting the bits inside each segment writes a count in unary; the Manhattan
distance of two points is then the number of bits in which their sorted forms differ.

The grid: the 32 counts form 7 blocks. Points at Manhattan distance 4 or less differ in at most 4 blocks and so agree
in at least 3; each of the 35 ways to choose 3 blocks is a grid whose cells are the counts in those blocks. A link
therefore always shows in some cell, and no cell needs its neighbours. Inside a cell, pairs within the Manhattan bound
are checked exactly. Small cells are compared pair by pair. Cells grow with the corpus, so larger ones are cut again:
groups that many of a cell belong to are searched out first and give one link per member, so that a group of near copies
never becomes all of its pairs; of the rest, two fingerprints that differ in at most 4 bits agree in one of any 5 bands
of bits, and are compared where they agree, in bands of the other bits where that is still a crowd. Work in a cell is so
about in proportion to what it holds, and exact.

Defined results: a text without words (null, empty, blank) has fingerprint 0 and links like any other; a text of any
length has one; equal fingerprints are one node, whatever the number of rows and their doc_id; rows that repeat a doc_id get one result each;
rows with a null doc_id link like any other, and component_id is null only where no row of a component has a doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import ROW, map_arrow, materialize, release, with_row_key
from axiloom.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Two-bit segments in each block; any 3 of the 7 blocks make a grid.
BLOCKS = (5, 5, 5, 5, 4, 4, 4)
#: Up to how many fingerprints of a cell are compared pair by pair.
PAIRWISE = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[int]:
    out, at = [], 0
    for n in BLOCKS:
        out.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return out


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text; unsigned."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if len(w) > SHINGLE else [b" ".join(w)]
    n = max(1, len(w) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of each row; fp as a signed long. More ``keys`` (long) come in front of them."""
    columns = [*keys, "doc_id"]

    def run(batches):
        for b in batches:
            got = [signed(fingerprint(t.as_py() or b"")) for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.int64())], [*columns, "fp"])

    given = docs.select(*[F.col(c).cast("long").alias(c) for c in columns], F.col("text").cast("binary").alias("text"))
    return map_arrow(given, run, ", ".join(f"{c} long" for c in (*columns, "fp")))


def _search(fp: np.ndarray, distance: int):
    """Groups of linked fingerprints among fp, as index arrays. Each found one is compared with the unvisited only."""
    left = np.arange(len(fp))
    while left.size:
        group, queue = [left[:1]], [left[:1]]
        left = left[1:]
        while queue and left.size:
            block = queue.pop()
            size = max(1, min(len(block), (1 << 21) // left.size))
            if size < len(block):
                queue.append(block[size:])
            near = (np.bitwise_count(fp[block[:size], None] ^ fp[None, left]) <= distance).any(axis=0)
            if near.any():
                group.append(left[near])
                queue.append(left[near])
                left = left[~near]
        yield np.concatenate(group)


def _bands(free: int, n: int) -> list[int]:
    """The bits set in ``free``, dealt into n masks."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _starts(key: np.ndarray) -> np.ndarray:
    """Where stretches of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _star(rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rep, np.full(len(rep), rep.min())


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what (a, b) connect: each to the least of its group."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _dense(fp: np.ndarray, rep: np.ndarray, distance: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of the groups that one in 16 belongs to, found from a few seeds, and which fingerprints are in none."""
    out, left = [], np.arange(len(fp))
    while len(left) > PAIRWISE:
        seeds = left[:: -(-len(left) // 8)]
        near = [int((np.bitwise_count(fp[left] ^ fp[k]) <= distance).sum()) for k in seeds]
        if 16 * max(near) < len(left):
            break
        turned = np.roll(left, -int(np.flatnonzero(left == seeds[np.argmax(near)])[0]))
        group = turned[next(_search(fp[turned], distance))]
        if len(group) > 1:
            out.append(_star(rep[group]))
        left = np.setdiff1d(left, group)
    return out, left


def _within(run: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, free: int = (1 << 64) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, rep) inside the runs, which lie one after the other; in each, fingerprints differ in ``free`` only."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    first = _starts(run)
    size = np.diff(np.append(first, len(run)))
    each = np.repeat(size, size)
    at = np.flatnonzero((each > 1) & (each <= PAIRWISE))
    for d in range(1, PAIRWISE):
        at = at[at + d < len(run)]
        at = at[run[at] == run[at + d]]
        if not at.size:
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        found.append((rep[hit], rep[hit + d]))
    crowd = size > PAIRWISE
    if crowd.any():
        stay = each > PAIRWISE
        near = np.zeros(len(size), np.int64)
        for k in range(4):
            seed = fp[first + size * k // 4]
            near = np.maximum(near, np.add.reduceat((np.bitwise_count(fp ^ np.repeat(seed, size)) <= distance).astype(np.int64), first))
        for k in np.flatnonzero(crowd & (16 * near >= size)):
            own = slice(first[k], first[k] + size[k])
            links, left = _dense(fp[own], rep[own], distance)
            found += links
            stay[own] = np.isin(np.arange(size[k]), left)
        varies = int(np.bitwise_or.reduce((fp ^ np.repeat(fp[first], size))[stay], initial=np.uint64(0))) & free
        run, fp, rep = run[stay], fp[stay], rep[stay]
        if varies.bit_count() < 4 * (distance + 1):
            for k, end in zip(_starts(run), np.append(_starts(run)[1:], len(run))):
                found += [_star(rep[k:end][g]) for g in _search(fp[k:end], distance) if len(g) > 1]
        else:
            met = []
            for band in _bands(varies, distance + 1):
                key = fp & np.uint64(band)
                order = np.lexsort((key, run))
                r, k = run[order], key[order]
                parts = np.cumsum(np.concatenate(([0], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
                met.append(_forest(*_within(parts, fp[order], rep[order], distance, varies & ~band)))
            found.append(_forest(*map(np.concatenate, zip(*met))))
    a, b = zip(*found)
    return np.concatenate(a), np.concatenate(b)


def _links(rows: tuple[np.ndarray, ...], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, rep) inside the cells of rows (grid, cell, fp, rep), sorted by cell."""
    grid, cell, fp, rep = rows
    run = np.cumsum(np.concatenate(([0], (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]))))
    return _within(run, fp, rep, distance)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the reps of distinct fingerprints (fp, rep), enough to connect all within ``distance``."""
    masks = block_masks()
    grids = [sum(masks[k] for k in c) for c in combinations(range(len(masks)), len(masks) - distance)]
    shifted = F.shiftrightunsigned("fp", 1)
    both = F.col("fp").bitwiseAND(shifted).bitwiseAND(F.lit(_EVEN))
    either = F.col("fp").bitwiseOR(shifted).bitwiseAND(F.lit(_EVEN))
    placed = nodes.withColumn("counts", F.shiftleft(both, 1).bitwiseOR(either))
    cells = F.array(*[F.struct(F.lit(k).cast("byte").alias("grid"), F.col("counts").bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(grids)])
    rows = placed.select("fp", "rep", F.inline(cells)).select("grid", "cell", "fp", "rep")
    dealt = rows.repartition("grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches):
        held = None
        for batch in batches:
            got = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            got = (*got[:2], got[2].view(np.uint64), got[3])
            if not len(got[0]):
                continue
            if held is not None:
                got = tuple(map(np.concatenate, zip(held, got)))
            # the last cell may go on in the next batch
            ends = np.flatnonzero((got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]))
            cut = ends[-1] + 1 if ends.size else 0
            held = tuple(x[cut:] for x in got)
            if cut:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _links(tuple(x[:cut] for x in got), distance))), ["a", "b"])
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _links(held, distance))), ["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint in prints (doc_id, fp). Fingerprints themselves are the
    nodes: root is the least one of the component, component_id the least doc_id."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = connected_components(links(nodes.select("fp", F.col("fp").alias("rep")), distance))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = materialize(named.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "components")
    release(nodes, named)
    return found


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable) for each row of docs (doc_id, text)."""
    prints = materialize(fingerprints(docs), "fingerprints")
    return prints.join(components(prints, distance).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: one whose doc_id names its component, if any has a doc_id. Rows are
    told apart by a key, as a doc_id may be null or repeated."""
    rows = with_row_key(docs, "near-rows")
    prints = materialize(fingerprints(rows, ROW), "fingerprints")
    found = prints.join(components(prints).hint("merge"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW))
    stay = found.groupBy("root").agg(first.alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in ROW])
    return rows.join(stay.hint("merge"), list(ROW), "left_semi").select(*docs.columns)
