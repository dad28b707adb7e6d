import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from axiloom.llm import exact_dedup, repeats, simhash
from axiloom.llm.common import fresh_path
from axiloom.llm.components import connected_components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, make, corpus):
    rows = exact_dedup.exact_dedup(make(corpus)).collect()
    groups = defaultdict(list)
    for k, t in enumerate(corpus):
        groups[lower(t)].append(k)
    assert len(rows) == len(corpus)
    for r in rows:
        g = groups[lower(corpus[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
        assert r["text_sha256"] == hashlib.sha256(lower(corpus[r["doc_id"]]).encode()).hexdigest()
    kept = exact_dedup.drop_copies(make(corpus))
    assert kept.columns == make([]).columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.exact_dedup(make([])).count() == 0 and exact_dedup.drop_copies(make([])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_digests_are_combined_before_they_are_shuffled(spark, make):
    hot = make(["same text"] * 3000).repartition(6)
    digests = hot.select("doc_id", exact_dedup.text_digest(hot["text"]).alias("digest"))
    plan = exact_dedup.distinct_digests(digests)._jdf.queryExecution().executedPlan().toString()
    last, first = plan.index("Exchange hashpartitioning(digest"), plan.index("partial_max")
    assert plan.index("HashAggregate") < last < first and plan.count("hashpartitioning(digest") == 1
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=2)
    before, plans = index.append, []

    def append(groups, batch):
        plans.append(groups._jdf.queryExecution().optimizedPlan().toString())
        before(groups, batch)

    index.append = append
    rows = exact_dedup.exact_dedup(hot, index).collect()
    # read from files: nothing is left that the anti-join could be moved below
    assert plans[0].startswith("Relation") and {(r["keep_id"], r["group_size"]) for r in rows} == {(2999, 3000)} and sum(r["kept"] for r in rows) == 1


def test_rows_with_null_or_repeated_ids_are_dropped_one_by_one(spark, make):
    far = [" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd", "ef", "gh")]
    cases = [
        ([(None, far[0]), (None, far[1]), (3, far[1])], {(None, far[0]): 1, (3, far[1]): 1}, None),
        ([(5, far[0]), (5, far[1]), (9, far[1])], {(5, far[0]): 1, (9, far[1]): 1}, {(5, far[0]): 1, (5, far[1]): 1}),
        ([(7, far[2])] * 3 + [(None, far[3])] * 2, {(7, far[2]): 1, (None, far[3]): 1}, None),
    ]
    for rows, exact, near in cases:
        docs = make([t for _, t in rows], ids=[k for k, _ in rows])
        assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(docs).collect()) == exact
        assert Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()) == (near or exact)


def test_index_remembers_batches(spark, make):
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "index"), buckets=3)
    exact_dedup.exact_dedup(make(["a", "b", "B"]), index, "one").collect()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=3)
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(make(["A", "c", "c"], ids=[10, 11, 12]), again, "two").collect()}
    assert (rows[10]["kept"], rows[10]["keep_id"]) == (False, 0)
    assert not rows[11]["kept"] and rows[12]["kept"] and again.entries().count() == 3
    rerun = {r["doc_id"]: r for r in exact_dedup.exact_dedup(make(["A", "c", "c"], ids=[10, 11, 12]), again, "two").collect()}
    assert rerun == rows
    kept = exact_dedup.drop_copies(make(["a", "d", "D", "c"], ids=[20, 21, 21, 23]), again, "three").collect()
    assert [(r["doc_id"], r["text"]) for r in kept] in ([(21, "d")], [(21, "D")]) and again.entries().count() == 4
    again.forget()
    assert exact_dedup.DigestIndex(spark, index.path, buckets=3).entries().count() == 4


def brute_fingerprint(t):
    w = lower(t).encode().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, make, corpus):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(make(corpus)).collect()}
    fps = [brute_fingerprint(t) for t in corpus]
    assert [rows[k]["fp"] for k in range(len(corpus))] == [simhash.signed(f) for f in fps]
    want = brute_components(fps)
    assert [rows[k]["component_id"] for k in range(len(corpus))] == want
    kept = simhash.one_of_each(make(corpus))
    assert kept.columns == make([]).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(make([])).count() == 0


def test_null_ids_link_fingerprints(spark, monkeypatch):
    """A chain that passes through rows with a null doc_id, copies among them, and a group without any doc_id."""
    chain = [0, 0b111, 0b111111, 0xF00FF00F0000, 0xF00FF00F0000, 0xF00FF00F0001]
    prints = spark.createDataFrame(list(zip([1, None, 2, None, None, None], chain)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    rows = simhash.near_duplicates(prints).collect()
    assert sorted(((r["fp"], r["component_id"]) for r in rows)) == [(f, 1 if k < 3 else None) for k, f in enumerate(chain)]


@pytest.mark.parametrize("flips", [3, 4, 5])
def test_links_of_dense_and_random_fingerprints(spark, flips):
    """A large group of fingerprints around one, pairs at just the distance, and many that are alone."""
    rng = np.random.default_rng(flips)
    one = [int(rng.integers(0, 1 << 63)) for _ in range(300)]
    dense = [one[0] ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))) for _ in range(400)]
    pairs = [f ^ sum(1 << int(b) for b in rng.permutation(64)[:flips]) for f in one[1:100]]
    fps = list(dict.fromkeys(one + dense + pairs))
    nodes = spark.createDataFrame([(simhash.signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == brute_components(fps)


def roots_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def near_pairs(fp, distance):
    for i in range(len(fp) - 1):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance):
            yield i, i + 1 + int(j)


def crowd(rng, n, dense, pairs, loose=0):
    """Fingerprints of one cell: alone, around one of them, in pairs, and some that differ in few bits at all."""
    fixed = np.uint64(0x3FF3FF3FF)
    alone = rng.integers(0, 1 << 64, n, np.uint64) & ~fixed | np.uint64(0x155) & fixed
    spread = np.flatnonzero([int(~fixed) >> k & 1 for k in range(64)])
    flipped = lambda f, most: f ^ np.uint64(sum(1 << int(b) for b in rng.permutation(spread)[: rng.integers(1, most + 1)]))
    out = [alone, np.array([flipped(alone[0], 3) for _ in range(dense)], np.uint64), np.array([flipped(f, 4) for f in alone[1 : pairs + 1]], np.uint64)]
    out.append(alone[-1] & ~np.uint64(0xFFFFFFFF) | rng.integers(0, 1 << 17, loose, np.uint64) << np.uint64(40) & ~fixed)
    return rng.permutation(np.unique(np.concatenate(out)))


@pytest.mark.parametrize(("dense", "loose"), [(0, 0), (900, 0), (0, 700), (2500, 300)])
def test_crowded_cells_are_searched_exactly(dense, loose):
    fp = crowd(np.random.default_rng(dense + loose), 2500, dense, 300, loose)
    ids = np.arange(len(fp))
    a, b = simhash._links((np.zeros(len(fp), np.int8), np.zeros(len(fp), np.int64), fp, ids), 4)
    assert roots_of(len(fp), zip(a.tolist(), b.tolist())) == roots_of(len(fp), near_pairs(fp, 4))


def test_a_cell_of_200000_takes_little_more_than_one_of_50000():
    rng = np.random.default_rng(9)

    def took(n):
        fp = crowd(rng, n, n // 50, n // 4)
        ids = np.arange(len(fp))
        began = time.process_time()
        a, b = simhash._links((np.zeros(len(fp), np.int8), np.zeros(len(fp), np.int64), fp, ids), 4)
        pairs = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        assert n // 4 <= len(pairs) == len(a) < n
        return time.process_time() - began

    small, large = took(50_000), took(200_000)
    assert large < 12 * small + 1  # all pairs would take 16 times as long, and minutes


def test_cells_are_a_lower_bound():
    masks = simhash.block_masks()
    assert sum(masks) == (1 << 64) - 1
    even = simhash._EVEN
    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, 1 << 63, (200, 2)).tolist():
        code = lambda f: ((f & (f >> 1) & even) << 1) | ((f | (f >> 1)) & even)
        counts = lambda f: [(f >> k & 3).bit_count() for k in range(0, 64, 2)]
        manhattan = sum(abs(x - y) for x, y in zip(counts(a), counts(b)))
        assert (code(a) ^ code(b)).bit_count() == manhattan <= (a ^ b).bit_count()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 500)] + [(3, 3), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(101, 161)) and all(got[k] == 7 for k in range(300, 500)) and got[901] == 900 and 3 not in got


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    starts = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 100), (40, 16)])
def test_repeats(spark, make, corpus, length, gram):
    rows = {r["doc_id"]: r for r in repeats.remove_repeats(make(corpus), length, gram, keep_text=True).collect()}
    want = brute_repeats(corpus, length)
    got = [(rows[k]["n_bytes"], rows[k]["n_removed"], rows[k]["n_spans"], rows[k]["kept_sha256"]) for k in range(len(corpus))]
    assert got == want
    assert sum(b - a for r in rows.values() for a, b in r["spans"]) == sum(w[1] for w in want) > 0
    assert repeats.remove_repeats(make([])).count() == 0
    # rows that share a doc_id, or have none, each lose what they lose by themselves
    ids = [None if k % 2 else 5 for k in range(len(corpus))]
    shared = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(make(corpus, ids=ids), length, gram).collect())
    assert shared == Counter(want)


def test_loser_tree_merges_and_keeps_prefixes():
    rng = np.random.default_rng(1)
    runs = [sorted((bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()), b"l", 1) for _ in range(rng.integers(0, 30))) for _ in range(5)]
    merged = list(repeats.merge([repeats.decode(repeats.front_code(r)) for r in runs]))
    assert [m[1] for m in merged] == sorted(x[0] for r in runs for x in r)
    assert all(b[0] == repeats.common(a[1], b[1]) for a, b in zip(merged, merged[1:]))
    assert list(repeats.merge([])) == []


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 200).tolist())
    found = []
    for lead in (0, 1, 57, 333):
        text = bytes(rng.integers(97, 123, lead).tolist()) + passage + bytes(rng.integers(97, 123, 400).tolist())
        p, _ = repeats.anchors(text)
        found.append({int(x) - lead for x in p if lead <= x <= lead + 100})
    assert set.intersection(*found)
