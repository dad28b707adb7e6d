import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from axiloom.llm import mixing, packing, queries

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("bits", [6, 16])
def test_mix(spark, make, corpus, bits):
    sources = [[None, "a", "b", "é", "c"][k % 5] if k % 3 else "big" for k in range(len(corpus))]
    docs = make(corpus, sources)
    found, stream = mixing.mix(docs, bits=bits)
    rows = found.collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for t, s in zip(corpus, sources):
        sizes[s] += len((t or "").encode().split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["size"] == len((corpus[r["doc_id"]] or "").encode().split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), bits=bits)[0].collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    per_doc = defaultdict(int)
    for r in stream.collect():
        assert 0 <= r["start"] and r["length"] > 0
        per_doc[r["doc_id"]] += r["length"]
    assert dict(per_doc) == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


SOURCES = "sid long, source string, source_size long, target double"


def test_schedule_is_even(spark):
    src = spark.createDataFrame([(0, "a", 10_000, 5000.0), (1, "b", 10_000, 2000.0), (2, "c", 10_000, 1000.0)], SOURCES)
    slots = sorted(mixing.schedule(src, bits=10).collect(), key=lambda r: r["slot"])
    for n in (100, 300, 900):
        share = np.bincount([r["sid"] for r in slots[:n]], minlength=3) / n
        np.testing.assert_allclose(share, [0.625, 0.25, 0.125], atol=0.02)


def test_ranks_are_those_of_sorted_points(spark, monkeypatch):
    """Slots against the van der Corput sequence itself, in many chunks and with sources of hardly a point."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    weights = [700.0, 0.7, 300.0, 1.2, 22.1, 0.0, 3.0]
    src = spark.createDataFrame([(k, str(k), 2000, w) for k, w in enumerate(weights)], SOURCES)
    for bits in (4, 9, 12):
        n = 1 << bits
        point = [int(f"{t:0{bits}b}"[::-1], 2) for t in range(n)]
        edges = np.round(np.cumsum([0, *np.round(np.array(weights) * 1024)]) / np.round(np.array(weights) * 1024).sum() * n).astype(int)
        got = defaultdict(dict)
        for r in mixing.schedule(src, bits).collect():
            got[r["sid"]][r["rank"]] = r["slot"]
        for k in got:
            times = [t for t in range(n) if edges[k] <= point[t] < edges[k + 1]]
            own = [got[k][r] for r in range(len(got[k]))]
            assert own[: len(times)] == times[: len(own)] and all(t >= n for t in own[len(times) :])
        assert set(got) == {k for k, w in enumerate(weights) if w >= 0.5}


def test_the_schedule_decides_when_documents_come(spark, make, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(5, 60, 900)]
    sources = [str(rng.choice(["a", "b", "c"], p=[0.4, 0.3, 0.3])) for _ in texts]
    docs = make(texts, sources)
    found = mixing.mix(docs)[0].collect()
    taken = defaultdict(int)
    for r in found:
        taken[r["source"]] += r["taken"]
        assert (r["taken"] > 0) == (r["slots"] > 0) == (r["first_slot"] is not None)
    share = {s: n / sum(taken.values()) for s, n in taken.items()}
    # in any beginning of the mix, sources have about the shares that they have in all of it
    stream = sorted(mixing.mix(docs)[1].collect(), key=lambda r: (r["slot"], r["at"]))
    for part in (0.1, 0.25, 0.6):
        have, at = defaultdict(int), 0
        for r in stream:
            if at < part * sum(taken.values()):
                have[r["source"]] += r["length"]
                at += r["length"]
        assert all(abs(have[s] / at - share[s]) < 0.02 for s in share)
    # and in the table that the pipeline goes on with, whose partitions are read side by side
    parts = mixing.mixed_documents(docs).rdd.glom().collect()
    for part in (0.2, 0.5):
        some = [r for f in parts for r in f[: int(part * len(f))]]
        words = sum(r["text"].count("w") for r in some)
        assert all(abs(sum(r["text"].count("w") for r in some if r["source"] == s) / words - share[s]) < 0.06 for s in share)
    # another schedule, another order
    monkeypatch.setattr(mixing, "reversed_bits", lambda df, source, out, bits: df.withColumn(out, df[source]))
    other = mixing.mix(docs)[0].collect()
    assert {(r["doc_id"], r["first_slot"]) for r in other} != {(r["doc_id"], r["first_slot"]) for r in found}


def test_many_sources(spark, make):
    """As many sources as documents, and hosts of which one has a third of all rows."""
    texts = [f"w{k} " * (k % 7) for k in range(3000)]
    sources = [f"host{k}" if k % 3 else "hot" for k in range(3000)]
    rows = mixing.mix(make(texts, sources))[0].collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == 3000 and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixed_documents_and_odd_tables(spark, make, corpus):
    docs = make(corpus, ["a" if k % 2 else "b" for k in range(len(corpus))])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r["doc_id"]] += 1
    found = {r["doc_id"]: r for r in mixing.mix(docs)[0].collect()}
    assert max(n.values()) <= 2 and all(abs(n[k] * r["size"] - r["taken"]) <= r["size"] / 2 for k, r in found.items())
    assert mixing.mix(make([]))[0].count() == 0
    assert [(r["target"], r["taken"]) for r in mixing.mix(make([None, ""]))[0].collect()] == [(0.0, 0)] * 2
    assert mixing.mix(make(["a b c"], ids=[None]))[0].collect()[0]["taken"] in (4, 5)  # the target is 4.5
    assert mixing.mix(make(["a b", "a b"], ids=[1, 1]))[0].count() == 2


def test_mixed_rows_that_share_an_id_are_taken_one_by_one(spark, make):
    """Source b is to come 1.4 times: its rows, all with a null or the same doc_id, can't all come twice."""
    texts = [f"w{k} " * 20 for k in range(60)]
    for doc in (None, 4):
        docs = make(texts, ["b"] * 50 + ["a"] * 10, ids=[doc] * 60)
        found = mixing.mix(docs)[0].collect()
        want = {s: sum(r["taken"] for r in found if r["source"] == s) / 20 for s in "ab"}
        out = mixing.mixed_documents(docs).collect()
        for s in "ab":
            assert abs(sum(r["source"] == s for r in out) - want[s]) <= 1


def pieces_of(text):
    ids = [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 1]
    return [(k, ids[k : k + 2048], len(ids)) for k in range(0, len(ids), 2048)]


def check_packing(rows, texts):
    got = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = sorted((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), n) for k, t in enumerate(texts) for at, ids, n in pieces_of(t))
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
    return used, len(sequences)


def test_pack(spark, make, corpus):
    texts = [*corpus, "don't I'LL <|endoftext|> x<|startoftext|>0 0 00 a0b", "é́   ½ Σας", "word, word. (word) 12.5%"]
    used, n = check_packing(packing.pack(make(texts), VOCABULARY).collect(), texts)
    assert n <= used / 2048 + 2
    assert packing.pack(make([]), VOCABULARY).count() == 0
    ids = packing.pack(make(["a b"]), VOCABULARY, keep_ids=True).collect()[0]["ids"]
    assert list(ids) == pieces_of("a b")[0][1]


def test_ids_are_the_tokenizers():
    """Words cut at punctuation, encoded together and without a normalizer, against the tokenizer on whole texts."""
    whole, encode, rng = Tokenizer.from_file(VOCABULARY), packing._ids_of(VOCABULARY), np.random.default_rng(3)
    texts = ["I'LL <|endoftext|> I'LL'S", "a\x1cb \x85x", "sİ'", "İ.\u0301", "'", "\u0301a"]
    texts += ["".join(rng.choice(list("abAB0'.,!-é½Σ \t\n<|>sSİ\u0301\x1f\x00漢"), rng.integers(1, 30))) for _ in range(3000)]
    for t, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_patterns_fill_windows():
    rng = np.random.default_rng(1)
    counts = {int(k): int(rng.integers(1, 90)) for k in rng.integers(1, 100, 60)}
    rows = packing.patterns(counts, 100)
    placed, load = defaultdict(int), defaultdict(int)
    for length, a, b, copies, sequence, offset in rows:
        placed[length] += b - a
        for k in range((b - a) // copies):
            load[sequence + k] += length * copies
    assert placed == counts and max(load.values()) <= 100
    # long items that nothing is left to go with keep their windows: as many windows as first-fit decreasing, or nearly
    rooms: list[int] = []
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= k), None)
        if at is None:
            rooms.append(100)
            at = len(rooms) - 1
        rooms[at] -= k
    assert len(load) <= 1.02 * len(rooms) + 1
    assert packing.fill({7: 3, 5: 2}, 17) == (17, {7: 1, 5: 2}) and packing.patterns({}) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_queries_and_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, f in queries.QUERIES.items():
        rows = f(spark, sf).count()
        assert rows == n or name in ("op8_html_text", "op9_packing", "op10_licences"), name
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            if k < 3:
                assert 0 < docs.count() <= before.count()
    rows = docs.collect()
    texts = before.orderBy("doc_id").collect()
    assert sum(r["length"] for r in rows) == sum(x[2] for t in texts for x in pieces_of(t["text"])[:1])
