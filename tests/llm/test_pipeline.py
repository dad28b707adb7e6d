"""Each stage of the pipeline against a brute-force version, on its own input."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_classify import brute_statistics
from test_dedup import brute_components, brute_fingerprint, lower
from test_mix_pack import brute_targets, check_packing

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words string"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def run_stages(spark, rows, labels, folder):
    """(name, input rows, output) of each stage, written and read again as the next one's documents."""
    spark.createDataFrame(rows, KINDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
        found.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, rows_of(docs), after))
        docs = after
    return out


def documents():
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    base = [text(r.randint(12, 300)) for _ in range(60)]
    junk = [" ".join(w + "$$$###" for w in text(40).split()) for _ in range(40)]
    near = base[3].split()
    texts = [*base, *junk, None, "", " \n", "too short", "again and again " * 30, base[1].upper(), base[1], base[1], text(6000)]
    texts += [" ".join(near[:k] + ["zz"] + near[k + 1 :]) for k in range(8)]
    ids = [k if k % 9 else (None if k % 2 else 18) for k in range(len(texts))]
    sources = [[None, "a", "b", "é"][k % 4] if k % 3 else "hot" for k in range(len(texts))]
    rows = [(i, t, None, s, 1, 2, "x") for i, t, s in zip(ids, texts, sources)]
    labels = [(i, int(t in base), 0) for i, t in zip(ids, texts) if i is not None and t and i != 18]
    return rows + rows[5:8] + rows[18:20], labels, set(base), set(junk)


def test_each_stage(spark, tmp_path):
    rows, labels, clean, junk = documents()
    stages = {name: (before, after) for name, before, after in run_stages(spark, rows, labels, str(tmp_path))}

    before, after = stages["quality_rules"]
    kept = rows_of(after)
    assert sum(before.values()) == len(rows)
    for row, n in before.items():
        words, _, _, _, repeated = brute_statistics(row[1])
        if words < 10 or 100 * repeated > 20 * words:
            assert row not in kept, row[1]
        if row[1] in clean:
            assert kept[row] == n
    assert sum(r[1] in junk for r in kept) <= 0.1 * len(junk)  # what is learned leaves a margin

    before, after = stages["exact_dedup"]
    best = {}
    for row in before:
        key = lower(row[1])
        best[key] = max(best.get(key, (-1,)), (-1 if row[0] is None else row[0],))
    found = rows_of(after)
    assert sorted((lower(r[1]), -1 if r[0] is None else r[0]) for r in found.elements()) == sorted((k, v[0]) for k, v in best.items())
    assert all(r in before for r in found)

    before, after = stages["simhash_near_dedup"]
    all_ = list(before.elements())
    roots = brute_components([brute_fingerprint(r[1]) for r in all_])
    groups = defaultdict(list)
    for root, r in zip(roots, all_):
        groups[root].append(r)
    found = rows_of(after)
    assert sum(found.values()) == len(groups)
    for g in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert sum(found[r] for r in set(g) if (r[0] is None, r[0] or 0) == least) == 1

    before, after = stages["mixing"]
    sizes, taken, found = Counter(), Counter(), rows_of(after)
    for r, n in before.items():
        sizes[r[3]] += n * len(r[1].split())
    for r, n in found.items():
        assert n <= 2 * before[r]
        taken[r[3]] += n * len(r[1].split())
    longest = max(len(r[1].split()) for r in before)
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= longest

    before, after = stages["packing"]
    texts = list(before.elements())
    # rows that share a doc_id can't be told apart in the result: number them
    again = [(k, *r[1:]) for k, r in enumerate(texts)]
    packed = corpus_pipeline.packing_stage(spark, spark.createDataFrame(again, KINDS), str(tmp_path))
    used, n = check_packing(packed.collect(), [r[1] for r in again])
    assert n <= used / 2048 + 3
    key = lambda r: (r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert Counter(map(key, after.collect())) == Counter(map(key, packed.collect()))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(key, whole.collect())) == Counter(map(key, after.collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)] * 3, [(4, "one two three four five six seven eight nine ten eleven", None, "s", 1, 2, "x")] * 5])
def test_small_and_repeated_tables(spark, tmp_path, rows):
    stages = run_stages(spark, rows, [], str(tmp_path))
    left = [sum(before.values()) for _, before, _ in stages] + [stages[-1][2].count()]
    assert left[1:3] == ([5, 1] if rows and rows[0][1] else [0, 0]) and left[3] == min(1, left[2])
    assert left[4] == left[5] == (2 if left[3] else 0)  # one and a half times, which counts as twice
