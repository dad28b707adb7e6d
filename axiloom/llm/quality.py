"""Quality rules: text statistics and a learned decision list, all as Column expressions.

Sequential covering on labelled statistics learns an ordered list of threshold conjunctions, each of which rejects.
Training never collects rows: features are cut at learned thresholds, the labelled rows are counted per cell of cut
features, and the driver grows and prunes rules on those counts. Their number is bounded by the cuts, not by the data.

Defined results: a null text has no words and zero counts, and fails the base rules; without labelled rows the list is
empty and the base rules alone decide; extra columns are ignored by the statistics and kept by the filter; rows that
repeat a doc_id are counted and judged each, with the largest of their labels; an empty table gives no rows. A list has at
most ``most_rules`` rules of at most MOST_CONDITIONS conditions: what it says must stay readable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import SPACE, let, materialize, words
from axiloom.llm.sampling import sample_by_class

#: What rules may test, as ratios of the counted statistics.
FEATURES = {
    "words": "n_words", "mean_word": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)", "echoes": "n_echoes / greatest(n_words, 1)",
}
WINDOW, MOST_CONDITIONS = 5, 4
#: Labelled rows of each class that the pipeline's list is learned from, about.
PER_CLASS = 10_000


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur more than once: sort (hash, place), mark equal neighbours, merge places."""

    def marked(pairs: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, j)["h"], F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        places = F.sort_array(F.transform(hits, lambda k: F.get(pairs, k)["i"]))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["p"])).alias("n"), p.alias("p"))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p"))
        return F.aggregate(places, first, step, lambda acc: acc["n"])

    return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals and n_echoes (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.char_length(F.regexp_replace(body, pattern, ""))

    def of_hashes(h: Column) -> list[Column]:
        n = F.size(h)
        last = F.greatest(n - (WINDOW - 1), F.lit(0))
        spans = F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        repeated = let(spans, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.lit(0)).otherwise(_covered(s)))
        shorter = F.greatest(n - 1, F.lit(0))
        echo = F.zip_with(F.slice(h, 1, shorter), F.slice(h, 2, shorter), lambda a, b: a == b)
        return [n.alias("n_words"), repeated.alias("n_repeat_words"), F.size(F.filter(echo, lambda x: x)).alias("n_echoes")]

    def of_words(w: Column) -> Column:
        hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(*of_hashes(h)))
        return F.struct(F.char_length(F.array_join(w, "")).alias("word_chars"), hashed.alias("h"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    lines = let(F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), of_lines)
    found = F.struct(let(words(F.col(text)), of_words).alias("w"), lines.alias("l"), count(r"[^#*$%&|<>]+").alias("n_symbols"), count("[^A-Z]+").alias("n_capitals"))
    # a generator: no filter on the counts is ever moved below it, to be computed many times over
    wide = docs.select("*", F.inline_outer(F.array(found)))
    names = {"n_words": "w.h.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.h.n_repeat_words"}
    names |= {"n_lines": "l.n_lines", "n_capitals": "n_capitals", "n_echoes": "w.h.n_echoes"}
    return wide.select(*docs.columns, *[F.col(v).cast("long").alias(k) for k, v in names.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); ``above`` says on which side of the threshold it holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.expr(FEATURES[f]) > t if above else F.expr(FEATURES[f]) <= t for f, above, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:g}" for f, above, t in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and what no rule meets is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rejects(self) -> Column:
        """1-based number of the first rule that holds, 0 if none does."""
        out = None
        for k, r in enumerate(self.rules, 1):
            out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
        return F.lit(0) if out is None else out.otherwise(0)

    def kept(self) -> Column:
        return ~base_failed() & (self.rejects() == 0)


def learn(stats: DataFrame, labels: DataFrame, least_precision: float = 0.95, least_cover: int = 5, most_rules: int = 12) -> DecisionList:
    """Learn from all rows of ``stats`` whose doc_id has a label ``quality`` (0 is what rules shall reject).

    A third of the labelled rows, by hash of doc_id, is held back from growing: rules are pruned on it, and one stays
    only if at least ``least_precision`` of what it rejects there is labelled 0.
    """
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ratios = [F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]
    rows = stats.where(~base_failed()).select("doc_id", *ratios).join(named, "doc_id")
    rows = materialize(rows, "labelled-statistics")
    levels = {0: [0.05, 0.25, 0.5, 0.75, 0.95], 1: [0.01, 0.5, 0.99, 1.0]}
    cuts: dict[str, set[float]] = {f: set() for f in FEATURES}
    for q, at in levels.items():
        got = rows.where(F.col("quality") == q).agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
        for f in FEATURES:
            cuts[f] |= set(got[f] or [])
    # cut half way between neighbouring levels, for a margin on either side
    for f in FEATURES:
        levels_ = sorted(cuts[f])
        cuts[f] = {float(f"{(a + b) / 2:.3g}") for a, b in zip(levels_, levels_[1:])}
    names = list(FEATURES)
    bins = [sum((F.col(f) > t).cast("int") for t in sorted(cuts[f])) if cuts[f] else F.lit(0) for f in names]
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    counts = [F.count_if((F.col("quality") == q) & (part if held else ~part)) for held in (False, True) for q in (0, 1)]
    cells = rows.groupBy(*[b.alias(f) for b, f in zip(bins, names)]).agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).collect()
    if not cells:
        return DecisionList()
    return _cover([(tuple(r[: len(names)]), tuple(r[len(names) :])) for r in cells], names, {f: sorted(cuts[f]) for f in names}, least_precision, least_cover, most_rules)


def _cover(cells: list[tuple[tuple[int, ...], tuple[int, ...]]], names: list[str], cuts: dict[str, list[float]], least_precision: float, least_cover: int, most_rules: int) -> DecisionList:
    """Sequential covering over counted cells ((bin of each feature), (grow 0s, grow 1s, prune 0s, prune 1s))."""
    bins = np.array([c[0] for c in cells], np.int64).reshape(-1, len(names))
    counts = np.array([c[1] for c in cells], np.int64).reshape(-1, 4)

    def holds(condition) -> np.ndarray:
        k, above, b = condition
        return (bins[:, k] > b) == above

    def all_hold(rule) -> np.ndarray:
        return np.logical_and.reduce([holds(c) for c in rule], axis=0) if rule else np.ones(len(bins), bool)

    def best_condition(inside: np.ndarray):
        """The condition with the most FOIL-like gain on the cells inside; of those on the same feature and side
        that come within a twentieth of it, the one that rejects the fewest rows, and of those the strictest."""
        bad, good = counts[inside, 0].sum(), counts[inside, 1].sum()
        seen = []
        for k, f in enumerate(names):
            zeros, ones = (np.bincount(bins[inside, k], counts[inside, i], len(cuts[f]) + 1).cumsum() for i in (0, 1))
            for b in range(len(cuts[f])):
                for above, x, y in ((True, bad - zeros[b], good - ones[b]), (False, zeros[b], ones[b])):
                    worth = x * (x / (x + y) - bad / (bad + good)) if x >= least_cover else 0.0
                    seen.append((worth, x + y, (k, above, b)))
        worth, _, best = max(seen, default=(0.0, 0, None), key=lambda s: s[0])
        if worth <= 1e-9:
            return None
        close = [s for s in seen if s[2][:2] == best[:2] and s[0] >= 0.95 * worth]
        return min(close, key=lambda s: (s[1], -s[2][2] if s[2][1] else s[2][2]))[2]

    def pruned_value(rule) -> float:
        zeros, ones = counts[left & all_hold(rule)][:, 2:].sum(axis=0)
        return (zeros - ones) / (zeros + ones + 1)

    found: list[Rule] = []
    left = np.ones(len(bins), bool)
    while len(found) < most_rules:
        rule: list[tuple[int, bool, int]] = []
        inside = left
        while counts[inside, 0].sum() and counts[inside, 1].sum() and len(rule) < MOST_CONDITIONS:
            if (c := best_condition(inside)) is None:
                break
            rule.append(c)
            inside = inside & holds(c)
        while len(rule) > 1 and pruned_value(rule[:-1]) >= pruned_value(rule):
            rule.pop()
        grown = counts[left & all_hold(rule)].sum(axis=0)
        sure = lambda zeros, ones: zeros and zeros >= least_precision * (zeros + ones)
        if not rule or grown[0] < least_cover or not sure(*grown[:2]) or not sure(*grown[2:]):
            break
        found.append(Rule(tuple((names[k], above, cuts[names[k]][b]) for k, above, b in rule)))
        left = left & ~all_hold(rule)
    return DecisionList(found)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of each row of ``docs`` (doc_id, text): one pass over the texts, then narrow rows only."""
    stats = materialize(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = learn(stats, labels)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select(*out, base_failed().alias("base_failed"), rules.kept().alias("kept"), rules.rejects().alias("rule"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the base rules or the learned list don't reject, all columns as they are, whatever their
    names. The list is learned from at most about ``per_class`` labelled rows of each class, so that statistics are
    computed about once, beside the texts, of which none is shuffled or written. Rows that repeat a doc_id, or have
    none, are judged each by its own text; an empty table gives an empty one."""
    marks = labels.where("quality in (0, 1) and doc_id is not null")
    few = sample_by_class(marks, "quality", F.col("doc_id"), per_class).select("doc_id", "quality")
    # few by the sample's bound, which is what makes a broadcast fit at any size of the tables
    some = docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi")
    rules = learn(with_statistics(some).drop("text"), few)
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("_text"))
    return with_statistics(inner, "_text").where(rules.kept()).select("_row.*")
