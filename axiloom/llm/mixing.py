"""Mixing sources to target weights with a low-discrepancy schedule.

The schedule has 2^k slots of about SLOT_WORDS words. The van der Corput sequence in base 2 visits the k-bit points in
bit-reversed order; a source owns the points inside its stretch of the cumulative targets, so it comes up evenly at
every scale. Its slots are ranked in time, and the r-th takes block r of the source: documents in shuffled order, cut
into blocks of equal numbers of words, from the start again once all are used. What a document contributes, and when, is
read off the slots that its blocks meet. The last slot of a source is cut where its target is met, and one that its
points don't reach comes after all others.

A slot's rank among those of its source is counted from its bits, without a sort, and slots are made in chunks: no task
ever holds a source, nor the sources, whatever their number.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own, last in order;
rows that repeat a doc_id count and are taken like any other; a text of any length is one row, and meets as many blocks
as it is long; without words every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import ROW, materialize, prefix_sums, running_sums, with_row_key, words

WEIGHTS = (5, 2, 1)
#: Words of a slot, about; bounds of the number of bits; slots made at a time; documents in a bucket of a source, about.
SLOT_WORDS, BITS, CHUNK, BUCKET_ROWS = 512, (12, 40), 1 << 14, 1 << 19
#: Targets are added up in whole parts of a word, so that sums don't depend on their order.
PARTS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Sources in code-point order, nulls last, get the weights in turn. Targets share ``share`` of all sizes by weight
    but stop at ``most`` times the source's size; what that leaves over goes to the others by weight. With the sources
    in the order in which they reach their limit, the level of those that don't is the largest of the levels that
    result when the first 0, 1, 2 ... are held at their limits.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = running_sums(src, [F.col("source").asc_nulls_last()], {"sid": F.lit(1)}, "sources-by-name")
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(most))
    src = materialize(running_sums(src, [F.col("cap") / F.col("w"), F.col("sid")], {"held": F.col("cap"), "lighter": F.col("w")}, "sources-by-limit"), "levels")
    total, weight = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("w")).first()
    level = src.agg(F.max((F.lit(total * share) - F.col("held")) / (F.lit(weight) - F.col("lighter")))).first()[0] or 0.0
    target = F.greatest(F.lit(0.0), F.least("cap", F.lit(level) * F.col("w")))
    return src.select("sid", "source", "source_size", target.alias("target"))


def reversed_bits(df: DataFrame, source: str, out: str, bits: int) -> DataFrame:
    """Add ``out``: the lowest ``bits`` bits of ``source`` in reverse, by swaps of ever larger neighbours."""
    df = df.withColumn(out, F.col(source))
    for k, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x, low = F.col(out), F.lit(mask)
        df = df.withColumn(out, F.shiftrightunsigned(x, k).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(low), k)))
    x = F.col(out)
    return df.withColumn(out, F.shiftrightunsigned(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)), 64 - bits))


def _rank(bits: int) -> Column:
    """How many of the points from lo to below hi come before ``point``.

    The times before the point's own fall into one run for each bit set in it: those that agree with it above that bit's
    place in time. Their points are an arithmetic progression, whose members below a bound are a quotient.
    """
    below = "greatest(0L, shiftright({} - (point & (shiftleft(1L, m) - 1L)) + shiftleft(2L, m) - 1L, m + 1))"
    step = f"acc + if((shiftright(point, m) & 1L) = 1L, {below.format('hi')} - {below.format('lo')}, 0L)"
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (acc, m) -> {step})")


def slot_bits(total: float, words: int = SLOT_WORDS) -> int:
    """Bits of a schedule for so many words."""
    return min(BITS[1], max(BITS[0], math.ceil(math.log2(max(1.0, total / words)))))


def schedule(src: DataFrame, bits: int) -> DataFrame:
    """The slots of each source: sid, slot (time), rank, block, epoch and take (words); see block_width()."""
    n = 1 << bits
    src = src.withColumn("parts", F.round(F.col("target") * PARTS).cast("long"))
    whole = src.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0] or 1
    s = running_sums(src, [F.col("sid")], {"parts_before": F.col("parts")}, "sources-in-line")
    at = lambda parts: F.round(parts / F.lit(float(whole)) * n).cast("long")
    s = s.withColumns({"lo": at(F.col("parts_before")), "hi": at(F.col("parts_before") + F.col("parts"))}).where("target >= 0.5 and source_size > 0")
    s = s.withColumn("width", F.lit(_width(whole, n)))
    s = s.withColumns({"quota": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / F.col("width")).cast("long")})
    s = s.withColumn("need", F.expr("(quota div source_size) * blocks + ceil((quota % source_size) / width)").cast("long"))
    s = s.withColumn("n", F.greatest("need", F.col("hi") - F.col("lo"))).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    spread = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.repartition(spread, "sid", "chunk").withColumn("r", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")))
    s = reversed_bits(s.withColumn("point", F.col("lo") + F.col("r")), "point", "time", bits)
    # slots beyond those that the points give come last; a source whose points are too many leaves some unused
    early = F.col("point") < F.col("hi")
    s = s.withColumn("slot", F.when(early, F.col("time")).otherwise(F.col("r") + n)).withColumn("rank", F.when(early, _rank(bits)).otherwise(F.col("r"))).where("rank < need")
    s = s.withColumns({"block": F.expr("rank % blocks"), "epoch": F.expr("rank div blocks")})
    length, left = F.expr("least(width, source_size - block * width)"), F.expr("quota - epoch * source_size - block * width")
    return s.select("sid", "slot", "rank", "block", "epoch", F.least(length, left).alias("take"))


def _width(parts: int, n: int) -> int:
    return max(1, math.ceil(parts / PARTS / n))


def block_width(src: DataFrame, bits: int) -> int:
    """Words of a block: those of all targets by the number of slots."""
    return _width(src.agg(F.sum(F.round(F.col("target") * PARTS).cast("long"))).first()[0] or 0, 1 << bits)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, bits: int | None = None, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, stream).

    documents: for each row of docs doc_id, size, source, source_size, target, the columns ``carry``, taken (words),
    first_slot (the time it is first taken at; null if never), slots (how many take from it) and starts (the first slot
    of each time round). stream: what each slot takes, as slot, epoch, source, doc_id, start, length in words, in the
    order (slot, at).
    """
    size = F.size(words(F.col("text"))).cast("long")
    sizes = materialize(docs.select("doc_id", "source", size.alias("size"), *carry), "sizes")
    src = materialize(targets(sizes, weights, share, most), "sources")
    rows, total = sizes.count(), src.agg(F.sum("target")).first()[0] or 0.0
    bits = bits or slot_bits(total)
    width = block_width(src, bits)
    named = sizes.join(src, sizes["source"].eqNullSafe(src["source"])).drop(src["source"])
    placed = prefix_sums(named, ["sid"], ["doc_id", "size"], F.col("size"), "start_at", max(64, rows // BUCKET_ROWS))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start_at div {width}, (start_at + size - 1) div {width})")))
    cut = cut.withColumn("from", F.greatest("start_at", F.col("block") * width))
    cut = cut.withColumn("length", F.least(F.col("start_at") + F.col("size"), (F.col("block") + 1) * width) - F.col("from"))
    cut = cut.withColumn("at", F.col("from") - F.col("block") * width)
    met = cut.join(schedule(src, bits).hint("merge"), ["sid", "block"])  # slots grow with the input
    got = F.least("length", F.col("take") - F.col("at"))
    stream = met.withColumn("length", got).where("length > 0").select("slot", "epoch", "source", "doc_id", (F.col("from") - F.col("start_at")).alias("start"), "length", "at", "sid", "start_at")
    starts = F.array(*[F.min(F.when(F.col("epoch") == e, F.col("slot"))) for e in range(math.ceil(most))])
    taken = stream.groupBy("sid", "start_at").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"), starts.alias("starts"))
    some = placed.where("size > 0").join(taken, ["sid", "start_at"], "left")
    columns = ["doc_id", "size", "source", "source_size", "target", *carry]
    nothing = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "slots": F.lit(0).cast("long"), "starts": F.lit(None).cast("array<bigint>")}
    documents = some.select(*columns, *[F.coalesce(k, v).alias(k) for k, v in nothing.items()])
    none = named.where("size = 0").select(*columns, *[v.alias(k) for k, v in nothing.items()])
    return documents.unionByName(none), stream.drop("sid", "start_at")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix uses them: as many rows of each as it takes the whole text, a part of half a text or more
    counting as whole. Since a source is used in one stretch, at most one document of each is taken in part.

    Rows are told apart by a key, as a doc_id may be null or repeated; empty texts are never taken. Each partition is a
    random share of the mix in the order of the schedule, each row standing where the schedule first takes from it that
    time round: a beginning of any file, and so of all of them read side by side, is mixed like the whole. To put all of
    it into one order would cost another shuffle of the texts.
    """
    rows = with_row_key(docs, "mixing-rows")
    times = F.expr("cast(floor(taken / greatest(size, 1) + 0.5) as int)")
    used = mix(rows, carry=ROW)[0].withColumn("_times", times).where("_times > 0")
    copies = used.select(*ROW, F.slice(F.array_sort(F.array_compact("starts")), F.lit(1), F.col("_times")).alias("_slots"))
    row = F.struct(*[rows[c] for c in docs.columns]).alias("_row")
    met = rows.join(copies.hint("merge"), list(ROW)).select(row, *ROW, F.explode("_slots").alias("_slot"))
    return met.sortWithinPartitions("_slot", *ROW).select("_row.*")
