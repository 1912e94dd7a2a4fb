"""Mixing sources to target weights along a time-varying curriculum.

Sources, ordered by code point with null last, take the weights in turn and
share a budget of words; a source's target stops at ``most`` times its size,
and what is over is shared by the others by weight.  Training time runs from 0
to 1.  A source's rate at a time is its target times its weight schedule, a
piecewise linear curve; its integral is the cumulative demand for the source's
words.  A source's documents, in the order of a keyed digest and again from
the start in every further epoch, fill that demand: an occurrence whose middle
word is the x-th of its source gets the time at which the demand reaches x.
The last occurrence before the target is cut at it, so that a source gives the
whole words of its target.  Documents are sorted by time in ranges.

No task needs a whole source.  A document's words before it in its source are
sums over the first digit pair of its digest (256 sums a source), over the
second within the first (256 sums), and over rows that agree in both, which
are one part in 65,536 of the source.  Source statistics ride on those sums,
so that the documents are exchanged once for them and once for the final sort.
Target rounds are one-row sums over the written table of sources.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null
source is a source, the last one; null ids are kept, and order by their text;
repeated rows are each placed; an empty table, or one without words, has
targets of 0 and takes nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import Scratch

#: Weights of the sources in turn, the budget as a share of all words (a fraction), and the most epochs of a source.
WEIGHTS, BUDGET, EPOCHS = (5, 2, 1), (3, 2), 2
#: The times at which schedules bend, and the schedule of each weight: the heavy sources lead, the light ones follow.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Positions are counted in parts of training time.
PARTS = 1_000_000_000

_BLANK = r"\x20\x09-\x0D"
_SOURCE = ["no_source", "known_source"]


def word_count(text: Column) -> Column:
    """Number of words; a word becomes one letter, and blanks are struck out."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_BLANK}]+", "w")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("bigint")


def integrated(knots: Sequence[float], schedule: Sequence[float]) -> list[float]:
    """The integral of a piecewise linear schedule up to each knot."""
    if len(knots) != len(schedule) or list(knots) != sorted(set(knots)) or min(schedule) < 0 or max(schedule) <= 0:
        raise ValueError("a schedule needs a weight of 0 or more at each of its rising knots, and one above 0")
    out = [0.0]
    for k in range(len(knots) - 1):
        out.append(out[-1] + (schedule[k] + schedule[k + 1]) * (knots[k + 1] - knots[k]) / 2)
    return out


def time_of(share: Column, knots: Sequence[float], schedule: Sequence[float]) -> Column:
    """The time at which a share of the schedule's integral is reached: its inverse, a root of a quadratic between two knots."""
    whole = integrated(knots, schedule)
    area = share * F.lit(whole[-1])
    out = None
    for k in reversed(range(len(knots) - 1)):
        if whole[k + 1] == whole[k]:
            continue
        slope = (schedule[k + 1] - schedule[k]) / (knots[k + 1] - knots[k])
        rest = area - F.lit(whole[k])
        below = F.lit(schedule[k]) + F.sqrt(F.lit(schedule[k] * schedule[k]) + F.lit(2.0 * slope) * rest)
        at = F.lit(knots[k]) + F.when(below > 0, F.lit(2.0) * rest / below).otherwise(F.lit(0.0))
        out = at if out is None else F.when(area < F.lit(whole[k + 1]), at).otherwise(out)
    return out


def _ranked(scratch: Scratch, sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources with their weight: places come from a sort by ranges and the sizes of the ranges before."""
    numbered = scratch.keep(sources.repartitionByRange(*_SOURCE).sortWithinPartitions(*_SOURCE).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    ranges = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    turn = ((F.col("before") + within) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    return scratch.keep(numbered.withColumn("part", part).join(before, "part").select(*_SOURCE, "source_size", turn.alias("turn"), weight.cast("bigint").alias("weight")), "weighed")


def _level(weighed: DataFrame, budget: tuple[int, int], most: int) -> tuple[int, int]:
    """Words for each unit of weight, as a fraction, when sources above their limit stop there.

    Each round shares what the limited sources leave among the others; it ends
    when no further source is above its limit.
    """
    limit = (F.col("source_size") * most * budget[1]).cast("decimal(38,0)")
    words, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    num, den = (words or 0) * budget[0], weights or 1
    limited = None
    while True:
        above = limit * F.lit(Decimal(den)) < F.lit(Decimal(num)) * F.col("weight")
        held, free = weighed.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if held is None or held == limited:
            return num, den * budget[1]
        limited, num, den = held, (words or 0) * budget[0] - int(held), free


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET,
    epochs: int = EPOCHS, knots: Sequence[float] = KNOTS, schedules: Sequence[Sequence[float]] = SCHEDULES,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and ``takes``: an array of (epoch, position, words), one element an occurrence.

    ``position`` counts billionths of training time.
    """
    if len(schedules) != len(weights) or min(weights) <= 0:
        raise ValueError("each weight is above 0 and has a schedule")
    if budget[0] > epochs * budget[1]:
        raise ValueError("the budget is more than all sources can give")
    scratch = Scratch(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    name = F.col(source).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), name.isNull().alias("no_source"), F.coalesce(name, F.lit("")).alias("known_source"), word_count(F.col(text).cast("string")).alias("size"), digest.alias("digest"))
    rows = scratch.keep(rows, "sizes").withColumns({"d1": F.substring("digest", 1, 2), "d2": F.substring("digest", 3, 2)})
    weighed = _ranked(scratch, rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights)
    num, den = _level(weighed, budget, epochs)

    limit = F.col("source_size") * epochs
    share = (F.lit(Decimal(num)) * F.col("weight")).cast("decimal(38,0)")
    above = (limit * F.lit(den)).cast("decimal(38,0)") < share
    target = F.when(above, limit.cast("double")).otherwise(share.cast("double") / F.lit(float(den)))
    stop = F.when(above, limit).otherwise(F.floor(share / F.lit(Decimal(den)))).cast("bigint")
    stated = weighed.select(*_SOURCE, "source_size", "turn", target.alias("target"), stop.alias("stop"))

    keys = [*_SOURCE, "d1", "d2"]
    fine = rows.groupBy(*keys).agg(F.sum("size").alias("n"))
    coarse = fine.groupBy(*_SOURCE, "d1").agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(*_SOURCE, "d1", F.coalesce(F.sum("n").over(earlier(*_SOURCE).orderBy("d1")), F.lit(0)).alias("before1"))
    fine = fine.select(*keys, F.coalesce(F.sum("n").over(earlier(*_SOURCE, "d1").orderBy("d2")), F.lit(0)).alias("before2"))
    offsets = fine.join(coarse, [*_SOURCE, "d1"]).join(stated, _SOURCE).select(*keys, (F.col("before1") + F.col("before2")).alias("before"), "source_size", "turn", "target", "stop")

    within = F.coalesce(F.sum("size").over(earlier(*keys).orderBy("digest", "doc_id", "size")), F.lit(0))
    begun = rows.withColumn("within", within).join(offsets, keys).withColumn("start", F.col("before") + F.col("within"))
    takes = []
    for epoch in range(epochs):
        first = F.col("start") + F.col("source_size") * epoch
        words = F.least(F.greatest(F.col("stop") - first, F.lit(0)), F.col("size"))
        at = (first + words / F.lit(2.0)) / F.col("stop")
        time = F.lit(None).cast("double")
        for turn, schedule in enumerate(schedules):
            time = F.when(F.col("turn") == turn, time_of(at, knots, schedule)).otherwise(time)
        position = F.least(F.floor(time * PARTS).cast("bigint"), F.lit(PARTS).cast("bigint"))
        takes.append(F.when(words > 0, F.struct(F.lit(epoch).alias("epoch"), position.alias("position"), words.cast("bigint").alias("words"))))
    placed = begun.withColumn("takes", F.filter(F.array(*takes), lambda x: x.isNotNull()))
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda s, x: s + x["words"])
    named = F.when(~F.col("no_source"), F.col("known_source"))
    return placed.select("doc_id", named.alias("source"), "size", "source_size", "target", taken.alias("taken"), "takes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row an occurrence, sorted by position in ranges: doc_id, source, epoch, position, words (the first ones of the text)."""
    rows = mixed.select("doc_id", "source", F.inline("takes"))
    order = ["position", "doc_id", "epoch"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document with its words in the mix, sorted by its first position; those without one come last."""
    mixed = mix(tx.table(spark, sf_dir, "documents"))
    first = F.try_element_at("takes", F.lit(1))["position"]
    out = mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("takes").cast("bigint").alias("n_takes"), first.alias("position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS turn FROM d GROUP BY source),
w AS (SELECT *, list_value{WEIGHTS}[turn + 1]::HUGEINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n / weight, source NULLS LAST) AS k FROM w),
p AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT * {EPOCHS * BUDGET[1]} AS held, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS free, n, weight, (SELECT coalesce(sum(n), 0) FROM w)::HUGEINT * {BUDGET[0]} AS budget FROM o),
l AS (SELECT budget - held AS num, free AS den FROM p WHERE n * {EPOCHS * BUDGET[1]} * free >= (budget - held) * weight ORDER BY k LIMIT 1),
t AS (SELECT source, n::BIGINT AS source_size, turn, CASE WHEN n * {EPOCHS * BUDGET[1]} * den < num * weight THEN (n * {EPOCHS})::DOUBLE ELSE (num * weight)::DOUBLE / (den * {BUDGET[1]})::DOUBLE END AS target, CASE WHEN n * {EPOCHS * BUDGET[1]} * den < num * weight THEN n * {EPOCHS} ELSE (num * weight) // (den * {BUDGET[1]}) END::BIGINT AS stop FROM w, l),
r AS (SELECT d.doc_id, d.source, size, source_size, target, stop, turn, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, least(greatest(stop - start, 0), size) AS a, least(greatest(stop - start - source_size, 0), size) AS b FROM r),
e AS (SELECT *, list_value{tuple(x[0] for x in SCHEDULES)}[turn + 1]::DOUBLE AS m0, list_value{tuple(x[1] for x in SCHEDULES)}[turn + 1]::DOUBLE AS m1, list_value{tuple(x[2] for x in SCHEDULES)}[turn + 1]::DOUBLE AS m2, ((CASE WHEN a > 0 THEN start ELSE start + source_size END) + (CASE WHEN a > 0 THEN a ELSE b END) / 2.0::DOUBLE) / stop AS y FROM x),
h AS (SELECT *, (m0 + m1) * 0.5 / 2 AS f1, (m0 + m1) * 0.5 / 2 + (m1 + m2) * 0.5 / 2 AS f2 FROM e),
q AS (SELECT *, CASE WHEN y * f2 < f1 THEN 2.0 * (y * f2) / (m0 + sqrt(m0 * m0 + 2.0 * ((m1 - m0) / 0.5) * (y * f2))) ELSE 0.5 + 2.0 * (y * f2 - f1) / (m1 + sqrt(m1 * m1 + 2.0 * ((m2 - m1) / 0.5) * (y * f2 - f1))) END AS time FROM h)
SELECT doc_id, source, size, source_size, target, (a + b)::BIGINT AS taken, ((a > 0)::BIGINT + (b > 0)::BIGINT)::BIGINT AS n_takes, CASE WHEN a + b > 0 THEN least(floor(time * {PARTS}), {PARTS})::BIGINT END AS position FROM q"""
