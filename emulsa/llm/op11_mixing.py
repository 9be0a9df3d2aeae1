"""Mixing sources to target weights by hash thresholds; DataFrame functions only.

Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share the mix's words; no target
exceeds ``REPEATS`` times its source's words, and what is above is shared by weight among the others.
A source is taken whole as often as its target allows; the rest is a budget that documents below a hash threshold
fill.  The threshold is found without sorting: words are summed by source and hash bucket, the bucket in which the
budget runs out is the boundary, and only its rows go into the next, finer histogram, until it holds one
document (or only such as no hash tells apart).  The boundary document is taken in part, to the nearest word, or with
``whole`` as a whole where that is nearer.  Thresholds are nested: of two ``shares`` the smaller
one takes no word that the larger one doesn't.

The hash covers id and text, so rows that agree in both are taken alike: at the boundary they share what is
left of the budget in equal parts, each to the nearest word.  Null text: no words; a null id hashes as the empty
text.  A source without words has target 0.  An empty table gives an empty result.  Only id, text and source are read.

Rows carry no texts after the first scan.  Histograms are combined map-side, with 2**``STEP`` buckets a source at most.  Per-source
figures reach the rows by a broadcast while there are at most ``BROADCAST`` of them (16 MB or so), by a salted join beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulsa.llm.common import cut

#: Of the sources in order; repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Bits of a hash, and of a histogram's bucket.
BITS, STEP = 60, 12
BROADCAST, SALTS = 100_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key (null is the empty key, other sources begin with =), size in words and hash of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(name, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``.  Sources lie in ranges of their order; one's place is the count of the ranges before and its place in its own."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key") == "", F.col("key")]
    ranged = cut(sources.repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    parts = placed.groupBy("part").count()  # one row a partition
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    turn = ((F.col("place") + F.col("before")) % len(weights)).cast("int")
    return placed.join(F.broadcast(before), "part").withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).drop("part", "place", "before")


def targets(sources: DataFrame, share: float, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target``: the share of all words by weight, stopped at ``repeats`` times a source's own words."""
    limit = F.lit(repeats) * F.col("source_size")
    level: float | None = 0.0
    above = lambda x: (F.col("weight") * F.lit(x) > limit) if x else F.lit(False)
    while True:
        total, stopped, weight = sources.agg(F.sum("source_size"), F.sum(F.when(above(level), limit)), F.sum(F.when(~above(level), F.col("weight")))).first()
        new = (share * total - (stopped or 0)) / weight if weight else level
        if new <= level:
            break
        level = new  # it only rises, and each time at least one more source stops
    return sources.withColumn("target", F.when(above(level), limit.cast("double")).otherwise(F.col("weight") * F.lit(float(level))))


def attached(rows: DataFrame, figures: DataFrame, on: list[str]) -> DataFrame:
    """rows with their figures, of which there are few for each key; a hot key is split among ``SALTS`` where they aren't broadcast."""
    if figures.count() <= BROADCAST:
        return rows.join(F.broadcast(figures), on)
    salted = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For (key, share, budget): ``threshold``, below which a document is taken, the ``rest`` of the budget and the words ``at`` the threshold."""
    state = budgets.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        if level:  # only the boundary buckets' rows go on
            open_ = state.select("key", "prefix").distinct()
            rows = cut(attached(rows.withColumn("prefix", F.shiftright("hash", shift + STEP)), open_, ["key", "prefix"]).drop("prefix"))
        finer = rows.withColumn("finer", F.shiftright("hash", shift))
        sums = finer.groupBy("key", F.shiftright("finer", STEP).alias("prefix"), "finer").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        if not level:
            sums = sums.withColumn("prefix", F.lit(0).cast("long"))
        running = F.sum("words").over(Window.partitionBy("key", "share").orderBy("finer"))  # 2**STEP rows at most
        found = state.drop("at", "docs").join(sums, ["key", "prefix"]).withColumn("after", F.col("before") + running).where("after >= budget")
        first = F.min(F.struct("finer", (F.col("after") - F.col("words")).alias("before"), F.col("words").alias("at"), "docs")).alias("first")
        found = found.groupBy("key", "share").agg(F.first("budget").alias("budget"), first)
        state = cut(found.select("key", "share", "budget", F.col("first.finer").alias("prefix"), "first.before", "first.at", "first.docs"))
        if not state.agg(F.max("docs") > 1).first()[0]:
            break
    rest = F.col("budget") - F.col("before")
    return state.select("key", "share", F.shiftleft("prefix", shift).alias("threshold"), F.shiftleft(F.col("prefix") + 1, shift).alias("beyond"), rest.alias("rest"), "at")


def mix(docs: DataFrame, shares: tuple[float, ...] = (1.0,), weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, whole: bool = False) -> DataFrame:
    """For every document and share of all words: doc_id, share, size, source_size, target (its source's) and taken."""
    rows = cut(measured(docs))
    sources = cut(weighted(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights))
    if sources.isEmpty():
        return rows.select("doc_id", F.lit(1.0).alias("share"), "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    plan = reduce(DataFrame.union, [targets(sources, s, repeats).withColumn("share", F.lit(float(s))) for s in shares])
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("times") * F.col("source_size")
    plan = cut(plan.withColumn("times", times).withColumn("budget", F.least(F.greatest(rest, F.lit(0.0)), F.col("source_size").cast("double"))))
    found = plan.join(thresholds(rows, plan.select("key", "share", "budget")), ["key", "share"])
    part = F.when(F.col("at") > 0, F.floor(F.col("rest") * F.col("size") / F.col("at") + 0.5)).otherwise(0)
    if whole:
        part = F.when(2 * F.col("rest") >= F.col("at"), F.col("size")).otherwise(0)
    extra: Column = F.when(F.col("hash") < F.col("threshold"), F.col("size")).when(F.col("hash") < F.col("beyond"), part).otherwise(0)
    taken = (F.col("times") * F.col("size") + extra).cast("long").alias("taken")
    return attached(rows, cut(found.drop("weight", "budget")), ["key"]).select("doc_id", "share", "size", "source_size", "target", taken)


#: The same by sorting each source's documents by hash.
ORACLE = r"""
with d as (
  select doc_id, coalesce('=' || source, '') as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 1, 15))::bigint as hash
  from documents),
s as (
  select key, source_size, case (row_number() over (order by key = '', key) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from (select key, sum(size)::bigint as source_size from d group by key)),
levels as (
  select *, ((select sum(source_size) from s) - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double
            / (sum(weight) over (o rows between current row and unbounded following))::double as level
  from s window o as (order by 3 * source_size / weight::double, key)),
t as (
  select key, source_size, case when weight * risen > 3 * source_size then (3 * source_size)::double else weight * risen end as target
  from s, (select coalesce(max(level) filter (where weight * level <= 3 * source_size), 0) as risen from levels)),
b as (
  select *, least(greatest(target - times * source_size, 0), source_size::double) as budget
  from (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from t)),
g as (
  select key, hash, sum(size)::bigint as at, (sum(sum(size)) over (partition by key order by hash))::bigint as after from d group by key, hash)
select d.doc_id, d.size, b.source_size, b.target,
       (b.times * d.size + case when g.after <= b.budget then d.size when g.after - g.at >= b.budget then 0
                                else floor((b.budget - (g.after - g.at)) * d.size / g.at + 0.5) end)::bigint as taken
from d join b on d.key = b.key join g on g.key = d.key and g.hash = d.hash
"""
