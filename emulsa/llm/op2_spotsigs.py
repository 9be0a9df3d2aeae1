"""SpotSigs fingerprints; DataFrame functions only.

A signature starts at an anchor (a common word) and chains the next two content words (words that are
no common words).  A text's fingerprint is its set of signatures as 64-bit hashes, written in ascending
order as ``DIGITS`` hexadecimal digits each (negative ones first, in two's complement).  A text with words but no anchor uses each content word (or, without
those, each word) as an anchor; a text without words has one signature, of the text itself; an empty
or null text has none.  Likeness is the Jaccard coefficient of two sets, 1 for two empty ones.

``near_duplicates`` partitions sets by length: partition k holds lengths from RATIO**-k on, so sets that
reach the threshold lie in the same or neighbouring partitions.  There, only the rarest signatures are
joined (prefix filter) and a pair is dropped from its lengths alone when these rule the threshold out.

Ids may be null (first in order) or repeated (ordered by the text's hash); all null ids, and all rows of one repeated
id, are put in order by one task.  An empty table gives an empty
result; only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulsa.llm.common import cut

THRESHOLD = 0.75
#: Hexadecimal digits of a signature in a fingerprint.
DIGITS = 16
#: Common words of English, German, French and Spanish: fixed values.
COMMON = (
    "a an and are as at be but by for from has have he in is it its not of on or that the this to was were will with "
    "als am auf aus bei das dass dem den der des die ein eine einem einen einer er es für im ist mit nicht sich sie und von war wie zu "
    "au aux avec ce dans de du elle en est et il la le les leur ne pas par pour que qui se son sur un une "
    "al con del el ella esta ha la las lo los más no para por se su sus una uno y"
).split()
LETTERS = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, made: dict[str, str]) -> DataFrame:
    """Adds, for each {name: text column}, the ascending array of distinct signature hashes (bigint).

    Each step is a projection of its own, so what lambdas refer to is computed once a row.
    """
    col, own = F.col, list(df.columns)
    content = lambda w: F.substring_index(w, "_", -1)
    follows = lambda t, i: F.coalesce(content(F.get(t, i + 1)), F.lit(""))
    none = F.array().cast("array<bigint>")

    def of_anchors(t: Column, w: Column, i: Column) -> Column:
        parts = F.split(w, "_")
        return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda a: _hash(a, content(w), follows(t, i)))

    def chains(t: str) -> Column:
        return F.flatten(F.transform(t, lambda w, i: F.when(w.contains("_"), of_anchors(col(t), w, i)).otherwise(none)))

    def each_word(t: str) -> Column:
        return F.transform(t, lambda w, i: _hash(F.lit(""), w, follows(col(t), i)))

    # each run of common words is tied to the content word after it
    stop = sorted(set(COMMON))
    df = df.withColumns({f"{k}_words": F.split(F.lower(F.coalesce(col(t), F.lit(""))), LETTERS) for k, t in made.items()})
    df = df.withColumns({f"{k}_tied": F.split(F.array_join(F.transform(f"{k}_words", lambda w: F.concat(w, F.when(w.isin(stop), "_").otherwise(" "))), ""), " ") for k in made})
    df = df.withColumns({f"{k}_tokens": F.filter(f"{k}_tied", lambda w: (w != "") & ~w.endswith("_")) for k in made})
    df = df.withColumns({f"{k}_sigs": chains(f"{k}_tokens") for k in made})
    df = df.withColumns({f"{k}_usual": F.when(F.size(f"{k}_sigs") > 0, F.array().cast("array<string>")).when(F.size(f"{k}_tokens") > 0, col(f"{k}_tokens")).otherwise(F.array_remove(f"{k}_words", "")) for k in made})
    df = df.withColumns({f"{k}_every": each_word(f"{k}_usual") for k in made})
    whole = lambda t: F.when(F.coalesce(col(t), F.lit("")) == "", none).otherwise(F.array(_hash(F.lit(""), col(t), F.lit(""))))
    df = df.withColumns({f"{k}_all": F.when(F.size(f"{k}_sigs") > 0, col(f"{k}_sigs")).when(F.size(f"{k}_every") > 0, col(f"{k}_every")).otherwise(whole(t)) for k, t in made.items()})
    return df.select(*own, *[F.sort_array(F.array_distinct(f"{k}_all")).alias(k) for k in made])


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def text_form(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), DIGITS, "0")), "")


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose Jaccard coefficient can reach the threshold lie at most one partition apart."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9))).otherwise(F.lit(-1)).cast("int")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard coefficient; 0 without any comparison where the lengths alone rule the threshold out."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((F.least(n, m) == 0) | (F.least(n, m) < threshold * F.greatest(n, m)), F.lit(0.0)).otherwise(both / (n + m - both))


def with_next(docs: DataFrame, per_bucket: int = 4) -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: the next row is that by id (after the last: the first).

    Ids fall into buckets between quantiles; the rows at a bucket's lower bound are also sent to the
    bucket before, so one shuffle suffices and no window spans the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    rows = with_signatures(rows, {"sigs": "text"})
    n = per_bucket * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("b")).first().b or []
    lowest = ids.agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low")).first().low
    bounds = sorted(set(bounds) - {lowest})
    step = max(1, math.isqrt(len(bounds)))
    coarse = bounds[::step]  # a search in two steps
    fine = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    at = F.coalesce(F.size(F.filter(F.lit(coarse).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at)
    table = F.array(*[F.lit(f).cast("array<bigint>") for f in fine]) if bounds else None
    bucket = F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(F.filter(F.get(table, at - 1), lambda b: b <= F.col("doc_id")))) if bounds else F.lit(0)
    last = len(bounds)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    edge = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    first = F.col("doc_id").eqNullSafe(F.lit(lowest).cast("long"))
    rows = rows.withColumn("copy", F.explode(F.when(edge, F.array(F.lit(0), F.lit(1))).when(first, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("bucket", F.when(F.col("copy") == 1, F.col("bucket") - 1).when(F.col("copy") == 2, F.lit(last)).otherwise(F.col("bucket")))
    order = Window.partitionBy("bucket").orderBy((F.col("copy") == 2).cast("int"), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "copy")
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)}).where("copy = 0").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, sigs (array<bigint>), fingerprint and its length partition."""
    rows = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"sigs": "text"})
    return rows.select("doc_id", "sigs", text_form(F.col("sigs")).alias("fingerprint"), length_partition(F.size("sigs")).alias("length_partition"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""
    rows = with_next(docs)
    chars = F.char_length("text")
    quarter = F.floor(chars / 4).cast("int")
    next_text = F.coalesce("next_text", F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), chars - quarter), F.substring(next_text, F.lit(1), quarter))
    rows = rows.select("doc_id", chars.cast("long").alias("n_chars"), F.col("sigs").alias("s"), F.coalesce("next_sigs", "sigs").alias("n"), edited.alias("edited"))
    rows = with_signatures(rows, {"e": "edited"}).withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("s")).alias("fingerprint"),
        text_form(F.col("e")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("s"), F.col("e")).alias("near_edited"),
        pruned_jaccard(F.col("s"), F.col("n")).alias("near_next"),
        length_partition(F.size("s")).alias("length_partition"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a_id < b_id and likeness of all pairs of representatives at or above the threshold.

    Rows with equal fingerprints form a class, represented by their smallest id; see ``classes``.
    """
    sets = cut(fingerprint(docs).where(F.size("sigs") > 0).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("sigs").alias("sigs"), F.first("length_partition").alias("part")))
    often = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("often"))
    each = sets.select("doc_id", F.size("sigs").alias("n"), "part", F.explode("sigs").alias("sig")).join(often, "sig")
    rare = Window.partitionBy("doc_id").orderBy("often", "sig")
    prefix = each.withColumn("k", F.row_number().over(rare)).where((F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1) & (F.col("often") > 1))
    here = prefix.select("sig", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("p_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    there = here.select("sig", "part", F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("p_a").alias("p_b"))
    short = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    pairs = here.join(there, ["sig", "part"]).where((F.col("a") < F.col("b")) & short).select("a", "b").distinct()
    left = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), pruned_jaccard(F.col("x"), F.col("y"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and the representative of its class of equal fingerprints."""
    prints = fingerprint(docs).select("doc_id", "fingerprint")
    return prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "fingerprint").select("doc_id", "class_id")
