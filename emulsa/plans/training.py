"""Registered queries of training: alignment, ground truth, files, library, gate; each with SQL where it can say the same."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.operators import alignment as al
from emulsa.operators import fill as fl
from emulsa.operators import learning as ln
from emulsa.operators import library as lb
from emulsa.operators import neighbourhood as nb
from emulsa.operators import training as tr
from emulsa.plans.catalogue import HELD, HOLE, KEYS, LUM, MASKED_SQL, NUDGE, PAIRS_SQL, box_sql, masked, pairs, query, r6, rounded, with_sql
from emulsa.plans.stages import shared_folder, written
from emulsa.sources import file_formats as ff
from emulsa.sources import training_files as tf
from emulsa.sources.rasters import rasters

SCALE_X, SCALE_Y, OFFSET_X, OFFSET_Y = 0.9, 0.85, 0.05, 0.125


# --- alignment ----------------------------------------------------------------------------------------
def placed(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed alignment for every image, with itself as the restored one."""
    sizes = rasters(spark, sf).select("image_id", "width", "height").distinct()
    fixed = {"scale_x": SCALE_X, "scale_y": SCALE_Y, "offset_x": OFFSET_X, "offset_y": OFFSET_Y}
    return sizes.withColumns({"restored_width": F.col("width"), "restored_height": F.col("height")} | {k: F.lit(v) for k, v in fixed.items()})


WARP_SQL = f"""places as (select image_id, y, x, width, height, ((x + 0.5e0) / width - {OFFSET_X}e0) / {SCALE_X}e0 * width - 0.5e0 as fx, ((y + 0.5e0) / height - {OFFSET_Y}e0) / {SCALE_Y}e0 * height - 0.5e0 as fy from pixels),
cornered as (select *, cast(least(floor(fx), width - 2) as int) as x0, cast(least(floor(fy), height - 2) as int) as y0 from places where fx between 0 and width - 1 and fy between 0 and height - 1),
warped as (select c.image_id, c.y, c.x, {", ".join(f"sum(p.{v} * (case when p.x = x0 then 1 - (fx - x0) else fx - x0 end) * (case when p.y = y0 then 1 - (fy - y0) else fy - y0 end)) as {v}" for v in "rgb")}
  from cornered c join pixels p on p.image_id = c.image_id and p.x between x0 and x0 + 1 and p.y between y0 and y0 + 1 group by c.image_id, c.y, c.x)"""


@query("warp", with_sql(f"select image_id, y, x, {r6(r='r', g='g', b='b')} from warped", WARP_SQL))
def warp(spark, sf):
    return rounded(al.warp(rasters(spark, sf), placed(spark, sf), ["r", "g", "b"]), KEYS, ["r", "g", "b"])


@query("pair_residual", with_sql(f"select image_id, y, x, {r6(residual='(abs(p.r - w.r) + abs(p.g - w.g) + abs(p.b - w.b)) / 3')} from pixels p join warped w using (image_id, y, x)", WARP_SQL))
def pair_residual(spark, sf):
    own = rasters(spark, sf).select(*KEYS, *[F.col(c).alias(f"own_{c}") for c in "rgb"])
    both = own.join(al.warp(rasters(spark, sf), placed(spark, sf), ["r", "g", "b"]), KEYS)
    return rounded(both.withColumn("residual", sum((F.abs(F.col(f"own_{c}") - F.col(c)) for c in "rgb"), F.lit(0.0)) / 3), KEYS, ["residual"])


@query("brightest", with_sql("select image_id, lum, y, x from (select image_id, y, x, round(lum, 2) as lum, row_number() over (partition by image_id order by round(lum, 2) desc, y, x) as k from lum) where k = 1", LUM))
def brightest(spark, sf):
    lum = "0.2126 * r + 0.7152 * g + 0.0722 * b"
    return al.first_best(rasters(spark, sf).withColumn("lum", F.round(F.expr(lum).cast("double"), 2)), ["image_id"], "lum", ["y", "x"], ["y", "x"])


@query("align_pairs")
def align_pairs(spark, sf):
    p = rasters(spark, sf)
    lighter = p.withColumns({c: F.sqrt(c) for c in "rgb"})
    return rounded(al.accepted(al.align(p, lighter)), ["image_id", "width", "height"], [*al.PARAMETERS, "score"])


# --- ground truth -------------------------------------------------------------------------------------
TEXTURE_SQL = "tl as (select *, 0.2126e0 * tr + 0.7152e0 * tg + 0.0722e0 * tb as tlum from pairs)"
LABELS = f"round((abs(r - tr) + abs(g - tg) + abs(b - tb)) / 3 + {NUDGE!r}::double, 6)", f"round(sqrt(greatest(mq - ml * ml, 0)) + {NUDGE!r}::double, 5)"


@query("damage_label", with_sql(f"select image_id, y, x, known and {LABELS[0]} > greatest(0.1e0, 1.5e0 * {LABELS[1]}) as labelled from bt", PAIRS_SQL, TEXTURE_SQL, box_sql("tl", "bt", {"ml": "tlum", "mq": "tlum * tlum"}, 3)))
def damage_label(spark, sf):
    p = pairs(spark, sf).withColumn("valid", F.col("known")).withColumn("tlum", F.expr("0.2126 * tr + 0.7152 * tg + 0.0722 * tb").cast("double"))
    p = nb.box_mean(p.withColumn("tsq", F.col("tlum") * F.col("tlum")), {"ml": "tlum", "mq": "tsq"}, 3)
    texture = F.sqrt(F.greatest(F.col("mq") - F.col("ml") * F.col("ml"), F.lit(0.0)))
    residual = (F.abs(F.col("r") - F.col("tr")) + F.abs(F.col("g") - F.col("tg")) + F.abs(F.col("b") - F.col("tb"))) / 3
    p = p.withColumns({"residual": F.round(residual + NUDGE, 6), "texture": F.round(texture + NUDGE, 5)})
    return p.select(*KEYS, al.damage_label(p).alias("labelled"))


@query("ground_truth")
def ground_truth(spark, sf):
    p = rasters(spark, sf)
    toned = p.withColumns({"r": F.when(F.expr(HOLE), 0.9).otherwise(0.1 + 0.8 * F.col("r")), "b": 0.9 * F.col("b")})
    return al.ground_truth(toned, p, placed(spark, sf).withColumns({"scale_x": F.lit(1.0), "scale_y": F.lit(1.0), "offset_x": F.lit(0.0), "offset_y": F.lit(0.0)})).select(*KEYS, "damage", "known")


@query("ground_truth_at_size")
def ground_truth_at_size(spark, sf):
    """Analysed at a longer side of 48, voted down to 24."""
    p = rasters(spark, sf)
    toned = p.withColumns({"r": F.when(F.expr(HOLE), 0.9).otherwise(0.1 + 0.8 * F.col("r")), "b": 0.9 * F.col("b")})
    at = placed(spark, sf).withColumns({"scale_x": F.lit(1.0), "scale_y": F.lit(1.0), "offset_x": F.lit(0.0), "offset_y": F.lit(0.0)})
    return al.ground_truth_at_size(toned, p, at, 24).select(*KEYS, "width", "height", "damage", "known")


DRAWN = 500


@query("with_replacement", with_sql("select image_id, y, x, times from ranked join picks using (image_id, k)", "ranked as (select image_id, y, x, row_number() over (partition by image_id order by y, x) - 1 as k from pixels)", f"draws as (select image_id, n, unnest(range(least(n, {DRAWN}))) as d from (select image_id, count(*) as n from pixels group by image_id))", "picks as (select image_id, k, count(*) as times from (select image_id, ((('0x' || substr(md5('0:' || d), 1, 8))::bigint * n) >> 32) as k from draws) group by image_id, k)"))
def with_replacement(spark, sf):
    return al.with_replacement(rasters(spark, sf), DRAWN).select(*KEYS, "times")


@query("train_candidates", with_sql(f"select image_id, y, x from pairs where known and not {HELD}", PAIRS_SQL))
def train_candidates(spark, sf):
    return pairs(spark, sf).where(al.candidates()).select(*KEYS)


# --- the damage network -------------------------------------------------------------------------------
def marked(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Pairs with features: what is damaged in them has been toned up; the features' names."""
    p = pairs(spark, sf).withColumn("damage", F.expr(HOLE))
    p = p.withColumns({"r": F.when(F.col("damage"), 0.9).otherwise(0.1 + 0.8 * F.col("r")), "b": 0.9 * F.col("b")})
    df, names = ln.features(p)
    return written(df.select(*KEYS, "width", "height", "damage", "known", *names)), names


def replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("row_id"), F.slice("embedding", 1, tf.FEATURES).alias("features"), (F.col("label") % 2 == 1).alias("label"), (1 + F.col("vec_id") % 4).cast("float").alias("weight"))


@query("train_model")
def train_model(spark, sf):
    p, names = marked(spark, sf)
    report = tr.train_gated(p, names, replay_rows(spark, sf), options=tr.Options(rate=5e-3, steps=8))
    return report.gate


@query("cross_validation")
def cross_validation(spark, sf):
    p, names = marked(spark, sf)
    return tr.cross_validated(p, names, options=tr.Options(rate=5e-3, steps=8))


TILT = [((i * 7919) % 2001 - 1000) / 2000 for i in range(tf.FEATURES)]
_TILT_SQL = "[" + ", ".join(f"{t}e0" for t in TILT) + "]"


@query("loss_gradient", f"""with r as (select list_transform(embedding[1:{tf.FEATURES}], lambda e: e::double) as x, (label % 2 = 1)::int as y, (1 + vec_id % 4)::double as w from embeddings where vec_id % 5 <> 0),
p as (select *, 1 / (1 + exp(-(list_dot_product(x, {_TILT_SQL}) + 0.1e0))) as p from r)
select -1 as place, {r6(value="sum(w * -(case when y = 1 then ln(p) else ln(1 - p) end))")} from p union all select -2, {r6(value="sum(w)")} from p
union all select i - 1, {r6(value="sum(w * (p - y) * x[i])")} from p, range(1, {tf.FEATURES + 1}) t(i) group by i union all select {tf.FEATURES}, {r6(value="sum(w * (p - y))")} from p""")
def loss_gradient(spark, sf):
    """Weighted cross entropy (place -1), weight (-2) and gradient (0 on; the bias last) of one layer over the replayed rows."""
    layer = ln.Network([tf.FEATURES, 1], [0.0] * tf.FEATURES, [1.0] * tf.FEATURES, [TILT], [[0.1]])
    [sums] = tr.partial_sums(tr.replayed(replay_rows(spark, sf), False), [(-1, layer)], True)
    rows = [(-1, float(sums[0])), (-2, float(sums[1])), *[(k, float(v)) for k, v in enumerate(sums[2:])]]
    return rounded(spark.createDataFrame(rows, "place int, value double"), ["place"], ["value"])


@query("replay_scores", "with r as (select label % 2 = 1 as label, 1 + vec_id % 4 as weight, embedding[1] > 0 as flag from embeddings where vec_id % 5 = 0)\nselect coalesce(sum(weight) filter (flag and label) / nullif(sum(weight) filter (flag or label), 0)::double, 1) as iou from r")
def replay_scores(spark, sf):
    one = [1.0] + [0.0] * (tf.FEATURES - 1)
    sign = ln.Network([tf.FEATURES, 1], [0.0] * tf.FEATURES, [1e-6] * tf.FEATURES, [one], [[0.0]])  # flags rows whose first feature is positive
    return tr.replay_scores(replay_rows(spark, sf), {"sign": sign})["sign"]


# --- fills --------------------------------------------------------------------------------------------
@query("locked_pixels", with_sql(f"select image_id, y, x, protected or (not {HOLE} and probability < 0.15e0) as locked from masked", MASKED_SQL))
def locked_pixels(spark, sf):
    return masked(spark, sf).withColumn("hole", F.expr(HOLE)).select(*KEYS, fl.locked().alias("locked"))


class MeanFill:
    """A fill model's stand-in: masked pixels become the mean of a tile's others."""

    def __call__(self):
        def run(planes: np.ndarray, mask: np.ndarray) -> np.ndarray:
            known = planes[:, mask == 0]
            return np.broadcast_to((known.mean(1) if known.size else np.zeros(3))[:, None, None] * 255, planes.shape)

        return run


@query("tiled_fill")
def tiled_fill(spark, sf):
    """Works at a longer side of 56, so that some images shrink."""
    return rounded(fl.tiled_fill(masked(spark, sf).withColumn("hole", F.expr(HOLE)), MeanFill(), tile=32, overlap=8, long_side=56), [*KEYS, "note"], ["r", "g", "b"])


# --- files --------------------------------------------------------------------------------------------
BYTE = "round_even({} * 255, 0) / 255"


@query("pair_files", with_sql(f"select 'pair-' || image_id as path, 'image ' || image_id as name, y, x, width, height, {r6(**{c: BYTE.format(c) for c in 'rgb'})}, damage, known from pairs", PAIRS_SQL))
def pair_files(spark, sf):
    """Written as files, one for each pair, and read by the data source."""
    named = pairs(spark, sf).withColumns({"path": F.concat(F.lit("pair-"), "image_id"), "name": F.concat(F.lit("image "), "image_id")})
    folder = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    ff.save_files(tf.encode_pairs(named).select(F.concat("path", F.lit(".bin")).alias("name"), "content"), folder)
    back = spark.read.format("pair_files").option("path", folder).load()
    back = back.withColumn("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.bin$", ""))
    return rounded(back, ["path", "name", "y", "x", "width", "height", "damage", "known"], ["r", "g", "b"])


REPLAY_FILES = 8


@query("replay_files", "select vec_id % 4 + 1 as weight, label % 2 = 1 as label, count(*) as n from embeddings group by all")
def replay_files(spark, sf):
    """Written as files, read by the data source, counted."""
    rows = replay_rows(spark, sf).withColumn("path", F.lit("replay"))
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    content = tf.encode_replay(rows, 5, REPLAY_FILES)
    ff.save_files(content.select(F.concat("path", F.lit(".bin")).alias("name"), "content"), folder)
    back = spark.read.format("replay_files").option("path", folder).load()
    return back.groupBy(F.col("weight").cast("long").alias("weight"), "label").agg(F.count("*").alias("n"))


# --- library ------------------------------------------------------------------------------------------
def infos(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    path = F.concat(F.lit("/scans/"), "event_type", F.lit("."), F.col("event_id").cast("string"), F.lit(".png"))
    own = {"id": lb.pair_id("ts", F.md5(F.col("event_id").cast("string"))), "name": lb.file_stem(path), "added_utc": F.col("ts").cast("timestamp_ntz"), "damaged_file_name": lb.file_name(path), "restored_file_name": F.concat(lb.file_stem(path), F.lit("-restored.png")), "damage_share": F.col("value"), "alignment_score": 1 / (1 + F.col("value"))}
    return e.select("event_id", *[c.alias(k) for k, c in own.items()])


INFOS_SQL = """infos as (select event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || substr(md5(event_id::varchar), 1, 12) as id, event_type || '.' || event_id as name, ts as added_utc,
  event_type || '.' || event_id || '.png' as damaged_file_name, event_type || '.' || event_id || '-restored.png' as restored_file_name, value as damage_share, 1 / (1 + value) as alignment_score from events)"""


@query("library", f"with {INFOS_SQL}\nselect id, name, strftime(added_utc, '%Y-%m-%d %H:%M:%S.%f') as added_utc, damaged_file_name, restored_file_name, {r6(damage_share='damage_share', alignment_score='alignment_score')} from infos where event_id % 17 <> 0 and event_id % 5 <> 0")
def library(spark, sf):
    own = infos(spark, sf)
    bad = F.when(F.expr("substr(i.json, 1, 1) = '{' and i.event_id % 17 = 0"), F.substring("i.json", 1, 40)).otherwise(F.col("i.json"))
    files = lb.to_info(own).join(own.select("event_id", "id"), "id").alias("i").select("i.id", bad.alias("json"))
    read = lb.listed(files, own.where("event_id % 5 <> 0"))
    return rounded(read.withColumn("added_utc", F.date_format("added_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS")), ["id", "name", "added_utc", "damaged_file_name", "restored_file_name"], ["damage_share", "alignment_score"])


@query("library_changes", f"with {INFOS_SQL}\nselect id, name from infos where event_id % 3 <> 0 and event_id % 2 = 0 or event_id % 7 = 0 and event_id % 3 <> 0")
def library_changes(spark, sf):
    own = infos(spark, sf)
    grown = lb.added(own.where("event_id % 2 = 0").select("id", "name"), own.where("event_id % 7 = 0").select("id", "name"))
    return lb.removed(grown, own.where("event_id % 3 = 0"))


@query("history", "select event_id as seq, event_type as line from events order by event_id desc limit 12")
def history(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return lb.newest(e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("line")), 12)


OTHER = "((x * 17 + y * 23) % 97) / 96e0"


def _iou(p: str) -> str:
    return f"coalesce(count(*) filter ({p} > 0.5 and damage) / nullif(count(*) filter ({p} > 0.5 or damage), 0)::double, 1)"


def _replay(p: str) -> str:
    return f"sum(r) filter ({p} > 0.5 and damage) / sum(r) filter ({p} > 0.5 or damage)"


@query("model_gate", with_sql(f"""select {r6(current_iou="a", candidate_iou="b", current_replay="c", candidate_replay="d")}, n as pairs, b >= a - 1e-4 and d >= 0.95e0 * c as accepted from
(select avg(a) as a, avg(b) as b, count(*) as n from (select {_iou("probability")} as a, {_iou(OTHER)} as b from pairs where known and {HELD} group by image_id)) cross join (select {_replay("probability")} as c, {_replay(OTHER)} as d from pairs)""", PAIRS_SQL))
def model_gate(spark, sf):
    now = pairs(spark, sf).withColumns({"label": F.col("damage"), "weight": F.col("r")})
    new = now.withColumn("probability", F.expr(OTHER))
    return rounded(lb.gate(ln.scores(now), ln.scores(new), ln.weighted_iou(now), ln.weighted_iou(new)), ["pairs", "accepted"], ["current_iou", "candidate_iou", "current_replay", "candidate_replay"])
