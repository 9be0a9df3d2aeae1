"""Registered queries over rasters, each with the SQL that says the same.

``masked`` gives every pixel a probability, a type and a protection by fixed rules, so that mask operators
have something to work on; ``pairs`` gives it a damage flag, a known flag and target colours.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.functions import pixels as px
from emulsa.operators import damage as dm
from emulsa.operators import faces as fc
from emulsa.operators import kernels as kn
from emulsa.operators import learning as ln
from emulsa.operators import neighbourhood as nb
from emulsa.operators import resample as rs
from emulsa.plans import restoration
from emulsa.plans.stages import shared_folder
from emulsa.sources.file_formats import digests, save_files
from emulsa.sources.rasters import image_files, rasters, rasters_sql, save_images

KEYS = ["image_id", "y", "x"]
L = "(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b)"
MOST, LEAST = "greatest(r, g, b)", "least(r, g, b)"
TYPE = "case (x * 3 + y * 5) % 7 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(dm.TYPES)) + " end"
PROBABILITY, PROTECTED = "((x * 13 + y * 29) % 101) / 100e0", "(x + 2 * y) % 11 = 0"
DAMAGE, KNOWN = "((x * 7 + y * 3) % 10 < 3)", "((x + y) % 9 <> 0)"
HOLE = "((x % 16 between 3 and 6 and y % 16 between 2 and 7) or (x % 16 = 9 and y % 16 > 10))"
TARGETS = {"tr": "0.9e0 * r + 0.05e0 * g", "tg": "0.8e0 * g + 0.1e0 * b * b", "tb": "b * r + 0.1e0"}

NUDGE = 2.3e-10

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).withColumns({"probability": F.expr(PROBABILITY), "damage_type": F.expr(TYPE), "protected": F.expr(PROTECTED)})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).withColumns({"damage": F.expr(DAMAGE), "known": F.expr(KNOWN), "probability": F.expr(PROBABILITY)} | {k: F.expr(v) for k, v in TARGETS.items()})


MASKED_SQL = f"masked as (select *, {PROBABILITY} as probability, {TYPE} as damage_type, {PROTECTED} as protected from pixels)"
PAIRS_SQL = f"pairs as (select *, {DAMAGE} as damage, {KNOWN} as known, {PROBABILITY} as probability, {', '.join(f'{v} as {k}' for k, v in TARGETS.items())} from pixels)"


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """To six places; a nudge decides alike, in both engines, what lies half-way but for the last bits."""
    return df.select(*keys, *[(F.round(F.col(c) + NUDGE, 6) + 0.0).alias(c) for c in values])


def with_sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([rasters_sql().strip(), *ctes]) + "\n" + body


def r6(**cols: str) -> str:
    return ", ".join(f"round(({v}) + {NUDGE!r}::double, 6) + 0e0 as {k}" for k, v in cols.items())


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def sat_sql(above: str = "0e0") -> str:
    return f"case when {MOST} > {above} then ({MOST} - {LEAST}) / {MOST} else 0e0 end"


WX, WY = "(partition by image_id, y order by x{})", "(partition by image_id, x order by y{})"


def frame(r: int) -> str:
    return f" rows between {r} preceding and {r} following"


def box_sql(source: str, out: str, cols: dict[str, str], r: int) -> str:
    """CTEs of replicated box means of {output: expression over source}."""
    full = " rows between unbounded preceding and unbounded following"

    def one(e: str, w: str, p: str, n: str) -> str:
        return f"(sum({e}) over {w.format(frame(r))} + greatest(0, {r} - {p}) * first_value({e}) over {w.format(full)} + greatest(0, {p} + {r} - {n} + 1) * last_value({e}) over {w.format(full)}) / {2 * r + 1}e0"

    first = f"{out}_x as (select *, {', '.join(f'{one(e, WX, "x", "width")} as _{o}' for o, e in cols.items())} from {source})"
    return first + f",\n{out} as (select *, {', '.join(f'{one(f"_{o}", WY, "y", "height")} as {o}' for o in cols)} from {out}_x)"


def local_sql(source: str, out: str, cols: dict[str, str], r: int) -> str:
    """CTEs of means (m_*) and variances (v_*) over windows cut off at the border."""
    x = ", ".join(f"sum({e}) over {WX.format(frame(r))} as _s{o}, sum(({e}) * ({e})) over {WX.format(frame(r))} as _q{o}" for o, e in cols.items())
    y = ", ".join(f"sum(_s{o}) over {WY.format(frame(r))} / _n{r} as m_{o}, sum(_q{o}) over {WY.format(frame(r))} / _n{r} as _e{o}" for o in cols)
    n = f"((least(x + {r}, width - 1) - greatest(x - {r}, 0) + 1) * (least(y + {r}, height - 1) - greatest(y - {r}, 0) + 1))"
    v = ", ".join(f"greatest(0e0, _e{o} - m_{o} * m_{o}) as v_{o}" for o in cols)
    return f"{out}_x as (select *, {n} as _n{r}, {x} from {source}),\n{out}_y as (select *, {y} from {out}_x),\n{out} as (select *, {v} from {out}_y)"


def near(e: str, axis: str, step: int) -> str:
    return f"{'lead' if step > 0 else 'lag'}({e}) over {(WX if axis == 'x' else WY).format('')}"


LUM = "lum as (select *, " + L + " as lum from pixels)"


# --- scalar expressions -------------------------------------------------------------------------------
@query("luminance", with_sql(f"select image_id, y, x, {r6(lum=L)} from pixels"))
def luminance(spark, sf):
    return rounded(rasters(spark, sf).withColumn("lum", px.luminance()), KEYS, ["lum"])


@query("saturation", with_sql(f"select image_id, y, x, {r6(s0=sat_sql(), s6=sat_sql('1e-6'), s4=sat_sql('1e-4'))} from pixels"))
def saturation(spark, sf):
    return rounded(rasters(spark, sf).withColumns({"s0": px.saturation(), "s6": px.saturation(1e-6), "s4": px.saturation(1e-4)}), KEYS, ["s0", "s6", "s4"])


@query("opponent", with_sql(f"select image_id, y, x, {r6(o1='r - g', o2='(r + g) / 2 - b')} from pixels"))
def opponent(spark, sf):
    o1, o2 = px.opponents()
    return rounded(rasters(spark, sf).withColumns({"o1": o1, "o2": o2}), KEYS, ["o1", "o2"])


@query("quantize", with_sql("select image_id, y, x, " + ", ".join(f"cast(round_even(least(greatest({c}, 0), 1) * 255, 0) as int) as {c}" for c in "rgb") + " from pixels"))
def quantize(spark, sf):
    return rasters(spark, sf).select(*KEYS, *[px.quantize(c).alias(c) for c in "rgb"])


LOGIT = "ln(least(greatest(probability, 1e-6), 1 - 1e-6) / (1 - least(greatest(probability, 1e-6), 1 - 1e-6)))"


@query("calibrate", with_sql(f"select image_id, y, x, {r6(p=f'1 / (1 + exp(-({LOGIT} - 0.8e0)))')}, case when 1 / (1 + exp(-({LOGIT} - 0.8e0))) > 0.05e0 then 'MetallicOrFoxingSpeckle' else 'None' end as damage_type from masked", MASKED_SQL))
def calibrate(spark, sf):
    df = masked(spark, sf).withColumn("p", px.calibrated("probability", 0.2))
    return rounded(df.withColumn("damage_type", F.when(F.col("p") > 0.05, "MetallicOrFoxingSpeckle").otherwise("None")), [*KEYS, "damage_type"], ["p"]).select(*KEYS, "p", "damage_type")


# --- masks --------------------------------------------------------------------------------------------
REPAIR = "(not protected and probability >= 0.5)"
REBUILD = f"({REPAIR} and damage_type in ({', '.join(repr(t) for t in dm.MISSING)}))"


@query("coverage", with_sql(f"select image_id, {r6(coverage=f'100e0 * count(*) filter ({REPAIR}) / count(*)', reconstructed_coverage=f'100e0 * count(*) filter ({REBUILD}) / count(*)')} from masked group by image_id", MASKED_SQL))
def coverage(spark, sf):
    return rounded(dm.coverage(masked(spark, sf)), ["image_id"], ["coverage", "reconstructed_coverage"])


@query("damage_share", with_sql(f"select image_id, {r6(share='coalesce(count(*) filter (damage and known) / nullif(count(*) filter (known), 0)::double, 0)')} from pairs group by image_id", PAIRS_SQL))
def damage_share(spark, sf):
    d = pairs(spark, sf).groupBy("image_id").agg(F.coalesce(F.count_if(F.col("damage") & F.col("known")) / F.nullif(F.count_if("known"), F.lit(0)), F.lit(0.0)).alias("share"))
    return rounded(d, ["image_id"], ["share"])


ACTION = "case (x * 5 + y) % 8 when 0 then 'set' when 1 then 'damaged' when 2 then 'intact' when 3 then 'protect' when 4 then 'unprotect' end"


@query("mask_edits", with_sql(f"select image_id, y, x, {r6(probability=f'''case {ACTION} when 'set' then least(greatest(r * 3 - 1, 0), 1) when 'damaged' then 1 when 'intact' then 0 else probability end''')}, case when {ACTION} = 'protect' then true when {ACTION} = 'unprotect' then false else protected end as protected, case when {ACTION} = 'intact' then 'None' else damage_type end as damage_type from masked", MASKED_SQL))
def mask_edits(spark, sf):
    m = masked(spark, sf)
    e = m.select(*KEYS, F.expr(ACTION).alias("action"), (F.col("r") * 3 - 1).alias("value")).where("action is not null")
    out = dm.edit(m, e)
    return rounded(out, [*KEYS, "protected", "damage_type"], ["probability"]).select(*KEYS, "probability", "protected", "damage_type")


@query("brush", with_sql("select image_id, y, x, coalesce(bool_or((x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius), false) as brushed from pixels cross join (values (20, 12, 5), (2, 38, 9), (24, 14, 7)) s(cx, cy, radius) group by image_id, y, x"))
def brush(spark, sf):
    m = rasters(spark, sf)
    strokes = m.select("image_id").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("cx"), F.lit(b).alias("cy"), F.lit(c).alias("radius")) for a, b, c in ((20, 12, 5), (2, 38, 9), (24, 14, 7))]))).select("image_id", "s.*")
    return dm.brush(m, strokes).select(*KEYS, "brushed")


@query("heat_map", with_sql("select image_id, y, x, cast(case when protected then 0 when probability > 0 then 255 else 0 end as int) as red, cast(case when protected then 255 else 0 end as int) as blue, cast(case when protected then 120 else round_even(probability * 200, 0) end as int) as alpha from masked", MASKED_SQL))
def heat_map(spark, sf):
    return dm.heat_map(masked(spark, sf))


@query("pair_preview", with_sql(f"select image_id, y, x, {r6(r='case when not known then r * 0.35e0 when damage then 0.4e0 * r + 0.6e0 else r end', g='case when not known then g * 0.35e0 when damage then 0.4e0 * g else g end', b='case when not known then b * 0.35e0 when damage then 0.4e0 * b else b end')} from pairs", PAIRS_SQL))
def pair_preview(spark, sf):
    shade = {c: F.when(~F.col("known"), F.col(c) * 0.35).when(F.col("damage"), F.col(c) * 0.4 + (0.6 if c == "r" else 0.0)).otherwise(F.col(c)) for c in "rgb"}
    return rounded(pairs(spark, sf).withColumns(shade), KEYS, ["r", "g", "b"])


# --- neighbourhoods -----------------------------------------------------------------------------------
@query("local_stats", with_sql(f"select image_id, y, x, {r6(mean='m_l', variance='v_l')} from s", LUM, local_sql("lum", "s", {"l": "lum"}, 3)))
def local_stats(spark, sf):
    df = rasters(spark, sf).withColumn("lum", px.luminance())
    return rounded(nb.local_stats(df, {"mean": "lum"}, {"variance": "lum"}, 3), KEYS, ["mean", "variance"])


@query("box_mean", with_sql(f"select image_id, y, x, {r6(m6='m6', m40='m40')} from b", LUM, box_sql("lum", "a", {"m6": "lum"}, 6), box_sql("a", "b", {"m40": "lum"}, 40)))
def box_mean(spark, sf):
    df = rasters(spark, sf).withColumn("lum", px.luminance())
    return rounded(nb.box_mean(nb.box_mean(df, {"m6": "lum"}, 6), {"m40": "lum"}, 40), KEYS, ["m6", "m40"])


DX, DY = f"({near('lum', 'x', 1)} - {near('lum', 'x', -1)})", f"({near('lum', 'y', 1)} - {near('lum', 'y', -1)})"


@query("gradient", with_sql(f"select image_id, y, x, {r6(halved=f'sqrt(pow(coalesce({DX} / 2, 0), 2) + pow(coalesce({DY} / 2, 0), 2))', framed=f'coalesce(sqrt({DX} * {DX} + {DY} * {DY}), 0)')} from lum", LUM))
def gradient(spark, sf):
    df = rasters(spark, sf).withColumn("lum", px.luminance())
    return rounded(df.withColumns({"halved": nb.gradient("lum"), "framed": nb.gradient("lum", False)}), KEYS, ["halved", "framed"])


FOUR = [("x", 1), ("x", -1), ("y", 1), ("y", -1)]
RIDGE = f"least(abs(4 * lum - ({' + '.join(f'coalesce({near("lum", a, s)}, lum)' for a, s in FOUR)})), 1)"


@query("ridge", with_sql(f"select image_id, y, x, {r6(ridge=RIDGE)} from lum", LUM))
def ridge(spark, sf):
    return rounded(rasters(spark, sf).withColumn("lum", px.luminance()).withColumn("ridge", nb.ridge("lum")), KEYS, ["ridge"])


@query("dilate", with_sql(f"select p.image_id, p.y, p.x, bool_or(case when {HOLE.replace('x %', 'q.x %').replace('y %', 'q.y %')} then true else false end) as grown from pixels p join pixels q on p.image_id = q.image_id and abs(p.x - q.x) <= 2 and abs(p.y - q.y) <= 2 group by all"))
def dilate(spark, sf):
    return nb.dilate(rasters(spark, sf).withColumn("hole", F.expr(HOLE)), "hole", "grown", 2).select(*KEYS, "grown")


def cross_sql(source: str, out: str, c: str, grow: bool) -> str:
    op = " or " if grow else " and "
    return f"{out} as (select image_id, y, x, width, height, {c}{op}{op.join(f'coalesce({near(c, a, s)}, false)' for a, s in FOUR)} as {c} from {source})"


ON = f"h0 as (select image_id, y, x, width, height, {HOLE} as h from pixels)"


@query("erode", with_sql("select image_id, y, x, h as worn from h2", ON, cross_sql("h0", "h1", "h", False), cross_sql("h1", "h2", "h", False)))
def erode(spark, sf):
    return nb.cross(rasters(spark, sf).withColumn("hole", F.expr(HOLE)), "hole", "worn", False, 2).select(*KEYS, "worn")


@query("open_close", with_sql("select image_id, y, x, h as cleaned from h6", ON, *[cross_sql(f"h{k}", f"h{k + 1}", "h", g) for k, g in enumerate((False, True, True, True, False, False))]))
def open_close(spark, sf):
    return nb.open_close(rasters(spark, sf).withColumn("hole", F.expr(HOLE)), "hole", "cleaned").select(*KEYS, "cleaned")


@query("seed_holes", with_sql(f"select p.image_id, p.y, p.x, {r6(seed='avg(q.r)')} from pixels p join pixels q on p.image_id = q.image_id and abs(p.x - q.x) <= 1 and abs(p.y - q.y) <= 1 where ({HOLE.replace('x %', 'p.x %').replace('y %', 'p.y %')}) and not ({HOLE.replace('x %', 'q.x %').replace('y %', 'q.y %')}) group by p.image_id, p.y, p.x"))
def seed_holes(spark, sf):
    df = rasters(spark, sf).withColumn("hole", F.expr(HOLE))
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    known = df.where(~F.col("hole")).select("image_id", "y", "x", "r", F.explode(steps).alias("s")).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "r")
    return rounded(known.join(df.where("hole").select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.avg("r").alias("seed")), KEYS, ["seed"])


@query("grain_sigma", with_sql(f"select image_id, {r6(sigma='coalesce(sqrt(avg(res * res)), 0)')} from (select *, lum - ({' + '.join(near('lum', a, s) for a, s in FOUR)}) / 4 as res from (select *, {L} as lum from masked)) where not {REBUILD} group by image_id", MASKED_SQL))
def grain_sigma(spark, sf):
    return rounded(dm.grain_sigma(masked(spark, sf)), ["image_id"], ["sigma"])


REFLECT = "case when f >= n then 2 * n - 2 - f else f end"


def gauss_sql(sigma: float) -> str:
    r = max(1, round(4 * sigma))
    k = f"k as (select k, exp(-k * k / {2 * sigma * sigma}e0) / sum(exp(-k * k / {2 * sigma * sigma}e0)) over () as w from range({-r}, {r + 1}) t(k))"
    fold = lambda p, n: f"case when (({p} + k) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2) >= {n} then 2 * {n} - 2 - (({p} + k) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2) else (({p} + k) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2) end"
    a = f"ga as (select p.image_id, p.y, p.x, p.height, p.lum, sum(k.w * q.lum) as v from lum p cross join k join lum q on q.image_id = p.image_id and q.y = p.y and q.x = {fold('p.x', 'p.width')} group by all)"
    b = f"gb as (select p.image_id, p.y, p.x, p.lum, sum(k.w * q.v) as soft from ga p cross join k join ga q on q.image_id = p.image_id and q.x = p.x and q.y = {fold('p.y', 'p.height')} group by p.image_id, p.y, p.x, p.lum)"
    return ",\n".join([k, a, b])


@query("gaussian", with_sql(f"select image_id, y, x, {r6(soft='soft')} from gb", LUM, gauss_sql(1.5)))
def gaussian(spark, sf):
    return rounded(nb.gaussian(rasters(spark, sf).withColumn("lum", px.luminance()), {"soft": "lum"}, 1.5), KEYS, ["soft"])


DELTA = "case when protected or abs(lum - soft) < 1 / 255e0 then 0 else least(greatest((lum - soft) * 0.5e0, -0.2e0), 0.2e0) end"


@query("unsharp", with_sql(f"select image_id, y, x, {r6(**{c: f'least(greatest({c} + {DELTA}, 0), 1)' for c in 'rgb'})} from masked join gb using (image_id, y, x)", MASKED_SQL, LUM, gauss_sql(0.7)))
def unsharp(spark, sf):
    return rounded(dm.unsharp(masked(spark, sf), 0.5), KEYS, ["r", "g", "b"])


# --- statistics, detection, colour --------------------------------------------------------------------
@query("percentile_linear", with_sql(f"select image_id, {r6(p01='quantile_cont(lum, 0.01)', p99='quantile_cont(lum, 0.99)')} from lum group by image_id", LUM))
def percentile_linear(spark, sf):
    d = rasters(spark, sf).withColumn("lum", px.luminance()).groupBy("image_id").agg(F.percentile("lum", 0.01).alias("p01"), F.percentile("lum", 0.99).alias("p99"))
    return rounded(d, ["image_id"], ["p01", "p99"])


@query("percentile_floor", with_sql(f"select image_id, {r6(value='lum')} from (select *, row_number() over (partition by image_id order by lum) as k, count(*) over (partition by image_id) as n from lum) where k = floor(0.97e0 * (n - 1)) + 1", LUM))
def percentile_floor(spark, sf):
    return rounded(dm.percentile_floor(rasters(spark, sf).withColumn("lum", px.luminance()), "lum", 0.97), ["image_id"], ["value"])


STATS = f"""stats as (
  select *, 0.2126e0 * avg_r + 0.7152e0 * avg_g + 0.0722e0 * avg_b as avg_l from (
    select image_id, avg(r) as avg_r, avg(g) as avg_g, avg(b) as avg_b, quantile_cont({L}, 0.01) as p01, quantile_cont({L}, 0.99) as p99, avg({sat_sql('1e-4')}) as mean_s, count(*) as n
    from masked join (select image_id, count(*) filter (probability < 0.5) < greatest(1000, count(*) / 100e0) as use_all from masked group by image_id) using (image_id)
    where use_all or probability < 0.5 group by image_id))"""


@query("color_stats", with_sql(f"select image_id, {r6(avg_r='avg_r', avg_g='avg_g', avg_b='avg_b', avg_l='avg_l', p01='p01', p99='p99', mean_s='mean_s')}, n from stats", MASKED_SQL, STATS))
def color_stats(spark, sf):
    return rounded(dm.color_stats(masked(spark, sf)), ["image_id", "n"], ["avg_r", "avg_g", "avg_b", "avg_l", "p01", "p99", "mean_s"])


def ratio_sql(c: str) -> str:
    return f"(case when avg_{c} <= 1e-4 then 1 else avg_l / avg_{c} end)"


CAST = f"greatest({', '.join(f'abs({ratio_sql(c)} - 1)' for c in 'rgb')}) > 0.12e0"
STRETCH = "(p01 > 0.06e0 or p99 < 0.92e0)"
COLOR_PLAN = f"""plan as (select image_id, {', '.join(f'case when {CAST} then least(greatest(1 + ({ratio_sql(c)} - 1) * 0.375e0, 0.7e0), 1.4e0) else 1 end as gain_{c}' for c in 'rgb')},
  case when {STRETCH} then p01 * 0.75e0 else 0 end as lo, case when {STRETCH} then greatest(1 + (p99 - 1) * 0.75e0 - p01 * 0.75e0, 0.05e0) else 1 end as span,
  case when avg_l > 0.5 then 1 + (least(ln(0.5e0) / ln(avg_l), 1.08e0) - 1) * 0.75e0 else 1 end as gamma,
  case when mean_s < 0.22e0 then 1 + (least(greatest(0.28e0 / greatest(mean_s, 0.001e0), 1), 1.2e0) - 1) * 0.75e0 else 1 end as boost from stats),
toned as (select image_id, y, x, boost, {', '.join(f'pow(least(greatest(({c} * gain_{c} - lo) / span, 0), 1), gamma) as {c}' for c in 'rgb')} from masked join plan using (image_id))"""


@query("color_restore", with_sql(f"select image_id, y, x, {r6(**{c: f'least(greatest({L} + ({c} - {L}) * boost, 0), 1)' for c in 'rgb'})} from toned", MASKED_SQL, STATS, COLOR_PLAN))
def color_restore(spark, sf):
    return rounded(dm.color_restore(masked(spark, sf)), KEYS, ["r", "g", "b"])


def norm_sql(v: str, lo: str, hi: str) -> str:
    return f"case when {hi} <= {lo} then case when {v} >= {hi} then 1e0 else 0e0 end else least(greatest(({v} - {lo}) / ({hi} - {lo}), 0), 1) end"


_S = 0.2
_FLOOR, _LOW, _RIDGE = 0.90 - 0.15 * _S, 0.0015 + 0.0035 * _S, 0.35 - 0.20 * _S
_FADED = 0.6 * _LOW
RULES = f"""base as (select *, {sat_sql()} as sat from lum),
{local_sql('base', 'near3', {'a': 'lum'}, 3)},
{local_sql('near3', 'near20', {'l': 'lum', 's': 'sat'}, 20)},
scored as (select *, {RIDGE} as ridge, greatest(0e0, lum - m_l) * greatest(0e0, m_s - sat) * sqrt(v_a) as anomaly from near20),
cut as (select image_id, anomaly as t from (select image_id, anomaly, row_number() over (partition by image_id order by anomaly) as k, count(*) over (partition by image_id) as n from scored) where k = floor({1 - (0.03 + 0.07 * _S)!r}::double * (n - 1)) + 1),
judged as (select *, lum >= {_FLOOR!r}::double and v_a <= {_LOW!r}::double as white, ridge >= {_RIDGE!r}::double as crease, t > 0 and anomaly >= t as speckle,
  0.6e0 * ({norm_sql(f'({_FADED!r}::double - v_a)', '0e0', f'{_FADED!r}::double')}) as fp, v_a <= {_FADED!r}::double and lum > 0.15e0 and lum < 0.85e0 as pale from scored join cut using (image_id)),
detected as (select *, case when white then (({norm_sql('lum', f'{_FLOOR!r}::double', '1e0')}) + ({norm_sql(f'({_LOW!r}::double - v_a)', '0e0', f'{_LOW!r}::double')})) / 2 when crease then {norm_sql('ridge', f'{_RIDGE!r}::double', '1e0')} when speckle then {norm_sql('anomaly', 't', '(5 * t)')} when pale and fp > 0 then fp else 0e0 end as probability,
  case when white then '{dm.TYPES[1]}' when crease then '{dm.TYPES[4]}' when speckle then '{dm.TYPES[6]}' when pale and fp > 0 then '{dm.TYPES[5]}' else 'None' end as damage_type from judged)"""


@query("rule_detector", with_sql(f"select image_id, y, x, {r6(probability='probability')}, damage_type from detected", LUM, RULES))
def rule_detector(spark, sf):
    return rounded(dm.rule_detector(rasters(spark, sf)), [*KEYS, "damage_type"], ["probability"]).select(*KEYS, "probability", "damage_type")


FACES = ((10.5, 8.2, 20.0, 15.5), (24.0, 12.0, 12.0, 18.0), (60.0, 60.0, 30.0, 30.0))
IN_FACE = " or ".join(f"(x between greatest(0, floor({fx}e0 - 0.15e0 * {w}e0)) and ceil({fx}e0 + 1.15e0 * {w}e0) and y between greatest(0, floor({fy}e0 - 0.15e0 * {h}e0)) and ceil({fy}e0 + 1.15e0 * {h}e0))" for fx, fy, w, h in FACES)
HIT = f"(({IN_FACE}) and probability > 0 and probability < 0.85e0)"


@query("face_lock", with_sql(f"select image_id, y, x, {r6(probability=f'case when {HIT} then 0 else probability end')}, case when {HIT} then 'None' else damage_type end as damage_type, {HIT} and probability >= 0.5 as cleared from masked", MASKED_SQL))
def face_lock(spark, sf):
    m = masked(spark, sf)
    f = m.select("image_id").distinct().withColumn("f", F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "width", "height"), box, strict=True)]) for box in FACES]))).select("image_id", "f.*")
    out = fc.lock(m, f)
    return rounded(out, [*KEYS, "damage_type", "cleared"], ["probability"]).select(*KEYS, "probability", "damage_type", "cleared")


@query("detections", with_sql(f"select image_id, stride, idx, {r6(score='score', bx='(idx % (640 // stride) + r) * stride - exp(b) * stride / 2', by='(idx // (640 // stride) + g) * stride - exp(b) * stride / 2')} from (select image_id, (8 * (1 + x % 2)) as stride, cast(y * width + x as int) as idx, r, g, b, sqrt(r * g) as score from pixels) where score > 0.6e0"))
def detections(spark, sf):
    cells = rasters(spark, sf).select("image_id", (8 * (1 + F.col("x") % 2)).alias("stride"), (F.col("y") * F.col("width") + F.col("x")).alias("idx"), F.col("r").alias("cls"), F.col("g").alias("obj"), F.array("r", "g", "b", "b").alias("bbox"))
    decoded = fc.decode(cells.withColumn("image_id", F.struct("image_id", "stride", "idx")))
    return rounded(decoded.select(F.col("image_id.image_id").alias("image_id"), F.col("image_id.stride").alias("stride"), F.col("image_id.idx").alias("idx"), "score", F.col("x").alias("bx"), F.col("y").alias("by")), ["image_id", "stride", "idx"], ["score", "bx", "by"])


# --- resampling ---------------------------------------------------------------------------------------
def area_sql(source: str, out: str, p: str, other: str, n: str, size: int) -> str:
    keep = "height" if n == "width" else "width"
    return f"{out} as (select image_id, {other}, o as {p}, {keep}, {size} as {n}, {', '.join(f'sum((least({p} + 1e0, (o + 1) * {n} / {size}e0) - greatest({p} + 0e0, o * {n} / {size}e0)) / ({n} / {size}e0) * {c}) as {c}' for c in 'rgb')} from {source} join range({size}) t(o) on ({p} + 1) * {size}e0 / {n} > o and {p} * {size}e0 / {n} < o + 1 group by image_id, {other}, o, {keep})"


@query("area_resize", with_sql(f"select image_id, cast(y as int) as y, cast(x as int) as x, {r6(r='r', g='g', b='b')} from ay", area_sql("pixels", "ax", "x", "y", "width", 24), area_sql("ax", "ay", "y", "x", "height", 17)))
def area_resize(spark, sf):
    return rounded(rs.area_resize(rasters(spark, sf), ["r", "g", "b"], 24, 17).withColumn("y", F.col("y").cast("int")), KEYS, ["r", "g", "b"])


def taps_sql(source: str, out: str, p: str, other: str, n: str, size: int, cubic: bool) -> str:
    keep = "height" if n == "width" else "width"
    f = f"((o + 0.5e0) * {n} / {size}e0 - 0.5e0)"
    grid = f"{out}_g as (select image_id, {n} as n, o, cast(floor({f}) as int) as s, {f} - floor({f}) as t from (select distinct image_id, {n} from {source}) cross join range({size}) t(o))"
    if cubic:
        inner, outer = "((1.25e0 * ({d}) - 2.25e0) * ({d}) * ({d}) + 1)", "(((-0.75e0 * ({d}) + 3.75e0) * ({d}) - 6) * ({d}) + 3)"
        ws = [outer.format(d="t + 1"), inner.format(d="t"), inner.format(d="1 - t")]
        ws.append(f"(1 - {ws[0]} - {ws[1]} - {ws[2]})")
        taps = " union all ".join(f"select image_id, o, least(greatest(s + {k - 1}, 0), n - 1) as i, {w} as w from {out}_g" for k, w in enumerate(ws))
    else:
        taps = f"select image_id, o, case when s < 0 then 0 when s >= n - 1 then n - 1 else s end as i, case when s < 0 or s >= n - 1 then 1 else 1 - t end as w from {out}_g union all select image_id, o, s + 1, t from {out}_g where s >= 0 and s < n - 1"
    return f"{grid},\n{out}_t as ({taps}),\n{out} as (select p.image_id, {other}, o as {p}, {keep}, {size} as {n}, {', '.join(f'sum(w * {c}) as {c}' for c in 'rgb')} from {source} p join {out}_t k on p.image_id = k.image_id and p.{p} = k.i group by p.image_id, {other}, o, {keep})"


for _name, _cubic in (("bilinear", False), ("bicubic", True)):

    @query(_name, with_sql(f"select image_id, cast(y as int) as y, cast(x as int) as x, {r6(r='r', g='g', b='b')} from ty", taps_sql("pixels", "tx", "x", "y", "width", 80, _cubic), taps_sql("tx", "ty", "y", "x", "height", 50, _cubic)))
    def _resized(spark, sf, cubic=_cubic):
        return rounded((rs.bicubic if cubic else rs.bilinear)(rasters(spark, sf), ["r", "g", "b"], 80, 50), KEYS, ["r", "g", "b"])


@query("tiles", with_sql(f"select image_id, ty, tx, bool_or({HOLE} and y between ty and ty + 15 and x between tx and tx + 15) as work from pixels cross join (values (0), (12), (24)) a(ty) cross join (values (0), (12), (24), (32)) b(tx) group by image_id, ty, tx"))
def tiles(spark, sf):
    ys, xs = rs.tile_starts(40, 16, 4), rs.tile_starts(48, 16, 4)
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("ty"), F.lit(x).alias("tx")) for y in ys for x in xs]))
    p = rasters(spark, sf).withColumn("hole", F.expr(HOLE)).select("image_id", "y", "x", "hole", cells.alias("t"))
    inside = (F.col("y") >= F.col("t.ty")) & (F.col("y") < F.col("t.ty") + 16) & (F.col("x") >= F.col("t.tx")) & (F.col("x") < F.col("t.tx") + 16)
    return p.groupBy("image_id", F.col("t.ty").alias("ty"), F.col("t.tx").alias("tx")).agg(F.bool_or(F.col("hole") & inside).alias("work"))


@query("tile_count", with_sql(f"select image_id, count(*) filter (work) as n from (select image_id, ty, tx, bool_or({HOLE} and y between ty and ty + 15 and x between tx and tx + 15) as work from pixels cross join (values (0), (12), (24)) a(ty) cross join (values (0), (12), (24), (32)) b(tx) group by image_id, ty, tx) group by image_id"))
def tile_count(spark, sf):
    """Tiles of each image that have something to fill."""
    return tiles(spark, sf).groupBy("image_id").agg(F.count_if("work").alias("n"))


@query("file_digests", "select 'supplier-' || s_suppkey || '.txt' as name, octet_length(encode(s_name)) as length, sha256(s_name) as sha256 from supplier")
def file_digests(spark, sf):
    """A file for each supplier, written by the sink and read back for its length and digest."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    save_files(s.select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), F.col("s_name").cast("binary").alias("content")), folder)
    return digests(spark, folder)


# --- features and learning ----------------------------------------------------------------------------
def features_sql() -> str:
    base = f"f0 as (select *, {L} as lum, {sat_sql('1e-6')} as sat, r - g as o1, (r + g) / 2 - b as o2, {MOST} as most, {LEAST} as least_ from pixels),\nf1 as (select *, sqrt(pow(coalesce({DX} / 2, 0), 2) + pow(coalesce({DY} / 2, 0), 2)) as grad, lum * lum as lum_sq from f0)"
    parts, source, cols = [base], "f1", {"lum": "lum", "sat": "sat", "o1": "o1", "o2": "o2", "most": "most", "least": "least_"}
    for r in ln.RADII:
        parts.append(box_sql(source, f"b{r}", {f"m_{c}_{r}": c for c in ("lum", "lum_sq", "sat", "o1", "o2", "grad")}, r))
        source = f"b{r}"
        cols |= {f"d_lum_{r}": f"lum - m_lum_{r}", f"std_{r}": f"sqrt(greatest(m_lum_sq_{r} - m_lum_{r} * m_lum_{r}, 0))", f"d_sat_{r}": f"sat - m_sat_{r}", f"d_o1_{r}": f"o1 - m_o1_{r}", f"d_o2_{r}": f"o2 - m_o2_{r}", f"grad_{r}": f"m_grad_{r}"}
    cols |= {c: c for c in ("m_sat_6", "m_lum_6", "m_sat_40", "m_lum_40")}
    return with_sql(f"select image_id, y, x, {r6(**{k: (v if not k.startswith('std') else f'round({v}, 5)') for k, v in cols.items()})} from b40", *parts)


@query("features34", features_sql())
def features34(spark, sf):
    df, names = ln.features(rasters(spark, sf))
    return rounded(df.withColumns({n: F.round(n, 5) for n in names if n.startswith("std")}), KEYS, names)


NET = ln.Network([3, 2, 1], [0.4, 0.5, 0.45], [0.2, 0.25, 0.3], [[0.5, -0.75, 0.25, 0.5, -0.3, 0.9], [1.2, -0.8]], [[0.1, -0.05], [-0.2]])
_Z = ["((lum - 0.4e0) / 0.2e0)", f"(({sat_sql('1e-6')} - 0.5e0) / 0.25e0)", "((r - 0.45e0) / 0.3e0)"]
_H = [f"greatest({_Z[0]} * {a}e0 + {_Z[1]} * {b}e0 + {_Z[2]} * {c}e0 + {d}e0, 0)" for a, b, c, d in ((0.5, 0.25, -0.3, 0.1), (-0.75, 0.5, 0.9, -0.05))]


@query("network", with_sql(f"select image_id, y, x, {r6(raw='raw', smooth='smooth')} from s", LUM, f"raw as (select *, 1 / (1 + exp(-({_H[0]} * 1.2e0 - {_H[1]} * 0.8e0 - 0.2e0))) as raw from lum)", box_sql("raw", "s", {"smooth": "raw"}, 1)))
def network(spark, sf):
    df = rasters(spark, sf).withColumns({"lum": px.luminance(), "sat": px.saturation(1e-6), "red": F.col("r")})
    df = ln.predict(df, ["lum", "sat", "red"], NET)
    return rounded(nb.box_mean(df, {"smooth": "raw"}, 1), KEYS, ["raw", "smooth"])


HELD = "(cast(floor(x * 4 / width::double) as int) = (3 * cast(floor(y * 4 / height::double) as int) + 1) % 4)"


@query("held_out", with_sql(f"select image_id, y, x, {HELD} as held from pixels"))
def held_out(spark, sf):
    return rasters(spark, sf).select(*KEYS, ln.held_out().alias("held"))


@query("iou_score", with_sql(f"""select image_id, {r6(iou="coalesce(both_ / nullif(either_, 0)::double, 1)", false_flags="coalesce(1 - both_ / nullif(flagged, 0)::double, 0)", precision="coalesce(both_ / nullif(flagged, 0)::double, 0)", recall="coalesce(both_ / nullif(damaged, 0)::double, 0)", flagged_share="flagged / n::double")}
from (select image_id, count(*) filter (probability > 0.5 and damage) as both_, count(*) filter (probability > 0.5 or damage) as either_, count(*) filter (probability > 0.5) as flagged, count(*) filter (damage) as damaged, count(*) as n from pairs where known and {HELD} group by image_id)""", PAIRS_SQL))
def iou_score(spark, sf):
    return rounded(ln.scores(pairs(spark, sf)), ["image_id"], ["iou", "false_flags", "precision", "recall", "flagged_share"])


@query("weighted_iou", with_sql(f"select {r6(iou='sum(r) filter (probability > 0.5 and damage) / sum(r) filter (probability > 0.5 or damage)')} from pairs", PAIRS_SQL))
def weighted_iou(spark, sf):
    return rounded(ln.weighted_iou(pairs(spark, sf).withColumns({"label": F.col("damage"), "weight": F.col("r")})), [], ["iou"])


@query("ncc", with_sql(f"select image_id, {r6(ncc='case when count(*) filter (known) < 0.4e0 * count(*) then -1 else corr(r, g) filter (known) end')} from pairs group by image_id", PAIRS_SQL))
def ncc(spark, sf):
    return rounded(ln.ncc(pairs(spark, sf).withColumn("valid", F.col("known")), "r", "g", ["image_id"]), ["image_id"], ["ncc"])


_T = list(ln.TERMS)
_PAIRS = [(a, b) for i, a in enumerate(_T) for b in _T[i:]] + [(a, t) for a in _T for t in TARGETS]


@query("normal_equations", with_sql(f"select image_id, split_part(k, ':', 1) as i, split_part(k, ':', 2) as j, round(v + {NUDGE!r}::double, 6) + 0e0 as value from (unpivot (select image_id, " + ", ".join(f"""sum(({ln.TERMS[a]}) * ({ln.TERMS.get(b, b)})) as "{a}:{b}\"""" for a, b in _PAIRS) + " from pairs where known group by image_id) on columns(* exclude (image_id)) into name k value v)", PAIRS_SQL))
def normal_equations(spark, sf):
    return rounded(ln.normal_equations(pairs(spark, sf).where("known"), ["image_id"]), ["image_id", "i", "j"], ["value"])


@query("stratified_sample", with_sql("""select image_id, y, x, damage from (
  select p.*, row_number() over (partition by image_id, damage order by md5('1:' || y || ':' || x), y, x) as k from pairs p)
join (select *, least(p, cast(floor(t * greatest(0.3e0, p / (p + q)::double)) as bigint)) as pos from (select image_id, count(*) filter (damage) as p, count(*) filter (not damage) as q, least(500, count(*)) as t from pairs group by image_id)) using (image_id)
where k <= case when damage then pos else least(q, t - pos) end""", PAIRS_SQL))
def stratified_sample(spark, sf):
    """The drawn rows themselves."""
    return ln.stratified(pairs(spark, sf), 500).select(*KEYS, "damage")


@query("replay_split", with_sql("select image_id, (y * width + x) % 5 <> 0 as trains, count(*) as n, " + r6(mean="avg(r)") + " from pixels group by all"))
def replay_split(spark, sf):
    d = rasters(spark, sf).groupBy("image_id", ((F.col("y") * F.col("width") + F.col("x")) % 5 != 0).alias("trains")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"))
    return rounded(d, ["image_id", "trains", "n"], ["mean"])


# --- kernels, composites ------------------------------------------------------------------------------
COMPONENTS = f"""nodes as (select image_id, y, x, cast(y * width + x as bigint) as id from pixels where {HOLE}),
reach as (select image_id, id, id as root from nodes
  union select n.image_id, n.id, r.root from reach r join nodes m on m.image_id = r.image_id and m.id = r.id join nodes n on n.image_id = m.image_id and abs(n.x - m.x) + abs(n.y - m.y) = 1)"""


@query("components", with_sql("select image_id, y, x, component from nodes join (select image_id, id, min(root) as component from reach group by all) using (image_id, id)", COMPONENTS).replace("with ", "with recursive ", 1))
def components(spark, sf):
    return kn.components(rasters(spark, sf).withColumn("hole", F.expr(HOLE)), "hole")


@query("identity_guard", with_sql(f"select image_id, {r6(deviation='max(n) / any_value(total)::double')}, max(n) / any_value(total)::double <= 0.06e0 as passed from (select image_id, component, count(*) as n from (select image_id, id, min(root) as component from reach group by all) group by all) join (select image_id, count(*) as total from pixels group by 1) using (image_id) group by image_id", COMPONENTS).replace("with ", "with recursive ", 1))
def identity_guard(spark, sf):
    return rounded(kn.identity_guard(rasters(spark, sf).withColumn("hole", F.expr(HOLE)), "hole"), ["image_id", "passed"], ["deviation"]).select("image_id", "deviation", "passed")


@query("inpaint")
def inpaint(spark, sf):
    return rounded(kn.inpaint(rasters(spark, sf).withColumn("hole", F.expr(HOLE))), KEYS, ["r", "g", "b"])


def detector_network() -> ln.Network:
    """A network of the detector's layout, 34-32-16-1, with weights by a rule (none is shipped)."""
    sizes = [34, 32, 16, 1]
    wave = lambda n, k: [round(((i * 7919 + k * 104729) % 2001 - 1000) / 4000, 6) for i in range(n)]
    return ln.Network(sizes, wave(34, 1), [0.5 + abs(v) for v in wave(34, 2)], [wave(a * b, k + 3) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))], [wave(n, k + 6) for k, n in enumerate(sizes[1:])], 0.5, 1)


@query("learned_detector")
def learned_detector(spark, sf):
    return rounded(ln.learned_detector(rasters(spark, sf), detector_network()).select(*KEYS, "raw", "probability"), KEYS, ["raw", "probability"])


@query("image_sink", with_sql(f"select image_id, y, x, width, height, {r6(r='round_even(least(greatest(r, 0), 1) * 255, 0) / 255', g='round_even(least(greatest(g, 0), 1) * 255, 0) / 255', b='round_even(least(greatest(b, 0), 1) * 255, 0) / 255')} from pixels"))
def image_sink(spark, sf):
    """Saved as PNG files and scanned again."""
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    save_images(rasters(spark, sf), folder)
    back = image_files(spark, folder).withColumn("image_id", F.regexp_extract("origin", r"([0-9]+)\.png$", 1).cast("long"))
    return rounded(back, [*KEYS, "width", "height"], ["r", "g", "b"])


@query("detector_at_size")
def detector_at_size(spark, sf):
    """Works at a longer side of 50, so that some images shrink and others keep their size."""
    raw = ln.detected_raw(rasters(spark, sf), detector_network(), 50)
    return rounded(ln.as_mask(raw, detector_network()), [*KEYS, "damage_type"], ["raw", "probability"])


class BrightCells:
    """A stand-in for a face model: a cell's score is the brightness of its middle, its box as wide as the cell."""

    def __call__(self):
        def run(planes):
            out = {}
            for stride in fc.STRIDES:
                middle = planes[:, stride // 2 :: stride, stride // 2 :: stride].mean(0).ravel() / 255
                out |= {f"cls_{stride}": middle, f"obj_{stride}": middle, f"bbox_{stride}": np.tile([0.5, 0.5, 0.0, 0.0], (len(middle), 1)).ravel()}
            return out

        return run


@query("face_tiles")
def face_tiles(spark, sf):
    found = fc.detect(rasters(spark, sf), BrightCells(), sides=(96, 192), tile=96, overlap=32, above=0.7)
    return rounded(found, ["image_id"], ["x", "y", "width", "height", "score"])


def sized_sql(long_side: int) -> str:
    side = lambda n: f"greatest(1, cast(round_even({n} * least(1e0, {long_side}e0 / greatest(width, height)), 0) as int))"
    return f"sized as (select *, {side('width')} as tw, {side('height')} as th from pixels)"


def each_area_sql(source: str, out: str, p: str, other: str, n: str, m: str) -> str:
    share = f"(least({p} + 1e0, (o + 1) * {n} / {m}::double) - greatest({p} + 0e0, o * {n} / {m}::double)) / ({n} / {m}::double)"
    keep = "image_id, width, height, tw, th"
    return f"{out} as (select {keep}, {other}, o as {p}, {', '.join(f'sum({share} * {c}) as {c}' for c in 'rgb')} from {source} join range({DRAWN_MOST}) t(o) on o < {m} and ({p} + 1) * {m}::double / {n} > o and {p} * {m}::double / {n} < o + 1 group by {keep}, {other}, o)"


DRAWN_MOST = 64


@query("resize_each", with_sql(f"select image_id, cast(y as int) as y, cast(x as int) as x, tw as width, th as height, {r6(r='r', g='g', b='b')} from ey", sized_sql(50), each_area_sql("sized", "ex", "x", "y", "width", "tw"), each_area_sql("ex", "ey", "y", "x", "height", "th")))
def resize_each(spark, sf):
    p = rasters(spark, sf)
    to_width, to_height = rs.working_size(50)
    sizes = p.select("image_id", "width", "height").distinct().withColumns({"to_width": to_width, "to_height": to_height})
    return rounded(rs.resize_each(p, ["r", "g", "b"], sizes), [*KEYS, "width", "height"], ["r", "g", "b"])


@query("locked_restoration")
def locked_restoration(spark, sf):
    m = masked(spark, sf)
    faces = m.groupBy("image_id").agg((F.max("width") * 0.25).alias("x"), (F.max("height") * 0.25).alias("y"), (F.max("width") * 0.5).alias("width"), (F.max("height") * 0.5).alias("height"))
    return rounded(restoration.restore(m, dm.Settings(), faces=faces), KEYS, ["r", "g", "b"])


@query("grain_match")
def grain_match(spark, sf):
    m = masked(spark, sf)
    return rounded(dm.grain_match(m, m), KEYS, ["r", "g", "b"])


@query("suppress_boxes")
def suppress_boxes(spark, sf):
    boxes = rasters(spark, sf).select("image_id", (F.col("x") * 1.0).alias("x"), (F.col("y") * 1.0).alias("y"), (4 + 12 * F.col("r")).alias("width"), (4 + 12 * F.col("g")).alias("height"), F.col("b").alias("score"))
    return fc.suppress(boxes)


@query("pipeline_audit", with_sql(f"""select image_id, seq, stage, applied, message from (
 select image_id, printf('%.2f', 100e0 * count(*) filter ({REPAIR}) / count(*)) as c, printf('%.2f', 100e0 * count(*) filter ({REBUILD}) / count(*)) as k from masked group by image_id)
 cross join lateral (values (1, 'Color', true, 'strength 75%'), (2, 'Reconstruct', true, 'damage ' || c || '%, rebuilt ' || k || '%'), (3, 'IdentityGuard', true, 'advisory'), (4, 'Grain', true, 'matched'), (5, 'Enhance', false, 'off'), (6, 'Sharpen', true, 'amount 10%')) v(seq, stage, applied, message)""", MASKED_SQL))
def pipeline_audit(spark, sf):
    return restoration.audit(masked(spark, sf), dm.Settings())


@query("run_report")
def run_report(spark, sf):
    return restoration.report(masked(spark, sf), dm.Settings())


@query("restoration")
def restore(spark, sf):
    return rounded(restoration.restore(masked(spark, sf), dm.Settings()), KEYS, ["r", "g", "b"])


def queries() -> dict[str, Query]:
    from emulsa.plans import training  # noqa: F401  adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from emulsa.plans import training  # noqa: F401  adds its own

    return dict(_sql)
