"""More registered queries: pixels, profiles, repairs, mosaics and samples, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as E
from .functions import wcs as W
from .operators import align
from .operators import catalog as C
from .operators import images as I
from .operators import stripes
from .plans import production, qc
from .queries import PEAKS, PX, SQL, chips, peaks, query, r, table
from .session import Scratch, checkpoint

GAUSS = "g AS (SELECT d, exp(-0.5 * pow(d / {sigma}, 2)) AS w FROM range(-{reach}, {reach} + 1) t(d))"


def gauss(sigma: float) -> str:
    return GAUSS.format(sigma=float(sigma), reach=int(4 * sigma + 0.5))


# ------------------------------------------------------------------ filters and profiles

ROWS = "rows_ AS (SELECT vec_id, y, count(*) AS n, CASE WHEN count(*) FILTER (v > -0.05) >= 3 THEN median(v) END AS med, var_pop(v) AS var FROM px GROUP BY 1, 2)"


@query(f"""
    WITH {PX}, {ROWS}, {gauss(1.5)}, s AS (SELECT a.vec_id, a.y, sum(b.med * g.w) FILTER (b.med IS NOT NULL) / sum(g.w) FILTER (b.med IS NOT NULL) AS s FROM rows_ a, g JOIN rows_ b ON b.vec_id = a.vec_id AND b.y = greatest(0, least(7, a.y + g.d)) GROUP BY 1, 2)
    SELECT vec_id, y, round(s, 6) AS med_smooth FROM s WHERE s IS NOT NULL""")
def profile_smooth(spark, sf_dir):
    rows = chips(spark, sf_dir).groupBy("vec_id", "y").agg(F.when(F.count(F.when(F.col("v") > -0.05, 1)) >= 3, F.median("v")).alias("med"))
    return I.smooth(rows, ["vec_id"], "y", "med", 1.5).select("vec_id", "y", r("med_smooth").alias("med_smooth"))


def _lowpass_sql(sigma: float, mask: str, value: str = "v", name: str = "lp", source: str = "px") -> str:
    return f"""{name}x AS (SELECT vec_id, y, x + d AS x, sum({value} * w) AS a, sum(w) AS b FROM {source}, g{name} WHERE {mask} GROUP BY 1, 2, 3),
         {name} AS (SELECT vec_id, y + d AS y, x, sum(a * w) / sum(b * w) AS low FROM {name}x, g{name} GROUP BY 1, 2, 3)"""


def _g(sigma: float, name: str) -> str:
    return gauss(sigma).replace("g AS", f"g{name} AS", 1)


@query(f"""WITH {PX}, {_g(1.0, "lp")}, {_lowpass_sql(1.0, "v < 0.2")} SELECT vec_id, y, x, round(low, 6) AS low FROM px JOIN lp USING (vec_id, y, x)""")
def lowpass(spark, sf_dir):
    return I.lowpass(chips(spark, sf_dir), ["vec_id"], 1.0, F.col("v") < 0.2).select("vec_id", "y", "x", r("low").alias("low"))


@query(f"""
    WITH {PX}, {_g(2.0, "a")}, {_lowpass_sql(2.0, "true", name="a")}, q AS (SELECT vec_id, y, x, 0.9 * v + 0.02 * y - 0.01 * x * v AS v FROM px), {_g(2.0, "b")}, {_lowpass_sql(2.0, "true", name="b", source="q")},
         h AS (SELECT px.vec_id, greatest(least(px.v - a.low, 0.3), -0.3) AS ha, greatest(least(q.v - b.low, 0.3), -0.3) AS hb FROM px JOIN a USING (vec_id, y, x) JOIN q USING (vec_id, y, x) JOIN b USING (vec_id, y, x) WHERE px.v < 0.25)
    SELECT vec_id, round(corr(ha, hb), 6) AS detail, count(*) AS n FROM h GROUP BY 1""")
def detail_score(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    other = px.withColumn("v", 0.9 * F.col("v") + 0.02 * F.col("y") - 0.01 * F.col("x") * F.col("v"))
    quiet = px.where("v < 0.25").select("vec_id", "y", "x")
    got = qc.detail_score(px, other, ["vec_id"], 2.0, 0.3, keep=quiet)
    return got.select("vec_id", r("detail").alias("detail"), "n")


@query(f"""
    WITH {PX}, p AS (SELECT vec_id, y, sum(v * v) AS power FROM px GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, y) AS rank, sum(power) OVER (PARTITION BY vec_id) AS whole FROM p),
         h AS (SELECT vec_id, sum(power) / any_value(whole) AS held FROM k WHERE rank <= 2 GROUP BY 1)
    SELECT k.vec_id, k.y, round(power, 6) AS power, round(held, 6) AS held FROM k JOIN h USING (vec_id) WHERE rank <= 2 AND held >= 0.4""")
def linear_rows(spark, sf_dir):
    power = chips(spark, sf_dir).groupBy("vec_id", "y").agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    return I.linear_rows(power, ["vec_id"], "power", "y", 0.4, 2).select("vec_id", "y", r("power").alias("power"), r("held").alias("held"))


def _clip_px(rounds: int, k: float) -> str:
    """CTEs c0.. over px by chip: all values tested anew against each round's figures; s{rounds} has the last ones."""
    out = ["c0 AS (SELECT vec_id, v, true AS live FROM px)"]
    for i in range(rounds + 1):
        out += [f"m{i} AS (SELECT vec_id, median(v) AS m FROM c{i} WHERE live GROUP BY 1)", f"s{i} AS (SELECT c{i}.vec_id, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM c{i} JOIN m{i} USING (vec_id) WHERE live GROUP BY 1)"]
        if i < rounds:
            out.append(f"c{i + 1} AS (SELECT vec_id, v, CASE WHEN s = 0 THEN live ELSE abs(v - m) < {k} * s END AS live FROM c{i} JOIN s{i} USING (vec_id))")
    return ", ".join(out)


SQL["source_mask"] = f"""
    WITH {PX}, {_clip_px(3, 2.0)}, hot AS (SELECT px.vec_id, y, x FROM px JOIN s3 USING (vec_id) WHERE abs(v - m) >= 2.0 * s)
    SELECT vec_id, y, x, EXISTS (SELECT 1 FROM hot h WHERE h.vec_id = px.vec_id AND abs(h.y - px.y) + abs(h.x - px.x) <= 2) AS masked FROM px"""


def _destripe_sql(source: str, mask: str, least: int, sigma: float) -> str:
    """CTEs that end in ``off`` (vec_id, y, o): what each row is off its neighbours."""
    return f"""rw AS (SELECT vec_id, y, count(v) AS n, CASE WHEN count(v) >= {least} THEN median(v) END AS med, var_pop(v) AS var FROM {source} WHERE {mask} GROUP BY 1, 2), {_g(sigma, "d")},
         ends AS (SELECT vec_id, min(y) AS lo, max(y) AS hi FROM rw GROUP BY 1),
         sm AS (SELECT a.vec_id, a.y, sum(b.med * w) / sum(w) AS s FROM rw a JOIN ends USING (vec_id), gd JOIN rw b ON b.vec_id = a.vec_id AND b.y = greatest(lo, least(hi, a.y + gd.d)) WHERE b.med IS NOT NULL GROUP BY 1, 2),
         o AS (SELECT rw.*, med - s AS o FROM rw JOIN sm USING (vec_id, y)), sg AS (SELECT vec_id, greatest(var_pop(o) - avg(pow(1.2533, 2) * var / n), 0) AS sig FROM o GROUP BY 1),
         off AS (SELECT vec_id, y, coalesce(o * sig / nullif(sig + pow(1.2533, 2) * var / greatest(n, 1), 0), 0) AS o FROM o JOIN sg USING (vec_id))"""


SQL["destripe"] = f"""WITH {PX}, {_destripe_sql("px", "true", 3, 3.0)} SELECT vec_id, y, x, round(v - coalesce(o, 0), 6) AS v FROM px LEFT JOIN off USING (vec_id, y)"""

ANGLES = "an AS (SELECT angle, cos(radians(angle)) AS c, sin(radians(angle)) AS s FROM (VALUES (0.0), (30.0), (60.0), (90.0)) t(angle))"
SCAN = f"""{ANGLES}, pr AS (SELECT vec_id, CAST(angle AS DOUBLE) AS angle, CAST(floor(round(y * c - x * s, 9)) AS INTEGER) AS bin, count(*) AS n, avg(v) AS mean FROM px, an GROUP BY 1, 2, 3 HAVING count(*) >= 3), {_g(2.0, "n")},
         pe AS (SELECT vec_id, angle, min(bin) AS lo, max(bin) AS hi FROM pr GROUP BY 1, 2),
         ps AS (SELECT a.vec_id, a.angle, a.bin, any_value(a.mean) AS mean, any_value(a.n) AS n, sum(b.mean * w) / sum(w) AS s FROM pr a JOIN pe USING (vec_id, angle), gn JOIN pr b ON b.vec_id = a.vec_id AND b.angle = a.angle AND b.bin = greatest(lo, least(hi, a.bin + gn.d)) GROUP BY 1, 2, 3),
         pv AS (SELECT vec_id, var_pop(v) AS var FROM px GROUP BY 1), sc AS (SELECT vec_id, angle, avg(pow(mean - s, 2) - var / n) AS power, count(*) AS bins FROM ps JOIN pv USING (vec_id) GROUP BY 1, 2)"""


@query(f"WITH {PX}, {SCAN} SELECT vec_id, angle, round(power, 6) AS power, bins FROM sc")
def angle_scan(spark, sf_dir):
    got = I.angle_scan(chips(spark, sf_dir), ["vec_id"], [0.0, 30.0, 60.0, 90.0], 3, 2.0)
    return got.select("vec_id", "angle", r("power").alias("power"), "bins")


def _strips_sql(px: str, name: str, choice: str) -> str:
    """CTE ``name``: px less the offsets of strips along the chosen angle, seen in windows."""
    return f"""{name}p AS (SELECT p.vec_id, p.y, p.x, p.v, floor(round(p.y * c - p.x * s, 9)) AS bin, p.y * s + p.x * c AS u FROM {px} p JOIN {choice} USING (vec_id)),
         {name}b AS (SELECT vec_id, bin, count(*) AS n, CASE WHEN count(*) >= 3 THEN median(v) END AS med FROM {name}p GROUP BY 1, 2), {name}e AS (SELECT vec_id, min(bin) AS lo, max(bin) AS hi FROM {name}b GROUP BY 1),
         {name}s AS (SELECT a.vec_id, a.bin, sum(b.med * w) / sum(w) AS s FROM {name}b a JOIN {name}e USING (vec_id), gn JOIN {name}b b ON b.vec_id = a.vec_id AND b.bin = greatest(lo, least(hi, a.bin + gn.d)) WHERE b.med IS NOT NULL GROUP BY 1, 2),
         {name} AS (SELECT {name}p.vec_id, y, x, v - coalesce(med - {name}s.s, 0) AS v FROM {name}p JOIN {name}b USING (vec_id, bin) LEFT JOIN {name}s USING (vec_id, bin))"""


@query(f"""
    WITH {PX}, an0 AS (SELECT vec_id, cos(radians(30.0)) AS c, sin(radians(30.0)) AS s FROM embeddings), {_g(2.0, "n")}, {_strips_sql("px", "one", "an0")}
    SELECT vec_id, y, x, round(v, 6) AS v FROM one""")
def destripe_at_angle(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label").withColumn("angle", F.lit(30.0))
    return I.destripe_along(px, ["vec_id"], least=3, detrend=2.0).select("vec_id", "y", "x", r("v").alias("v"))


@query()
def destripe_greedy(spark, sf_dir):
    """The search until no angle of any image stands out, on images of 8 by 8; held against whole-image computations in the tests."""
    with Scratch(spark) as scratch:
        px = chips(spark, sf_dir).select("vec_id", "y", "x", "v")
        options = dict(low=4.0, detrend=2.0, window=4.0, smooth=1.0, coarse=10.0, fine=2.5, reach=10.0, least_scan=3, least_field=3, least_strips=5, significance=10.0)
        pixels, _ = stripes.destripe_search(px, ["vec_id"], scratch, **options)
        return checkpoint(pixels.select("vec_id", "y", "x", r("v").alias("v")))


STRIP = "CAST(floor(round((y - 3.5) * cos(radians(angle)) - (x - 3.5) * sin(radians(angle)) + 3.5 * abs(cos(radians(angle))) + 3.5 * abs(sin(radians(angle))), 9)) AS INTEGER)"


@query(f"""
    WITH {PX}, ca AS (SELECT vec_id, CAST(a AS DOUBLE) AS angle FROM (SELECT vec_id, unnest([vec_id % 90, vec_id % 90 - 45, -(vec_id % 37) - 0.5, 17.375]) AS a FROM embeddings)),
         st AS (SELECT vec_id, angle, {STRIP} AS i, count(*) AS n, sum(greatest(least(v, 0.4), -0.4)) AS s FROM px JOIN ca USING (vec_id) WHERE v < 0.2 GROUP BY 1, 2, 3),
         mx AS (SELECT vec_id, angle, max(i) AS last FROM st GROUP BY 1, 2), g AS (SELECT d, exp(-0.5 * pow(d / 2.0, 2)) AS w FROM range(-8, 9) t(d)), nw AS (SELECT sum(w) AS whole FROM g),
         pr AS (SELECT vec_id, angle, i, n, CASE WHEN n >= 3 THEN s / n END AS p FROM st),
         al AS (SELECT vec_id, angle, k AS i, last FROM mx, range(0, 12) t(k) WHERE k <= last),
         sm AS (SELECT al.vec_id, al.angle, al.i, sum(w * p) AS a, sum(w) FILTER (p IS NOT NULL) AS b FROM al, g JOIN pr ON pr.vec_id = al.vec_id AND pr.angle = al.angle AND pr.i = greatest(0, least(last, al.i + d)) GROUP BY 1, 2, 3),
         re AS (SELECT pr.vec_id, pr.angle, n, p - a / b AS hf FROM pr JOIN sm USING (vec_id, angle, i), nw WHERE p IS NOT NULL AND b / whole > 1e-3)
    SELECT vec_id, angle, CASE WHEN count(hf) >= 5 THEN round(avg(hf * hf / 0.01 - 1.0 / n), 6) END AS score FROM ca LEFT JOIN re USING (vec_id, angle) GROUP BY 1, 2 HAVING count(hf) >= 0""")
def angle_scan_background(spark, sf_dir):
    """A scan whose angles are each image's own, over background pixels with clipped values."""
    px = chips(spark, sf_dir).select("vec_id", "y", "x", F.when(F.col("v") < 0.2, F.col("v")).alias("hp"))
    k = F.col("vec_id")
    own = F.array_distinct(F.array((k % 90).cast("double"), (k % 90 - 45).cast("double"), -(k % 37) - 0.5, F.lit(17.375)))
    candidates = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(0.1).alias("sigma"), own.alias("angles"))
    return stripes.scan(px, candidates, ["vec_id"], least=3, least_strips=5, detrend=2.0).select("vec_id", "angle", r("score").alias("score"))


@query(f"""
    WITH {PX}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), d AS (SELECT vec_id, y, x, v - m AS d FROM px JOIN m USING (vec_id)),
         n AS (SELECT vec_id, d, lead(d) OVER (PARTITION BY vec_id, y ORDER BY x) AS rt, lead(d) OVER (PARTITION BY vec_id, x ORDER BY y) AS dn FROM d),
         a AS (SELECT vec_id, round((avg(d * rt) + avg(d * dn)) / 2 / nullif(avg(d * d), 0), 9) AS acf FROM n GROUP BY 1), k AS (SELECT e.label, a.vec_id, acf, row_number() OVER (PARTITION BY e.label ORDER BY acf, a.vec_id) AS rank, count(*) OVER (PARTITION BY e.label) AS n FROM a JOIN embeddings e USING (vec_id))
    SELECT label, vec_id FROM k WHERE rank <= greatest(1, n // 3)""")
def least_correlated_third(spark, sf_dir):
    keys = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    acf = I.autocorrelation(chips(spark, sf_dir).drop("label"), ["vec_id"]).join(keys, "vec_id").withColumn("acf", F.round("acf1", 9))
    return C.lowest_share(acf, ["label"], [F.col("acf"), F.col("vec_id")], 3).select("label", "vec_id")


# ------------------------------------------------------------------ components, repairs, mosaics

COMPONENTS = """reach AS (SELECT vec_id, y, x, y AS ly, x AS lx FROM hit UNION SELECT h.vec_id, h.y, h.x, r.ly, r.lx FROM reach r JOIN hit h ON h.vec_id = r.vec_id AND abs(h.y - r.y) + abs(h.x - r.x) = 1),
         part AS (SELECT vec_id, y, x, CAST(min(ly * 8 + lx) // 8 AS INTEGER) AS label_y, CAST(min(ly * 8 + lx) % 8 AS INTEGER) AS label_x FROM reach GROUP BY 1, 2, 3)"""
SQL["components"] = f"WITH RECURSIVE {PX}, hit AS (SELECT vec_id, y, x FROM px WHERE v > 0.05), {COMPONENTS} SELECT vec_id, y, x, label_y, label_x FROM part"
VETO = f"""hit AS (SELECT vec_id, y, x FROM px WHERE v > 0.1), {COMPONENTS}, par AS (SELECT vec_id - 1 AS vec_id, y, x, v AS p FROM px),
         pm AS (SELECT vec_id, median(p) AS m FROM par GROUP BY 1), pg AS (SELECT vec_id, 1.4826 * median(abs(p - m)) AS s FROM par JOIN pm USING (vec_id) GROUP BY 1),
         sums AS (SELECT part.vec_id, label_y, label_x, sum(v) AS flux, coalesce(sum(p), 0) AS flux_partner, count(*) AS n_pix FROM part JOIN px USING (vec_id, y, x) LEFT JOIN par USING (vec_id, y, x) GROUP BY 1, 2, 3),
         rays AS (SELECT sums.* FROM sums JOIN pg USING (vec_id) WHERE NOT (flux_partner > 0.3 * flux AND flux_partner > 0.5 * s * sqrt(n_pix)))"""


@query(f"""WITH RECURSIVE {PX}, hit AS (SELECT vec_id, y, x FROM px WHERE v > 0.05), {COMPONENTS}
    SELECT vec_id, label_y, label_x, round(sum(v), 6) AS flux, count(*) AS n_pix FROM part JOIN px USING (vec_id, y, x) GROUP BY 1, 2, 3""")
def component_sums(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    parts = I.label_components(px.where("v > 0.05"), ["vec_id"])
    return parts.join(px, ["vec_id", "y", "x"]).groupBy("vec_id", "label_y", "label_x").agg(r(F.sum("v")).alias("flux"), F.count(F.lit(1)).alias("n_pix"))


@query(f"WITH RECURSIVE {PX}, {VETO} SELECT vec_id, y, x FROM part JOIN rays USING (vec_id, label_y, label_x)")
def veto(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    partner = px.withColumn("vec_id", F.col("vec_id") - 1)
    return production.veto(px.where("v > 0.1"), px, partner, ["vec_id"], ratio=0.3, k=0.5)


@query(f"""
    WITH RECURSIVE {PX}, st AS (SELECT vec_id, y, x, v, v > 0.1 OR x < 5 AND vec_id % 2 = 0 AS bad, 0 AS k FROM px),
         r1 AS ({{fill:st}}), r2 AS ({{fill:r1}}), r3 AS ({{fill:r2}}), r4 AS ({{fill:r3}}), r5 AS ({{fill:r4}})
    SELECT vec_id, y, x, round(v, 6) AS v, bad AS unfilled FROM r5""".replace("{{fill:", "{fill:"))
def fill_until_done(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label").withColumn("bad", (F.col("v") > 0.1) | ((F.col("x") < 5) & (F.col("vec_id") % 2 == 0)))
    return I.median_fill(px, ["vec_id"], "bad", 2, rounds=None).select("vec_id", "y", "x", r("v").alias("v"), "unfilled")


def _fill_sql(source: str) -> str:
    return f"""SELECT a.vec_id, a.y, a.x, CASE WHEN a.bad THEN coalesce(f, a.v) ELSE a.v END AS v, a.bad AND f IS NULL AS bad, 0 AS k FROM {source} a LEFT JOIN (SELECT b.vec_id, b.y, b.x, median(g.v) AS f FROM {source} b JOIN {source} g ON g.vec_id = b.vec_id AND b.bad AND NOT g.bad AND abs(b.y - g.y) <= 2 AND abs(b.x - g.x) <= 2 GROUP BY 1, 2, 3) q USING (vec_id, y, x)"""


for _source in ("st", "r1", "r2", "r3", "r4"):
    SQL["fill_until_done"] = SQL["fill_until_done"].replace(f"{{fill:{_source}}}", _fill_sql(_source))

DRIZZLE = """box AS (SELECT {keys}, v, w, y + dy - 0.4 AS t, y + dy + 0.4 AS b, x + dx - 0.4 AS l, x + dx + 0.4 AS r FROM {source} WHERE w > 0 AND v IS NOT NULL),
         cells AS (SELECT *, unnest(range(CAST(floor(t + 0.5) AS INTEGER), CAST(floor(b + 0.5) AS INTEGER) + 1)) AS oy FROM box), both_ AS (SELECT *, unnest(range(CAST(floor(l + 0.5) AS INTEGER), CAST(floor(r + 0.5) AS INTEGER) + 1)) AS ox FROM cells),
         area AS (SELECT *, greatest(least(b, oy + 0.5) - greatest(t, oy - 0.5), 0) * greatest(least(r, ox + 0.5) - greatest(l, ox - 0.5), 0) * w AS a FROM both_),
         grid AS (SELECT {keys}, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, sum(v * a) / sum(a) AS v, sum(a) AS weight FROM area WHERE a > 1e-12 GROUP BY ALL)"""
SQL["drizzle"] = f"""WITH {PX}, d AS (SELECT label, v, y, x, (vec_id % 4) * 0.25::DOUBLE AS dy, (vec_id % 3) * 0.5::DOUBLE AS dx, 1.0::DOUBLE AS w FROM px), {DRIZZLE.format(keys="label", source="d").replace("GROUP BY ALL", "GROUP BY label, oy, ox")}
    SELECT label, oy, ox, round(v, 6) AS v, round(weight, 6) AS weight FROM grid"""


def _narrow_px(key: str, source: str, value: str, rounds: int, k: float, name: str = "z") -> str:
    """CTEs that end in ``{name}m`` (key, m): the median after rounds of clipping the survivors."""
    out = [f"{name}0 AS (SELECT {key} AS g, {value} AS v, true AS live FROM {source})"]
    for i in range(rounds):
        out += [f"{name}m{i} AS (SELECT g, median(v) AS m FROM {name}{i} WHERE live GROUP BY 1)", f"{name}s{i} AS (SELECT {name}{i}.g, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM {name}{i} JOIN {name}m{i} USING (g) WHERE live GROUP BY 1)",
                f"{name}{i + 1} AS (SELECT {name}{i}.g, v, CASE WHEN s = 0 THEN live ELSE live AND abs(v - m) < {k} * s END AS live FROM {name}{i} JOIN {name}s{i} USING (g))"]
    return ", ".join(out) + f", {name}m AS (SELECT g, median(v) AS m FROM {name}{rounds} WHERE live GROUP BY 1)"


SQL["mosaics"] = f"""WITH {PX}, {_narrow_px("vec_id", "px", "v", 5, 3.0)}, d AS (SELECT label, v - m AS v, y, x, (vec_id % 4) * 0.25::DOUBLE AS dy, (vec_id % 3) * 0.5::DOUBLE AS dx, CASE WHEN v > 0.3 THEN 0.0 ELSE 400.0 END::DOUBLE AS w FROM px JOIN zm ON zm.g = px.vec_id),
    {DRIZZLE.format(keys="label", source="d").replace("GROUP BY ALL", "GROUP BY label, oy, ox")} SELECT label, oy, ox, round(v, 6) AS v, round(weight, 6) AS weight FROM grid"""


@query(f"""WITH {PX}, {_narrow_px("label", "px", "v", 5, 3.0)} SELECT g AS label, round(m, 6) AS sky FROM zm""")
def pooled_sky(spark, sf_dir):
    return production.pooled_sky(chips(spark, sf_dir), ["label"]).select("label", r("sky").alias("sky"))


@query(f"""WITH {PX}, m AS (SELECT vec_id, median(v / CASE WHEN label = 0 THEN 1.0 ELSE label END) AS sky FROM px WHERE y % 4 = 0 AND x % 4 = 0 GROUP BY 1)
    SELECT vec_id, y, x, round(v / CASE WHEN label = 0 THEN 1.0 ELSE label END - sky, 6) AS v, round(sky, 6) AS sky FROM px JOIN m USING (vec_id)""")
def prepared(spark, sf_dir):
    return production.prepare(chips(spark, sf_dir), ["vec_id"], F.col("label"), 4).select("vec_id", "y", "x", r("v").alias("v"), r("sky").alias("sky"))


# ------------------------------------------------------------------ pairs, stamps, turns


@query(f"""WITH {PX} SELECT a.vec_id, a.y, a.x, round(a.v - b.v, 6) AS diff, abs(a.v - b.v) > 0.2 AS touched FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x""")
def pixel_difference(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    other = px.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("w"))
    return px.join(other, ["vec_id", "y", "x"]).select("vec_id", "y", "x", r(F.col("v") - F.col("w")).alias("diff"), (F.abs(F.col("v") - F.col("w")) > 0.2).alias("touched"))


@query(f"""WITH {PX}, {PEAKS}, m AS (SELECT p.vec_id, p.y, p.x, n.vec_id AS partner FROM pk p JOIN embeddings e ON e.vec_id = p.vec_id JOIN px n ON n.label = e.label AND n.vec_id <> p.vec_id AND n.y = p.y AND n.x = p.x AND n.v > 0.1)
    SELECT vec_id, y, x, count(DISTINCT partner) AS votes FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT partner) >= 2""")
def partner_votes(spark, sf_dir):
    px = chips(spark, sf_dir)
    sources = peaks(px.drop("label")).select("vec_id", "y", "x").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    seen = px.where("v > 0.1").select("label", "y", "x", F.col("vec_id").alias("partner"))
    return I.votes_of_others(sources, seen, ["label"], ["vec_id"], "partner")


@query(f"""WITH {PX}, {PEAKS} SELECT p.vec_id, p.y, p.x, n.y - p.y AS dy, n.x - p.x AS dx, n.v AS raw, n.v * 0.5 AS clean FROM pk p JOIN px n ON n.vec_id = p.vec_id AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1""")
def stamps(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    return qc.stamps(px, px.withColumn("v", F.col("v") * 0.5), peaks(px), ["vec_id"], 1)


@query(f"""WITH {PX}, f AS (SELECT vec_id, v, CASE WHEN label % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN label % 3 = 1 THEN 7 - x ELSE x END AS x, label % 4 AS t FROM px)
    SELECT vec_id, v, CAST(CASE t WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y WHEN 3 THEN x ELSE y END AS INTEGER) AS y, CAST(CASE t WHEN 1 THEN y WHEN 2 THEN 7 - x WHEN 3 THEN 7 - y ELSE x END AS INTEGER) AS x FROM f""")
def augmented(spark, sf_dir):
    px = chips(spark, sf_dir)
    return I.augment(px, 8, 8, flip_y=F.col("label") % 2 == 1, flip_x=F.col("label") % 3 == 1, turns=F.col("label")).select("vec_id", "v", "y", "x")


@query(f"""WITH {PX}, o AS (SELECT i AS y, j AS x FROM range(-2, 10) t(i), range(-2, 10) u(j)) SELECT px.vec_id, CAST(o.y AS INTEGER) AS y, CAST(o.x AS INTEGER) AS x, v FROM px JOIN o ON px.y = CASE WHEN o.y < 0 THEN -o.y WHEN o.y > 7 THEN 14 - o.y ELSE o.y END AND px.x = CASE WHEN o.x < 0 THEN -o.x WHEN o.x > 7 THEN 14 - o.x ELSE o.x END""")
def reflect_pad(spark, sf_dir):
    return I.reflect_pad(chips(spark, sf_dir).drop("label"), 8, 8, multiple=12)


@query(f"""WITH {PX} SELECT vec_id, y, x, v FROM px""")
def pad_and_unpad(spark, sf_dir):
    return I.unpad(I.reflect_pad(chips(spark, sf_dir).drop("label"), 8, 8, multiple=12), 8, 8, multiple=12)


@query("""
    WITH w AS (SELECT s_suppkey AS id, 10 + s_suppkey * 1e-5 AS ra0, s_nationkey * 1.0 AS dec0, 1e-5 * (1 + s_suppkey % 3) AS cd FROM supplier),
         p AS (SELECT a.id, a.cd * 20 AS xi, a.cd * 30 AS eta, radians(a.dec0) AS d0, a.ra0 AS ra_a, b.ra0 AS ra_b, b.dec0 AS dec_b, b.cd AS cd_b FROM w a JOIN w b ON b.id = a.id),
         s AS (SELECT *, ra_a + degrees(atan2(radians(xi), cos(d0) - radians(eta) * sin(d0))) AS ra, degrees(atan2(sin(d0) + radians(eta) * cos(d0), sqrt(pow(cos(d0) - radians(eta) * sin(d0), 2) + pow(radians(xi), 2)))) AS dec FROM p),
         t AS (SELECT *, radians(dec) AS d, radians(dec_b) AS e, radians(ra - (ra_b + 2e-5)) AS da FROM s), q AS (SELECT *, sin(d) * sin(e) + cos(d) * cos(e) * cos(da) AS den FROM t)
    SELECT id AS s_suppkey, round(ra, 9) AS ra, round(dec, 9) AS dec, round(degrees(cos(d) * sin(da) / den) / cd_b - 20, 5) AS tx, round(degrees((sin(d) * cos(e) - cos(d) * sin(e) * cos(da)) / den) / cd_b - 30, 5) AS ty FROM q""")
def wcs_translation(spark, sf_dir):
    k = F.col("s_suppkey")

    def wcs(shift: float):
        cd = 1e-5 * (1 + k % 3)
        return F.struct((10 + k * 1e-5 + shift).alias("crval1"), (F.col("s_nationkey") * 1.0).alias("crval2"), F.lit(1.0).alias("crpix1"), F.lit(1.0).alias("crpix2"), cd.alias("cd11"), F.lit(0.0).alias("cd12"), F.lit(0.0).alias("cd21"), cd.alias("cd22"))

    rows = table(spark, sf_dir, "supplier").select("s_suppkey", wcs(0.0).alias("a"), wcs(2e-5).alias("b"))
    sky, move = W.pixel_to_sky(F.col("a"), F.lit(20.0), F.lit(30.0)), W.translation(F.col("a"), F.col("b"), F.lit(20.0), F.lit(30.0))
    return rows.select("s_suppkey", r(sky.ra, 9).alias("ra"), r(sky.dec, 9).alias("dec"), r(move.tx, 5).alias("tx"), r(move.ty, 5).alias("ty"))


@query(f"""
    WITH {PX}, t AS (SELECT vec_id, y, x, y + 0.25 * (vec_id % 3) AS py, x + 0.5 * (vec_id % 2) AS px_ FROM px), c AS (SELECT t.*, floor(py) + j AS cy, floor(px_) + i AS cx, CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE i WHEN 1 THEN px_ - floor(px_) ELSE 1 - (px_ - floor(px_)) END AS w FROM t, range(0, 2) a(j), range(0, 2) b(i)),
         g AS (SELECT c.vec_id, c.y, c.x, sum(p.v * w) AS v, sum(w) AS w FROM c JOIN px p ON p.vec_id = c.vec_id AND p.y = cy AND p.x = cx WHERE w > 0 GROUP BY 1, 2, 3)
    SELECT vec_id, y, x, round(v, 6) AS v FROM g WHERE abs(w - 1) < 1e-9""")
def resample(spark, sf_dir):
    px = chips(spark, sf_dir).drop("label")
    places = px.select("vec_id", "y", "x", (F.col("y") + 0.25 * (F.col("vec_id") % 3)).alias("py"), (F.col("x") + 0.5 * (F.col("vec_id") % 2)).alias("px"))
    return align.resample(places, px, ["vec_id"]).select("vec_id", "y", "x", r("v").alias("v"))
