"""More registered queries: names, expressions, catalogs, files and reports, with equivalent SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions import exprs as E
from .functions import names as N
from .operators import catalog as C
from .operators import stats as S
from .plans import curation, qc, samples
from .queries import PX, chips, query, r, table
from .session import Scratch, checkpoint
from .sources import catalogs, fits

# ------------------------------------------------------------------ names

PATHS = """paths AS (SELECT p_partkey, p_size, '/data/' || p_type || '_' || replace(p_brand, '#', '_') || '/f606w/hst_' || p_partkey || '_' || p_size || '_acs_wfc_f606w_j' || p_partkey || 'q_flc.fits' AS path,
            CASE p_size % 3 WHEN 0 THEN 'CLEAR1L' WHEN 1 THEN p_brand ELSE ' ' END AS f1, CASE WHEN p_size % 2 = 0 THEN 'CLEAR2S' ELSE p_type END AS f2 FROM part)"""


def _paths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    path = F.concat(F.lit("/data/"), "p_type", F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/f606w/hst_"), key, F.lit("_"), size, F.lit("_acs_wfc_f606w_j"), key, F.lit("q_flc.fits"))
    f1 = F.when(F.col("p_size") % 3 == 0, "CLEAR1L").when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(" ")
    return part.select("p_partkey", "p_size", path.alias("path"), f1.alias("f1"), F.when(F.col("p_size") % 2 == 0, "CLEAR2S").otherwise(F.col("p_type")).alias("f2"))


@query(f"""
    WITH {PATHS}, b AS (SELECT *, list_last(string_split(path, '/')) AS base FROM paths)
    SELECT p_partkey, string_split(base, '_')[-2] AS rootname, regexp_extract(base, 'hst_(\\d+)_(\\w+?)_acs', 2) AS visit, p_partkey || '_' || p_size AS visit_joined,
           replace(string_split(path, '/')[-3], '_', ' ') AS galaxy, replace(path, '_flc.fits', '_flc_chip2.fits') AS chip2, replace(path, '/data/', '/clean/') AS cleaned,
           lower(left('j' || p_partkey || 'q', 8)) AS root, lower(left('j' || p_partkey || 'q', 8)) AS root_short, base AS base FROM b""")
def path_names(spark, sf_dir):
    path = F.col("path")
    short = F.concat(F.lit("/x/j"), F.col("p_partkey").cast("string"), F.lit("q_flc.fits"))
    root_long = N.root8(F.regexp_replace(path, "_flc.fits$", "_flc.fits"))
    return _paths(spark, sf_dir).select(
        "p_partkey", N.rootname(path).alias("rootname"), N.visit(path).alias("visit"), N.visit(path, joined=True).alias("visit_joined"), N.galaxy_from_path(path).alias("galaxy"), N.chip_path(path, 2).alias("chip2"),
        N.reroot(path, "/data/", "/clean/").alias("cleaned"), root_long.alias("root"), N.root8(short).alias("root_short"), N.basename(path).alias("base"),
    )


@query(f"""
    WITH {PATHS} SELECT p_partkey, CASE WHEN trim(f1) <> '' AND NOT starts_with(trim(f1), 'CLEAR') THEN trim(f1) WHEN trim(f2) <> '' AND NOT starts_with(trim(f2), 'CLEAR') THEN trim(f2) ELSE coalesce(nullif(trim(f1), ''), nullif(trim(f2), ''), 'UNKNOWN') END AS first_real,
           CASE WHEN starts_with(f1, 'CLEAR') THEN f2 ELSE f1 END AS second_if_clear, f1 || ' → ' || f2 AS both FROM paths""")
def filter_names(spark, sf_dir):
    f1, f2 = F.col("f1"), F.col("f2")
    return _paths(spark, sf_dir).select("p_partkey", N.filter_first_clear(f1, f2).alias("first_real"), N.filter_second_if_clear(f1, f2).alias("second_if_clear"), N.date_range(f1, f2).alias("both"))


# ------------------------------------------------------------------ expressions


@query("""
    SELECT l_orderkey, l_linenumber, CAST(format('{:.5f}', l_quantity * 5e-6) AS DOUBLE) AS on_halves, CAST(format('{:.5f}', l_extendedprice / (l_linenumber + 2e0)) AS DOUBLE) AS centre, CAST(format('{:.0f}', l_quantity / 2e0) AS DOUBLE) AS whole FROM lineitem""")
def python_round(spark, sf_dir):
    """Binary values rounded as Python rounds them, many of them on a half in decimals."""
    price, lines, quantity = F.col("l_extendedprice").cast("double"), F.col("l_linenumber"), F.col("l_quantity").cast("double")
    parts = {"on_halves": E.python_round(quantity * 5e-6), "centre": E.python_round(price / (lines + 2.0)), "whole": E.python_round(quantity / 2.0, 0)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in parts.items()])


@query("""
    WITH e AS (SELECT event_id, value AS v, user_id AS u, CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN 'NaN'::DOUBLE WHEN user_id % 10 = 2 THEN 'Infinity'::DOUBLE ELSE value END AS w FROM events)
    SELECT event_id, round(sinh(asinh(v / 7.0)) * 7.0, 6) AS restored, round(2290.0 * abs(radians(v / 100)), 6) AS corner, round(v * v / (v * v + pow(1.2533 * 3.0, 2) / greatest(u * 0.8, 1.0)), 6) AS wiener,
           CASE WHEN u % 4 = 0 THEN 'Infinity'::DOUBLE ELSE round(10 * log10(1 / (u % 4 / 8.0)), 6) END AS psnr, w IS NOT NULL AND isfinite(w) AS finite, CASE WHEN w IS NULL OR isnan(w) THEN 0.0 ELSE w END AS filled,
           v BETWEEN 30 AND 130 AS usable, v * 1000 < 60000 AS unsaturated, u % 10 / 20.0 >= 0.15 AS quiet, u % 3 > 0 AND abs(v - 50) < 1 AS same_setup, (u % 10 / 50.0 <= 0.15 AND v / 100 > 0.5 AND v / 100 > 5 * (u % 10 / 50.0)) AS gradient FROM e""")
def more_expressions(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    w = F.when(u % 10 == 0, None).when(u % 10 == 1, F.lit(float("nan"))).when(u % 10 == 2, F.lit(float("inf"))).otherwise(v)
    width = F.when(u % 3 > 0, 4096).when(u % 3 <= 0, 512)
    return table(spark, sf_dir, "events").select(
        "event_id", E.half_away(E.asinh_restore(E.asinh_stretch(v, F.lit(7.0)), F.lit(7.0)), 6, signed_zero=True).alias("restored"), r(E.roll_displacement(v / 100)).alias("corner"), r(E.wiener(v * v, F.lit(3.0), u, 0.8)).alias("wiener"),
        F.when(u % 4 == 0, E.psnr(F.lit(0.0))).otherwise(r(E.psnr(F.when(u % 4 != 0, u % 4 / 8.0)))).alias("psnr"), E.finite(w).alias("finite"), E.no_nan(w).alias("filled"),
        E.in_range(v, 30, 130, missing=None).alias("usable"), E.unsaturated(v * 1000, missing=None).alias("unsaturated"), E.enough_background(u % 10, F.lit(20), missing=None).alias("quiet"),
        E.same_setup(width, F.lit(2048), v, F.lit(50.0), missing=None).alias("same_setup"), E.is_gradient(v / 100, u % 10 / 50.0, missing=None).alias("gradient"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AND l_quantity > 25 AS both, l_returnflag = 'R' OR l_quantity > 25 AS either, l_returnflag = 'R' AND NOT l_quantity > 25 AS only_first FROM lineitem""")
def mask_algebra(spark, sf_dir):
    a, b = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (a & b).alias("both"), (a | b).alias("either"), (a & ~b).alias("only_first"))


# ------------------------------------------------------------------ catalogs


@query("""
    SELECT o_custkey, count(*) AS n_exposures, round(avg(o_totalprice), 7) AS ra_targ, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey), ',') AS files FROM orders GROUP BY 1 HAVING count(*) >= 2""")
def catalog_mean_centre(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_totalprice")
    out = C.catalog(orders, ["o_custkey"], "o_orderkey", "d", "o_orderpriority", "o_totalprice", "o_totalprice", centre="mean")
    return out.select("o_custkey", "n_exposures", r("ra_targ", 7).alias("ra_targ"), F.array_join(F.transform("files", lambda f: f.cast("string")), ",").alias("files"))


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def first_appearance(spark, sf_dir):
    return C.first_occurrences(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 25""")
def first_targets(spark, sf_dir):
    return C.take_targets(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("""SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part) WHERE place IN (0, 3, 4, 17, 100000)""")
def subset_by_place(spark, sf_dir):
    return catalogs.subset(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], [0, 3, 4, 17, 100_000])


@query("""
    WITH f AS (SELECT l_orderkey AS obs_id, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'FLC' WHEN 'N' THEN 'FLT' ELSE 'DRC' END AS sub FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')),
         b AS (SELECT obs_id, bool_or(sub = 'FLC') AS flc FROM f WHERE sub <> 'DRC' GROUP BY 1)
    SELECT obs_id, n, sub AS "productSubGroupDescription" FROM f JOIN b USING (obs_id) WHERE sub = CASE WHEN flc THEN 'FLC' ELSE 'FLT' END""")
def products_of_observations(spark, sf_dir):
    sub = F.when(F.col("l_returnflag") == "R", "FLC").when(F.col("l_returnflag") == "N", "FLT").otherwise("DRC")
    products = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_linenumber").alias("n"), sub.alias("productSubGroupDescription"))
    return curation.products_of(products, table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("obs_id")))


@query("""
    WITH p AS (SELECT p_partkey, 'j' || p_partkey AS obs_id, CASE WHEN p_size % 2 = 0 THEN 'FLC' ELSE 'DRC' END AS sub, CASE WHEN p_size % 5 = 0 THEN 'x_' ELSE 'hst_' END || p_partkey AS name FROM part)
    SELECT p_partkey FROM p WHERE starts_with(name, 'hst_') AND (sub = 'FLC' AND starts_with(obs_id, 'j1') OR sub = 'DRC' AND obs_id = 'j1')""")
def products_of_visit(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    products = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("j"), key).alias("obs_id"), F.when(F.col("p_size") % 2 == 0, "FLC").otherwise("DRC").alias("productSubGroupDescription"), F.concat(F.when(F.col("p_size") % 5 == 0, "x_").otherwise("hst_"), key).alias("productFilename"))
    return curation.select_products(products, "j1").select("p_partkey")


@query("""
    WITH f AS (SELECT l_orderkey AS target, CASE WHEN l_linenumber = 1 THEN 'a_drc.fits' WHEN l_linenumber = 2 THEN 'b_clean_flc.fits' ELSE 'c' || l_orderkey || '_flc.fits' END AS name FROM lineitem)
    SELECT target, count(*) FILTER (ends_with(name, '_flc.fits') AND NOT regexp_matches(name, '_(clean|destriped|denoised)')) AS n_single, count(*) FILTER (ends_with(name, '_drc.fits')) AS n_combined,
           CASE WHEN n_single = 2 AND n_combined >= 1 THEN 'ready' ELSE 'SKIP' END AS status FROM f GROUP BY 1""")
def ready_targets(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 1, "a_drc.fits").when(F.col("l_linenumber") == 2, "b_clean_flc.fits").otherwise(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("_flc.fits")))
    listing = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), name.alias("name"))
    return curation.ready_targets(listing)


@query("""
    WITH n AS (SELECT o_custkey, count(*) * (count(*) - 1) // 2 AS n_pairs FROM orders GROUP BY 1),
         f AS (SELECT o_orderkey AS file, n_pairs, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders JOIN n USING (o_custkey) WHERE o_orderstatus <> 'F'),
         s AS (SELECT *, sum(size) OVER (ORDER BY n_pairs DESC, file) AS running FROM f)
    SELECT file, n_pairs, size, CAST(running AS BIGINT) AS running FROM s WHERE running <= 20000000""")
def download_plan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("size", F.round("o_totalprice").cast("long"))
    groups = orders.groupBy("o_custkey").agg(E.pairs_of(F.count(F.lit(1))).alias("n_pairs"))
    files = orders.join(groups, "o_custkey").select(F.col("o_orderkey").alias("file"), "n_pairs", "size")
    return curation.download_plan(files, 20_000_000, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file")))


@query("""
    WITH o AS (SELECT 'g' || o_custkey AS galaxy, o_orderpriority AS filter, CAST(o_custkey % 2 AS INTEGER) + 1 AS chip, 'f' || o_orderkey AS file, o_orderstatus AS st FROM orders),
         new AS (SELECT galaxy, filter, chip, list(file) AS files FROM o WHERE st <> 'P' GROUP BY 1, 2, 3), base AS (SELECT galaxy, filter, chip, list(file) AS files FROM o WHERE st = 'P' GROUP BY 1, 2, 3),
         judged AS (SELECT *, NOT ends_with(galaxy, '7') AND len(files) >= 2 AS keep, CASE WHEN ends_with(galaxy, '7') THEN 'gradient of the field' ELSE 'too few' END AS reason FROM new),
         kept AS (SELECT unnest(files) AS file FROM judged WHERE keep UNION SELECT unnest(files) FROM base),
         lost AS (SELECT unnest(files) AS file, CASE WHEN contains(reason, 'gradient') THEN 'gradient_wcs' ELSE 'groupe_trop_petit' END AS slug FROM judged WHERE NOT keep)
    SELECT 'catalog' AS part, file, '' AS note FROM kept UNION ALL SELECT 'excluded', file, slug FROM lost WHERE file NOT IN (SELECT file FROM kept)
    UNION ALL SELECT 'missing', file, '' FROM kept WHERE file NOT IN (SELECT 'f' || l_orderkey FROM lineitem WHERE l_linenumber = 4) UNION ALL SELECT 'offsets', 'f' || l_orderkey, '' FROM lineitem WHERE l_linenumber = 3 AND 'f' || l_orderkey IN (SELECT file FROM kept)""")
def merged_catalog(spark, sf_dir):
    cust = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("g"), cust.cast("string")).alias("galaxy"), F.col("o_orderpriority").alias("filter"), (cust % 2 + 1).cast("int").alias("chip"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"), "o_orderstatus")
    groups = lambda which: rows.where(which).groupBy("galaxy", "filter", "chip").agg(F.collect_list("file").alias("files"))
    new = groups(F.col("o_orderstatus") != "P")
    label = N.group_label(F.col("galaxy"), F.col("filter"), F.col("chip"))
    verdicts = new.select(label.alias("label"), (~F.col("galaxy").endswith("7") & (F.size("files") >= 2)).alias("keep"), F.when(F.col("galaxy").endswith("7"), "gradient of the field").otherwise("too few").alias("reason"))
    lines = lambda n: table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("file"))
    out = curation.merge(groups(F.col("o_orderstatus") == "P"), new, verdicts, lines(4), lines(3))
    told = lambda name, df, note=None: df.select(F.lit(name).alias("part"), "file", (note if note is not None else F.lit("")).alias("note"))
    catalog = told("catalog", out["catalog"].select(F.explode("files").alias("file")).distinct())
    return catalog.unionByName(told("excluded", out["excluded"], F.col("reason"))).unionByName(told("missing", out["missing"])).unionByName(told("offsets", out["offsets"]))


@query(f"""
    WITH {PATHS} SELECT path AS file, CASE WHEN p_size % 4 = 0 THEN '/split/' || p_partkey || '_1.fits' ELSE replace(path, '_flc.fits', '_flc_chip1.fits') END AS chip1,
           CASE WHEN p_size % 4 = 0 THEN '/split/' || p_partkey || '_2.fits' ELSE replace(path, '_flc.fits', '_flc_chip2.fits') END AS chip2 FROM paths""")
def split_paths(spark, sf_dir):
    files = _paths(spark, sf_dir).withColumnRenamed("path", "file")
    place = lambda k: F.concat(F.lit("/split/"), F.col("p_partkey").cast("string"), F.lit(f"_{k}.fits")).alias(f"chip{k}")
    return catalogs.split_paths(files, files.where("p_size % 4 = 0").select("file", place(1), place(2)))


@query("""
    SELECT doc_id, CAST(quality AS DOUBLE) AS value FROM labels WHERE quality IS NOT NULL UNION ALL
    SELECT doc_id, CAST(n_chars AS DOUBLE) FROM documents WHERE n_chars % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)""")
def cache_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("value"))
    read = lambda missing: docs.join(missing, "doc_id", "left_semi").select("doc_id", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars").cast("double")).alias("value"))
    return catalogs.probe(docs, cache, ["doc_id"], read)


@query("""
    WITH g AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS v FROM customer)
    SELECT a.g AS galaxy, a.id AS file, b.n AS n_base FROM g a JOIN (SELECT g, count(*) AS n FROM g WHERE v > 0 GROUP BY 1) b ON a.g || '/F606W/chip1' = b.g || '/F606W/chip1' WHERE a.v <= 0""")
def label_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("label", N.group_label(F.col("c_nationkey").cast("string"), F.lit("F606W"), F.lit(1)))
    base = rows.where("c_acctbal > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n_base"))
    return rows.where("c_acctbal <= 0").join(base, "label").select(F.col("c_nationkey").alias("galaxy"), F.col("c_custkey").alias("file"), "n_base")


# ------------------------------------------------------------------ files


@query("""
    SELECT o_orderpriority AS galaxy, o_orderstatus AS filter, CAST(count(*) AS INTEGER) AS n_exposures, array_to_string(list_sort(list(DISTINCT CAST(o_custkey % 5 AS VARCHAR))), ',') AS proposals FROM orders GROUP BY 1, 2""")
def catalog_round_trip(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("galaxy"), F.col("o_orderstatus").alias("filter")).agg(F.count(F.lit(1)).cast("int").alias("n_exposures"), F.array_sort(F.collect_set((F.col("o_custkey") % 5).cast("string"))).alias("proposals"))
    with Scratch(spark) as scratch:
        catalogs.write_catalog(groups, f"{scratch.folder}/catalog.json")
        read = catalogs.read_catalog(spark, f"{scratch.folder}/catalog.json")
        return checkpoint(read.select("galaxy", "filter", "n_exposures", F.array_join("proposals", ",").alias("proposals")))


@query("SELECT n_name AS file, n_regionkey / 4.0 AS off_x, n_nationkey / 8.0 AS off_y FROM nation")
def offsets_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name", F.array(F.col("n_regionkey") / 4.0, F.col("n_nationkey") / 8.0).alias("v"))
    text = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "v")))).alias("value"))  # one small file by its format
    with Scratch(spark) as scratch:
        text.write.text(f"{scratch.folder}/offsets.json")
        return checkpoint(catalogs.read_offsets(spark, f"{scratch.folder}/offsets.json"))


@query("SELECT c_custkey AS file, CAST(c_nationkey % 2 + 1 AS INTEGER) AS chip, 'chip=' || (c_nationkey % 2 + 1) AS folder FROM customer")
def per_chip_files(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") % 2 + 1).cast("int").alias("chip"))
    with Scratch(spark) as scratch:
        catalogs.write_per_chip(rows, f"{scratch.folder}/chips")
        return checkpoint(spark.read.parquet(f"{scratch.folder}/chips").select("file", "chip", F.regexp_extract(F.input_file_name(), "/(chip=[0-9]+)/", 1).alias("folder")))


@query("""
    SELECT c_custkey AS file, CASE WHEN c_acctbal < 0 THEN 'gradient_wcs' ELSE 'groupe_trop_petit' END AS reason FROM customer WHERE c_acctbal < 2000""")
def quarantined(spark, sf_dir):
    rejects = table(spark, sf_dir, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("file"), N.reject_slug(F.when(F.col("c_acctbal") < 0, "gradient").otherwise("small")).alias("reason"))
    with Scratch(spark) as scratch:
        path = f"{scratch.folder}/_excluded"
        catalogs.quarantine(rejects.where("file % 2 = 0"), path)
        catalogs.quarantine(rejects.where("file % 2 <> 0"), path)  # nothing that lies there goes
        return checkpoint(spark.read.parquet(path).select("file", F.col("reason").cast("string").alias("reason")))


def _fits(spark, sf_dir):
    """Each embedding as a FITS file whose header has the embedding's keys."""
    chip = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/d/g/f606w/j"), F.col("vec_id").cast("string"), F.lit("q_flc.fits")).alias("path"), F.col("vec_id").cast("string").alias("target"), F.col("label").cast("double").alias("exptime"), "embedding")
    cards = {"ROOTNAME": "target", "TARGNAME": "target", "EXPTIME": "exptime"}
    fixed = {"PROPOSID": 10, "FILTER1": "F606W", "FILTER2": "CLEAR2L", "RA_TARG": 12.5, "DEC_TARG": -3.25, "DATE-OBS": "2004-01-02", "CD1_1": 1.0, "CD1_2": 1.0, "D2IMFILE": "x.fits"}
    return fits.encode_images(chip, "path", "embedding", 8, cards, fixed)


@query(f"WITH {PX} SELECT '/d/g/f606w/j' || vec_id || 'q_flc.fits' AS path, 1 AS hdu, y, x, v FROM px")
def fits_pixels(spark, sf_dir):
    return fits.image_pixels(fits.image_rows(_fits(spark, sf_dir)))


@query("""
    SELECT '/d/g/f606w/j' || vec_id || 'q_flc.fits' AS file, lower(left('j' || vec_id || 'q', 8)) AS root, CAST(vec_id AS VARCHAR) AS rootname, 10 AS proposid, 'F606W' AS filter, CAST(label AS DOUBLE) AS exptime, 0.0 AS postarg1, 45.0 AS cd_angle, 8 AS naxis1, 8 AS naxis2 FROM embeddings""")
def fits_headers(spark, sf_dir):
    files = _fits(spark, sf_dir).withColumn("length", F.octet_length("content"))
    head = files.select("path", "length").join(fits.headers(files), "path")
    typed = fits.typed(head.withColumn("header", fits.clean_wcs(F.col("header"))))
    return typed.select("file", "root", "rootname", "proposid", "filter", "exptime", "postarg1", r("cd_angle").alias("cd_angle"), "naxis1", "naxis2")


@query(f"""
    WITH {PX}, n AS (SELECT vec_id, label, count(*) AS n_pix, count(*) FILTER (v < -0.3) AS n_missing FROM px WHERE NOT (vec_id % 7 = 0 AND y = 7) AND vec_id % 11 <> 0 GROUP BY 1, 2)
    SELECT e.vec_id AS file, n_pix, n_missing, array_to_string(list_filter([CASE WHEN n_pix IS NULL THEN 'no image' END, CASE WHEN e.vec_id % 7 = 0 AND n_pix IS NOT NULL THEN 'shape' END, CASE WHEN n_missing > 0 THEN 'missing values' END, CASE WHEN e.label = 0 THEN 'exptime' END,
           CASE WHEN e.vec_id % 5 = 0 THEN 'missing CD1_1' END], lambda s: s IS NOT NULL), ',') AS problems FROM embeddings e LEFT JOIN n USING (vec_id)""")
def integrity(spark, sf_dir):
    keys = table(spark, sf_dir, "embeddings")
    header = F.when(F.col("vec_id") % 5 == 0, F.create_map(F.lit("A"), F.lit("1"))).otherwise(F.create_map(F.lit("CD1_1"), F.lit("1")))
    files = keys.select(F.col("vec_id").alias("file"), F.col("label").cast("double").alias("exptime"), header.alias("header"))
    px = chips(spark, sf_dir).where("NOT (vec_id % 7 = 0 AND y = 7) AND vec_id % 11 <> 0").select(F.col("vec_id").alias("file"), "y", "x", F.when(~(F.col("v") < -0.3), F.col("v")).alias("v"))
    return qc.integrity(files, px, 8, 8, ["CD1_1"]).withColumn("problems", F.array_join("problems", ","))


# ------------------------------------------------------------------ statistics and reports


@query("""SELECT l_suppkey, l_linenumber, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(l_extendedprice), 4) END AS med FROM lineitem GROUP BY 1, 2""")
def grouped_median(spark, sf_dir):
    return S.grouped_median(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], "l_extendedprice", 5).select("l_suppkey", "l_linenumber", "n", r("med", 4).alias("med"))


def _clip_all_sql(source: str, key: str, value: str, k: float, rounds: int, floor: float = 0.0, least: int = 0) -> str:
    """Figures of values within k sigma of the last round's figures; all values are tested anew in each round."""
    steps = [f"r0 AS (SELECT {key} AS g, CAST({value} AS DOUBLE) AS v, true AS live FROM {source})"]
    for i in range(rounds + 1):
        steps += [f"m{i} AS (SELECT g, median(v) AS m, count(*) AS c FROM r{i} WHERE live GROUP BY g)", f"s{i} AS (SELECT r{i}.g, any_value(m) AS m, any_value(c) AS c, 1.4826 * median(abs(v - m)) AS s FROM r{i} JOIN m{i} ON r{i}.g IS NOT DISTINCT FROM m{i}.g WHERE live GROUP BY r{i}.g)"]
        if i < rounds:
            steps.append(f"r{i + 1} AS (SELECT r{i}.g, v, CASE WHEN s = 0 OR c < {least} THEN live ELSE abs(v - m) < {k} * (s + {floor}) END AS live FROM r{i} JOIN s{i} ON r{i}.g IS NOT DISTINCT FROM s{i}.g)")
    return "WITH " + ", ".join(steps)


@query(_clip_all_sql("lineitem", "l_suppkey", "l_extendedprice", 1.2, 4) + " SELECT g AS l_suppkey, c AS n_used, round(m, 4) AS med, round(s, 4) AS sigma FROM s4")
def clip_from_original(spark, sf_dir):
    got = S.clipped_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", k=1.2, rounds=4, narrowing=False)
    return got.select("l_suppkey", "n_used", r("med", 4).alias("med"), r("sigma", 4).alias("sigma"))


@query("""
    WITH p AS (SELECT o_custkey, o_orderpriority AS a, round(sum(o_totalprice), 2) AS pw FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, median(pw) AS m FROM p GROUP BY 1), s AS (SELECT o_custkey, any_value(m) AS m, 1.4826 * median(abs(pw - m)) AS s FROM p JOIN m USING (o_custkey) GROUP BY 1)
    SELECT o_custkey, arg_max(a, pw) AS best, round((max(pw) - any_value(m)) / greatest(any_value(s), 1e-12), 3) AS significance FROM p JOIN s USING (o_custkey) GROUP BY 1""")
def scan_significance(spark, sf_dir):
    power = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(r(F.sum("o_totalprice"), 2).alias("power"))
    return S.scan_significance(power, ["o_custkey"], "o_orderpriority", "power").select("o_custkey", "best", r("significance", 3).alias("significance"))


@query("""
    WITH d AS (SELECT c_nationkey AS g, c_custkey AS f, c_acctbal AS x, c_custkey % 97 AS y FROM customer), p AS (SELECT a.g, a.f AS fa, b.f AS fb, (b.x - a.x) + (b.f % 3) AS dx, CAST((b.y - a.y) + (a.f % 2) AS DOUBLE) AS dy FROM d a JOIN d b ON b.f = a.f + 25 AND a.g = b.g OR b.f = a.f + 50 AND a.g = b.g),
         k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(fa || '|' || fb), fa, fb) AS k FROM p),
         c AS (SELECT k.g, sqrt(pow(dx - (b.x - a.x), 2) + pow(dy - (b.y - a.y), 2)) AS gap FROM k JOIN d a ON a.f = fa AND a.g = k.g JOIN d b ON b.f = fb AND b.g = k.g WHERE k <= 4)
    SELECT g AS "group", round(median(gap), 6) AS med, round(quantile_cont(gap, 0.9), 6) AS p90, round(max(gap), 6) AS most FROM c GROUP BY 1""")
def closure(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("off_x"), (F.col("c_custkey") % 97).alias("off_y"))
    a = stored.select("group", F.col("file").alias("file_a"), F.col("off_x").alias("xa"), F.col("off_y").alias("ya"))
    b = stored.select("group", F.col("file").alias("file_b"), F.col("off_x").alias("xb"), F.col("off_y").alias("yb")).withColumn("file_a", F.explode(F.array(F.col("file_b") - 25, F.col("file_b") - 50)))
    direct = a.join(b, ["group", "file_a"]).select("group", "file_a", "file_b", (F.col("xb") - F.col("xa") + F.col("file_b") % 3).alias("dx"), (F.col("yb") - F.col("ya") + F.col("file_a") % 2).cast("double").alias("dy"))
    return qc.closure(direct, stored).select("group", *[r(c).alias(c) for c in ("med", "p90", "most")])


@query("""
    WITH d AS (SELECT o_custkey AS g, o_orderkey AS f, o_totalprice AS v FROM orders), m AS (SELECT g, median(v) AS m FROM d GROUP BY 1)
    SELECT g AS "group", f AS file FROM (SELECT d.g, f, row_number() OVER (PARTITION BY d.g ORDER BY round(abs(v - m), 6), f) AS k FROM d JOIN m ON m.g = d.g) WHERE k = 1""")
def reference_exposure(spark, sf_dir):
    ex = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("cd_angle"))
    return qc.reference_exposure(ex).select("group", "file")


@query(_clip_all_sql("(SELECT c_nationkey || '/' || c_custkey % 2 AS g, c_acctbal AS v FROM customer)", "g", "v", 1.0, 4, 1e-6, 5) + ", t AS (SELECT * FROM s4) SELECT split_part(g, '/', 1) AS \"group\", split_part(g, '/', 2) AS file, c AS n_dx, round(m, 4) AS off_x, round(s, 4) AS scat_x, round(2 * m, 4) AS off_y FROM t")
def exposure_offsets(spark, sf_dir):
    matches = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("group"), (F.col("c_custkey") % 2).cast("string").alias("file"), F.col("c_acctbal").alias("dx"), (2 * F.col("c_acctbal")).alias("dy"))
    got = qc.offsets(matches, k=1.0, rounds=4)
    return got.select("group", "file", "n_dx", r("off_x", 4).alias("off_x"), r("scat_x", 4).alias("scat_x"), r("off_y", 4).alias("off_y"))


@query("""
    WITH e AS (SELECT o_custkey AS g, o_orderstatus AS f, CAST(o_custkey % 2 AS INTEGER) AS c, CAST(o_orderkey // 8 AS VARCHAR) AS r FROM orders)
    SELECT f AS filter, c AS chip, r AS root, count(*) AS n, array_to_string(list_sort(list(DISTINCT g)), ',') AS groups FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def shared_exposures(spark, sf_dir):
    ex = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderstatus").alias("filter"), (F.col("o_custkey") % 2).cast("int").alias("chip"), F.floor(F.col("o_orderkey") / 8).cast("string").alias("root"))
    return qc.shared_exposures(ex).withColumn("groups", F.array_join(F.transform("groups", lambda g: g.cast("string")), ","))


@query("""
    WITH e AS (SELECT event_type AS run, CAST(user_id % 20 AS INTEGER) AS epoch, value AS loss, user_id % 5 + 1 AS n FROM events), l AS (SELECT run, epoch, sum(loss * n) / greatest(sum(n), 1) AS loss FROM e GROUP BY 1, 2)
    SELECT run, arg_min(epoch, loss) AS epoch, round(min(loss), 6) AS loss, CASE WHEN min(loss) = 0 THEN 'Infinity'::DOUBLE ELSE round(10 * log10(1 / min(loss)), 6) END AS psnr FROM l GROUP BY 1""")
def best_epoch(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 20).cast("int").alias("epoch"), F.col("value").alias("loss"), (F.col("user_id") % 5 + 1).alias("n"))
    return samples.best_epoch(metrics).select("run", "epoch", r("loss").alias("loss"), r("psnr").alias("psnr"))


@query("""
    WITH b AS (SELECT c_nationkey AS g, max(c_custkey % 10) AS y0, max(c_custkey % 7) AS x0, min(c_custkey % 30 + 10) AS y1, min(c_custkey % 50 + 10) AS x1 FROM customer GROUP BY 1)
    SELECT g AS unit, y0, x0, y1, x1 FROM b WHERE y1 > y0 AND x1 > x0""")
def common_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    boxes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), (k % 10).alias("y0"), (k % 7).alias("x0"), (k % 30 + 10).alias("y1"), (k % 50 + 10).alias("x1"))
    return samples.overlap(boxes, ["unit"])


@query("""
    WITH RECURSIVE c AS (SELECT c_nationkey || c_mktsegment AS k, c_custkey AS id, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS pos FROM customer),
         f AS (SELECT k, 1::BIGINT AS pos, [[v]] AS groups, 0::BIGINT AS g FROM c WHERE pos = 1
               UNION ALL SELECT c.k, c.pos, CASE WHEN spot > 0 THEN list_transform(groups, lambda x, i: CASE WHEN i = spot THEN list_append(x, c.v) ELSE x END) ELSE list_append(groups, [c.v]) END, CASE WHEN spot > 0 THEN spot - 1 ELSE len(groups) END
               FROM (SELECT f.k, f.pos, f.groups, coalesce(list_position(list_transform(f.groups, lambda x: list_bool_and(list_transform(x, lambda m: abs(m - n.v) < 1500 AND abs(m - n.v) <= 900))), true), 0) AS spot FROM f JOIN c n ON n.k = f.k AND n.pos = f.pos + 1) s JOIN c ON c.k = s.k AND c.pos = s.pos + 1)
    SELECT c.k AS filter, c.id AS file, CAST(f.g AS INTEGER) AS group_no FROM f JOIN c ON c.k = f.k AND c.pos = f.pos""")
def complete_groups(spark, sf_dir):
    key = F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment")
    rec = table(spark, sf_dir, "customer").select(key.alias("filter"), F.col("c_custkey").alias("file"), F.col("c_custkey").alias("root"), F.lit("d").alias("date_obs"), F.lit(0.0).alias("ra_targ"), (F.col("c_acctbal") / 3600.0).alias("dec_targ"), F.col("c_acctbal").alias("cd_angle"))
    runs = curation.group_complete(rec, tolerance=1500.0, roll=900.0)
    order = F.dense_rank().over(C.Window.partitionBy("filter").orderBy("_first")) - 1
    firsts = runs.groupBy("filter", "run", "group_no").agg(F.min("file").alias("_first"))
    return runs.join(firsts.withColumn("_g", order), ["filter", "run", "group_no"]).select("filter", "file", F.col("_g").cast("int").alias("group_no"))


def _plane_sql(rounds: int, k: float) -> str:
    """CTEs p0.. of least-squares planes, each over the rows within k scatters of the one before."""
    out = ["q0 AS (SELECT l_suppkey AS g, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT g, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM q{i} GROUP BY 1)")
        out.append(f"""b{i} AS (SELECT g, any_value(mx) AS mx, any_value(my) AS my, any_value(mv) AS mv, count(*) AS n, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (v - mv)) AS xv, sum((y - my) * (v - mv)) AS yv, sum((v - mv) * (v - mv)) AS vv FROM q{i} JOIN a{i} USING (g) GROUP BY 1)""")
        out.append(f"c{i} AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS sx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS sy FROM b{i}), p{i} AS (SELECT *, sqrt(greatest(vv - sx * xv - sy * yv, 0) / greatest(n - 3, 1)) AS scatter FROM c{i})")
        if i < rounds:
            out.append(f"q{i + 1} AS (SELECT q{i}.* FROM q{i} JOIN p{i} USING (g) WHERE abs(v - mv - sx * (x - mx) - sy * (y - my)) <= {k} * scatter + 1e-12)")
    return "WITH " + ", ".join(out)


@query(_plane_sql(6, 1.8) + " SELECT g AS l_suppkey, n, round(sx, 4) AS slope_x, round(sy, 2) AS slope_y, round(scatter, 3) AS scatter FROM p6")
def robust_plane(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("dx"))
    return qc.robust_plane(rows, ["l_suppkey"], "dx", k=1.8).select("l_suppkey", "n", r("slope_x", 4).alias("slope_x"), r("slope_y", 2).alias("slope_y"), r("scatter", 3).alias("scatter"))


@query("""
    WITH e AS (SELECT c_nationkey AS g, c_custkey AS f, c_acctbal AS roll FROM customer), m AS (SELECT g, median(roll) AS m FROM e GROUP BY 1)
    SELECT g AS "group", count(*) AS n, count(*) FILTER (abs(roll - m) > 3000) AS n_far, count(*) FILTER (abs(roll - m) > 3000) * 2 > count(*) AS re_anchor FROM e JOIN m USING (g) GROUP BY 1""")
def re_anchor(spark, sf_dir):
    ex = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("cd_angle"))
    return qc.needs_new_anchor(ex, 3000.0)


@query("""
    WITH e AS (SELECT l_orderkey AS g, l_linenumber AS pos, CAST(l_quantity AS DOUBLE) AS x, l_partkey % 17 AS y FROM lineitem), p AS (SELECT a.g, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS gap FROM e a JOIN e b ON a.g = b.g AND a.pos < b.pos)
    SELECT g AS "group", count(*) AS n_pairs, round(avg(CASE WHEN gap > 15 THEN 1.0 ELSE 0.0 END), 6) AS over, avg(CASE WHEN gap > 15 THEN 1.0 ELSE 0.0 END) <= 0.4 AS passes FROM p GROUP BY 1""")
def qc_control(spark, sf_dir):
    off = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("double").alias("off_x"), (F.col("l_partkey") % 17).alias("off_y"))
    return qc.control(off, limit=15.0, share=0.4).withColumn("over", r("over"))


@query("""
    WITH g AS (SELECT o_custkey AS g, count(*) AS n, max(CAST(o_totalprice AS DOUBLE)) AS most, CASE WHEN count(*) > 3 THEN count(*) * (count(*) - 1) // 2 END AS pairs FROM orders GROUP BY 1)
    SELECT g AS "group", rtrim(printf('%-8s', 'g' || g) || '  ' || printf('%5d', n) || '  ' || coalesce(printf('%6d', pairs), '-     ') || '  ' || printf('%12.2f', most)) AS line,
           printf('%d files, about %.1f GB', n, round_even(n * 170e0 / 1024, 1)) AS size FROM g""")
def report_lines(spark, sf_dir):
    """A report of fixed width, a line for each group, and what its files will take."""
    n = F.count(F.lit(1))
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(n.alias("n"), F.max(F.col("o_totalprice").cast("double")).alias("most"))
    told = groups.withColumns({"label": F.concat(F.lit("g"), F.col("group").cast("string")), "pairs": F.when(F.col("n") > 3, E.pairs_of(F.col("n")))})
    return told.select("group", C.fixed_width({"label": "%-8s", "n": "%5d", "pairs": "%6d", "most": "%12.2f"}).alias("line"), N.size_estimate(F.col("n")).alias("size"))


@query("""
    WITH g AS (SELECT o_custkey AS g, count(*) * (count(*) - 1) // 2 AS n_pairs FROM orders GROUP BY 1) SELECT g AS "group", n_pairs, row_number() OVER (ORDER BY n_pairs DESC, g) - 1 AS place FROM g""")
def groups_by_size(spark, sf_dir):
    """Groups in order of their pairs, those of equal size in the order they had."""
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(E.pairs_of(F.count(F.lit(1))).alias("n_pairs"))
    return C.placed(groups.withColumn("_less", -F.col("n_pairs")), ["_less", "group"]).select("group", "n_pairs", "place")
