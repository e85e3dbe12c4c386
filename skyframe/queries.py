"""Registered queries: the operators bound to the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exprs as E
from .functions import names as N
from .operators import catalog as C
from .operators import images as I
from .operators import stats as S
from .plans import curation, production, qc, samples

QUERIES: dict = {}
SQL: dict[str, str] = {}

PX = """px AS MATERIALIZED (SELECT vec_id, label, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
        FROM embeddings, range(1, 65) t(i))"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a chip of 8 by 8 pixels; its label is the field."""
    return I.to_pixels(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], "embedding", 8)


def r(c: Column | str, digits: int = 6) -> Column:
    return E.half_away(F.col(c) if isinstance(c, str) else c, digits)


# ------------------------------------------------------------------ catalog layer


@query("""
    SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_a, b.l_linenumber AS l_linenumber_b, a.l_partkey AS l_partkey_a, b.l_partkey AS l_partkey_b
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pair_catalog(spark, sf_dir):
    return C.pair_join(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_partkey"])


@query("""
    SELECT l_orderkey, count(*) AS n_files, count(*) * (count(*) - 1) // 2 AS n_pairs, min(l_shipdate) AS first_date, max(l_shipdate) AS last_date
    FROM lineitem GROUP BY 1 HAVING count(*) >= 2""")
def pair_counts(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    out = g.agg(F.count(F.lit(1)).alias("n_files"), F.min("l_shipdate").alias("first_date"), F.max("l_shipdate").alias("last_date")).where("n_files >= 2")
    return out.withColumn("n_pairs", E.pairs_of(F.col("n_files")))


@query("""
    SELECT o_custkey, count(*) AS n_exposures, count(*) * (count(*) - 1) // 2 AS n_pairs,
           array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS proposals,
           strftime(min(o_orderdate), '%Y-%m-%d') || ' → ' || strftime(max(o_orderdate), '%Y-%m-%d') AS date_range,
           array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey), ',') AS files,
           arg_min(o_totalprice, strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS ra_targ
    FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def exposure_catalog(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_totalprice")
    out = C.catalog(orders, ["o_custkey"], "o_orderkey", "d", "o_orderpriority", "o_totalprice", "o_totalprice", least=3)
    return out.select("o_custkey", "n_exposures", "n_pairs", F.array_join("proposals", ",").alias("proposals"), "date_range", F.array_join(F.transform("files", lambda f: f.cast("string")), ",").alias("files"), "ra_targ")


@query("""
    SELECT o_custkey, count(*) AS n_obs, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey)[1:6], ',') AS first_ids
    FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def group_min_size(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    first = C.top_per_group(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 6)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s.o_orderkey.cast("string"))
    enough = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_obs")).where("n_obs >= 3")
    return enough.join(first.groupBy("o_custkey").agg(F.array_join(ids, ",").alias("first_ids")), "o_custkey")


@query("""
    SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY source <> 'src0', doc_id) = 1 AS kept FROM documents""")
def dedup_prefer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    best = C.first_by_aggregate(docs, ["h"], F.struct(F.col("source") != "src0", F.col("doc_id")), ["doc_id"]).withColumnRenamed("doc_id", "best")
    return docs.join(best, "h").select("doc_id", (F.col("doc_id") == F.col("best")).alias("kept"))


@query("""
    SELECT l_orderkey, l_linenumber, (abs(l_discount - 0.05) <= 0.03 AND abs(l_tax - 0.04) <= 0.03) AS kept FROM lineitem""")
def box_filter_split(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.in_box(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, 0.03).alias("kept"))


@query("""
    SELECT coalesce(CAST(o_orderpriority AS VARCHAR), 'TOTAL') AS o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done,
           round(median(o_totalprice), 4) AS med_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
    FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def catalog_rollup(spark, sf_dir):
    aggs = {"n": F.count(F.lit(1)), "n_done": F.sum((F.col("o_orderstatus") == "F").cast("int")), "min_price": F.min("o_totalprice"), "max_price": F.max("o_totalprice")}
    orders = table(spark, sf_dir, "orders")
    each = S.selected_percentile(orders, ["o_orderpriority"], F.col("o_totalprice"), 0.5).select(F.col("o_orderpriority").cast("string").alias("o_orderpriority"), "p")
    mid = each.unionByName(S.selected_percentile(orders.withColumn("_g", F.lit("TOTAL")), ["_g"], F.col("o_totalprice"), 0.5).select(F.col("_g").alias("o_orderpriority"), "p"))
    return C.total_line(orders, "o_orderpriority", aggs).join(mid, "o_orderpriority", "left").withColumn("med_price", F.round("p", 4)).drop("p")


@query("""
    SELECT source, md5(text) AS h, count(*) AS n, count(*) - count(DISTINCT doc_id) AS same_id, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("h"), "doc_id")
    return docs.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"), (F.count("doc_id") - F.countDistinct("doc_id")).alias("same_id"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_miss(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def catalogued_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS off_x, coalesce(l.toxic, 0) AS off_y FROM documents d LEFT JOIN labels l USING (doc_id)")
def offset_left_default(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(0)).alias("off_x"), F.coalesce("toxic", F.lit(0)).alias("off_y"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price,
           CASE WHEN o_orderstatus = 'F' THEN 'override' ELSE 'base' END AS origin FROM orders""")
def catalog_union_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("base").alias("origin"))
    over = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("price"), F.lit("override").alias("origin"))
    return C.upsert(base, over, ["o_orderkey"])


@query("""
    WITH e AS (SELECT user_id, event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
                      count(*) OVER (PARTITION BY user_id) AS size FROM events),
         s AS (SELECT a.user_id, b.pos AS e, b.day - a.day AS span FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos = a.pos + 9),
         best AS (SELECT user_id, e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY span, e) AS k FROM s) WHERE k = 1)
    SELECT e.user_id, e.event_id, CAST(e.day AS INTEGER) AS day FROM e LEFT JOIN best USING (user_id) WHERE e.size <= 10 OR e.pos BETWEEN best.e - 9 AND best.e""")
def tightest_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_date(F.col("ts").cast("date")).alias("day"))
    return C.tightest_window(events, ["user_id"], ["ts", "event_id"], "day", 10).select("user_id", "event_id", "day")


@query("""
    SELECT o_orderkey, round(running, 2) AS running FROM (
        SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey) / 100.0 AS running FROM orders) WHERE running <= 50000000""")
def budget_prefix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return C.budget_prefix(orders, ["o_orderdate", "o_orderkey"], "cents", 5_000_000_000).select("o_orderkey", F.round(F.col("running") / 100.0, 2).alias("running"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS pos FROM (SELECT DISTINCT user_id, value FROM events)),
         f AS (SELECT user_id, value, pos, value AS anchor, 1 AS cluster FROM e WHERE pos = 1
               UNION ALL SELECT e.user_id, e.value, e.pos, CASE WHEN e.value - f.anchor > 5.0 THEN e.value ELSE f.anchor END, f.cluster + CASE WHEN e.value - f.anchor > 5.0 THEN 1 ELSE 0 END
               FROM f JOIN e ON e.user_id = f.user_id AND e.pos = f.pos + 1)
    SELECT v.user_id, v.event_id, v.value, f.anchor, CAST(f.cluster AS INTEGER) AS cluster FROM events v JOIN f ON v.user_id = f.user_id AND v.value = f.value""")
def roll_clusters(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return C.anchor_clusters(events, ["user_id"], "value", 5.0, "event_id").select("user_id", "event_id", "value", "anchor", "cluster")


@query("""
    SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, round(abs(a.p_retailprice - b.p_retailprice), 6) AS gap
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) < 10 AND a.p_partkey < b.p_partkey""")
def band_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left = part.select("p_brand", F.col("p_partkey").alias("a_key"), F.col("p_retailprice").alias("pa"))
    right = part.select("p_brand", F.col("p_partkey").alias("b_key"), F.col("p_retailprice").alias("pb"))
    gap = r(F.abs(F.col("pa") - F.col("pb")))
    return C.band_join(left, right, ["p_brand"], "pa", "pb", 10, F.col("a_key") < F.col("b_key"), {"gap": gap}).select("a_key", "b_key", "gap")


@query("""
    WITH RECURSIVE c AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
         f AS (SELECT k, 1::BIGINT AS pos, [{'i': id, 'v': v}] AS anchors FROM c WHERE pos = 1
               UNION ALL SELECT c.k, c.pos, CASE WHEN len(list_filter(f.anchors, lambda a: abs(a.v - c.v) < 500)) > 0 THEN f.anchors ELSE list_append(f.anchors, {'i': c.id, 'v': c.v}) END
               FROM f JOIN c ON c.k = f.k AND c.pos = f.pos + 1),
         final AS (SELECT k, unnest(anchors) AS a FROM (SELECT k, arg_max(anchors, pos) AS anchors FROM f GROUP BY k))
    SELECT c.k AS c_nationkey, c.id AS c_custkey, min(final.a.i) AS anchor_id FROM c JOIN final ON c.k = final.k AND abs(final.a.v - c.v) < 500 AND final.a.i <= c.id GROUP BY 1, 2""")
def pointing_groups(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return C.anchor_groups(customer, ["c_nationkey"], "c_custkey", "c_acctbal", 500.0)


@query("""
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 3""")
def seeded_sample(spark, sf_dir):
    return C.sample_per_group(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 3).select("user_id", "event_id", "value")


@query("""
    SELECT c.conv_id, CASE WHEN CAST(('0x' || left(md5(CAST(c.conv_id AS VARCHAR)), 8)) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'valid' END AS split, CAST(s AS INTEGER) AS sample
    FROM (SELECT DISTINCT conv_id FROM conversations) c, range(0, 3) t(s)""")
def split_slots(spark, sf_dir):
    return C.split_slots(table(spark, sf_dir, "conversations"), "conv_id", 0.8, 3)


@query("""
    WITH m AS (SELECT l_partkey, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1)
    SELECT l_partkey, id AS line_id, l_extendedprice FROM (
        SELECT l.l_partkey, l.l_orderkey * 10 + l.l_linenumber AS id, l.l_extendedprice, row_number() OVER (PARTITION BY l.l_partkey ORDER BY round(abs(l.l_extendedprice - m.mid), 6), l.l_orderkey * 10 + l.l_linenumber) AS k
        FROM lineitem l JOIN m USING (l_partkey)) WHERE k = 1""")
def nearest_to_median(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_extendedprice")
    return C.nearest_to_median(lines, ["l_partkey"], "l_extendedprice", "line_id")


@query("""
    SELECT o_orderpriority, o_orderkey, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 40""")
def brightest(spark, sf_dir):
    return C.top_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 40).select("o_orderpriority", "o_orderkey", "rank")


@query("""
    WITH n AS (SELECT event_type, count(*) FILTER (value > 400) AS a, count(*) FILTER (value > 250) AS b, count(*) FILTER (value > 150) AS c FROM events GROUP BY 1),
         t AS (SELECT event_type, CASE WHEN a >= 40 THEN 400.0 WHEN b >= 40 THEN 250.0 WHEN c >= 40 THEN 150.0 ELSE 100.0 END AS threshold FROM n)
    SELECT e.event_id, CAST(t.threshold AS DOUBLE) AS threshold FROM events e JOIN t USING (event_type) WHERE e.value > t.threshold""")
def threshold_cascade(spark, sf_dir):
    return C.first_enough(table(spark, sf_dir, "events"), ["event_type"], "value", [400.0, 250.0, 150.0, 100.0], 40).select("event_id", "threshold")


@query("""
    WITH f AS (SELECT c_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS turn FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O')),
         b AS (SELECT c_custkey, min(turn) AS best FROM f GROUP BY 1)
    SELECT f.c_custkey, f.o_orderkey, f.o_orderstatus FROM f JOIN b USING (c_custkey) WHERE f.turn = b.best""")
def product_fallback(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    orders = orders.join(table(spark, sf_dir, "customer"), "c_custkey", "left_semi")
    return C.fallback(orders, ["c_custkey"], "o_orderstatus", ["F", "O"]).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("""
    SELECT l_suppkey, count(*) AS n_files, bool_and(l_returnflag <> 'R') AS all_kept FROM lineitem GROUP BY 1 HAVING count(*) >= 4""")
def all_predicate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("l_returnflag") != "R").alias("all_kept")).where("n_files >= 4")


@query("""
    SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) = 1) u USING (o_custkey) WHERE o.o_orderpriority = '1-URGENT'""")
def unique_match(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return C.having(urgent, ["o_custkey"], 1, 1).select("o_orderkey", "o_custkey")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber AS pos, l_quantity AS q FROM lineitem)
    SELECT a.l_orderkey, a.pos AS i, b.pos AS j, c.pos AS k FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos JOIN l c ON b.l_orderkey = c.l_orderkey AND b.pos < c.pos
    WHERE abs((b.q - a.q) / 7.0 - round_even((b.q - a.q) / 7.0, 0)) < 0.15 AND abs((c.q - a.q) / 7.0 - round_even((c.q - a.q) / 7.0, 0)) < 0.15""")
def near_integer_triples(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("q"))
    two = C.pair_join(lines, ["l_orderkey"], "pos", ["q"]).where(E.near_integer((F.col("q_b") - F.col("q_a")) / 7.0, 0.15))
    three = two.join(lines.select("l_orderkey", F.col("pos").alias("k"), F.col("q").alias("q_c")), "l_orderkey").where("pos_b < k")
    return three.where(E.near_integer((F.col("q_c") - F.col("q_a")) / 7.0, 0.15)).select("l_orderkey", F.col("pos_a").alias("i"), F.col("pos_b").alias("j"), "k")


# ------------------------------------------------------------------ names, headers, flags


@query(r"""
    SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN regexp_matches(url, '://[^/]*/(\w+)/(\d+)') THEN regexp_extract(url, '://[^/]*/(\w+)/(\d+)', 1) || '_' || regexp_extract(url, '://[^/]*/(\w+)/(\d+)', 2) ELSE '?' END AS visit,
           length(html) AS n_html FROM pages""")
def visit_regex(spark, sf_dir):
    url = F.col("url")
    visit = N.visit(url, joined=True, pattern=r"://[^/]*/(\w+)/(\d+)")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"://([^/?#]*)", 1).alias("host"), visit.alias("visit"), F.length("html").cast("long").alias("n_html"))


@query("""
    SELECT p_partkey, lower(left(CASE WHEN p_name LIKE 'hst_%' THEN list_last(string_split(p_name, '_')) ELSE p_name END, 8)) AS root,
           p_brand || '/' || p_type || '/chip' || CAST(p_size AS VARCHAR) AS label,
           CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' ELSE 'groupe_trop_petit' END AS slug FROM part""")
def name_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", N.root8(F.col("p_name")).alias("root"), N.group_label(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("label"), N.reject_slug(F.col("p_type"), (("STEEL", "steel"), ("BRASS", "brass"))).alias("slug"))


@query("""
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS INTEGER) AS k_int, coalesce(json_extract_string(props, '$.missing'), 'UNKNOWN') AS filter
    FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""")
def header_parse(spark, sf_dir):
    cards = F.from_json("props", "map<string,string>")
    typed = table(spark, sf_dir, "events").withColumn("_c", cards).select("event_id", F.expr("try_cast(_c['k'] AS double)").alias("k"), F.coalesce(F.col("_c")["missing"], F.lit("UNKNOWN")).alias("filter"))
    return typed.where("k IS NOT NULL").withColumn("k_int", F.col("k").cast("int"))


@query("SELECT l_orderkey, l_linenumber, (CAST(l_partkey AS INTEGER) & ~2384) <> 0 AS bad FROM lineitem")
def dq_bitmask(spark, sf_dir):
    good = 16 | 64 | 256 | 2048
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.bad_quality(F.col("l_partkey").cast("int"), good).alias("bad"))


@query("""
    SELECT event_id, round(value / CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE CAST(user_id % 7 AS DOUBLE) END, 6) AS rate, round_even(value / 3.0, 0) AS snapped, CAST(date_diff('day', DATE '0001-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS ordinal,
           greatest(least(value, 250.0), -250.0) AS clipped, round(degrees(atan2(value, user_id)), 6) AS roll, round(0.75 * value + 0.25 * user_id, 6) AS blended FROM events""")
def scalar_expressions(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", r(E.rate(v, F.col("user_id") % 7)).alias("rate"), E.half_even(v / 3.0).alias("snapped"), E.ordinal_day(F.col("ts")).alias("ordinal"),
        E.clip(v, 250.0).alias("clipped"), r(E.roll_angle(u, v)).alias("roll"), r(E.blend(v, u, 0.75)).alias("blended"),
    )


# ------------------------------------------------------------------ statistics


@query("""
    WITH m AS (SELECT event_type, median(value) AS med, count(value) AS n FROM events GROUP BY 1)
    SELECT event_type, any_value(n) AS n, round(any_value(med), 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS sigma FROM events JOIN m USING (event_type) GROUP BY 1""")
def mad_sigma(spark, sf_dir):
    return S.mad_sigma(table(spark, sf_dir, "events"), ["event_type"], "value", few_groups=True).select("event_type", "n", r("med").alias("med"), r("sigma").alias("sigma"))


def _clip_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT l_returnflag AS f, CAST(l_extendedprice AS DOUBLE) AS v, true AS live FROM lineitem)"]
    for k in range(rounds):
        steps.append(f"m{k} AS (SELECT f, median(v) AS m FROM r{k} WHERE live GROUP BY f)")
        steps.append(f"s{k} AS (SELECT r{k}.f, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM r{k} JOIN m{k} ON r{k}.f = m{k}.f WHERE live GROUP BY r{k}.f)")
        steps.append(f"r{k + 1} AS (SELECT r{k}.f, v, CASE WHEN s = 0 THEN live ELSE live AND abs(v - m) < 1.5 * s END AS live FROM r{k} JOIN s{k} ON r{k}.f = s{k}.f)")
    return f"""WITH {", ".join(steps)}, z AS (SELECT f, median(v) AS m, count(*) AS n FROM r{rounds} WHERE live GROUP BY f)
    SELECT r{rounds}.f AS l_returnflag, any_value(n) AS n_used, round(any_value(m), 6) AS med, round(1.4826 * median(abs(v - m)), 6) AS sigma FROM r{rounds} JOIN z ON r{rounds}.f = z.f WHERE live GROUP BY 1"""


@query(_clip_sql(5))
def sigma_clip(spark, sf_dir):
    return S.clipped_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", k=1.5, rounds=5, few_groups=True).select("l_returnflag", "n_used", r("med").alias("med"), r("sigma").alias("sigma"))


@query("""
    WITH s AS (SELECT event_type, quantile_cont(value, 0.99) - quantile_cont(value, 0.01) + 1e-8 AS scale FROM events GROUP BY 1)
    SELECT event_id, round(asinh(value / scale), 6) AS stretched FROM events JOIN s USING (event_type)""")
def percentile_scale_asinh(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    scale = S.joint_scale(events, ["event_type"], "value")
    return events.join(scale, "event_type").select("event_id", r(E.asinh_stretch(F.col("value"), F.col("scale"))).alias("stretched"))


@query("""
    SELECT l_shipdate < TIMESTAMP '1995-01-01' AS early, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.995), 4) AS p99_5 FROM lineitem GROUP BY 1""")
def percentile_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("early", F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    got = S.percentiles(lines, ["early"], "l_extendedprice", [0.1, 0.5, 0.995])
    return got.select("early", *[r(c, 4).alias(c) for c in ("p10", "p50", "p99_5")])


@query("""
    WITH t AS (SELECT l_returnflag, CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 10 THEN 1 WHEN l_quantity >= 3 THEN 0 END AS tier, l_extendedprice AS p FROM lineitem)
    SELECT l_returnflag, tier, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(p), 4) END AS med FROM t WHERE tier IS NOT NULL GROUP BY 1, 2""")
def tier_census(spark, sf_dir):
    got = S.tier_census(table(spark, sf_dir, "lineitem"), ["l_returnflag"], E.tier(F.col("l_quantity"), [3, 10, 25, 40]), "l_extendedprice")
    return got.select("l_returnflag", "tier", "n", r("med", 4).alias("med"))


@query("""
    SELECT l_linestatus, count(*) FILTER (q <= 0.1) AS bin0, count(*) FILTER (q > 0.1 AND q <= 0.3) AS bin1, count(*) FILTER (q > 0.3 AND q <= 0.5) AS bin2, count(*) FILTER (q > 0.5 AND q <= 1) AS bin3, count(*) FILTER (q > 1) AS bin4, count(*) AS n
    FROM (SELECT l_linestatus, l_quantity / 45.0 AS q FROM lineitem) GROUP BY 1""")
def misalign_hist(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "lineitem"), ["l_linestatus"], E.mixed_edge_bin(F.col("l_quantity") / 45.0), 5)


@query("""
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS corr, count(*) AS n FROM lineitem GROUP BY 1""")
def regression_trend(spark, sf_dir):
    got = S.trend(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return got.select("l_returnflag", r("slope", 4).alias("slope"), r("intercept", 2).alias("intercept"), r("corr").alias("corr"), "n")


@query(f"""
    WITH {PX}, k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
         w AS (SELECT px.label, y, x, max(v) FILTER (k.k = 1) AS a, max(v) FILTER (k.k = 2) AS b, max(v) FILTER (k.k = 3) AS c, max(v) FILTER (k.k = 4) AS d FROM px JOIN k USING (vec_id) WHERE k.k <= 4 GROUP BY 1, 2, 3)
    SELECT label, round(2 * corr(a - c, b - d), 6) AS rho, round(var_pop(a - b), 8) AS var_ab, round(var_pop((a + b) / 2), 8) AS var_mean, count(*) AS n FROM w GROUP BY 1""")
def noise_indep(spark, sf_dir):
    first = C.top_per_group(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], [F.col("vec_id")], 4)
    px = I.to_pixels(first, ["label", "rank"], "embedding", 8)
    wide = px.groupBy("label", "y", "x").agg(*[F.max(F.when(F.col("rank") == k + 1, F.col("v"))).alias(n) for k, n in enumerate("abcd")])
    got = S.noise_independence(wide, ["label"], "a", "b", "c", "d")
    return got.select("label", r("rho").alias("rho"), r("var_ab", 8).alias("var_ab"), r("var_mean", 8).alias("var_mean"), "n")


@query("""
    WITH p AS (SELECT l_returnflag, l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, round(median(m), 4) AS med, count(*) AS parts FROM p GROUP BY 1""")
def nested_median(spark, sf_dir):
    return S.two_stage_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_suppkey"], "l_extendedprice").select("l_returnflag", r("med", 4).alias("med"), "parts")


@query("""
    SELECT event_type, round(sum(value * (user_id % 5)) / greatest(sum(user_id % 5), 1), 6) AS mean, CAST(sum(user_id % 5) AS BIGINT) AS weight FROM events GROUP BY 1""")
def weighted_loss(spark, sf_dir):
    got = S.weighted_mean(table(spark, sf_dir, "events").withColumn("w", F.col("user_id") % 5), ["event_type"], "value", "w")
    return got.select("event_type", r("mean").alias("mean"), "weight")


# ------------------------------------------------------------------ pixels and sources


@query(f"""
    WITH {PX}, m AS (SELECT vec_id, median(v) AS sky FROM px GROUP BY 1)
    SELECT vec_id, round(any_value(sky), 6) AS med, round(1.4826 * median(abs(v - sky)), 6) AS sigma, count(*) AS n FROM px JOIN m USING (vec_id) GROUP BY 1""")
def pixel_stats(spark, sf_dir):
    return S.mad_sigma(chips(spark, sf_dir), ["vec_id"], "v").select("vec_id", r("med").alias("med"), r("sigma").alias("sigma"), "n")


@query(f"""
    WITH {PX}, m AS (SELECT vec_id, median(v) AS med FROM px GROUP BY 1), s AS (SELECT vec_id, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS s FROM px JOIN m USING (vec_id) GROUP BY 1),
         q AS (SELECT vec_id, y, median(v) AS row_med FROM px JOIN s USING (vec_id) WHERE v < med + 3 * s GROUP BY 1, 2)
    SELECT vec_id, round(stddev_pop(row_med), 6) AS stripe, count(*) AS rows FROM q GROUP BY 1""")
def stripe_metric(spark, sf_dir):
    return I.stripe_metric(chips(spark, sf_dir), ["vec_id"]).select("vec_id", r("stripe").alias("stripe"), "rows")


@query(f"""
    WITH {PX}, b AS (SELECT a.vec_id, a.y, a.x, a.v, max(b.v) AS m FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3, 4)
    SELECT vec_id, y, x, round(v, 6) AS v FROM b WHERE v >= m AND v > 0.1 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6""")
def local_maxima(spark, sf_dir):
    return I.local_maxima(chips(spark, sf_dir), ["vec_id"], 2, 1, 8, 8, F.lit(0.1)).select("vec_id", "y", "x", r("v").alias("v"))


PEAKS = """pk AS (SELECT a.vec_id, a.y, a.x, a.v FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5 AND a.v > 0.1 GROUP BY 1, 2, 3, 4 HAVING a.v >= max(b.v))"""


def peaks(px: DataFrame) -> DataFrame:
    return I.local_maxima(px, ["vec_id"], 1, 2, 8, 8, F.lit(0.1))


@query(f"""
    WITH {PX}, {PEAKS}, c AS (SELECT p.vec_id, p.y, p.x, avg(n.v) / greatest(p.v, 1e-6) AS ratio FROM pk p JOIN px n ON p.vec_id = n.vec_id AND abs(p.y - n.y) + abs(p.x - n.x) = 1 GROUP BY p.vec_id, p.y, p.x, p.v),
         o AS (SELECT p.vec_id, p.y, p.x, avg(n.v) / greatest(p.v, 1e-6) AS outer_ratio FROM pk p JOIN px n ON p.vec_id = n.vec_id AND greatest(abs(p.y - n.y), abs(p.x - n.x)) = 2 GROUP BY p.vec_id, p.y, p.x, p.v)
    SELECT vec_id, y, x, round(ratio, 6) AS ratio, round(outer_ratio, 6) AS outer_ratio, ratio > 0.15 AND ratio < 0.95 AS star_like FROM c JOIN o USING (vec_id, y, x)""")
def psf_ring(spark, sf_dir):
    px = chips(spark, sf_dir)
    found = peaks(px)
    inner = I.ring_ratio(found, ["vec_id"], px)
    outer = I.ring_ratio(found, ["vec_id"], px, I.ring(2), "outer_ratio").drop("v")
    return inner.join(outer, ["vec_id", "y", "x"]).select("vec_id", "y", "x", r("ratio").alias("ratio"), r("outer_ratio").alias("outer_ratio"), E.ring_ratio_ok(F.col("ratio")).alias("star_like"))


@query(f"""
    WITH {PX}, {PEAKS}, m AS (SELECT vec_id, median(v) AS sky FROM px GROUP BY 1)
    SELECT p.vec_id, p.y, p.x, round(sum(n.v) - count(*) * any_value(sky), 6) AS flux, count(*) AS n_pix FROM pk p JOIN px n ON p.vec_id = n.vec_id AND abs(p.y - n.y) <= 1 AND abs(p.x - n.x) <= 1 JOIN m ON m.vec_id = p.vec_id GROUP BY 1, 2, 3""")
def aperture_flux(spark, sf_dir):
    px = chips(spark, sf_dir)
    sky = px.groupBy("vec_id").agg(F.median("v").alias("sky"))
    return I.aperture_flux(peaks(px).join(sky, "vec_id"), ["vec_id"], px, 1, "sky").select("vec_id", "y", "x", r("flux").alias("flux"), "n_pix")


@query(f"""
    WITH {PX}, {PEAKS}, b AS (SELECT p.vec_id, p.y, p.x, n.y AS ny, n.x AS nx, n.v FROM pk p JOIN px n ON p.vec_id = n.vec_id AND abs(p.y - n.y) <= 1 AND abs(p.x - n.x) <= 1),
         m AS (SELECT vec_id, y, x, median(v) AS mid FROM b GROUP BY 1, 2, 3), w AS (SELECT b.*, greatest(v - mid, 0) AS w FROM b JOIN m USING (vec_id, y, x))
    SELECT vec_id, y, x, round(sum(w * ny) / nullif(sum(w), 0), 6) AS cy, round(sum(w * nx) / nullif(sum(w), 0), 6) AS cx FROM w GROUP BY 1, 2, 3""")
def centroid(spark, sf_dir):
    px = chips(spark, sf_dir)
    return I.centroid(peaks(px), ["vec_id"], px, 1).select("vec_id", "y", "x", r("cy").alias("cy"), r("cx").alias("cx"))


@query(f"WITH {PX} SELECT label, y, x, count(DISTINCT vec_id) AS images FROM px WHERE v > 0.2 GROUP BY 1, 2, 3 HAVING count(DISTINCT vec_id) >= 3")
def artifact_map(spark, sf_dir):
    return I.hit_map(chips(spark, sf_dir).where("v > 0.2"), "vec_id", 3, ["label"])


@query(f"""
    WITH {PX}, {PEAKS}, mark AS (SELECT y, x FROM px WHERE v > 0.28 GROUP BY 1, 2 HAVING count(DISTINCT vec_id) >= 8)
    SELECT vec_id, y, x FROM pk WHERE EXISTS (SELECT 1 FROM mark WHERE abs(mark.y - pk.y) <= 1 AND abs(mark.x - pk.x) <= 1)""")
def artifact_sources(spark, sf_dir):
    px = chips(spark, sf_dir)
    return I.near_map(peaks(px), I.hit_map(px.where("v > 0.28"), "vec_id", 8), 1).select("vec_id", "y", "x")


@query(f"""
    WITH {PX}, n AS (SELECT label, x, count(*) AS n FROM px WHERE v > 0.2 GROUP BY 1, 2)
    SELECT label, round(median(n), 4) AS med, round(quantile_cont(n, 0.99), 4) AS p99, max(n) AS most, count(*) AS columns FROM n GROUP BY 1""")
def hot_columns(spark, sf_dir):
    return I.column_counts(chips(spark, sf_dir).where("v > 0.2"), ["label"]).select("label", r("med", 4).alias("med"), r("p99", 4).alias("p99"), "most", "columns")


@query(f"""
    WITH {PX}, m AS (SELECT label, y, x, median(v) AS m, count(v) AS n, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1, 2, 3),
         s AS (SELECT px.label, 1.4826 * median(abs(v - m)) AS s FROM px JOIN m USING (label, y, x) GROUP BY 1),
         c AS (SELECT label, y, x, CASE WHEN n >= 3 AND v - m > 2 * s + 0.5 * abs(m) THEN m WHEN n = 2 AND hi - lo > 2 * s + 0.5 * abs(m) THEN lo ELSE v END AS v FROM px JOIN m USING (label, y, x) JOIN s USING (label))
    SELECT label, y, x, round(avg(v), 6) AS v, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def stack_reject_mean(spark, sf_dir):
    return I.stack_mean(chips(spark, sf_dir), ["label"], "vec_id", k=2.0).select("label", "y", "x", r("v").alias("v"), "n")


@query(f"""
    WITH {PX}, a AS (SELECT * FROM (VALUES (0.0), (45.0), (90.0)) t(angle)),
         b AS (SELECT vec_id, CAST(angle AS DOUBLE) AS angle, CAST(floor(round(y * cos(radians(angle)) - x * sin(radians(angle)), 9)) AS INTEGER) AS bin, v FROM px, a)
    SELECT vec_id, angle, bin, count(*) AS n, round(avg(v), 6) AS mean FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def angle_profile(spark, sf_dir):
    return I.angle_profile(chips(spark, sf_dir), ["vec_id"], [0.0, 45.0, 90.0], 3).select("vec_id", "angle", "bin", "n", r("mean").alias("mean"))


@query(f"""
    WITH {PX}, bad AS (SELECT *, v > 0.25 AS bad FROM px), f AS (SELECT b.vec_id, b.y, b.x, median(g.v) AS fill FROM bad b JOIN bad g ON b.vec_id = g.vec_id AND b.bad AND NOT g.bad AND abs(b.y - g.y) <= 2 AND abs(b.x - g.x) <= 2 GROUP BY 1, 2, 3)
    SELECT vec_id, y, x, round(CASE WHEN bad THEN coalesce(fill, v) ELSE v END, 6) AS v, bad AND fill IS NULL AS unfilled FROM bad LEFT JOIN f USING (vec_id, y, x)""")
def median_fill(spark, sf_dir):
    px = chips(spark, sf_dir).withColumn("bad", F.col("v") > 0.25)
    return I.median_fill(px, ["vec_id"], "bad", 2, 1).select("vec_id", "y", "x", r("v").alias("v"), "unfilled")


@query(f"""
    WITH {PX}, t AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS s FROM px GROUP BY 1, 2, 3)
    SELECT vec_id, round(median(s), 6) AS scale, count(*) AS tiles FROM t GROUP BY 1""")
def tile_scale(spark, sf_dir):
    return I.tile_scale(chips(spark, sf_dir), ["vec_id"], 4, 8, 8).select("vec_id", r("scale").alias("scale"), "tiles")


@query(f"""
    WITH {PX}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1), d AS (SELECT vec_id, y, x, v - m AS d FROM px JOIN m USING (vec_id)),
         n AS (SELECT vec_id, d, lead(d) OVER (PARTITION BY vec_id, y ORDER BY x) AS rt, lead(d) OVER (PARTITION BY vec_id, x ORDER BY y) AS dn FROM d)
    SELECT vec_id, round((avg(d * rt) + avg(d * dn)) / 2 / nullif(avg(d * d), 0), 6) AS acf1 FROM n GROUP BY 1""")
def autocorr(spark, sf_dir):
    return I.autocorrelation(chips(spark, sf_dir), ["vec_id"]).select("vec_id", r("acf1").alias("acf1"))


@query(f"""
    WITH {PX}, h AS (SELECT vec_id, x, y, y - row_number() OVER (PARTITION BY vec_id, x ORDER BY y) AS island FROM px WHERE v > 0.05)
    SELECT vec_id, x, min(y) AS run_start, max(y) AS run_end, count(*) AS run_length FROM h GROUP BY vec_id, x, island""")
def bleed_runs(spark, sf_dir):
    return C.runs_through(chips(spark, sf_dir), ["vec_id", "x"], "y", F.col("v") > 0.05)


@query(f"""
    WITH {PX}, {PEAKS}, best AS (SELECT p.vec_id, p.y, p.x, n.y AS my, n.x AS mx, n.v, row_number() OVER (PARTITION BY p.vec_id, p.y, p.x ORDER BY n.v DESC, n.y, n.x) AS k
         FROM pk p JOIN px n ON n.vec_id = p.vec_id + 1 AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1)
    SELECT vec_id, y, x, my, mx, round(v, 6) AS peak FROM best WHERE k = 1 AND v > 0.05""")
def cross_match(spark, sf_dir):
    px = chips(spark, sf_dir)
    sources = peaks(px).select("vec_id", "y", "x", F.col("y").alias("py"), F.col("x").alias("px"))
    partner = px.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", "v")
    return I.cross_match(sources, partner, ["vec_id"], 1, F.lit(0.05), 0, 8, 8).select("vec_id", "y", "x", "my", "mx", r("peak").alias("peak"))


@query(f"""
    WITH {PX}, {PEAKS} SELECT p.vec_id, p.y, p.x, round(n.v / greatest(p.v, 1e-6), 6) AS partner_ratio FROM pk p LEFT JOIN px n ON n.vec_id = p.vec_id + 1 AND n.y = p.y AND n.x = p.x""")
def partner_flux(spark, sf_dir):
    px = chips(spark, sf_dir)
    sources = peaks(px).withColumns({"py": F.col("y"), "px": F.col("x")})
    partner = px.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", "v")
    return I.partner_ratio(sources, partner, ["vec_id"]).select("vec_id", "y", "x", r("partner_ratio").alias("partner_ratio"))


@query(f"""
    WITH {PX} SELECT vec_id, y, x, round(0.75 * (0.5 * v + 0.5 * r), 6) AS v FROM (SELECT vec_id, y, x, v, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM px) WHERE r IS NOT NULL""")
def half_pixel_shift(spark, sf_dir):
    return I.shift_bilinear(chips(spark, sf_dir), ["vec_id"], 0.0, 0.5).select("vec_id", "y", "x", r(F.col("v") * 0.75).alias("v"))


LEAVE_ONE_OUT = """t AS (SELECT label, y, x, sum(v) AS s, count(*) AS n FROM px WHERE v > 0 GROUP BY 1, 2, 3),
         cov AS (SELECT px.*, coalesce(n, 0) - CASE WHEN v > 0 THEN 1 ELSE 0 END AS covered, CASE WHEN coalesce(n, 0) - CASE WHEN v > 0 THEN 1 ELSE 0 END > 0 THEN (s - CASE WHEN v > 0 THEN v ELSE 0 END) / (n - CASE WHEN v > 0 THEN 1 ELSE 0 END) ELSE v END AS partner FROM px LEFT JOIN t USING (label, y, x))"""


@query(f"WITH {PX}, {LEAVE_ONE_OUT} SELECT vec_id, y, x, round(partner, 6) AS partner, covered FROM cov")
def coverage_mean(spark, sf_dir):
    got = I.others_mean(chips(spark, sf_dir), ["label"], F.col("v") > 0)
    return got.select("vec_id", "y", "x", r("partner").alias("partner"), "covered")


@query(f"""
    WITH {PX}, c AS (SELECT vec_id, y, o.o * 2 AS centre, v FROM px, range(0, 8) o(o) WHERE abs(x - o.o * 2) <= 2)
    SELECT vec_id, y, centre, count(v) AS n, CASE WHEN count(v) >= 3 THEN round(median(v), 6) END AS med FROM c GROUP BY 1, 2, 3""")
def windowed_profile(spark, sf_dir):
    return I.windowed_profile(chips(spark, sf_dir), ["vec_id"], 4, 2, 3).select("vec_id", "y", "centre", "n", r("med").alias("med"))


@query(f"""
    WITH {PX}, g AS (SELECT vec_id, y, CASE WHEN count(*) FILTER (v > 0) >= 4 THEN median(v) END AS med FROM px GROUP BY 1, 2),
         w AS (SELECT vec_id, y, med, last_value(med IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN med IS NOT NULL THEN y END IGNORE NULLS) OVER b AS p0, first_value(med IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN med IS NOT NULL THEN y END IGNORE NULLS) OVER f AS p1
               FROM g WINDOW b AS (PARTITION BY vec_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY vec_id ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT vec_id, y, round(coalesce(CASE WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (y - p0) / (p1 - p0) END, v0, v1), 6) AS med_filled FROM w""")
def profile_interpolation(spark, sf_dir):
    rows = chips(spark, sf_dir).groupBy("vec_id", "y").agg(F.when(F.count(F.when(F.col("v") > 0, 1)) >= 4, F.median("v")).alias("med"))
    return I.interpolate(rows, ["vec_id"], "y", "med").select("vec_id", "y", r("med_filled").alias("med_filled"))


# ------------------------------------------------------------------ without SQL, held against brute force in the tests


@query()
def drizzle(spark, sf_dir):
    px = chips(spark, sf_dir).withColumns({"dy": (F.col("vec_id") % 4) * 0.25, "dx": (F.col("vec_id") % 3) * 0.5, "w": F.lit(1.0)})
    return I.drizzle(px, ["label"], scale=1.0, dy="dy", dx="dx", weight="w").select("label", "oy", "ox", r("v").alias("v"), r("weight").alias("weight"))


@query()
def components(spark, sf_dir):
    return I.label_components(chips(spark, sf_dir).where("v > 0.05"), ["vec_id"])


@query()
def destripe(spark, sf_dir):
    return I.destripe(chips(spark, sf_dir), ["vec_id"], detrend=3.0, least=3).select("vec_id", "y", "x", r("v").alias("v"))


@query()
def source_mask(spark, sf_dir):
    return I.source_mask(chips(spark, sf_dir), ["vec_id"], k=2.0, rounds=3).select("vec_id", "y", "x", "masked")


# ------------------------------------------------------------------ plans


@query("""
    WITH o AS (SELECT l_orderkey AS g, l_linenumber AS pos, l_extendedprice / 50000.0 AS ox, l_discount * 3 AS oy FROM lineitem),
         p AS (SELECT a.g, sqrt((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy)) AS gap FROM o a JOIN o b ON a.g = b.g AND a.pos < b.pos)
    SELECT coalesce(CAST(g AS VARCHAR), 'TOTAL') AS "group", count(*) AS n_pairs, count(*) FILTER (gap <= 0.1) AS bin0, count(*) FILTER (gap > 0.1 AND gap <= 0.3) AS bin1, count(*) FILTER (gap > 0.3 AND gap <= 0.5) AS bin2,
           count(*) FILTER (gap > 0.5 AND gap <= 1) AS bin3, count(*) FILTER (gap > 1) AS bin4, round(median(gap), 6) AS med_gap, round(max(gap), 6) AS max_gap FROM p GROUP BY ROLLUP (g)""")
def qc_misalignment(spark, sf_dir):
    off = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("pos"), (F.col("l_extendedprice") / 50000.0).alias("off_x"), (F.col("l_discount") * 3).alias("off_y"))
    got = qc.pair_misalignment(off)
    return got.withColumns({"med_gap": r("med_gap"), "max_gap": r("max_gap")})


@query("""
    WITH s AS (SELECT l_returnflag AS "group", CASE WHEN q >= 300 THEN 3 WHEN q >= 100 THEN 2 WHEN q >= 30 THEN 1 WHEN q >= 10 THEN 0 END AS tier, p AS raw, p * (1 - d * 6) AS clean FROM (SELECT l_returnflag, l_quantity * 7 AS q, l_extendedprice AS p, l_discount AS d FROM lineitem))
    SELECT "group", tier, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(median(clean / greatest(raw, 1e-6)), 6) END AS surv, CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN clean / greatest(raw, 1e-6) < 0.5 THEN 1.0 ELSE 0.0 END), 6) END AS lost,
           CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN abs(raw - clean) > 5 * 1000.0 THEN 1.0 ELSE 0.0 END), 6) END AS damaged FROM s WHERE tier IS NOT NULL GROUP BY 1, 2""")
def qc_survival(spark, sf_dir):
    p = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), (F.col("l_quantity") * 7).alias("peak_sig"), p.alias("raw"), (p * (1 - F.col("l_discount") * 6)).alias("clean"), F.lit(1000.0).alias("sigma"))
    return qc.survival(rows).withColumns({c: r(c) for c in ("surv", "lost", "damaged")})


@query("""
    WITH s AS (SELECT l_returnflag AS "group", CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 25 THEN 1 WHEN l_quantity >= 10 THEN 0 END AS tier, l_discount * 5 AS ratio FROM lineitem)
    SELECT "group", tier, count(*) AS n, count(*) FILTER (ratio > 0.3) AS stars, round(count(*) FILTER (ratio > 0.3) / count(*), 6) AS share FROM s WHERE tier IS NOT NULL GROUP BY 1, 2""")
def qc_census(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_quantity").alias("peak_sig"), (F.col("l_discount") * 5).alias("partner_ratio"))
    return qc.census(rows, edges=(10, 25, 40)).withColumn("share", r("share"))


@query("""
    WITH e AS (SELECT o_custkey AS "group", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS f, o_totalprice / 1e6 AS roll, o_totalprice AS sky FROM orders)
    SELECT a."group", a.f AS file_a, b.f AS file_b, abs(a.roll - b.roll) <= 0.1 AS valid,
           array_to_string(list_filter([CASE WHEN abs(a.roll - b.roll) > 0.1 THEN 'attention roll' END, CASE WHEN greatest(a.sky, b.sky) / greatest(least(a.sky, b.sky), 1e-6) > 4 THEN 'attention sky ratio' END], lambda x: x IS NOT NULL), ',') AS rules
    FROM e a JOIN e b ON a."group" = b."group" AND a.pos < b.pos""")
def qc_pair_rules(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ex = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), pos.alias("pos"), F.col("o_orderkey").alias("file"), (F.col("o_totalprice") / 1e6).alias("cd_angle"), F.lit(400.0).alias("exptime"), F.col("o_totalprice").alias("sky"), F.col("o_orderkey").alias("root"))
    return qc.pair_rules(ex).select("group", "file_a", "file_b", "valid", F.array_join("rules", ",").alias("rules"))


@query("""
    WITH RECURSIVE e AS (SELECT c_nationkey AS g, v, row_number() OVER (PARTITION BY c_nationkey ORDER BY v) AS pos FROM (SELECT DISTINCT c_nationkey, c_acctbal AS v FROM customer)),
         f AS (SELECT g, v, pos, v AS anchor FROM e WHERE pos = 1 UNION ALL SELECT e.g, e.v, e.pos, CASE WHEN e.v - f.anchor > 150.0 THEN e.v ELSE f.anchor END FROM f JOIN e ON e.g = f.g AND e.pos = f.pos + 1),
         s AS (SELECT g, anchor, count(*) AS size FROM f JOIN customer c ON c.c_nationkey = f.g AND c.c_acctbal = f.v GROUP BY 1, 2)
    SELECT size, count(*) AS clusters, size >= 3 AS used FROM s GROUP BY 1""")
def qc_units(spark, sf_dir):
    ex = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("cd_angle"))
    return qc.units(ex, roll=150.0)[1]


@query("""
    WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mv FROM lineitem GROUP BY 1),
         s AS (SELECT l_returnflag, sum((l_quantity - mx) * (l_quantity - mx)) AS xx, sum((l_quantity - mx) * (l_discount - my)) AS xy, sum((l_discount - my) * (l_discount - my)) AS yy, sum((l_quantity - mx) * (l_extendedprice - mv)) AS xv, sum((l_discount - my) * (l_extendedprice - mv)) AS yv, count(*) AS n
               FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_returnflag, n, round((xv * yy - yv * xy) / (xx * yy - xy * xy), 4) AS slope_x, round((yv * xx - xv * xy) / (xx * yy - xy * xy), 2) AS slope_y FROM s""")
def qc_plane(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("dx"))
    return qc.plane(rows, ["l_returnflag"], "dx").select("l_returnflag", "n", r("slope_x", 4).alias("slope_x"), r("slope_y", 2).alias("slope_y"))


@query(f"""
    WITH {PX}, {PEAKS}, h AS (SELECT vec_id, x, y, y - row_number() OVER (PARTITION BY vec_id, x ORDER BY y) AS island FROM px WHERE v > 0.6 * 0.1),
         runs AS (SELECT vec_id, x, min(y) AS a, max(y) AS b, count(*) AS n FROM h GROUP BY vec_id, x, island)
    SELECT p.vec_id, p.y, p.x, max(r.n) AS bleed FROM pk p JOIN runs r ON r.vec_id = p.vec_id AND r.x = p.x AND p.y BETWEEN r.a AND r.b GROUP BY 1, 2, 3""")
def qc_saturation(spark, sf_dir):
    px = chips(spark, sf_dir)
    return qc.saturation(px, peaks(px), ["vec_id"], F.lit(0.1))


@query(f"""
    WITH {PX}, {PEAKS}, best AS (SELECT p.vec_id, p.y, p.x, n.y - p.y AS dy, n.x - p.x AS dx, n.v, row_number() OVER (PARTITION BY p.vec_id, p.y, p.x ORDER BY n.v DESC, n.y, n.x) AS k FROM pk p JOIN px n ON n.vec_id = p.vec_id + 1 AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1),
         r AS (SELECT * FROM best WHERE k = 1 AND v > 0.05), m AS (SELECT median(dx) AS mx, median(dy) AS my FROM r)
    SELECT 'all' AS "group", count(*) AS n_match, round(any_value(mx), 6) AS med_dx, round(any_value(my), 6) AS med_dy, round(1.4826 * median(abs(dx - mx)), 6) AS mad_dx, round(median(sqrt(dx * dx + dy * dy)), 6) AS med_r FROM r, m""")
def qc_alignment(spark, sf_dir):
    got = cross_match(spark, sf_dir).select(F.lit("all").alias("group"), (F.col("mx") - F.col("x")).alias("dx"), (F.col("my") - F.col("y")).alias("dy"))
    base = got.groupBy("group").agg(F.count(F.lit(1)).alias("n_match"), F.median("dx").alias("med_dx"), F.median("dy").alias("med_dy"), F.median(F.hypot("dx", "dy")).alias("med_r"))
    off = got.join(base, "group").groupBy("group").agg((E.MAD_SCALE * F.median(F.abs(F.col("dx") - F.col("med_dx")))).alias("mad_dx"))
    return base.join(off, "group").select("group", "n_match", *[r(c).alias(c) for c in ("med_dx", "med_dy", "mad_dx", "med_r")])


@query("""
    SELECT a.c_custkey AS file_a, b.c_custkey AS file_b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 36
    WHERE sqrt(pow((b.c_custkey % 50 - a.c_custkey % 50) * cos(radians(a.c_acctbal / 3600)), 2) + pow(b.c_acctbal - a.c_acctbal, 2)) < 36""")
def near_pairs(spark, sf_dir):
    rec = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("filter"), F.col("c_custkey").alias("file"), (F.col("c_custkey") % 50).cast("double").alias("ra_targ"), F.col("c_acctbal").alias("dec_targ"), F.lit(0.0).alias("cd_angle"))
    return curation.near_pairs(rec, tolerance=36.0, unit=1.0).select("file_a", "file_b")


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND regexp_matches(o_orderpriority, '^(?:[0-9]-u)', 'i') AND length(CAST(o_orderkey AS VARCHAR)) >= 3""")
def observation_filter(spark, sf_dir):
    obs = table(spark, sf_dir, "orders").withColumns({"instrument_name": F.lit("ACS/WFC"), "dataproduct_type": F.lit("image"), "intentType": F.when(F.col("o_orderstatus") == "O", "science"), "filters": F.col("o_orderpriority"), "target_name": F.col("o_orderpriority"), "obs_id": F.when(F.length(F.col("o_orderkey").cast("string")) >= 3, "123456789")})
    return curation.select_fields(obs, instrument="ACS/WFC", filters=["1-URGENT", "2-HIGH"], target="[0-9]-u").select("o_orderkey", "o_custkey")


@query("""
    SELECT s_suppkey FROM supplier WHERE degrees(2 * asin(sqrt(least(pow(sin(radians((s_acctbal / 100 - 20) / 2)), 2) + cos(radians(20)) * cos(radians(s_acctbal / 100)) * pow(sin(radians((s_suppkey - 30) / 2.0)), 2), 1)))) <= 25""")
def cone_search(spark, sf_dir):
    obs = table(spark, sf_dir, "supplier").withColumns({"s_ra": F.col("s_suppkey").cast("double"), "s_dec": F.col("s_acctbal") / 100})
    return curation.cone(obs, 30.0, 20.0, 25 * 60.0).select("s_suppkey")


def _narrow_sql(key: str, source: str, value: str, rounds: int, k: float) -> str:
    """CTEs that end in ``zm`` (g, m): the median of each key after rounds of clipping the survivors."""
    out = [f"z0 AS (SELECT {key} AS g, {value} AS v, true AS live FROM {source})"]
    for i in range(rounds):
        out += [f"zm{i} AS (SELECT g, median(v) AS m FROM z{i} WHERE live GROUP BY 1)", f"zs{i} AS (SELECT z{i}.g, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM z{i} JOIN zm{i} USING (g) WHERE live GROUP BY 1)"]
        out.append(f"z{i + 1} AS (SELECT z{i}.g, v, CASE WHEN s = 0 THEN live ELSE live AND abs(v - m) < {k} * s END AS live FROM z{i} JOIN zs{i} USING (g))")
    return ", ".join(out) + f", zm AS (SELECT g, median(v) AS m FROM z{rounds} WHERE live GROUP BY 1)"


@query(f"""WITH {PX}, {LEAVE_ONE_OUT}, d AS (SELECT *, (v + partner) / 2 AS den FROM cov), {_narrow_sql("vec_id", "d", "v - den", 5, 3.0)}
    SELECT vec_id, y, x, round(CASE WHEN covered = 0 THEN v ELSE 0.9 * (den + m) + (1 - 0.9) * v END, 6) AS v, covered FROM d JOIN zm ON zm.g = d.vec_id""")
def denoised(spark, sf_dir):
    seen = I.others_mean(chips(spark, sf_dir), ["label"], F.col("v") > 0).drop("label")
    return production.denoise_with(seen, ["vec_id"]).select("vec_id", "y", "x", r("v").alias("v"), "covered")


@query()
def mosaics(spark, sf_dir):
    px = chips(spark, sf_dir).withColumns({"dq": F.when(F.col("v") > 0.3, 4).otherwise(16), "exptime": F.lit(400.0), "dy": (F.col("vec_id") % 4) * 0.25, "dx": (F.col("vec_id") % 3) * 0.5})
    return production.mosaic(px, ["label"], ["vec_id"]).select("label", "oy", "ox", r("v").alias("v"), r("weight").alias("weight"))


@query()
def training_samples(spark, sf_dir):
    ex = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("unit"), F.col("vec_id").alias("file"), "embedding")
    drawn = samples.draw(ex.select("unit", F.col("file").cast("string").alias("file")), samples=2, attempts=2)
    boxes = ex.select(F.col("file").cast("string").alias("file"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.lit(8).alias("y1"), F.lit(8).alias("x1"))
    px = I.to_pixels(ex.withColumn("file", F.col("file").cast("string")), ["file"], "embedding", 8)
    cut = samples.patches(drawn, samples.positions(drawn, boxes, 4), px, 4)
    return samples.targets(samples.augmented(cut, 4)).withColumn("v", r("v"))
