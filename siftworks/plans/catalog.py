"""Named queries over the tables, each with SQL that computes the same rows where SQL can.

Each query applies operators of this library to a whole table.  Doubles are rounded to six decimals
on both sides, because sums and percentiles differ in the last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.functions import decisions as dc, flags as fl, text as tx, transfer as tr
from siftworks.operators import fits, gates, graphs, ordered, planning, ranking, raster, regions, sessions, stats
from siftworks.sources import pages
from siftworks.streaming import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "categorize_plan"


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- planning --------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT doc_id, coalesce(lang,'') || '/' || coalesce(source,'') AS destination, sha256(coalesce(text,'')) AS fingerprint FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY destination, fingerprint) AS first FROM f),
h AS (SELECT *, dense_rank() OVER (PARTITION BY destination ORDER BY first) AS sequence FROM g)
SELECT doc_id, destination, sequence, CASE WHEN sequence > 1 THEN 'document (' || sequence || ').txt' ELSE 'document.txt' END AS file_name,
CASE WHEN doc_id = first THEN 'copy' ELSE 'duplicate' END AS disposition FROM h""")
def categorize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict-free names for documents by language and source; equal texts share one."""
    docs = read(spark, sf_dir, "documents")
    items = docs.select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))).alias("destination"), tx.sha256(F.col("text")).alias("fingerprint"))
    return planning.categorize(items, ["destination"], "fingerprint", "doc_id", F.lit("document"), F.lit("txt")).drop("fingerprint")


@query("""
SELECT o_orderkey, o_custkey, min(l_linenumber) AS companion FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def companion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the first of its lines, if it has one."""
    big = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return planning.companions(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), big, ["o_orderkey"], "l_linenumber")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def missing_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return planning.missing(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])


@query("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AND l_returnflag IN ('N','A')) AS reuse FROM orders""")
def reuse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's receipt counts if a line shipped the day after it and was not returned."""
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.date_add(F.col("o_orderdate").cast("date"), 1).alias("day"))
    receipts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").cast("date").alias("day"), F.when(F.col("l_returnflag").isin("N", "A"), "success").otherwise("failed").alias("status"))
    return planning.reusable(items, receipts, ["key"], ["day"]).select(F.col("key").alias("o_orderkey"), "reuse")


# --- flags -----------------------------------------------------------------------------------

_MODE_SQL = ", ".join(f"CASE WHEN flags & {bit} <> 0 THEN '{name}' END" for name, bit in fl.MODES.items())


@query(f"""
WITH f AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000003 AS flags FROM orders), g AS (SELECT *, concat_ws(',', {_MODE_SQL}) AS modes FROM f)
SELECT o_orderkey, modes, CASE WHEN modes <> '' THEN string_split(modes, ',')[1] WHEN flags & {~fl.KNOWN_MASK & 0x7FFFFFFFFFFFFFFF} = 0 THEN 'normal' END AS primary_mode,
CAST(flags & {fl.MAPPED_MASK} AS BIGINT) AS recognized, CAST(flags & {fl.KNOWN_MASK & ~fl.MAPPED_MASK} AS BIGINT) AS known_unmapped, CAST(flags & {~fl.KNOWN_MASK & 0x7FFFFFFFFFFFFFFF} AS BIGINT) AS unknown FROM g""")
def flag_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys, spread over the bits, as capture flags."""
    flags = (F.col("o_orderkey") * 1000003).cast("decimal(20,0)")
    df = read(spark, sf_dir, "orders").select("o_orderkey", flags.alias("flags")).withColumn("found", fl.modes(F.col("flags")))
    f, found = F.col("flags"), F.col("found")
    as_long = lambda c: c.cast("long")
    return df.select("o_orderkey", F.array_join(found, ",").alias("modes"), fl.primary_mode(found, f, F.lit("ok")).alias("primary_mode"), as_long(fl.recognized(f)).alias("recognized"), as_long(fl.known_unmapped(f)).alias("known_unmapped"), as_long(fl.unknown(f)).alias("unknown"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS flags FROM events""")
def flag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag value in each event's JSON properties."""
    return read(spark, sf_dir, "events").select("event_id", fl.parse_json_flags(F.col("props"), "k").cast("long").alias("flags"))


# --- sessions and splits ---------------------------------------------------------------------


@query("""
WITH m AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN last IS NULL OR epoch_us(ts) - epoch_us(last) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM m)
SELECT event_id, CAST(session AS BIGINT) AS session, substr(sha256(CAST(user_id AS VARCHAR) || '|' || CAST(CAST(session AS BIGINT) AS VARCHAR)), 1, 16) AS session_id FROM s""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600).select("event_id", "session", "session_id")


_SPLIT = "CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'calibration' ELSE 'heldout' END"
_BUCKET = "CAST(('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 8)) AS BIGINT) % 100"


@query(f"WITH x AS (SELECT doc_id, {_BUCKET.format('doc_id')} AS b FROM documents) SELECT doc_id, CAST(b AS INTEGER) AS bucket, {_SPLIT} AS split FROM x")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.hash_bucket(F.col("doc_id")).alias("bucket"), tx.hash_split(F.col("doc_id")).alias("split"))


@query(f"""
WITH x AS (SELECT user_id, {_BUCKET.format('event_id')} AS b FROM events) SELECT user_id, count(DISTINCT {_SPLIT}) AS splits FROM x GROUP BY user_id HAVING count(DISTINCT {_SPLIT}) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that leak when events, and not users, are dealt to splits."""
    return sessions.leaking_sessions(read(spark, sf_dir, "events").withColumn("split", tx.hash_split(F.col("event_id"))), "user_id", "split")


@query(f"WITH x AS (SELECT {_BUCKET.format('doc_id')} AS b FROM documents) SELECT {_SPLIT} AS split, count(*) AS n FROM x GROUP BY 1")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.split_counts(read(spark, sf_dir, "documents"), tx.hash_split(F.col("doc_id")))


# --- statistics ------------------------------------------------------------------------------

_NINE_SQL = ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in stats.NINE.items())


@query(f"SELECT l_returnflag, count(x) AS n, {_NINE_SQL} FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY 1")
def nine_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.nine_number(read(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice")))


@query(f"SELECT l_shipmode AS l_linestatus, count(x) AS n, {_NINE_SQL} FROM (SELECT l_linestatus AS l_shipmode, CASE WHEN l_discount >= 0.05 THEN l_quantity END AS x FROM lineitem) GROUP BY 1")
def masked_nine_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.nine_number(read(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_discount") >= 0.05))


@query("""
WITH l AS (SELECT l_returnflag AS k, l_extendedprice AS x FROM lineitem), m AS (SELECT k, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
b AS (SELECT k, CAST(least(floor(20 * (x - lo) / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n, avg(x) AS mean FROM l JOIN m USING (k) GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY bin) AS cumulative, sum(n) OVER (PARTITION BY k) AS total FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bin) AS i FROM c WHERE cumulative > floor(total * 0.3))
SELECT k AS l_returnflag, bin, CAST(cumulative AS BIGINT) AS cumulative, round(mean, 6) AS mean FROM d WHERE i = 1""")
def histogram_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price bin of each return flag where the running count passes 30 %."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    ends = lines.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    binned = stats.histogram(lines.join(ends, "l_returnflag"), ["l_returnflag"], "l_extendedprice", 20, "low", "high")
    return rounded(stats.threshold_bin(binned, ["l_returnflag"], 0.3))


_CENTROID = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, label, i, CAST(v AS DOUBLE) AS v, avg(CAST(v AS DOUBLE)) OVER (PARTITION BY label, i) AS c FROM e)"""


def _against_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return long.join(long.groupBy("label", "i").agg(F.avg("v").alias("c")), ["label", "i"])


@query(f"""{_CENTROID} SELECT label, count(*) AS n, round(avg(abs(v - c)), 6) AS mean_abs, round(max(abs(v - c)), 6) AS max_abs, round(sqrt(avg((v - c) * (v - c))), 6) AS rmse,
round(CASE WHEN avg((v-c)*(v-c)) > 0 THEN 20 * log10(greatest(1.0, max(abs(c)))) - 10 * log10(avg((v - c) * (v - c))) END, 6) AS psnr FROM p GROUP BY label""")
def diff_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.difference_metrics(_against_centroid(spark, sf_dir), ["label"], "v", "c"))


@query(f"""{_CENTROID}, g AS (SELECT label, avg(abs(v - c)) AS m, sum(abs(v - c)) AS s, count(*) AS n FROM p GROUP BY label)
SELECT round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, round(max(m), 6) AS worst, count(*) AS "groups" FROM g""")
def group_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.micro_macro(_against_centroid(spark, sf_dir).withColumn("error", F.abs(F.col("v") - F.col("c"))), "label", "error"))


@query(f"""{_CENTROID}, g AS (SELECT label, vec_id, sqrt(avg((v - c) * (v - c))) AS rmse, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, round(sqrt(sum(rmse * rmse * n) / sum(n)), 6) AS rmse FROM g GROUP BY label""")
def pooled_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = stats.difference_metrics(_against_centroid(spark, sf_dir), ["label", "vec_id"], "v", "c")
    return rounded(stats.pooled(each, ["label"], "rmse", "n"))


@query("""
WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME col VALUE x),
m AS (SELECT col, quantile_cont(x, 0.5) AS median FROM u GROUP BY 1), s AS (SELECT col, median, quantile_cont(abs(x - median), 0.9) AS scale FROM u JOIN m USING (col) GROUP BY 1, 2)
SELECT col, round(median, 6) AS median, round(scale, 6) AS scale, scale >= 0.001 AS active FROM s""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").unpivot([], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "col", "x")
    return rounded(stats.robust_scale(lines, ["col"], "x"))


@query("""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_wall, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95_wall,
round(quantile_cont(l_quantity, 0.5), 6) AS median_memory, round(max(l_quantity), 6) AS max_memory FROM lineitem GROUP BY 1""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summary(read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate")), ["year"], "l_extendedprice", "l_quantity"))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS processed, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def receipt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.receipt(read(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate")), ["year"], "l_returnflag", ["A", "N", "R"])


_YEARLY = "SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS c, avg(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) {0} 1995 GROUP BY 1"


@query(f"""
WITH a AS ({_YEARLY.format('<')}), b AS ({_YEARLY.format('>=')}), j AS (SELECT a.c, a.v AS reference, greatest(a.v * 1.01, a.v + 50) AS budget, b.v AS current FROM a LEFT JOIN b USING (c))
SELECT c, round(reference, 6) AS reference, round(budget, 6) AS budget, round(current, 6) AS current, CASE WHEN current IS NULL THEN 'missing' WHEN current <= budget THEN 'pass' ELSE 'fail' END AS verdict FROM j""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices from 1995 on against a budget from those before, by flag, status and line."""
    lines = read(spark, sf_dir, "lineitem").withColumn("c", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    early = F.year("l_shipdate") < 1995
    part = lambda which: lines.where(which).groupBy("c").agg(F.avg("l_extendedprice").alias("v"))
    return rounded(stats.budget_report(part(early), part(~early), "c", "v", 0.01, 50.0))


@query("""
WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
s AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS j, count(*) OVER (PARTITION BY k) AS m FROM r WHERE i >= floor(n / 5) AND i < floor(n * 4 / 5))
SELECT k AS l_suppkey, v AS anchor, m AS kept FROM s WHERE j = floor(m / 2)""")
def trimmed_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the price among the middle three fifths of each supplier's lines by quantity."""
    return stats.trimmed_anchor(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("""
WITH t AS (SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_extendedprice, l_quantity) AS correlation FROM lineitem WHERE NOT (l_orderkey + l_linenumber) % 2 = 0 GROUP BY 1),
h AS (SELECT k, avg(abs(l_extendedprice - intercept - slope * l_quantity)) AS e FROM lineitem JOIN t ON l_suppkey = k WHERE (l_orderkey + l_linenumber) % 2 = 0 GROUP BY 1)
SELECT t.k AS l_suppkey, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(correlation, 6) AS correlation, round(e, 4) AS held_out_mae FROM t LEFT JOIN h ON t.k = h.k""")
def local_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity for each supplier, fitted on one colour of a checkerboard and judged on the other."""
    found = stats.local_regression(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", (F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0)
    return found.select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("correlation").alias("correlation"), F.round("held_out_mae", 4).alias("held_out_mae"))


@query("""
WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem),
m AS (SELECT avg(l_extendedprice) FILTER (l_quantity >= hi) AS edge, avg(l_extendedprice) FILTER (l_quantity <= lo) AS flat FROM lineitem, q) SELECT round(edge, 6) AS edge, round(flat, 6) AS flat, round(edge / flat, 6) AS ratio FROM m""")
def edge_to_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.edge_to_flat(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


# --- ordered ---------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins: the last event of each user and type."""
    return rounded(ordered.replay(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_wins(read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT event_type, lead(v) OVER (PARTITION BY event_type ORDER BY day) - v AS delta FROM d)
SELECT event_type, count(delta) AS steps, round(max(abs(delta)), 6) AS max_step, round(avg(abs(delta)), 6) AS mean_step, NOT (coalesce(bool_or(delta > 0), false) AND coalesce(bool_or(delta < 0), false)) AS monotone FROM s GROUP BY 1""")
def tone_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(ordered.step_score(ordered.steps(daily, ["event_type"], "day", "v"), ["event_type"]))


@query("""
WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def byte_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type in each user's stream."""
    return ordered.islands(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").drop("first", "last")


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT event_type, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT event_type FROM events)),
j AS (SELECT a.event_type, day(a.day) AS pos, CASE WHEN day(a.day) % 3 = 1 THEN v END AS v FROM a LEFT JOIN d ON a.event_type = d.event_type AND a.day = d.day),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS x0, last_value(v IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER c AS x1, first_value(v IGNORE NULLS) OVER c AS y1 FROM j
WINDOW b AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, CAST(pos AS INTEGER) AS pos, round(coalesce(v, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (pos - x0) / (x1 - x0) END, y0, y1), 6) AS filled FROM w""")
def gap_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means measured on every third day; the days between are the gaps to fill."""
    events = read(spark, sf_dir, "events")
    days = events.select("event_type").distinct().withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(31))))
    daily = events.groupBy("event_type", F.day("ts").alias("pos")).agg(F.avg("value").alias("v"))
    known = daily.withColumn("v", F.when(F.col("pos") % 3 == 1, F.col("v")))
    return rounded(ordered.interpolated(days.join(known, ["event_type", "pos"], "left"), ["event_type"], "pos", "v").drop("v"))


@query("SELECT user_id, bool_and(coalesce(value > last, true)) AS increasing FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) GROUP BY 1")
def increasing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.strictly_increasing(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


# --- functions -------------------------------------------------------------------------------

_P, _H, _L = tr.PQ, tr.HLG, tr.LOG


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 110000.0 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(pow(({_P['c1']} + {_P['c2']} * pow(x, {_P['m1']})) / (1 + {_P['c3']} * pow(x, {_P['m1']})), {_P['m2']}), 6) AS pq,
round(CASE WHEN x <= {1 / 12} THEN sqrt(3 * x) ELSE {_H['a']} * ln(12 * x - {_H['b']}) + {_H['c']} END, 6) AS hlg,
round(CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, {1 / 2.4}) - 0.055 END, 6) AS srgb,
round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END, 6) AS linear,
round(greatest(0, least(1, {_L['a']} * log2(x + {_L['b']}) + {_L['c']})), 6) AS log,
round(pow(2.0, (x - {_L['c']}) / {_L['a']}) - {_L['b']}, 6) AS unlog FROM x""")
def transfer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 110000.0).alias("x"))
    curves = {"pq": tr.pq_encode(x), "hlg": tr.hlg_encode(x), "srgb": tr.srgb_encode(x), "linear": tr.srgb_decode(x), "log": tr.log_encode(x), "unlog": tr.log_decode(x)}
    return lines.select("l_orderkey", "l_linenumber", *(r6(c).alias(n) for n, c in curves.items()))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 110000.0 AS x, l_discount * 10 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x * 0.22897456 + t * 0.69173855 + x * t * 0.07928691, 6) AS luminance,
round(greatest(0, least(1, (t - 0.2) / 0.6)), 6) AS weight, round(pow(2.0, greatest(0, least(1, (t - 0.2) / 0.6)) * (-0.5 + pow(t, 0.5) * 2.5)) * (x + 0.015625) - 0.015625, 6) AS applied,
round(CASE WHEN x > 0 AND t > 0 THEN greatest(1, least(2.5, sqrt(t / x))) ELSE 1 END, 6) AS boost FROM x""")
def gain_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, t = F.col("x"), F.col("t")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 110000.0).alias("x"), (F.col("l_discount") * 10).alias("t"))
    weight = tr.gain_weight(t, F.lit(0.2), F.lit(0.8))
    applied = tr.gain_apply(x, t, weight, F.lit(-0.5), F.lit(2.0), 2.0, 0.015625, 0.015625)
    return lines.select("l_orderkey", "l_linenumber", r6(tr.p3_luminance(x, t, x * t)).alias("luminance"), r6(weight).alias("weight"), r6(applied).alias("applied"), r6(tr.exposure_boost(t, x)).alias("boost"))


@query("""SELECT p_partkey, regexp_extract(p_name, '([^ ]+)$', 1) AS last_word, sha256(p_name) AS digest,
CASE WHEN p_size > 1 THEN 'part (' || p_size || ').bin' ELSE 'part.bin' END AS file_name, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part""")
def names_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_name", "([^ ]+)$", 1).alias("last_word"), tx.sha256(F.col("p_name")).alias("digest"),
        tx.sequenced_name(F.lit("part"), F.lit("bin"), F.col("p_size")).alias("file_name"), fl.padded(F.col("p_size"), F.lit("0000")).alias("padded"),
    )


# --- fits ------------------------------------------------------------------------------------

_BINS = "SELECT CAST(l_quantity AS INTEGER) AS q, avg(l_extendedprice * (1 + l_discount * 9 * (l_linenumber % 2))) AS m, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1"


@query(f"""
WITH b AS ({_BINS}), p AS (SELECT x.q AS lo, y.q AS hi, (SELECT sum(m * w) / sum(w) FROM b WHERE q BETWEEN x.q AND y.q) AS v FROM b x JOIN b y ON x.q <= y.q),
s AS (SELECT k.q, p.lo, min(p.v) AS v FROM b k JOIN p ON p.lo <= k.q AND p.hi >= k.q GROUP BY 1, 2) SELECT q, round(max(v), 4) AS fitted FROM s GROUP BY 1""")
def bin_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 + F.col("l_discount") * 9 * (F.col("l_linenumber") % 2))
    bins = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.avg(price).alias("m"), F.count(F.lit(1)).alias("w"))
    return fits.isotonic(bins.withColumn("all", F.lit(1)), ["all"], "q", "m", "w").select("q", F.round("fitted", 4).alias("fitted"))


@query("SELECT l_suppkey, round(sum(l_extendedprice / 1000 - l_quantity) / (count(*) + 10), 6) AS bias FROM lineitem GROUP BY 1")
def ridge_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.ridge_bias(read(spark, sf_dir, "lineitem").withColumn("residual", F.col("l_extendedprice") / 1000 - F.col("l_quantity")), ["l_suppkey"], "residual", 10))


@query("""
WITH g AS (SELECT unnest(range(41)) AS i), e AS (SELECT l_returnflag, i, round(avg(abs(i / 40.0 * l_quantity + (1 - i / 40.0) * l_tax * 500 - l_extendedprice / 1500)), 9) AS error FROM lineitem, g GROUP BY 1, 2)
SELECT l_returnflag, round(arg_min(i / 40.0, (error, i)), 6) AS weight, round(min(error), 6) AS error FROM e GROUP BY 1""")
def grid_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") * 500).alias("other"), (F.col("l_extendedprice") / 1500).alias("target"))
    return rounded(fits.best_on_grid(lines, ["l_returnflag"], "l_quantity", "other", "target"))


@query()
def irls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust quadratic fit of price on quantity, discount and tax: ten coefficients."""
    lines = read(spark, sf_dir, "lineitem")
    basis = tr.quadratic_basis(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    out = fits.robust_fit(lines, [basis[i] for i in range(10)], F.col("l_extendedprice") / 100000)
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(float(c)) for c in out))).alias("term", "coefficient"))


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.gap_sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return fits.cluster_bootstrap(found.withColumn("goal", F.lit(50.0)), "session_id", "value", "goal")


# --- decisions, ranges, graphs ---------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN food >= 0.08 THEN 'food' WHEN sunset >= 0.08 THEN 'sunset' WHEN indoor >= 0.15 THEN 'indoor' WHEN outdoor >= 0.15 THEN 'outdoor' ELSE 'other' END AS scene FROM
(SELECT l.doc_id, toxic * 0.5 AS food, (n_chars % 100) / 1000.0 AS sunset, quality * (n_chars % 7) / 30.0 AS indoor, (n_chars % 11) / 60.0 AS outdoor FROM labels l JOIN documents USING (doc_id))""")
def scene_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    scores = {"food": F.col("toxic") * 0.5, "sunset": n % 100 / 1000.0, "indoor": F.col("quality") * (n % 7) / 30.0, "outdoor": n % 11 / 60.0}
    return both.select("doc_id", gates.decided(scores, [("food", 0.08), ("sunset", 0.08), ("indoor", 0.15), ("outdoor", 0.15)], "other").alias("scene"))


@query("""
WITH r AS (SELECT p_brand, min(p_retailprice) - 1e-9 AS lo, max(p_retailprice) + 1e-9 AS hi FROM part WHERE p_size <= 25 GROUP BY 1) SELECT p_partkey, p_retailprice BETWEEN lo AND hi AS in_range FROM part LEFT JOIN r USING (p_brand)""")
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a part's price within its brand's range among the small parts?"""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return graphs.outside_range(part, part.where("p_size <= 25"), ["p_brand"], "p_retailprice").select("p_partkey", "in_range")


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice > 1500 THEN 30 + 10 * (least(p_retailprice, 2000) - 1500) / 500 WHEN p_retailprice > 1000 THEN 10 + 20 * (p_retailprice - 1000) / 500 ELSE 10 END, 6) AS y FROM part""")
def curve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", r6(graphs.on_curve(F.col("p_retailprice"), [(1000, 10), (1500, 30), (2000, 40)])).alias("y"))


_HALF = "SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = {0}"


@query(f"""SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM ({_HALF.format(0)} EXCEPT ALL {_HALF.format(1)}) UNION ALL SELECT 'right' FROM ({_HALF.format(1)} EXCEPT ALL {_HALF.format(0)})) GROUP BY 1""")
def bag_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even orders against those of odd orders as bags; both halves make the whole table."""
    half = lambda k: read(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 2 == k).select("l_suppkey", "l_linenumber")
    return graphs.bag_difference(half(0), half(1)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'lines without order' AS problem, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'repeated line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'repeated supplier identity', count(*) FROM (SELECT s_name FROM supplier GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)""")
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    lost = counted(graphs.dangling(lines.select("l_orderkey"), orders, "l_orderkey", "o_orderkey"), "lines without order")
    twice = counted(graphs.repeated_keys(lines, ["l_orderkey", "l_linenumber"]), "repeated line")
    named = counted(graphs.repeated_identities(read(spark, sf_dir, "supplier"), ["s_name", "s_nationkey"]), "repeated supplier identity")
    return lost.unionByName(twice).unionByName(named)


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation),
r(node, hops) AS (SELECT 1, 0 UNION ALL SELECT e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 30) SELECT CAST(node AS INTEGER) AS node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node""")
def ref_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")).unionByName(nation.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 100).alias("b")))
    return graphs.closure(edges, spark.range(1).select(F.lit(1).alias("node"))).select(F.col("node").cast("int").alias("node"), F.col("hops").cast("int").alias("hops"))


@query("""
SELECT l_orderkey, rule, count(*) AS n FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN NOT coalesce(l_quantity <= 45, false) THEN 'quantity' END, CASE WHEN NOT coalesce(l_discount < 0.1, false) THEN 'discount' END, CASE WHEN NOT coalesce(l_tax < 0.08, false) THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1, 2""")
def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of each order's lines."""
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "tax": F.col("l_tax") < 0.08}
    return gates.violations(read(spark, sf_dir, "lineitem"), "l_orderkey", rules).groupBy("l_orderkey", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT l_returnflag AS f, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY 1, 2), e AS (SELECT DISTINCT l_returnflag AS f, i AS n FROM lineitem, range(0, 8) t(i))
SELECT f, CAST(n AS INTEGER) AS n, 'missing' AS problem FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.f = e.f AND x.n = e.n) UNION ALL SELECT f, n, 'repeated' FROM x WHERE c > 1""")
def sweep_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag and line-number cells of all lines against the full grid."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    grid = lines.select("f").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return gates.grid_gaps(grid, lines, ["f", "n"])


# --- rasters: embeddings as 8 x 8 samples ----------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST((i // 8) // 4 * 2 + (i % 8) // 4 AS INTEGER) AS cell, round(avg(v), 6) AS mean FROM e GROUP BY 1, 2""")
def grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(raster.cell_means(F.col("embedding"), 8, 8, 2, 2)).alias("cell", "mean")))


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
d AS (SELECT vec_id, CASE WHEN i % 8 = 0 THEN 0 ELSE v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) END AS dx, CASE WHEN i < 8 THEN 0 ELSE v - lag(v, 8) OVER (PARTITION BY vec_id ORDER BY i) END AS dy FROM e)
SELECT vec_id, round(sum(abs(dx)), 6) AS dx, round(sum(abs(dy)), 6) AS dy FROM d GROUP BY 1""")
def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = raster.gradients(F.col("embedding"), 8)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(total(dx)).alias("dx"), r6(total(dy)).alias("dy"))


@query("""SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x >= 0.1)) AS BIGINT) AS prior, CAST(len(list_filter(embedding, lambda x, i: x >= 0.1 AND embedding[65 - i] >= 0.1)) AS BIGINT) AS overlap FROM embeddings""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, both = raster.overlap(F.col("embedding"), F.reverse("embedding"), 0.1)
    return read(spark, sf_dir, "embeddings").select("vec_id", prior.alias("prior"), both.alias("overlap"))


def _filtered(spark: SparkSession, sf_dir: str, f: Column) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(f).alias("cell", "value")).withColumn("value", r6("value"))


_GRID = """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, CAST(i AS INTEGER) AS cell, i // 8 AS y, i % 8 AS x, v FROM e), o AS (SELECT a - 3 AS d FROM range(7) t(a))"""
_NEAR = "p a JOIN o oy ON abs(oy.d) <= 2 JOIN o ox ON abs(ox.d) <= 2 JOIN {0} b ON b.vec_id = a.vec_id AND b.y = greatest(0, least(7, a.y + oy.d)) AND b.x = greatest(0, least(7, a.x + ox.d))"


@query(f"""{_GRID}, m AS (SELECT a.vec_id, a.cell, a.y, a.x, avg(b.v) AS mean, avg(b.v * b.v) - avg(b.v) * avg(b.v) AS var FROM {_NEAR.format('p')} GROUP BY ALL),
k AS (SELECT *, var / (var + 0.01) AS slope, mean * (1 - var / (var + 0.01)) AS base FROM m)
SELECT a.vec_id, a.cell, round(avg(b.slope) * a.v + avg(b.base), 6) AS value FROM {_NEAR.format('k')} GROUP BY a.vec_id, a.cell, a.v""")
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, raster.guided(8, 8, 2, 0.01)(F.col("embedding")))


@query(f"{_GRID} SELECT a.vec_id, a.cell, round(max(b.v), 6) AS value FROM p a JOIN p b ON b.vec_id = a.vec_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 GROUP BY 1, 2")
def disc_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, raster.disc_maximum(8, 8, 2)(F.col("embedding")))


_PASS = "sum(exp(-0.5 * (d / 1.5) * (d / 1.5)) * exp(-0.5 * ((b.g - a.g) / 0.5) * ((b.g - a.g) / 0.5)) * b.v) / sum(exp(-0.5 * (d / 1.5) * (d / 1.5)) * exp(-0.5 * ((b.g - a.g) / 0.5) * ((b.g - a.g) / 0.5)))"


@query(f"""{_GRID}, q AS (SELECT *, v * v AS g FROM p),
r AS (SELECT a.vec_id, a.cell, a.y, a.x, a.g, {_PASS} AS v FROM q a CROSS JOIN o JOIN q b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = greatest(0, least(7, a.x + d)) GROUP BY ALL)
SELECT a.vec_id, a.cell, round({_PASS}, 6) AS value FROM r a CROSS JOIN o JOIN r b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = greatest(0, least(7, a.y + d)) GROUP BY 1, 2""")
def bilateral_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples smoothed under the guidance of their squares, which both passes follow."""
    squares = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return _filtered(spark, sf_dir, raster.bilateral(8, 8, 3, 1.5, 0.5)(F.col("embedding"), squares))


@query(f"{_GRID} SELECT a.vec_id, a.cell, round(coalesce(avg(b.v) FILTER (b.v >= 0.1), 0), 6) AS value FROM p a JOIN p b ON b.vec_id = a.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the samples from 0.1 on; 0 where the square has none."""
    return _filtered(spark, sf_dir, raster.box_blur(8, 8, 1)(F.col("embedding"), F.transform("embedding", lambda v: v >= 0.1)))


# --- sources and streams ---------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a[ >]')) AS INTEGER) AS links FROM pages""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.records(read(spark, sf_dir, "pages"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal replay as a stream over the event files, run to its end."""
    return journal.replayed(spark, sf_dir)


# --- more predicates, ranges and geometry ----------------------------------------------------


@query("""
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_type FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, event_type FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.position, b.position) AS INTEGER) AS position, coalesce(a.event_type = b.event_type, false) AS equal FROM a FULL JOIN b ON a.user_id = b.user_id AND a.position = b.position""")
def packet_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's even-numbered events against the odd-numbered ones, place by place; both halves make the whole table."""
    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.positional_parity(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"], ["event_type"])


_YEAR_KEY = "SELECT l_suppkey AS k, round(sum(l_quantity), 6) AS v FROM lineitem WHERE year(l_shipdate) {0} 1995 GROUP BY 1"


@query(f"""WITH a AS ({_YEAR_KEY.format('<')}), b AS ({_YEAR_KEY.format('>=')}) SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'before' WHEN b.v IS NULL THEN 'after' ELSE 'none' END AS lacks FROM a FULL JOIN b ON a.k = b.k""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each supplier before 1995 against those from then on."""
    early = F.year("l_shipdate") < 1995
    part = lambda which: read(spark, sf_dir, "lineitem").where(which).groupBy(F.col("l_suppkey").alias("k")).agg(r6(F.sum("l_quantity")).alias("v"))
    return ordered.key_comparison(part(early), part(~early), ["k"], "v")


@query("""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT unnest(range(9)) AS cell),
w AS (SELECT cell, i, greatest(0, least((cell // 3 + 1) * 8 / 3, i // 8 + 1) - greatest(cell // 3 * 8 / 3, i // 8)) * greatest(0, least((cell % 3 + 1) * 8 / 3, i % 8 + 1) - greatest(cell % 3 * 8 / 3, i % 8)) AS w FROM c, (SELECT unnest(range(64)) AS i))
SELECT vec_id, CAST(cell AS INTEGER) AS cell, round(sum(v * w) / sum(w), 6) AS mean FROM e JOIN w USING (i) GROUP BY 1, 2""")
def area_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(raster.area_resample(F.col("embedding"), 8, 8, 3, 3)).alias("cell", "mean")))


@query("SELECT p_partkey, CAST(round((p_retailprice - lo) / (hi - lo) * 255) AS INTEGER) AS code FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def quantise_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantised(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "code")


@query("SELECT l_returnflag, count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above, round(avg(greatest(5, least(45, l_quantity))), 6) AS mean FROM lineitem GROUP BY 1")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.clipped(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 5.0, 45.0))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, round(max(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1")
def top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.best_of(read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey", ["p_partkey", "p_retailprice"]))


@query(f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: greatest(CAST(v AS DOUBLE), least(CAST(embedding[65 - i] AS DOUBLE), 0.05)))), 5) AS total FROM embeddings""")
def fused_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.transform("embedding", lambda v: v.cast("double"))
    fused = raster.fused(value, F.reverse(value), F.transform(value, lambda v: F.lit(0.05)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(fused, F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("""
WITH x AS (SELECT p_partkey, p_size * 100 + 37 AS w, p_size * 61 + 500 AS h, CAST(p_size AS DOUBLE) AS s FROM part), y AS (SELECT *, least(1.0, 3000.0 / greatest(w, h)) AS k FROM x)
SELECT p_partkey, greatest(2, CAST(round(w * k / 2) * 2 AS INTEGER)) AS width, greatest(2, CAST(round(h * k / 2) * 2 AS INTEGER)) AS height, round(s * sqrt(36.0 * 36 + 24 * 24) / sqrt(13.2 * 13.2 + 8.8 * 8.8), 6) AS focal,
round(least(140000.0, 1 / (1 / 8.0 + pow(s * 5 / 255, 1.5) * (1 / 0.4 - 1 / 8.0))), 6) AS depth FROM y""")
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    width, height = tr.even_fit(s * 100 + 37, s * 61 + 500, 3000)
    focal = tr.equivalent_focal(s.cast("double"), F.lit(13.2), F.lit(8.8))
    depth = tr.rank_to_depth(s.cast("double") * 5, 0.4, 8.0, 1.5)
    return read(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"), r6(focal).alias("focal"), r6(depth).alias("depth"))


@query("SELECT o_orderkey, (o_orderkey | 2048) & ~16 AS flags, lpad(CAST((o_orderkey | 2048) & ~16 AS VARCHAR), CAST(greatest(9, len(CAST((o_orderkey | 2048) & ~16 AS VARCHAR))) AS INTEGER), '0') AS digits FROM orders")
def flag_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = fl.clear_bits(fl.set_bits(F.col("o_orderkey"), 0x800), 0x10)
    return read(spark, sf_dir, "orders").select("o_orderkey", flags.alias("flags"), fl.padded(flags, F.lit("000000000")).alias("digits"))


@query(r"""
SELECT page_id, NOT contains(path, '/') AND path LIKE '%1' AS leaf, starts_with(path, 'de/') AS german, regexp_matches(path, '(?s)^../.*[0-4]$') AS low FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages)""")
def glob_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    return read(spark, sf_dir, "pages").select("page_id", *(path.rlike(tx.glob_to_regex(g)).alias(n) for n, g in {"german": "de/**", "low": "??/*[0-4]"}.items()), (path.rlike(tx.glob_to_regex("*1")) & ~path.contains("/")).alias("leaf"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT), doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i <= greatest(1, n // 5) THEN 'validation' WHEN i <= 2 * greatest(1, n // 5) THEN 'test' ELSE 'train' END AS split FROM r""")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20/20/60 split by hash order, at least one document in each part: ranks over the whole table, in slices."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(tx.sha256(F.col("doc_id")), 1, 15), 16, 10).cast("long").alias("h"))
    part = max(1, docs.count() // 5)
    place = F.col("rank")
    split = F.when(place <= part, "validation").when(place <= 2 * part, "test").otherwise("train")
    return ranking.numbered(docs.withColumn("all", F.lit(0)), ["all"], ["h", "doc_id"]).select("doc_id", split.alias("split"))


@query("SELECT event_id, value FROM events WHERE event_id % 7 = 0")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event: the sampling is the operator."""
    return ordered.strided(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", 7000, 1000)


@query("""SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.leaves(read(spark, sf_dir, "events"), "event_id", "props")


@query("""SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal, 2) AS VARCHAR) ELSE '0.0' END) = '0.0' AS zeroed, c_acctbal > 0 AS observed FROM customer""")
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing (here: not positive) balance is 0 with mask false."""
    vector, mask = tx.numeric_features(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return read(spark, sf_dir, "customer").select("c_custkey", (vector[0] == 0).alias("zeroed"), mask[0].alias("observed"))


@query()
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = raster.pack_half(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", packed.alias("packed")).withColumn("values", raster.unpack_half(F.col("packed")))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, least(1, l_quantity / 50) AS r, least(1, l_discount * 10) AS g, least(1, l_tax * 10) AS b FROM lineitem), y AS (SELECT *, least(floor(r * 4), 3) / 4 AS lo FROM x)
SELECT l_orderkey, l_linenumber, round(lo * lo + (r - lo) * (2 * lo + 0.25), 6) AS red, round((r + g) / 2, 6) AS green, round(b * g, 6) AS blue FROM y""")
def lut_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax as a colour, through a 5**3 table that mixes its channels; between nodes the square is a chord."""
    grid = [i / 4 for i in range(5)]
    nodes = [(r * r, (r + g) / 2, b * g) for b in grid for g in grid for r in grid]
    read_at = raster.lut_trilinear(5, nodes)
    rgb = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", read_at(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("rgb"))
    return rgb.select("l_orderkey", "l_linenumber", *(r6(F.col("rgb")[i]).alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query()
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of an embedding as points on an 8 x 8 grid, merged where near and alike."""
    long = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("point", "tone"))
    points = long.select("image", "point", (F.col("point") % 8).alias("x"), F.floor(F.col("point") / 8).alias("y"), "tone")
    return regions.merge_regions(points, 1.0, 0.3)


# --- decision tables, small series, graph shapes ---------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'one-to-below-two' WHEN p_size < 30 THEN 'two-to-below-three' WHEN p_size < 60 THEN 'three-to-below-six' ELSE 'six-to-ten' END AS zoom,
CASE WHEN p_size <= 11 THEN CASE WHEN p_retailprice / 30 < 45 THEN 'phone-wide' ELSE 'phone-tele' END WHEN p_size < 28 THEN 'short' ELSE 'long' END AS profile,
CASE WHEN p_partkey % 3 = 0 THEN '444' WHEN p_partkey % 3 = 1 THEN '444' ELSE NULL END AS layout, 'part' || CASE WHEN p_size > 1 THEN '.out (' || p_size || ')' ELSE '.out' END || CASE WHEN p_partkey % 2 = 0 THEN 'MP' ELSE '' END || '.jpg' AS name FROM part""")
def decision_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.element_at(F.array(F.lit("444"), F.lit("422"), F.lit("400")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", dc.zoom_bucket(F.col("p_size") / 10.0).alias("zoom"), dc.lens_profile(F.col("p_size"), F.col("p_retailprice") / 30).alias("profile"),
        dc.resolved_layout(wanted, ["444", "420"], {"422": "444"}).alias("layout"), dc.output_name(F.lit("part"), "out", F.col("p_size"), F.col("p_partkey") % 2 == 0, F.lit("jpg")).alias("name"),
    )


@query("""SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<article') AND contains(html, '<h1') THEN 'headed' END, CASE WHEN contains(html, '<nav') THEN 'menu' END, CASE WHEN contains(html, '<table') THEN 'table' END) AS tags FROM pages""")
def capability_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.capabilities(F.col("html").cast("binary"), {"headed": [b"<article", b"<h1"], "menu": [b"<nav"], "table": [b"<table"]})
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(dc.tags(found), ",").alias("tags"))


@query("""
WITH m AS (SELECT l_orderkey, count(*) AS n, quantile_cont(l_quantity, 0.5) AS median, count(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY 1),
w AS (SELECT l_orderkey, n, median, t, max(abs(l_quantity / median - 1)) AS worst FROM lineitem JOIN m USING (l_orderkey) GROUP BY ALL)
SELECT l_orderkey, n, round(median, 6) AS median, round(worst, 6) AS worst, n BETWEEN 3 AND 128 AND worst <= 0.2 AND t = n AS usable FROM w""")
def series_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.agreement(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity"))


@query("""SELECT vec_id, round(greatest(1.0, list_max(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 5))), 5) AS headroom, round(list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) / 64 / 2, 5) AS coverage,
len(list_filter(embedding, lambda v: v >= 0.1)) >= 16 AS foreground FROM embeddings""")
def sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(stats.headroom(F.transform(wide, lambda v: v * 5)), 5).alias("headroom"), F.round(stats.coverage(F.transform(wide, lambda v: F.abs(v)), 2.0), 5).alias("coverage"),
        dc.has_foreground(wide, 0.1, 16).alias("foreground"),
    )


@query("""
WITH x AS (SELECT o_orderkey AS g, l_linenumber AS o, l_returnflag AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2), a AS (SELECT g, list(t ORDER BY o, t) AS ts FROM x GROUP BY 1)
SELECT g, CASE WHEN len(list_distinct(ts)) <> len(ts) THEN 'repeated' ELSE 'targets' END AS problem FROM a WHERE len(list_distinct(ts)) <> len(ts) OR ts <> ['N', 'A']""")
def graph_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as graphs whose first two lines should be flagged N, then A."""
    edges = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("g"), F.lit("s").alias("s"), F.col("l_linenumber").alias("o"), F.col("l_returnflag").alias("t"))
    return graphs.shape_problems(edges, "g", "s", "t", "o", ["N", "A"])


@query("""
WITH a AS (SELECT l_orderkey AS g, count(*) AS n, count(DISTINCT l_linenumber) AS d, count(DISTINCT l_linestatus) AS c, max(l_linenumber) AS want FROM lineitem GROUP BY 1)
SELECT g, CASE WHEN n <> want THEN 'count' WHEN d <> n THEN 'repeated' ELSE 'config' END AS problem FROM a WHERE n <> want OR d <> n OR c > 1""")
def tile_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", F.lit(1).alias("one"), "l_linestatus")
    return graphs.tile_problems(lines, "g", "l_linenumber", "l_linenumber", "one", "l_linestatus")


@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY o_custkey NULLS FIRST, d) - 1 AS at_, d FROM (SELECT o_custkey, sha256(len(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || len(o_orderstatus) || ':' || o_orderstatus) AS d FROM orders)),
x AS (SELECT at_ // 4096 AS at_, sha256(string_agg(d, '' ORDER BY at_)) AS d FROM r GROUP BY 1), y AS (SELECT at_ // 4096 AS at_, sha256(string_agg(d, '' ORDER BY at_)) AS d FROM x GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY at_)) AS digest FROM y""")
def plan_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.plan_digest(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


@query("""
WITH e AS (SELECT quantile_cont(l_quantity, 0.02) AS lo, quantile_cont(l_quantity, 0.98) AS hi FROM lineitem), b AS (SELECT CAST(greatest(0, least(15, floor((l_quantity - lo) / (hi - lo) * 16))) AS INTEGER) AS bin, l_extendedprice AS y FROM lineitem, e)
SELECT bin, count(*) AS n, round(quantile_cont(y, 0.5), 6) AS median FROM b GROUP BY 1""")
def bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("all", F.lit(1))
    return rounded(stats.bin_medians(lines, ["all"], "l_quantity", "l_extendedprice", 16).drop("all"))
