"""The recording queries over the `events`, `lineitem` and `part` tables, each with the equivalent DuckDB SQL.

`events` is viewed as a recording: a run per user, the axis in microseconds since the first record, ties broken by
event_id, value as numeric field, event_type as categorical field, props as event text, value guarded by purchases as a
guarded field, a frame per run and day, a segment per week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import axis, bits, conversions
from .functions.axis import Buckets
from .model import Field, Schema
from .operators import decimate, index, records
from .plans import storage, tiers
from .sources import container, convert, dbc

DAY = 86_400_000_000
#: The window that the queries show.
START, END = 2 * DAY, 25 * DAY


def epoch(spark: SparkSession, sf_dir: str) -> int:
    """The file epoch: one aggregate, so that all plans carry it as a literal."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(axis.utc_micros(F.col("ts")))).first()[0] or 0


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = axis.utc_micros(F.col("ts")) - F.lit(epoch(spark, sf_dir))
    rows = events.select(F.col("user_id").alias("run_id"), at.alias("axis"), F.col("event_id").alias("seq"), conversions.finite(F.col("value")).alias("value"), F.col("event_type").alias("state"), F.col("props").alias("text"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"))
    return rows.withColumns({"frame": F.floor(F.col("axis") / DAY), "segment": F.floor(F.col("axis") / (7 * DAY))})


REC = f"""rec AS (
  SELECT user_id AS run_id, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS axis, event_id AS seq, value, event_type AS state, props AS text,
         CASE WHEN event_type = 'purchase' THEN value END AS amount,
         (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {DAY} AS frame, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {7 * DAY} AS segment
  FROM events
)"""
STATS = """stats AS (
  SELECT segment, run_id, frame, count(*)::BIGINT AS "count", arg_min(axis, (axis, seq)) AS first, arg_max(axis, (axis, seq)) AS last,
         count({v})::BIGINT AS n_present, min({v}) AS low, max({v}) AS high,
         arg_min({v}, (axis, seq)) FILTER ({v} IS NOT NULL) AS first_value, arg_max({v}, (axis, seq)) FILTER ({v} IS NOT NULL) AS last_value
  FROM rec GROUP BY segment, run_id, frame
)"""


def _share(start: int, end: int, n: int, x: str = "axis") -> str:
    return f"CASE WHEN {x} >= {start} THEN least({n - 1}, floor((({x}) - {start})::DOUBLE / {float(end - start)}::DOUBLE * {n})::INT) END"


def _centre(start: int, end: int, n: int, b: str = "bucket") -> str:
    edge = lambda b: f"({float(start)}::DOUBLE + (({b})::DOUBLE / {float(n)}::DOUBLE) * {float(end - start)}::DOUBLE)"
    return f"(({edge(b)}) + ({edge(b + ' + 1')})) / 2"


def _envelope_sql(value: str, keys: str, where: str, start: int, end: int, n: int) -> str:
    on = " AND ".join(f"s.{k} = b.{k}" for k in keys.split(", "))
    return f"""WITH {REC}, found AS (SELECT {keys}, {value} AS v, {_share(start, end, n)} AS bucket FROM rec WHERE axis BETWEEN {start} AND {end} AND {where}),
b AS (SELECT {keys}, bucket, min(v) AS min, max(v) AS max, count(v)::BIGINT AS n FROM found GROUP BY {keys}, bucket),
s AS (SELECT {keys}, unnest(range({n}))::INT AS bucket FROM (SELECT DISTINCT {keys} FROM b))
SELECT {', '.join('s.' + k for k in keys.split(', '))}, s.bucket, {_centre(start, end, n, 's.bucket')} AS x, b.min, b.max, coalesce(b.n, 0)::BIGINT AS n"""  + f" FROM s LEFT JOIN b ON {on} AND s.bucket = b.bucket"


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(_envelope_sql("value", "run_id", "true", START, END, 50).replace(" AS n FROM s", " AS n, 'exact' AS tier FROM s"))
def run_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.bucketed(recording(spark, sf_dir), ["run_id"], Buckets(START, END, 50)).withColumn("tier", F.lit("exact"))


@query(_envelope_sql("amount", "run_id", "true", START, END, 50))
def envelope_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.bucketed(recording(spark, sf_dir), ["run_id"], Buckets(START, END, 50), "amount")


@query(f"WITH {REC} SELECT run_id, axis::DOUBLE AS x, amount AS min, amount AS max, count(amount) OVER (PARTITION BY seq) AS n FROM rec WHERE axis BETWEEN {START} AND {END}")
def run_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.samples(recording(spark, sf_dir), ["run_id"], START, END, "amount")


@query("""WITH f AS (SELECT p_brand AS run_id, p_retailprice AS v, CASE WHEN p_retailprice >= 900 THEN least(9, floor((log10(p_retailprice) - 2.9542425094393248::DOUBLE) / (3.3010299956639813::DOUBLE - 2.9542425094393248::DOUBLE) * 10)::INT) END AS bucket
  FROM part WHERE p_retailprice BETWEEN 900 AND 2000),
b AS (SELECT run_id, bucket, min(v) AS min, max(v) AS max, count(v)::BIGINT AS n FROM f GROUP BY run_id, bucket),
s AS (SELECT run_id, unnest(range(10))::INT AS bucket FROM (SELECT DISTINCT run_id FROM b))
SELECT s.run_id, s.bucket, min, max, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN b ON s.run_id = b.run_id AND s.bucket = b.bucket""")
def envelope_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("run_id"), F.col("p_retailprice").alias("axis"), F.col("p_retailprice").alias("value"))
    return decimate.bucketed(part, ["run_id"], Buckets(900, 2000, 10, "log")).drop("x")


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT *, coalesce(low <> high, false) AS several FROM stats")
def tier1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frame_stats(recording(spark, sf_dir), F.col("value"))


@query(f"WITH {REC}, {STATS.format(v='amount')} SELECT *, coalesce(low <> high, false) AS several FROM stats")
def tier1_stats_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frame_stats(recording(spark, sf_dir), F.col("amount"))


@query(f"WITH {REC}, {STATS.format(v='text')} SELECT segment, run_id, frame, \"count\", first, last, n_present FROM stats")
def presence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frame_stats(recording(spark, sf_dir), F.col("text"), bounds=False)


def _spans_sql(n: int) -> str:
    return f"""spans AS (SELECT run_id, low, high, n_present, {_share(START, END, n, 'first')} AS a, {_share(START, END, n, 'last')} AS b FROM stats WHERE n_present > 0 AND last >= {START} AND first <= {END}),
ord AS (SELECT run_id, low, high, n_present, least(coalesce(a, 0), coalesce(b, {n - 1})) AS lo, greatest(coalesce(a, 0), coalesce(b, {n - 1})) AS hi FROM spans WHERE a IS NOT NULL OR b IS NOT NULL),
spread AS (SELECT run_id, low, high, greatest(1, n_present // (hi - lo + 1)) AS share, unnest(range(lo, hi + 1))::INT AS bucket FROM ord),
b AS (SELECT run_id, bucket, min(low) AS min, max(high) AS max, sum(share)::BIGINT AS n FROM spread GROUP BY run_id, bucket)"""


@query(f"""WITH {REC}, {STATS.format(v='value')}, {_spans_sql(50)}, s AS (SELECT run_id, unnest(range(50))::INT AS bucket FROM (SELECT DISTINCT run_id FROM b))
SELECT s.run_id, s.bucket, {_centre(START, END, 50, 's.bucket')} AS x, b.min, b.max, coalesce(b.n, 0)::BIGINT AS n FROM s LEFT JOIN b ON s.run_id = b.run_id AND s.bucket = b.bucket""")
def envelope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.overlapping(index.frame_stats(recording(spark, sf_dir), F.col("value")), START, END)
    return decimate.from_stats(stats.withColumnsRenamed({"low": "min", "high": "max"}), ["run_id"], Buckets(START, END, 50))


@query("SELECT 0::BIGINT AS violations")
def envelope_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a bucket of the exact envelope exceeds the one made of statistics: never."""
    exact, wide = run_overlay(spark, sf_dir), envelope_stats(spark, sf_dir)
    both = exact.where("n > 0").select("run_id", "bucket", F.col("min").alias("low"), F.col("max").alias("high")).join(wide.select("run_id", "bucket", "min", "max"), ["run_id", "bucket"], "left")
    return both.agg(F.count_if(F.coalesce((F.col("min") > F.col("low")) | (F.col("max") < F.col("high")), F.lit(True))).alias("violations"))


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT run_id, min(first) AS first, max(last) AS last, sum(\"count\")::BIGINT AS records FROM stats GROUP BY run_id")
def stream_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.span(index.frame_index(recording(spark, sf_dir)))


@query("SELECT min(epoch_us(ts)) AS epoch, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS last_tick FROM events")
def epoch_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = axis.utc_micros(F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(at).alias("epoch"), (F.max(at) - F.min(at)).alias("last_tick"))


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT segment, run_id, frame, \"count\", first, last FROM stats WHERE last >= {START} AND first <= {END}")
def run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.overlapping(index.frame_index(recording(spark, sf_dir)), START, END)


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT segment, count(*)::BIGINT AS frames, sum(\"count\")::BIGINT AS records, count(DISTINCT run_id)::BIGINT AS runs, max(last) AS last FROM stats GROUP BY segment")
def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.segment_totals(index.frame_index(recording(spark, sf_dir)))


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT sum(\"count\")::BIGINT AS total, bool_and(first >= {START} AND last <= {END}) AS total_exact, count(*)::BIGINT AS frames FROM stats WHERE last >= {START} AND first <= {END}")
def window_count_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.window_count(index.frame_index(recording(spark, sf_dir)), START, END)


def _rle_sql(where: str = "true") -> str:
    return f"""w AS (SELECT * FROM rec WHERE axis BETWEEN {START} AND {END} AND {where}),
f AS (SELECT *, state IS DISTINCT FROM lag(state) OVER o OR row_number() OVER o = 1 AS begins FROM w WINDOW o AS (PARTITION BY run_id ORDER BY axis, seq))
SELECT run_id, (row_number() OVER o)::INT AS run_no, axis AS x0, coalesce(lead(axis) OVER o, {END}) AS x1, state AS raw, state IS NULL AS absent FROM f WHERE begins WINDOW o AS (PARTITION BY run_id ORDER BY axis, seq)"""


@query(f"WITH {REC}, {_rle_sql()}")
def states_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.states(recording(spark, sf_dir), ["run_id"], START, END, "state", "frame")


@query(f"""WITH {REC}, w AS (SELECT run_id, state, {_share(START, END, 40)} AS bucket FROM rec WHERE axis BETWEEN {START} AND {END}),
b AS (SELECT run_id, bucket, min(state) AS low, max(state) AS high FROM w WHERE state IS NOT NULL GROUP BY run_id, bucket),
s AS (SELECT run_id, unnest(range(40))::INT AS bucket FROM (SELECT DISTINCT run_id FROM w))
SELECT s.run_id, s.bucket, {float(START)}::DOUBLE + s.bucket::DOUBLE / 40.0::DOUBLE * {float(END - START)}::DOUBLE AS x0, {float(START)}::DOUBLE + (s.bucket + 1)::DOUBLE / 40.0::DOUBLE * {float(END - START)}::DOUBLE AS x1,
  CASE WHEN low = high THEN low END AS raw, coalesce(low <> high, false) AS mixed, low IS NULL AS absent FROM s LEFT JOIN b ON s.run_id = b.run_id AND s.bucket = b.bucket""")
def states_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.states_bucketed(recording(spark, sf_dir), ["run_id"], Buckets(START, END, 40), "state")


@query(f"""WITH {REC}, {STATS.format(v='state')}, bands AS (SELECT run_id, frame, greatest(first, {START}) AS x0, least(last, {END}) AS x1, n_present = 0 AS absent, n_present > 0 AND low <> high AS mixed, CASE WHEN low = high THEN low END AS raw FROM stats),
k AS (SELECT *, CASE WHEN (absent, mixed, raw) IS DISTINCT FROM lag((absent, mixed, raw)) OVER o THEN 1 ELSE 0 END AS changed FROM bands WHERE x1 >= x0 WINDOW o AS (PARTITION BY run_id ORDER BY x0, frame)),
n AS (SELECT *, sum(changed) OVER (PARTITION BY run_id ORDER BY x0, frame ROWS UNBOUNDED PRECEDING) AS band FROM k)
SELECT run_id, band::BIGINT AS band, min(x0) AS x0, arg_max(x1, (x0, frame)) AS x1, any_value(raw) AS raw, bool_or(mixed) AS mixed, bool_or(absent) AS absent FROM n GROUP BY run_id, band""")
def states_from_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.states_from_stats(index.frame_stats(recording(spark, sf_dir), F.col("state")), ["run_id"], START, END)


@query(f"WITH {REC} SELECT run_id, axis, seq, text FROM rec WHERE text IS NOT NULL AND axis BETWEEN {START} AND {END}")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.exact_events(recording(spark, sf_dir), "text", START, END)


@query(f"WITH {REC}, {STATS.format(v='amount')} SELECT run_id, greatest(first, {START}) AS x0, least(last, {END}) AS x1, n_present AS n FROM stats WHERE n_present > 0 AND last >= {START} AND first <= {END}")
def events_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.event_density(index.frame_stats(recording(spark, sf_dir), F.col("amount"), bounds=False), ["run_id"], START, END)


@query(f"WITH {REC} SELECT segment, run_id, frame, axis, seq, value, state FROM rec WHERE axis BETWEEN {START} AND {END} ORDER BY segment, run_id, frame, axis, seq LIMIT 200 OFFSET 1500")
def record_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recording(spark, sf_dir)
    page = records.record_page(rows, index.frame_index(rows), START, END, 1500, 200)
    return page.select("segment", "run_id", "frame", "axis", "seq", "value", "state")


@query(f"WITH {REC}, {STATS.format(v='value')}, t AS (SELECT sum(\"count\")::BIGINT AS total, bool_and(first >= {START} AND last <= {END}) AS total_exact FROM stats WHERE last >= {START} AND first <= {END}) SELECT (SELECT count(*) FROM rec WHERE axis BETWEEN {START} AND {END}) > 1700 AS more, total, total_exact FROM t")
def record_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the page of record_page."""
    rows = recording(spark, sf_dir)
    info = records.page_info(rows, index.frame_index(rows), START, END, 1500, 200)
    return spark.createDataFrame([(info.more, info.total, info.total_exact)], "more boolean, total long, total_exact boolean")


@query(f"WITH {REC} SELECT run_id, seq, amount, amount IS NOT NULL AS present FROM rec")
def guard_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).select("run_id", "seq", "amount", F.col("amount").isNotNull().alias("present"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))


ITEM = "l_orderkey, l_linenumber"


@query(f"SELECT {ITEM}, -40.0::DOUBLE + 0.25::DOUBLE * l_quantity AS y FROM lineitem")
def conv_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.linear(F.col("x"), -40, 0.25).alias("y"))


@query(f"SELECT {ITEM}, CASE WHEN l_quantity <> 10 THEN (l_quantity * l_quantity + 2 * l_quantity + 3) / (l_quantity - 10) END AS y FROM lineitem")
def conv_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.rational(F.col("x"), (1, 2, 3, 0, 1, -10)).alias("y"))


@query(f"SELECT {ITEM}, CASE WHEN l_quantity >= 40 THEN 9.0 WHEN l_quantity >= 20 THEN 4.0 WHEN l_quantity >= 10 THEN 2.0 ELSE 1.0 END::DOUBLE AS y FROM lineitem")
def conv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.table(F.col("x"), [5, 10, 20, 40], [1, 2, 4, 9]).alias("y"))


@query(f"SELECT {ITEM}, CASE WHEN l_quantity >= 40 THEN 9.0::DOUBLE WHEN l_quantity >= 20 THEN 4.0::DOUBLE + (l_quantity - 20) * 5.0::DOUBLE / 20.0::DOUBLE WHEN l_quantity >= 10 THEN 2.0::DOUBLE + (l_quantity - 10) * 2.0::DOUBLE / 10.0::DOUBLE ELSE 2.0::DOUBLE END AS y FROM lineitem")
def conv_table_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.table_interpolated(F.col("x"), [10, 20, 40], [2, 4, 9]).alias("y"))


@query(f"SELECT {ITEM}, CASE l_linenumber WHEN 1 THEN 'P' WHEN 2 THEN 'R' WHEN 3 THEN 'N' ELSE '?' END AS y FROM lineitem")
def conv_value_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.value_to_text(F.col("l_linenumber"), [(1, "P"), (2, "R"), (3, "N"), (1, "again")], "?").alias("y"))


@query(f"SELECT {ITEM}, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 30 THEN 'mid' ELSE 'high' END AS y FROM lineitem")
def conv_range_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", "l_linenumber", conversions.range_to_text(F.col("x"), [(0, 10, "low"), (10, 30, "mid")], "high").alias("y"))


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bytes a record, most significant first, made of event_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return events.withColumn("record", F.unhex(F.lpad(F.hex(F.col("event_id") * 2_654_435_761 % 9_007_199_254_740_881), 16, "0")))


PACKED = "(event_id * 2654435761 % 9007199254740881)"


@query(f"SELECT event_id, (({PACKED} >> 13) & 4095)::BIGINT AS v FROM events")
def bits_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("event_id", bits.bit_slice(F.col("record"), 39, 12, True).alias("v"))


@query(f"SELECT event_id, ((((({PACKED} >> 16) & 255) << 8 | (({PACKED} >> 24) & 255)) >> 3) & 2047)::BIGINT AS v FROM (SELECT event_id FROM events)".replace("<< 8 |", "|").replace(f"((({PACKED} >> 16) & 255) | (({PACKED} >> 24) & 255))", f"((({PACKED} >> 24) & 255) | ((({PACKED} >> 16) & 255) << 8))"))
def bits_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("event_id", bits.bit_slice(F.col("record"), 35, 11).alias("v"))


@query(f"SELECT event_id, (CASE WHEN ({PACKED} & 4095) >= 2048 THEN ({PACKED} & 4095) - 4096 ELSE {PACKED} & 4095 END)::BIGINT AS v FROM events")
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("event_id", bits.sign_extend(bits.bit_slice(F.col("record"), 52, 12, True), 12).alias("v"))


@query("SELECT event_id, 1000 + event_id * 250 AS tick FROM events")
def axis_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", axis.implicit_axis(F.lit(1000).cast("long"), F.col("event_id"), 250).alias("tick"))


@query("SELECT event_id, 500 + user_id * 1000 AS tick FROM events")
def axis_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", axis.explicit_axis(F.lit(500).cast("long"), F.col("user_id"), 1000).alias("tick"))


@query("SELECT event_id, round(10.0::DOUBLE * pow(1.0471285480508996::DOUBLE, event_id % 250), 6) AS x FROM events")
def axis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = axis.log_axis(F.lit(10.0), F.col("event_id") % 250, 1.0471285480508996)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(x, 6).alias("x"))


@query("SELECT CASE WHEN round(event_id * 0.5::DOUBLE) IS NULL THEN 0 ELSE event_id END AS event_id, round(value * 1000)::BIGINT AS ticks FROM events WHERE value IS NOT NULL")
def seconds_to_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL").select("event_id", axis.seconds_to_ticks(F.col("value"), -3).alias("ticks"))


#: A message dimension of three rows: key, name, factor and offset of its one signal.
MESSAGES = [(3, "Engine", 0.25, 0.0), (11, "Vehicle", 0.5, -40.0), (4_294_967_301, "Extended", 2.0, 1.0)]


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", bits.can_key(F.col("user_id"), F.col("event_type") == "purchase").alias("can_key"), "value")


FRAMES = "f AS (SELECT event_id, user_id + CASE WHEN event_type = 'purchase' THEN 4294967296 ELSE 0 END AS can_key, value FROM events), m(can_key, message, factor, shift) AS (VALUES (3, 'Engine', 0.25::DOUBLE, 0.0::DOUBLE), (11, 'Vehicle', 0.5, -40.0), (4294967301, 'Extended', 2.0, 1.0))"


@query(f"WITH {FRAMES} SELECT event_id, message, shift + factor * value AS physical FROM f JOIN m USING (can_key)")
def can_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.createDataFrame(MESSAGES, "can_key long, message string, factor double, shift double")
    return _frames(spark, sf_dir).join(F.broadcast(messages), "can_key").select("event_id", "message", (F.col("shift") + F.col("factor") * F.col("value")).alias("physical"))


@query(f"WITH {FRAMES} SELECT can_key, count(*)::BIGINT AS frames FROM f WHERE can_key NOT IN (SELECT can_key FROM m) GROUP BY can_key")
def can_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.createDataFrame(MESSAGES, "can_key long, message string, factor double, shift double")
    return _frames(spark, sf_dir).join(F.broadcast(messages), "can_key", "left_anti").groupBy("can_key").agg(F.count("*").alias("frames"))


@query("SELECT s AS start_bit, (8 * (s // 8) + 7 - s % 8)::BIGINT AS \"offset\" FROM range(64) t(s)")
def dbc_bit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("start_bit"), bits.motorola_offset(F.col("id")).alias("offset"))


@query("SELECT 0 AS file_seq, user_id AS run_id, count(*)::BIGINT AS records FROM events WHERE event_id % 2 = 0 GROUP BY user_id UNION ALL SELECT 1, user_id, count(*)::BIGINT FROM events WHERE event_id % 2 = 1 GROUP BY user_id")
def concat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files one after the other: streams merge by identity, segments are numbered on."""
    rows = recording(spark, sf_dir)
    first, second = (rows.where(F.col("seq") % 2 == k).withColumn("file_seq", F.lit(k)) for k in (0, 1))
    return first.unionByName(second).groupBy("file_seq", "run_id").agg(F.count("*").alias("records"))


@query(f"WITH {REC}, {STATS.format(v='value')} SELECT segment, run_id, frame, \"count\", first, last FROM stats")
def growth_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first weeks, extended from its last segment on, equals that of the whole recording."""
    rows = recording(spark, sf_dir)
    cached = index.frame_index(rows.where("segment < 3 OR segment = 3 AND seq % 3 = 0"))
    return index.grown(cached, index.frame_index(rows.where("segment >= 3")), 3)


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS axis, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS before FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, axis, (sum(CASE WHEN axis < before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, axis ROWS UNBOUNDED PRECEDING))::BIGINT AS run_no FROM p")
def run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("axis"))
    return decimate.detect_runs(points, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice", "axis"]).drop("l_extendedprice")


@query(f"WITH {REC} SELECT state, count(*)::BIGINT AS records, count(DISTINCT run_id)::BIGINT AS runs, min(axis) AS first, max(axis) AS last FROM rec GROUP BY state")
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).groupBy("state").agg(F.count("*").alias("records"), F.countDistinct("run_id").alias("runs"), F.min("axis").alias("first"), F.max("axis").alias("last"))


def _container(spark: SparkSession, sf_dir: str) -> tuple[str, Schema]:
    """The events as a recording file set: id, user and value as fields, microseconds as implicit axis of one-record frames' bases."""
    schema = Schema("6f1c2a52-7b0e-5d5f-9d55-3f1f0f6f3a01", "events", 160, (Field("event_id", 0, 32), Field("user_id", 32, 24, big_endian=True), Field("purchase", 56, 1, "bool"), Field("value", 64, 64, "float", guard=(2, 1)), Field("at", 128, 32)), axis_mode="explicit", axis_exp=-6, axis_unit="s", axis_step=0, axis_scale=1, axis_field=4)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = (axis.utc_micros(F.col("ts")) - F.lit(epoch(spark, sf_dir))) / 1_000_000
    rows = events.select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("purchase"), "value", F.floor(at).alias("at"), F.lit(0).cast("long").alias("axis"), F.lit(0).cast("long").alias("run_id"))
    path = storage.scratch(spark, "recording")
    container.write_values(rows, path, schema)
    return path, schema


@query("SELECT event_id, user_id, event_type = 'purchase' AS purchase, CASE WHEN event_type = 'purchase' THEN value END AS value, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 AS axis FROM events")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a container, read back and decoded, guard included."""
    path, schema = _container(spark, sf_dir)
    return container.decode(container.read(spark, path), schema).select("event_id", "user_id", "purchase", "value", "axis")


@query("SELECT 'DATA' AS type, count(*)::BIGINT AS records FROM events")
def index_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _container(spark, sf_dir)
    return container.read(spark, path, "frames").where("type = 'DATA'").groupBy("type").agg(F.sum("count").alias("records"))


@query("SELECT user_id, min(value) AS low, max(value) AS high, count(*)::BIGINT AS n FROM events WHERE event_type = 'purchase' AND (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 BETWEEN 172800 AND 604800 GROUP BY user_id")
def zoom_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a container, by user; only the fields that it names are decoded."""
    path, schema = _container(spark, sf_dir)
    rows = container.decode(container.read(spark, path), schema).where("axis BETWEEN 172800 AND 604800")
    return rows.where("value IS NOT NULL").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS bought, value, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 1000000 AS pos FROM events)
SELECT 'event_id' AS field, count(*)::BIGINT AS n, min(event_id)::DOUBLE AS low, max(event_id)::DOUBLE AS high FROM e
UNION ALL SELECT 'user_id', count(*)::BIGINT, min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM e
UNION ALL SELECT 'purchase', count(*)::BIGINT, min(bought::INT)::DOUBLE, max(bought::INT)::DOUBLE FROM e
UNION ALL SELECT 'value', count(value)::BIGINT, min(value), max(value) FROM e WHERE bought
UNION ALL SELECT 'at', count(*)::BIGINT, min(pos)::DOUBLE, max(pos)::DOUBLE FROM e""")
def kept_index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a container from its kept index, opened again: no frame is read."""
    path, _ = _container(spark, sf_dir)
    at = storage.scratch(spark, "index")
    storage.open_index(spark, path, at)
    frames, kept = storage.open_index(spark, path, at)
    if not kept:
        raise ValueError("the index of an unchanged recording has to answer")
    fields = frames.select(F.explode("fields").alias("f")).select("f.*")
    return fields.groupBy("field").agg(F.sum("n_present").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(ORACLE_SQL["zoom_container"])
def kept_index_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a container by its kept index: frames outside it aren't read, each other one by its place."""
    path, schema = _container(spark, sf_dir)
    frames, _ = storage.open_index(spark, path, storage.scratch(spark, "index"))
    rows = storage.window(frames, schema.uuid, 172_800, 604_800)
    return rows.where("value IS NOT NULL").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(((axis.utc_micros(F.col("ts")) - F.lit(epoch(spark, sf_dir))) / 1_000_000).alias("t"), "event_id", "value")


def _micros(schema: Schema) -> Column:
    return F.round(axis.ticks_to_seconds(F.col("axis"), schema.axis_exp) * 1_000_000).cast("long").alias("micros")


TIMED = "SELECT event_id, value, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS micros FROM events"


@query(TIMED)
def mdf4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as MDF4 files, turned into a container with ticks as axis, and decoded; absent values by their invalidation bits."""
    path, out = storage.scratch(spark, "mdf4"), storage.scratch(spark, "recording")
    fixtures.write_mdf4(_timed(spark, sf_dir), path)
    convert.mdf4_to_container(spark, path, out, ticks=True)
    schema = container.stream_schema(spark, out)
    return container.decode(container.read(spark, out), schema).select(F.col("event_id").cast("long").alias("event_id"), "value", _micros(schema))


@query(TIMED)
def spice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as simulator raw files, turned into a container with ticks as axis, and decoded."""
    path, out = storage.scratch(spark, "spice"), storage.scratch(spark, "recording")
    fixtures.write_spice(_timed(spark, sf_dir), path)
    schema = convert.spice_to_container(spark, path, out, ticks=True)
    rows = container.decode(container.read(spark, out), schema)
    return rows.select(F.col("V(event_id)").cast("long").alias("event_id"), F.col("I(value)").alias("value"), _micros(schema))


DATABASE = '''BO_ 3 Engine: 8 X
 SG_ Speed : 7|16@0+ (0.25,0) [0|1] "rpm" X
 SG_ Kind M : 16|2@1+ (1,0) [0|3] "" X
 SG_ Heat m1 : 24|12@1- (0.1,-40) [0|1] "degC" X
BO_ 11 Vehicle: 8 X
 SG_ Gear : 60|4@1+ (1,0) [0|15] "" X
VAL_ 11 Gear 0 "P" 1 "R" 2 "N" ;
'''
_B = [f"(({PACKED} >> {56 - 8 * i}) & 255)" for i in range(8)]


@query(f"""WITH b AS (SELECT event_id, user_id, {", ".join(f"{x} AS b{i}" for i, x in enumerate(_B))} FROM events WHERE user_id IN (3, 11))
SELECT event_id, 'Engine' AS message, 'Speed' AS signal, 0.25::DOUBLE * (b0 * 256 + b1) AS value, NULL::VARCHAR AS text FROM b WHERE user_id = 3
UNION ALL SELECT event_id, 'Engine', 'Kind', (b2 & 3)::DOUBLE, NULL FROM b WHERE user_id = 3
UNION ALL SELECT event_id, 'Engine', 'Heat', -40.0::DOUBLE + 0.1::DOUBLE * (CASE WHEN (b3 + (b4 & 15) * 256) >= 2048 THEN b3 + (b4 & 15) * 256 - 4096 ELSE b3 + (b4 & 15) * 256 END), NULL FROM b WHERE user_id = 3 AND (b2 & 3) = 1
UNION ALL SELECT event_id, 'Vehicle', 'Gear', (b7 >> 4)::DOUBLE, CASE b7 >> 4 WHEN 0 THEN 'P' WHEN 1 THEN 'R' WHEN 2 THEN 'N' END FROM b WHERE user_id = 11""")
def dbc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus frames decoded against a message database: multiplexed, signed and labelled signals."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    frames = events.withColumn("payload", F.unhex(F.lpad(F.hex(F.col("event_id") * 2_654_435_761 % 9_007_199_254_740_881), 16, "0")))
    frames = frames.select("event_id", F.col("user_id").alias("can_id"), F.lit(False).alias("extended"), "payload")
    return dbc.decode_frames(frames, dbc.parse(DATABASE)).select("event_id", "message", "signal", "value", "text")


@query("SELECT user_id AS run_id, count(*)::BIGINT AS records, sum(value) AS total FROM events WHERE user_id > (SELECT min(user_id) FROM events) GROUP BY user_id")
def container_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of a segment per run and task, of which the segments of the least run are damaged: all others are read whole."""
    path, schema = storage.scratch(spark, "damaged"), Schema("6e9f2f0e-0a52-4d8e-9b0c-2f5a1c3d7e11", "values", 64, (Field("value", 0, 64, "float"),), axis_mode="implicit", axis_step=0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).cast("long").alias("axis"), F.col("user_id").alias("run_id"), "value", "event_id")
    rows = rows.repartitionByRange("run_id", "event_id")  # a run is in few tasks, so that segments don't grow with runs times tasks; a large one is in several
    container.write_values(rows, path, schema, segmentFrames=1)
    frames = container.read(spark, path, "frames").where("type = 'DATA'")
    least = frames.agg(F.min("run_id")).first()[0]
    for r in frames.where(F.col("run_id") == F.lit(least)).groupBy("file").agg(F.collect_list("frame_offset").alias("at")).collect():
        container.overwrite_bytes(r.file, r.at, 20)
    return container.decode(container.read(spark, path, splitBytes=4096), schema).groupBy("run_id").agg(F.count("*").alias("records"), F.sum("value").alias("total"))


@query(f"SELECT run_id, x, min, max, n, 'stats' AS tier, false AS exact FROM ({ORACLE_SQL['envelope_stats']})")
def tier_choice_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More frames than may be decoded: the envelope comes from statistics."""
    rows = recording(spark, sf_dir)
    return tiers.envelope(rows, index.frame_stats(rows, F.col("value")), START, END, 50, most_frames=0)


@query(f"SELECT run_id, x, min, max, n, 'exact' AS tier, false AS exact FROM ({ORACLE_SQL['run_overlay']})")
def tier_choice_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few enough frames, more samples than points: the envelope of the samples."""
    rows = recording(spark, sf_dir)
    return tiers.envelope(rows, index.frame_stats(rows, F.col("value")), START, END, 50, most_frames=1 << 40)


@query(f"SELECT run_id, x0, x1, raw, mixed, absent, 'stats' AS tier FROM ({ORACLE_SQL['states_from_stats']})")
def tier_choice_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recording(spark, sf_dir)
    return tiers.states(rows, index.frame_stats(rows, F.col("state")), START, END, most_frames=0)


@query(f"SELECT * FROM ({ORACLE_SQL['events_density']})")
def tier_choice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recording(spark, sf_dir)
    return tiers.events(rows, index.frame_stats(rows, F.col("amount"), bounds=False), START, END, text="amount", most_frames=0)[0]
