"""The driver's tables bound to the canonical frames, in Spark and in SQL.

The limits and rules apply to the numbers as they stand; the tables have no
clinical meaning.  Every frame covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalars import bmi, elapsed_days, floor_div, week_index
from cohortflow.operators.cgm import daily_summary
from cohortflow.sources.tables import load

# Fixed values of the bindings.
ORIGIN = "2024-01-01"
PER_DAY = 3
MIN_VALID = 10


def readings(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "events").select(
        F.col("user_id").alias("patient_id"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("device_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.nanvl("value", F.lit(None)).alias("glucose"),
        F.col("event_id").alias("reading_id"),
    )


def anchors(spark: SparkSession, base: str) -> DataFrame:
    signups = load(spark, base, "events", ["user_id", "ts"], F.col("event_type") == "signup")
    return signups.groupBy(F.col("user_id").alias("patient_id")).agg(
        F.min(F.col("ts").cast("timestamp")).alias("enroll_ts")
    )


def daily(spark: SparkSession, base: str) -> DataFrame:
    return daily_summary(readings(spark, base))


def time_key(*before: Column) -> Column:
    """Time of day to the microsecond; readings of one instant but the first add their id."""
    same = Window.partitionBy("patient_id", "ts").orderBy("reading_id")
    text = F.concat_ws(" ", *before, F.date_format("ts", "HH:mm:ss.SSSSSS"))
    later = F.concat_ws("_", text, F.col("reading_id").cast("string"))
    return F.when(F.row_number().over(same) == 1, text).otherwise(later)


def per_key(df: DataFrame, keys: list[str | Column], time: Column, value: Column) -> DataFrame:
    """Maps from time keys to values, one entry per reading."""
    rows = df.select(*keys, time.alias("k"), value.alias("v"))
    names = [c for c in rows.columns if c not in ("k", "v")]
    return rows.groupBy(*names).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("daily_data")
    )


def day_maps(spark: SparkSession, base: str) -> DataFrame:
    rows = readings(spark, base).withColumn("date", F.to_date("ts"))
    maps = per_key(rows, ["patient_id", "date"], time_key(), F.col("glucose"))
    record = F.concat_ws("_", F.col("patient_id").cast("string"), F.col("date").cast("string"))
    return maps.select(record.alias("id"), "patient_id", "date", "daily_data")


def day_map_text(spark: SparkSession, base: str) -> DataFrame:
    """Day maps as text: JSON for odd patients, Python literals with None for even ones.

    Readings under 1.1 are written as missing, so both forms hold NULL entries.
    """
    maps = day_maps(spark, base)
    python = F.col("patient_id") % 2 == 0
    quote = F.when(python, "'").otherwise('"')
    none = F.when(python, "None").otherwise("null")
    entries = F.transform(
        F.map_entries("daily_data"),
        lambda e: F.concat(
            quote,
            e["key"],
            quote,
            F.lit(": "),
            F.when(e["value"] < 1.1, none).otherwise(e["value"].cast("string")),
        ),
    )
    text = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    return maps.select("id", "patient_id", "date", text.alias("daily_data"))


# Two versions of the same records: each side lacks some readings and the new one
# has other values, by fixed rules on the ids, so that every kind of change occurs.


def _week_records(spark: SparkSession, base: str) -> DataFrame:
    rows = readings(spark, base).withColumn("day", elapsed_days(F.lit(ORIGIN), F.col("ts")))
    d = F.pmod("day", F.lit(7))
    return rows.withColumn("week", week_index("day")).withColumn("d", d)


def _snapshot(rows: DataFrame, value: Column) -> DataFrame:
    key = time_key(F.col("d").cast("string"))
    record = F.concat_ws("_", F.col("patient_id").cast("string"), F.col("week").cast("string"))
    return per_key(rows, [record.alias("id")], key, value)


def snap_old(spark: SparkSession, base: str) -> DataFrame:
    rows = _week_records(spark, base).where(
        (F.col("reading_id") % 11 != 0) & ~((F.col("d") >= 4) & (F.col("patient_id") % 5 == 0))
    )
    return _snapshot(rows, F.col("glucose"))


def snap_new(spark: SparkSession, base: str) -> DataFrame:
    rows = _week_records(spark, base).where(
        (F.col("reading_id") % 13 != 0) & ~((F.col("patient_id") % 10 == 0) & (F.col("week") == 3))
    )
    shifted = F.when(F.col("reading_id") % 7 == 0, F.round(F.col("glucose") + 0.5, 2))
    return _snapshot(rows, F.coalesce(shifted, F.col("glucose")))


def patients(spark: SparkSession, base: str) -> DataFrame:
    c = load(spark, base, "customer")
    n = load(spark, base, "nation")
    r = load(spark, base, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("patient_id"),
            (F.col("c_custkey") % 2).cast("int").alias("arm"),
            F.col("n_name").alias("hospital"),
            F.col("r_name").alias("city"),
            F.col("c_mktsegment").alias("status"),
        )
    )


def orders_f(spark: SparkSession, base: str) -> DataFrame:
    who = F.col("o_custkey")
    exposed = (
        F.when(who % 17 == 0, F.lit(None).cast("boolean"))
        .when(who % 3 == 0, True)
        .when(who % 3 == 1, False)
        .otherwise(F.col("o_orderkey") % 2 == 0)
    )
    return load(spark, base, "orders").select(
        F.col("o_orderkey").alias("oid"),
        who.alias("patient_id"),
        F.col("o_orderdate").cast("timestamp").alias("paid_at"),
        F.col("o_totalprice").alias("fee"),
        exposed.alias("exposed"),
    )


def refunds(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "lineitem", where=F.col("l_returnflag") == "R")
    return rows.select(F.col("l_orderkey").alias("oid"), F.col("l_extendedprice").alias("total"))


def prescriptions(spark: SparkSession, base: str) -> DataFrame:
    li = load(spark, base, "lineitem")
    o = load(spark, base, "orders", ["o_orderkey", "o_custkey"])
    p = load(spark, base, "part", ["p_partkey", "p_name", "p_type"])
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_shipdate").cast("timestamp").alias("date"),
            F.col("p_name").alias("medicine"),
            F.col("p_type").alias("cls"),
            F.col("l_orderkey").alias("oid"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_extendedprice").alias("price"),
        )
    )


PRESCRIPTION_ORDER = ["date", "oid", "line", "part", "supplier", "price"]


def measures(spark: SparkSession, base: str, event_type: str) -> DataFrame:
    rows = load(spark, base, "events", where=F.col("event_type") == event_type)
    height = (150 + F.col("user_id") % 50).cast("double")
    return rows.select(
        F.col("user_id").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("reading_id"),
        F.col("value").alias("weight"),
        height.alias("height"),
    ).withColumn("bmi", bmi("weight", "height"))


def scale(spark: SparkSession, base: str) -> DataFrame:
    return measures(spark, base, "view")


def exam(spark: SparkSession, base: str) -> DataFrame:
    return measures(spark, base, "click")


def weekly_outcome(spark: SparkSession, base: str) -> DataFrame:
    rows = readings(spark, base).withColumn("day", elapsed_days(F.lit(ORIGIN), F.col("ts")))
    weekly = (
        rows.withColumn("week", floor_div(F.col("day"), 7).cast("int"))
        .groupBy("patient_id", "week")
        .agg(F.avg("glucose").alias("y"))
    )
    base_y = weekly.where("week = 0").select("patient_id", F.col("y").alias("base"))
    return weekly.join(base_y, "patient_id", "left").select(
        "patient_id",
        "week",
        "y",
        (F.col("patient_id") % 2).cast("int").alias("arm"),
        (F.col("patient_id") % 3 == 0).alias("drug"),
        "base",
    )


def survival_frame(spark: SparkSession, base: str) -> DataFrame:
    events = load(spark, base, "events").select(
        F.col("user_id").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("hit"),
    )
    joined = events.join(anchors(spark, base), "patient_id").where(F.col("ts") > F.col("enroll_ts"))
    per = joined.groupBy("patient_id", "enroll_ts").agg(
        F.min(F.when(F.col("hit"), F.col("ts"))).alias("first_hit"), F.max("ts").alias("last_ts")
    )
    until = F.coalesce("first_hit", "last_ts")
    return per.select(
        "patient_id",
        elapsed_days(F.col("enroll_ts"), until).cast("double").alias("T"),
        F.col("first_hit").isNotNull().cast("int").alias("E"),
        (F.col("patient_id") % 2).cast("int").alias("arm"),
        (F.col("patient_id") % 7).cast("double").alias("age"),
    ).where("T > 0")


def series(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def id_map(spark: SparkSession, base: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, base, "customer", ["c_custkey"]).select(
        key.alias("old"), F.concat(F.lit("P"), F.lpad(key.cast("string"), 8, "0")).alias("new")
    )


# The same frames for the SQL side.


def time_key_sql(before: str) -> str:
    text = f"{before} || strftime(ts, '%H:%M:%S.%f')"
    return f"""{text} || CASE WHEN row_number() OVER (PARTITION BY patient_id, ts ORDER BY reading_id) = 1
        THEN '' ELSE '_' || reading_id END"""


SQL = {
    "readings": """SELECT user_id AS patient_id, 'D' || user_id AS device_id, ts, value AS glucose,
        event_id AS reading_id FROM events""",
    "anchors": """SELECT user_id AS patient_id, min(ts) AS enroll_ts FROM events
        WHERE event_type = 'signup' GROUP BY 1""",
    "risk": """SELECT *, 1.794 * (pow(ln(glucose), 1.026) - 1.861) AS f FROM readings
        WHERE glucose >= 1.1""",
    "daily_valid": """SELECT patient_id, CAST(ts AS DATE) AS date, count(*) AS valid_data,
        avg(glucose) AS mean, stddev_pop(glucose) AS std,
        count(*) FILTER (WHERE glucose < 3) AS vlow,
        count(*) FILTER (WHERE glucose >= 3 AND glucose < 3.9) AS low,
        count(*) FILTER (WHERE glucose > 10 AND glucose <= 13.9) AS high,
        count(*) FILTER (WHERE glucose > 13.9) AS vhigh,
        count(*) FILTER (WHERE glucose BETWEEN 3.9 AND 7.8) AS in_range_tight,
        avg(CASE WHEN f < 0 THEN 10 * f * f ELSE 0 END) AS lbgi,
        avg(CASE WHEN f > 0 THEN 10 * f * f ELSE 0 END) AS hbgi
        FROM risk GROUP BY 1, 2""",
    "daily_all": """SELECT patient_id, CAST(ts AS DATE) AS date, count(glucose) AS data_count
        FROM readings GROUP BY 1, 2""",
    "daily": """SELECT a.patient_id, a.date, a.data_count, coalesce(v.valid_data, 0) AS valid_data,
        v.mean, v.std, coalesce(v.vlow, 0) AS vlow, coalesce(v.low, 0) AS low,
        coalesce(v.high, 0) AS high, coalesce(v.vhigh, 0) AS vhigh,
        coalesce(v.in_range_tight, 0) AS in_range_tight, v.lbgi, v.hbgi,
        min(a.date) OVER (PARTITION BY a.patient_id) AS first_date
        FROM daily_all a LEFT JOIN daily_valid v USING (patient_id, date)""",
    "days": """SELECT *, CAST(floor((date - first_date) / 7.0) AS INTEGER) AS week FROM daily
        WHERE valid_data > 0""",
    "weekly_all": """SELECT *, sqrt(greatest(q / valid_data - mean * mean, 0)) AS std,
        sqrt(greatest(q / valid_data - mean * mean, 0)) / mean AS cv,
        (valid_data - vlow - low - high - vhigh) / valid_data AS TIR,
        (low + vlow) / valid_data AS TBR, vlow / valid_data AS TBR_II,
        (high + vhigh) / valid_data AS TAR, vhigh / valid_data AS TAR_II,
        (3.0::DOUBLE * vlow + 2.4::DOUBLE * low + 1.6::DOUBLE * vhigh + 0.8::DOUBLE * high) / valid_data AS GRI,
        valid_data / 21 AS valid_rate
        FROM (SELECT patient_id, week, CAST(sum(valid_data) AS BIGINT) AS valid_data,
            CAST(sum(vlow) AS BIGINT) AS vlow, CAST(sum(low) AS BIGINT) AS low,
            CAST(sum(high) AS BIGINT) AS high, CAST(sum(vhigh) AS BIGINT) AS vhigh,
            CAST(sum(in_range_tight) AS BIGINT) AS in_range_tight,
            sum(mean * valid_data) / sum(valid_data) AS mean,
            sum((std * std + mean * mean) * valid_data) AS q,
            sum(lbgi * valid_data) / sum(valid_data) AS lbgi,
            sum(hbgi * valid_data) / sum(valid_data) AS hbgi
            FROM days GROUP BY 1, 2)""",
    "weekly": """SELECT *, count(*) OVER (PARTITION BY patient_id) AS week_count FROM weekly_all
        WHERE valid_data >= 10""",
    "pairs": """SELECT patient_id, week, week_count, CASE WHEN week = lo THEN 'first' ELSE 'last' END AS seq,
        TBR, TBR_II, TAR, TAR_II, TIR, GRI, lbgi, hbgi, mean, std, cv
        FROM (SELECT *, min(week) OVER (PARTITION BY patient_id) AS lo,
            max(week) OVER (PARTITION BY patient_id) AS hi FROM weekly)
        WHERE lo < hi AND (week = lo OR week = hi)""",
    "melted": """UNPIVOT (SELECT patient_id, week, week_count, seq, TBR, TBR_II, TAR, TAR_II, TIR, GRI,
        lbgi, hbgi, mean, std, cv FROM pairs) ON TBR, TBR_II, TAR, TAR_II, TIR, GRI, lbgi, hbgi, mean,
        std, cv INTO NAME variable VALUE value""",
    "day_long": f"""SELECT patient_id || '_' || CAST(ts AS DATE) AS id, patient_id,
        CAST(ts AS DATE) AS date, {time_key_sql("''")} AS time, glucose FROM readings""",
    "records": """SELECT *, CAST(floor(day / 7.0) AS INTEGER) AS week, day % 7 AS d
        FROM (SELECT *, CAST(ts AS DATE) - DATE '2024-01-01' AS day FROM readings)""",
    "old_long": f"""SELECT patient_id || '_' || week AS id, {time_key_sql("d || ' '")} AS time,
        glucose AS v FROM records
        WHERE reading_id % 11 <> 0 AND NOT (d >= 4 AND patient_id % 5 = 0)""",
    "new_long": f"""SELECT patient_id || '_' || week AS id, {time_key_sql("d || ' '")} AS time,
        CASE WHEN reading_id % 7 = 0 THEN round(glucose + 0.5, 2) ELSE glucose END AS v
        FROM records
        WHERE reading_id % 13 <> 0 AND NOT (patient_id % 10 = 0 AND week = 3)""",
    "patients": """SELECT c_custkey AS patient_id, CAST(c_custkey % 2 AS INTEGER) AS arm,
        n_name AS hospital, r_name AS city, c_mktsegment AS status
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "orders_f": """SELECT o_orderkey AS oid, o_custkey AS patient_id, o_orderdate AS paid_at,
        o_totalprice AS fee, CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN true
        WHEN o_custkey % 3 = 1 THEN false ELSE o_orderkey % 2 = 0 END AS exposed FROM orders""",
    "refunds": """SELECT l_orderkey AS oid, l_extendedprice AS total FROM lineitem
        WHERE l_returnflag = 'R'""",
    "prescriptions": """SELECT o_custkey AS patient_id, l_shipdate AS date, p_name AS medicine,
        p_type AS cls, l_orderkey AS oid, l_linenumber AS line, l_partkey AS part,
        l_suppkey AS supplier, l_extendedprice AS price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "bodies": """SELECT user_id AS patient_id, ts, event_id AS reading_id, value AS weight,
        CAST(150 + user_id % 50 AS DOUBLE) AS height, event_type,
        value / (((150 + user_id % 50) / 100.0::DOUBLE) * ((150 + user_id % 50) / 100.0::DOUBLE)) AS bmi
        FROM events WHERE event_type IN ('view', 'click')""",
    "scale": "SELECT * EXCLUDE (event_type) FROM bodies WHERE event_type = 'view'",
    "exam": "SELECT * EXCLUDE (event_type) FROM bodies WHERE event_type = 'click'",
    "outcome_weeks": "SELECT patient_id, week, avg(glucose) AS y FROM records GROUP BY 1, 2",
    "weekly_outcome": """SELECT w.patient_id, w.week, w.y, CAST(w.patient_id % 2 AS INTEGER) AS arm,
        w.patient_id % 3 = 0 AS drug, b.y AS base
        FROM outcome_weeks w LEFT JOIN (SELECT * FROM outcome_weeks WHERE week = 0) b USING (patient_id)""",
    "survival": """SELECT * FROM (SELECT patient_id,
        CAST(floor(epoch(coalesce(first_hit, last_ts) - enroll_ts) / 86400) AS DOUBLE) AS T,
        CASE WHEN first_hit IS NULL THEN 0 ELSE 1 END AS E, CAST(patient_id % 2 AS INTEGER) AS arm,
        CAST(patient_id % 7 AS DOUBLE) AS age
        FROM (SELECT a.patient_id, a.enroll_ts,
            min(CASE WHEN event_type = 'error' AND value > 100 THEN ts END) AS first_hit, max(ts) AS last_ts
            FROM events e JOIN anchors a ON e.user_id = a.patient_id AND e.ts > a.enroll_ts GROUP BY 1, 2))
        WHERE T > 0""",
    "id_map": "SELECT c_custkey AS old, 'P' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS new FROM customer",
}

# Which frames a frame is built on.
NEEDS = {
    "risk": ["readings"],
    "daily_valid": ["risk"],
    "daily_all": ["readings"],
    "daily": ["daily_all", "daily_valid"],
    "days": ["daily"],
    "weekly_all": ["days"],
    "weekly": ["weekly_all"],
    "pairs": ["weekly"],
    "melted": ["pairs"],
    "day_long": ["readings"],
    "records": ["readings"],
    "old_long": ["records"],
    "new_long": ["records"],
    "scale": ["bodies"],
    "exam": ["bodies"],
    "outcome_weeks": ["records"],
    "weekly_outcome": ["outcome_weeks"],
    "survival": ["anchors"],
}


def with_frames(body: str, *frames: str, extra: dict[str, str] | None = None) -> str:
    """A query over the named frames (and ``extra`` ones, in order)."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        ordered.setdefault(name, SQL[name])

    for name in frames:
        add(name)
    ordered |= extra or {}
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in ordered.items())
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
