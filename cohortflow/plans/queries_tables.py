"""Queries over sources, columns, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions import columns as C
from cohortflow.functions import scalars as S
from cohortflow.operators import joins as J
from cohortflow.operators.shape import explode_day_map, key_sets, rounded, sort_by_category, top_k
from cohortflow.plans import bindings as B
from cohortflow.plans.bindings import with_frames
from cohortflow.plans.registry import day_sql, day_text, query, r, ts_sql, ts_text
from cohortflow.session import scratch_path
from cohortflow.sources import tables as T


# Sources and sinks.


@query(
    "SRC1_table_scan",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, {day_sql('o_orderdate')} FROM orders
    WHERE o_totalprice > 200000 AND o_orderstatus = 'F'""",
)
def table_scan(spark: SparkSession, base: str) -> DataFrame:
    kept = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    df = T.load(spark, base, "orders", cols, kept)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "SRC2_cohort_extract",
    with_frames(
        f"""SELECT patient_id, {ts_sql('ts')}, glucose FROM readings
        WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'
        AND patient_id IN (SELECT patient_id FROM patients WHERE status = 'BUILDING')""",
        "readings",
        "patients",
    ),
)
def cohort_extract(spark: SparkSession, base: str) -> DataFrame:
    cohort = B.patients(spark, base).where("status = 'BUILDING'")
    names = {"user_id": "patient_id", "value": "glucose"}
    source = C.rename_columns(T.load(spark, base, "events", ["user_id", "ts", "value"]), names)
    start = F.lit("2024-01-05").cast("timestamp_ntz")
    end = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    df = T.cohort_extract(source, cohort, "patient_id", "ts", start, end, ["ts", "glucose"])
    return df.select("patient_id", ts_text("ts"), "glucose")


@query("SRC3_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, base: str) -> DataFrame:
    df = T.load(spark, base, "customer")
    path = scratch_path(spark, "csv")
    T.write_csv(df, path)
    return T.read_csv(spark, path, df.schema)


@query("SRC4_json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, base: str) -> DataFrame:
    df = T.load(spark, base, "conversations")
    path = scratch_path(spark, "json")
    T.write_json(df, path)
    return T.read_json_records(spark, path, df.schema)


ODD_TEXTS = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || chr(10) || ' "quoted", ' || c_mktsegment
    WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' ' || c_name || ' ' ELSE '{}]' || chr(10) END AS note,
    c_acctbal, c_mktsegment FROM customer"""


def odd_texts(spark: SparkSession, base: str) -> DataFrame:
    """Customers with texts that are easy to get wrong."""
    case = F.pmod("c_custkey", F.lit(5))
    note = (
        F.when(case == 0, F.concat("c_name", F.lit('\n "quoted", '), "c_mktsegment"))
        .when(case == 1, "")
        .when(case == 3, F.concat(F.lit(" "), "c_name", F.lit(" ")))
        .when(case == 4, "{}]\n")
    )
    df = T.load(spark, base, "customer")
    return df.select("c_custkey", note.alias("note"), "c_acctbal", "c_mktsegment")


@query("SRC3_csv_odd_texts", ODD_TEXTS)
def csv_odd_texts(spark: SparkSession, base: str) -> DataFrame:
    df, path = odd_texts(spark, base), scratch_path(spark, "csv")
    T.write_csv(df, path)
    return T.read_csv(spark, path, df.schema)


@query("SRC4_json_arrays", ODD_TEXTS)
def json_arrays(spark: SparkSession, base: str) -> DataFrame:
    df, path = odd_texts(spark, base), scratch_path(spark, "json")
    T.write_json_array(df, path)
    return T.read_json_records(spark, path, df.schema, array=True)


@query(
    "SRC5_materialize",
    with_frames(f"SELECT patient_id, week, arm, drug, {r('y', 'base')} FROM weekly_outcome", "weekly_outcome"),
)
def materialize(spark: SparkSession, base: str) -> DataFrame:
    df = B.weekly_outcome(spark, base)
    return rounded(T.materialize(df, scratch_path(spark, "frame"), "save"))


# Columns and predicates.


@query(
    "SEL1_rename_columns",
    """SELECT c_custkey AS patient_id, c_name AS name, c_mktsegment AS status,
    c_acctbal AS balance FROM customer""",
)
def rename_columns(spark: SparkSession, base: str) -> DataFrame:
    names = {"c_custkey": "patient_id", "c_name": "name", "c_mktsegment": "status", "c_acctbal": "balance"}
    return C.rename_columns(T.load(spark, base, "customer"), names, drop=["c_nationkey"])


@query("SEL2_select_like", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def select_like(spark: SparkSession, base: str) -> DataFrame:
    return C.select_like(T.load(spark, base, "orders"), "pri", first=["o_orderkey"])


@query(
    "SEL3_predicates",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 250000
    AND o_orderpriority IS NOT NULL AND o_orderdate >= TIMESTAMP '1996-01-01'
    AND o_orderpriority <> '5-LOW'""",
)
def predicates(spark: SparkSession, base: str) -> DataFrame:
    kept = (
        F.col("o_orderstatus").isin("F", "O")
        & F.col("o_totalprice").between(1000, 250000)
        & F.col("o_orderpriority").isNotNull()
        & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderpriority") != "5-LOW")
    )
    return T.load(spark, base, "orders", ["o_orderkey", "o_custkey", "o_totalprice"], kept)


@query(
    "SEL4_flag_contains",
    """SELECT p_partkey, p_name, contains(p_name, 'ring') AND p_name NOT IN ('small ring', 'hot ring')
    AS flagged FROM part""",
)
def flag_contains(spark: SparkSession, base: str) -> DataFrame:
    flag = C.flag_contains("p_name", "ring", ["small ring", "hot ring"])
    return T.load(spark, base, "part").select("p_partkey", "p_name", flag.alias("flagged"))


@query(
    "SEL5_flag_either",
    """SELECT p_partkey, coalesce(contains(c1, 'o'), contains(c2, 'o')) AS first_decides,
    coalesce(contains(c1, 'o'), false) OR coalesce(contains(c2, 'o'), false) AS either
    FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS c1,
        CASE WHEN p_size % 8 = 4 THEN NULL ELSE lower(p_type) END AS c2 FROM part)""",
)
def flag_either(spark: SparkSession, base: str) -> DataFrame:
    part = T.load(spark, base, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("c1"),
        F.when(F.col("p_size") % 8 != 4, F.lower("p_type")).alias("c2"),
    )
    return part.select(
        "p_partkey",
        C.flag_either("c1", "c2", "o", "first").alias("first_decides"),
        C.flag_either("c1", "c2", "o").alias("either"),
    )


@query(
    "SEL6_to_ts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
    AS paid_at, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS paid_day
    FROM orders""",
)
def to_ts(spark: SparkSession, base: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    raw = T.load(spark, base, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(text).alias("paid_at")
    )
    parsed = C.to_day(C.to_ts(raw, ["paid_at"]), "paid_at", "paid_day")
    return parsed.select(
        "o_orderkey", F.date_format("paid_at", "yyyy-MM-dd HH:mm:ss").alias("paid_at"), day_text("paid_day")
    )


@query(
    "SEL7_complete_cases",
    with_frames(
        """SELECT patient_id, count(*) FILTER (WHERE base IS NOT NULL AND y IS NOT NULL) AS kept,
        bool_or(base IS NULL OR y IS NULL) AS rejected FROM weekly_outcome GROUP BY 1""",
        "weekly_outcome",
    ),
)
def complete_cases(spark: SparkSession, base: str) -> DataFrame:
    df = B.weekly_outcome(spark, base)
    kept = C.complete_cases(df, ["y", "base"]).groupBy("patient_id").agg(F.count(F.lit(1)).alias("kept"))
    out = C.rejected_keys(df, "patient_id", ["y", "base"])
    everyone = J.flag_member(df.select("patient_id").distinct(), out, "patient_id", "rejected")
    return C.fill_from(J.attach(everyone, kept, "patient_id"), "kept", 0)


@query(
    "SEL8_fill_from",
    with_frames(
        f"""SELECT patient_id, week, round(coalesce(base, y), 6) AS base FROM weekly_outcome""", "weekly_outcome"
    ),
)
def fill_from(spark: SparkSession, base: str) -> DataFrame:
    df = C.fill_from(B.weekly_outcome(spark, base), "base", "y")
    return rounded(df.select("patient_id", "week", "base"))


@query(
    "SEL8_fill_constant",
    with_frames("SELECT oid, coalesce(exposed, false) AS exposed FROM orders_f", "orders_f"),
)
def fill_constant(spark: SparkSession, base: str) -> DataFrame:
    return C.fill_from(B.orders_f(spark, base), "exposed", False).select("oid", "exposed")


@query(
    "SEL9_recode",
    with_frames(
        """SELECT patient_id, CASE arm WHEN 0 THEN 'without' WHEN 1 THEN 'with' END AS arm,
        CASE status WHEN 'BUILDING' THEN 'join' WHEN 'MACHINERY' THEN 'take_over' ELSE status END AS status
        FROM patients""",
        "patients",
    ),
)
def recode(spark: SparkSession, base: str) -> DataFrame:
    df = C.recode(B.patients(spark, base), "arm", {0: "without", 1: "with"})
    df = C.recode(df, "status", {"BUILDING": "join", "MACHINERY": "take_over"}, other="keep")
    return df.select("patient_id", "arm", "status")


@query(
    "SEL10_label_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F'
    THEN 'final' ELSE 'open' END AS label FROM orders""",
)
def label_when(spark: SparkSession, base: str) -> DataFrame:
    cases = [(F.col("o_totalprice") > 300000, "large"), (F.col("o_orderstatus") == "F", "final")]
    df = C.label_when(T.load(spark, base, "orders"), "label", cases, "open")
    return df.select("o_orderkey", "label")


@query(
    "SEL11_bin_label",
    """SELECT p_partkey, CASE WHEN v < 0 THEN NULL WHEN v <= 2 THEN '<=2' WHEN v <= 4 THEN '3-4'
    WHEN v <= 8 THEN '5-8' WHEN v <= 12 THEN '9-12' ELSE '>=13' END AS care_period
    FROM (SELECT p_partkey, p_size - 3 AS v FROM part)""",
)
def bin_label(spark: SparkSession, base: str) -> DataFrame:
    df = T.load(spark, base, "part").withColumn("v", F.col("p_size") - 3)
    return df.select("p_partkey", C.bin_label("v").alias("care_period"))


# Joins.


@query(
    "JOIN1_left",
    with_frames(
        "SELECT oid, patient_id, fee, arm, hospital FROM orders_f LEFT JOIN patients USING (patient_id)",
        "orders_f",
        "patients",
    ),
)
def join_left(spark: SparkSession, base: str) -> DataFrame:
    df = J.attach(B.orders_f(spark, base), B.patients(spark, base), "patient_id")
    return df.select("oid", "patient_id", "fee", "arm", "hospital")


@query(
    "JOIN2_inner",
    with_frames(
        f"""SELECT reading_id, patient_id, glucose, {ts_sql('enroll_ts')} FROM readings
        JOIN anchors USING (patient_id)""",
        "readings",
        "anchors",
    ),
)
def join_inner(spark: SparkSession, base: str) -> DataFrame:
    df = J.match(B.readings(spark, base), B.anchors(spark, base), "patient_id")
    return df.select("reading_id", "patient_id", "glucose", ts_text("enroll_ts"))


@query(
    "JOIN3_keep_keys",
    with_frames(
        f"""SELECT patient_id, {day_sql('date')}, week, valid_data, week_valid_sum FROM days
        JOIN (SELECT patient_id, week, CAST(sum(valid_data) AS BIGINT) AS week_valid_sum FROM days
            GROUP BY 1, 2 HAVING sum(valid_data) >= 10) USING (patient_id, week)""",
        "days",
    ),
)
def join_keep_keys(spark: SparkSession, base: str) -> DataFrame:
    from cohortflow.operators.cgm import with_week

    days = with_week(B.daily(spark, base))
    keys = days.groupBy("patient_id", "week").agg(F.sum("valid_data").alias("week_valid_sum"))
    kept = J.keep_keys(days, keys.where(f"week_valid_sum >= {B.MIN_VALID}"), ["patient_id", "week"])
    return kept.select("patient_id", day_text("date"), "week", "valid_data", "week_valid_sum")


@query(
    "JOIN4_semi",
    with_frames(
        "SELECT oid, patient_id, fee FROM orders_f WHERE patient_id IN (SELECT patient_id FROM readings)",
        "orders_f",
        "readings",
    ),
)
def join_semi(spark: SparkSession, base: str) -> DataFrame:
    keys = B.readings(spark, base).select("patient_id")
    return J.semi(B.orders_f(spark, base), keys, "patient_id").select("oid", "patient_id", "fee")


@query(
    "JOIN5_anti",
    with_frames(
        """SELECT patient_id, hospital FROM patients p WHERE NOT EXISTS
        (SELECT 1 FROM orders_f o WHERE o.patient_id = p.patient_id AND o.fee > 400000)""",
        "patients",
        "orders_f",
    ),
)
def join_anti(spark: SparkSession, base: str) -> DataFrame:
    keys = B.orders_f(spark, base).where("fee > 400000").select("patient_id")
    return J.anti(B.patients(spark, base), keys, "patient_id").select("patient_id", "hospital")


@query(
    "JOIN6_net_orders",
    with_frames(
        """SELECT oid, fee, round(refund_amount, 2) AS refund_amount FROM orders_f
        LEFT JOIN (SELECT oid, sum(total) AS refund_amount FROM refunds GROUP BY 1) USING (oid)
        WHERE refund_amount IS NULL OR fee > refund_amount""",
        "orders_f",
        "refunds",
    ),
)
def net_orders(spark: SparkSession, base: str) -> DataFrame:
    df = J.net_orders(B.orders_f(spark, base), B.refunds(spark, base))
    return rounded(df.select("oid", "fee", "refund_amount"), {"refund_amount": 2})


@query(
    "JOIN7_flag_member",
    with_frames(
        """SELECT patient_id, patient_id IN (SELECT patient_id FROM prescriptions
        WHERE medicine = 'small ring') AS is_user FROM patients""",
        "patients",
        "prescriptions",
    ),
)
def flag_member(spark: SparkSession, base: str) -> DataFrame:
    users = B.prescriptions(spark, base).where("medicine = 'small ring'")
    df = J.flag_member(B.patients(spark, base), users, "patient_id", "is_user")
    return df.select("patient_id", "is_user")


@query(
    "JOIN8_patient_star",
    with_frames(
        """SELECT reading_id, s.patient_id, weight, c_mktsegment, n_name, r_name, paid_orders
        FROM scale s LEFT JOIN customer ON s.patient_id = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT patient_id, count(*) AS paid_orders FROM orders_f GROUP BY 1) o
            ON s.patient_id = o.patient_id
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND r_name <> 'AFRICA' AND n_name IS NOT NULL
        AND paid_orders > 5""",
        "scale",
        "orders_f",
    ),
)
def patient_star(spark: SparkSession, base: str) -> DataFrame:
    counts = B.orders_f(spark, base).groupBy("patient_id").agg(F.count(F.lit(1)).alias("paid_orders"))
    fact = B.scale(spark, base)
    dims = [
        (T.load(spark, base, "customer"), F.col("patient_id") == F.col("c_custkey")),
        (T.load(spark, base, "nation"), F.col("c_nationkey") == F.col("n_nationkey")),
        (T.load(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey")),
        (counts, "patient_id"),
    ]
    kept = (
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        & (F.col("r_name") != "AFRICA")
        & F.col("n_name").isNotNull()
        & (F.col("paid_orders") > 5)
    )
    return J.patient_star(fact, dims, kept).select(
        "reading_id", "patient_id", "weight", "c_mktsegment", "n_name", "r_name", "paid_orders"
    )


ANCHORED = """SELECT * FROM (SELECT reading_id, patient_id, glucose,
    CAST(floor(epoch(ts - enroll_ts) / 86400) AS INTEGER) AS days
    FROM readings JOIN anchors USING (patient_id))"""


@query(
    "JOIN9_anchored_window",
    with_frames(f"{ANCHORED} WHERE days BETWEEN 0 AND 6", "readings", "anchors"),
)
def anchored_window(spark: SparkSession, base: str) -> DataFrame:
    df = J.anchored_window(
        B.readings(spark, base), B.anchors(spark, base), "patient_id", "ts", "enroll_ts", 0, 6
    )
    return df.select("reading_id", "patient_id", "glucose", "days")


@query(
    "JOIN9_spread_window",
    with_frames(f"{ANCHORED} WHERE days BETWEEN -3 AND 9", "readings", "anchors"),
)
def spread_window(spark: SparkSession, base: str) -> DataFrame:
    df = J.anchored_window(
        B.readings(spark, base), B.anchors(spark, base), "patient_id", "ts", "enroll_ts", -3, 9, spread_days=2
    )
    return df.select("reading_id", "patient_id", "glucose", "days")


@query(
    "JOIN9_offset_before",
    with_frames(f"{ANCHORED} WHERE days BETWEEN -30 AND 30", "readings", "anchors"),
)
def offset_before(spark: SparkSession, base: str) -> DataFrame:
    df = J.anchored_window(
        B.readings(spark, base), B.anchors(spark, base), "patient_id", "ts", "enroll_ts", -30, 30
    )
    return df.select("reading_id", "patient_id", "glucose", "days")


@query(
    "JOIN10_key_outer",
    with_frames(
        """SELECT id, time, o.v AS old_value, n.v AS new_value, CASE WHEN o.id IS NULL THEN 'only_new'
        WHEN n.id IS NULL THEN 'only_old' ELSE 'both' END AS key_status
        FROM old_long o FULL JOIN new_long n USING (id, time)""",
        "old_long",
        "new_long",
    ),
)
def key_outer(spark: SparkSession, base: str) -> DataFrame:
    return J.key_outer(B.snap_old(spark, base), B.snap_new(spark, base), "id")


@query(
    "JOIN11_crosswalk",
    with_frames(
        "SELECT oid, new AS patient_id, fee FROM orders_f LEFT JOIN id_map ON patient_id = old",
        "orders_f",
        "id_map",
    ),
)
def crosswalk(spark: SparkSession, base: str) -> DataFrame:
    df = J.crosswalk(B.orders_f(spark, base), B.id_map(spark, base), "patient_id", "old", "new")
    return df.select("oid", "patient_id", "fee")


# Sorting and set operations.


@query(
    "SORT1_sort_by_category",
    with_frames(
        f"SELECT patient_id, week, seq, variable, {r('value')} FROM melted",
        "melted",
    ),
)
def sorted_pairs(spark: SparkSession, base: str) -> DataFrame:
    from cohortflow.operators.cgm import WEEKLY_METRICS, weekly_rollup
    from cohortflow.plans.jobs import week_pairs

    weekly = weekly_rollup(B.daily(spark, base), per_day=B.PER_DAY, min_valid=B.MIN_VALID)
    df = sort_by_category(week_pairs(weekly), "variable", WEEKLY_METRICS, ["seq", "patient_id"])
    return rounded(df.select("patient_id", "week", "seq", "variable", "value"))


@query(
    "SORT2_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_orders(spark: SparkSession, base: str) -> DataFrame:
    df = T.load(spark, base, "orders", ["o_orderkey", "o_totalprice"])
    return top_k(df, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query(
    "SET1_union",
    with_frames(
        f"""SELECT patient_id, {ts_sql('ts')}, round(bmi, 6) AS bmi, NULL::DOUBLE AS height FROM scale
        UNION ALL SELECT patient_id, {ts_sql('ts')}, round(bmi, 6), height FROM exam""",
        "scale",
        "exam",
    ),
)
def union(spark: SparkSession, base: str) -> DataFrame:
    a = B.scale(spark, base).select("patient_id", F.col("ts").alias("measured_at"), "bmi")
    b = B.exam(spark, base).select("patient_id", F.col("ts").alias("created_at"), "bmi", "height")
    df = J.union_aligned([a, b], [{"measured_at": "ts"}, {"created_at": "ts"}])
    return rounded(df.select("patient_id", ts_text("ts"), "bmi", "height"))


@query(
    "SET2_replace_rows",
    with_frames(
        """SELECT patient_id, reading_id, weight FROM scale WHERE patient_id NOT IN
        (SELECT patient_id FROM exam WHERE weight > 100)
        UNION ALL SELECT patient_id, reading_id, weight FROM exam WHERE weight > 100""",
        "scale",
        "exam",
    ),
)
def replace_rows(spark: SparkSession, base: str) -> DataFrame:
    cols = ["patient_id", "reading_id", "weight"]
    new = B.exam(spark, base).where("weight > 100").select(*cols)
    return J.replace_rows(B.scale(spark, base).select(*cols), "patient_id", new)


@query(
    "SET2_replace_stored",
    with_frames(
        """SELECT patient_id, reading_id, weight, patient_id % 16 AS part FROM scale WHERE patient_id NOT IN
        (SELECT patient_id FROM exam WHERE weight > 100)
        UNION ALL SELECT patient_id, reading_id, weight, patient_id % 16 AS part FROM exam WHERE weight > 100""",
        "scale",
        "exam",
    ),
)
def replace_stored(spark: SparkSession, base: str) -> DataFrame:
    cols = ["patient_id", "reading_id", "weight", F.pmod("patient_id", F.lit(16)).alias("part")]
    path = scratch_path(spark, "stored")
    B.scale(spark, base).select(*cols).write.partitionBy("part").parquet(path)
    new = B.exam(spark, base).where("weight > 100").select(*cols)
    for _ in range(2):  # the second run changes nothing
        T.replace_stored(spark, path, new, "patient_id", "part", scratch_path(spark, "staged"))
    out = spark.read.parquet(path)
    return out.withColumn("part", F.col("part").cast(new.schema["part"].dataType))


@query(
    "SET3_key_sets",
    with_frames(
        """SELECT id, string_agg(time, ',' ORDER BY time) AS key_union,
        coalesce(string_agg(time, ',' ORDER BY time) FILTER (WHERE o IS NULL), '') AS key_added,
        coalesce(string_agg(time, ',' ORDER BY time) FILTER (WHERE n IS NULL), '') AS key_missing,
        count(o) FILTER (WHERE n IS NOT NULL) AS n_common
        FROM (SELECT id, time, a.time AS o, b.time AS n FROM old_long a FULL JOIN new_long b USING (id, time))
        WHERE id IN (SELECT id FROM old_long) AND id IN (SELECT id FROM new_long) GROUP BY 1""",
        "old_long",
        "new_long",
    ),
)
def set_keys(spark: SparkSession, base: str) -> DataFrame:
    old = B.snap_old(spark, base).select("id", F.map_keys("daily_data").alias("a"))
    new = B.snap_new(spark, base).select("id", F.map_keys("daily_data").alias("b"))
    df = key_sets(old.join(new, "id"), "a", "b")
    joined = [F.array_join(c, ",").alias(c) for c in ("key_union", "key_added", "key_missing")]
    return df.select("id", *joined, F.size("key_common").cast("bigint").alias("n_common"))


# Scalar functions.


@query(
    "FN1_elapsed_days",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CAST(floor(epoch(l_shipdate - (o_orderdate + INTERVAL 5 HOUR)) / 86400) AS INTEGER) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def elapsed(spark: SparkSession, base: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = T.load(spark, base, "lineitem", cols)
    o = T.load(spark, base, "orders", ["o_orderkey", "o_orderdate"])
    late = F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS")
    df = li.join(o, li.l_orderkey == o.o_orderkey)
    return df.select(*cols[:-1], S.elapsed_days(late, "l_shipdate").alias("days"))


@query(
    "FN2_week_index",
    with_frames(
        """SELECT oid, part, line, supplier, price,
        CAST(floor(epoch(date - TIMESTAMP '1998-01-01') / 86400 / 7) AS INTEGER) AS week FROM prescriptions""",
        "prescriptions",
    ),
)
def week_number(spark: SparkSession, base: str) -> DataFrame:
    days = S.elapsed_days(F.lit("1998-01-01"), "date")
    df = B.prescriptions(spark, base)
    return df.select("oid", "part", "line", "supplier", "price", S.week_index(days).alias("week"))


@query(
    "FN3_bmi",
    with_frames(
        """SELECT reading_id, round(bmi, 6) AS bmi, CASE WHEN bmi < 18.5 THEN 'underweight'
        WHEN bmi < 24 THEN 'normal' WHEN bmi < 28 THEN 'overweight' ELSE 'obese' END AS grade FROM scale""",
        "scale",
    ),
)
def body_mass(spark: SparkSession, base: str) -> DataFrame:
    df = B.scale(spark, base)
    return rounded(df.select("reading_id", "bmi", S.bmi_class("bmi").alias("grade")))


@query(
    "FN4_formats",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    printf('%.2f%%', l_discount * 100.0::DOUBLE) AS pct, printf('%.3f', l_tax) AS fixed FROM lineitem""",
)
def formats(spark: SparkSession, base: str) -> DataFrame:
    df = T.load(spark, base, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return df.select(*keys, S.fmt_pct("l_discount").alias("pct"), S.fmt_fixed("l_tax", 3).alias("fixed"))


@query(
    "FN5_parse_day_map",
    with_frames(
        """SELECT id, count(*) AS entries, count(*) FILTER (WHERE glucose < 1.1) AS missing,
        round(sum(CASE WHEN glucose >= 1.1 THEN glucose ELSE 0 END), 6) AS total FROM day_long GROUP BY 1""",
        "day_long",
    ),
)
def parse_maps(spark: SparkSession, base: str) -> DataFrame:
    df = B.day_map_text(spark, base).withColumn("m", S.parse_day_map("daily_data"))
    values = F.map_values("m")
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return rounded(
        df.select(
            "id",
            F.size("m").cast("bigint").alias("entries"),
            F.size(F.filter(values, lambda v: v.isNull())).cast("bigint").alias("missing"),
            total.alias("total"),
        )
    )


@query(
    "FN6_count_below",
    with_frames(
        "SELECT id, CAST(count(*) FILTER (WHERE glucose < 1.1) AS INTEGER) AS invalid FROM day_long GROUP BY 1",
        "day_long",
    ),
)
def invalid_counts(spark: SparkSession, base: str) -> DataFrame:
    return B.day_maps(spark, base).select("id", S.count_below("daily_data").alias("invalid"))


@query(
    "FN7_last_key",
    with_frames(
        "SELECT id, min(time) AS first_key, max(time) AS last_key FROM day_long GROUP BY 1", "day_long"
    ),
)
def edge_keys(spark: SparkSession, base: str) -> DataFrame:
    return B.day_maps(spark, base).select(
        "id", S.first_key("daily_data").alias("first_key"), S.last_key("daily_data").alias("last_key")
    )


@query(
    "RSH3_explode_day_map",
    with_frames(
        f"""SELECT id, {day_sql('date')}, time, glucose,
        CAST(date AS VARCHAR) || ' ' || split_part(time, '_', 1) AS ts FROM day_long""",
        "day_long",
    ),
)
def explode_maps(spark: SparkSession, base: str) -> DataFrame:
    df = explode_day_map(B.day_maps(spark, base).drop("patient_id"), "date", "daily_data")
    return df.select(
        "id", day_text("date"), "time", "glucose", ts_text("ts")
    )
