"""Queries over the star schema tables, one for each operator, with the SQL they are held against.

Relations are the tables' integer columns in file order; a query text names them by number.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.unsigned import compare, wrapping_sum
from .functions.workers import shared_dir
from .operators.aggregates import checksum
from .operators.filters import filter_equal_columns
from .harness import run_workload
from .operators.joins import distinct_keys, hash_join, radix, radix_histogram, radix_partition
from .operators.scans import materialize_late, project, row_at, scan, with_row_ids
from .plans.order import explain_order
from .plans.parser import parse_query
from .plans.planner import Planner
from .plans.stats import statistics_frame
from .sources.catalog import Catalog
from .sources.relbin import write_relation
from .streaming.protocol import Engine, batch_frame, serve

#: Relation number -> table and its integer columns.
TABLES = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey", "n_regionkey")),
    ("supplier", ("s_suppkey", "s_nationkey")),
    ("customer", ("c_custkey", "c_nationkey")),
    ("part", ("p_partkey", "p_size")),
    ("orders", ("o_orderkey", "o_custkey")),
    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
    ("events", ("event_id", "user_id")),
)

FLAGSHIP = "6 5 3 2|0.0=1.0&1.1=2.0&0.2=3.0&2.1=3.1&3.1>3|0.0 1.0 2.1 3.1"

#: Query name -> text; each is planned with joins in order of cost.
TEXTS = {
    "scan_sum": "6||0.0 0.1 0.2 0.3",
    "filter_lt": "6|0.3<3|0.0 0.3",
    "filter_gt": "6|0.1>1500|0.1 0.2",
    "filter_eq": "6|0.3=1|0.0 0.3",
    "filter_conjunction": "6 5|0.0=1.0&0.0>2000&0.0<4000&0.3=2|0.1 0.1",
    "hash_join": "6 5|0.0=1.0&0.3=1|0.1 1.1 0.0",
    "join_one_filter": "5 3|0.1=1.0&1.0>750|0.0 1.1",
    "join_chain3": "6 5 3|0.0=1.0&1.1=2.0&2.1<5|0.2 1.0 2.1",
    "join_chain4": "6 2 1 0|0.2=1.0&1.1=2.0&2.1=3.0&3.0<2|0.0 2.0 3.0",
    "join_star": "6 4 2|0.1=1.0&0.2=2.0&1.1>25|0.0 1.1 2.1",
    "join_cycle": FLAGSHIP,
    "join_many_to_many": "3 2|0.1=1.1&1.0<10|0.0 1.0",
    "self_join": "5 5|0.1=1.1&0.0<500|0.0 1.0",
    "self_join_all": "5 5|0.1=1.1|0.0 1.0",
    "join_many_to_many_all": "3 2|0.1=1.1|0.0 1.0",
    "join_multi_key": "6 5|0.0=1.0&0.1=1.1|0.0 1.1",
    "join_redundant": "5 3|0.1=1.0&1.0=0.1&0.0>7000|0.1 1.0 0.1",
    "join_events": "7 3|0.1=1.0&1.1=7|0.0 1.0",
    "join_inside_binding": "6 5|0.0=1.0&0.0=0.1|0.0 1.1 0.1",
    "join_right_deep": "0 1 2 6|0.0=1.1&1.0=2.1&2.0=3.2&3.3=2|3.1 2.0",
    "checksum_empty": "6 5|0.0=1.0&1.0>999999999|0.0 1.1",
    "checksum_zero": "1 0|0.1=1.0&1.0=0|1.0 0.0",
    "sum_dedup": "6 5|0.0=1.0&1.1<100|0.1 0.1 1.1 0.1",
    "sum_equivalence": "6 5 3|0.0=1.0&1.1=2.0|0.0 1.0 1.1 2.0",
}

#: A relation given as lists: a key and its square.
GIVEN = (tuple(range(50)), tuple(k * k for k in range(50)))

BATCH = ("hash_join", "join_chain3", "self_join", "checksum_zero", "join_redundant")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a data folder; kept with its statistics for the session."""
    kept = spark.__dict__.setdefault("_tallyweave_catalogs", {})
    if sf_dir not in kept:
        made = Catalog(spark)
        for table, _ in TABLES:
            made.add_parquet(f"{sf_dir}/{table}.parquet")
        kept[sf_dir] = made
    return kept[sf_dir]


def planner(spark: SparkSession, sf_dir: str, **options) -> Planner:
    return Planner(catalog(spark, sf_dir), **options)


def _planned(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: planner(spark, sf_dir).plan(text)


def _relation(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return catalog(spark, sf_dir)[[t for t, _ in TABLES].index(table)].df


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project(scan(_relation(spark, sf_dir, "lineitem"), 0), [3, 1])
    return out.select(F.col("b0_c3").alias("l_linenumber"), F.col("b0_c1").alias("l_partkey"))


def projection_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_ids(_relation(spark, sf_dir, "orders"), "c0")


def late_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = with_row_ids(_relation(spark, sf_dir, "orders"), "c0")
    ids = base.filter(F.col("c1") < 10).select("row_id", "c1")
    return materialize_late(ids, base, "row_id", ["c0"]).select("row_id", "c0", "c1")


def late_materialize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = with_row_ids(_relation(spark, sf_dir, "orders"), "c0")
    return materialize_late(base.select("row_id", "c1"), base, "row_id", ["c0"]).select("row_id", "c0", "c1")


def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_at(with_row_ids(_relation(spark, sf_dir, "orders"), "c0"), "row_id", 100)


def column_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_equal_columns(scan(_relation(spark, sf_dir, "lineitem"), 0), "b0_c0", "b0_c1")


def join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = scan(_relation(spark, sf_dir, "orders"), 0), scan(_relation(spark, sf_dir, "customer"), 1)
    return hash_join(left, right, [("b0_c1", "b1_c0")])


def shuffle_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner(spark, sf_dir, hint="shuffle_hash").plan(TEXTS["hash_join"])


def cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner(spark, sf_dir, cross=True).plan("1 0|0.0<5|0.0 1.0")


def cross_product_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner(spark, sf_dir, cross=True).plan("1 0||0.0 1.0")


def radix_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each radix of the dealt rows their number, and how many partitions hold them."""
    dealt = radix_partition(_relation(spark, sf_dir, "lineitem"), "c0", 3, 4).withColumn("home", F.spark_partition_id())
    return dealt.groupBy(radix("c0", 3, 4).alias("radix")).agg(F.count("*").alias("n_rows"), F.count_distinct("home").alias("n_homes"))


def in_memory_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns given as lists, joined with a table."""
    made = Catalog(spark)
    made.add_columns(GIVEN)
    made.add_parquet(f"{sf_dir}/nation.parquet")
    return Planner(made).plan("0 1|0.0=1.0|0.0 0.1 1.1")


def wrapping_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join whose values and sums are taken mod 2^64, with the fact table summed up before it. Shifts drop the bits beyond
    64, where a product of longs raises."""
    made = Catalog(spark)
    made.add(_relation(spark, sf_dir, "lineitem").select(F.shiftleft("c0", 40).alias("c0"), F.col("c2").alias("c1")), unsigned=True)
    made.add(_relation(spark, sf_dir, "supplier").select(F.col("c0").alias("c0"), F.shiftleft("c1", 52).alias("c1")), unsigned=True)
    return Planner(made, eager_rows=1000).answer("0 1|0.1=1.0|0.0 1.1")


def _session_text(sf_dir: str) -> str:
    """Relations, then two batches, as a client sends them."""
    paths = "".join(f"{sf_dir}/{table}.parquet\n" for table, _ in TABLES)
    return paths + "Done\n" + "\n".join(TEXTS[name] for name in BATCH[:3]) + "\nF\n" + "\n".join(TEXTS[name] for name in BATCH[3:]) + "\nF\n"


def protocol_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the protocol answers to a session."""
    sink = io.StringIO()
    serve(spark, io.StringIO(_session_text(sf_dir)), sink)
    return spark.createDataFrame(list(enumerate(sink.getvalue().splitlines())), "query_no long, answer string")


def harness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload of two batches, held against answers planned in the order of the texts; and against wrong ones."""
    work = _session_text(sf_dir).split("Done\n")[1].splitlines()
    plain = planner(spark, sf_dir, order="text", cross=True)
    right = [plain.answer(TEXTS[name]).first()["answer"] for name in BATCH]
    out = []
    for expected in (right, ["wrong", *right[1:]]):
        report = run_workload(Engine(planner(spark, sf_dir)), work, expected)
        out.append((report.valid, len(report.batch_ms), len(report.failures)))
    return spark.createDataFrame(out, "valid boolean, n_batches long, n_failures long")


def query_printout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query's parts, a line each."""
    return spark.createDataFrame(list(enumerate(parse_query(FLAGSHIP).tree().splitlines())), "line_no long, line string")


def order_printout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step of the printed join order of the flagship query, how many of its bindings are joined, by the text."""
    used = planner(spark, sf_dir)
    lines = explain_order(parse_query(FLAGSHIP), used.statistics(parse_query(FLAGSHIP))).splitlines()
    names = [line.removeprefix("+ ").split(" (")[0] for line in lines]
    return spark.createDataFrame([(k, len(set(names[: k + 1])), "rows" in line) for k, line in enumerate(lines)], "step long, n_joined long, has_estimate boolean")


def stats_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate distinct counts are within a fifth (or two) of the exact ones."""
    key = ["relation", "column_no", "n_rows", "low", "high"]
    near = F.abs(F.col("approx") - F.col("n_distinct")) <= F.greatest(F.lit(2), F.col("n_distinct") * 0.2)
    found = _stats(False)(spark, sf_dir).withColumnRenamed("n_distinct", "approx")
    return _stats(True)(spark, sf_dir).join(found, key).select(*key, near.alias("near"))


def radix_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_histogram(_relation(spark, sf_dir, "lineitem"), "c0", 3, 7)


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_keys(_relation(spark, sf_dir, "lineitem"), "c1")


def checksum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(_relation(spark, sf_dir, "orders"))


def _stats(exact: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for number in range(len(TABLES)):
            part = statistics_frame(catalog(spark, sf_dir)[number].df, exact).select(F.lit(number).cast("bigint").alias("relation"), F.col("column").cast("bigint").alias("column_no"), "n_rows", "n_distinct", "low", "high")
            out = part if out is None else out.union(part)
        return out

    return run


def _high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys moved to the high bits: unsigned values over the whole 64-bit range."""
    return _relation(spark, sf_dir, "orders").select(F.shiftleft("c0", 49).alias("c0"))


def sum_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _high(spark, sf_dir).agg(wrapping_sum(F.col("c0")).cast("string").alias("s0"))


def unsigned_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _high(spark, sf_dir).filter(compare(F.col("c0"), ">", 2**63, True))
    return rows.agg(F.count("*").alias("n_rows"), wrapping_sum(F.col("c0")).cast("string").alias("s0"))


def batch_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_frame(planner(spark, sf_dir), [TEXTS[name] for name in BATCH])


def sql_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's text, parsed, rendered as SQL and run by Spark's own parser."""
    catalog(spark, sf_dir).views()
    query = parse_query(parse_query(FLAGSHIP).to_text())
    return spark.sql(query.to_sql().replace('"', "`"))


def binary_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary relation, written to the shared folder, read back by the data source and queried."""
    place = shared_dir(spark)
    i = np.arange(2000)
    if not place.startswith(("file:", "/")):
        raise ValueError("this query writes its relation to a mounted folder")
    path = "/" + place.removeprefix("file:").lstrip("/") + f"/{uuid.uuid4().hex}.rel"
    write_relation(path, [i, i % 7, 3 * i % 1000])
    made = Catalog(spark)
    made.add_binary(path)
    return Planner(made).plan("0 0|0.1=1.0&0.0<2000|0.0 1.2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _planned(text) for name, text in TEXTS.items()} | {
        "projection": projection, "projection_row_ids": projection_row_ids, "late_materialize": late_materialize, "column_equality": column_equality,
        "join_rows": join_rows, "shuffle_hash_join": shuffle_hash_join, "cross_product": cross_product, "radix_partition_counts": radix_partition_counts,
        "distinct_keys": distinct, "checksum": checksum_all, "column_stats": _stats(True), "column_stats_approx": _stats(False),
        "wrapping_sum": sum_wrapping, "unsigned_filter": unsigned_filter, "batch_workload": batch_workload, "dump_sql_roundtrip": sql_roundtrip,
        "binary_relation": binary_relation, "late_materialize_all": late_materialize_all, "row_lookup": row_lookup, "cross_product_all": cross_product_all,
        "radix_partitions": radix_partitions, "in_memory_relation": in_memory_relation, "wrapping_join": wrapping_join, "protocol_session": protocol_session,
        "harness_report": harness_report, "query_printout": query_printout, "order_printout": order_printout, "column_stats_bounded": stats_bounded,
    }


def relations_sql() -> str:
    """The relations r0, r1, ... as common table expressions."""
    return "WITH " + ", ".join(f"r{k} AS (SELECT {', '.join(f'CAST({c} AS BIGINT) AS c{j}' for j, c in enumerate(columns))} FROM {table})" for k, (table, columns) in enumerate(TABLES)) + " "


def _text_sql(text: str) -> str:
    return relations_sql() + parse_query(text).to_sql()


def _answer_sql(number: int, text: str) -> str:
    query = parse_query(text)
    sums = ", ".join(f"coalesce(CAST(s{k} AS VARCHAR), 'NULL')" for k in range(len(query.sums)))
    return f"SELECT CAST({number} AS BIGINT) AS query_no, concat_ws(' ', {sums}) AS answer FROM ({query.to_sql()})"


def _stats_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS relation, CAST({j} AS BIGINT) AS column_no, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM {table}"
        for k, (table, columns) in enumerate(TABLES)
        for j, c in enumerate(columns)
    )


def oracle_sql() -> dict[str, str]:
    high = "(CAST(o_orderkey AS HUGEINT) * 562949953421312) % 18446744073709551616"
    ids = "SELECT o_orderkey AS c0, o_custkey AS c1, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders"
    batch = relations_sql() + " UNION ALL ".join(_answer_sql(k, TEXTS[name]) for k, name in enumerate(BATCH))
    lines = ["Sum 0.0, 1.0, 2.1, 3.1", *(f"  Join {x}" for x in ("0.0=1.0", "1.1=2.0", "0.2=3.0", "2.1=3.1")), "  Scan binding 0: relation 6", "  Scan binding 1: relation 5", "  Scan binding 2: relation 3", "  Scan binding 3: relation 2, 3.1>3"]
    return {name: _text_sql(text) for name, text in TEXTS.items()} | {
        "late_materialize_all": f"SELECT row_id, c0, c1 FROM ({ids})",
        "row_lookup": f"SELECT row_id, c0, c1 FROM ({ids}) WHERE row_id = 100",
        "cross_product_all": relations_sql() + 'SELECT CAST(NULLIF(SUM("0".c0), 0) AS BIGINT) AS s0, CAST(NULLIF(SUM("1".c0), 0) AS BIGINT) AS s1 FROM r1 "0", r0 "1"',
        "radix_partitions": "SELECT (l_orderkey >> 3) & 15 AS radix, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_homes FROM lineitem GROUP BY 1",
        "in_memory_relation": "SELECT CAST(SUM(k) AS BIGINT) AS s0, CAST(SUM(k * k) AS BIGINT) AS s1, CAST(SUM(n_regionkey) AS BIGINT) AS s2 FROM range(50) t(k) JOIN nation ON k = n_nationkey",
        "wrapping_join": "SELECT concat_ws(' ', CAST(SUM(CAST(l_orderkey AS HUGEINT) * 1099511627776) % 18446744073709551616 AS VARCHAR), CAST(SUM(CAST(s_nationkey AS HUGEINT) * 4503599627370496) % 18446744073709551616 AS VARCHAR)) AS answer FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        "protocol_session": batch,
        "harness_report": "SELECT true AS valid, CAST(2 AS BIGINT) AS n_batches, CAST(0 AS BIGINT) AS n_failures UNION ALL SELECT false, 2, 1",
        "query_printout": " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS line_no, '{line}' AS line" for k, line in enumerate(lines)),
        "order_printout": "SELECT i AS step, i + 1 AS n_joined, true AS has_estimate FROM range(4) t(i)",
        "column_stats_bounded": f"SELECT relation, column_no, n_rows, low, high, true AS near FROM ({_stats_sql()})",
        "projection": "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem",
        "projection_row_ids": ids,
        "late_materialize": f"SELECT row_id, c0, c1 FROM ({ids}) WHERE c1 < 10",
        "column_equality": "SELECT l_orderkey AS b0_c0, l_partkey AS b0_c1, l_suppkey AS b0_c2, CAST(l_linenumber AS BIGINT) AS b0_c3 FROM lineitem WHERE l_orderkey = l_partkey",
        "join_rows": "SELECT o_orderkey AS b0_c0, o_custkey AS b0_c1, c_custkey AS b1_c0, CAST(c_nationkey AS BIGINT) AS b1_c1 FROM orders JOIN customer ON o_custkey = c_custkey",
        "shuffle_hash_join": _text_sql(TEXTS["hash_join"]),
        "cross_product": relations_sql() + 'SELECT CAST(NULLIF(SUM("0".c0), 0) AS BIGINT) AS s0, CAST(NULLIF(SUM("1".c0), 0) AS BIGINT) AS s1 FROM r1 "0", r0 "1" WHERE "0".c0 < 5',
        "radix_partition_counts": "SELECT (l_orderkey >> 3) & 127 AS partition, count(*) AS n_rows FROM lineitem GROUP BY 1",
        "distinct_keys": "SELECT DISTINCT l_partkey AS c1 FROM lineitem",
        "checksum": "SELECT CAST(NULLIF(SUM(o_orderkey), 0) AS BIGINT) AS s0, CAST(NULLIF(SUM(o_custkey), 0) AS BIGINT) AS s1 FROM orders",
        "column_stats": _stats_sql(),
        "wrapping_sum": f"SELECT CAST(SUM({high}) % 18446744073709551616 AS VARCHAR) AS s0 FROM orders",
        "unsigned_filter": f"SELECT count(*) AS n_rows, CAST(SUM(v) % 18446744073709551616 AS VARCHAR) AS s0 FROM (SELECT {high} AS v FROM orders) WHERE v > 9223372036854775808",
        "batch_workload": batch,
        "dump_sql_roundtrip": _text_sql(FLAGSHIP),
        "binary_relation": "WITH r AS (SELECT i AS c0, i % 7 AS c1, 3 * i % 1000 AS c2 FROM range(2000) t(i)) SELECT CAST(SUM(a.c0) AS BIGINT) AS s0, CAST(SUM(b.c2) AS BIGINT) AS s1 FROM r a, r b WHERE a.c1 = b.c0 AND a.c0 < 2000",
    }
