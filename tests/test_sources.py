"""Binary relations, unsigned values, the catalog and the protocol."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyweave.functions.unsigned import from_signed, to_signed
from tallyweave.operators import joins, scans
from tallyweave.plans.parser import parse_query
from tallyweave.plans.planner import Planner
from tallyweave.sources import relbin
from tallyweave.sources.catalog import Catalog
from tallyweave.streaming.protocol import read_batches, read_relations, serve

EDGES = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]


@pytest.fixture
def basic(tmp_path):
    i = np.arange(2000)
    relbin.write_relation(str(tmp_path / "basic"), [i, i % 7, 3 * i % 1000])
    return str(tmp_path / "basic")


def answers(catalog, *texts):
    return [Planner(catalog).answer(t).first()["answer"] for t in texts]


@pytest.mark.parametrize("converted", [False, True])
def test_basic_relation(spark, basic, tmp_path, converted):
    catalog = Catalog(spark)
    catalog.add_binary(basic, parquet=str(tmp_path / "basic.parquet") if converted else None)
    assert catalog.widths() == [3] and catalog[0].count() == 2000
    assert answers(catalog, "0|0.0<2000|0.0 0.1 0.2", "0 0|0.1=1.0|0.0 1.2") == ["1999000 5995 999000", "1999000 17985"]
    stats = catalog.stats(0)
    assert stats.rows == 2000 and (stats.columns[1].low, stats.columns[1].high) == (0, 6)


def test_split_reads_and_chosen_columns(spark, basic):
    relbin.read_relation(spark, basic)
    df = spark.read.format("relbin").option("columns", "2,0").option("rows", "300").load(basic)
    assert df.columns == ["c2", "c0"] and df.rdd.getNumPartitions() == 7
    assert df.agg(F.sum("c0"), F.sum("c2")).first()[:] == (1999000, 999000)


def test_unsigned_values(spark, tmp_path):
    path = str(tmp_path / "edges")
    relbin.write_relation(path, [np.array(EDGES, np.uint64)])
    catalog = Catalog(spark)
    catalog.add_binary(path, unsigned=True)
    catalog.add_columns([EDGES], unsigned=True)
    for r in (0, 1):
        assert answers(catalog, f"{r}|0.0>10|0.0", f"{r}|0.0<9223372036854775808|0.0", f"{r}|0.0=18446744073709551615|0.0", f"{r}|0.0>18446744073709551615|0.0") == ["18446744073709551614", "9223372036854775808", "18446744073709551615", "NULL"]
    assert (catalog.stats(0).columns[0].low, catalog.stats(0).columns[0].high) == (0, 2**64 - 1)
    assert all(from_signed(to_signed(v)) == v for v in EDGES)


def test_large_constants_on_plain_columns(spark):
    catalog = Catalog(spark)
    catalog.add_columns([[1, 2, 3]])
    assert answers(catalog, "0|0.0<9223372036854775808|0.0", "0|0.0>9223372036854775808|0.0", "0|0.0=9223372036854775808|0.0") == ["6", "NULL", "NULL"]


def test_sum_that_wraps_to_zero(spark):
    catalog = Catalog(spark)
    catalog.add_columns([[2**63, 2**63]], unsigned=True)
    assert answers(catalog, "0||0.0") == ["NULL"]


def test_sums_over_the_signed_range_wrap(spark):
    """Plain relations too: sums are mod 2^64, joined and summed up early or not, with statistics or without."""
    catalog = Catalog(spark)
    catalog.add_columns([[2**62] * 3, [1, 1, 2]])
    catalog.add_columns([[1, 1, 2, 2, 2], [2**61, 5, 7, 2**62, 2**62]])
    assert answers(catalog, "0||0.0", "0||0.1") == [str(3 * 2**62), "4"]
    joined = [(a, b) for a, k in zip([2**62] * 3, [1, 1, 2], strict=True) for j, b in zip([1, 1, 2, 2, 2], [2**61, 5, 7, 2**62, 2**62], strict=True) if j == k]
    want = " ".join(str(sum(x[i] for x in joined) % 2**64 or "NULL") for i in (0, 1))
    for options in ({}, {"eager_rows": 0}, {"order": "text"}):
        assert Planner(catalog, **options).answer("0 1|0.1=1.0|0.0 1.1").first()["answer"] == want
    assert dict(Planner(catalog).plan("0||0.1").dtypes) == {"s0": "bigint"} and dict(Planner(catalog).plan("0||0.0").dtypes) == {"s0": "decimal(20,0)"}


def test_unsigned_relations_are_summed_up_early(spark):
    """Values of 2^63 and over, as summed columns, as the join's keys and beside a plain relation, against plain Python."""
    left, right = [[2**63, 2**64 - 1, 2**63 + 5, 7, 2**62] * 8, [2**64 - 1, 1, 2**63, 2**64 - 1, 1] * 8], [[2**64 - 1, 2**64 - 1, 1, 3] * 8, [2**63 + 1, 2**64 - 2, 9, 1] * 8]
    plain = [[1, 1, 2] * 8, [4, 2**62, 6] * 8]
    catalog = Catalog(spark)
    catalog.add_columns(left, unsigned=True)
    catalog.add_columns(right, unsigned=True)
    catalog.add_columns(plain)
    for number, other in ((1, right), (2, plain)):
        text = f"0 {number}|0.1=1.0|0.0 1.1 0.1"
        joined = [(a, b, k) for a, k in zip(*left, strict=True) for j, b in zip(*other, strict=True) if j == k]
        want = " ".join(str(sum(x[i] for x in joined) % 2**64 or "NULL") for i in range(3))
        assert Planner(catalog, eager_rows=0).eager(parse_query(text)) == {0, 1}
        for options in ({"eager_rows": 0}, {"eager_rows": None}, {"order": "text"}):
            assert Planner(catalog, **options).answer(text).first()["answer"] == want


def test_conversion_follows_its_file(spark, tmp_path):
    """A grown file and a half-written conversion are converted again; an unchanged one is not."""
    path, parquet = str(tmp_path / "r"), str(tmp_path / "r.parquet")
    counts = []
    for rows, spoil in ((10, False), (50, False), (50, True)):
        relbin.write_relation(path, [np.arange(rows)])
        if spoil:
            (tmp_path / "r.parquet" / "_SUCCESS").unlink()
        counts.append(spark.read.parquet(relbin.convert(spark, path, parquet)).count())
    made = {p.name for p in (tmp_path / "r.parquet").iterdir()}
    relbin.convert(spark, path, parquet)
    assert counts == [10, 50, 50] and {p.name for p in (tmp_path / "r.parquet").iterdir()} == made


def test_binary_scans_read_the_columns_in_use(spark, basic):
    catalog = Catalog(spark)
    catalog.add_binary(basic)
    assert catalog[0].read((2,)).columns == ["c2"] and answers(catalog, "0|0.2>990|0.2") == [str(sum(v for v in (3 * i % 1000 for i in range(2000)) if v > 990))]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tallyweave.functions.workers import shared_dir

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(unset)


def test_a_failing_query_loses_no_other_answer(spark, basic):
    sink = io.StringIO()
    with pytest.raises(ValueError):
        serve(spark, io.StringIO(f"{basic}\nDone\n0|0.0<2000|0.0\n0|0.9<1|0.0\n0|0.0=3|0.1\nF\n"), sink)
    assert sink.getvalue() == "1999000\nERROR\n3\n"


def test_tiny_and_empty_relations(spark, tmp_path):
    relbin.write_relation(str(tmp_path / "tiny"), [np.arange(5)])
    relbin.write_relation(str(tmp_path / "empty"), [np.zeros(0, int), np.zeros(0, int)])
    catalog = Catalog(spark)
    catalog.add_binary(str(tmp_path / "tiny"))
    catalog.add_binary(str(tmp_path / "empty"))
    assert answers(catalog, "0|0.0>0|0.0", "1||0.0 0.1", "0 1|0.0=1.0|0.0") == ["10", "NULL NULL", "NULL"]


@pytest.mark.parametrize("raw", [struct.pack("<QQ", 10, 2) + b"\0" * 48, b"123", struct.pack("<QQ", 1, 1) + b"\0" * 9])
def test_broken_files(tmp_path, raw):
    path = tmp_path / "broken"
    path.write_bytes(raw)
    with pytest.raises(relbin.RelationFileError):
        relbin.read_header(str(path))


def test_missing_file(tmp_path):
    with pytest.raises(relbin.RelationFileError):
        relbin.read_header(str(tmp_path / "none"))


def test_batches():
    lines = ["a", "b", "F", "", "c", "F", "F", "d"]
    assert list(read_batches(lines)) == [["a", "b"], ["c"], [], ["d"]]
    assert read_relations(iter(["x\n", "\n", "y\n", "Done\n", "z\n"])) == ["x", "y"]


def test_protocol(spark, basic, tmp_path):
    text = f"{basic}\n/root/testdata/sf0.001/orders.parquet\nDone\n0|0.0<2000|0.0\n0 0|0.1=1.0|1.2\nF\n1||0.0\n0|0.0>5000|0.0\nF\n"
    sink = io.StringIO()
    serve(spark, io.StringIO(text), sink, parquet_dir=str(tmp_path / "converted"))
    assert sink.getvalue() == f"1999000\n17985\n{1499 * 750}\nNULL\n"


def test_radix_partitions_keep_keys_together(spark):
    df = joins.radix_partition(spark.range(1000).select((F.col("id") % 64).alias("k")), "k", 1, 3)
    homes = df.select(F.spark_partition_id().alias("p"), joins.radix("k", 1, 3).alias("r")).distinct()
    assert homes.count() == homes.select("r").distinct().count() == 8


@pytest.mark.parametrize("n", [0, 1, 500])
def test_row_ids(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 1009).alias("k"))
    rows = scans.with_row_ids(df, "k", slots=8).orderBy("k").collect()
    assert [r.row_id for r in rows] == list(range(n))
    assert scans.row_at(scans.with_row_ids(df, "k", slots=8), "row_id", 3).count() == (n > 3)
