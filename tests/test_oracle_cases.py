"""Registered queries against their SQL on rows that the smallest driver tables lack."""

import os
import re
from datetime import datetime

import pytest
from oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from tallyforge.catalog import Tables, load
from tallyforge.operators.ordering import oldest_pending

FOLDER = "/root/testdata/sf0.001"


def problem(spark, tmp_path, name, **changed):
    """Compare on the smallest tables, some of them replaced."""
    for table in TABLES:
        path = f"{tmp_path}/{table}.parquet"
        if table in changed:
            changed[table].toPandas().to_parquet(path, coerce_timestamps="us")
        else:
            os.symlink(f"{FOLDER}/{table}.parquet", path)
    entry = load()[name]
    return compare(entry.run(Tables(spark, str(tmp_path))), connect(str(tmp_path)), entry.sql)


@pytest.mark.parametrize("name", ["co18_gate_claims", "p10_normalize_range", "p14_assessment_status"])
def test_ranges_of_zero_and_negative_values(spark, tmp_path, name):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    value = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, -F.col("value")).otherwise(F.col("value"))
    assert problem(spark, tmp_path, name, events=events.withColumn("value", value)) is None


@pytest.mark.parametrize("name", ["co23_normalize_filings", "co23_filing_delta", "co23_filing_claims", "st2_matches_id"])
def test_keys_of_seven_digits_are_no_accession(spark, tmp_path, name):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    shifted = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1_000_000).otherwise(F.col("o_orderkey"))
    assert problem(spark, tmp_path, name, orders=orders.withColumn("o_orderkey", shifted)) is None


def test_outcome_on_the_end_of_an_interval_is_inside(spark, tmp_path):
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(1)
    early = [(q, datetime(1997, 1, 1)) for q in [11.0, 11.0] + [15.0] * 12]  # p10 is 12.2
    late = [(q, datetime(1999, 1, 1)) for q in [12.0] * 4 + [13.0]]  # so is the mean
    rows = spark.createDataFrame(early + late, "l_quantity double, l_shipdate timestamp")
    lines = rows.crossJoin(line.drop("l_quantity", "l_shipdate")).withColumn("l_partkey", F.lit(1).cast("bigint")).select(*line.columns)
    lines = lines.withColumns({"l_shipdate": F.col("l_shipdate").cast("timestamp_ntz")})
    assert problem(spark, tmp_path, "co14_score_forecasts", lineitem=lines) is None
    assert [r.inside_p10_p90 for r in load()["co14_score_forecasts"].run(Tables(spark, str(tmp_path))).collect()] == [True]


@pytest.mark.parametrize("name", ["co29_capture_documents", "s5_read_hashed_files"])
def test_empty_and_missing_texts_are_captured(spark, tmp_path, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("text"))
    assert problem(spark, tmp_path, name, documents=documents.withColumn("text", text)) is None


def test_an_empty_file_is_a_problem_unless_allowed(spark):
    from tallyforge.plans.filings import capture_documents

    known = spark.createDataFrame([(1,), (2,)], "accession_number long")
    requests = known.select("accession_number", F.lit("read").alias("review_reason"), F.lit(None).cast("string").alias("expected_sha256"))
    files = spark.createDataFrame([(1, "a.txt", 0, "x"), (2, "b.txt", 1, "y")], "accession_number long, name string, bytes long, sha256 string")
    verdicts = lambda **more: {r.accession_number: r.problem for r in capture_documents(known, requests, files, **more).collect()}
    assert verdicts() == {1: "file_empty", 2: None}
    assert verdicts(least=0) == {1: None, 2: None}


def test_racks_of_a_component_that_just_miss_demand(spark, tmp_path):
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(1)
    parts = [(d, s, q, c) for d, first in ((1, 4.0), (2, 10.0)) for s, q, c in ((1, first, "F"), (2, 40 - first, "F"), (3, 60.0, "O"))]  # 4 and 36 miss 24 racks by the last bit
    rows = spark.createDataFrame(parts, "l_orderkey long, l_suppkey long, l_quantity double, l_linestatus string").withColumns({"l_linenumber": F.lit(1), "l_returnflag": F.lit("N")})
    lines = rows.crossJoin(line.drop(*rows.columns)).select(*line.columns)
    assert problem(spark, tmp_path, "co5_assembly_pool", lineitem=lines) is None
    assert {r.draw_index: r.demand_limited for r in load()["co5_assembly_pool"].run(Tables(spark, str(tmp_path))).collect()} == {1: False, 2: True}


def test_a_steady_sum_does_not_depend_on_order(spark):
    from itertools import permutations

    from tallyforge.functions.maths import steady_sum

    values = [3.4200000000000004, 9.261, 11.318999999999997]  # 24.0 or the number below, by order
    rows = [(i, v) for i, order in enumerate(permutations(values)) for v in order]
    sums = spark.createDataFrame(rows, "i int, v double").coalesce(1).groupBy("i").agg(F.sum("v").alias("plain"), steady_sum("v").alias("steady")).collect()
    assert {r.plain for r in sums} == {24.0, 23.999999999999996} and {r.steady for r in sums} == {23.999999999999996}


def test_pages_of_any_key_are_in_the_manifest(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").limit(12)
    odd = F.when(F.col("page_id") % 3 == 0, -1 - F.col("page_id")).when(F.col("page_id") % 3 == 1, F.lit(7)).otherwise(F.col("page_id"))
    assert problem(spark, tmp_path, "sk4_build_manifest", pages=pages.withColumns({"page_id": odd, "html": F.concat("html", F.lit("\r\n\u00e9"))})) is None


@pytest.mark.parametrize("store", ["file://", "viewfs://made"])
def test_files_are_written_whole_and_again_in_the_same_places(spark, tmp_path, store):
    from tallyforge.sources.readers import read_files
    from tallyforge.sources.writers import write_files

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.made.link./tmp", "file:///tmp")
    key = F.when(F.col("id") > 9, F.col("id") % 100 - 50)  # some have none
    rows = spark.range(200).select(key.alias("k"), F.concat(F.lit("text "), "id").alias("text"))
    for order in (F.col("text"), F.col("text").desc()):
        paths = write_files(rows.repartition(3).sortWithinPartitions(order), f"{store}{tmp_path}/out dir", "k", "text")
        found = read_files(paths, f"{store}{tmp_path}/out dir").collect()
        files = [f"{at}/{f}" for at, _, names in os.walk(f"{tmp_path}/out dir") for f in names if f.endswith(".txt")]
        assert len({r.path for r in found}) == 200 and {re.search(r".*k=(-?\w+)", r.path)[1] for r in found} == {"__HIVE_DEFAULT_PARTITION__", *map(str, range(-50, 50))}
        assert {r.content.decode() for r in found} == {f"text {i}\n" for i in range(200)}
        if store != "file://":
            break  # Spark names these anew
        assert len(files) == 200 and not [f for _, _, names in os.walk(f"{tmp_path}/out dir") for f in names if not f.endswith(".txt")]


def test_a_delivery_without_limit_leaves_nothing(spark):
    state = spark.range(10_001).select(F.col("id").alias("event_id"), F.lit("pending").alias("status"), F.col("id").alias("created_at"))
    assert oldest_pending(state, 10_000).count() == 10_000
    assert oldest_pending(state, None).count() == 10_001


def test_documents_are_one_file_each_in_one_folder(spark, tmp_path):
    from tallyforge.catalog.pipeline import documents

    documents(spark.range(40).select(F.col("id").cast("string").alias("value"))).text(f"file://{tmp_path}/out")
    assert sorted(int(r.value) for r in spark.read.text(f"file://{tmp_path}/out", wholetext=True).collect()) == list(range(40))
    assert len([f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".txt") and os.path.getsize(f"{tmp_path}/out/{f}")]) == 40


def test_table_queries_start_with_many_partitions_and_leave_none_behind(spark):
    from tallyforge.session import INITIAL_PARTITIONS, tune

    assert tune(spark, 400).conf.get(INITIAL_PARTITIONS) == "400"
    assert tune(spark).conf.get(INITIAL_PARTITIONS, None) is None
