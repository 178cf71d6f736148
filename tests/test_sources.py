import gzip
import json

from pyspark.sql import functions as F

from claimweave.sources import files
from claimweave.streaming import claim_stream

TEXT = """PM 123
TC 4
UT WOS:1
AU Doe, J
   Roe, R
C1 [Doe, J] Univ X, Town
ER
PM x
UT WOS:2
ER
"""


def test_tagged_text(spark, tmp_path):
    (tmp_path / "savedrecs.txt").write_text(TEXT)
    (tmp_path / "other.txt").write_text(TEXT)
    rows = files.read_tagged(spark, str(tmp_path)).orderBy("wos_id").collect()
    assert [(r["pmid"], r["cite_count"], r["wos_id"], r["authors"], r["affs"]) for r in rows] == [
        (123, "4", "WOS:1", "Doe, J|Roe, R", "[Doe, J] Univ X, Town"), (None, None, "WOS:2", None, None)]


def test_gene_dictionary_and_reports(spark, tmp_path):
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump({"response": {"docs": [{"hgnc_id": "H:1", "entrez_id": "5", "symbol": "abc"}, {"symbol": "x"}]}}, f)
    assert {tuple(r) for r in files.read_gene_dictionary(spark, str(tmp_path / "g.json.gz")).collect()} == {("H:1", 5, "abc"), (None, None, "x")}
    (tmp_path / "r").mkdir()
    for n in ("n_5_a", "n_5_it_3", "n_6_a"):
        (tmp_path / "r" / f"{n}.json").write_text('{"v": 1}')
    assert files.read_reports(spark, str(tmp_path / "r"), "n_5", ("it_",)).count() == 1


def test_keyed_store_prunes_partitions(spark, tmp_path):
    df = spark.range(50).withColumn("year", (F.col("id") % 5).cast("int"))
    files.write_keyed(df, str(tmp_path / "k"), ["year"])
    one = files.read_keyed(spark, str(tmp_path / "k"), year=3)
    assert one.count() == 10 and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, tmp_path):
    c = spark.read.parquet("/root/testdata/sf0.001/claims.parquet")
    c.repartition(5).write.parquet(str(tmp_path / "claims"))
    got = claim_stream.batch_counts_of(spark, str(tmp_path / "claims"))
    assert got.exceptAll(claim_stream.batch_counts(c)).count() == 0 and got.count() > 0


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark, tmp_path):
    import os
    for i, days in enumerate((["2024-01-10", "2024-01-10"], ["2024-01-10", "2024-01-12"], ["2024-01-01", "2024-01-12"])):
        spark.createDataFrame([(d + " 12:00:00", "click") for d in days], "ts string, event_type string").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        os.makedirs(tmp_path / "events", exist_ok=True)
        (part,) = (tmp_path / f"p{i}").glob("*.parquet")
        os.rename(part, tmp_path / "events" / f"{i}.parquet")
        os.utime(tmp_path / "events" / f"{i}.parquet", (1000 + i * 1000, 1000 + i * 1000))
    out = claim_stream.event_windows(spark, str(tmp_path / "events"), "1 day", maxFilesPerTrigger="1")
    assert {(str(r["start"])[:10], r["n"]) for r in out.collect()} == {("2024-01-10", 3), ("2024-01-12", 2)}


def test_configurations_and_models(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"f": ["x"]}')
    (tmp_path / "a.txt").write_text("x\n\n y \n")
    assert files.read_config(str(tmp_path / "a.json")) == {"f": ["x"]} and files.read_config(str(tmp_path / "a.txt")) == ["x", "y"]


def test_no_silent_local_folder(spark):
    import pytest

    from claimweave import session
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,4,6144]"):
        with pytest.raises(ValueError):
            session._own_folder(master)


def test_scratch_deletes_what_was_cut_inside(spark):
    from pathlib import Path

    from claimweave.session import cut, scratch
    with scratch(spark):
        df = cut(spark.range(5))
        (folder,) = {Path(f.removeprefix("file://").removeprefix("file:")).parent for f in df.inputFiles()}
        assert folder.exists() and df.count() == 5
    assert not folder.exists()
