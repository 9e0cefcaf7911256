"""Exports are written by many tasks, with the files that the queries count on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from workload import consolidation, sources


@pytest.fixture
def uncoalesced(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def lines(folder) -> dict[str, list[str]]:
    return {file.name: file.read_text().splitlines()[1:] for file in sorted(folder.glob("part-*"))}


def tasks(files) -> int:
    return len({name.split("-")[1] for name in files})


@pytest.mark.parametrize("n", [1000, 1001, 1049])
def test_files_of_equal_size(uncoalesced, tmp_path, n):
    rows = uncoalesced.range(n).select("id", (F.col("id") % 3).alias("other"))
    consolidation._write_files_of(rows, 50, [F.col("id")], str(tmp_path), "ads")
    files = lines(tmp_path / "ads")
    assert sorted(map(len, files.values()), reverse=True) == [50] * (n // 50) + [n % 50] * (n % 50 > 0)
    assert sorted(int(line.split(",")[0]) for own in files.values() for line in own) == list(range(n))
    assert tasks(files) > 1


def test_end_rows_end_the_last_range(uncoalesced, tmp_path):
    rows = uncoalesced.range(1000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    ends = uncoalesced.createDataFrame([(-1, '"open'), (-2, "z")], "k bigint, v string")
    sources._write_with_ends(rows, ends, str(tmp_path), "long")
    files = lines(tmp_path / "long")
    assert tasks(files) > 1 and sum(map(len, files.values())) == 1002
    assert [own[-2:] for own in files.values() if any(line.startswith("-") for line in own)] == [['-1,"open', "-2,z"]]


def test_short_files_hold_n_rows_each(spark, tmp_path):
    from workload.exports import write_short_files

    rows = spark.range(1, 1004, numPartitions=1).selectExpr("id", "id / 2 AS half")
    write_short_files(rows, 50, str(tmp_path), "short")
    names = sorted(p.name for p in (tmp_path / "short").iterdir() if p.name.startswith("part"))
    assert len(names) == 21 and all(name.endswith(".csv") for name in names)  # nothing else to list beside them
    texts = [(tmp_path / "short" / name).read_text().splitlines() for name in names]
    assert {text[0] for text in texts} == {"id,half"}
    assert [len(text) - 1 for text in texts] == [50] * 20 + [3]
    assert sorted(int(line.split(",")[0]) for text in texts for line in text[1:]) == list(range(1, 1004))
