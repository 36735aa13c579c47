"""Steps that shuffle long texts are made in slices, one on disk at a time."""

import pytest

from inboxlake.plans import QUERIES
from inboxlake.sources import tables

FOLDER = "/root/testdata/sf0.001"


def shuffled(spark):
    """Files of shuffles on the disk of this process."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")]


def test_what_a_slice_shuffled_is_dropped(spark, rows):
    df = spark.range(500).selectExpr("id", "concat('text ', id) as text")
    key, folder, before = tables._CLEANUP, tables.workspace(spark), set(shuffled(spark))
    was = spark.conf.get(key, None)
    left = []

    def build(k):
        left.append(set(shuffled(spark)) - before)
        return df.where(tables.of_slice("id", k, 3)).repartition(3, "text").groupBy("text").count()

    made = tables.in_slices(build, 3, folder, "texts")
    assert left == [set()] * 3 and not set(shuffled(spark)) - before and spark.conf.get(key, None) == was
    assert rows(made) == rows(df.groupBy("text").count())


def test_every_row_has_one_slice(spark):
    df = spark.range(1000).selectExpr("nullif(id, 7) as id")
    sizes = [df.where(tables.of_slice("id", k, 5)).count() for k in range(5)]
    assert sum(sizes) == 1000 and min(sizes) > 100


@pytest.mark.parametrize("name", ["E14_identity_translation", "E14_translation_write_back", "F14_summary_transcript", "F19_case_context", "F24_summary_case"])
def test_slices_give_the_same_rows(spark, rows, monkeypatch, name):
    whole = rows(QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(tables, "SLICE_ROWS", 500)
    made = QUERIES[name](spark, FOLDER)
    assert len({f.split("slice=")[1][0] for f in made.inputFiles()}) > 1
    assert rows(made) == whole
