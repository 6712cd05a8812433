import glob

from trustweave.sources.shared import CLEANUP, dropped, stored


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, held = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(5000).repartition(3, "id")
    made = stored(df)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == held
    assert made.count() == 5000 and df.count() == 5000


def test_dropped_tables_go_and_others_stay(spark):
    gone, kept = stored(spark.range(10)), stored(spark.range(20))
    at = gone._stored_at.removeprefix("file:")
    assert glob.glob(f"{at}/*.parquet")
    dropped(gone)
    assert not glob.glob(f"{at}/*")
    assert kept.count() == 20
