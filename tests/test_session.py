import pytest

from claimsieve.session import materialize, release, release_group, shared_folder, step_group


def test_step_tables_live_in_the_shared_folder_until_released(spark):
    step = materialize(spark.range(5), "probe")
    assert step.count() == 5
    assert shared_folder(spark) in step.inputFiles()[0]
    assert release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(step.inputFiles()[0]).count()


def test_schema_survives(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert materialize(df).dtypes == df.dtypes


def test_every_call_writes_its_own_table(spark):
    assert len({materialize(spark.range(2), "same").inputFiles()[0] for _ in range(3)}) == 3


def test_a_group_of_step_tables_goes_at_once(spark):
    with step_group("stage") as group:
        inner = materialize(spark.range(5), "inner")
        with step_group("deeper"):
            deeper = materialize(inner.where("id > 1"), "deep")
    outside = materialize(deeper, "outside")
    assert not release_group(spark, group, deeper) and deeper.count() == 3
    assert release_group(spark, group, outside) and outside.count() == 3
    assert not any(group in f for f in outside.inputFiles())
    with pytest.raises(Exception, match="(?i)does not exist|not found"):
        inner.count()
