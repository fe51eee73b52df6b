from codeprep.session import applied, recommended_settings


def test_partitions_follow_the_data(spark):
    small = recommended_settings(10 << 20, cores=8)
    assert small["spark.sql.shuffle.partitions"] == "8"
    middle = recommended_settings(1 << 40, cores=8_000)
    assert middle["spark.sql.shuffle.partitions"] == "8192"
    large = recommended_settings(100 << 40, cores=8_000)
    assert large["spark.sql.shuffle.partitions"] == "819200"
    for key in large:
        assert spark.conf.isModifiable(key)


def test_settings_last_as_long_as_the_job(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with applied(spark, 1 << 40):
        assert spark.conf.get(key) == "8192"
    assert spark.conf.get(key) == before
    with applied(spark, None):
        assert spark.conf.get(key) == before
