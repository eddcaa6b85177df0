from sectorscope.session import PARTITION_BYTES, shuffle_settings


def test_shuffle_partitions_follow_the_data():
    assert shuffle_settings(0)["spark.sql.shuffle.partitions"] == "200"
    assert shuffle_settings(10_000 * PARTITION_BYTES)["spark.sql.shuffle.partitions"] == "10000"
    assert shuffle_settings(10_000 * PARTITION_BYTES + 1)["spark.sql.shuffle.partitions"] == "10001"
