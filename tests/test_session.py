"""Session helpers only fill settings the session leaves unset."""
from riskloom import session


def test_defaults_do_not_override_explicit_settings(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    unset = [k for k in session.CLUSTER_SETTINGS if spark.conf.get(k, None) is None]
    try:
        session.apply_cluster_settings(spark)  # shuffle partitions was set explicitly by the test session
        assert spark.conf.get("spark.sql.shuffle.partitions") == old
        assert all(spark.conf.get(k) == session.CLUSTER_SETTINGS[k] for k in unset)
    finally:
        for k in unset:
            spark.conf.unset(k)


def test_checkpoint_dir_comes_from_the_context(spark):
    assert session.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert session.ensure_checkpoint_dir(spark) == session.checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        assert named.replace("file:", "").rstrip("/") in session.checkpoint_dir(spark)


def test_ensure_defaults_keeps_explicit_values(spark):
    spark.conf.set("spark.sql.codegen.maxFields", "150")
    try:
        session.ensure_defaults(spark)
        assert spark.conf.get("spark.sql.codegen.maxFields") == "150"
    finally:
        spark.conf.set("spark.sql.codegen.maxFields", "1000")


def test_scan_splits_leave_room_for_the_sort_of_the_last_k(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        session.ensure_defaults(spark)
        assert spark.conf.get(key) == "32m"
        spark.conf.set(key, "64m")
        session.ensure_defaults(spark)
        assert spark.conf.get(key) == "64m"
    finally:
        spark.conf.set(key, old)
