"""Shared-folder and partitioning helpers."""
import pytest

from variantlake.session import scratch_path, shared_dir


def test_checkpoint_dir_is_read_from_the_session_and_kept(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured  # never replaced when the cluster names one
    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert a.startswith(configured.rstrip("/") + "/tables/") and a != b  # fresh path per use


def test_a_cluster_without_a_shared_folder_is_an_error():
    class _Cluster:  # a session whose master is a cluster and whose setting is unset
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_dir(_Cluster)
