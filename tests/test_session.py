import pytest

from rankfold import session as ss


def test_lineage_is_cut_in_the_configured_folder(spark):
    folder = spark.conf.get(ss.CHECKPOINT_KEY)
    saved = ss.cut_lineage(spark.range(5).withColumnRenamed("id", "n"))
    assert saved.count() == 5
    assert all(f.replace("file://", "").startswith(folder) for f in saved.inputFiles())


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class NoDir:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: NoDir())})

    with pytest.raises(RuntimeError):
        ss.shared_dir(type("Session", (), {"conf": Conf(), "sparkContext": Context()}))
