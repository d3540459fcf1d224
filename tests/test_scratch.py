import pytest
from simloom.operators.components import connected_components
from simloom.scratch import materialize, release, scratch_dir


class _Elsewhere:
    """A session on a cluster that names no shared folder."""

    class sparkContext:
        master, applicationId = "spark://host:7077", "a"

        class _jsc:
            @staticmethod
            def sc():
                class none:
                    @staticmethod
                    def getCheckpointDir():
                        class empty:
                            isDefined = staticmethod(lambda: False)

                        return empty

                return none

        getConf = staticmethod(dict)

    class conf:
        get = staticmethod(lambda key, default: default)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        scratch_dir(_Elsewhere)


def test_released_tables_are_gone(spark):
    t = materialize(spark.range(5), "five")
    assert t.count() == 5
    release(t)
    with pytest.raises(Exception):
        spark.read.parquet(t._scratch)


def test_rounds_of_components_are_released(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
