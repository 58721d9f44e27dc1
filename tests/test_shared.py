import os
from types import SimpleNamespace

from sluice.sources.shared import shared_folder


def test_the_folder_that_the_cluster_names(spark, tmp_path):
    # the setting can't be changed in a running session
    conf = SimpleNamespace(get=lambda key, default=None: f"file://{tmp_path}/" if key == "spark.checkpoint.dir" else default)
    named = SimpleNamespace(conf=conf, sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)
    own = shared_folder(named)
    assert own == f"file://{tmp_path}/sluice-{spark.sparkContext.applicationId}" == shared_folder(named)
    assert os.path.isdir(own.removeprefix("file://"))
    spark.range(5).write.parquet(f"{own}/x")
    assert spark.read.parquet(f"{own}/x").count() == 5
    assert os.path.isdir(shared_folder(spark))
