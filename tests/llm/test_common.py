import os

from pagequarry.llm import common


def test_interim_tables_are_deleted(spark):
    kept, used = common.stage_table(spark.range(10), "a-test"), common.stage_table(spark.range(5), "a-test")
    places = [next(iter(x.inputFiles())).removeprefix("file://").rsplit("/", 1)[0] for x in (kept, used)]
    common.drop_stage(used)
    assert [os.path.exists(p) for p in places] == [True, False] and kept.count() == 10
    common.remove_made([name for name in common._made if name.endswith(os.path.basename(places[0]))])
    assert not os.path.exists(places[0])
