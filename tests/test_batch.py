"""What a batch of searches moves follows its tables, not the matches of its queries."""

from pathlib import Path

import pytest

from stratalith.plans import registry

DATA = "/root/testdata/sf0.01"


def _moved(spark) -> int:
    """Bytes exchanged and spilled so far."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in stages)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables aren't here")
def test_batch_search_moves_less_than_four_times_its_tables(spark):
    before = _moved(spark)
    assert registry.QUERIES["batch_search"](spark, DATA).count() == 400
    size = sum(f.stat().st_size for name in ("nodes", "dropped_hits") for f in [Path(f"{DATA}/{name}.parquet")])
    assert 0 < _moved(spark) - before < 4 * size
