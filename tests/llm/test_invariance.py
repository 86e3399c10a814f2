"""Results don't depend on how rows are spread."""

from pathlib import Path

import pytest

from stratalith.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["p1_found", "p1_classes", "p4_pieces", "p6_ids", "p7_containers", "p8_levels"])
def test_one_and_seven_partitions_give_the_same(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = queries.QUERIES[name](spark, DATA)
            seen.append(sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and seen[0]
