import random

from pyspark.sql import functions as F

from sedge.operators.paging import Listing


def test_a_deep_page_reads_few_ranges(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *range(50)])) for i in range(4000)]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))]
    df = spark.createDataFrame(rows, "id long, k int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listing = Listing.write(df, [F.col("k").asc_nulls_last(), F.desc("id")], f"file://{tmp_path}/l", ranges=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for offset, limit in ((0, 7), (1999, 40), (3990, 50), (3000, 1), (0, 4000), (10_000, 5)):
        page = listing.page(offset, limit)
        assert [r.id for r in page.collect()] == want[offset : offset + limit]
        if limit < 100 and offset < 4000:
            assert len({f.split("_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 2
    assert len(listing._counts()) > 8
    assert Listing.write(df.where("1 = 0"), ["id"], f"file://{tmp_path}/none").page(0, 5).count() == 0
