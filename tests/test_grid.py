"""Grids of trials from tables of few tasks."""

from pyspark.sql import functions as F

from rdlab.plans import catalog, grid


def test_the_grid_is_made_by_many_tasks(spark):
    images = spark.range(50).select(F.concat(F.lit("/a.b/IMG_"), "id", F.lit(".tar.png")).alias("path"), F.lit(64).alias("width"), F.lit(32).alias("height")).coalesce(1)
    named = images.withColumn("image", grid.image_part(F.col("path"), [F.col("width"), F.col("height")]))
    rows = grid.trial_grid(named, catalog.codec_catalog(spark).where("media = 'image' and depth = 8 and mode = 'lossy'"))
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("path", grid.trial_id(F.col("image"), F.col("codec"), F.col("target_metric"), F.col("target_value"), F.col("sub_sampling"), F.lit(0)).alias("id"), "codec", "sub_sampling").collect()
    assert len(ids) == 50 * 35
    for r in ids:
        assert r["id"] == f"{r['path'].split('/')[-1][:-4]}_png_64x32_{r['codec']}_psnr_avg_0.0_{r['sub_sampling']}_0_"
