import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.sources import png
from folio.sources.batches import tasks


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("size", (1, 2, 3, 8))
def test_rows_are_filtered_together_and_undone(kind, size):
    rows = np.random.default_rng(kind).integers(0, 256, (7, 5 * size), np.uint8)
    above = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    lines = png.filtered(kind, rows, above, size)
    assert lines.shape == (7, 5 * size + 1) and all(png.undone(x[0], x[1:].tobytes(), a.tobytes(), size) == r.tobytes() for x, a, r in zip(lines, above, rows))


def test_crops_of_small_rows_are_dealt_to_many_tasks(spark):
    content = png.encoded(np.arange(48, dtype=np.uint8).reshape(6, 8, 1))
    images = spark.range(40).selectExpr("concat('d', id) AS token", "cast(id % 3 AS int) AS page").withColumn("content", F.lit(bytearray(content)))
    crops = images.selectExpr("token", "page", "'c' AS name", "1 AS x1", "2 AS y1", "4 AS x2", "5 AS y2", "90 AS turn")
    found = png.crop_images(images, crops)
    rows = found.selectExpr("*", "spark_partition_id() AS task").collect()
    assert len(rows) == 40 and len({r.task for r in rows}) > 4 and tasks(spark) > 4
    want = np.rot90(np.arange(48, dtype=np.uint8).reshape(6, 8, 1)[2:5, 1:4], -1)
    assert all((png.whole(bytes(r.content)) == want).all() for r in rows)
