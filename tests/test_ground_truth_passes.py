"""Ground truth reads its images once, however many passes the colour fit takes."""

from pyspark.sql import functions as F

from emulsa.operators import alignment as al
from tests.test_training import shapes, table

def test_images_are_not_read_anew_in_every_pass(spark):
    target = shapes(48, 40)
    scan = 0.1 + 0.75 * target
    scan[10:17, 20:27] = 0.97
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    at = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 48, 40, 48, 40)], "image_id long, scale_x double, scale_y double, offset_x double, offset_y double, width int, height int, restored_width int, restored_height int")
    assert al.ground_truth(table(spark, scan).withColumn("r", counted("r")), table(spark, target), at).count() == 48 * 40

    assert read.value == 48 * 40  # twice before
