"""Scratch tables whose Python steps get batches by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from prismdex.sources import scratch


def test_python_steps_of_a_written_table_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows, name = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), F.lit(5000)).alias("text")), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = [r.n for r in scratch.written_by_bytes(rows.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) > 20_000_000 and max(found) < 5_000_000
    assert spark.conf.get(name) == before
