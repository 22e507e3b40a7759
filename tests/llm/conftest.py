import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that the operators use inside, as columns of the input.
CLASHES = ("digest", "key", "n", "lines", "at", "group", "block", "size", "rank", "_key", "_at", "rate", "words", "features")


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text) rows with further columns of clashing names."""

    def build(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.repartition(3).withColumns({c: F.lit("x") for c in CLASHES})

    return build
