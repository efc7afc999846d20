"""What errors of data say."""

import pytest
from pyspark.sql import functions as F

from lexisim.functions.scorers import Aline, Editex


def test_unknown_tokens_name_place_and_side(spark):
    rows = spark.createDataFrame([("ab", "b a\u6771")], "x string, y string")
    with pytest.raises(Exception, match="UnknownToken: Aline knows no sound \u6771 at 2 of y"):
        rows.select(Aline().similarity(F.col("x"), F.col("y"))).collect()
    few = Editex(group={"a": [0], "b": [1]})
    with pytest.raises(Exception, match="UnknownToken: Editex knows no letter c at 1 of x"):
        rows.select(few.similarity(F.lit("a-C"), F.col("x"))).collect()
    assert rows.select(Aline(strict=False).similarity(F.col("x"), F.col("y"))).first()[0] is None
