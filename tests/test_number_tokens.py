"""Plain numbers lose trailing zeros as they stand; only others are parsed and formatted."""

import pytest
from pyspark.sql import functions as F

from corpusengine.functions.text import number_token


def test_plain_numbers_need_no_formatting(spark, monkeypatch):
    plain = {"12.50": "12.5", "−1,200.00%": "-1200", "10": "10", "100.": "100", "1234567890": "1234567890"}
    other = {"12345678901": "1.23456789e+10", "007.10": "7.1", "5.0\n": "5", "0": "0", "1.2.0": None}
    tokens = lambda raw: [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(number_token(F.col("t"))).collect()]
    assert tokens(plain | other) == list((plain | other).values())
    # formatting is what takes the time
    monkeypatch.setattr(F, "format_string", lambda *a: F.raise_error(F.lit("formatted")).cast("string"))
    assert tokens(plain) == list(plain.values())
    with pytest.raises(Exception, match="formatted"):
        tokens(["007.10"])
