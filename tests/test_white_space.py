"""Masking, squashing and cell trimming follow Python's idea of digits and white space."""

import re

from pyspark.sql import functions as F

from shipshape.functions.exprs import squash_spaces
from shipshape.operators.sampling import mask_text
from shipshape.sources.files import read_csv_trimmed

TEXTS = ["tel 11 9999 8888 7777 ok", "  call 123456789\n", "١٢٣٤٥٦٧٨٩!", "1\x0b2\x0b3 4-5.6\t7 8 9 ", "12345678", "", "a   b\x85"]


def test_mask_and_squash_equal_python(spark):
    phone = re.compile(r"(?:\d[\s.\-]?){9,}")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", mask_text(F.col("t")).alias("m"), squash_spaces(F.col("t")).alias("s")).collect()
    assert [r["m"] for r in rows] == [phone.sub("[number removed] ", r["t"]).strip() for r in rows]
    assert [r["s"] for r in rows] == [" ".join(r["t"].split()) for r in rows]


def test_cells_are_trimmed_of_every_white_space(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n"late\n","\tx "\n" ",y\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv_trimmed(spark, str(tmp_path / "x.csv")).collect()] == [("late", "x"), (None, "y")]
