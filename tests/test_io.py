"""IO1/IO2: blank-delimited text in, typed table out, Parquet round trip with labels."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from survspan.operators import clean
from survspan.sources import read_text_table, write_table


def test_text_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="survspan-io-")
    path = os.path.join(d, "in.dat")
    with open(path, "w") as f:
        f.write("0048  1 .   3.5\n")
        f.write("  7 0   2.0  .\n")
        f.write("bad line\n")
        f.write("12 1 x 4\n")
    names = ["id", "male1female0", "gfr", "income"]
    good, bad = read_text_table(spark, path, names)
    assert bad.count() == 1
    t = clean.id_as_string(clean.to_numeric(clean.null_token(good, "."), ["male1female0", "gfr", "income"]), "id")
    got = rows(t)
    assert got == [("12", 1.0, None, 4.0), ("48", 1.0, None, 3.5), ("7", 0.0, 2.0, None)]
    t = clean.label(t, {"gfr": "estimated GFR"})
    out = os.path.join(d, "out.parquet")
    write_table(t, out)
    back = spark.read.parquet(out)
    assert back.schema["gfr"].metadata.get("label") == "estimated GFR"
    assert rows(back) == got


def test_select_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "id int, YearsA int, b int, c int, YearsB int")
    assert clean.select_names(df, "id", "contains:years") == ["id", "YearsA", "YearsB"]
    assert clean.select_names(df, "YearsA:c") == ["YearsA", "b", "c"]
    assert clean.select_names(df, "-contains:years", "-id") == ["b", "c"]
