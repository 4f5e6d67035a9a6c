from __future__ import annotations

import csv
import io

import pytest


from chemlattice.sources import rejects

csv.field_size_limit(1 << 20)
GOOD = "7,CCO,name,46.07,2020-02-29"
CASES = [
    (GOOD, None), (GOOD + "\r", None), (GOOD + "\r\r", "registered_on"), ('"7","CCO","a ""b"", c\nd","",2020-01-01', None), ("7,CCO,,,2020-01-01", None), ("7,CCO tail,x,1,2020-01-01", None),
    ('7,CCO,a"b,1,2020-01-01', "quoting"), ('7,CCO,"a"b,1,2020-01-01', "quoting"), ('7,CCO,"ab,1,2020-01-01', "quoting"), ('7,CCO, "ab",1,2020-01-01', "quoting"),
    ("7,CCO,x,1", "columns"), (GOOD + ",", "columns"), ("", "columns"), ("\r", "columns"), (None, "columns"), ("7\tCCO\tx\t1\t2020-01-01", "columns"), ('""', "columns"),
    ("x7,CCO,x,1,2020-01-01", "mol_id"), (",CCO,x,1,2020-01-01", "mol_id"), ("-7,CCO,x,1,2020-01-01", "mol_id"), ("7.0,CCO,x,1,2020-01-01", "mol_id"), ("x,(,x,y,z", "mol_id"),
    ("7,,x,1,2020-01-01", "smiles"), ("7,CC(,x,1,2020-01-01", "smiles"), ("7, CC,x,1,2020-01-01", "smiles"),
    ("7,C,x,0,2020-01-01", "mol_weight"), ("7,C,x,-1,2020-01-01", "mol_weight"), ("7,C,x,nan,2020-01-01", "mol_weight"), ("7,C,x,1e,2020-01-01", "mol_weight"), ("7,C,x,0.0e5,2020-01-01", "mol_weight"), ("7,C,x, 1,2020-01-01", "mol_weight"),
    ("7,C,x,1e3,2020-01-01", None), ("7,C,x,1.5E-2,2020-01-01", None), ("7,C,x,.5,2020-01-01", None),
    ("7,C,x,1,2021-02-29", "registered_on"), ("7,C,x,1,2020-13-01", "registered_on"), ("7,C,x,1,20200101", "registered_on"), ("7,C,x,1,", "registered_on"), ("7,C,x,1,2020-1-01", "registered_on"), ("7,C,x,1,2020-00-10", "registered_on"), ("7,C,x,1,1900-02-29", "registered_on"), ("7,C,x,1,2000-02-29", None),
    ("7,C," + "0,1,2000-02-29", None), ("12345678901234567890123,C,x,1,2000-02-29", None), ("7,C," + "y" * 300000 + ",1,2000-02-29", None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, raw, "clash") for i, (raw, _) in enumerate(CASES)], "line_id long, raw string, reason string").repartition(3)
    got = {r["line_id"]: r["reason"] for r in rejects.split_lines(df).collect()}
    assert {i: got[i] for i in got} == {i: why for i, (_, why) in enumerate(CASES)}


def test_loaded_fields_agree_with_a_csv_reader(spark):
    lines = [raw for raw, why in CASES if why is None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw string")
    got = {r["line_id"]: r for r in rejects.loaded(df).collect()}
    for i, raw in enumerate(lines):
        f = next(csv.reader(io.StringIO(raw.removesuffix("\r"), newline="")))
        assert got[i]["title"] == f[2]
        assert got[i]["mol_weight"] == (float(f[3]) if f[3] else None)
        assert str(got[i]["registered_on"]) == f[4]
        assert got[i]["mol_id"] == (int(f[0]) if len(f[0]) < 19 else None)


def test_deliveries_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, GOOD), (2, GOOD)], "line_id long, raw string")
    assert rejects.rejected(df).count() == 1 and rejects.loaded(df).count() == 1
    assert rejects.rejected(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ['a"', '"', '"a', '","'])
def test_broken_quoting_does_not_swallow_other_lines(spark, bad):
    df = spark.createDataFrame([(1, GOOD), (2, bad), (3, GOOD)], "line_id long, raw string").coalesce(1)
    assert sorted(r["line_id"] for r in rejects.loaded(df).collect()) == [1, 3]
