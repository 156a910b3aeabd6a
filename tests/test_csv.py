import datetime as dt

import pytest
from conftest import rows

from pyspark.sql.types import LongType, StringType, StructField, StructType

from claimscope import schemas as S
from claimscope.sources.csv_tables import load_claims, read_providers, read_table, read_with_quarantine


def write(path, columns, *lines):
    path.write_text("\n".join([",".join(columns), *lines]) + "\n")
    return str(path)


def line(columns, values):
    return ",".join(str(values.get(c, "NA")) for c in columns)


def test_codes_keep_leading_zeros_and_missing_texts_become_null(spark, tmp_path):
    columns = [f.name for f in S.OUTPATIENT]
    path = write(
        tmp_path / "out.csv",
        columns,
        line(columns, {"ClaimID": "C1", "ClmDiagnosisCode_1": "0066", "DeductibleAmtPaid": ""}),
        line(columns, {"ClaimID": "C2", "ClmDiagnosisCode_1": "66", "DeductibleAmtPaid": 10}),
    )
    df = read_table(spark, path, S.OUTPATIENT)
    assert df.schema == S.OUTPATIENT
    got = df.select("ClaimID", "ClmDiagnosisCode_1", "DeductibleAmtPaid", "OtherPhysician")
    assert rows(got, "ClaimID") == [("C1", "0066", None, None), ("C2", "66", 10, None)]


def test_columns_are_found_by_header_name(spark, tmp_path):
    columns = [f.name for f in S.OUTPATIENT][::-1]
    path = write(tmp_path / "out.csv", columns, line(columns, {"ClaimID": "C1", "Provider": "P1"}))
    assert rows(read_table(spark, path, S.OUTPATIENT).select("ClaimID", "Provider")) == [("C1", "P1")]
    with pytest.raises(ValueError, match="AdmissionDt"):
        read_table(spark, path, S.INPATIENT)


def test_provider_list_with_quotes(spark, tmp_path):
    path = write(tmp_path / "p.csv", ["Provider"], '"PRV51002"', '"PRV51006"')
    assert rows(read_providers(spark, path), "Provider") == [("PRV51002",), ("PRV51006",)]


def test_load_returns_raw_prepared_and_merged_tables(spark, tmp_path):
    ben_columns = [f.name for f in S.BENEFICIARY]
    flags = {c: 2 for c in S.CHRONIC_FLAGS}
    ben = write(
        tmp_path / "ben.csv",
        ben_columns,
        line(ben_columns, {"BeneID": "B1", "DOB": "1940-01-01", "RenalDiseaseIndicator": "Y", **flags}),
        line(ben_columns, {"BeneID": "B2", "DOB": "1950-01-01", "DOD": "2009-05-01", "RenalDiseaseIndicator": "0", **flags}),
    )
    inp_columns, out_columns = ([f.name for f in s] for s in (S.INPATIENT, S.OUTPATIENT))
    stay = {"AdmissionDt": "2009-03-01", "DischargeDt": "2009-03-04"}
    inp = write(tmp_path / "inp.csv", inp_columns, line(inp_columns, {"BeneID": "B1", "ClaimID": "C1", **stay}))
    out = write(tmp_path / "out.csv", out_columns, line(out_columns, {"BeneID": "B2", "ClaimID": "C2"}))
    tables = load_claims(spark, ben, inp, out)
    assert tables.beneficiary.schema == S.BENEFICIARY
    assert rows(tables.inpatient.select("AdmissionDt", "AdmitForDays")) == [(dt.date(2009, 3, 1), 4)]
    merged = tables.claims.select(
        "ClaimID", "AdmitForDays", "RenalDiseaseIndicator", "WhetherDead", S.CHRONIC_FLAGS[0]
    )
    assert rows(merged, "ClaimID") == [("C1", 4, 1, 0, 0), ("C2", None, 0, 1, 0)]


def written(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


MIXED = StructType([StructField("Provider", StringType()), StructField("Amount", LongType())])


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    path = written(
        tmp_path / "mixed",
        a="Provider,Amount\nP1,1068.0\nP2,NA\n",
        b="Amount,Other,Provider\n7,x,P3\r\n\n0008,,\"P,4\"\n",
        c="\ufeffProvider,Amount\nP5,-3\nProvider,Amount\nP6,+4.\n",
        empty="",
        header_only="Other,Amount,Provider\n",
    )
    wanted = [("P,4", 8), ("P1", 1068), ("P2", None), ("P3", 7), ("P5", -3), ("P6", 4)]
    assert rows(read_table(spark, path, MIXED), "Provider") == wanted
    found = read_with_quarantine(spark, path, MIXED)
    assert rows(found.rows, "Provider") == wanted and found.bad.isEmpty()
    with pytest.raises(ValueError, match="Provider"):
        read_table(spark, written(tmp_path / "no", a="Provider,Amount\n", b="Other,Amount\n"), MIXED)


def test_bad_lines_are_set_aside_or_fail(spark, tmp_path):
    lines = ["P1,1", "P2,2,3", "P3", '"P4,x', 'P5,"5', "P6,1068.5", "P7,many", "P8,99999999999999999999", '"P""9",9', '"P10,1",10', "P11,"]
    path = written(tmp_path / "bad", a="Provider,Amount\n" + "\n".join(lines) + "\n", b="Amount,Provider\n12,P12\nP13,13\n")
    found = read_with_quarantine(spark, path, MIXED)
    assert sorted(rows(found.rows)) == sorted([("P1", 1), ('P"9', 9), ("P10,1", 10), ("P11", None), ("P12", 12)], key=lambda r: r[0])
    bad = {r.line: (r.reason, r.file.rsplit("/", 1)[1]) for r in found.bad.collect()}
    assert bad == {
        "P2,2,3": ("number of fields", "a.csv"),
        "P3": ("number of fields", "a.csv"),
        '"P4,x': ("open quote", "a.csv"),
        'P5,"5': ("open quote", "a.csv"),
        "P6,1068.5": ("not a number: Amount", "a.csv"),
        "P7,many": ("not a number: Amount", "a.csv"),
        "P8,99999999999999999999": ("not a number: Amount", "a.csv"),
        "P13,13": ("not a number: Amount", "b.csv"),
    }
    for line in ("P2,2,3", "P3", 'P5,"5', "P7,many"):
        name = f"one-{abs(hash(line))}"
        one = read_table(spark, written(tmp_path / name, a=f"Provider,Amount\n{line}\n"), MIXED)
        # Also when no column, or only another one, is asked for.
        for df in (one, one.select("Provider"), one.groupBy().count()):
            with pytest.raises(Exception, match="a.csv"):
                df.collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = written(tmp_path / "breaks", a='Provider,Amount\n"P\n1",1\nP2,2\n', b='Amount,Provider\n3,"P""\n3"\n4\n')
    found = read_with_quarantine(spark, path, MIXED, multiline=True)
    assert sorted(rows(found.rows)) == [("P\n1", 1), ('P"\n3', 3), ("P2", 2)]
    assert [r.reason for r in found.bad.collect()] == ["number of fields"]
    # Line by line, the same file has bad lines instead of wrong values.
    assert read_with_quarantine(spark, path, MIXED).rows.collect() == [("P2", 2)]
