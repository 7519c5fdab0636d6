from pyspark.sql import functions as F

from umbra.functions.countries import continent_of
from umbra.functions.text import bin_label, normalize_country, strip_trailing
from umbra.operators.cleaning import clean
from umbra.schema import CLEAN_REQUIRED_COLUMNS, SchemaError, require_columns
from umbra.sources.census import read_census_csv

RAW = [
    "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K",
    "50, ?, 83311, Bachelors, 13, Married-civ-spouse, Exec-managerial, Husband, White, Male, 0, 0, 13, Columbia, >50K.",
    "38, Private, 215646, HS-grad, 9, Divorced, ?, Not-in-family, White, Male, 0, 0, 40, England, <=50K.",
    "53, Private, 234721, 11th, 7, Married-civ-spouse, Handlers-cleaners, Husband, Black, Male, 0, 0, 40, ?, <=50K",
    "28, Private, 338409, Bachelors, 13, Married-civ-spouse, Prof-specialty, Wife, Black, Female, 0, 0, 40, Trinadad&Tobago, unknown",
    "37, Private, 284582, Masters, 14, Married-civ-spouse, Exec-managerial, Wife, White, Female, 0, 0, 40, Outlying-US(Guam-USVI-etc), >50K",
    "49, Private, 160187, 9th, 5, Married-spouse-absent, Other-service, Not-in-family, Black, Female, 0, 0, 16, South, <=50K",
    "|1x3 Cross validator",
    "age, workclass, fnlwgt, education, education-num, marital-status, occupation, relationship, race, sex, capital-gain, capital-loss, hours-per-week, native-country, income",
]


def _write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + ("\n" if lines else ""))
    return p


def test_csv_scan_and_clean(spark, tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    _write(d, "adult.data", RAW)
    _write(d, "empty.csv", [])
    _write(d, "notes.txt", RAW[:2])
    raw = read_census_csv(spark, str(d), select_files=True, with_file_name=True)
    rows = raw.collect()
    assert {r["source_file"] for r in rows} == {"adult.data"}          # S3: notes.txt skipped, empty file ok
    first = [r for r in rows if r["age"] == 39][0]
    assert first["fnlwgt"] == 77516 and first["hours-per-week"] == 40   # blanks after ", " trimmed: ints parse
    out = {r["age"]: r for r in clean(raw.drop("source_file")).collect()}
    # malformed and header lines have age null -> dropped; '?' occupation / country -> dropped; unknown label dropped
    assert set(out) == {39, 50, 37, 49}
    assert out[50]["income"] == 1 and out[50]["workclass"] is None      # '>50K.' -> 1, '?' -> null but kept
    assert out[39]["age_group"] == "30-40" and out[49]["age_group"] == "40-50"
    assert out[50]["continent_code"] == "SA"                           # Columbia -> fuzzy Colombia
    assert out[37]["continent_code"] == "NA"                           # Outlying US alias
    assert out[49]["continent_code"] == "Other"                        # South
    assert "fnlwgt" not in out[39]


def test_functions(spark):
    df = spark.createDataFrame([(" >50K. ", "Trinadad&Tobago", 39), ("<=50K", "Holand-Netherlands", 30)], "l string, c string, a int")
    r = df.select(strip_trailing(F.col("l")).alias("l"), normalize_country(F.col("c")).alias("n"),
                  continent_of(F.col("c")).alias("k"), bin_label(F.col("a")).alias("b")).collect()
    assert r[0]["l"] == ">50K" and r[0]["n"] == "TrinadadandTobago" and r[0]["k"] == "NA" and r[0]["b"] == "30-40"
    assert r[1]["k"] == "EU" and r[1]["b"] == "30-40"


def test_schema_guard(spark):
    df = spark.createDataFrame([(1,)], "age int")
    try:
        require_columns(df, CLEAN_REQUIRED_COLUMNS)
        raise AssertionError("expected SchemaError")
    except SchemaError as e:
        assert "workclass" in str(e)
