"""Raw census CSV scan (S1, S2) and input selection (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Positional layout of the header-less census CSV.
CENSUS_COLUMNS = [
    ("age", IntegerType()), ("workclass", StringType()), ("fnlwgt", IntegerType()), ("education", StringType()),
    ("education-num", IntegerType()), ("marital-status", StringType()), ("occupation", StringType()),
    ("relationship", StringType()), ("race", StringType()), ("sex", StringType()), ("capital-gain", IntegerType()),
    ("capital-loss", IntegerType()), ("hours-per-week", IntegerType()), ("native-country", StringType()),
    ("income", StringType()),
]
CENSUS_SCHEMA = StructType([StructField(n, t, True) for n, t in CENSUS_COLUMNS])
# Which uploaded files are data files.
DATA_FILE_GLOB = "{adult.data,adult.test,*.[cC][sS][vV]}"


def read_census_csv(spark: SparkSession, path: str, keep_corrupt: bool = False, sentinel_as_null: bool = False,
                    select_files: bool = False, with_file_name: bool = False) -> DataFrame:
    """S1 (and S2 with ``sentinel_as_null``): header-less CSV with the fixed 15-column schema.

    Blanks after the ``,`` separators are trimmed so integers parse; malformed lines become a row
    of nulls (PERMISSIVE) and are dropped later by the critical-null filter, or kept in
    ``_corrupt_record`` with ``keep_corrupt``. ``select_files`` applies S3 on a directory.
    """
    schema = CENSUS_SCHEMA
    reader = (spark.read.option("header", "false").option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true"))
    if keep_corrupt:
        schema = StructType(schema.fields + [StructField("_corrupt_record", StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    if sentinel_as_null:
        reader = reader.option("nullValue", "?")
    if select_files:
        reader = reader.option("pathGlobFilter", DATA_FILE_GLOB)
    df = reader.schema(schema).csv(path)
    if with_file_name:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    return df


def census_lines(people: DataFrame) -> DataFrame:
    """Render census-style records as raw ``", "``-separated text lines (15 positional fields).

    Columns missing from the source (fnlwgt, education, relationship, capital-loss,
    hours-per-week) get fixed filler values.
    """
    fill = {"fnlwgt": F.col("person_id"), "education": F.lit("HS-grad"), "relationship": F.lit("Not-in-family"),
            "capital-loss": F.lit(0), "hours-per-week": F.lit(40)}
    fields = []
    for name, _ in CENSUS_COLUMNS:
        c = fill.get(name, F.col(f"`{name}`") if name in people.columns else F.lit(None))
        fields.append(F.trim(c.cast("string")))
    return people.select(F.concat_ws(", ", *fields).alias("value"))
