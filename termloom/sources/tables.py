"""Tables in and out. Workbooks are exported to one Parquet or CSV dataset per sheet first."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.spread import ranked


# One schema per source table, after renaming.
SCHEMAS: Mapping[str, str] = {
    "registry": (
        "id bigint, active string, grad_date date, nivel string, year_in int, trim_in int, honor string, "
        "age_in int, age_out int, date_in timestamp, program string, program_desc string, program_in string, "
        "program_in_desc string, admin_type string, credit_conv double, cred_recon double, changed string"
    ),
    "biography": (
        "id bigint, dob string, sex string, nationality string, birth_city string, birth_country string, "
        "address string, city string, country string"
    ),
    "enrolment": (
        "id bigint, clave string, sec string, year int, trim int, teachid bigint, select_date_time timestamp, "
        "retiro string, retiro_date_time timestamp, grade string, credits double"
    ),
    "gpa_term": (
        "id bigint, year int, trim int, program string, nivel string, gpa_trim double, gpa_cum double, "
        "acad_condition string"
    ),
    "programme_area": ("program string, program_name string, nivel string, area string, area_name string"),
    "curriculum": (
        "version string, program string, description string, course string, trim int, "
        "course_description string, credits double, credits_total double, prerequisites string, "
        "credits_prereq double, corequisites string"
    ),
    "admission_test": (
        "id bigint, paa_verb double, paa_mat double, paa_redact double, paa_verb_2 double, paa_mat_2 double, "
        "paa_redact_2 double, poma_total double, poma_verb double, poma_mat double, poma_struct double, "
        "poma_nat double, poma_soc double, poma_human double, elash_total double, elash_lang double, "
        "elash_list double, elash_read double, elash_total_2 double, elash_lang_2 double, "
        "elash_list_2 double, elash_read_2 double"
    ),
    "sponsorship": (
        "id bigint, sponsor_type string, cover_type string, status string, approval_date timestamp, "
        "year_start_sponsor int, trim_start_sponsor int, trim_amount double, trim_percent double"
    ),
    "city_map": ("raw string, clean string"),
}


#: What no CSV field holds: null stands for it alone.
NO_TEXT = "\x00"
BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """One dataset. CSV needs a schema: types are stated, not guessed from a pass over the data.

    Quoted CSV values may hold line breaks, doubled quotes and blanks at their ends; a malformed row is an error.
    An empty field is null, and an empty one in quotes is an empty text.
    NaN in a column of floating numbers is read as missing.
    """
    return nan_as_null(_read(spark, path, fmt, schema))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN to null in all columns of floating numbers."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(f"`{c}`", F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV dataset needs a schema")
        # with another sign for null than nothing, what stands in quotes stays a text
        return reader.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", nullValue=NO_TEXT, emptyValue="", **BLANKS)
    return reader.format(fmt).load(path)


def read_tables(
    spark: SparkSession, folder: str, names: Iterable[str], fmt: str = "parquet", suffix: str = ""
) -> dict[str, DataFrame]:
    """All named tables of a folder: the workbook as a dictionary."""
    return {n: read_table(spark, f"{folder}/{n}{suffix}", fmt, SCHEMAS.get(n)) for n in names}


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), row_number: str | None = None
) -> str:
    """Write a dataset; ``row_number`` adds a column that takes the place of a saved row index."""
    if row_number:
        df = ranked(df, df.columns, row_number).select(row_number, *df.columns)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        writer.csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", **BLANKS)
    else:
        writer.format(fmt).save(path)
    return path
