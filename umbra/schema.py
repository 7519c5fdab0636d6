"""Column roles and schema guards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The cleaned census table must contain these 14 columns.
CLEAN_REQUIRED_COLUMNS = [
    "age", "workclass", "education", "education-num", "marital-status", "occupation",
    "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week",
    "native-country", "income",
]

# Quasi-identifier order and sensitive attribute of the census preset.
CENSUS_QI = ["age", "workclass", "education_num", "marital_status", "occupation", "race", "sex", "native_country"]
CENSUS_NUMERIC_QI = ["age", "education_num"]
CENSUS_SA = "income"


class SchemaError(ValueError):
    """Raised before any job when a frame lacks the columns an operator needs."""


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """Reject a frame whose columns are not a superset of ``required`` (no job runs)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{what} is missing required columns: {missing}")


def to_identifiers(df: DataFrame) -> DataFrame:
    """Rename hyphenated columns to identifiers (``-`` -> ``_``) in one projection."""
    renames = {c: c.replace("-", "_") for c in df.columns if "-" in c}
    return df.withColumnsRenamed(renames) if renames else df


@dataclass(frozen=True)
class PrivacySchema:
    """Ordered quasi-identifiers (order breaks width ties), which are numeric, and the sensitive attribute."""

    qi: list[str]
    numeric: list[str] = field(default_factory=list)
    sa: str | None = None

    def __post_init__(self):
        if not self.qi:
            raise SchemaError("at least one quasi-identifier is required")
        unknown = [c for c in self.numeric if c not in self.qi]
        if unknown:
            raise SchemaError(f"numeric columns not among the quasi-identifiers: {unknown}")
        if self.sa is not None and self.sa in self.qi:
            raise SchemaError("the sensitive attribute cannot be a quasi-identifier")

    @property
    def is_numeric(self) -> list[bool]:
        return [c in self.numeric for c in self.qi]

    @property
    def columns(self) -> list[str]:
        return self.qi + ([self.sa] if self.sa else [])

    def validate(self, df: DataFrame) -> None:
        require_columns(df, self.columns, "anonymizer input")
        types = {f.name: f.dataType for f in df.schema.fields}
        bad = [c for c in self.numeric if not isinstance(types[c], NumericType)]
        if bad:
            raise SchemaError(f"numeric quasi-identifiers must have a numeric type: {bad}")


CENSUS_SCHEMA = PrivacySchema(qi=CENSUS_QI, numeric=CENSUS_NUMERIC_QI, sa=CENSUS_SA)


def drop_incomplete(df: DataFrame, schema: PrivacySchema, keep: list[str] | None = None) -> DataFrame:
    """C17: keep the QI + SA columns (plus ``keep``) of rows with no null among them."""
    cols = schema.columns + [c for c in (keep or []) if c not in schema.columns]
    return df.dropna(subset=schema.columns).select(*[F.col(f"`{c}`") for c in cols])
