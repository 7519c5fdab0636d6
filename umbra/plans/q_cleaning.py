"""Registered queries for sources, cleaning and reports (S/C/A9) with DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbra.functions.similarity import scored_sql
from umbra.functions.text import bin_label, col, normalize_country
from umbra.functions.countries import (FUZZY_MIN_SCORE, SPECIAL_CASES, continent_of, country_name, exact_continent,
                                       fuzzy_best)
from umbra.operators import cleaning as C
from umbra.operators.fuzzy import MIN_SCORE, fuzzy_pairs
from umbra.operators.report import equivalence_classes, privacy_report
from umbra.plans.sqltext import (bin_sql, clean_ctes, continent_ctes, income_code_sql, normalize_sql, q, trimmed_sql,
                                 with_)
from umbra.schema import CENSUS_SCHEMA, drop_incomplete, to_identifiers
from umbra.sources.fixtures import people, people_sql, table

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def clean_people(spark, sf):
    return C.clean(people(spark, sf))


PEOPLE = [("people", people_sql())]


@register("c01_trim_strings", with_(PEOPLE, "SELECT person_id, trim(workclass) AS workclass, trim(race) AS race, "
                                            "trim(income) AS income, age FROM people"))
def c01(spark, sf):
    return C.trim_strings(people(spark, sf)).select("person_id", "workclass", "race", "income", "age")


@register("c02_sentinel_null", with_(PEOPLE + [("trimmed", trimmed_sql())],
                                     f"SELECT person_id, workclass, occupation, {q('native-country')} FROM trimmed"))
def c02(spark, sf):
    return C.nullify_sentinels(C.trim_strings(people(spark, sf))).select(
        "person_id", "workclass", "occupation", "`native-country`")


@register("c03_drop_column", with_(PEOPLE, "SELECT * EXCLUDE (\"capital-gain\") FROM people"))
def c03(spark, sf):
    return C.drop_columns(people(spark, sf), ["capital-gain"])


@register("c04_strip_period", with_(PEOPLE, "SELECT person_id, regexp_replace(trim(income), '\\.$', '') AS income FROM people"))
def c04(spark, sf):
    from umbra.functions.text import strip_trailing
    return people(spark, sf).select("person_id", strip_trailing(col("income")).alias("income"))


@register("c05_label_encode", with_(PEOPLE, f"SELECT person_id, {income_code_sql('income')} AS income FROM people"))
def c05(spark, sf):
    return C.encode_label(people(spark, sf)).select("person_id", "income")


@register("c06_filter_unknown_label", with_(PEOPLE, f"SELECT * FROM (SELECT person_id, {income_code_sql('income')} AS income "
                                                    "FROM people) WHERE income IS NOT NULL"))
def c06(spark, sf):
    return C.drop_unknown_label(C.encode_label(people(spark, sf)).select("person_id", "income"))


_CLEAN_NOGEN = clean_ctes()[:4]


@register("c07_drop_critical_nulls", with_(_CLEAN_NOGEN, "SELECT * FROM critical"))
def c07(spark, sf):
    return C.clean(people(spark, sf), generalize=False)


@register("c08_drop_any_nulls", with_(PEOPLE + [("trimmed", trimmed_sql())],
                                      f"SELECT * REPLACE ({income_code_sql('income', True)} AS income) FROM trimmed "
                                      f"WHERE workclass IS NOT NULL AND occupation IS NOT NULL AND {q('native-country')} IS NOT NULL "
                                      f"AND {income_code_sql('income', True)} IS NOT NULL"))
def c08(spark, sf):
    return C.clean(people(spark, sf), drop_policy="any", generalize=False)


@register("c09_decade_bin", with_(PEOPLE, f"SELECT person_id, age, {bin_sql('age')} AS age_group FROM people"))
def c09(spark, sf):
    return C.add_age_group(people(spark, sf)).select("person_id", "age", "age_group")


@register("c10_country_normalize", with_(PEOPLE, f"SELECT DISTINCT {q('native-country')} AS raw, "
                                                 f"{normalize_sql(q('native-country'))} AS norm FROM people"))
def c10(spark, sf):
    return people(spark, sf).select(col("native-country").alias("raw"),
                                    normalize_country(col("native-country")).alias("norm")).distinct()


def _alias_case(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIAL_CASES.items())
    return f"coalesce(CASE {expr} {whens} END, {expr})"


@register("c11_country_alias", with_(PEOPLE, f"SELECT DISTINCT {q('native-country')} AS raw, "
                                             f"{_alias_case(normalize_sql(q('native-country')))} AS name FROM people"))
def c11(spark, sf):
    return people(spark, sf).select(col("native-country").alias("raw"),
                                    country_name(col("native-country")).alias("name")).distinct()


@register("c12_continent_lookup", with_(PEOPLE + continent_ctes("people"), "SELECT raw, continent_code FROM country_map"))
def c12(spark, sf):
    return (people(spark, sf).select(col("native-country").alias("raw")).where(F.col("raw").isNotNull()).distinct()
            .select("raw", continent_of(F.col("raw")).alias("continent_code")))


@register("c13_fuzzy_country", with_(PEOPLE + continent_ctes("people"),
                                     "SELECT n.raw, coalesce(b.score >= 80.0, false) AS fuzzy_hit FROM cname n LEFT JOIN cbest b "
                                     "ON b.raw = n.raw LEFT JOIN cexact e ON e.raw = n.raw WHERE e.cont IS NULL AND n.name <> 'Other'"))
def c13(spark, sf):
    """Distinct values that miss the exact lookup, and whether the fuzzy fallback accepts them."""
    raw = col("native-country")
    d = (people(spark, sf).where(raw.isNotNull()).select(raw.alias("raw")).distinct()
         .select("raw", country_name(F.col("raw")).alias("name")))
    return (d.where(exact_continent(F.col("name")).isNull() & (F.col("name") != "Other"))
            .select("raw", (fuzzy_best(F.col("name"))["score"] >= float(FUZZY_MIN_SCORE)).alias("fuzzy_hit")))


@register("c14_country_map", with_(clean_ctes(), f"SELECT person_id, {q('native-country')}, continent_code FROM clean"))
def c14(spark, sf):
    return clean_people(spark, sf).select("person_id", "`native-country`", "continent_code")


@register("c15_rename_identifiers", with_(PEOPLE, 'SELECT person_id, "education-num" AS education_num, '
                                                  '"marital-status" AS marital_status, "native-country" AS native_country FROM people'))
def c15(spark, sf):
    return to_identifiers(people(spark, sf)).select("person_id", "education_num", "marital_status", "native_country")


@register("c17_qi_sa_project", with_(clean_ctes(), "SELECT age, workclass, \"education-num\" AS education_num, "
                                                   "\"marital-status\" AS marital_status, occupation, race, sex, "
                                                   "\"native-country\" AS native_country, income FROM clean WHERE workclass "
                                                   "IS NOT NULL AND \"education-num\" IS NOT NULL AND race IS NOT NULL"))
def c17(spark, sf):
    return drop_incomplete(to_identifiers(clean_people(spark, sf)), CENSUS_SCHEMA)


@register("c18_clean_pipeline", with_(clean_ctes(), "SELECT * FROM clean"))
def c18(spark, sf):
    return clean_people(spark, sf)


@register("a09_class_sizes", with_(clean_ctes(), "SELECT age_group, sex, sum(n) AS class_size, count(*) AS distinct_sa, "
                                                 "max(n) AS max_sa_count, max(n) / sum(n) AS max_sa_share FROM "
                                                 "(SELECT age_group, sex, income, count(*) AS n FROM clean GROUP BY ALL) "
                                                 "GROUP BY age_group, sex"))
def a09_classes(spark, sf):
    return equivalence_classes(clean_people(spark, sf), ["age_group", "sex"], "income")


@register("a09_privacy_report", with_(clean_ctes() + [
    ("cls", "SELECT age_group, sex, continent_code, sum(n) AS class_size, count(*) AS distinct_sa, max(n) AS max_sa_count, "
            "max(n) / sum(n) AS max_sa_share FROM (SELECT age_group, sex, continent_code, income, count(*) AS n FROM clean "
            "GROUP BY ALL) GROUP BY ALL")],
    "SELECT sum(class_size) AS n_records, count(*) AS n_classes, min(class_size) AS min_class_size, "
    "sum(CASE WHEN class_size = 1 THEN 1 ELSE 0 END) AS unique_records, 1.0 / min(class_size) AS max_reid_risk, "
    "min(distinct_sa) AS min_distinct_sa, max(max_sa_share) AS max_sa_share FROM cls"))
def a09_report(spark, sf):
    return privacy_report(clean_people(spark, sf), ["age_group", "sex", "continent_code"], "income")


# misspelt: the letter at a place that the key names is left out, and some names keep one word only
_NAMES = "SELECT DISTINCT lower(p_name) AS b FROM part"
_MISSPELT = ("SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN lower(split_part(p_name, ' ', 2)) ELSE lower(concat(substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)), "
             "substr(p_name, CAST(p_partkey % length(p_name) + 2 AS INT)))) END AS a FROM part")


@register("c13_fuzzy_join", with_([("v", _MISSPELT), ("d", _NAMES), ("s", scored_sql("SELECT a, b FROM v, d WHERE a <> ''"))],
                                  f"SELECT a AS value, b AS entry, round(score, 6) AS score FROM s WHERE score >= {MIN_SCORE}"))
def c13_join(spark, sf):
    """Misspelt part names joined to the names they may stand for, by the index of letter pairs."""
    part = table(spark, sf, "part")
    cut = F.expr("CASE WHEN p_partkey % 5 = 0 THEN lower(split_part(p_name, ' ', 2)) ELSE lower(concat(substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT)), "
                 "substr(p_name, CAST(p_partkey % length(p_name) + 2 AS INT)))) END")
    got = fuzzy_pairs(part.select(cut.alias("a")), "a", part, "p_name")
    return got.select("value", "entry", F.round("score", 6).alias("score"))
