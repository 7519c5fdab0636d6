"""All registered queries: name -> Spark callable, name -> DuckDB oracle SQL."""

from __future__ import annotations

from umbra.plans import q_cleaning, q_mechanisms, q_mondrian, q_noise, q_workflows

MODULES = (q_cleaning, q_mondrian, q_noise, q_mechanisms, q_workflows)


def queries():
    return {name: fn for m in MODULES for name, fn in m.Q.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark, sf_dir):
    """Cleaned people -> Mondrian k-anonymity (k=10): generalized classes and their sizes."""
    return q_mondrian.m01_mondrian_k(spark, sf_dir)
