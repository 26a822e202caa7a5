"""Pluggable validators and functions: anything that maps a table and a spec to findings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.types import SimpleType
from plumbline.operators.check import check_table
from plumbline.operators.findings import SCHEMA, union_findings
from plumbline.operators.rules import RuleSet, evaluate


class Checker(Protocol):
    source: str

    def __call__(self, df: DataFrame) -> DataFrame: ...


class TypeChecker:
    source = "schema"

    def __init__(self, spec: dict[str, SimpleType], key: Sequence[str], doc: str | None = None):
        self.spec, self.key, self.doc = spec, key, doc

    def __call__(self, df: DataFrame) -> DataFrame:
        return check_table(df, self.spec, self.key, self.doc)


class RuleChecker:
    source = "rules"

    def __init__(self, ruleset: RuleSet, key: Sequence[str], doc: str | None = None, order: str | None = None):
        self.ruleset, self.key, self.doc, self.order = ruleset, key, doc, order

    def __call__(self, df: DataFrame) -> DataFrame:
        return evaluate(df, self.ruleset, self.key, self.doc, self.order)


def run_checkers(df: DataFrame, checkers: Sequence[Checker]) -> DataFrame:
    """One findings table from several validators; usable through df.transform as well."""
    out = []
    for c in checkers:
        found = c(df)
        if found.columns != SCHEMA.names:
            raise ValueError(f"checker {c!r} does not return findings")
        out.append(found)
    return union_findings(*out)


def register_function(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    """An extra function for rule expressions, kept inside Catalyst as a SQL function."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
