"""Registered queries: one per operator, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return keep


def load_all() -> None:
    from plumbline.catalog import facets, record, sequence, keys, rules, profiling, shredding, text, repair, streams  # noqa: F401


# Deterministically damaged views of the given tables. Every expression is valid in both dialects.
BASES: dict[str, tuple[str, list[str]]] = {
    "order_text": ("orders", [
        "o_orderkey", "o_custkey",
        "case when o_orderkey % 7 = 0 then lower(o_orderstatus) when o_orderkey % 11 = 0 then concat(o_orderstatus, 'x') else o_orderstatus end as status",
        "cast(cast(o_totalprice as decimal(18,2)) as string) as total",
        "case when o_orderkey % 5 = 0 then concat(substr(cast(cast(o_orderdate as date) as string), 1, 8), '30') else cast(cast(o_orderdate as date) as string) end as odate",
        "case when o_orderkey % 9 = 0 then concat('  ', replace(o_orderpriority, '-', '   '), ' ') else o_orderpriority end as priority"]),
    "line_text": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate",
        "case when l_partkey % 13 = 0 then concat(cast(cast(l_quantity as int) as string), '.0') when l_partkey % 17 = 0 then concat('-', cast(cast(l_quantity as int) as string)) else cast(cast(l_quantity as int) as string) end as qty",
        "case when l_partkey % 19 = 0 then replace(cast(cast(l_extendedprice as decimal(18,2)) as string), '.', ',') else cast(cast(l_extendedprice as decimal(18,2)) as string) end as price",
        "cast(cast(l_discount as decimal(18,2)) as string) as discount"]),
    "part_text": ("part", [
        "p_partkey", "p_name", "p_type", "p_size",
        "case when p_partkey % 4 = 0 then lower(p_brand) when p_partkey % 6 = 1 then replace(p_brand, '#', '-#') else p_brand end as brand"]),
    "part_names": ("part", [
        "p_partkey",
        "case when p_partkey % 10 = 0 then upper(p_name) when p_partkey % 7 = 0 then replace(p_name, 'e', '') when p_partkey % 11 = 0 then concat(p_name, ' no ', cast(p_partkey as string)) when p_partkey % 13 = 0 then null else p_name end as name"]),
    "docs_gaps": ("documents", [
        "doc_id", "source", "case when doc_id % 7 = 0 then null else lang end as lang",
        "case when doc_id % 5 = 0 then null else text end as text", "n_chars"]),
    "event_names": ("events", [
        "event_id", "user_id", "ts", "value", "props",
        "case when event_id % 10 = 0 then upper(event_type) when event_id % 7 = 0 then replace(event_type, 'i', '') when event_id % 11 = 0 then concat('x:', event_type) else event_type end as name"]),
    "talk": ("conversations", [
        "conv_id", "turn", "text", "case when turn = 3 and length(text) % 4 = 0 then 'tool' else role end as role"]),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, exprs = BASES[name]
    return table(spark, sf, source).selectExpr(*exprs)


def with_base(*names: str) -> str:
    """WITH clause defining the damaged views."""
    return "with " + ", ".join(f"{n} as (select {', '.join(BASES[n][1])} from {BASES[n][0]})" for n in names) + "\n"
