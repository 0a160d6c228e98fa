"""The tables the queries read, and views of them with nulls, blanks and repeats.

The views keep every row of their tables; Spark and the oracle build them from the same SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline import Catalog, Dataset, ProfileConfig

TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
                  "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}

# View name -> (columns, SQL over the tables).
VIEWS = {
    "dirty_orders": (
        {"o_orderkey": "bigint", "cust_id": "bigint", "amount": "double", "sparse_status": "string",
         "priority": "string", "tags": "string", "created_at": "timestamp_ntz", "const_n": "int"},
        """select o_orderkey,
  case when o_custkey % 10 = 0 then null else o_custkey end as cust_id,
  case when o_orderkey % 3 = 0 then null else o_totalprice end as amount,
  case when o_orderkey % 100 < 85 then null else o_orderstatus end as sparse_status,
  case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then '   '
       when o_orderkey % 17 = 0 then null else o_orderpriority end as priority,
  case when o_orderkey % 19 = 0 then null when o_orderkey % 4 = 0 then o_orderstatus
       else concat(o_orderstatus, '; ', substring(o_orderpriority, 1, 1), ';',
                   cast(o_custkey % 5 as varchar(10))) end as tags,
  case when o_orderkey % 23 = 0 then null else o_orderdate end as created_at,
  7 as const_n
from {orders}"""),
    "dup_customers": (
        {"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"},
        """select c_custkey, c_name, c_mktsegment from {customer}
union all
select c_custkey, c_name, c_mktsegment from {customer} where c_mktsegment = 'BUILDING'"""),
    "narrow_lineitem": (
        {"l_partkey": "bigint", "l_quantity": "double", "l_discount": "double"},
        "select l_partkey, l_quantity, l_discount from {lineitem}"),
    "sparse_orders": (
        {"sparse_status": "string", "rare": "bigint"},
        """select case when o_orderkey % 100 < 85 then null else o_orderstatus end as sparse_status,
  case when o_orderkey % 10 < 9 then null else o_custkey end as rare from {orders}"""),
    "judged_documents": (
        {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint",
         "quality": "int", "toxic": "int"},
        """select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from {documents} d left join {labels} l on d.doc_id = l.doc_id"""),
}

SCHEMAS = {**TABLES, **{name: columns for name, (columns, _) in VIEWS.items()}}
EXACT = ProfileConfig(unique_mode="exact")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name][1]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def view_sql(name: str) -> str:
    """The SQL of a table or view for the oracle, as something to select from."""
    if name in TABLES:
        return name
    sql = VIEWS[name][1]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return f"({sql}) as {name}"


def catalog(spark: SparkSession, sf_dir: str, cfg: ProfileConfig = EXACT) -> Catalog:
    return Catalog(spark, [Dataset(name, table(spark, sf_dir, name), f"lake/{name}")
                           for name in SCHEMAS], cfg)
