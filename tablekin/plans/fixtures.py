"""A service organisation over warehouse tables, its keys written as record ids: the same SQL runs on Spark and DuckDB.

Products are installed as assets, customers' cases are opened on assets and sites' engineers visit for them. Keys
become 15-character record ids with a type prefix; nulls, dangling ids, references to two tables and to absent ones are
put in by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _id(prefix: str, number: str) -> str:
    return f"concat('{prefix}', 'A', lpad(cast({number} as string), 11, '0'))"


_INSTALLED = """concat(cast(2015 + c_custkey % 9 as string), '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-',
        lpad(cast(1 + c_custkey % 28 as string), 2, '0'), 'T08:30:00.000Z')"""
#: By object: its columns as SQL, and the warehouse table they come from.
ORG = {
    "User": ({"Id": _id("005", "n_nationkey"), "Username": "n_name", "Region": "n_regionkey"}, "nation"),
    "Product2": ({"Id": _id("01t", "p_partkey"), "Name": "p_name", "Family": "p_brand", "Price": "p_retailprice"}, "part"),
    "Asset": (
        {
            "Id": _id("02i", "c_custkey"), "SerialNumber": "c_name", "Product2Id": _id("01t", "c_custkey % 200"),
            "RootAssetId": f"case when c_custkey % 7 < 2 then {_id('02i', 'c_custkey - c_custkey % 7')} end", "InstallDate": _INSTALLED,
        },
        "customer",
    ),
    "Site__c": ({"Id": _id("a0S", "s_suppkey"), "Name": "s_name", "Manager__c": _id("005", "s_suppkey % 25"), "Budget__c": "s_acctbal"}, "supplier"),
    "Case": (
        {
            "Id": _id("500", "o_orderkey"), "Priority": "o_orderpriority",
            "AssetId": f"case when o_orderkey % 29 = 0 then null when o_orderkey % 40 = 3 then concat('02iZ', lpad(cast(o_orderkey as string), 11, '0')) else {_id('02i', 'o_custkey')} end",
            "ParentId": f"case when o_orderkey % 5 = 0 then {_id('500', 'o_orderkey % 100')} end",
            "OwnerId": f"case when o_orderkey % 10 < 7 then {_id('005', 'o_orderkey % 25')} else {_id('00G', 'o_orderkey % 4')} end",
        },
        "orders",
    ),
    "Visit__c": (
        {
            "Id": _id("a0V", "event_id"), "Kind__c": "event_type", "Site__c": _id("a0S", "event_id % 10"),
            "RecordId__c": f"case when event_id % 3 < 2 then {_id('500', 'event_id % 1500')} else {_id('02i', 'event_id % 150')} end",
            "Engineer__c": _id("005", "event_id % 25"), "Campaign__c": _id("701", "event_id % 6"),
        },
        "events",
    ),
}
#: The columns that hold record ids, by object.
IDS = {name: [c for c, sql in columns.items() if "lpad" in sql and c != "InstallDate"] for name, (columns, _) in ORG.items()}


def select(name: str, table: str) -> str:
    columns, _ = ORG[name]
    return f"select {', '.join(f'{sql} as {c}' for c, sql in columns.items())} from {table}"


def org_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(select(name, f"parquet.`{sf_dir}/{ORG[name][1]}.parquet`"))


def org(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: org_table(spark, sf_dir, n) for n in names or ORG}
