"""Rules about names, values, numbers and order, one at a time."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekin import UserError
from tablekin.functions import dialects, numbers, values
from tablekin.operators import cells, combining, ordering, profiling
from tablekin.plans import analysis, fixtures
from tablekin.plans.model import Column, Node

SF = "/root/testdata/sf0.001"


def test_order_units():
    assert ordering.cycles_and_layers("ABC", [("A", "B"), ("B", "A"), ("C", "A")]) == ([["A", "B"], ["C"]], [["A", "B"]])
    layers, cycles = ordering.cycles_and_layers("PQRSTU", [("P", "Q"), ("Q", "R"), ("R", "P"), ("S", "P"), ("T", "S")])
    assert layers == [["P", "Q", "R", "U"], ["S"], ["T"]] and cycles == [["P", "Q", "R"]]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_order_is_right(edges):
    nodes = [str(k) for k in range(10)]
    layers, cycles = ordering.cycles_and_layers(nodes, [(str(a), str(b)) for a, b in edges])
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[str(a)] |= reach[str(b)]
    together = sorted({tuple(sorted(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes})
    assert [tuple(c) for c in cycles] == [t for t in together if len(t) > 1]
    at = {n: k for k, layer in enumerate(layers) for n in layer}
    assert sorted(at) == nodes
    for a, b in edges:
        a, b = str(a), str(b)
        assert at[b] < at[a] or (at[a] == at[b] and a in reach[b])


def test_score_and_rounding():
    assert numbers.score(0.9795, True, True, True) == 0.986 and numbers.score(1, True, True, True) == 0.99 and numbers.score(0, False, False, False) == 0
    assert numbers.rounded(2469 / 20000, 4) == 0.1235
    assert [numbers.share_text(x) for x in (0, 1, 0.5, 0.9995, 0.0004)] == ["0%", "100%", "50.0%", "99.95%", "0.04%"]
    assert numbers.page_bytes(1536) == "1.5 KB" and numbers.duration(3700) == "1h 01m"


def test_generic_names():
    d = dialects.get("generic")
    assert [d.key_rank(c, "My Order") for c in ("ID", "my_order_id", "my_orderid", "x")] == [0, 1, 1, 99]
    assert [d.reference_base(c) for c in ("account_id", "AccountId", "id", "name", "x-ID")] == ["account", "Account", None, None, "x"]
    assert d.name_aliases("Order_Entry") >= {"order_entry", "orderentry", "order entry", "order_entries", "order_entrys"}
    assert d.node_name("a/b/Book.xlsx", "Data", 2) == "Book.Data" and d.node_name("Book.xlsx", "Sheet1", 2) == "Book"


def test_salesforce_names():
    d = dialects.get("salesforce")
    assert [d.key_rank(c, "Acme") for c in ("Id", "AcmeId", "Acme__c", "uuid")] == [0, 1, 1, 99]
    assert [d.reference_base(c) for c in ("My_Account__c", "OwnerId", "Id", "Name")] == ["My_Account", "Owner", None, None]
    assert "my_account__c" in d.name_aliases("My_Account") and d.builtin_targets("OWNERID") == ("User", "Group")
    assert d.is_polymorphic("WhatId") and d.name_for_token("00Q") == "Lead"
    with pytest.raises(UserError, match="generic, salesforce"):
        dialects.get("none")


def test_own_dialect():
    class Mine(dialects.Dialect):
        name = "mine"

    dialects.register(Mine)
    assert dialects.get("mine").name == "mine" and "mine" in dialects.names()


def test_value_rules(spark):
    rows = ["7", "+07", "-3", " 7", "7\n", "9223372036854775808", ".5", "5.", "1E5", "1d", "NaN", "TRUE", "t", "2024-01-31", "2024-01-31T10:00", "2024-01-31 10:00:00.5+0100", "x"]
    got = spark.createDataFrame([(x,) for x in rows], "v string").select(
        "v", values.kind_of_text(F.col("v")).alias("k"), values.canonical(values.kind_of_text(F.col("v")), F.col("v")).alias("c"), F.col("v").rlike(values.ISO_DATE).alias("d"), F.col("v").rlike(values.ISO_DATETIME).alias("t")
    )
    kinds = {r.v: r.k for r in got.collect()}
    assert [kinds[x] for x in rows] == ["int", "int", "int", "str", "str", "float", "float", "float", "float", "str", "float", "bool", "str", "str", "str", "str", "str"]
    forms = {r.v: r.c for r in got.collect()}
    assert forms["+07"] == forms["7"] == "7" and forms["TRUE"] == "True"
    assert [r.v for r in got.collect() if r.d] == ["2024-01-31"] and sum(r.t for r in got.collect()) == 2


def test_typed_frames(spark):
    frame = spark.sql("select * from values (1, 1.5D, true, date'2024-01-01', 'a', cast(null as string)), (1, 2D, false, date'2024-01-02', '', null) as t(`a.b`, f, b, d, s, n)")
    found = analysis.profile_frames(spark, {"T": frame}, dialects.get("generic"))
    assert {c.name: (c.type, c.distinct, c.nulls, c.max_length) for c in found.nodes[0].columns} == {"a.b": ("int", 1, 0, None), "f": ("float", 2, 0, None), "b": ("bool", 2, 0, None), "d": ("datetime", 2, 0, None), "s": ("string", 1, 1, 1), "n": ("empty", 0, 2, None)}
    found.release()


def test_long_texts_count_exactly(spark):
    frame = spark.range(300).selectExpr("repeat(cast(id % 7 as string), 500) || 'x' as t")
    found = analysis.profile_frames(spark, {"T": frame}, dialects.get("generic"))
    assert found.nodes[0].columns[0].distinct == 7 and found.nodes[0].columns[0].max_length == 501


def test_widening():
    w = combining.widened
    assert [w(t, False) for t in (["int", "float"], ["date", "datetime"], ["int", "string"], ["empty", "int"], ["empty"], [])] == ["float", "datetime", "string", "int", "empty", "empty"]
    assert w(["int"], True) == "id"


def test_key_choice():
    unique, other = lambda n, i=False: Column(n, "id" if i else "int", 5, 0, 5, i), lambda n: Column(n, "int", 5, 0, 3)
    d = dialects.get("generic")
    node = lambda *c: Node("T", "T", "T", 5, list(c))
    assert combining.chosen_key(node(unique("t_id"), unique("id")), d) == "id"
    assert combining.chosen_key(node(other("id"), unique("code", True)), d) == "code"
    assert combining.chosen_key(node(other("id"), unique("n")), d) is None


def test_plan_settings_change_nothing(spark):
    got = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        graph = analysis.analyze(spark, fixtures.org(spark, SF), "salesforce")
        got.append([(e.from_node, e.from_column, e.to_node, e.matched, e.total, e.confidence) for e in graph.edges])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len(got[0]) == 10


def test_split_frames_are_whole(spark):
    org = fixtures.org(spark, SF)
    whole = analysis.profile_frames(spark, org, dialects.get("salesforce"))
    assets = org["Asset"].persist()
    org["Asset"] = [assets.where("Id < '02iA00000000100'"), assets.where("Id >= '02iA00000000100'")]
    parts = analysis.profile_frames(spark, org, dialects.get("salesforce"))
    pick = lambda p: [(c.name, c.type, c.rows, c.nulls, c.distinct, c.id_like, c.tokens) for n in p.nodes if n.id == "Asset" for c in n.columns]
    assert pick(whole) == pick(parts)


def test_tokens_are_ranked(spark):
    rows = [(0, 0, f"{p}A{k:011d}", 1) for p, n in (("b01", 3), ("a01", 3), ("c01", 5)) for k in range(n)]
    tokens = profiling.token_counts(spark.createDataFrame(rows, "part int, col int, value string, n long"))
    assert [(r.token, r.rows) for r in profiling.top_tokens(tokens, ["part", "col"], 2).orderBy("rank").collect()] == [("c01", 5), ("a01", 3)]


def test_counts_are_partial_before_the_shuffle(spark):
    plan = cells.counted(cells.melted(spark.range(10), 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") == 1 and plan.count("Exchange") == 1


def test_counting_by_column_or_melted_is_the_same(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("*", "o_orderkey % 3 = 0 as flag", "if(o_orderkey % 5 = 0, '', o_orderstatus) as some", "array(o_custkey) as list")
    rows = []
    for most in (0, 40):
        monkeypatch.setattr(cells, "MELT_ABOVE", most)
        texts, numbers = cells.text_counts(frame, 3), cells.number_counts(frame, 3)
        rows.append([sorted(map(str, f.select(sorted(f.columns)).collect())) for f in (texts, numbers)])
    assert rows[0] == rows[1] and rows[0][0] and rows[0][1]
