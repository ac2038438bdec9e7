"""Files in, relationships out: planted edges, split parts, odd files, the command line and its outputs."""

import csv
import json
import os
import random
import re
import tempfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exports import EDGES, OUTSIDE, as_csv, as_xlsb, as_xlsx, as_zip, org, xlsx_table
from tablekin import cli
from tablekin.functions import dialects
from tablekin.operators import relating
from tablekin.plans.analysis import profile_members
from tablekin.sinks import diagrams, json_graph, pages
from tablekin.sources import listing, member_source, readers

ORG = org()


def analyzed(spark, *sources, profile="salesforce", **more):
    dialect = dialects.get(profile)
    members = listing.list_members([str(s) for s in sources], skip=dialect.skipped_folders)
    groups, copies = listing.plan_parts(members)
    found = profile_members(spark, [m for g in groups.values() for m in g], dialect, copies, **more)
    return relating.infer(found.ids, [n for n in found.nodes if n.rows], dialect), found.nodes


def edges(graph):
    return {(e.from_node, e.from_column, e.to_node) for e in graph.edges}


def facts(nodes):
    return {n.id: (n.rows, n.key, n.key_token, {c.name: (c.type, c.rows, c.nulls, c.distinct, c.id_like, c.max_length, tuple(c.tokens)) for c in n.columns}) for n in nodes}


@pytest.fixture(scope="module")
def plain(tmp_path_factory):
    folder = tmp_path_factory.mktemp("plain")
    for name, (header, rows) in ORG.items():
        (folder / f"{name}.xlsx").write_bytes(xlsx_table(header, rows))
    return folder


@pytest.fixture(scope="module")
def whole(spark, plain):
    return analyzed(spark, plain)


def test_planted_edges(whole):
    graph, _ = whole
    assert edges(graph) == EDGES and len(EDGES) == 9
    assert all(e.to_column == "Id" for e in graph.edges)
    by = {(e.from_node, e.from_column, e.to_node): e for e in graph.edges}
    loose = by["Case", "AssetId", "Asset"]
    assert 0.9 < loose.resolve_rate < 1 and loose.verified and 0 < loose.null_pct < 0.1
    assert by["Asset", "Product2Id", "Product2"].confidence == 0.99
    assert {e.group for e in graph.edges if e.group} == {"Case.OwnerId", "Visit__c.RecordId__c"}
    assert {(u.node, u.column, u.token) for u in graph.unresolved} == OUTSIDE
    assert graph.load_order == [["Product2", "User"], ["Asset", "Site__c"], ["Case"], ["Visit__c"]] and graph.cycles == []
    assert {e.from_column for e in graph.edges if e.kind == "self"} == {"RootAssetId", "ParentId"}


def test_generic_profile_finds_less(spark, plain):
    graph, _ = analyzed(spark, plain, profile="generic")
    assert edges(graph) < EDGES and len(graph.edges) >= 5 and all(e.confidence < 0.99 for e in graph.edges)


def halves(name):
    header, rows = ORG[name]
    return (header, rows[: len(rows) // 2]), (header, rows[len(rows) // 2 :])


def split_files(overlap=0, drop=False):
    assets, visits = halves("Asset"), halves("Visit__c")
    second = (assets[1][0], assets[0][1][:overlap] + assets[1][1])
    if drop:
        at = second[0].index("SerialNumber")
        second = ([h for k, h in enumerate(second[0]) if k != at], [[v for k, v in enumerate(r) if k != at] for r in second[1]])
    user = xlsx_table(*ORG["User"])
    one = {"User.xlsx": user, "Case.xlsx": xlsx_table(*ORG["Case"]), "Site__c.xlsx": xlsx_table(*ORG["Site__c"]), "Asset.csv": as_csv(*assets[0]), "Visit__c.xlsx": xlsx_table(*visits[0])}
    two = {"User.xlsx": user, "Product2.xlsx": xlsx_table(*ORG["Product2"]), "x/asset.CSV": as_csv(*second), "Visit__c.xlsx": xlsx_table(*visits[1])}
    return as_zip(one), as_zip(two)


@pytest.mark.parametrize("nested", [False, True])
def test_split_is_whole(spark, tmp_path, whole, nested):
    one, two = split_files()
    if nested:
        (tmp_path / "outer.zip").write_bytes(as_zip({"WE_1.zip": one, "deep/WE_2.ZIP": two, "damaged.zip": b"PK\x03\x04 no"}))
        sources = [tmp_path / "outer.zip"]
    else:
        (tmp_path / "WE_1.zip").write_bytes(one)
        (tmp_path / "WE_2.zip").write_bytes(two)
        sources = [tmp_path]
    graph, nodes = analyzed(spark, *sources)
    assert edges(graph) == EDGES
    assert facts(nodes) == facts(whole[1])
    visit = next(n for n in nodes if n.id == "Visit__c")
    assert len(visit.parts) == 2 and sum(visit.part_rows) == visit.rows
    assert any("identical copy" in w for n in nodes if n.id == "User" for w in n.warnings)


def test_overlap_and_missing_columns(spark, tmp_path):
    one, two = split_files(overlap=17, drop=True)
    (tmp_path / "a.zip").write_bytes(one)
    (tmp_path / "b.zip").write_bytes(two)
    graph, nodes = analyzed(spark, tmp_path)
    asset = next(n for n in nodes if n.id == "Asset")
    assert asset.key == "Id" and any("repeats 17 value(s)" in w for w in asset.warnings)
    assert any("1 column(s) missing from some parts" in w and "SerialNumber" in w for w in asset.warnings)
    serial = asset.column("SerialNumber")
    assert serial.nulls == asset.rows - len(halves("Asset")[0][1])
    assert edges(graph) == EDGES


def columns(spark, folder, name="T"):
    _, nodes = analyzed(spark, folder)
    return {c.name: c for c in next(n for n in nodes if n.id == name).columns}


def test_text_typing(spark, tmp_path):
    (tmp_path / "T.csv").write_bytes(b"\xef\xbb\xbf\nId,Flag,N,F,M,X,,Id,D\n1,true,7,1,1,12,,a,2024-01-01\n\"\"\n2,TRUE,07,2.5,true,Call,,b,2024-01-02,extra\n3,false,8,,,,\n")
    got = columns(spark, tmp_path)
    assert {k: (c.type, c.distinct, c.nulls) for k, c in got.items()} == {
        "Id": ("int", 3, 0), "Flag": ("bool", 2, 0), "N": ("int", 2, 0), "F": ("float", 2, 1), "M": ("string", 2, 1), "X": ("string", 2, 1),
        "__UNNAMED__6": ("empty", 0, 3), "Id_duplicated_0": ("string", 2, 1), "D": ("date", 2, 1),
    }


def test_workbook_typing(spark, tmp_path):
    rows = [["A", "B", "C", "D", "E", ("shared", "F")], ["00123", 3.0, 3.0, ("date", 45000), True, ("shared", "x")], [None] * 6, ["7", 4.0, 4.5, ("date", 45000.5), False, None], [None] * 6]
    (tmp_path / "T.xlsx").write_bytes(as_xlsx({"Sheet1": rows}, top=1, left=1))
    got = columns(spark, tmp_path)
    assert {k: (c.type, c.distinct, c.nulls, c.rows) for k, c in got.items()} == {"A": ("string", 2, 1, 3), "B": ("int", 2, 1, 3), "C": ("float", 2, 1, 3), "D": ("datetime", 2, 1, 3), "E": ("bool", 2, 1, 3), "F": ("string", 1, 2, 3)}


def test_binary_workbook(spark, tmp_path):
    rows = [["A", "B", "C", "D", "E", ("shared", "F")], ["00123", 3.0, ("rk", 350), ("date", 45000), True, ("shared", "é\U0001f600")], ["7", 4, ("rk", 400), ("date", 45000.5), False, None]]
    (tmp_path / "T.zip").write_bytes(as_zip({"T.xlsb": as_xlsb({"Sheet1": rows, "Two": [["X"], ["y" * 300]]})}))
    got = columns(spark, tmp_path)
    assert {k: (c.type, c.distinct, c.nulls, c.rows) for k, c in got.items()} == {"A": ("string", 2, 0, 2), "B": ("int", 2, 0, 2), "C": ("float", 2, 0, 2), "D": ("datetime", 2, 0, 2), "E": ("bool", 2, 0, 2), "F": ("string", 1, 1, 2)}
    assert columns(spark, tmp_path, "T.Two")["X"].max_length == 300


def test_ids_beyond_the_sample(spark, tmp_path):
    ids = [f"001{k:012d}"[:3] + f"A{k:011d}" for k in range(1000)] + [f"003B{k:011d}" for k in range(200)]
    (tmp_path / "T.csv").write_bytes(as_csv(["Id"], [[x] for x in ids]))
    _, nodes = analyzed(spark, tmp_path)
    assert nodes[0].columns[0].tokens == [("001", 1000), ("003", 200)] and nodes[0].columns[0].unique and nodes[0].key_token == "001"


def test_odd_files(spark, tmp_path):
    for folder in ("ContentVersion", ".hidden", "__MACOSX"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Inside.csv").write_bytes(b"a\n1\n")
    (tmp_path / "ContentVersion.csv").write_bytes(b"Id\n1\n")
    (tmp_path / "~$lock.xlsx").write_bytes(b"x")
    (tmp_path / "Broken.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "Old.xlsb").write_bytes(b"x")
    (tmp_path / "Bad.zip").write_bytes(b"x")
    (tmp_path / "Case.csv").write_bytes(b"Id,Name\n")
    (tmp_path / "Nothing.csv").write_bytes(b"")
    (tmp_path / "Multi.xlsx").write_bytes(as_xlsx({"One": [["A"], ["x"]], "multi": [["B"], [1]], "Bare": []}))
    (tmp_path / "T.tsv").write_bytes('A\tB\n"x\ty\nz"\t1\n'.encode("utf-16"))
    logs = []
    members = listing.list_members([str(tmp_path)], logs.append, {"contentversion"})
    assert sorted(m.label for m in members) == ["Broken.xlsx", "Case.csv", "ContentVersion.csv", "Multi.xlsx", "Nothing.csv", "Old.xlsb", "T.tsv"]
    assert any("ContentVersion/ holds attachments: 1 file not read" in x for x in logs) and any("Bad.zip is not a readable zip" in x for x in logs)
    _, nodes = analyzed(spark, tmp_path)
    by = {n.id: n for n in nodes}
    assert by["Broken"].warnings[0].startswith("unreadable: ") and by["Old"].warnings[0].startswith("unreadable: ")
    assert by["Case"].warnings == by["Nothing"].warnings == by["Multi.Bare"].warnings == ["empty sheet"]
    assert by["Multi.One"].rows == 1 and by["Multi"].columns[0].name == "B"
    assert by["T"].rows == 1 and by["T"].columns[0].max_length == 5


def test_row_limit(spark, plain):
    _, nodes = analyzed(spark, plain, max_rows=5)
    assert {n.rows for n in nodes} == {5}


ODD_CELLS = ["plain", 'a "quoted" word', "two\nlines\n", "", "comma, here", "é\U0001f600", "cr\r\nlf", '""']
LONE = ['5" pipe,x', 'x"y,"multi\nline', '"a"b,c', 'q,"""in"" quotes\n\n"']


def file_of(rng, lone, ends):
    """A CSV file: rows written by the csv module, and lone quotes inside unquoted fields among them."""
    rows = [as_csv([str(k), rng.choice(ODD_CELLS), "" if k < 30 else f"later{k}"], []).decode().replace("\r\n", ends) if not lone or rng.random() < 0.7 else f"{k},{rng.choice(LONE)}{ends}" for k in range(120)]
    return b"\xef\xbb\xbf" + ("N,Text,Late" + ends + "".join(rows)).encode()


@pytest.mark.parametrize("chunk", [7, 64, 1000])
@pytest.mark.parametrize("lone", [False, True])
def test_chunks_are_whole(spark, tmp_path, chunk, lone):
    rng = random.Random(chunk)
    (tmp_path / "T.csv").write_bytes(file_of(rng, lone, "\n" if chunk > 7 else "\r\n"))
    whole, cut = (facts(analyzed(spark, tmp_path, sample=20, chunk=c)[1]) for c in (10**9, chunk))
    assert whole == cut and whole["T"][0] >= 100


@given(st.integers(0, 10**6), st.integers(5, 2000), st.booleans(), st.sampled_from(["\n", "\r\n"]))
@settings(max_examples=60, deadline=None)
def test_chunks_agree_or_say_so(seed, chunk, lone, ends):
    """The readers alone: where all chunks agree on where they meet, they hold exactly the rows of one reader."""
    rng = random.Random(seed)
    with tempfile.NamedTemporaryFile(suffix=".csv") as f:
        f.write(file_of(rng, lone, ends))
        f.flush()
        (whole,) = readers.read_csv(open(f.name, "rb"), ",", "T", None)
        want = Counter((c, v) for c, _, _, v in whole.cells)
        header, start = readers.head_of_csv(f.name, ",")
        size, got, rows, spans, quotes = os.path.getsize(f.name), Counter(), 0, [], 0
        bounds = [start, *range(start + chunk, size, chunk), size]
        for a, b in zip(bounds, bounds[1:], strict=False):
            (sheet,) = readers.read_csv_chunk(f.name, ",", header, a, b, bool(quotes & 1), a == start)
            try:
                got.update((c, v) for c, _, _, v in sheet.cells)
            except csv.Error:
                spans.append((-1, -1))
                break
            quotes += readers.count_quotes(f.name, a, b)
            rows += sheet.rows
            spans.append(sheet.span)
        if not member_source.disagreeing({0: spans}):
            assert got == want and rows == whole.rows
        else:
            assert lone  # files that a csv writer has written never need a second reading


def test_names():
    assert [listing.norm_name(x) for x in ("Account", " 'account.XLSX' ", "a\\b/Account.csv", "o.zip!x/Account.tsv")] == ["account"] * 4
    assert listing.default_stem(["nightly-01.ZIP", "nightly-02.ZIP"]) == "nightly"
    assert listing.default_stem(["a.zip", "b.zip"]) == "extract" and listing.default_stem(["x/export/"]) == "export"
    assert listing.safe_name("Ejer_æ/1") == "Ejer___1"


@pytest.fixture(scope="module")
def built(spark, plain, tmp_path_factory):
    folder = tmp_path_factory.mktemp("out")
    err = open(folder / "log", "w+")
    assert cli.run([str(plain), "-o", str(folder / "g.json"), "--dot", str(folder / "g.dot")], err) == 0
    err.seek(0)
    return folder, err.read()


def test_outputs(built):
    folder, log = built
    assert sorted(os.listdir(folder)) == ["g-docs", "g.dot", "g.json", "g.mmd", "log"]
    assert "9 references measured, 2 to objects outside the export" in log
    graph = json.loads((folder / "g.json").read_text())
    assert list(graph) == ["schema_version", "generator", "profile", "source", "stats", "reading_guide", "load_order", "nodes", "edges", "unresolved"]
    assert len(graph["edges"]) == 9 and all(e["verified"] for e in graph["edges"])
    for phrase in ("resolve_rate is the authority", "NOT mean unverified", "name-only"):
        assert phrase in graph["reading_guide"]
    record = next(c for n in graph["nodes"] if n["id"] == "Visit__c" for c in n["columns"] if c["name"] == "RecordId__c")
    assert sorted(record["ref"]) == ["Asset.Id", "Case.Id"] and set(record["tokens"]) == {"02i", "500"}
    mermaid = (folder / "g.mmd").read_text()
    assert '  User ||--o{ Site__c : "Manager__c"' in mermaid and "    id Id PK" in mermaid
    assert 'Asset -> Product2 [label="Product2Id (0.99)", style=solid];' in (folder / "g.dot").read_text()


def test_pages_link_up(built):
    docs = built[0] / "g-docs"
    names = {p.relative_to(docs).as_posix() for p in docs.rglob("*.md")}
    assert len(names) == 8
    for page in docs.rglob("*.md"):
        text = page.read_text()
        assert text.startswith(pages.MARKER)
        for target in re.findall(r"\]\(([^)]+)\)", text):
            assert (page.parent / target).resolve().is_file(), (page, target)
    assert "9 references were measured; 9 of them hold for nine values in ten or more." in (docs / "README.md").read_text()
    assert "also to Group, which was not exported" in (docs / "entities" / "Case.md").read_text()


def test_no_data_value_is_written(built):
    folder = built[0]
    text = "".join(p.read_text() for p in folder.rglob("*") if p.is_file())
    for name, (header, rows) in ORG.items():
        for row in rows[:50]:
            for h, value in zip(header, row, strict=True):
                if len(value) > 5 and value not in ("northern",):
                    assert value not in text, (name, h, value)


def test_stale_pages_go(built, whole):
    docs = built[0] / "g-docs"
    (docs / "entities" / "Gone.md").write_text(pages.MARKER + " x -->")
    (docs / "notes.md").write_text("mine")
    pages.write(whole[0], str(docs))
    assert not (docs / "entities" / "Gone.md").exists() and (docs / "notes.md").exists()


def test_command_line_errors(spark, tmp_path, capsys):
    assert cli.run([str(tmp_path / "no.zip")]) == 2
    assert cli.run([str(tmp_path), "--indent", "65"]) == 2
    assert cli.run([str(tmp_path), "--profile", "none"]) == 2
    assert cli.run([str(tmp_path), "--memory", "0"]) == 2
    assert cli.run([str(tmp_path)]) == 1 and "no tables in" in capsys.readouterr().err
    (tmp_path / "A.csv").write_bytes(b"Id\n")
    (tmp_path / "B.csv").write_bytes(b"Id\n1\n")
    (tmp_path / "names").write_text("# all\n\nA.xlsx\nMissing\n")
    assert cli.run([str(tmp_path), "--include", str(tmp_path / "none")]) == 2
    assert cli.run([str(tmp_path), "--include", str(tmp_path / "names"), "-o", str(tmp_path / "x.json")]) == 1
    assert "no table has a row" in capsys.readouterr().err
    assert cli.run([str(tmp_path), "--include", str(tmp_path / "names"), "--include-empty", "--json-only", "-q", "-o", str(tmp_path / "x.json")]) == 0
    graph = json.loads((tmp_path / "x.json").read_text())
    assert [n["id"] for n in graph["nodes"]] == ["A"] and graph["stats"]["unmatched_include_names"] == ["missing"]
    assert not (tmp_path / "x.mmd").exists()


def test_diagrams_mangle_names():
    assert diagrams.ident("1 a-b") == "n_1_a_b" and diagrams.ident("") == "n_"
    assert json_graph.lean({"a": 0, "rows": 0, "b": [{"c": False}], "d": {}}) == {"rows": 0, "b": [{}]}


def test_heartbeat(spark):
    lines = []
    with cli.Heartbeat(spark, lines.append, every=0.2):
        spark.sparkContext.parallelize(range(8), 8).foreach(lambda _: __import__("time").sleep(0.3))
    assert any(re.match(r"  \.\.\. \d+ of 8 tasks done in 0s", x) for x in lines)
