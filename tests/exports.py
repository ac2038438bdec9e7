"""Builds export files for tests: the records of a service organisation, as CSV and workbooks, also in zips in zips."""

import csv
import io
import itertools
import random
import struct
import zipfile
from xml.sax.saxutils import escape

#: By object: key prefix, how many records, and its columns. A column is a kind of value, or what its ids refer to:
#: (share, object) pairs; an object that is only a prefix is not in the export, and what is left of the shares is empty.
OBJECTS = {
    "User": ("005", 20, {"Username": "name", "Title": "word", "Active": "flag"}),
    "Product2": ("01t", 60, {"Name": "name", "Family": "word", "Price": "money"}),
    "Asset": ("02i", 400, {"SerialNumber": "name", "Product2Id": [(1, "Product2")], "RootAssetId": [(0.4, "Asset")], "InstallDate": "date"}),
    "Case": ("500", 700, {"Subject": "name", "AssetId": [(0.93, "Asset"), (0.02, "02i")], "OwnerId": [(0.75, "User"), (0.25, "00G")], "ParentId": [(0.3, "Case")], "ClosedDate": "time"}),
    "Site__c": ("a0S", 50, {"Name": "name", "Manager__c": [(1, "User")], "Region__c": "word"}),
    "Visit__c": ("a0V", 500, {"Site__c": [(1, "Site__c")], "RecordId__c": [(0.55, "Case"), (0.45, "Asset")], "Campaign__c": [(1, "701")], "Notes__c": "text"}),
}
EDGES = {(name, column, target) for name, (_, _, columns) in OBJECTS.items() for column, kind in columns.items() if isinstance(kind, list) for _, target in kind if target in OBJECTS}
OUTSIDE = {("Case", "OwnerId", "00G"), ("Visit__c", "Campaign__c", "701")}
WORDS = "north south east west upper lower inner outer".split()


def record_id(prefix, number):
    """Fifteen letters and digits, different for each number, in no order that shows."""
    n, out = (number + 1) * 7_368_787 % 62**6, ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out += "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[digit]
    return f"{prefix}5e0000{out}"


def org(scale=1.0):
    """object -> (header, rows)."""
    count = {name: max(10, round(n * scale)) for name, (_, n, _) in OBJECTS.items()}
    out = {}
    for name, (prefix, _, columns) in OBJECTS.items():
        rng = random.Random(name)

        def value(kind, k, rng=rng, name=name):
            if isinstance(kind, list):
                at = rng.random()
                for bound, (_, target) in zip(itertools.accumulate(share for share, _ in kind), kind, strict=True):
                    if at < bound:
                        known = target in OBJECTS
                        return record_id(OBJECTS[target][0] if known else target, rng.randrange(count[target]) if known else 10**6 + rng.randrange(30))
                return ""
            made = {
                "name": f"{name} no. {k:05d}", "word": rng.choice(WORDS), "flag": rng.choice(("true", "false")), "money": f"{rng.randrange(10**6) / 100:.2f}", "text": " ".join(rng.choices(WORDS, k=9)) + f" {k}",
                "date": f"20{10 + k % 14}-{1 + k % 12:02d}-{1 + k % 28:02d}", "time": "" if k % 6 == 0 else f"2024-{1 + k % 12:02d}-{1 + k % 28:02d}T07:45:00.000Z",
            }
            return made[kind]

        out[name] = (["Id", *columns], [[record_id(prefix, k), *(value(kind, k) for kind in columns.values())] for k in range(count[name])])
    return out


def as_csv(header, rows, separator=",", encoding="utf-8"):
    text = io.StringIO()
    writer = csv.writer(text, delimiter=separator)
    writer.writerow(header)
    writer.writerows(rows)
    return text.getvalue().encode(encoding)


def letters(k):
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def as_xlsx(sheets, top=0, left=0):
    """sheets: name -> rows of cells: str, int, float, bool, None, ("date", serial) or ("shared", text)."""
    shared = []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        rels, listed = [], []
        for n, (name, rows) in enumerate(sheets.items(), 1):
            body = []
            for r, row in enumerate(rows):
                cells = []
                for c, v in enumerate(row):
                    at = f"{letters(c + left)}{r + 1 + top}"
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, (int, float)):
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                    elif isinstance(v, tuple) and v[0] == "date":
                        cells.append(f'<c r="{at}" s="1"><v>{v[1]}</v></c>')
                    elif isinstance(v, tuple):
                        shared.append(v[1])
                        cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
                    else:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                body.append(f'<row r="{r + 1 + top}">{"".join(cells)}</row>')
            ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{ns}"><sheetData>{"".join(body)}</sheetData></worksheet>')
            rels.append(f'<Relationship Id="rId{n}" Type="t" Target="worksheets/sheet{n}.xml"/>')
            listed.append(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(listed)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">{"".join(f"<si><r><t>{escape(s)}</t></r></si>" for s in shared)}</sst>')
    return out.getvalue()


def as_xlsb(sheets):
    """sheets: name -> rows of cells: str, int, float, bool, None, ("date", serial), ("shared", text) or ("rk", hundredths)."""
    shared, parts = [], {}

    def bits(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    record = lambda kind, raw=b"": bits(kind) + bits(len(raw)) + raw
    text = lambda t: struct.pack("<I", len(t.encode("utf-16-le")) // 2) + t.encode("utf-16-le")
    book, rels = record(153, bytes(12)), []
    for n, (name, rows) in enumerate(sheets.items(), 1):
        body = record(129)
        for r, row in enumerate(rows):
            body += record(0, struct.pack("<I", r) + bytes(13))
            for c, v in enumerate(row):
                at = struct.pack("<I", c) + (1 if isinstance(v, tuple) and v[0] == "date" else 0).to_bytes(3, "little") + b"\0"
                if v is None:
                    body += record(1, at)
                elif isinstance(v, bool):
                    body += record(4, at + bytes([v]))
                elif isinstance(v, str):
                    body += record(6, at + text(v))
                elif isinstance(v, tuple) and v[0] == "shared":
                    shared.append(v[1])
                    body += record(7, at + struct.pack("<I", len(shared) - 1))
                elif isinstance(v, tuple) and v[0] == "rk":
                    body += record(2, at + struct.pack("<i", v[1] << 2 | 3))
                else:
                    body += record(5, at + struct.pack("<d", v[1] if isinstance(v, tuple) else v))
        parts[f"xl/worksheets/sheet{n}.bin"] = body + record(130)
        rels.append(f'<Relationship Id="rId{n}" Type="t" Target="worksheets/sheet{n}.bin"/>')
        book += record(156, struct.pack("<II", 0, n) + text(f"rId{n}") + text(name))
    parts["xl/workbook.bin"] = book
    parts["xl/_rels/workbook.bin.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(rels)}</Relationships>'.encode()
    parts["xl/sharedStrings.bin"] = b"".join(record(19, b"\0" + text(t)) for t in shared)
    style = lambda f: record(47, struct.pack("<HH", 0, f) + bytes(12))
    parts["xl/styles.bin"] = record(626) + style(14) + record(627) + record(44, struct.pack("<H", 170) + text("yyyy/mm")) + record(617) + style(0) + style(170) + record(618)
    return as_zip(parts)


def as_zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx_table(header, rows):
    return as_xlsx({"Sheet1": [header, *([c or None for c in r] for r in rows)]})
