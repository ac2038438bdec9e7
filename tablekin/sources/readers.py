"""Reading one file as a stream of filled cells: CSV and TSV text, and xlsx, xlsm and xlsb workbooks by the standard library."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import shutil
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from .listing import open_chain

#: (column, row, kind, value): kind is text for what has yet to be typed, else str, int, float, bool or time.
Cell = tuple[int, int, str, str]
csv.field_size_limit(2**31 - 1)


@dataclass
class Sheet:
    name: str
    header: list[str]
    cells: Iterator[Cell]
    rows: int = 0  # known once the cells are used up
    first: int = 0  # columns before this one, and from `last` on, are formatting
    last: int | None = None
    span: tuple[int, int] | None = None  # of a chunk: where its first record starts, and the first one behind it


def column_names(header: list[str]) -> list[str]:
    """Blank names by position, repeated ones numbered from 0."""
    seen: dict[str, int] = {}
    out = []
    for k, raw in enumerate(header):
        name = raw or f"__UNNAMED__{k}"
        if name in seen:
            out.append(f"{name}_duplicated_{seen[name]}")
            seen[name] += 1
        else:
            seen[name] = 0
            out.append(name)
    return out


def _encoding(head: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    return "utf-8"


def read_csv(stream: io.BufferedIOBase, separator: str, stem: str, max_rows: int | None) -> Iterator[Sheet]:
    buffered = io.BufferedReader(stream) if not isinstance(stream, io.BufferedReader) else stream
    text = io.TextIOWrapper(buffered, encoding=_encoding(buffered.peek(4)[:4]), errors="replace", newline="")
    lines = (r for r in csv.reader(text, delimiter=separator) if r and r != [""])
    header = next(lines, None)
    if header is None:
        yield Sheet(stem, [], iter(()))
        return
    sheet = Sheet(stem, column_names(header), iter(()))

    def cells() -> Iterator[Cell]:
        width = len(header)
        for row in lines:
            if sheet.rows == max_rows:
                break
            for k, value in enumerate(row[:width]):
                if value:
                    yield k, sheet.rows, "text", value
            sheet.rows += 1

    sheet.cells = cells()
    yield sheet


def head_of_csv(path: str, separator: str) -> tuple[list[str], int] | None:
    """The header of a plain file and where its first row starts; None if the file can't be cut at line feeds."""
    with open(path, "rb") as f:
        start = f.read(1 << 16)
        if _encoding(start[:4]) not in ("utf-8", "utf-8-sig") or b"\n" not in start:
            return None
        f.seek(3 if start.startswith(b"\xef\xbb\xbf") else 0)
        lines = _Lines(f, f.tell())
        for row in csv.reader(lines, delimiter=separator):
            if row and row != [""]:
                return column_names(row), lines.at
    return None


class _Lines:
    """Text lines of a file from where it stands; at is where the next one starts."""

    def __init__(self, f: io.BufferedIOBase, at: int):
        self.f, self.at = f, at

    def __iter__(self) -> _Lines:
        return self

    def __next__(self) -> str:
        line = self.f.readline()
        if not line:
            raise StopIteration
        self.at += len(line)
        return line.decode("utf-8", "replace")


def count_quotes(path: str, start: int, end: int) -> int:
    n = 0
    with open(path, "rb") as f:
        f.seek(start)
        while start < end and (block := f.read(min(1 << 22, end - start))):
            n += block.count(b'"')
            start += len(block)
    return n


def read_csv_chunk(path: str, separator: str, header: list[str], start: int, end: int, quoted: bool, first: bool) -> Iterator[Sheet]:
    """The records that start after `start` (for the first chunk: at it) and not after `end`.

    quoted guesses whether `start` lies inside quotes. The sheet's span tells where its first record starts and where the
    first one behind it does: neighbours that agree on all of these have read what a single reader would.
    """
    sheet = Sheet(path.replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[0], header if first else [""] * len(header), iter(()))

    def cells() -> Iterator[Cell]:
        with open(path, "rb") as f:
            f.seek(start)
            lines = _Lines(f, start)
            open_ = quoted
            for line in () if first else lines:
                open_ ^= bool(line.count('"') & 1)
                if not open_:
                    break
            begin, records = lines.at, csv.reader(lines, delimiter=separator)
            while lines.at <= end and (row := next(records, None)) is not None:
                if not row or row == [""]:
                    continue
                for k, value in enumerate(row[: len(header)]):
                    if value:
                        yield k, sheet.rows, "text", value
                sheet.rows += 1
            sheet.span = begin, lines.at

    sheet.cells = cells()
    yield sheet


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code)
    return bool(re.search(r"[ymdhs]", bare, re.IGNORECASE)) and "general" not in bare.lower()


class Workbook:
    """The sheets of an xlsx or xlsm file, cell by cell."""

    def __init__(self, stream: io.BufferedIOBase):
        self.zip = zipfile.ZipFile(_seekable(stream))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        props = book.find(f"{_NS}workbookPr")
        self.epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), self._path(rels[s.get(_REL)])) for s in book.find(f"{_NS}sheets")]
        self.strings = self._strings() if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    @staticmethod
    def _path(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _strings(self) -> list[str]:
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, item in ElementTree.iterparse(f):
                if item.tag == f"{_NS}si":
                    out.append(_rich_text(item))
                    item.clear()
        return out

    def _date_styles(self) -> set[int]:
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_NS}numFmt")}
        styles = root.find(f"{_NS}cellXfs")
        ids = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
        return {k for k, i in enumerate(ids) if (_is_date_format(own[i]) if i in own else i in _DATE_FORMATS)}

    def rows(self, path: str) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """(row number, filled cells by column) in file order."""
        with self.zip.open(path) as f:
            number = -1
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r")) - 1 if row.get("r") else number + 1
                cells, column = {}, -1
                for c in row.iter(f"{_NS}c"):
                    column = _column(c.get("r")) if c.get("r") else column + 1
                    if (value := self._value(c)) is not None:
                        cells[column] = value
                yield number, cells
                row.clear()

    def _value(self, c) -> tuple[str, str] | None:
        kind, v = c.get("t") or "n", c.find(f"{_NS}v")
        if kind == "inlineStr":
            text = _rich_text(c.find(f"{_NS}is"))
            return ("str", text) if text else None
        if v is None or not v.text:
            return None
        if kind == "s":
            text = self.strings[int(v.text)]
            return ("str", text) if text else None
        if kind in ("str", "e", "d"):
            return None if kind == "e" else ("str", v.text)
        if kind == "b":
            return "bool", "True" if v.text == "1" else "False"
        return _number(float(v.text), int(c.get("s") or 0) in self.dates, self.epoch)


def _number(number: float, is_date: bool, epoch: dt.datetime) -> tuple[str, str]:
    if is_date:
        when = epoch + dt.timedelta(microseconds=round(number * 86_400_000) * 1000)
        return "time", when.strftime("%Y-%m-%d %H:%M:%S") + (f".{when.microsecond:06d}" if when.microsecond else "")
    if number == int(number) and abs(number) < 9.2e18:
        return "int", str(int(number))
    return "float", repr(number)


def _seekable(stream: io.BufferedIOBase) -> io.BufferedIOBase:
    """The stream itself, or a packed one's bytes on the task's disk: a zip's directory is at its end."""
    if isinstance(stream, (io.BytesIO, io.BufferedReader)):
        return stream
    out = tempfile.TemporaryFile()
    shutil.copyfileobj(stream, out, 1 << 20)
    return out


def _rich_text(item) -> str:
    """The text of a string item; phonetic hints are not part of it."""
    if item is None:
        return ""
    own = [t.text or "" for t in item.findall(f"{_NS}t")]
    return "".join(own + [t.text or "" for r in item.findall(f"{_NS}r") for t in r.findall(f"{_NS}t")])


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


#: Record types of the binary workbook format.
_ROW, _RK, _BOOL, _REAL, _TEXT, _SHARED = 0, 2, 4, 5, 6, 7
_FORMULA_TEXT, _FORMULA_REAL, _FORMULA_BOOL = 8, 9, 10
_STRING_ITEM, _FORMAT, _STYLE, _BOOK, _SHEET, _STYLES_BEGIN, _STYLES_END = 19, 44, 47, 153, 156, 617, 618


class BinaryWorkbook:
    """The sheets of an xlsb file, cell by cell: a zip of parts that are runs of (type, length, payload) records."""

    def __init__(self, stream: io.BufferedIOBase):
        self.zip = zipfile.ZipFile(_seekable(stream))
        names = set(self.zip.namelist())
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.bin.rels"))}
        self.epoch, self.sheets = dt.datetime(1899, 12, 30), []
        for kind, raw in self._records("xl/workbook.bin"):
            if kind == _BOOK and raw[0] & 1:
                self.epoch = dt.datetime(1904, 1, 1)
            elif kind == _SHEET:
                rel, at = self._text(raw, 8)
                self.sheets.append((self._text(raw, at)[0], Workbook._path(rels[rel])))
        self.strings = [self._text(raw, 1)[0] for kind, raw in self._records("xl/sharedStrings.bin") if kind == _STRING_ITEM] if "xl/sharedStrings.bin" in names else []
        self.dates = self._date_styles() if "xl/styles.bin" in names else set()

    def _records(self, part: str) -> Iterator[tuple[int, bytes]]:
        with self.zip.open(part) as packed:
            f = io.BufferedReader(packed, 1 << 16)

            def number(most: int) -> int | None:
                """Seven bits a byte, the lowest first; the eighth tells that more follow."""
                out = 0
                for k in range(most):
                    if not (byte := f.read(1)):
                        return None
                    out |= (byte[0] & 0x7F) << 7 * k
                    if byte[0] < 0x80:
                        break
                return out

            while (kind := number(2)) is not None and (size := number(4)) is not None:
                yield kind, f.read(size)

    @staticmethod
    def _text(raw: bytes, at: int) -> tuple[str, int]:
        """A counted UTF-16 string, and where it ends."""
        end = at + 4 + 2 * int.from_bytes(raw[at : at + 4], "little")
        return raw[at + 4 : end].decode("utf-16-le", "replace"), end

    def _date_styles(self) -> set[int]:
        own, styles, inside = {}, [], False
        for kind, raw in self._records("xl/styles.bin"):
            if kind == _FORMAT:
                own[int.from_bytes(raw[:2], "little")] = self._text(raw, 2)[0]
            elif kind in (_STYLES_BEGIN, _STYLES_END):
                inside = kind == _STYLES_BEGIN
            elif kind == _STYLE and inside:
                styles.append(int.from_bytes(raw[2:4], "little"))
        return {k for k, i in enumerate(styles) if (_is_date_format(own[i]) if i in own else i in _DATE_FORMATS)}

    def rows(self, path: str) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """(row number, filled cells by column) in file order."""
        number, cells = None, {}
        for kind, raw in self._records(path):
            if kind == _ROW:
                if number is not None:
                    yield number, cells
                number, cells = int.from_bytes(raw[:4], "little"), {}
            elif _RK <= kind <= _FORMULA_BOOL and (value := self._value(kind, raw[8:], int.from_bytes(raw[4:7], "little"))) is not None:
                cells[int.from_bytes(raw[:4], "little")] = value
        if number is not None:
            yield number, cells

    def _value(self, kind: int, raw: bytes, style: int) -> tuple[str, str] | None:
        if kind in (_BOOL, _FORMULA_BOOL):
            return "bool", "True" if raw[0] else "False"
        if kind in (_TEXT, _FORMULA_TEXT, _SHARED):
            text = self.strings[int.from_bytes(raw[:4], "little")] if kind == _SHARED else self._text(raw, 0)[0]
            return ("str", text) if text else None
        if kind in (_REAL, _FORMULA_REAL):
            return _number(struct.unpack("<d", raw[:8])[0], style in self.dates, self.epoch)
        if kind == _RK:  # 30 bits of a number: the upper ones of a double or an integer, either perhaps in hundredths
            bits = int.from_bytes(raw[:4], "little", signed=True)
            number = float(bits >> 2) if bits & 2 else struct.unpack("<d", b"\0\0\0\0" + (bits & ~3 & 0xFFFFFFFF).to_bytes(4, "little"))[0]
            return _number(number / 100 if bits & 1 else number, style in self.dates, self.epoch)
        return None  # errors


def read_workbook(book: Workbook | BinaryWorkbook, max_rows: int | None) -> Iterator[Sheet]:
    for name, path in book.sheets:
        # A sheet is as wide as its widest row, so it is read twice; no more than a row is held.
        number, header, width = -1, {}, 0
        for n, c in book.rows(path):
            if c:
                number, header = (n, c) if not header else (number, header)
                width = max(width, max(c) + 1)
        if not header:
            yield Sheet(name, [], iter(()))
            continue
        raw = [header.get(k, ("", ""))[1] for k in range(width)]
        sheet = Sheet(name, column_names(raw), iter(()))

        def cells(path=path, number=number, sheet=sheet, raw=raw) -> Iterator[Cell]:
            filled: set[int] = set()
            for n, c in book.rows(path):
                row = n - number - 1
                if row < 0 or not c:
                    continue  # blank rows count once a filled one follows
                if max_rows is not None and row >= max_rows:
                    sheet.rows = max_rows
                    break
                sheet.rows = row + 1
                for k, (kind, value) in c.items():
                    filled.add(k)
                    yield k, row, kind, value
            used = [k for k, h in enumerate(raw) if h or k in filled]
            sheet.first, sheet.last = (used[0], used[-1] + 1) if used else (0, 0)

        sheet.cells = cells()
        yield sheet


def read_member(path: str, chain: tuple[str, ...], max_rows: int | None) -> Iterator[Sheet]:
    name = (chain[-1] if chain else path).replace("\\", "/").rsplit("/", 1)[-1]
    stem, _, extension = name.rpartition(".")
    stream = open_chain(path, chain)
    if extension.lower() in ("csv", "tsv"):
        yield from read_csv(stream, "," if extension.lower() == "csv" else "\t", stem, max_rows)
    else:
        yield from read_workbook((BinaryWorkbook if extension.lower() == "xlsb" else Workbook)(stream), max_rows)
