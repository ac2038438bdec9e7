"""Dialects: what an export's names and values say about keys and references.

To add one, subclass Dialect, give it a name, override what differs, and enter it with `register`. Rules about values
are Column expressions, so that they run in the scan; rules about names run on the driver, where the schema is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import UserError
from . import values

NO_KEY = 99


class Dialect:
    """The base: names and value overlap, nothing more."""

    name = "generic"
    #: Folders that hold attachments, not tables, in lower case.
    skipped_folders: frozenset[str] = frozenset()
    #: Whether record ids start with a token of their type.
    typed_ids = False
    #: Share of the sample that must look like an identifier.
    id_share = 0.95
    #: Whether integer columns can be identifiers, by name.
    integer_ids = False
    #: Whether the first unique identifier column may be the key where no name tells.
    key_fallback = True

    def node_name(self, member: str, sheet: str, sheets: int) -> str:
        stem = re.sub(r"\.[^.]*\Z", "", member.rsplit("/", 1)[-1])
        plain = sheets == 1 or sheet.lower() in ("sheet1", "sheet", stem.lower())
        return stem if plain else f"{stem}.{sheet}"

    def id_token(self, value: Column) -> Column:
        return F.lit(None).cast("string")

    def looks_like_id(self, value: Column) -> Column:
        return value.rlike(values.OPAQUE_ID)

    def integer_id(self, column: str, node: str) -> bool:
        return False

    def key_rank(self, column: str, node: str) -> int:
        c, n = column.lower(), node.lower().replace(" ", "_")
        if c in ("id", "pk", "key", "uuid", "guid"):
            return 0
        return 1 if c in (f"{n}_id", f"{n}id", f"{n}_key") else NO_KEY

    def reference_base(self, column: str) -> str | None:
        m = re.fullmatch(r"(.+?)[_\- ]?id", column, re.IGNORECASE | re.DOTALL)
        return m[1] if m else None

    def name_aliases(self, base: str) -> set[str]:
        low = base.lower()
        forms = {low, low.replace("_", ""), low.replace("_", " ")}
        plural = {f + "s" for f in forms} | {f[:-1] + "ies" for f in forms if f.endswith("y")}
        return forms | plural | {f[:-1] for f in forms if f.endswith("s")}

    def builtin_targets(self, column: str) -> tuple[str, ...]:
        return ()

    def is_polymorphic(self, column: str) -> bool:
        return False

    def name_for_token(self, token: str) -> str | None:
        return None


class Salesforce(Dialect):
    """Record ids carry their object's key prefix in the first three characters."""

    name = "salesforce"
    skipped_folders = frozenset({"contentversion"})
    typed_ids = True
    id_share = 0.9
    #: Standard key prefixes, columns with fixed targets, columns with several targets.
    PREFIXES = {
        "001": "Account", "003": "Contact", "005": "User", "006": "Opportunity", "00Q": "Lead", "500": "Case",
        "00T": "Task", "00U": "Event", "0Q0": "Quote", "801": "Order", "701": "Campaign", "00G": "Group",
        "012": "RecordType", "00e": "Profile", "0Hn": "ContentDocument", "068": "ContentVersion",
        "015": "Document", "00P": "Attachment",
    }
    BUILTIN = {
        "ownerid": ("User", "Group"), "createdbyid": ("User",), "lastmodifiedbyid": ("User",),
        "recordtypeid": ("RecordType",), "contactid": ("Contact",), "accountid": ("Account",),
    }
    POLYMORPHIC = frozenset({"whatid", "whoid", "parentid", "ownerid", "relatedtoid", "targetobjectid", "linkedentityid", "subjectid"})

    def id_token(self, value: Column) -> Column:
        return values.record_token(value)

    def looks_like_id(self, value: Column) -> Column:
        return value.rlike(values.RECORD_ID)

    def key_rank(self, column: str, node: str) -> int:
        c, n = column.lower(), node.lower()
        return 0 if c == "id" else 1 if c in (f"{n}id", f"{n}__c") else NO_KEY

    def reference_base(self, column: str) -> str | None:
        for pattern in (r"(.+?)__c", r"(.+?)id"):
            if m := re.fullmatch(pattern, column, re.IGNORECASE | re.DOTALL):
                return m[1]
        return None

    def name_aliases(self, base: str) -> set[str]:
        return super().name_aliases(base) | {base.lower() + "__c", base.lower().replace("_", "")}

    def builtin_targets(self, column: str) -> tuple[str, ...]:
        return self.BUILTIN.get(column.lower(), ())

    def is_polymorphic(self, column: str) -> bool:
        return column.lower() in self.POLYMORPHIC

    def name_for_token(self, token: str) -> str | None:
        return self.PREFIXES.get(token)


class Star(Dialect):
    """Warehouse tables with integer keys: an addition of this engine. Names decide, overlap proves nothing here."""

    name = "star"
    integer_ids = True
    key_fallback = False
    _KEY = re.compile(r"[a-z]+_(.+)key", re.IGNORECASE)
    _ID = re.compile(r"(.+)_id", re.IGNORECASE)

    def looks_like_id(self, value: Column) -> Column:
        return F.lit(False)

    def integer_id(self, column: str, node: str) -> bool:
        return bool(self._KEY.fullmatch(column) or self._ID.fullmatch(column)) or self.key_rank(column, node) < NO_KEY

    def key_rank(self, column: str, node: str) -> int:
        n = node.lower()
        if (m := self._KEY.fullmatch(column)) and n.startswith(m[1].lower()) and column.lower().startswith(n[:1]):
            return 0
        if (m := self._ID.fullmatch(column)) and (n.startswith(m[1].lower()) or n.rstrip("s") == m[1].lower()):
            return 1
        return NO_KEY

    def reference_base(self, column: str) -> str | None:
        m = self._KEY.fullmatch(column) or self._ID.fullmatch(column)
        return m[1] if m else None

    def aliases_of_node(self, node: str) -> list[str]:
        """Prefixes of three letters or more by which other tables' columns name this one."""
        n = node.lower()
        return [n[:k] for k in range(len(n), 2, -1)]


_KNOWN: dict[str, type[Dialect]] = {}


def register(dialect: type[Dialect]) -> None:
    _KNOWN[dialect.name] = dialect


for _d in (Dialect, Salesforce, Star):
    register(_d)


def names() -> list[str]:
    return list(_KNOWN)


def get(name: str) -> Dialect:
    if name not in _KNOWN:
        raise UserError(f"unknown profile '{name}' (known: {', '.join(_KNOWN)})")
    return _KNOWN[name]()
