"""Declared schemas: fields, their types and how values become terms and sortable numbers."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldType(Enum):
    TEXT, KEYWORD, LONG, DOUBLE, BOOLEAN, DATE = "text", "keyword", "long", "double", "boolean", "date"


NUMERIC = {FieldType.LONG, FieldType.DOUBLE, FieldType.BOOLEAN, FieldType.DATE}
_SPARK = {FieldType.TEXT: T.StringType(), FieldType.KEYWORD: T.StringType(), FieldType.LONG: T.LongType(), FieldType.DOUBLE: T.DoubleType(), FieldType.BOOLEAN: T.BooleanType(), FieldType.DATE: T.TimestampType()}


@dataclass(frozen=True)
class FieldMapping:
    name: str
    type: FieldType = FieldType.TEXT
    analyzer: str = "standard"
    search_analyzer: str | None = None
    stored: bool = True
    doc_values: bool = False
    positions: bool = True
    boost: float = 1.0
    suggest: bool = False

    @property
    def numeric(self) -> bool:
        return self.type in NUMERIC

    def query_analyzer(self) -> str:
        """Only text is analysed; a search analyzer falls back to the index analyzer."""
        return (self.search_analyzer or self.analyzer) if self.type is FieldType.TEXT else "keyword"

    def index_analyzer(self) -> str:
        return self.analyzer if self.type is FieldType.TEXT else "keyword"


@dataclass(frozen=True)
class IndexMapping:
    name: str
    fields: tuple[FieldMapping, ...]
    shards: int = 1
    replicas: int = 1
    default: str | None = None
    synonyms: tuple[str, ...] = ()
    by_name: dict[str, FieldMapping] = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        if not self.fields:
            raise ValueError("a mapping needs at least one field")
        if self.shards < 1 or self.replicas < 1:
            raise ValueError("shards and replicas are at least 1")
        object.__setattr__(self, "by_name", {f.name: f for f in self.fields})
        if self.default and self.default not in self.by_name:
            raise ValueError(f"default field {self.default!r} isn't mapped")

    @property
    def default_field(self) -> str:
        """The one named, else the first text field, else the first."""
        return self.default or next((f.name for f in self.fields if f.type is FieldType.TEXT), self.fields[0].name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.StringType())] + [T.StructField(f.name, _SPARK[f.type]) for f in self.fields] + [T.StructField("acl", T.ArrayType(T.StringType()))])


def typed(f: FieldMapping, value: Column, kind: T.DataType) -> Column:
    """A value in the field's type; strings are parsed, and what can't be parsed fails the job."""
    text = isinstance(kind, T.StringType)
    if f.type in (FieldType.TEXT, FieldType.KEYWORD):
        return value.cast("string")
    if f.type is FieldType.LONG:
        return F.trim(value).cast("long") if text else value.cast("long")  # fractions are cut off
    if f.type is FieldType.DOUBLE:
        return F.trim(value).cast("double") if text else value.cast("double")
    if f.type is FieldType.BOOLEAN:
        if not text:
            return value.cast("boolean")
        low = F.lower(F.trim(value))
        return F.when(low.isin("true", "false"), low == "true").otherwise((value != "") & (value != "0"))
    if not text:
        return F.timestamp_millis(value) if isinstance(kind, T.LongType | T.IntegerType) else value.cast("timestamp")
    return F.coalesce(F.try_to_timestamp(value), F.timestamp_millis(value.cast("long")))


def number_form(f: FieldMapping, value: Column) -> Column:
    """What ranges, sorts and facets of numeric types compare: a double; dates in milliseconds since 1970."""
    return (F.unix_millis(value) if f.type is FieldType.DATE else value).cast("double")


def term_form(f: FieldMapping, value: Column) -> Column:
    if f.type is FieldType.DATE:
        return F.unix_millis(value).cast("string")
    return number_text(value) if f.type is FieldType.DOUBLE else value.cast("string")


def number_text(value: Column) -> Column:
    """A double without `.0` where it is whole."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def term_of(f: FieldMapping, text: str) -> str:
    """The term that a word of a query means in a field that isn't text."""
    if f.type is FieldType.KEYWORD:
        return text
    try:
        number = number_of(f, text)
    except ValueError as e:
        raise ValueError(f"{text!r} isn't a {f.type.value}") from e
    if f.type is FieldType.BOOLEAN:
        return "true" if number else "false"
    return str(int(number)) if number == int(number) else repr(number)


def number_of(f: FieldMapping, text: str) -> float:
    if f.type is FieldType.BOOLEAN:
        low = text.strip().lower()
        return float(low == "true" if low in ("true", "false") else text not in ("", "0"))
    if f.type is FieldType.DATE:
        from datetime import UTC, datetime

        try:
            at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
            return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000
        except ValueError:
            return float(int(text))
    return float(int(float(text))) if f.type is FieldType.LONG else float(text)


def to_dict(m: IndexMapping) -> dict:
    return {"name": m.name, "shards": m.shards, "replicas": m.replicas, "default": m.default, "synonyms": list(m.synonyms), "fields": [f.__dict__ | {"type": f.type.value} for f in m.fields]}


def from_dict(d: dict) -> IndexMapping:
    return IndexMapping(d["name"], tuple(FieldMapping(**(f | {"type": FieldType(f["type"])})) for f in d["fields"]), d["shards"], d["replicas"], d["default"], tuple(d["synonyms"]))
