"""Row schemas of recorded sections, with the class of each column.

A layout is a Spark schema whose fields carry their class (cumulative, gauge,
label, timestamp) and unit as metadata, so operators can tell counters from
gauges and tables keep it when they are written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

KINDS = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.DoubleType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "ts": T.LongType(), "text": T.StringType(), "list": T.ArrayType(T.IntegerType(), False),
}
CLASSES = {"C": "cumulative", "G": "gauge", "L": "label", "T": "timestamp"}
SEMANTICS = ("snapshot_full", "conditional_full", "event_stream", "changed", "on_change")


@dataclass(frozen=True)
class Layout:
    """One physical row schema of a logical section.

    `columns` are `name:kind[?]/class[unit]`, for example `calls:i64/C[count]`.
    """

    type_id: int
    name: str
    semantics: str
    identity: tuple[str, ...]
    sort_key: tuple[str, ...]
    columns: tuple[str, ...]
    implementation: str | None = None
    schema: T.StructType = field(init=False, compare=False)

    def __post_init__(self):
        if self.semantics not in SEMANTICS:
            raise ValueError(f"unknown semantics: {self.semantics}")
        fields = [_field(c) for c in self.columns]
        missing = {*self.identity, *self.sort_key} - {f.name for f in fields}
        if missing:
            raise ValueError(f"{self.name}: no such columns: {sorted(missing)}")
        object.__setattr__(self, "schema", T.StructType(fields))

    def of_class(self, kind: str) -> list[str]:
        """Names of the columns of a class."""
        return [f.name for f in self.schema.fields if f.metadata["class"] == kind]

    def row_identity(self) -> list[str]:
        """What finds a row again: the identity, or for event streams every column that is no time."""
        return list(self.identity) or [f.name for f in self.schema.fields if f.metadata["class"] != "timestamp"]


def _field(text: str) -> T.StructField:
    name, _, rest = text.partition(":")
    kind, _, tail = rest.partition("/")
    unit = tail[2:-1] if len(tail) > 1 else None
    if CLASSES[tail[0]] in ("cumulative", "gauge") and unit is None:
        raise ValueError(f"{name}: counters and gauges need a unit")
    meta = {"class": CLASSES[tail[0]]} | ({"unit": unit} if unit else {})
    return T.StructField(name, KINDS[kind.rstrip("?")], kind.endswith("?"), meta)


class Registry:
    """Layouts by number and by name; layouts of one name make up a section."""

    def __init__(self, layouts: list[Layout]):
        self.by_id = {x.type_id: x for x in layouts}
        if len(self.by_id) != len(layouts):
            raise ValueError("a type_id is used twice")

    def section(self, name: str) -> list[Layout]:
        return sorted((x for x in self.by_id.values() if x.name == name), key=lambda x: x.type_id)

    def names(self) -> list[str]:
        return sorted({x.name for x in self.by_id.values()})


#: Sections that the operators are tried on; recordings bring their own layouts in the same way.
SECTIONS = Registry(
    [
        Layout(1, "processes", "snapshot_full", ("pid",), ("pid", "ts"), ("ts:ts/T", "pid:i32/L", "ppid:i32?/L", "starttime:i64/L", "uid:u32/L", "comm:text/L", "utime:i64/C[jiffies]", "stime:i64/C[jiffies]", "rss:i64?/G[kibibytes]")),
        Layout(2, "statements", "conditional_full", ("queryid", "userid", "dbid"), ("dbid", "queryid", "ts"), ("ts:ts/T", "queryid:i64/L", "userid:i64/L", "dbid:i64/L", "query:text?/L", "calls:i64/C[count]", "rows:i64/C[count]", "total_exec_time:f64/C[milliseconds]")),
        Layout(3, "statements", "conditional_full", ("queryid", "userid", "dbid"), ("dbid", "queryid", "ts"), ("ts:ts/T", "queryid:i64/L", "userid:i64/L", "dbid:i64/L", "query:text?/L", "calls:i64/C[count]", "rows:i64/C[count]", "total_exec_time:f64/C[milliseconds]", "wal_bytes:i64?/C[bytes]")),
        Layout(4, "pressure", "snapshot_full", ("scope", "resource"), ("scope", "resource", "ts"), ("ts:ts/T", "scope:i32/L", "resource:i32/L", "some_us:i64/C[microseconds]")),
        Layout(5, "locks", "snapshot_full", ("pid", "target"), ("pid", "ts"), ("ts:ts/T", "pid:i32/L", "target:text/L", "blocked_by:list/L", "granted:bool/L")),
        Layout(6, "log_errors", "event_stream", (), ("ts",), ("ts:ts/T", "severity:text/L", "category:text/L", "pattern:text/L", "count:i64?/G[count]")),
        Layout(7, "users", "changed", ("uid",), ("uid", "ts"), ("ts:ts/T", "uid:u32/L", "user:text/L")),
    ]
)
