"""Typed search conditions on the fields of a surface, compiled to columns.

    fields = conditions.of("tables")
    wanted = fields["schema"].matches("pub*") & (fields["size"].above("100MB") | fields["buffer_hit"].below("90%"))
    member, result = conditions.phases(wanted, grouped=True)

A condition is a tree of at most CLAUSES predicates in groups at most DEPTH
deep. Texts and identifiers speak of members, before grouping; quantities speak
of results, after it. Quantities carry the unit of their field and are compared
exactly where the metric is a whole number or a quotient of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeloom.functions import search
from gaugeloom.functions.ratios import POOLS, neutral_sum, percent, quotient

# Bounds of a search.
CLAUSES, DEPTH, LETTERS, CHOICES, DIGITS = 8, 4, 256, 8, 38
BLOCK, TICKS, NANOSECONDS = 8_192, 100, 10**9

Get = Callable[[str], Column]
#: What a unit of each kind must look like, as the step between the quantity's base unit and the metric's.
BYTE, DURATION, RATE = search.BYTES, search.SECONDS, "/s"


@dataclass(frozen=True)
class Field:
    """A field of a surface: a text over columns, an identifier, or a quantity of a kind of unit."""

    name: str
    kind: str  # text, identifier, or bytes, byte_rate, count, count_rate, duration, duration_rate, percentage, scalar
    columns: tuple[str, ...] = ()
    metric: Callable[[Get], Column] | None = None
    signed: bool = False
    parts: tuple[str, ...] | None = None  # (whole number,) or (dividend, divisor), to compare exactly
    aliases: tuple[str, ...] = ()

    @property
    def is_member(self) -> bool:
        return self.kind in ("text", "identifier")

    def matches(self, text: str) -> Condition:
        """Anywhere in one of the columns, * and ? being wildcards; an identifier as a whole."""
        return Condition(Predicate(self, "matches", _value(self, text)))

    def contains(self, text: str) -> Condition:
        return Condition(Predicate(self, "contains", _text(self, text)))

    def equals(self, value: str | int) -> Condition:
        return Condition(Predicate(self, "equals", _value(self, str(value))))

    def any_of(self, values: Iterable[str | int]) -> Condition:
        found = tuple(dict.fromkeys(_value(self, str(v)) for v in values))
        if not 0 < len(found) <= CHOICES:
            raise ValueError(f"1 to {CHOICES} values")
        return Condition(Predicate(self, "any_of", found))

    def above(self, quantity: str) -> Condition:
        return Condition(Predicate(self, "above", threshold(self, quantity)))

    def below(self, quantity: str) -> Condition:
        return Condition(Predicate(self, "below", threshold(self, quantity)))


@dataclass(frozen=True)
class Predicate:
    field: Field
    op: str
    value: object

    def column(self, get: Get) -> Column:
        f = self.field
        if f.is_member:
            one = {"matches": search.identifier if f.kind == "identifier" else search.glob, "contains": search.contains, "equals": search.identifier if f.kind == "identifier" else search.exact}
            tests = [one["equals"](get(c), v) for c in f.columns for v in self.value] if self.op == "any_of" else [one[self.op](get(c), self.value) for c in f.columns]
            return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), tests), F.lit(False))
        exact, q = search.above if self.op == "above" else search.below, self.value
        if f.parts is not None:
            test = exact(get(f.parts[0]), q, *[get(c) for c in f.parts[1:]])
        else:
            x = f.metric(get).cast("double")
            test = x > float(q) if self.op == "above" else x < float(q)
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Condition:
    """A predicate, or two conditions that must both hold (`&`) or one of which must (`|`)."""

    predicate: Predicate | None = None
    join: str = ""
    sides: tuple[Condition, ...] = ()
    size: int = field(default=1, compare=False)
    depth: int = field(default=0, compare=False)

    def _with(self, other: Condition, join: str) -> Condition:
        size = self.size + other.size
        depth = max(c.depth + (c.join not in ("", join)) for c in (self, other))  # a group inside a group of the other kind
        if size > CLAUSES:
            raise ValueError(f"more than {CLAUSES} predicates")
        if depth > DEPTH:
            raise ValueError(f"groups more than {DEPTH} deep")
        return Condition(None, join, (self, other), size, depth)

    def __and__(self, other: Condition) -> Condition:
        return self._with(other, "and")

    def __or__(self, other: Condition) -> Condition:
        return self._with(other, "or")

    def predicates(self) -> list[Predicate]:
        return [self.predicate] if self.predicate else [p for s in self.sides for p in s.predicates()]

    def column(self, get: Get = F.col, known: Callable[[Predicate], bool] = lambda p: True) -> Column:
        """As a column; predicates that are not `known` count as met."""
        if self.predicate:
            return self.predicate.column(get) if known(self.predicate) else F.lit(True)
        left, right = (s.column(get, known) for s in self.sides)
        return left & right if self.join == "and" else left | right

    def phase(self) -> str:
        """member, result, or both; an `or` of both can't be told before grouping nor after it."""
        if self.predicate:
            return "member" if self.predicate.field.is_member else "result"
        of = {s.phase() for s in self.sides}
        if len(of) > 1 or "both" in of:
            if self.join == "or":
                raise ValueError("an alternative mixes members and results of a grouped surface")
            return "both"
        return of.pop()


def phases(condition: Condition, grouped: bool, get: Get = F.col) -> tuple[Column, Column]:
    """(before, after) grouping or ranking: what members must meet, and what results must meet.

    Without groups a row has both kinds of fields: what members can tell alone
    is asked first, and the whole condition afterwards.
    """
    if grouped:
        condition.phase()
        return condition.column(get, lambda p: p.field.is_member), condition.column(get, lambda p: not p.field.is_member)
    return condition.column(get, lambda p: p.field.is_member), condition.column(get)


def filters(surface: str, given: list[dict]) -> Condition:
    """A condition from a list of {"field", "op", "value"} (or "values"): eq, contains, in, gt and lt, all of which must hold."""
    if not 0 < len(given) <= CLAUSES:
        raise ValueError(f"1 to {CLAUSES} filters")
    fields = of(surface)
    out: list[Condition] = []
    for item in given:
        op, wanted = item.get("op"), {"op", "field", "values" if item.get("op") == "in" else "value"}
        if op not in ("eq", "contains", "in", "gt", "lt") or set(item) != wanted:
            raise ValueError(f"not a filter: {item}")
        f = fields[item["field"]]
        for value in item["values"] if op == "in" else [item["value"]]:
            if isinstance(value, bool) or not isinstance(value, (str, int)) or (f.kind == "text" and not isinstance(value, str)):
                raise ValueError(f"not a value of {f.name}: {value!r}")
        if f.is_member and op in ("gt", "lt") or not f.is_member and op in ("eq", "contains", "in"):
            raise ValueError(f"{op} does not apply to {f.name}")
        one = f.any_of(item["values"]) if op == "in" else {"eq": f.equals, "contains": f.contains, "gt": f.above, "lt": f.below}[op](item["value"])
        if one not in out:
            out.append(one)
    return reduce(lambda a, b: a & b, out)


def anywhere(surface: str, text: str) -> Condition:
    """The text in any of a surface's texts."""
    return of(surface)["text"].matches(text)


def threshold(f: Field, quantity: str | int) -> Fraction:
    """The exact value of a quantity in the unit of the field's metric: bytes, milliseconds, per cent, or a number, and that per second.

    A whole number given as an int is in that unit already.
    """
    if f.is_member:
        raise ValueError(f"{f.name} is no quantity")
    if isinstance(quantity, int):
        if quantity < 0:
            raise ValueError("negative")
        return Fraction(quantity)
    if len(quantity) > LETTERS:
        raise ValueError(f"more than {LETTERS} characters")
    per = quantity.endswith(RATE)
    if per != f.kind.endswith("rate"):
        raise ValueError(f"{f.name} is {'a rate' if f.kind.endswith('rate') else 'no rate'}: {quantity}")
    body = quantity.removesuffix(RATE)
    digits = len(body) - len(body.lstrip("0123456789."))
    unit = body[digits:]
    if digits == 0 or body != body.strip() or unit[:1].isspace():
        raise ValueError(f"not a quantity: {quantity}")
    kind = f.kind.removesuffix("_rate")
    allowed = {"bytes": BYTE, "byte": BYTE, "duration": DURATION, "percentage": {"%": 1}}.get(kind, {"": 1})
    if unit not in allowed:
        raise ValueError(f"{quantity}: {f.name} wants one of {', '.join(allowed) or 'no unit'}")
    value = Fraction(search.quantity(body))
    if f.kind == "count" and value.denominator != 1:
        raise ValueError("a part of a count")
    return value * 1_000 if kind == "duration" else value


def _text(f: Field, text: str) -> str:
    if f.kind != "text":
        raise ValueError(f"{f.name} is no text")
    if not text or len(text) > LETTERS:
        raise ValueError(f"1 to {LETTERS} characters")
    return text


def _value(f: Field, text: str) -> str:
    if f.kind == "identifier":
        digits = text.removeprefix("-") if f.signed else text
        if not digits.isascii() or not digits.isdigit() or (digits != "0" and digits[0] == "0") or text == "-0" or len(text) > DIGITS:
            raise ValueError(f"not an identifier: {text}")
        return text
    return _text(f, text)


class Fields(dict):
    def __missing__(self, name: str):
        raise ValueError(f"unknown field {name}; known are {', '.join(self)}")


def of(surface: str) -> Fields:
    """The fields of a surface by name and alias."""
    if surface not in SURFACES:
        raise ValueError(f"unknown surface {surface}; known are {', '.join(SURFACES)}")
    return Fields({name: f for f in SURFACES[surface] for name in (f.name, *f.aliases)})


def _texts(**columns: str) -> list[Field]:
    """Text fields as name="columns | aliases"."""
    split = {name: [part.split() for part in (spec + "|").split("|")] for name, spec in columns.items()}
    return [Field(name, "text", tuple(c), aliases=tuple(a)) for name, (c, a, *_) in split.items()]


def _ids(*names: str, signed: bool = False, **columns: str) -> list[Field]:
    return [Field(n, "identifier", (columns.get(n, n),), signed=signed) for n in (*names, *(c for c in columns if c not in names))]


def _numbers(kind: str, **metrics: Callable[[Get], Column]) -> list[Field]:
    return [Field(n, kind, metric=m) for n, m in metrics.items()]


def _whole(kind: str, *names: str) -> list[Field]:
    return [Field(n, kind, metric=lambda g, n=n: g(n), parts=(n,)) for n in names]


def _also(fields: list[Field], **aliases: str) -> list[Field]:
    return [replace(f, aliases=tuple(aliases[f.name].split())) if f.name in aliases else f for f in fields]


_PER_CALL = {
    "mean_exec": ("duration", lambda g: quotient(g("total_exec_time"), g("calls"))),
    "rows_per_call": ("scalar", lambda g: quotient(g("rows"), g("calls"))),
}
_BUFFER = {
    f"{pool}_buffer_{verb}_rate": (lambda g, c=f"{pool}_blks_{column}": g(c) * BLOCK)
    for pool in ("shared", "local", "temp")
    for verb, column in (("hit", "hit"), ("read", "read"), ("dirty", "dirtied"), ("write", "written"))
    if pool != "temp" or verb in ("read", "write")
}
_TIMES = {f"{pool}_{verb}_time_rate": (lambda g, c=f"{pool}_blk_{verb}_time": g(c)) for pool in ("shared", "local", "temp") for verb in ("read", "write")}
_EXECUTED = [
    *_numbers("count_rate", call_rate=lambda g: g("calls"), row_rate=lambda g: g("rows")), *_numbers("duration_rate", exec_time_rate=lambda g: g("total_exec_time"), planning_time_rate=lambda g: g("total_plan_time")),
    *[Field(n, kind, metric=m) for n, (kind, m) in _PER_CALL.items()], *_numbers("percentage", planning_share=lambda g: percent(g("total_plan_time"), g("total_plan_time") + g("total_exec_time"))),
    *_numbers("byte_rate", **_BUFFER), *_numbers("duration_rate", **_TIMES),
    *_numbers("percentage", buffer_hit=lambda g: percent(g("shared_blks_hit"), g("shared_blks_hit") + g("shared_blks_read"))),
]
_CPU = {"cpu_cores": ("utime", "stime"), "user_cpu_cores": ("utime",), "system_cpu_cores": ("stime",)}

# The fields of each surface, with their columns and aliases. Counters are rates per second by then.
SURFACES: dict[str, list[Field]] = {
    "statements": [
        *_texts(text="query datname usename | q", database="datname | db", role="usename | user"), *_ids(signed=True, query_id="queryid"), *_EXECUTED,
        *_numbers("count_rate", plan_rate=lambda g: g("plans")), *_numbers("bytes", wal_per_call=lambda g: quotient(g("wal_bytes"), g("calls"))), *_numbers("byte_rate", wal_rate=lambda g: g("wal_bytes")),
    ],
    "plans": [*_texts(text="plan datname usename | q", database="datname | db", role="usename | user"), *_ids(signed=True, query_id="queryid", plan_id="planid"), *_whole("count", "calls"), *_EXECUTED],
    "tables": [
        *_texts(text="datname schemaname relname tablespace | q", database="datname | db", schema="schemaname", table_name="relname | table", tablespace="tablespace"),
        *_numbers("bytes", size=lambda g: neutral_sum(g("main_fork_bytes"), g("toast_bytes"))), *_whole("count", "table_count", "xid_age"),
        *_numbers("percentage", buffer_hit=lambda g: percent(neutral_sum(*[g(f"{p}_blks_hit") for p in POOLS]), neutral_sum(*[g(f"{p}_blks_{x}") for p in POOLS for x in ("read", "hit")]))),
        *_numbers("count_rate", seq_scan_rate=lambda g: g("seq_scan"), change_rate=lambda g: g("n_tup_ins") + g("n_tup_upd") + g("n_tup_del"), autovacuum_rate=lambda g: g("autovacuum_count")),
        *_numbers("duration", autovacuum_mean=lambda g: quotient(g("total_autovacuum_time"), g("autovacuum_count"))),
    ],
    "indexes": [
        *_texts(text="datname schemaname relname indexrelname tablespace amname indexdef | q", database="datname | db", schema="schemaname", table_name="relname | table", index_name="indexrelname | index",
                access_method="amname | method", definition="indexdef", tablespace="tablespace"),
        *_numbers("bytes", size=lambda g: g("main_fork_bytes")), *_whole("count", "index_count"),
        *_numbers("percentage", buffer_hit=lambda g: percent(g("idx_blks_hit"), g("idx_blks_read") + g("idx_blks_hit"))), *_numbers("count_rate", scan_rate=lambda g: g("idx_scan")),
    ],
    "processes": [
        *_texts(text="comm cmdline | q", command="comm cmdline | cmd", user="user | username", state="state"), *_also(_ids("pid", user_id="uid", effective_user_id="euid", parent_pid="ppid"), user_id="uid", parent_pid="ppid"),
        *_also(_numbers("bytes", rss=lambda g: g("rmem_kb") * 1_024, vsz=lambda g: g("vmem_kb") * 1_024, swap=lambda g: g("vswap_kb") * 1_024), rss="resident_memory", vsz="virtual_memory"), *_numbers("count", threads=lambda g: g("num_threads")),
        *_numbers("scalar", **{n: (lambda g, c=c: reduce(lambda a, b: a + b, map(g, c)) / TICKS) for n, c in _CPU.items()}),
        *_also(_numbers("byte_rate", disk_read_rate=lambda g: g("read_bytes"), disk_write_rate=lambda g: g("write_bytes"), logical_read_rate=lambda g: g("rchar"), logical_write_rate=lambda g: g("wchar")),
               disk_read_rate="read_bytes_rate", disk_write_rate="write_bytes_rate", logical_read_rate="rchar_rate", logical_write_rate="wchar_rate"),
        *_numbers("count_rate", read_syscall_rate=lambda g: g("syscr"), write_syscall_rate=lambda g: g("syscw"), major_fault_rate=lambda g: g("majflt"), minor_fault_rate=lambda g: g("minflt"), context_switch_rate=lambda g: g("nvcsw") + g("nivcsw")),
        *_numbers("duration_rate", run_delay=lambda g: g("rundelay_ns") / (NANOSECONDS // 1_000), block_io_delay=lambda g: g("blkdelay_ticks") * (1_000 // TICKS)),
    ],
    "activity": [
        *_texts(text="query application_name client_addr datname usename | q", database="datname | db", role="usename | user", application="application_name | app", client_addr="client_addr | client", backend_type="backend_type",
                state="state", wait_event_type="wait_event_type", wait_event="wait_event"),
        *_ids("pid"), *_ids("query_id", signed=True), *_whole("count", "backend_xid_age", "backend_xmin_age"),
    ],
    "locks": [*_texts(text="query datname usename lock_relname | q", database="datname | db", role="usename | user", state="state", lock_type="lock_locktype | locktype", lock_mode="lock_mode | mode", table_name="lock_relname | table"), *_ids("pid")],
    "vacuum": [
        *_texts(text="datname relname schemaname phase | q", database="datname | db", schema="schemaname", table_name="relname | table", phase="phase", is_autovacuum="is_autovacuum | autovacuum"), *_ids("pid"),
        *_whole("count", "heap_blks_total", "heap_blks_scanned", "heap_blks_vacuumed"),
    ],
    "databases": [*_texts(text="datname | q", database="datname | db"), *_ids("datid"), *_whole("count", "numbackends"), *_numbers("count", **{n: (lambda g, n=n: g(n)) for n in ("xact_commit", "xact_rollback", "deadlocks")}), *_whole("bytes", "temp_bytes")],
}
