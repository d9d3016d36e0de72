"""Finders: the current rows of a surface, searched, ordered and cut to a page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.functions.conditions import Condition, phases
from gaugeloom.operators import snapshot


@dataclass(frozen=True)
class Surface:
    """What a finder looks at: the identity of its rows, their counters, and how often they are recorded.

    `partition` names the column whose values are recorded on their own, as
    relations are per database; `same` must be equal for a row to be the same
    entity as before; cadence None stands for the recorded interval.
    """

    name: str
    identity: tuple[str, ...]
    counters: tuple[str, ...]
    cadence: float | None = None
    partition: str | None = None
    same: tuple[str, ...] = ()


RELATION_SECONDS, PROCESS_SECONDS, DEFAULT_SECONDS = 300, 5, 30
SURFACES = {
    s.name: s
    for s in (
        Surface("processes", ("pid",), ("utime", "stime"), PROCESS_SECONDS, same=("starttime",)),
        Surface("activity", ("pid",), ()),
        Surface("locks", ("pid", "target"), ()),
        Surface("vacuum", ("pid",), ()),
        Surface("databases", ("datid",), ("xact_commit", "xact_rollback", "blks_read", "blks_hit", "deadlocks")),
        Surface("statements", ("queryid", "userid", "dbid"), ("calls", "rows", "total_exec_time")),
        Surface("plans", ("userid", "dbid", "queryid", "planid"), ("rows", "total_time")),
        Surface("tables", ("datid", "relid"), ("seq_scan", "idx_scan", "n_tup_ins", "n_tup_upd", "n_tup_del"), RELATION_SECONDS, partition="datid"),
        Surface("indexes", ("datid", "relid", "indexrelid"), ("idx_scan", "idx_tup_read", "idx_tup_fetch"), RELATION_SECONDS, partition="datid"),
    )
}


def recorded_interval(settings: DataFrame, at: int, name: str = "interval_seconds", ts: str = "ts") -> float:
    """The latest recorded interval at or before a time, in seconds; a default without a positive one."""
    row = settings.where((F.col(ts) <= at) & (F.col(name) > 0)).agg(F.max_by(name, ts).alias("x")).first()
    return float(row["x"]) if row["x"] else float(DEFAULT_SECONDS)


def current(df: DataFrame, surface: Surface, at: int, interval: float = DEFAULT_SECONDS, ts: str = "ts") -> DataFrame:
    """The surface's rows as of a time, counters as rates; nothing that is older than the look-back."""
    back = snapshot.look_back_of(surface.cadence or interval)
    have = [c for c in surface.counters if c in df.columns]
    if surface.partition:
        return snapshot.partitioned(df, at, surface.partition, list(surface.identity), have, back, ts, "type_id" if "type_id" in df.columns else None)
    return snapshot.with_rates(df, at, list(surface.identity), have, list(surface.same), ts, back)


def find(
    df: DataFrame, surface: Surface, at: int, member: Column | None = None, result: Column | None = None, order: str | None = None, descending: bool = True, limit: int = 20, interval: float = DEFAULT_SECONDS,
    wanted: Condition | None = None, own: Column | None = None,
) -> DataFrame:
    """A page of current rows: members that match, results that match, ordered, ties and default order by identity.

    `member` speaks of stored columns, `result` of rates and derived values,
    `wanted` of the surface's fields; with eligible, the number that match,
    excluded, how many of `own`, as the recorder's statements, match and are not
    listed, and truncated. Every row that is listed must be the only one of its
    identity among all current ones: a second scan of their identities proves
    it, and the query fails if one is not.
    """
    if not 0 < limit <= 5_000:
        raise ValueError("1 to 5000 rows")
    whole = rows = current(df, surface, at, interval)
    if wanted is not None:
        before, after = phases(wanted, grouped=False)
        member = before if member is None else member & before
        result = after if result is None else result & after
    for condition in (member, result):
        rows = rows if condition is None else rows.where(condition)
    hidden = F.lit(False) if own is None else F.coalesce(own, F.lit(False))
    excluded = rows.agg(F.count_if(hidden).alias("excluded"))
    keys = list(surface.identity)
    page = snapshot.page(rows.where(~hidden), order or keys[0], keys, limit, descending if order else False)
    return _proven(page, whole, keys).crossJoin(F.broadcast(excluded))


def _proven(page: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The page, which fails when read if an identity in it has several rows among `rows`. The page's identities are broadcast."""
    asked = page.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    copies = rows.select(*keys).join(F.broadcast(asked), same).groupBy(*[f"_k_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("_copies"))
    checked = page.join(F.broadcast(copies), same, "left")
    proof = F.when(F.col("_copies") > 1, F.raise_error(F.lit("several rows of one identity"))).otherwise(F.lit(True))
    return checked.where(proof.cast("boolean")).select(*page.columns)
