"""Lines of server logs to records: continuations, quoted line ends, JSON lines, and prefixes.

Lines have a source, the number of their file in it, and their place in the
file. A file is one window; what of a record stands at a file's head belongs to
the last record of the files before, which a row per file tells. So records
span files, and no task sees more of a source than a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities of records, and the parts that follow a record under a marker of their own.
SEVERITIES = ("DEBUG1", "DEBUG2", "DEBUG3", "DEBUG4", "DEBUG5", "LOG", "INFO", "NOTICE", "WARNING", "ERROR", "FATAL", "PANIC")
PARTS = {"DETAIL": "detail", "HINT": "hint", "CONTEXT": "context", "STATEMENT": "statement", "QUERY": "statement"}
# The columns of the database's CSV log, in order.
CSV = (
    "log_time user_name database_name process_id connection_from session_id session_line_num command_tag session_start_time virtual_transaction_id transaction_id error_severity "
    "sql_state_code message detail hint internal_query internal_query_pos context query query_pos location application_name backend_type leader_pid query_id"
).split()
# Escapes of a line prefix and what they stand for.
ESCAPES = {
    "m": ("logged_at", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+ \S+"), "t": ("logged_at", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \S+"), "n": ("epoch", r"\d+\.\d+"), "p": ("pid", r"\d+"), "u": ("user", r"[^\s@\[\]]*"), "d": ("database", r"[^\s@\[\]]*"),
    "a": ("application", r".*?"), "h": ("host", r"\S*?"), "r": ("host", r"\S*?"), "l": ("line", r"\d+"), "c": ("session", r"[0-9a-f.]+"), "e": ("sqlstate", r"[0-9A-Z]{5}"), "b": ("backend_type", r".*?"), "x": ("xid", r"\d+"), "v": ("vxid", r"\S*?"),
    "i": ("command", r".*?"), "s": ("started_at", r"\S+ \S+ \S+"), "P": ("leader", r"\d*"), "Q": ("query_id", r"-?\d+"),
}
_MARK = re.compile(r"%(-?\d*)([A-Za-z%])")


def numbered(lines: DataFrame, starts: Column, by: list[str], file: str, place: str) -> DataFrame:
    """Lines with the record they belong to: (rec_file, rec), the file it starts in and its number there. Lines before any start have nulls.

    A source's files are few against its lines, and are what runs through one task.
    """
    inside = Window.partitionBy(*by, file).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumn("rec", F.sum(starts.cast("int")).over(inside))
    files = lines.withColumn("_s", starts.cast("int")).groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col(file).alias("_f")).agg(F.sum("_s").alias("_n"))
    ahead = Window.partitionBy(*[f"_{b}" for b in by]).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    carried = files.withColumn("_last", F.last(F.when(F.col("_n") > 0, F.struct("_f", "_n")), ignorenulls=True).over(ahead))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(file) == F.col("_f")]
    joined = counted.join(carried.drop("_n"), same)
    head = F.col("rec") == 0
    rec_file, rec = F.when(head, F.col("_last._f")).otherwise(F.col(file)), F.when(head, F.col("_last._n")).otherwise(F.col("rec"))
    return joined.select(*lines.columns, rec_file.alias("rec_file"), rec.alias("rec"))


def _records(found: DataFrame, by: list[str], file: str, place: str, line: str) -> DataFrame:
    """(by..., rec_file, rec, first_place, lines): the lines of each record in order."""
    kept = found.where("rec IS NOT NULL").groupBy(*by, "rec_file", "rec").agg(F.array_sort(F.collect_list(F.struct(file, place, line))).alias("_l"))
    return kept.select(*by, "rec_file", "rec", F.col("_l")[0][place].alias("first_place"), F.transform("_l", lambda x: x[line]).alias("lines"))


def _marker(names: tuple[str, ...]) -> str:
    """Before the first marker of any kind: text with no `:  ` that a marker ends."""
    return rf"(?s)^(.*?)\b({'|'.join(names)}):  (.*)$"


def prefix_pattern(prefix: str) -> tuple[str, list[str]]:
    """A line prefix such as '%m [%p] %q%u@%d ' as an expression with a group per escape, and the names of its groups. What follows %q may be missing."""
    out, names, at, optional = "", [], 0, False
    for m in _MARK.finditer(prefix):
        out += re.escape(prefix[at : m.start()])
        at, escape = m.end(), m[2]
        if escape == "%":
            out += "%"
        elif escape == "q":
            out, optional = out + "(?:", True
        elif escape in ESCAPES:
            name, body = ESCAPES[escape]
            out += rf"\s*({body})\s*" if m[1] else f"({body})"
            names.append(name)
        else:
            raise ValueError(f"unknown escape %{escape}")
    return out + re.escape(prefix[at:]) + (")?" if optional else ""), names


def stderr(lines: DataFrame, by: list[str], file: str, place: str, line: str = "line", prefix: str | None = None) -> DataFrame:
    """Records of plain log lines: by..., rec_file, rec, first_place, head, severity, sqlstate, message, detail, hint, context, statement, and the prefix's fields.

    A record starts with a line that carries a severity. A line that begins with
    a tab goes on with what is before it, and a line with the marker of a part,
    as DETAIL, starts that part; other lines before any record are dropped, and
    those inside one end nothing and add nothing. Null lines are left out.
    """
    text = F.col(line)
    first = F.regexp_extract(text, rf"(?s)^.*?\b({'|'.join((*SEVERITIES, *PARTS))}):  ", 1)
    starts = ~text.startswith("\t") & first.isin(*SEVERITIES)
    rows = _records(numbered(lines.where(text.isNotNull()), starts, by, file, place), by, file, place, line)
    opener = lambda x: F.when(x.startswith("\t"), F.struct(F.lit(None).cast("string").alias("part"), F.substring(x, 2, 1 << 30).alias("text"), F.lit(True).alias("goes_on"))).when(
        x.rlike(_marker(tuple(PARTS))), F.struct(F.regexp_extract(x, _marker(tuple(PARTS)), 2).alias("part"), F.regexp_extract(x, _marker(tuple(PARTS)), 3).alias("text"), F.lit(False).alias("goes_on"))
    )
    body = F.filter(F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), opener), lambda x: x.isNotNull())
    zero = F.struct(F.lit("message").alias("open"), *[F.lit("").alias(n) for n in ("message", "detail", "hint", "context", "statement")])

    def add(acc: Column, x: Column) -> Column:
        now = F.when(x["goes_on"], acc["open"]).otherwise(F.create_map(*[F.lit(v) for kv in PARTS.items() for v in kv])[x["part"]])
        grown = lambda n: F.when(now == n, F.when(acc[n] == "", x["text"]).otherwise(F.concat(acc[n], F.lit("\n"), x["text"]))).otherwise(acc[n])
        return F.struct(now.alias("open"), *[grown(n).alias(n) for n in ("message", "detail", "hint", "context", "statement")])

    opening = _marker(SEVERITIES)
    head, said = F.regexp_extract(F.col("lines")[0], opening, 1), F.trim(F.regexp_extract(F.col("lines")[0], opening, 3))
    state = F.when(said.rlike(r"^[0-9A-Z]{5}: "), F.substring(said, 1, 5))
    rows = rows.withColumn("_x", F.aggregate(body, zero, add)).withColumns({"head": head, "severity": F.regexp_extract(F.col("lines")[0], opening, 2), "sqlstate": state})
    message = F.concat_ws("\n", F.when(state.isNotNull(), F.substring(said, 8, 1 << 30)).otherwise(said), F.when(F.col("_x.message") != "", F.col("_x.message")))
    out = rows.select(*by, "rec_file", "rec", "first_place", "head", "severity", "sqlstate", message.alias("message"), *[F.when(F.col(f"_x.{n}") != "", F.col(f"_x.{n}")).alias(n) for n in ("detail", "hint", "context", "statement")])
    if prefix is None:
        return out
    pattern, names = prefix_pattern(prefix)
    groups = {n: F.when(F.col("head").rlike("^" + pattern), F.nullif(F.regexp_extract("head", "^" + pattern, k + 1), F.lit(""))) for k, n in enumerate(names)}
    return out.select("*", *[c.alias(n) for n, c in groups.items()])


def csv(lines: DataFrame, by: list[str], file: str, place: str, line: str = "line") -> DataFrame:
    """Records of a CSV log, whose quoted fields may hold line ends: by..., rec_file, rec, first_place, and the log's columns as texts, empty ones null.

    A line starts a record if an even number of quotes comes before it in its
    source. Fewer columns, as older servers write, leave the last ones null.
    """
    rows = lines.where(F.col(line).isNotNull()).withColumn("_q", F.char_length(line) - F.char_length(F.replace(F.col(line), F.lit('"'))))
    inside = Window.partitionBy(*by, file).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col(file).alias("_f")).agg(F.sum("_q").alias("_n"))
    ahead = Window.partitionBy(*[f"_{b}" for b in by]).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    carried = files.select(*[f"_{b}" for b in by], "_f", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(file) == F.col("_f")]
    open_ = rows.withColumn("_upto", F.coalesce(F.sum("_q").over(inside), F.lit(0))).join(carried, same).withColumn("_starts", (F.col("_upto") + F.col("_before")) % 2 == 0)
    found = _records(numbered(open_.select(*lines.columns, "_starts"), F.col("_starts"), by, file, place), by, file, place, line)
    # Fields are split where an even number of quotes is behind; quotes around one go, and doubled ones inside are one.
    fields = F.split(F.array_join("lines", "\n"), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return found.select(*by, "rec_file", "rec", "first_place", plain.alias("_c")).where(F.size("_c") > 1).select(*by, "rec_file", "rec", "first_place", *[F.nullif(F.get("_c", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(CSV)])


def json(lines: DataFrame, line: str = "line") -> DataFrame:
    """Records of a JSON log, one per line, with the CSV log's names for what both have; lines that are no object are left out."""
    schema = "timestamp string, user string, dbname string, pid long, error_severity string, state_code string, message string, detail string, hint string, context string, statement string, application_name string, backend_type string, query_id long"
    got = lines.withColumn("_j", F.from_json(line, schema)).where("_j.message IS NOT NULL OR _j.error_severity IS NOT NULL")
    names = {"timestamp": "log_time", "user": "user_name", "dbname": "database_name", "pid": "process_id", "state_code": "sql_state_code", "statement": "query"}
    fields = [f.split()[0] for f in schema.split(", ")]
    return got.select(*lines.columns, *[F.col(f"_j.{f}").alias(names.get(f, f)) for f in fields])
