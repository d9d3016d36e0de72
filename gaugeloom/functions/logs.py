"""Log text: patterns that make occurrences of one error alike, and their families. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN_BYTES = 256
# Words followed by a number that differs from one occurrence to the next.
NUMBERED = ["transaction ", "relation ", "process ", "database ", "PID ", "signal ", "on page "]
DENIED = ["table", "schema", "sequence", "function", "database"]
# Families in order of precedence, with the phrases that name them.
FAMILIES = {
    "lock": ["deadlock detected", "could not obtain lock", "lock timeout", "still waiting for"],
    "constraint": ["duplicate key", "violates foreign key", "violates not-null", "violates check", "violates exclusion", "null value in column"],
    "serialization": ["could not serialize access"],
    "timeout": ["statement timeout", "idle-in-transaction session timeout", "transaction timeout", "idle session timeout", "canceling statement due to user request"],
    "resource": ["out of memory", "out of shared memory", "too many connections", "disk full", "could not extend", "remaining connection slots"],
    "data_corruption": ["invalid page", "could not read block", "data corrupted", "index corrupted", "unexpected zero page", "invalid checkpoint record", "invalid memory alloc"],
    "system": ["could not open file", "i/o error", "crash shutdown", "server process", "shutting down"],
    "connection": ["connection reset by peer", "unexpected eof", "broken pipe", "could not receive data", "could not send data", "terminating connection"],
    "auth": ["password authentication failed", "no pg_hba.conf entry", "role ", "permission denied", "ssl connection is required"],
    "syntax": ["syntax error", "does not exist", "invalid input syntax", "division by zero", "value too long"],
}


def _numbered(text: Column, word: str, digits: str) -> Column:
    """The number right behind the first place of the word, if there is one."""
    return F.regexp_replace(text, f"(?s)^((?:(?!{word}).)*{word}){digits}+", "$1...")


def normalize_error(message: Column) -> Column:
    """The message with what differs between occurrences replaced, at most PATTERN_BYTES bytes of it."""
    x = F.regexp_replace(message, "(?s) at character .*$", "")
    for quote in "\"'":  # pairs from the left; an empty pair stays
        x = F.regexp_replace(x, f"{quote}([^{quote}]*){quote}", "\u0001$1\u0002")
        x = F.regexp_replace(F.replace(x, F.lit("\u0001\u0002"), F.lit(quote * 2)), "\u0001[^\u0002]+\u0002", f"{quote}...{quote}")
    for opened, closed in (("(", ")"), ("[", "]")):
        x = F.regexp_replace(x, f"(?s)\\{opened}[^\\{closed}]*\\{closed}", f"{opened}...{closed}")
    for word in NUMBERED:
        x = _numbered(x, word, "[0-9]")
    x = _numbered(x, "after ", "[0-9.]")
    x = F.regexp_replace(x, "(?<![0-9A-Za-z])[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}(?![0-9A-Za-z])", "x/x")
    x = F.regexp_replace(x, "(?s)^(.*?invalid input syntax for .*?: ).*$", "$1...")
    x = F.regexp_replace(x, f"(?is)^(.*?permission denied for (?:{'|'.join(DENIED)}) ).*$", "$1...")
    x = F.regexp_replace(x, "(?s)^(.*?byte sequence for encoding).*$", "$1 ...")
    return _cut(x)


def normalize_sql(text: Column) -> Column:
    """normalize_error, and bare numbers replaced."""
    return _cut(F.regexp_replace(normalize_error(text), "(?<![0-9A-Za-z_.])[0-9]+(?:\\.[0-9]+)?(?![0-9A-Za-z_])", "?"))


def _cut(text: Column) -> Column:
    """At most PATTERN_BYTES bytes, without a broken character at the end."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, PATTERN_BYTES)
    whole = F.regexp_replace(F.try_validate_utf8(F.decode(raw, "UTF-8")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= PATTERN_BYTES, text).otherwise(whole)


def classify_error(pattern: Column, severity: Column) -> Column:
    """The family of a message; panics are data corruption, and fatal messages of no family are system errors.

    The pattern is bound as a lambda's variable, so that it is computed once
    however many phrases are looked for.
    """

    def family(low: Column) -> Column:
        out = F.when(low.contains("terminated by signal") & low.contains(": killed"), "resource")
        for name, phrases in FAMILIES.items():
            out = out.when(reduce(lambda a, b: a | b, (low.contains(p) for p in phrases)), name)
        return out

    found = F.get(F.transform(F.array(F.lower(pattern)), family), F.lit(0))
    return F.when(severity == "PANIC", "data_corruption").otherwise(F.coalesce(found, F.when(severity == "FATAL", "system"), F.lit("other")))


# stderr lines of a database server: time, process, severity, message.
STDERR = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?) \S+ \[(\d+)\] (?:\S+ )?(DEBUG\d?|INFO|NOTICE|WARNING|ERROR|LOG|FATAL|PANIC|STATEMENT|DETAIL|HINT|CONTEXT):\s+(.*)$"
SLOW = r"(?s)^duration: ([0-9.]+) ms\s+(?:statement|execute [^:]*|plan):\s*(.*)$"
LOCK = r"(?s)^process (\d+) (still waiting for|acquired) (\w+) on (.+?) after ([0-9.]+) ms"
AUTOVACUUM = r'(?s)^automatic (aggressive )?(vacuum|analyze) of table "([^"]+)"'
CHECKPOINT = r"^checkpoint (starting|complete): (.*)$"
TEMP_FILE = r'^temporary file: path "([^"]+)", size (\d+)'
BOUNCER = r"^(\S+ \S+) \S+ \[(\d+)\] (LOG|WARNING|ERROR|FATAL|DEBUG|NOISE) (.*)$"
BOUNCER_SOCKET = r"^[CS]-0x[0-9a-f]+: ([^/\s]+)/([^@\s]+)@(\S+?)(?::\d+)? (.*)$"


def parse_stderr(line: Column) -> list[Column]:
    """logged_at, pid, severity, message of a line; all null if the line continues another."""
    part = lambda k: F.when(line.rlike(STDERR), F.regexp_extract(line, STDERR, k))
    return [part(1).alias("logged_at"), part(2).cast("long").alias("pid"), part(3).alias("severity"), part(4).alias("message")]


def parse_message(message: Column) -> list[Column]:
    """What slow-query, lock, autovacuum, checkpoint and temporary-file messages tell; null where a message is none."""
    got = lambda pattern, k: F.when(message.rlike(pattern), F.regexp_extract(message, pattern, k))
    return [
        got(SLOW, 1).cast("double").alias("slow_ms"), got(SLOW, 2).alias("slow_sql"),
        got(LOCK, 1).cast("long").alias("lock_pid"), got(LOCK, 2).alias("lock_phase"), got(LOCK, 4).alias("lock_target"), got(LOCK, 5).cast("double").alias("lock_ms"),
        got(AUTOVACUUM, 2).alias("auto_kind"), got(AUTOVACUUM, 3).alias("auto_relation"),
        got(CHECKPOINT, 1).alias("checkpoint_phase"), got(CHECKPOINT, 2).alias("checkpoint_detail"), got(TEMP_FILE, 2).cast("long").alias("temp_bytes"),
    ]


def parse_bouncer(line: Column) -> list[Column]:
    """level, text (without the socket), database, user, host of a connection pooler's line."""
    text = F.regexp_extract(line, BOUNCER, 4)
    of = lambda k: F.when(text.rlike(BOUNCER_SOCKET), F.regexp_extract(text, BOUNCER_SOCKET, k))
    level = F.when(line.rlike(BOUNCER), F.regexp_extract(line, BOUNCER, 3))
    return [level.alias("level"), F.coalesce(of(4), F.when(line.rlike(BOUNCER), text)).alias("text"), of(1).alias("database"), of(2).alias("user"), of(3).alias("host")]
