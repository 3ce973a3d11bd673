"""SQL dumps: rows of INSERT statements, read by byte ranges.

Where a range of a dump begins, a reader cannot see whether it stands inside a quoted value. So ranges are read twice. First each range is
scanned from every state that a line can begin in (outside, in one of three quotes, in a comment), which gives five end states;
these few rows are chained by file, and each range then knows its state. In the second reading a range gives the statements that begin in it, and
reads on to the end of the last. Statements end at a semicolon outside of quotes and comments only. Ranges are moved to the next line's
beginning, where no escape and no mark of two characters is cut.

Values come as strings: quotes and escapes are resolved, NULL is null. Columns are named by the caller or by the statement's own list;
a row with fewer values has nulls. Statements of other tables, definitions and comments are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import opened, scratch

#: States at a line's beginning.
STATES = ("", "'", '"', "`", "/*")
_STEP = 1 << 20
_OUTSIDE = re.compile(rb"""['"`;]|/\*|--(?=[\s])[^\n]*|\#[^\n]*""")
_INSIDE = {"'": re.compile(rb"""[^'\\]*+(?:\\.[^'\\]*+)*+'""", re.S), '"': re.compile(rb"""[^"\\]*+(?:\\.[^"\\]*+)*+\"""", re.S), "`": re.compile(rb"[^`]*`"), "/*": re.compile(rb".*?\*/", re.S)}


def scan(data: bytes, state: str) -> tuple[str, list[int]]:
    """The state after data, and where its statements end (behind their semicolons)."""
    at, ends = 0, []
    while at < len(data):
        m = (_INSIDE[state] if state else _OUTSIDE).match(data, at) if state else _OUTSIDE.search(data, at)
        if not m:
            return state, ends
        at, mark = m.end(), m.group()
        if state:
            state = ""
        elif mark == b";":
            ends.append(at)
        elif mark[:1] in b"'\"`" or mark == b"/*":
            state = mark.decode()
    return state, ends


class _Range:
    """The bytes of a file from the line after `start` to the line after `end`, in pieces that end with a line; after that, more of the file."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.size = file, size
        self.start, self.end = self._line(start), self._line(end)

    def _line(self, at: int) -> int:
        if at in (0, self.size):
            return at
        at -= 1  # a line that begins just there belongs to the range
        while at < self.size:
            data = self.file.read_at(min(_STEP, self.size - at), at)
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return self.size

    def pieces(self, at: int, end: int) -> Iterator[bytes]:
        rest = b""
        while at < end:
            data = self.file.read_at(min(_STEP, end - at), at)
            at += len(data)
            cut = data.rfind(b"\n") + 1 if at < end else len(data)
            if cut:
                yield rest + data[:cut]
                rest = data[cut:]
            else:
                rest += data
        if rest:
            yield rest


def _statements(part: _Range, state: str) -> Iterator[bytes]:
    """The statements that begin in the range: behind a semicolon in it, or at the file's beginning."""
    held: list[bytes] = []
    within = part.start == 0  # whether what is read belongs to a statement of this range
    at = part.start
    for end in (part.end, part.size):
        over = end != part.end
        for piece in part.pieces(at, end) if end > at else ():
            state, ends = scan(piece, state)
            before = 0
            for e in ends:
                if within:
                    yield b"".join(held) + piece[before:e]
                    held = []
                within, before = not over, e
                if over:
                    return
            if within:
                held.append(piece[before:])
        at = max(at, end)
        if not within:
            return
    if b"".join(held).strip():
        yield b"".join(held)  # the last statement lacks its semicolon


_INSERT = re.compile(rb"(?:\s|--[^\n]*\n|\#[^\n]*\n|/\*.*?\*/)*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+(?:[`\"]?[\w$]+[`\"]?\.)?[`\"]?(?P<table>[\w$]+)[`\"]?\s*(?:\((?P<columns>[^()]*)\))?\s*VALUES\s*", re.I | re.S)
_VALUE = re.compile(r"""\s*(?:_\w+\s*)?(?:'([^'\\]*(?:(?:\\.|'')[^'\\]*)*)'|"([^"\\]*(?:(?:\\.|"")[^"\\]*)*)"|([^,()'"]*(?:\([^()]*\))?[^,()'"]*))\s*([,)])""", re.S)
_ESCAPE = re.compile(r"\\(.)|''|\"\"", re.S)
#: What letters stand for behind a backslash; other characters stand for themselves.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def _plain(quoted: str) -> str:
    return _ESCAPE.sub(lambda e: _ESCAPES.get(e[1], e[1]) if e[1] else e[0][0], quoted)


def sql_tuples(statement: str) -> Iterator[list[str | None]]:
    """The value lists of an INSERT statement."""
    m = _INSERT.match(statement.encode())
    at = statement.find("(", len(statement.encode()[: m.end()].decode()) if m else 0)
    while at >= 0:
        row: list[str | None] = []
        at += 1
        while m := _VALUE.match(statement, at):
            at = m.end()
            if m[1] is not None or m[2] is not None:
                row.append(_plain(m[1] if m[1] is not None else m[2]))
            else:
                row.append(None if m[3].strip().upper() == "NULL" else m[3].strip())
            if m[4] == ")":
                break
        yield row
        between = re.compile(r"\s*,?\s*\(").match(statement, at)
        at = between.end() - 1 if between else -1


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files and their sizes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the beginning of each range of one file, from the end states of those before it."""
    for table in batches:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        state = 0
        for r in rows:
            r["state"], state = state, r.pop("ends")[state]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("state", pa.int32())]))


def read_statements(spark: SparkSession, path: str, range_bytes: int = 32 << 20, pattern: str = "*.sql") -> DataFrame:
    """Statements of the files of a name at or below path, each with its file: path, statement."""
    files = _files(spark, path, pattern)
    ranges = files.withColumn("at", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {range_bytes}L)"))).withColumn("end", F.least(F.col("at") + range_bytes, "size"))
    n = max(1, ranges.count())

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = opened(r["path"])
                with store.open_input_file(name) as f:
                    part = _Range(f, r["at"], r["end"], r["size"])
                    ends = list(STATES)
                    for piece in part.pieces(part.start, part.end):
                        after = {s: scan(piece, s)[0] for s in set(ends)}
                        ends = [after[s] for s in ends]
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "size": r["size"], "at": r["at"], "ends": [STATES.index(s) for s in ends]}], pa.schema([("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("ends", pa.list_(pa.int32()))]))

    def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, name = opened(r["path"])
                with store.open_input_file(name) as f:
                    for s in _statements(_Range(f, r["at"], min(r["size"], r["at"] + range_bytes), r["size"]), STATES[r["state"]]):
                        yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"]]), "statement": pa.array([s.decode("utf-8", "replace")])})

    ended = ranges.repartition(n).mapInArrow(states, "path string, size long, at long, ends array<int>")
    chained = scratch(spark, "ranges")
    ended.groupBy("path").applyInArrow(_chain, "path string, size long, at long, state int").write.parquet(chained)
    return spark.read.parquet(chained).repartition(n).mapInArrow(statements, "path string, statement string")


def _rows(statements: DataFrame, table: str, columns: list[str], *keep: str) -> DataFrame:
    """Rows of a table's INSERT statements."""
    wanted = table.lower().encode()

    @F.arrow_udf("array<array<string>>")
    def tuples(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for s in b.to_pylist():
                m = _INSERT.match(s.encode())
                if not m or m["table"].lower() != wanted:
                    out.append([])
                    continue
                rows = sql_tuples(s)
                if m["columns"]:  # the statement's own order
                    own = [c.strip(' `"\n\t').lower() for c in m["columns"].decode().split(",")]
                    place = [own.index(c.lower()) if c.lower() in own else -1 for c in columns]
                    rows = ([r[i] if 0 <= i < len(r) else None for i in place] for r in rows)
                out.append(list(rows))
            yield pa.array(out, pa.list_(pa.list_(pa.string())))

    found = statements.where(F.col("statement").rlike(rf"(?i)\b{re.escape(table)}\b")).select(*keep, F.explode(tuples(F.col("statement"))).alias("t"))
    return found.select(*keep, *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_sql_dump(spark: SparkSession, path: str, table: str, columns: list[str], range_bytes: int = 32 << 20) -> DataFrame:
    """Rows of a table of the dumps at path, as strings."""
    return _rows(read_statements(spark, path, range_bytes), table, columns)


def read_sql_dumps(spark: SparkSession, base: str, table: str, columns: list[str], langs: list[str] | None = None, range_bytes: int = 32 << 20, pattern: str = "*.sql") -> DataFrame:
    """The same table of every language: base has a folder for each, whose name (or what follows `lang=`) is the language; its schema is `<language>wiki`."""
    statements = read_statements(spark, base, range_bytes, pattern).withColumn("lang", F.regexp_extract("path", r"/(?:lang=)?([^/]+)/[^/]+$", 1))
    if langs is not None:
        statements = statements.where(F.col("lang").isin(langs))
    return _rows(statements.withColumn("schema", F.concat("lang", F.lit("wiki"))), table, columns, "schema", "lang")


def write_sql_dumps(rows: DataFrame, path: str, table: str, lang_col: str, columns: list[str], rows_a_statement: int = 50) -> None:
    """Rows as INSERT statements in a folder for each language. Values keep their line ends, so only a reader that knows quotes reads them."""
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")), F.lit("NULL"))
    one = rows.select(F.col(lang_col).alias("lang"), F.concat(F.lit("("), F.concat_ws(",", *[quoted(c) for c in columns]), F.lit(")")).alias("value"))
    block = F.floor(F.monotonically_increasing_id() / rows_a_statement)
    made = one.withColumn("block", block).groupBy("lang", "block").agg(F.concat_ws(",", F.collect_list("value")).alias("values"))
    made.select("lang", F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), "values", F.lit(";")).alias("value")).write.mode("append").partitionBy("lang").text(path)
