"""Queries by name, and the SQL that each can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Fixed value: white space as Python's strip takes it.
BLANK = " \t\n\r\x0b\x0c" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def whole_trim(sql: str, name: str) -> str:
    """SQL in which trim(x) takes off all white space: the engines' own differ in what they take. name is the function with a list of characters."""
    out, i, open_, quote = [], 0, [], ""
    while i < len(sql):
        c = sql[i]
        if quote:
            if c == "\\" and name == "btrim" and not quote.startswith("r"):
                out.append(sql[i : i + 2])
                i += 2
                continue
            if c == quote[-1]:
                quote = ""
        elif c in "'\"":
            quote = ("r" if i and sql[i - 1] == "r" and not (i > 1 and (sql[i - 2].isalnum() or sql[i - 2] == "_")) else "") + c
        elif sql.startswith("trim(", i) and not (i and (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            out.append(f"{name}(")
            open_.append(True)
            i += 5
            continue
        elif c == "(":
            open_.append(False)
        elif c == ")" and open_ and open_.pop():
            out.append(f", '{BLANK}'")
        out.append(c)
        i += 1
    return "".join(out)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL of the same result if there is one."""

    def wrap(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = whole_trim(sql, "trim")
        return f

    return wrap
