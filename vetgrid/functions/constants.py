"""Python values as constants of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: object, ddl: str) -> Column:
    """Nested lists and dicts as one literal of type ``ddl``.

    The text is parsed on the JVM in one call and folded by the optimizer; building a table of
    some hundred values from single literals would take seconds.
    """
    return F.expr(f"CAST({_sql(value)} AS {ddl})")


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        # ``${name}`` in the text would be taken for a variable of the session.
        quoted = quoted.replace("$", "\\u0024")
        return f"'{quoted}'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(
            f"{_sql(k)}, {_sql(v)}" for k, v in value.items()) + ")"
    return "array(" + ", ".join(_sql(v) for v in value) + ")"
