"""Declarative checks: a rule is a condition on a row and the issue that it raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (severity, code, message, field, condition)
Rule = tuple[str, str, str, str, Column]
ISSUES = "array<struct<severity:string,code:string,message:string,field:string>>"


def issues(rules: Sequence[Rule]) -> Column:
    """The issues of a row in rule order; a condition that is null raises none."""
    each = [
        F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(field).alias("field")))
        for severity, code, message, field, when in rules
    ]
    return F.filter(F.array(*each), lambda i: i.isNotNull()) if each else F.expr(f"cast(array() as {ISSUES})")


def in_range(field: str, column: Column, *, least: float | None = None, most: float | None = None, positive: bool = False, warn_above: float | None = None) -> list[Rule]:
    """Rules for one number: critical outside its range, a warning above what is usual."""
    out: list[Rule] = []
    if positive:
        out.append(("critical", f"{field}_not_positive", f"{field} must be positive", field, column <= 0))
    if least is not None:
        out.append(("critical", f"{field}_too_low", f"{field} is below {least:g}", field, column < least))
    if most is not None:
        out.append(("critical", f"{field}_too_high", f"{field} is above {most:g}", field, column > most))
    if warn_above is not None:
        out.append(("warning", f"{field}_unusual", f"{field} is unusually large", field, (column > warn_above) & (column <= (most if most is not None else float("inf")))))
    return out


def has_severity(found: Column, severity: str) -> Column:
    return F.exists(found, lambda i: i["severity"] == severity)


def summary(found: Column) -> Column:
    """Like "2 critical, 1 warning", or "ok"."""

    def part(severity: str) -> Column:
        n = F.size(F.filter(found, lambda i: i["severity"] == severity))
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {severity}")))

    parts = [part(s) for s in ("critical", "warning", "info")]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("ok"))


def user_message(found: Column, head: str, most: int = 3) -> Column:
    """The first critical messages below a head; null without any."""
    critical = F.transform(F.slice(F.filter(found, lambda i: i["severity"] == "critical"), 1, most), lambda i: F.concat(F.lit("- "), i["message"]))
    return F.when(F.size(critical) > 0, F.concat_ws("\n", F.lit(head), F.array_join(critical, "\n")))


def issue_rows(rows: DataFrame, key: str, found: str = "issues") -> DataFrame:
    return rows.select(key, F.explode(found).alias("issue")).select(key, "issue.*")


def issue_counts(rows: DataFrame, found: str = "issues") -> DataFrame:
    return rows.select(F.explode(found).alias("issue")).groupBy("issue.severity", "issue.code").agg(F.count("*").alias("n"))
