"""Chains of regular-expression replacements, as Spark columns and as SQL for a check.

Patterns keep to what Java and RE2 both read alike; {1} in a replacement stands for a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]


def apply(text: Column, rules: Rules) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].replace("\\", "\\\\").replace("$", "\\$").replace("{1}", "$1").replace("{2}", "$2")), rules, text)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def apply_sql(text: str, rules: Rules) -> str:
    return reduce(lambda c, r: f"regexp_replace({c}, {quoted(r[0])}, {quoted(r[1].replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')", rules, text)
