"""Results as text: one column per kind of listing, by format functions of the JVM.

Fixed values: the layouts of these texts, which readers of them rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _receiver(pattern: str) -> Column:
    return F.when(F.col("recv") != "", F.format_string(pattern, "recv")).otherwise("")


def list_line() -> Column:
    """``[method   ] Recv.Name<tab>file:line``"""
    return F.format_string("[%-9s] %s%s\t%s:%d", "kind", _receiver("%s."), "name", "file", "line")


def search_line() -> Column:
    """``[method   ] Recv.Name  file:line`` and the signature below."""
    head = F.format_string("[%-9s] %s%s  %s:%d\n", "kind", _receiver("%s."), "name", "file", "line")
    return F.concat(head, F.when(F.col("sig") != "", F.format_string("             sig: %s\n", "sig")).otherwise(""))


def symbol_text() -> Column:
    """A definition over several lines, with the signature where there is one."""
    head = F.format_string("[%s] %s%s\n  file: %s:%d\n  pkg:  %s\n", "kind", _receiver("(%s) "), "name", "file", "line", "pkg")
    return F.concat(head, F.when(F.col("sig") != "", F.format_string("  sig:  %s\n", "sig")).otherwise(""))


def usage_line() -> Column:
    return F.concat(F.format_string("  %s:%d", "file", "line"), F.when(F.col("in_symbol") != "", F.concat(F.lit("  ← "), "in_symbol")).otherwise(""))


def call_line() -> Column:
    return F.format_string("  %s()  at %s:%d", "sym", "file", "line")
