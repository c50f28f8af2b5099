"""Folders of a window of time, found level by level: what lies outside the window is never listed."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Names of the folders of a year, a month, ...; the last of them names the smallest span that is told apart.
DAYS = (r"(\d{4})", r"(\d{2})", r"(\d{2})")
HOURS = (r"y=(\d+)", r"m=(\d+)", r"d=(\d+)", r"h=(\d+)")


def _span(parts: list[int]) -> tuple[dt.datetime, dt.datetime] | None:
    """[from, to) of a year, month, day or hour; None if there is none such."""
    try:
        first = dt.datetime(*[*parts, 1, 1][: max(3, len(parts))], tzinfo=dt.UTC)
        if len(parts) == 1:
            return first, first.replace(year=first.year + 1)
        if len(parts) == 2:
            return first, (first + dt.timedelta(days=32)).replace(day=1)
    except ValueError:
        return None
    return first, first + (dt.timedelta(days=1) if len(parts) == 3 else dt.timedelta(hours=1))


def _entries(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(address, name, whether it is a folder) of what lies in a folder, hidden entries left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    made = ((f.getPath().toString(), f.getPath().getName(), f.isDirectory()) for f in found)
    return [x for x in made if x[1][0] not in "_."]


def _walk(spark: SparkSession, path: str, parts: list[int], layout: tuple[str, ...], first, last) -> Iterator[str]:
    for address, name, folder in _entries(spark, path):
        if not folder:
            yield address
            continue
        # the next level of a date, or the start of one, or neither
        for known in (parts, []) if parts else ([],):
            m = re.fullmatch(layout[len(known)], name)
            now = [*known, int(m[1])] if m else []
            if m and _span(now):
                break
        else:
            now = []
        span = _span(now) if now else None
        if span and ((first and span[1] <= first) or (last and span[0] >= last)):
            continue
        if len(now) == len(layout):
            yield address
        else:
            yield from _walk(spark, address, now, layout, first, last)


def paths(spark: SparkSession, root: str, layout: tuple[str, ...], first: dt.datetime | None, last: dt.datetime | None) -> list[str]:
    """What is to be read of root for [first, last): folders of dates in the window, and single files outside of dated folders.

    Without a window that is root itself. Only folders on the way to dates are listed here, those found are listed by Spark's
    tasks. Folders whose names are no date of the calendar count as undated, but all that lies in the folder of a year or month
    outside the window goes with it. Addresses are escaped for Spark's readers.
    """
    if first is None and last is None:
        return [root]
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in _walk(spark, root, [], layout, first, last)]


def texts(spark: SparkSession, found: list[str], **options) -> DataFrame:
    """The lines (or whole texts) of found, with folders in folders; no rows if nothing was found."""
    reader = spark.read.option("recursiveFileLookup", True).options(**options)
    # recursive lookup of no path at all is an error, so an empty table with the same hidden columns stands for it
    return reader.text(found) if found else reader.schema("value string").text([])


def counted(lines: DataFrame, reasons: tuple[str, ...], skipped: Observation | None) -> DataFrame:
    """lines without those that have a reason; how many there were, and how many for each reason, goes to skipped.

    The counts are made on the way, by the first job that reads the result.
    """
    if skipped is not None:
        lines = lines.observe(skipped, F.count("*").alias("lines"), *(F.count_if(F.col("reason") == r).alias(r) for r in reasons))
    return lines.where("reason is null").drop("reason")


def reason(*cases: tuple[str, Column]) -> Column:
    """The first of cases (reason, condition) that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out.alias("reason")
