"""Names of files as results show them: the path below the folder that was read, so two files of one name stay apart."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def roots_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The given paths with scheme and authority, as the readers report them."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out.append(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/"))
    return sorted(out, key=len, reverse=True)


def label(path: Column, roots: list[str]) -> Column:
    """What follows the longest given folder in a file's path; the file's name if it lies in none of them."""
    plain = F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
    found = F.element_at(F.split(path, "/"), -1)
    for root in reversed(roots):
        start = F.regexp_replace(F.lit(root), "^([a-z0-9]+):/+", "$1:/")
        found = F.when(F.startswith(plain, F.concat(start, F.lit("/"))), F.substring(plain, F.length(start) + 2, F.length(plain))).otherwise(found)
    return found


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)
