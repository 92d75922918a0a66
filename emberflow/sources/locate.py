"""Which report files a locator names, in any store that Spark's file systems open."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Last name parts that mark a file beside a report as something else.
SIDECARS = ("callgraph", "hierarchy", "calibrated", "layerreach", "locs", "gate")


class NotFound(ValueError):
    """A locator that names no report."""


def is_sidecar(name: str) -> bool:
    """A file that lies beside reports but isn't one: its last part before .json is reserved."""
    if ".encountered-" in name:
        return True
    stem = name.removesuffix(".json")
    return stem != name and "." in stem and stem.rsplit(".", 1)[1] in SIDECARS


def sidecar(report: str, kind: str) -> str:
    """The path of a report's sidecar."""
    return f"{report.removesuffix('.json')}.{kind}.json"


#: A file system's name and the slashes after it, of which Spark and Hadoop write different numbers.
_ROOT = "^([A-Za-z][A-Za-z0-9+.-]*):/+"


def decoded(file: Column) -> Column:
    """The path of a file from Spark's _metadata.file_path, in which signs like spaces are written as %20; a plus stands for
    itself there."""
    return F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), _ROOT, "$1:/")


class Store:
    """Listing and testing of paths."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def full(self, path: str) -> str:
        """The whole path with its file system, as `decoded` gives that of a file that was read."""
        p, fs = self._at(path)
        return re.sub(_ROOT, r"\1:/", fs.makeQualified(p).toString())

    def is_dir(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def is_file(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and not fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if self.is_dir(path) else []


def _prefix(store: Store, locator: str, home: str) -> str:
    return f"{locator.rstrip('/')}/{home}/report" if store.is_dir(locator) else locator


def reports(spark: SparkSession, locator: str, home: str = ".reports", shape: str | None = None) -> list[str]:
    """All report files that a locator names, in order: a path in .json stands for itself; a folder for the prefix
    <home>/report below it; a prefix for every <prefix>.*.json beside it and <prefix>.json, sidecars left out.

    shape, if given, keeps files whose names end in it (and <prefix>.json): one producer's own reports.
    """
    if locator.endswith(".json"):
        return [locator]
    store = Store(spark)
    prefix = _prefix(store, locator, home)
    folder, base = os.path.split(prefix)
    names = {n for n in store.names(folder or ".") if n.startswith(base + ".") and n.endswith(".json") and not is_sidecar(n)}
    if shape is not None:
        names = {n for n in names if n.endswith(shape) or n == base + ".json"}
    return sorted(os.path.join(folder, n) for n in names)


def report(spark: SparkSession, locator: str, home: str = ".reports") -> str:
    """The one report of a locator, the first by name of several; NotFound without any."""
    found = reports(spark, locator, home)
    if not found:
        raise NotFound(f"no report for {locator!r}")
    return found[0]


def pair(spark: SparkSession, now: str, base: str, home: str = ".reports") -> tuple[str, str]:
    """The reports of two locators, for verbs that compare."""
    return report(spark, now, home), report(spark, base, home)


def discover(spark: SparkSession, folder: str, home: str = ".reports", given: str | None = None) -> str | None:
    """The locator to use where none is given: `given` if it says one, else the prefix in the nearest <home> folder at or
    above `folder`; None without one."""
    if given:
        return given
    store, at = Store(spark), os.path.abspath(folder) if "://" not in folder else folder.rstrip("/")
    while True:
        if store.is_dir(f"{at}/{home}"):
            return f"{at}/{home}/report"
        up = os.path.dirname(at)
        if up == at or up.endswith(":/"):
            return None
        at = up
