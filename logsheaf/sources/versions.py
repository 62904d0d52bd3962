"""Tables whose parts are replaced in one step, by pointers to written versions.

A table holds parts (a day, a chunk), each in a folder below that of the run
that wrote it: ``<path>/v=<version>/<part>``. The newest pointer at
``<path>/_pointers`` names the version of every present part. Readers follow it, so that
a run changes nothing until its pointer stands, and then everything it
wrote, replaced or removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import SparkSession

from logsheaf.session import delete, file_system

POINTERS = "_pointers"
UNVERSIONED = ""


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders at ``path``; none if there is no such folder."""
    files, target = file_system(spark, path)
    if not files.exists(target):
        return []
    # All paths come in one call, as {path,path}: a folder may hold very many.
    paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files.listStatus(target))
    text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)
    folder = f"{files.makeQualified(target).toString()}/"
    return sorted(name.removesuffix(",") for name in text[1:-1].split(folder)[1:])


def new_version() -> str:
    return f"r{uuid.uuid4().hex}"


def folder(path: str, version: str) -> str:
    return path if version == UNVERSIONED else f"{path}/v={version}"


def _pointers(spark: SparkSession, path: str) -> list[str]:
    return [name for name in listed(spark, f"{path}/{POINTERS}") if name.endswith(".json")]


def _parts_at(spark: SparkSession, path: str, pointer: str) -> dict[str, str]:
    file = f"{path}/{POINTERS}/{pointer}"
    return json.loads(spark.read.option("wholetext", "true").text(file).first()[0])


def parts(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Version by part, as the newest pointer has it; None where there is no pointer."""
    names = _pointers(spark, path)
    return _parts_at(spark, path, names[-1]) if names else None


def commit(spark: SparkSession, path: str, present: Mapping[str, str]) -> None:
    """Makes ``present`` the parts of the table, and removes versions that are out of use.

    The pointer is written aside and then renamed. What the pointer before
    names is kept, for readers that still follow it; older versions go.
    """
    names = _pointers(spark, path)
    number = int(names[-1].split(".")[0]) + 1 if names else 0
    aside, place = (f"{path}/{POINTERS}/{name}" for name in (f"_{uuid.uuid4().hex}", f"{number:010}.json"))
    files, target = file_system(spark, aside)
    stream = files.create(target)
    stream.write(bytearray(json.dumps(dict(present), sort_keys=True).encode()))
    stream.close()
    _, final = file_system(spark, place)
    if files.exists(final) or not files.rename(target, final):
        delete(spark, aside)
        raise RuntimeError(f"another run has changed {path}")
    kept = set(present.values())
    if names:
        kept |= set(_parts_at(spark, path, names[-1]).values())
    for old in names[:-1]:
        delete(spark, f"{path}/{POINTERS}/{old}")
    _remove_others(spark, path, kept)


def _remove_others(spark: SparkSession, path: str, kept: Collection[str]) -> None:
    for name in listed(spark, path):
        if name.startswith("v=") and name[2:] not in kept:
            delete(spark, f"{path}/{name}")
