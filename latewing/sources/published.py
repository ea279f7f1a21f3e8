"""Published runs: whole or not at all, repeatable, visible by one pointer file.

    <root>/data/<output>/<key>=<run>/_version=<id>/   what a run wrote, never changed
    <root>/runs/<run>.json                           which version of a run counts

All outputs of a run are written under a version of their own. Then the run's pointer is
replaced by one rename, which is atomic; readers go through the pointers. A driver lost
before the rename leaves every reader with the run as it was, one lost after it with the
new run, and nothing that a reader may be reading is deleted. ``sweep`` removes versions
that no pointer names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from .sinks import export_csv


@dataclass(frozen=True)
class Export:
    """An output that is written as CSV part files which follow each other by ``order``; those columns are left out."""

    frame: DataFrame
    order: Sequence[str]


@dataclass(frozen=True)
class Divided:
    """Outputs that are parts of one frame, written in one pass over it.

    ``place`` names the output that a row goes to; ``outputs`` has the columns of each. The files hold
    the other outputs' columns too, but readers get the named ones.
    """

    frame: DataFrame
    place: Column
    outputs: dict[str, Sequence[str]]


class _Files:
    """Hadoop's view of the store that ``root`` lies in."""

    def __init__(self, spark: SparkSession, root: str):
        hadoop, settings = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
        self.path, self.options = hadoop.fs.Path, hadoop.fs.Options.Rename
        self.store = self.path(root).getFileSystem(settings)
        self.context = hadoop.fs.FileContext.getFileContext(self.store.makeQualified(self.path(root)).toUri(), settings)
        self._one = spark._sc._gateway.new_array(self.options, 1)
        self._one[0] = self.options.OVERWRITE

    def replace(self, name: str, content: str) -> None:
        """The file ``name`` has the new content or, whatever fails, the old one."""
        folder, _, last = name.rpartition("/")
        aside = self.path(f"{folder}/_{last}.{uuid.uuid4().hex}")
        out = self.store.create(aside, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        self.rename(aside, self.path(name))

    def rename(self, old, new) -> None:
        self.context.rename(self.store.makeQualified(old), self.store.makeQualified(new), self._one)

    def moved(self, old: str, new: str) -> None:
        """The folder ``old`` under the name ``new``; an empty folder where there is none."""
        source, target = self.path(old), self.path(new)
        self.store.mkdirs(target.getParent() if self.store.exists(source) else target)
        if self.store.exists(source):
            self.rename(source, target)

    def delete(self, name: str) -> None:
        self.store.delete(self.path(name), True)

    def listed(self, pattern: str) -> list:
        return list(self.store.globStatus(self.path(pattern)) or [])


#: Where ``Divided`` outputs are before they go to their own folders, and the column that divides them.
_WHOLE, _PLACE = "_whole", "__place"


def _pointers(spark: SparkSession, root: str) -> list[dict]:
    """One small file for each run."""
    if not _Files(spark, root).listed(f"{root}/runs/*.json"):
        return []
    rows = spark.read.option("wholetext", True).text(f"{root}/runs/*.json").collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda p: (p["published_at"], p["run"]))


def publish(
    root: str,
    outputs: dict[str, DataFrame | Export] | Divided,
    run: str,
    key: str = "run_id",
    check: Callable[[], dict | None] | None = None,
) -> dict:
    """Store the outputs of one run and make them visible together; an earlier try is replaced.

    ``check`` is called when everything is written and may still refuse by raising; what it
    returns is kept with the run. An input column named like the run's column is refused. Returns the run's record.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"A run's name is letters, digits, '_', '.' and '-', not {run!r}.")
    divided = outputs if isinstance(outputs, Divided) else None
    if divided:
        outputs = {name: divided.frame.select(*(f"`{c}`" for c in columns)) for name, columns in divided.outputs.items()}
    frames = {name: o.frame if isinstance(o, Export) else o for name, o in outputs.items()}
    for df in frames.values():
        if clash := {key.lower(), "_version"} & {c.lower() for c in df.columns}:
            raise ValueError(f"The input has a column {min(clash)!r}; rename it before publishing.")
    spark = next(iter(frames.values())).sparkSession
    files, version, stored, record = _Files(spark, root), uuid.uuid4().hex, {}, None
    whole = f"{root}/data/{_WHOLE}/{key}={run}/_version={version}"
    try:
        if divided:
            divided.frame.withColumn(_PLACE, divided.place).write.partitionBy(_PLACE).parquet(whole)
        for name, output in outputs.items():
            folder = f"{root}/data/{name}/{key}={run}/_version={version}"
            stored[name] = {"path": folder[len(root) + 1 :], "schema": frames[name].schema.jsonValue()}
            if isinstance(output, Export):
                export_csv(output.frame, folder, order=output.order)
            else:
                files.moved(f"{whole}/{_PLACE}={name}", folder) if divided else output.write.parquet(folder)
                stored[name]["rows"] = spark.read.schema(output.schema).parquet(folder).count()
        if divided:
            if left := files.listed(f"{whole}/{_PLACE}=*"):
                raise ValueError(f"Rows have no output: {left[0].getPath().getName()}.")
            files.delete(whole)
        facts = check() if check else None
        record = {
            "run": run, "key": key, "version": version, "outputs": stored, "facts": facts or {},
            "published_at": datetime.now(timezone.utc).isoformat(),
        }
        files.replace(f"{root}/runs/{run}.json", json.dumps(record))
    except BaseException:
        # Whoever stops here without cleaning up leaves files that no pointer names.
        if version not in (p["version"] for p in _pointers(spark, root)):
            for output in stored.values():
                files.delete(f"{root}/{output['path']}")
            if divided:
                files.delete(whole)
        raise
    return record


def published(spark: SparkSession, root: str, output: str) -> DataFrame:
    """Rows of an output in all runs that count, with the run's column; the newest run gives the schema."""
    found = [p for p in _pointers(spark, root) if output in p["outputs"]]
    if not found:
        raise FileNotFoundError(f"No run under {root} has an output {output!r}.")
    schema = T.StructType.fromJson(found[-1]["outputs"][output]["schema"])
    whole = T.StructType([*schema.fields, T.StructField(found[-1]["key"], T.StringType()), T.StructField("_version", T.StringType())])
    paths = [f"{root}/{p['outputs'][output]['path']}" for p in found]
    return spark.read.schema(whole).option("basePath", f"{root}/data/{output}").parquet(*paths).drop("_version")


def published_folder(spark: SparkSession, root: str, output: str, run: str) -> str:
    """Where the files of one run's output lie, for an ``Export``."""
    found = {p["run"]: p for p in _pointers(spark, root)}
    return f"{root}/{found[run]['outputs'][output]['path']}"


def run_records(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run and output: when it was published, its rows, and the run's facts."""
    rows = [
        (p["run"], p["published_at"], name, o.get("rows"), {k: str(v) for k, v in p["facts"].items()})
        for p in _pointers(spark, root)
        for name, o in p["outputs"].items()
    ]
    return spark.createDataFrame(rows, "run string, published_at string, output string, rows bigint, facts map<string,string>")


def sweep(spark: SparkSession, root: str, older_than: timedelta = timedelta(days=1)) -> int:
    """Delete versions that no pointer names and that are older than any running job; returns their number."""
    files = _Files(spark, root)
    used = {p["version"] for p in _pointers(spark, root)}
    limit = (datetime.now(timezone.utc) - older_than).timestamp() * 1000
    gone = [
        s.getPath().toString() for s in files.listed(f"{root}/data/*/*/_version=*")
        if s.getPath().getName().partition("=")[2] not in used and s.getModificationTime() <= limit
    ]
    for path in gone:
        files.delete(path)
    return len(gone)

