"""Sinks and provenance: prepared tables, immutable results, manifests, model bundles, packages.

Tables are written by Spark, whose commit protocol publishes a write whole or
not at all; small files on the driver are written aside and renamed.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import platform
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import require_sound
from .series import from_long, require_columns, with_row_number

MANIFEST = "manifest.json"
PREPARED = "sources.json"


def canonical(obj) -> bytes:
    """The same bytes for equal values; no NaN."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def digest(obj) -> str:
    return hashlib.sha256(canonical(obj)).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a cluster is an error; where all is one process, a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more, where they exist."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def write_json(path: str | Path, obj, indent: int | None = None) -> None:
    path = Path(path)
    data = json.dumps(obj, sort_keys=True, indent=indent, allow_nan=False).encode() + b"\n" if indent else canonical(obj)
    aside = path.with_name(path.name + ".partial")
    aside.write_bytes(data)
    os.replace(aside, path)


def file_digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def table_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """File name -> sha256 of a table's files, read where the table lies."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha")).collect()  # one row a file
    return {r["path"].rsplit("/", 1)[-1]: r["sha"] for r in rows}


def versions(spark: SparkSession) -> dict[str, str]:
    import numpy
    import pandas
    import pyarrow

    return {"python": platform.python_version(), "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "timezone": spark.conf.get("spark.sql.session.timeZone")}


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, by: str | None = None) -> None:
    """Parquet in zstd, never over an earlier result; with by, every key's rows in one file and in order."""
    if by:
        df = df.repartition(by)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV of a small aggregate."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_export(df: DataFrame, root: str, features: list[str], evaluator: list[str], keys: tuple[str, ...] = ("id", "t")) -> None:
    """What models may read and what only evaluation may, apart, from one computed frame."""
    df = df.persist()
    try:
        write_table(df.select(*keys, *features), f"{root}/raw", list(keys), keys[0])
        write_table(df.select(*keys, *evaluator), f"{root}/evaluator", list(keys), keys[0])
    finally:
        df.unpersist()


def prepare(spark: SparkSession, x_path: str, y_path: str, index_path: str, cache: str) -> DataFrame:
    """The long form of three parquet tables, checked, written once, clustered by series, and read back.

    The marker holds the sources' digests: other sources need another cache, and a
    cache without a marker is incomplete.
    """
    source = {n: table_digests(spark, p) for n, p in (("x", x_path), ("y", y_path), ("index", index_path))}
    marker, data = Path(cache) / PREPARED, f"{cache}/observations"
    if marker.exists():
        if json.loads(marker.read_text()) != source:
            raise ValueError("the sources changed; use another cache")
        return spark.read.parquet(data)
    if Path(data).exists():
        raise ValueError("incomplete cache; use another")
    x = with_row_number(spark, x_path)
    y, index = spark.read.parquet(y_path), spark.read.parquet(index_path)
    require_columns(x, {"id", "time", "value", "period"})
    require_columns(y, {"id", "time", "target"})
    require_columns(index, {"id", "tau_index", "tau"})
    require_sound(x, y, index)
    ids = index.select(F.col("id").cast("string").alias("id"))
    if ids.count() != ids.distinct().count():
        raise ValueError("ids collide as text")
    write_table(from_long(x, y, index), data, ["id", "k"], "id")
    write_json(marker, source)
    return spark.read.parquet(data)


def finalize(folder: str | Path) -> dict[str, str]:
    """Write the manifest of a folder's files, last."""
    folder = Path(folder)
    if (folder / MANIFEST).exists():
        raise ValueError("already final")
    files = {str(p.relative_to(folder)): file_digest(p) for p in sorted(folder.rglob("*")) if p.is_file()}
    write_json(folder / MANIFEST, {"files": files, "digest": digest(files)})
    return files


def verify(folder: str | Path) -> dict[str, str]:
    """The files of a final folder, if each still has its digest and none was added."""
    folder = Path(folder)
    m = json.loads((folder / MANIFEST).read_text())
    now = {str(p.relative_to(folder)): file_digest(p) for p in sorted(folder.rglob("*")) if p.is_file() and p.name != MANIFEST}
    if m["digest"] != digest(m["files"]) or now != m["files"]:
        raise ValueError("artifacts changed")
    return now


def freeze(path: str | Path, spec: dict, protected: tuple[str | Path, ...] = ()) -> str:
    """Write a specification (sources, configuration, folds) and the digests of the files it protects, once; the digest of both is the pin."""
    if Path(path).exists():
        raise ValueError("already frozen")
    held = {"spec": json.loads(canonical(spec)), "protected": {str(p): file_digest(p) for p in protected}}
    write_json(path, held)
    return digest(held)


def admit(path: str | Path, pin: str, spec: dict) -> dict:
    """The frozen specification, if it has this pin, says what spec says, and its protected files are as they were; else all that differs."""
    held = json.loads(Path(path).read_text())
    if digest(held) != pin:
        raise ValueError("the frozen specification is not the pinned one")
    asked = json.loads(canonical(spec))
    wrong = sorted(k for k in asked.keys() | held["spec"].keys() if k not in asked or k not in held["spec"] or asked[k] != held["spec"][k])
    wrong += [p for p, d in sorted(held["protected"].items()) if not Path(p).is_file() or file_digest(p) != d]
    if wrong:
        raise ValueError("not admitted: " + ", ".join(wrong))
    return held["spec"]


def write_bundle(folder: str | Path, model: bytes, note: dict) -> None:
    """A model and what it was made from; the manifest comes last and makes it valid."""
    folder = Path(folder)
    folder.mkdir(parents=True)
    (folder / "model.json").write_bytes(model)
    write_json(folder / "note.json", note)
    finalize(folder)


def read_bundle(folder: str | Path) -> bytes:
    verify(folder)
    return (Path(folder) / "model.json").read_bytes()


def package(folder: str | Path, out: str | Path, allow: tuple[str, ...]) -> None:
    """A zip of the allowed files that is the same for the same contents."""
    folder = Path(folder)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(allow):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, (folder / name).read_bytes())


def report(path: str | Path, title: str, tables: dict[str, DataFrame], most: int = 200) -> None:
    """A Markdown report of small result tables; a longer one shows its first rows and says how many it has."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            rows = rows[:most]
            name = f"{name} (the first {most} of {df.count()} rows)"
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    Path(path).write_text("\n".join(out) + "\n")
