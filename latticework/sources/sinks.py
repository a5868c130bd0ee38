"""Writers: ordered CSV, atomic replacement, slices by partition, versions, JSON."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(conf), p


def write_csv(df: DataFrame, path: str, order: Sequence[Column] = (), columns: Sequence[str] | None = None) -> None:
    """CSV with a header, blanks for nulls, quotes doubled inside quotes, the listed columns, globally ordered over its part files."""
    out = df.select(*columns) if columns else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def replace_atomically(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the target, move the old table aside, move the new one in, then delete the old. df may read the target.

    Nothing is deleted before the new table is in place: after a crash between the moves the old table lies at
    `<path>__old_...`, and a failed move is undone.
    """
    mark = uuid.uuid4().hex
    staged, aside = f"{path.rstrip('/')}__staged_{mark}", f"{path.rstrip('/')}__old_{mark}"
    df.write.format(fmt).save(staged)
    jvm, fs, target = _fs(df, path)
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, aside))
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move {staged} to {path}")
    if had:
        fs.delete(old, True)


def replace_slices(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that df has rows of, and no others: repeating a run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int, apply: bool = True) -> str:
    """Keep earlier versions: <root>/v=<version>. Without apply nothing is written, the path is returned all the same."""
    path = f"{root.rstrip('/')}/v={version}"
    if apply:
        df.write.mode("errorifexists").parquet(path)
    return path


#: Name of the file that says which version of a table is the current one.
POINTER = "current"


def publish(df: DataFrame, root: str) -> str:
    """Write df as a new version under root and make it the current one; returns its folder. df may read the current one.

    Versions lie beside each other as <root>/v=<mark>. What is current stands in one small file, which is written aside
    and put in place by a single rename over the old one: a reader at any moment finds the old version whole or the new
    one whole. Earlier versions stay until `prune`; a run that ends early leaves the pointer as it was. The rename is the
    file system's own (HDFS replaces in one step), and for local and mounted folders the operating system's.
    """
    path = f"{root.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.parquet(path)
    name = path.rsplit("/", 1)[-1]
    jvm, fs, staged = _fs(df, f"{path}__pointer")
    target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{POINTER}")
    if fs.getScheme() == "file":  # Hadoop's local rename deletes first, and moves checksums apart from their file
        aside = staged.toUri().getPath()
        with open(aside, "w") as f:
            f.write(name)
        os.replace(aside, target.toUri().getPath())
        return path
    out = fs.create(staged)
    out.write(name.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    options = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(target), options)
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(f"{root.rstrip('/')}/{_current_name(spark, root)}")


def _current_name(spark: SparkSession, root: str) -> str:
    """The pointer's text; it is one line, read in the driver."""
    jvm, fs, path = _fs(spark.range(0), f"{root.rstrip('/')}/{POINTER}")
    if fs.getScheme() == "file":
        with open(path.toUri().getPath()) as f:
            return f.read()
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def prune(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete all but the `keep` newest versions and the current one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs, now = path.getFileSystem(conf), _current_name(spark, root)
    found = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and s.isDirectory()), key=lambda x: x[0])
    for _, old in found[: max(0, len(found) - keep)]:
        if old.getName() != now:
            fs.delete(old, True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df if it has `most` rows at most; else an error, so that nothing is gathered or cut in silence."""
    if len(df.select(F.lit(1)).limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} rows")
    return df


def json_array(df: DataFrame, order: Sequence[Column] = (), most: int = 100_000) -> str:
    """A result of `most` rows at most as one JSON array in order, nulls kept."""
    rows = bounded(df, most)
    made = (rows.orderBy(*order) if order else rows).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()
    return "[" + ",".join(r[0] for r in made) + "]"


def script_text(df: DataFrame, name: str, most: int = 100_000) -> str:
    """A result of `most` rows at most as a script that assigns it to window.<name>."""
    df = bounded(df, most)
    body = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)))).first()[0]
    return f"window.{name} = {body};\n"


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report of `most` rows at most as a Markdown table; more rows raise."""
    rows = bounded(df, most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def replace_assignment(source: str, name: str, body: str) -> str:
    """A script with the value assigned to a name replaced, up to the first semicolon outside quotes; an error unless the
    name is assigned exactly once."""
    import re

    value = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[^;"'`])*"""
    found = re.compile(rf"(\b{re.escape(name)}\s*=(?!=)\s*)({value})(;)", re.S)
    if len(found.findall(source)) != 1:
        raise ValueError(f"{name} is not assigned exactly once")
    return found.sub(lambda m: m[1] + body + m[3], source)
