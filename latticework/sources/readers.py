"""Readers of landed files: CSV with text cells, JSON of several shapes, tables embedded in scripts, paged payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, every cell text, empty cells null, short rows padded with null, a byte-order mark dropped.

    `columns` (in file order) spares the pass over the file that finds them.
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    df = r.schema(text_schema(columns)).csv(path) if columns else r.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def json_records(spark: SparkSession, path: str, schema: T.StructType | str, wrappers: Sequence[str] = ("rows", "data", "results")) -> DataFrame:
    """Records of JSON files (path or glob) that hold a list, or an object with the list under one of the wrappers."""
    text = spark.read.option("wholetext", True).text(path)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    row = f"array<{kind if kind.startswith('struct<') else f'struct<{kind}>'}>"
    found = [F.from_json("value", row)] + [F.from_json(F.get_json_object("value", f"$.{w}"), row) for w in wrappers]
    is_list = F.ltrim("value").startswith("[")
    records = F.when(is_list, found[0]).otherwise(F.coalesce(*found[1:]))
    return text.select(F.explode(records).alias("r")).select("r.*")


def embedded_json(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> DataFrame:
    """Records of a JSON array assigned to a name in a script, plain or parsed from a template literal."""
    text = spark.read.option("wholetext", True).text(path)
    body = F.regexp_extract("value", rf"(?s)\b{re.escape(name)}\s*=\s*(?:JSON\.parse\()?\s*[`'\"]?\s*(\[.*?\])\s*[`'\"]?\s*\)?\s*;", 1)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    row = f"array<{kind if kind.startswith('struct<') else f'struct<{kind}>'}>"
    return text.select(F.explode(F.from_json(body, row)).alias("r")).select("r.*")


def unique_names(headers: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """Lower-case names of letters, digits and single underscores; a clash gets _2, _3 and so on."""
    used, out = set(taken), []
    for h in headers:
        base = re.sub(r"[^a-z0-9]+", "_", (h or "").lower()).strip("_") or "col"
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def header_row(rows: DataFrame, cells: str, index: str, must: str = "ipeds", scan: int = 10) -> int | None:
    """Index of the first of the leading rows with a cell containing `must` and a cell that is a four-digit year."""
    low = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))))
    fits = F.exists(low, lambda c: c.contains(must)) & F.exists(low, lambda c: c.rlike("^(19|20)[0-9]{2}$"))
    return rows.where((F.col(index) < scan) & fits).agg(F.min(index)).first()[0]


def header_columns(cells: Sequence[str | None]) -> dict:
    """Positions of the name, id and year columns of a header."""
    low = [(c or "").strip().lower() for c in cells]
    years = {int(c): i for i, c in enumerate(low) if re.fullmatch(r"(19|20)\d\d", c)}
    ident = next((i for i, c in enumerate(low) if "ipeds" in c), None)
    name = next((i for i, c in enumerate(low) if i != ident and ("name" in c or "institution" in c or "school" in c or "university" in c)), 0)
    return {"name": name, "id": ident, "years": years}


def sheet_history(rows: DataFrame, cells: str, index: str, columns: dict, category: str) -> DataFrame:
    """id, name, year, rank, category: long form of a wide rank sheet below its header; tied ranks read as numbers."""
    from ..functions.clean import first_digits, leading_integer

    at = lambda i: F.try_element_at(F.col(cells), F.lit(i + 1)).cast("string")
    years = F.array(*[F.struct(F.lit(y).alias("year"), at(i).alias("rank")) for y, i in sorted(columns["years"].items())])
    out = rows.select(first_digits(at(columns["id"])).alias("id"), F.trim(at(columns["name"])).alias("name"), F.explode(years).alias("y"))
    out = out.select("id", "name", F.col("y.year").alias("year"), leading_integer(F.col("y.rank")).alias("rank"), F.lit(category).alias("category"))
    return out.where("id IS NOT NULL AND rank IS NOT NULL")


def file_id(path: Column | None = None) -> Column:
    """Leading digits of a file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1)
    return F.nullif(F.regexp_extract(name, "^([0-9]+)", 1), F.lit(""))


def with_manifest(files: DataFrame, manifest: DataFrame, path: str, key: str = "id") -> DataFrame:
    """files with their id, the leading digits of the name, and the manifest's columns for it; files that the manifest
    does not know stay, those without an id too."""
    known = manifest.withColumn(key, F.col(key).cast("string"))
    return files.withColumn(key, file_id(F.col(path))).join(known, key, "left")


def request_url(base: str, params: dict[str, object]) -> str:
    """Address with parameters in the given order; lists are joined by commas."""
    from urllib.parse import urlencode

    return f"{base}?{urlencode({k: ','.join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in params.items()}, safe=',')}"


def scope(df: DataFrame, ids: Sequence | None = None, years: Sequence[int] | None = None, covered: tuple[int, int] | None = None, entity: str = "unitid", year: str = "year", first: int | None = None) -> DataFrame:
    """Rows of a run: a subset of ids or the first ids in order, a subset of years, within the years a series covers."""
    if ids is not None:
        df = df.where(F.col(entity).isin(*ids))
    if first is not None:
        df = df.join(df.select(entity).where(F.col(entity).isNotNull()).distinct().orderBy(entity).limit(first), entity, "left_semi")
    if years is not None:
        df = df.where(F.col(year).isin(*years))
    return df.where(F.col(year).between(*covered)) if covered else df


class LandedPages:
    """Pages of a keyed interface that were landed as files: <folder>/<request>/<page>.json.

    read(request) follows numbered pages until metadata.total rows are seen, or `next` links; a missing first page
    is an empty answer. `fetch` may be any function from a path to text, so tests and object stores can supply theirs;
    transient failures are tried again.
    """

    def __init__(self, folder: str, fetch: Callable[[str], str | None], tries: int = 3):
        self.folder, self.fetch, self.tries = folder, fetch, tries

    def _get(self, path: str) -> dict | None:
        for left in range(self.tries - 1, -1, -1):
            try:
                text = self.fetch(path)
                return None if text is None else json.loads(text)
            except (OSError, ValueError):
                if not left:
                    raise
        return None

    def read(self, request: str) -> Iterator[dict]:
        page, seen, path = 0, 0, str(PurePosixPath(self.folder) / request / "0.json")
        while (body := self._get(path)) is not None:
            rows = body.get("results") or []
            yield from rows
            seen, page = seen + len(rows), page + 1
            if body.get("next"):
                path = str(PurePosixPath(self.folder) / request / body["next"])
            elif rows and seen < (body.get("metadata") or {}).get("total", 0):
                path = str(PurePosixPath(self.folder) / request / f"{page}.json")
            else:
                return


def keyed_facts(rows: DataFrame, payload: str, entity: str, year: int, fields: dict[str, str]) -> DataFrame:
    """entity, year, variable, value from flat objects with keys "<year>.<path>"; null, negative and non-numeric values out."""
    one = rows.withColumn("_m", F.from_json(payload, "map<string,string>"))
    items = F.array(*[F.struct(F.lit(v).alias("variable"), F.try_element_at("_m", F.lit(f"{year}.{p}")).alias("value")) for v, p in fields.items()])
    long = one.select(F.try_element_at("_m", F.lit(entity)).alias(entity), F.lit(year).alias("year"), F.explode(items).alias("i")).select(entity, "year", "i.*")
    value = F.when(F.col("value").rlike("^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("value").try_cast("double"))
    return long.withColumn("value", value).where("value >= 0")
