"""Sinks: tables, spreadsheets, map layers, pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import part_label, parts


def csv_columns(rows: DataFrame, arrays: list[str], maps: list[str], positions: tuple[str, ...] = ("lat", "lng")) -> DataFrame:
    """Arrays joined by semicolons, maps as key:value, positions with seven decimals."""
    out = {c: F.array_join(c, ";") for c in arrays}
    out |= {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"].cast("string"), F.lit("")))), ";") for c in maps}
    out |= {c: F.when(F.col(c).isNotNull(), F.format_string("%.7f", F.col(c).cast("double"))) for c in positions if c in rows.columns}
    return rows.withColumns(out)


def write_csv(rows: DataFrame, path: str, spreadsheet: bool = False) -> None:
    """CSV files with a header; spreadsheet: each begins with a byte order mark (before the first column's name), as spreadsheets want for UTF-8."""
    out = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}") if spreadsheet else rows
    out.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


#: Columns of the table that people download, and what each is made of.
SHEET = ("name", "address", "lat", "lng", "country", "games", "cabinets", "source")


def sheet(rows: DataFrame) -> DataFrame:
    """The eight columns of SHEET from rows (name, addr, lat, lng, country, games, cabs, src)."""
    plain = csv_columns(rows, ["games", "cabs", "src"], [])
    return plain.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("addr", F.lit("")).alias("address"), "lat", "lng", F.coalesce("country", F.lit("")).alias("country"), "games", F.col("cabs").alias("cabinets"), F.col("src").alias("source"))


def stable_json(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One JSON text a row (value), keys in alphabetical order and nulls written, rows in order: two exports of one table are the same text."""
    return rows.orderBy(*order).select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def _escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def kml_colour(rgb: str) -> str:
    """A web colour as opaque alpha, blue, green, red."""
    return f"ff{rgb[4:6]}{rgb[2:4]}{rgb[0:2]}".lower()


def placemarks(name: str = "name", about: str = "about") -> Column:
    return F.format_string("<Placemark><name>%s</name><description>%s</description><Point><coordinates>%.7f,%.7f,0</coordinates></Point></Placemark>", _escaped(F.coalesce(F.col(name), F.lit(""))), _escaped(F.coalesce(F.col(about), F.lit(""))), F.col("lng"), F.col("lat"))


def kml_parts(rows: DataFrame, layer: str, order: list[Column], size: int = 1990, label: Callable[[Column], Column] = part_label) -> DataFrame:
    """One KML document for each layer and part of at most size rows: layer, part, n, kml."""
    placed = parts(rows.where("lat is not null and lng is not null"), layer, order, size, label).withColumn("_mark", placemarks())
    docs = placed.groupBy(layer, "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_mark"))), lambda m: m["_mark"]), "\n").alias("_body"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'), _escaped(F.col(layer)), F.lit("</name>\n"))
    return docs.select(layer, "part", "n", F.concat(head, F.col("_body"), F.lit("\n</Document></kml>\n")).alias("kml"))


@F.pandas_udf(T.BinaryType())
def zipped(kml: pd.Series) -> pd.Series:
    """A KMZ: a zip file with the one document doc.kml, the same bytes for the same text."""

    def one(text: str | None) -> bytes | None:
        if text is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("doc.kml", (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return kml.map(one, na_action=None)


def kmz_files(rows: DataFrame, layer: str, order: list[Column], size: int = 1990) -> DataFrame:
    """file and content of the KMZ of each layer and part (see kml_parts): layer.kmz where there is one part, else layer_a.kmz, layer_b.kmz, ..."""
    docs = kml_parts(rows, layer, order, size)
    many = F.count("*").over(Window.partitionBy(layer)) > 1  # a row for each part
    name = F.concat(F.col(layer), F.when(many, F.concat(F.lit("_"), F.lower("part"))).otherwise(""), F.lit(".kmz"))
    return docs.select(name.alias("file"), zipped("kml").alias("content"))


def pages(rows: DataFrame, key: str, title: str, about: str) -> DataFrame:
    """A static page for each key."""
    html = F.format_string('<!doctype html><html><head><meta charset="utf-8"><title>%s</title><meta property="og:title" content="%s"><meta property="og:description" content="%s"></head><body><h1>%s</h1><p>%s</p></body></html>', *[_escaped(F.coalesce(F.col(c), F.lit(""))) for c in (title, title, about, title, about)])
    return rows.select(key, html.alias("html"))


def stale(existing: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Written files or partitions that nothing current stands for."""
    return existing.join(current.select(*key).distinct(), key, "left_anti")
