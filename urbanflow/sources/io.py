"""Readers and writers of feature tables, node-link graphs, storms and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanflow.functions.geometry import reproject_points
from urbanflow.model import Network

LINE = "array<struct<x:double,y:double>>"


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether JSON at ``path`` is one document over several lines, told by its first line."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return first is not None and not first["value"].rstrip().endswith("}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: parquet and geoparquet; geojson and ndgeojson (features to rows); json and jsonl.

    JSON of any kind may hold a record a line, which large inputs need to be split, or one document.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "geoparquet"):
        return spark.read.parquet(path)
    if kind in ("geojson", "ndgeojson", "json", "jsonl"):
        raw = spark.read.option("multiLine", _whole(spark, path)).json(path)
        if "geojson" not in kind:
            return raw
        features = raw.select(F.explode("features").alias("f")).select("f.*") if "features" in raw.columns else raw
        return features.select("properties.*", "geometry")
    raise ValueError(f"unknown extension {kind}")


def write_table(df: DataFrame, path: str) -> None:
    """By extension, as ``read_table`` takes it; geojson has a feature a line: points of x and y, or lines of ``geometry``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "geoparquet"):
        df.write.parquet(path)
    elif kind in ("geojson", "ndgeojson"):
        (_line_features(df) if "geometry" in df.columns else _point_features(df)).write.text(path)
    elif kind in ("json", "jsonl"):
        df.write.json(path)
    else:
        raise ValueError(f"unknown extension {kind}")


def parse_line(wkt: Column) -> Column:
    """LINESTRING text to vertices; null for anything else."""
    body = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([^()]*)\)", 1)
    points = F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")),
    )
    return F.when(body != "", points)


def line_text(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def load_network(spark: SparkSession, path: str, lines: bool = False) -> Network:
    """Node-link JSON: ids as text, WKT to vertices, straight lines where an edge has none.

    ``lines``: a document a line, which large inputs need to be split; all of them are one network.
    """
    raw = spark.read.option("multiLine", not lines).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*").withColumn("id", F.col("id").cast("string"))
    links = raw.select(F.explode("links").alias("e")).select("e.*")
    edges = links.withColumns({"u": F.col("source").cast("string"), "v": F.col("target").cast("string")}).drop("source", "target")
    line = parse_line(F.col("geometry")) if "geometry" in edges.columns else F.lit(None).cast(LINE)
    edges = edges.withColumn("geometry", line)
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(f"_{end}")), end)
    crs = raw.select("graph.crs").first()[0] if "graph" in raw.columns and "crs" in raw.schema["graph"].dataType.names else ""
    return Network(nodes, edges.withColumn("geometry", F.coalesce("geometry", F.array("_u", "_v"))).drop("_u", "_v"), crs or "")


def saved_network(spark: SparkSession, path: str, crs: str = "") -> Network:
    """What ``save_network`` has written."""
    return Network(spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet"), crs)


def save_network(net: Network, path: str) -> None:
    """Nodes and links as Parquet side by side."""
    net.nodes.write.parquet(f"{path}/nodes.parquet")
    net.edges.write.parquet(f"{path}/edges.parquet")


def _safe(df: DataFrame, skip: tuple[str, ...]) -> Column:
    return F.struct(*(F.col(c) for c in df.columns if c not in skip))


def _feature(df: DataFrame, kind: str, coordinates: Column, skip: tuple[str, ...]) -> DataFrame:
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), _safe(df, skip).alias("properties"))
    return df.select(F.to_json(f).alias("value"))


def _point_features(df: DataFrame) -> DataFrame:
    return _feature(df, "Point", F.array("x", "y"), ("x", "y"))


def _line_features(df: DataFrame) -> DataFrame:
    return _feature(df, "LineString", F.transform("geometry", lambda p: F.array(p["x"], p["y"])), ("geometry",))


def node_features(net: Network) -> DataFrame:
    """One GeoJSON text for each node."""
    return _point_features(net.nodes)


def edge_features(net: Network) -> DataFrame:
    return _line_features(net.edges)


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    deep = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in deep}) if deep else df


def write_features(net: Network, path: str, fmt: str = "geojson") -> None:
    if fmt == "geojson":
        node_features(net).write.text(f"{path}/nodes.ndgeojson")
        edge_features(net).write.text(f"{path}/edges.ndgeojson")
    elif fmt == "geoparquet":
        flat_columns(net.nodes).write.parquet(f"{path}/nodes.geoparquet")
        flat_columns(net.edges).write.parquet(f"{path}/edges.geoparquet")
    else:
        raise ValueError(f"unknown format {fmt}")


def _spread(n: Column) -> Column:
    """The low 16 bits with a zero bit before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def write_by_place(df: DataFrame, path: str, files: int | None = None, row_group: int | None = None) -> None:
    """Parquet in order of a space-filling curve over the centres of ``bbox``, so that ``scan_bbox`` skips row groups.

    The extent of all boxes is cut in 2^16 by 2^16 cells, numbered by their interleaved bits; files are
    ranges of those numbers. Rows without a box come first. ``row_group`` is in bytes.
    """
    x, y = (F.col(f"bbox.{c}min") + F.col(f"bbox.{c}max") for c in "xy")
    extent = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda v, a, b: F.coalesce(F.floor((v - F.col(a)) / F.nullif(F.col(b) - F.col(a), F.lit(0.0)) * 65535), F.when(v.isNotNull(), F.lit(0))).cast("long")
    placed = df.crossJoin(F.broadcast(extent))  # one row
    placed = placed.withColumn("_z", _spread(cell(x, "_x0", "_x1")).bitwiseOR(F.shiftleft(_spread(cell(y, "_y0", "_y1")), 1)))
    ranged = placed.repartitionByRange(files, "_z") if files else placed.repartitionByRange("_z")
    out = ranged.sortWithinPartitions("_z").select(*df.columns).write
    (out.option("parquet.block.size", row_group) if row_group else out).parquet(path)


def scan_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose ``bbox`` struct overlaps the box; the nested fields are pushed to the scan."""
    return df.where((F.col("bbox.xmin") < xmax) & (F.col("bbox.xmax") > xmin) & (F.col("bbox.ymin") < ymax) & (F.col("bbox.ymax") > ymin))


def country_iso3(df: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    """Adds ``iso3`` by ``codes`` (iso2, iso3), one row a country; unknown codes give empty text."""
    return df.join(codes.select(F.col("iso2").alias(col), "iso3"), col, "left").withColumn("iso3", F.coalesce("iso3", F.lit("")))


def prepare_precipitation(df: DataFrame) -> DataFrame:
    return reproject_points(df).withColumn("unit", F.lit("m/hr"))


def read_storm(spark: SparkSession, path: str) -> DataFrame:
    """``station, ts, value`` of a storm file; lines that start with ; are comments."""
    p = F.split(F.trim("value"), r"\s+")
    own = spark.read.text(path).where("trim(value) <> '' AND NOT trim(value) LIKE ';%'")
    ts = F.make_timestamp(*(p[i].cast("int") for i in range(1, 6)), F.lit(0))
    return own.select(p[0].alias("station"), ts.alias("ts"), p[6].cast("double").alias("value"))


def compose_networks(networks: list[Network]) -> Network:
    """Union by edge key and node id; where several have an attribute, the last one's value holds."""

    def merged(frames: list[DataFrame], keys: list[str]) -> DataFrame:
        tagged = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        cols = [c for c in every.columns if c not in (*keys, "_rank")]
        return every.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in cols))

    return networks[-1].with_(nodes=merged([n.nodes for n in networks], ["id"]), edges=merged([n.edges for n in networks], ["u", "v", "key"]))


def starting_network(river: Network, street: Network) -> Network:
    """Rivers and streets in one network; streets win."""
    tag = lambda n, t: n.with_(edges=n.edges.withColumn("edge_type", F.lit(t)))
    return compose_networks([tag(river, "river"), tag(street, "street")])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("id").cast("string").alias("id"), "variable", "date", "value")
