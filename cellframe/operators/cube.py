"""A (time, channel, product) cube of a correlator as a main table and its sub-tables.

Antennas (id, name, position, diameter) and products (index, input1, input2; an input is an antenna's name and a
lower-case polarisation) are small; scans (scan, state, target, tags, ra, dec) have a row a scan; dumps (t, time, scan,
vis, flags, weights) have a row a time, with cells by channel and product.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tensors import axis_mean, gather, power
from .groups import ROW, Partition
from .lookup import index_of

#: Observation intents by tag.
INTENTS = {
    "gaincal": "CALIBRATE_PHASE,CALIBRATE_AMPLI",
    "bpcal": "CALIBRATE_BANDPASS,CALIBRATE_FLUX",
    "target": "TARGET",
}
#: Polarisation products in order, and their types.
POLARISATIONS = {"HH": 9, "HV": 10, "VH": 11, "VV": 12}
#: The columns that the main table is grouped by.
GROUPS = ["FIELD_ID", "DATA_DESC_ID", "SCAN_NUMBER"]
TIME_CHUNK = 100


def baselines(antennas: DataFrame, autos: bool = False, products: DataFrame | None = None) -> DataFrame:
    """ANTENNA1, ANTENNA2 (ANTENNA1 <= ANTENNA2, equal only with `autos`) and BL, numbered in the order of
    products (ANTENNA1, ANTENNA2, CP_INDEX; missing ones count as -1) and then of the antennas."""
    one, two = antennas.select(F.col("id").alias("ANTENNA1")), antennas.select(F.col("id").alias("ANTENNA2"))
    pairs = one.join(F.broadcast(two), (F.col("ANTENNA1") <= F.col("ANTENNA2")) if autos else (F.col("ANTENNA1") < F.col("ANTENNA2")))
    if products is not None:
        pairs = pairs.join(products, ["ANTENNA1", "ANTENNA2"], "left").withColumn("CP_INDEX", F.coalesce("CP_INDEX", F.lit(-1)))
    order = Window.orderBy(*(["CP_INDEX"] if products is not None else []), "ANTENNA1", "ANTENNA2")  # antennas squared over two
    return pairs.withColumn("BL", F.row_number().over(order) - 1)


def product_pairs(antennas: DataFrame, products: DataFrame, polarisations: Sequence[str] = tuple(POLARISATIONS), autos: bool = False) -> DataFrame:
    """Baselines with CP, the index of the product of each polarisation (-1 where there is none), in the order of the first."""
    named = F.broadcast(antennas.select("id", "name"))
    pairs = baselines(antennas, autos).drop("BL")
    pairs = pairs.join(named.toDF("ANTENNA1", "__n1"), "ANTENNA1").join(named.toDF("ANTENNA2", "__n2"), "ANTENNA2")
    for pol in polarisations:
        known = products.select(F.col("input1").alias("__i1"), F.col("input2").alias("__i2"), F.col("index").alias(f"__{pol}"))
        on = [F.concat("__n1", F.lit(pol[0].lower())) == F.col("__i1"), F.concat("__n2", F.lit(pol[1].lower())) == F.col("__i2")]
        pairs = pairs.join(F.broadcast(known), on, "left").drop("__i1", "__i2").withColumn(f"__{pol}", F.coalesce(f"__{pol}", F.lit(-1)))
    first = Window.orderBy(f"__{polarisations[0]}", "ANTENNA1", "ANTENNA2")  # antennas squared over two
    return pairs.select("ANTENNA1", "ANTENNA2", F.array(*[f"__{pol}" for pol in polarisations]).alias("CP"), (F.row_number().over(first) - 1).alias("BL"))


def rows(times: DataFrame, pairs: DataFrame, n_pairs: int | Column) -> DataFrame:
    """One row for each time (column t = 0, 1, ...) and baseline, time first: ROWID = t * n_pairs + BL.
    The baselines are few (antennas squared over two) and are broadcast, so that no time moves."""
    return times.crossJoin(F.broadcast(pairs)).withColumn("ROWID", F.col("t") * n_pairs + F.col("BL"))


def time_chunks(row_chunk: int, n_pairs: int, n_times: int) -> int:
    """Whole times that a chunk of rows holds, all of them at most."""
    return min(max(row_chunk, n_pairs) // n_pairs, n_times)


def chunk_specs(chunks: None | dict | Sequence[dict], n_pairs: int, n_times: int, by_row: bool = True) -> list[dict]:
    """Chunk specifications of scans with rows turned into times; without any, TIME_CHUNK times."""
    if chunks is not None and not isinstance(chunks, dict) and not all(isinstance(c, dict) for c in chunks):
        raise TypeError("chunks are a dictionary or several")
    specs = [chunks] if isinstance(chunks, dict) else list(chunks or [{}])
    if not by_row:
        return [{"time": TIME_CHUNK, **c} for c in specs]
    return [{**{k: v for k, v in c.items() if k != "row"}, "time": time_chunks(c.get("row", TIME_CHUNK * n_pairs), n_pairs, n_times)} for c in specs]


def transpose(df: DataFrame, column: str, index: str, default) -> DataFrame:
    """(chan, product) cells to (chan, corr) by the row's index of products; -1 gives the default."""
    return df.withColumn(column, F.transform(column, lambda r: gather(r, F.col(index), default if hasattr(default, "alias") else F.lit(default))))


def weights(df: DataFrame, spectrum: str = "WEIGHT_SPECTRUM") -> DataFrame:
    """WEIGHT, the mean of the weights over channels, SIGMA_SPECTRUM, weight ** -0.5, and SIGMA, its mean."""
    df = df.withColumn("WEIGHT", axis_mean(spectrum)).withColumn("SIGMA_SPECTRUM", F.transform(spectrum, lambda r: power(r, -0.5)))
    return df.withColumn("SIGMA", axis_mean("SIGMA_SPECTRUM"))


def difference(df: DataFrame, antennas: DataFrame, column: str, out: str, on: Sequence[str] = ()) -> DataFrame:
    """column[ANTENNA1] - column[ANTENNA2], elementwise, of rows of `antennas` (id and the columns `on`)."""
    a = antennas.select(*on, F.col("id").alias("ANTENNA1"), F.col(column).alias("__a"))
    b = antennas.select(*on, F.col("id").alias("ANTENNA2"), F.col(column).alias("__b"))
    both = df.join(a, [*on, "ANTENNA1"]).join(b, [*on, "ANTENNA2"])
    return both.withColumn(out, F.zip_with("__a", "__b", lambda x, y: x - y)).drop("__a", "__b")


def antenna_cells(antennas: DataFrame, column: str, out: str) -> DataFrame:
    """(t, id, `column`) as one row a time: t, and `out`, a map from antenna to its value; an antenna given twice is refused."""
    return antennas.where("id is not null").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("id", column))).alias(out))


def cell_difference(df: DataFrame, column: str) -> Column:
    """column[ANTENNA1] - column[ANTENNA2], elementwise, of a cell by antenna; null where one of them is missing."""
    at = F.get if df.schema[column].dataType.typeName() == "array" else F.try_element_at
    return F.zip_with(at(column, F.col("ANTENNA1")), at(column, F.col("ANTENNA2")), lambda x, y: x - y)


def product_index(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """The position of each wanted product, -1 where it is missing."""
    return index_of(wanted, products, "product", "index")


def tracked(scans: DataFrame) -> DataFrame:
    """Scans that are no slews, with OBS_MODE (the intents of the tags, joined by commas, UNKNOWN without any), FIELD_ID
    (targets by first scan) and STATE_ID (modes by first scan from 1 on; UNKNOWN is 0)."""
    known = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    mapped = F.filter(F.transform("tags", lambda t: F.element_at(known, t)), lambda x: x.isNotNull())
    kept = scans.where("state <> 'slew'").withColumn("OBS_MODE", F.array_join(mapped, ","))
    kept = kept.withColumn("OBS_MODE", F.when(F.col("OBS_MODE") == "", "UNKNOWN").otherwise(F.col("OBS_MODE")))
    first = lambda key: F.min("scan").over(Window.partitionBy(key))
    kept = kept.withColumns({"__target": first("target"), "__mode": first("OBS_MODE"), "__known": F.col("OBS_MODE") != "UNKNOWN"})
    state = F.dense_rank().over(Window.partitionBy("__known").orderBy("__mode"))
    kept = kept.withColumns({"FIELD_ID": (F.dense_rank().over(Window.orderBy("__target")) - 1).cast("long"),  # a row a scan: few
                             "STATE_ID": F.when(F.col("__known"), state).otherwise(0).cast("long")})
    return kept.drop("__target", "__mode", "__known")


def main_table(dumps: DataFrame, scans: DataFrame, pairs: DataFrame, period: float, uvw: DataFrame | str | None = None, n_pairs: int | None = None) -> DataFrame:
    """The main table: a row for each dump of a tracked scan and each of `pairs` (see `product_pairs`).

    Missing products are flagged, with zero visibilities and weights.  `uvw` has antennas' coordinates: a table (t, id,
    uvw), which is joined by t and so moves the dumps' cells once, or the name of a column of the dumps with a vector
    for each antenna (an array by id, or a map); UVW is null without them.  Scans and baselines are broadcast.
    ROWID counts dumps first, then baselines; group it by GROUPS for partitions."""
    if n_pairs is None:
        pairs, n_pairs = pairs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))), F.col("__n")
    dumps = dumps.join(F.broadcast(tracked(scans).select("scan", "FIELD_ID", "STATE_ID")), "scan")
    if isinstance(uvw, DataFrame):
        dumps, uvw = dumps.join(antenna_cells(uvw, "uvw", "__uvw"), "t", "left"), "__uvw"
    out = rows(dumps, pairs, n_pairs)
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(out.schema["vis"].dataType.elementType.elementType)
    for column, default in (("vis", zero), ("flags", F.lit(True)), ("weights", F.lit(0.0))):
        out = transpose(out, column, "CP", default)
    out = out.withColumn("UVW", F.lit(None).cast("array<double>") if uvw is None else cell_difference(out, uvw))
    out = weights(out.withColumnRenamed("weights", "WEIGHT_SPECTRUM"))
    whole = {"FEED1": 0, "FEED2": 0, "ARRAY_ID": 0, "OBSERVATION_ID": 0, "PROCESSOR_ID": 1, "DATA_DESC_ID": 0}
    out = out.withColumns({c: F.lit(v) for c, v in whole.items()} | {c: F.lit(float(period)) for c in ("INTERVAL", "EXPOSURE")})
    return out.select("ROWID", *GROUPS[:2], F.col("scan").alias("SCAN_NUMBER"), F.col("time").alias("TIME"), "ANTENNA1", "ANTENNA2", "FEED1", "FEED2",
                      "STATE_ID", "ARRAY_ID", "OBSERVATION_ID", "PROCESSOR_ID", F.col("time").alias("TIME_CENTROID"), "INTERVAL", "EXPOSURE", "UVW",
                      F.col("vis").alias("DATA"), F.col("flags").alias("FLAG"), "WEIGHT_SPECTRUM", "WEIGHT", "SIGMA_SPECTRUM", "SIGMA")


def states(scans: DataFrame) -> DataFrame:
    """The STATE table: ROWID, the state's id, and OBS_MODE; UNKNOWN is always there."""
    spark = scans.sparkSession
    found = tracked(scans).select(F.col("STATE_ID").cast("long").alias("ROWID"), "OBS_MODE").union(
        spark.createDataFrame([(0, "UNKNOWN")], "ROWID long, OBS_MODE string")).distinct()
    return found.selectExpr("ROWID", "cast(1 as short) SIG", "cast(0 as short) REF", "0D CAL", "0D LOAD", "0 SUB_SCAN", "OBS_MODE", "0 FLAG_ROW")


def antenna_table(antennas: DataFrame) -> DataFrame:
    return antennas.selectExpr("cast(id as long) ROWID", "name NAME", "name STATION", "position POSITION", "array(0D, 0D, 0D) OFFSET",
                               "diameter DISH_DIAMETER", "'ALT-AZ' MOUNT", "'GROUND-BASED' TYPE", "0 FLAG_ROW")


def feed_table(antennas: DataFrame) -> DataFrame:
    one, none = "named_struct('re', 1F, 'im', 0F)", "named_struct('re', 0F, 'im', 0F)"
    return antennas.selectExpr(
        "cast(id as long) ROWID", "cast(id as int) ANTENNA_ID", "1 BEAM_ID", "array(array(0D, 0D), array(0D, 0D)) BEAM_OFFSET", "0 FEED_ID", "0D INTERVAL",
        "2 NUM_RECEPTORS", "array('X', 'Y') POLARIZATION_TYPE", f"array(array({one}, {none}), array({none}, {one})) POL_RESPONSE", "array(0D, 0D, 0D) POSITION",
        "array(-pi() / 2, -pi() / 2) RECEPTOR_ANGLE", "-1 SPECTRAL_WINDOW_ID", "0D TIME")


def polarization_table(spark: SparkSession, polarisations: Sequence[str] = tuple(POLARISATIONS)) -> DataFrame:
    number = {"H": 0, "V": 1}
    row = (0, len(polarisations), [[number[p[0]], number[p[1]]] for p in polarisations], [POLARISATIONS[p] for p in polarisations], 0)
    return spark.createDataFrame([row], "ROWID long, NUM_CORR int, CORR_PRODUCT array<array<int>>, CORR_TYPE array<int>, FLAG_ROW int")


def data_description_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 0, 0)], "ROWID long, SPECTRAL_WINDOW_ID int, POLARIZATION_ID int, FLAG_ROW int")


def field_table(scans: DataFrame, time: float) -> DataFrame:
    """The FIELD table of tracked targets: their directions (ra, dec) at the time of the first dump."""
    found = tracked(scans).groupBy("FIELD_ID").agg(F.min_by("target", "scan").alias("NAME"), F.min_by(F.array("ra", "dec"), "scan").alias("d"))
    return found.select(F.col("FIELD_ID").cast("long").alias("ROWID"), "NAME", F.lit("T").alias("CODE"), F.col("FIELD_ID").cast("int").alias("SOURCE_ID"),
                        F.lit(0).alias("NUM_POLY"), F.lit(float(time)).alias("TIME"),
                        *[F.array("d").alias(c) for c in ("DELAY_DIR", "PHASE_DIR", "REFERENCE_DIR")], F.lit(0).alias("FLAG_ROW"))


def source_table(fields: DataFrame) -> DataFrame:
    return fields.selectExpr("ROWID", "NAME", "SOURCE_ID", "array(0F, 0F) PROPER_MOTION", "-1 CALIBRATION_GROUP", "PHASE_DIR[0] DIRECTION", "TIME",
                             "1 NUM_LINES", "array(0D) REST_FREQUENCY")


def observation_table(spark: SparkSession, observer: str, project: str, start: float, end: float, telescope: str = "MeerKAT") -> DataFrame:
    row = (0, observer, project, ["unavailable"], ["unavailable"], "unknown", telescope, [start, end], 0)
    return spark.createDataFrame([row], "ROWID long, OBSERVER string, PROJECT string, LOG array<string>, SCHEDULE array<string>, SCHEDULE_TYPE string, "
                                        "TELESCOPE_NAME string, TIME_RANGE array<double>, FLAG_ROW short")  # fmt: skip


def spectral_window(freqs: Sequence[float], width: float, compatible: bool = False, band: str = "L") -> dict:
    """One SPECTRAL_WINDOW row; `compatible` fills RESOLUTION with frequencies and sums them, as old writers do."""
    n = len(freqs)
    return {"NUM_CHAN": n, "CHAN_FREQ": list(freqs), "CHAN_WIDTH": [width] * n, "EFFECTIVE_BW": [width] * n,
            "RESOLUTION": list(freqs) if compatible else [width] * n, "REF_FREQUENCY": freqs[n // 2],
            "TOTAL_BANDWIDTH": sum(freqs) if compatible else width * n, "MEAS_FREQ_REF": 5, "NAME": f"{band}-band", "FREQ_GROUP_NAME": f"{band}-band",
            "FREQ_GROUP": 0, "IF_CONV_CHAN": 0, "NET_SIDEBAND": 1, "FLAG_ROW": 0}


def spectral_window_table(spark: SparkSession, windows: Sequence[dict]) -> DataFrame:
    made = "ROWID long, NUM_CHAN int, CHAN_FREQ array<double>, CHAN_WIDTH array<double>, EFFECTIVE_BW array<double>, RESOLUTION array<double>, " \
           "REF_FREQUENCY double, TOTAL_BANDWIDTH double, MEAS_FREQ_REF int, NAME string, FREQ_GROUP_NAME string, FREQ_GROUP int, IF_CONV_CHAN int, " \
           "NET_SIDEBAND int, FLAG_ROW int"  # fmt: skip
    return spark.createDataFrame([(i, *w.values()) for i, w in enumerate(windows)], made)


def subtable_parts(df: DataFrame, group_cols: Sequence[str], name: str) -> list[Partition]:
    """A sub-table as one partition (no group columns) or one a row; other groups are refused."""
    if list(group_cols) == [ROW]:
        return [Partition(df.where(F.col("ROWID") == r[0]), {"__partition_schema__": ()}) for r in df.select("ROWID").orderBy("ROWID").collect()]
    if group_cols:
        raise ValueError(f"{name} is grouped by nothing or by {ROW}, not by {', '.join(group_cols)}")
    return [Partition(df.orderBy("ROWID"), {"__partition_schema__": ()})]


def mjd_seconds(column: str):
    """A time stamp as Modified Julian Date in seconds."""
    return F.unix_micros(column) / 1e6 + 40587 * 86400.0


def default_name(url: str, suffix: str = ".parquet") -> str:
    """The name of an archive's converted table: its file name without .full.rdb or any other last extension."""
    name = os.path.basename(urlparse(url, scheme="file").path)
    return (name[: -len(".full.rdb")] if name.endswith(".full.rdb") else os.path.splitext(name)[0]) + suffix
