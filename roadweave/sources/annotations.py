"""Ground truth of vehicles and their boxes, from XML and JSON.

A vehicle's facts stand in attributes or child elements under several names, its boxes in frames or in
one region; here they become one form. Records that can't be read are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators.graph import written

# Names under which each fact is looked for, the first that isn't empty counts; "_" marks attributes of XML.
XML_NAMES = {
    "raw_id": ("_id", "_iframe", "id"),
    "raw_plate": ("plate", "license_plate", "_placa", "_plate_number"),
    "moto": ("_moto", "motorcycle", "moto"),
    "vehicle_type": ("type", "vehicle_type", "_type"),
    "make": ("make", "brand", "_brand", "_make"),
    "model": ("model", "_model"),
    "color": ("color", "colour", "_color", "_colour"),
    "year": ("year", "_year"),
    "quality": ("quality", "_quality"),
    "discard": ("_discard", "discard"),
}
JSON_NAMES = {
    "raw_id": ("id", "vehicle_id"),
    "raw_plate": ("plate", "license_plate"),
    "moto": ("motorcycle",),
    "vehicle_type": ("type", "vehicle_type"),
    "make": ("make",),
    "model": ("model",),
    "color": ("color",),
    "year": ("year",),
    "quality": ("quality",),
    "discard": ("discard",),
}
TRUE = ("1", "true")

_SIZES = "struct<_x:string,_x1:string,_y:string,_y1:string,_width:string,_w:string,_height:string,_h:string>"
_FRAME = f"struct<_number:string,_id:string,number:string,plate:{_SIZES},plate_bbox:{_SIZES},vehicle:{_SIZES},box:{_SIZES},bbox:{_SIZES}>"
_XML = ", ".join([*[f"`{n}` string" for n in dict.fromkeys(n for names in XML_NAMES.values() for n in names)], "_plate string", f"frame array<{_FRAME}>", f"region {_SIZES}", "_corrupt string"])
_BOX = "array<double>"
_JSON_FRAME = f"struct<frame:string,frame_id:string,plate_bbox:{_BOX},plate:{_BOX},vehicle_bbox:{_BOX},bbox:{_BOX}>"
_JSON_ITEM = ", ".join([*[f"{n} string" for n in dict.fromkeys(n for names in JSON_NAMES.values() for n in names)], "camera_id string", f"frames array<{_JSON_FRAME}>", f"observations array<{_JSON_FRAME}>"])


def _first(*values: Column) -> Column:
    """The first that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def _box(*elements: Column) -> Column:
    """[x, y, width, height] of the first element that is there, 0 for a side that isn't; null if one isn't a number."""
    made = []
    for e in elements:
        sides = [F.coalesce(_first(e[a], e[b]), F.lit("0")) for a, b in (("_x", "_x1"), ("_y", "_y1"), ("_width", "_w"), ("_height", "_h"))]
        numbers = F.array(*[s.try_cast("double") for s in sides])
        made.append(F.when(e.isNotNull(), F.when(F.exists(numbers, F.isnull), None).otherwise(numbers)))
    return F.coalesce(*made)


def _observation(number: Column, plate: Column, vehicle: Column) -> Column:
    return F.struct(number.try_cast("int").alias("frame"), plate.cast(_BOX).alias("plate_box"), vehicle.cast(_BOX).alias("vehicle_box"))


def _unread(rows: DataFrame) -> DataFrame:
    """Records that can't be read. Readers refuse a query of that column alone, so another takes part."""
    return rows.where(F.col("_corrupt").isNotNull() & (F.length(F.concat_ws("", "id", "quality")) >= 0)).select(F.col("_corrupt").alias("record"))


def _vehicles(rows: DataFrame, names: dict[str, tuple[str, ...]], camera: str, observations: Column, plate: Column | None = None) -> DataFrame:
    """The common form: facts by name, and observations in order of their frames."""
    of = {k: _first(*[F.col(f"`{n}`") for n in v]) for k, v in names.items()}
    raw_plate = F.coalesce(of["raw_plate"], F.lit("")) if plate is None else F.coalesce(of["raw_plate"], plate, F.lit(""))
    moto = F.coalesce(F.lower(of["moto"]).isin(*TRUE), F.lit(False))
    kind = F.coalesce(of["vehicle_type"], F.when(moto, "motorcycle").otherwise("car")) if "_moto" in names["moto"] else F.coalesce(of["vehicle_type"], F.lit("car"))
    key = F.when(raw_plate == "", "").otherwise(text.normalize(raw_plate))
    seen = F.array_sort(F.filter(F.coalesce(observations, F.array().cast(f"array<struct<frame:int,plate_box:{_BOX},vehicle_box:{_BOX}>>")), lambda o: o["frame"].isNotNull()))
    blank = lambda k: F.coalesce(of[k], F.lit("")).alias(k)
    out = rows.select(
        F.when(key != "", key).otherwise(F.concat(F.lit(f"{camera}_V"), F.coalesce(of["raw_id"], F.lit("")))).alias("vehicle_gt_id"),
        F.coalesce(of["raw_id"], F.lit("")).alias("raw_id"),
        F.lit(camera).alias("camera_id"),
        raw_plate.alias("raw_plate"),
        key.alias("normalized_plate"),
        kind.alias("vehicle_type"),
        *[blank(k) for k in ("make", "model", "color", "year")],
        moto.alias("motorcycle"),
        F.coalesce(of["quality"], F.lit("good")).alias("quality"),
        F.coalesce(F.lower(of["discard"]).isin(*TRUE), F.lit(False)).alias("discard"),
        seen.alias("observations"),
    )
    edge = lambda at: F.coalesce(F.try_element_at("observations", F.lit(at))["frame"], F.lit(0))
    return out.withColumns({"observation_count": F.size("observations"), "min_frame": edge(1), "max_frame": edge(-1)})


def xml_vehicles(spark: SparkSession, path: str, camera: str) -> tuple[DataFrame, DataFrame]:
    """(vehicles, records that can't be read) of XML files with a ``vehicle`` element each.

    A vehicle has frames with boxes, or its frame is an attribute and its plate's box a region. Its name is its plate's
    normal form, or the camera's name and its id; vehicles of one name keep rows of their own. Frames without a number
    are left out, as are the boxes whose sides aren't numbers."""
    rows = spark.read.format("xml").schema(_XML).option("rowTag", "vehicle").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").load(path)
    named = F.transform("frame", lambda f: _observation(F.coalesce(_first(f["_number"], f["_id"], f["number"]), F.lit("0")), _box(f["plate"], f["plate_bbox"]), _box(f["vehicle"], f["box"], f["bbox"])))
    single = F.when(F.col("_iframe").isNotNull(), F.array(_observation(F.coalesce(F.col("_iframe").try_cast("int"), F.lit(0)).cast("string"), _box(F.col("region")), F.lit(None))))
    flag = F.when(~F.lower(F.trim(F.col("_plate"))).isin("true", "false", "1", "0"), _first(F.col("_plate")))
    good = rows.where("_corrupt is null")
    return _vehicles(good, XML_NAMES, camera, F.when(F.size("frame") > 0, named).otherwise(single), flag), _unread(rows)


@contextmanager
def _streamed(spark: SparkSession) -> Iterator[None]:
    """Numbers in fields of text are taken as they are parsed. Otherwise the reader fetches each of them from its file once
    more, a block at a time, which is the square of what stands there."""
    name = "spark.sql.json.enableExactStringParsing"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def json_vehicles(spark: SparkSession, path: str, camera: str) -> tuple[DataFrame, DataFrame]:
    """(vehicles, files that can't be read) of JSON files: a list of vehicles, or one under ``vehicles`` or ``annotations``.

    Vehicles of another camera are left out. One without an id has its place in its list for it; of a bare list,
    whose rows have no places, the empty text. The files are read once, into a table of the shared folder."""
    item = f"struct<{_JSON_ITEM.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>"
    schema = f"{_JSON_ITEM}, vehicles array<{item}>, annotations array<{item}>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    with _streamed(spark):
        rows = written(rows, "annotations")
    good, names = rows.where("_corrupt is null"), StructType.fromDDL(_JSON_ITEM).names
    held = F.coalesce("vehicles", "annotations")
    inner = good.where(held.isNotNull()).select(F.posexplode(held).alias("at", "v")).select(F.col("at").cast("string").alias("at"), "v.*")
    bare = good.where(held.isNull()).select(F.lit(None).cast("string").alias("at"), *names)
    each = inner.unionByName(bare).withColumn("id", F.coalesce("id", "vehicle_id", "at"))
    each = each.where(F.col("camera_id").isNull() | F.contains("camera_id", F.lit(camera)))
    seen = F.transform(F.coalesce("frames", "observations"), lambda f: _observation(F.coalesce(f["frame"], f["frame_id"], F.lit("0")), F.coalesce(f["plate_bbox"], f["plate"]), F.coalesce(f["vehicle_bbox"], f["bbox"])))
    return _vehicles(each, JSON_NAMES, camera, seen), _unread(rows)


def boxes_of(vehicles: DataFrame) -> DataFrame:
    """A row for each vehicle and frame: camera_id, vehicle_gt_id, discard, frame, plate_box, vehicle_box."""
    return vehicles.select("camera_id", "vehicle_gt_id", "discard", F.explode("observations").alias("o")).select("camera_id", "vehicle_gt_id", "discard", "o.*")


def element(tag: str, attributes: dict[str, Column], content: Column | None = None) -> Column:
    """One XML element as text, values escaped; attributes that are null are left out."""
    escaped = lambda v: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")), v.cast("string"))
    named = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escaped(v), F.lit('"'))).otherwise("") for k, v in attributes.items()]
    if content is None:
        return F.concat(F.lit(f"<{tag}"), *named, F.lit("/>"))
    return F.concat(F.lit(f"<{tag}"), *named, F.lit(">"), content, F.lit(f"</{tag}>"))
