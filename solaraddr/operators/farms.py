"""Many farms in one plan: profiles are rows, and what a farm counts by is columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import Layout
from .checks import profile_issues
from .compiled import Farm, compile_rows
from .profiles import DEFAULTS, pitch_of

#: A table of profiles, nested as profiles are written; pitchMm is a number, `derive` or null. `origin` may be left out: the middle of the rows.
PROFILE = (
    "id string, name string, profileVersion long, crs struct<type: string, zone: int, hemisphere: string>, module struct<widthMm: double, gapMm: double, orientation: string, pitchMm: string>, "
    "topology struct<modulesPerString: int, stringsPerRow: int, stringGapMm: double>, geometry struct<source: string, endpointOffsetMm: double, endpointOffsetMode: string, lengthToleranceMmPerModule: double>, "
    "addressing struct<originStrategy: string, fixedEnd: string, dcBoxPlacement: string, inversionStrategy: string>, matching struct<maxDistanceM: double, neighborhood: int, maxRowCandidates: int, defaultAccuracyM: double>"
)
#: So many profiles are kept as literal rows and broadcast; more are joined by shuffles.
FEW = 10_000
#: Farms that an error names.
NAMED = 20
_LAYOUT = ("modules", "strings", "width", "gap", "string_gap", "offset")
_FIELDS = ("lat", "lon", *_LAYOUT, "max_distance", "neighbourhood", "rows", "accuracy", "cell_size", "origin", "fixed_end", "dc_box", "inversion", "offset_mode", "pitch_mode", "pitch", "tolerance")


class ProfileError(ValueError):
    """All that is wrong with a set of profiles: `issues` has (farm, what) pairs of the first farms."""

    def __init__(self, issues: list[tuple[str, str]]):
        self.issues = issues
        super().__init__("; ".join(f"{farm}: {what}" for farm, what in issues))


@dataclass(frozen=True, eq=False)
class Farms(Farm):
    """Farm parameters as columns `farm_...`, which `attached` joins by farm_id to whatever needs them."""

    by: ClassVar[tuple[str, ...]] = ("farm_id",)
    parameters: DataFrame | None = field(default=None, repr=False)
    few: bool = True
    most: int = 1

    @classmethod
    def of(cls, parameters: DataFrame) -> Farms:
        """From a table with farm_id and _FIELDS. A table of up to FEW farms is read once and kept as literal rows."""
        spark = parameters.sparkSession
        parameters = parameters.select("farm_id", *[F.col(c).alias(f"farm_{c}") for c in _FIELDS])
        some = parameters.limit(FEW + 1).collect()
        few = len(some) <= FEW
        if few:
            parameters = spark.createDataFrame(some, parameters.schema)
            most = max((r.farm_rows for r in some), default=1)
        else:
            most = parameters.agg(F.max("farm_rows")).first()[0]
        c = {name: F.col(f"farm_{name}") for name in _FIELDS}
        plain = {k: c[k] for k in ("max_distance", "neighbourhood", "rows", "accuracy", "origin", "fixed_end", "dc_box", "inversion", "offset_mode", "pitch", "tolerance")}
        return cls(c["lat"], c["lon"], Layout(*[c[k] for k in _LAYOUT]), parameters=parameters, few=few, most=max(1, most), **plain)

    def attached(self, df: DataFrame, *fields: str) -> DataFrame:
        wanted = [f"farm_{c}" for c in (fields or _FIELDS) if f"farm_{c}" not in df.columns]
        if not wanted:
            return df
        own = self.parameters.select("farm_id", *wanted)
        return df.join(F.broadcast(own) if self.few else own, "farm_id")

    @property
    def stated_pitch(self) -> tuple[Column, Column]:
        return F.col("farm_pitch_mode"), F.col("farm_pitch")

    @property
    def cell_size(self) -> Column:
        return F.col("farm_cell_size")

    @property
    def most_rows(self) -> int:
        return self.most


def parameters(profiles: DataFrame, origins: DataFrame) -> DataFrame:
    """The table that `Farms.of` takes, from profiles (PROFILE) and origins (farm_id, lat, lon). Missing limits take the defaults."""
    col, metres = F.col, lambda c: F.col(c) / 1000
    limit = lambda k: F.coalesce(col(f"matching.{k}"), F.lit(DEFAULTS[k]))
    pitch = pitch_of(col("module.pitchMm"))
    box = F.coalesce(F.nullif(col("addressing.dcBoxPlacement"), F.lit("")), F.lit("center-road"))
    wide = F.greatest(limit("maxDistanceM"), F.lit(1.0))
    return (
        profiles.withColumnRenamed("id", "farm_id")
        .join(origins.select("farm_id", "lat", "lon"), "farm_id")
        .select(
            "farm_id", "lat", "lon", col("topology.modulesPerString").cast("int").alias("modules"), col("topology.stringsPerRow").cast("int").alias("strings"), metres("module.widthMm").alias("width"),
            metres("module.gapMm").alias("gap"), F.coalesce(metres("topology.stringGapMm"), F.lit(0.0)).alias("string_gap"), metres("geometry.endpointOffsetMm").alias("offset"),
            limit("maxDistanceM").cast("double").alias("max_distance"), limit("neighborhood").cast("int").alias("neighbourhood"), limit("maxRowCandidates").cast("int").alias("rows"),
            limit("defaultAccuracyM").cast("double").alias("accuracy"), F.pow(F.lit(2.0), F.greatest(F.lit(6), F.ceil(F.log2(2 * wide)))).alias("cell_size"),
            col("addressing.originStrategy").alias("origin"), col("addressing.fixedEnd").alias("fixed_end"), box.alias("dc_box"), col("addressing.inversionStrategy").alias("inversion"),
            F.coalesce(F.nullif(col("geometry.endpointOffsetMode"), F.lit("")), F.lit("both")).alias("offset_mode"), pitch["mode"].alias("pitch_mode"), (pitch["mm"] / 1000).alias("pitch"),
            F.coalesce("geometry.lengthToleranceMmPerModule", F.lit(15.0)).alias("tolerance"),
        )
    )


def middles(rows: DataFrame) -> DataFrame:
    """The mean of all ends of each farm's rows: farm_id, lat, lon."""
    return rows.groupBy("farm_id").agg(F.avg((F.col("lat_a") + F.col("lat_b")) / 2).alias("lat"), F.avg((F.col("lon_a") + F.col("lon_b")) / 2).alias("lon"))


def require_valid(profiles: DataFrame, rows: DataFrame | None = None) -> None:
    """Raises ProfileError with every issue of the first NAMED farms that have any: fields, ids given twice, farms without rows, rows without a farm."""
    found = profile_issues(profiles).select(F.coalesce("id", F.lit("")).alias("farm"), F.explode("issues").alias("what"))
    twice = profiles.groupBy("id").count().where("count > 1").select(F.coalesce("id", F.lit("")).alias("farm"), F.lit("id is given twice").alias("what"))
    found = found.unionByName(twice)
    if rows is not None:
        ids = rows.select("farm_id").distinct()
        bare = profiles.join(ids, F.col("id") == F.col("farm_id"), "left_anti").select(F.coalesce("id", F.lit("")).alias("farm"), F.lit("no rows").alias("what"))
        lost = ids.join(profiles, F.col("id") == F.col("farm_id"), "left_anti").select(F.coalesce("farm_id", F.lit("")).alias("farm"), F.lit("rows without a profile").alias("what"))
        found = found.unionByName(bare).unionByName(lost)
    by_farm = found.groupBy("farm").agg(F.collect_list("what").alias("what")).orderBy("farm").limit(NAMED).collect()
    if by_farm:
        raise ProfileError([(r.farm, what) for r in by_farm for what in r.what])


def compile_farms(profiles: DataFrame, rows: DataFrame, origins: DataFrame | None = None, strict: bool = True) -> tuple[Farms, DataFrame]:
    """Validates all profiles, then compiles the rows of all farms (those of `compile_rows`, with farm_id): (farms, compiled rows).

    Each farm's plane is around its place in `origins`, or around the middle of its rows. `strict`: wrong profiles raise ProfileError
    with all issues, and a row without length or room raises when it is read; else wrong profiles and their rows are left out, and such rows have a `reason`.
    """
    if strict:
        require_valid(profiles, rows)
    else:
        profiles = profile_issues(profiles).where(F.size("issues") == 0).drop("issues").dropDuplicates(["id"])
    places = middles(rows)
    if origins is not None:
        given = origins.select("farm_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        places = places.join(given, "farm_id", "left").select("farm_id", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"))
    farms = Farms.of(parameters(profiles, places))
    return farms, compile_rows(rows, farms, strict)
