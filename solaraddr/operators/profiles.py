"""Farm profiles: presets, and how a new version of one is put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..functions.text import slug
from .compiled import Farm

# Two profiles to begin with; millimetres and metres as profiles state them.
PRESETS = {
    "pvh-28x2": {
        "module": {"widthMm": 1130.0, "gapMm": 20.0, "orientation": "portrait", "pitchMm": None},
        "topology": {"modulesPerString": 28, "stringsPerRow": 2, "stringGapMm": 3713.0},
        "geometry": {"source": "survey-stakes", "endpointOffsetMm": -1464.0, "endpointOffsetMode": "both"},
        "addressing": {"originStrategy": "dc-box-end", "dcBoxPlacement": "center-road", "inversionStrategy": "piercing-chain"},
        "matching": {"maxDistanceM": 30.0, "neighborhood": 2, "maxRowCandidates": 3, "defaultAccuracyM": 3.0},
    },
    "generico": {
        "module": {"widthMm": 1130.0, "gapMm": 20.0, "orientation": "portrait", "pitchMm": "derive"},
        "topology": {"modulesPerString": 28, "stringsPerRow": 1, "stringGapMm": 0.0},
        "geometry": {"source": "survey-stakes", "endpointOffsetMm": 0.0, "endpointOffsetMode": "none"},
        "addressing": {"originStrategy": "fixed-end", "fixedEnd": "north", "inversionStrategy": "none"},
        "matching": {"maxDistanceM": 30.0, "neighborhood": 2, "maxRowCandidates": 3, "defaultAccuracyM": 3.0},
    },
}
# Matching limits of a profile that states none.
DEFAULTS = {"maxDistanceM": 30.0, "neighborhood": 2, "maxRowCandidates": 3, "defaultAccuracyM": 3.0}


def farm_of(profile: dict, lat: float, lon: float) -> Farm:
    """The counting rules of a profile (nested as in PRESETS) on a plane around (lat, lon); missing matching limits take DEFAULTS."""
    module, topology, geometry, rules = (profile[k] for k in ("module", "topology", "geometry", "addressing"))
    limits = DEFAULTS | {k: v for k, v in (profile.get("matching") or {}).items() if v is not None}
    offset = geometry["endpointOffsetMm"] / 1000
    layout = Layout(topology["modulesPerString"], topology["stringsPerRow"], module["widthMm"] / 1000, module["gapMm"] / 1000, (topology.get("stringGapMm") or 0) / 1000, offset)
    pitch = module.get("pitchMm")
    return Farm(
        lat, lon, layout, limits["maxDistanceM"], limits["neighborhood"], limits["maxRowCandidates"], limits["defaultAccuracyM"],
        origin=rules["originStrategy"], fixed_end=rules.get("fixedEnd"), dc_box=rules.get("dcBoxPlacement") or "center-road", inversion=rules["inversionStrategy"],
        offset_mode=geometry.get("endpointOffsetMode") or "both", pitch=pitch if pitch in (None, "derive") else pitch / 1000, tolerance=geometry.get("lengthToleranceMmPerModule") or 15.0,
    )


def next_version(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Profiles ready to be saved: drafts (name, crs, and other columns) with id, version and calibration.

    A draft whose `farm_id` is among `existing` (farm_id, profileVersion, calibration) goes on with its id, the next version and
    its calibration; others get an id from their name, version 1 and the status unverified.
    """
    old = existing.select("farm_id", F.col("profileVersion").alias("_version"), F.col("calibration").alias("_calibration"))
    name = F.nullif(F.trim("name"), F.lit(""))
    out = drafts.join(old, "farm_id", "left")
    return out.withColumns(
        {
            "farm_id": F.coalesce("farm_id", slug(F.coalesce(name, F.lit("")))),
            "name": F.coalesce(name, F.lit("Unnamed farm")),
            "profileVersion": F.coalesce("_version", F.lit(0)) + 1,
            "calibration": F.coalesce("_calibration", F.lit("unverified")),
        }
    ).drop("_version", "_calibration")


def pitch_of(profile_pitch: Column) -> Column:
    """A profile's pitch, which is a number, `derive` or nothing, as struct(mode, mm)."""
    text = profile_pitch.cast("string")
    mode = F.when(text.isNull(), "nominal").when(text == "derive", "derive").otherwise("explicit")
    return F.struct(mode.alias("mode"), text.try_cast("double").alias("mm"))
