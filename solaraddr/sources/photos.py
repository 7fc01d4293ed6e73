"""Photos with the place they were taken at, from the EXIF block of JPEG files."""

from __future__ import annotations

import math
import struct
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the EXIF format: tags of directories and of the values that are read, and bytes of each type.
EXIF_IFD, GPS_IFD, TAKEN, CREATED = 0x8769, 0x8825, 0x9003, 0x9004
LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT, ERROR = 1, 2, 3, 4, 5, 6, 31
_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_CODE = {1: "B", 3: "H", 4: "I", 9: "i"}
_SCHEMA = "path string, file_name string, lat double, lon double, accuracy double, altitude double, taken_at timestamp_ntz, error string"


def _tiff(raw: bytes) -> bytes | None:
    """The TIFF block of a JPEG's EXIF segment."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            return raw[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(tiff: bytes, at: int) -> dict[int, object]:
    """Tag -> value (text, number or list of numbers) of the directory at an offset."""
    end = "<" if tiff[:2] == b"II" else ">"
    out = {}
    for k in range(struct.unpack_from(f"{end}H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(f"{end}HHI", tiff, at + 2 + 12 * k)
        width = _WIDTH.get(kind, 0) * n
        if not width:
            continue
        place = at + 10 + 12 * k if width <= 4 else struct.unpack_from(f"{end}I", tiff, at + 10 + 12 * k)[0]
        if kind in (2, 7):
            out[tag] = tiff[place : place + n].split(b"\0")[0].decode("latin-1")
        elif kind in (5, 10):
            pairs = struct.unpack_from(f"{end}{2 * n}{'I' if kind == 5 else 'i'}", tiff, place)
            out[tag] = [a / b if b else math.nan for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(f"{end}{n}{_CODE[kind]}", tiff, place))
    return out


def _degrees(parts, ref, negative: str) -> float | None:
    if not parts:
        return None
    size = sum(x / 60**i for i, x in enumerate(parts[:3]))
    return None if math.isnan(size) else -size if str(ref or "")[:1].upper() == negative else size


def read_exif(raw: bytes) -> dict:
    """lat, lon, accuracy, altitude and taken_at of a JPEG, those that it has. Raises on what is no JPEG or has a broken block."""
    tiff = _tiff(raw)
    if tiff is None:
        return {}
    end = "<" if tiff[:2] == b"II" else ">"
    main = _directory(tiff, struct.unpack_from(f"{end}I", tiff, 4)[0])
    gps = _directory(tiff, main[GPS_IFD][0]) if GPS_IFD in main else {}
    exif = _directory(tiff, main[EXIF_IFD][0]) if EXIF_IFD in main else {}
    out = {"lat": _degrees(gps.get(LAT), gps.get(LAT_REF), "S"), "lon": _degrees(gps.get(LON), gps.get(LON_REF), "W")}
    error, altitude = (gps.get(ERROR) or [math.nan])[0], (gps.get(ALT) or [math.nan])[0]
    out["accuracy"] = error if error > 0 else None
    out["altitude"] = None if math.isnan(altitude) else -altitude if gps.get(ALT_REF) == [1] else altitude
    try:
        out["taken_at"] = datetime.strptime(str(exif.get(TAKEN) or exif.get(CREATED)), "%Y:%m:%d %H:%M:%S")
    except ValueError:
        out["taken_at"] = None
    return out


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """A row for every file under `path`: path, file_name, lat, lon, accuracy, altitude, taken_at, error.

    A file that cannot be read is a row with its error, one without a place has the error no-gps; none stops the others.
    Thumbnails are not made. A photo has to fit a task's memory.
    """

    return parsed(spark.read.format("binaryFile").load(path, recursiveFileLookup=True).repartition("path"))


def parsed(files: DataFrame) -> DataFrame:
    """The same for files (path, content) of a table or a stream."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = read_exif(bytes(raw))
                    error = "no-gps" if found.get("lat") is None or found.get("lon") is None else None
                except (ValueError, struct.error, IndexError, KeyError, TypeError) as problem:
                    found, error = {}, type(problem).__name__
                rows.append((name, name.rsplit("/", 1)[-1], *(None if error else found.get(k) for k in ("lat", "lon", "accuracy", "altitude", "taken_at")), error))
            out = pd.DataFrame(rows, columns=["path", "file_name", "lat", "lon", "accuracy", "altitude", "taken_at", "error"])
            yield out.astype({c: "float64" for c in ("lat", "lon", "accuracy", "altitude")} | {"taken_at": "datetime64[us]"})

    return files.select("path", "content").mapInPandas(parse, _SCHEMA)


#: Columns of a stream of files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def photo_stream(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """The rows of `read_photos` as a stream: each file that is put under `path` once, up to `most_files` a batch. Bad files are rows too."""
    return parsed(spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(path))
