"""Reading captures into frame tables and writing alerts, rules and profiles."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.functions.payload import hex_to_bytes
from framewatch.operators import windows as W
from framewatch.operators.rules import rule_row, rules_frame
from framewatch.schema import FRAME_SCHEMA
from framewatch.storage import kept

#: Attack type by a word in the file's name, in order.
ATTACK_NAMES = (("attack-free", "none"), ("dos", "dos"), ("accessory", "accessory"), ("combined", "combined"), ("double", "double"), ("fuzz", "fuzzing"), ("interval", "interval"), ("rpm", "rpm"), ("speed", "speed"), ("standstill", "standstill"), ("systematic", "systematic"), ("triple", "triple"), ("suspension", "suspension"), ("force", "force-neutral"), ("gear", "gear"))


def frame_columns(df: DataFrame, **have: Column) -> DataFrame:
    """``df`` as frames: the columns given, null (or false) for the rest, ts from ts_us."""
    cols = []
    for f in FRAME_SCHEMA.fields:
        c = have.get(f.name)
        if c is None and f.name == "ts" and "ts_us" in have:
            c = F.timestamp_micros(have["ts_us"])
        elif c is None:
            c = F.lit(False) if f.name.startswith("is_") else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _seq() -> Column:
    """Place in the source: files are read in splits whose ids ascend with the offset, so order within a file is kept; no shuffle."""
    return F.monotonically_increasing_id()


def _micros(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(20,6)") * 1_000_000).cast("long")


def read_can_csv(spark: SparkSession, path: str | list[str], pad: bool = False, below: str | None = None) -> DataFrame:
    """CSV with a header: timestamp, arbitration_id (or can_id), data_field (or data, Data), attack (or Attack).

    Ids are hex. A row whose time, id or payload can't be read is left out. With
    ``pad`` a payload is filled up with 00 or cut to eight bytes. ``below``: all
    files of this name (a glob) in the folder and those below it.
    """
    reader = spark.read.option("header", True)
    raw = (reader.option("recursiveFileLookup", True).option("pathGlobFilter", below) if below else reader).csv(path)
    names = {c.lower().strip(): c for c in raw.columns}

    def pick(*options: str) -> Column:
        found = [F.col(f"`{names[o]}`") for o in options if o in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    hexed = F.regexp_replace(F.regexp_replace(pick("data_field", "data"), r"^\s*0[xX]", ""), r"\s", "")
    if pad:
        hexed = F.substr(F.rpad(hexed, 16, "0"), F.lit(1), F.lit(16))
    clean = F.regexp_replace(F.trim(pick("arbitration_id", "can_id")), "^0[xX]", "")
    rows = raw.select(F.trim(pick("timestamp", "time")).alias("_s"), F.when(clean.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(clean, 16, 10).cast("long")).alias("_id"), hex_to_bytes(F.coalesce(hexed, F.lit(""))).alias("_d"), F.expr("try_cast({} as int)".format("`" + names.get("attack", "") + "`") if "attack" in names else "cast(null as int)").alias("_attack"), F.input_file_name().alias("_file"))
    rows = rows.withColumn("_us", _micros(F.expr("try_cast(_s as decimal(20,6))"))).filter("_us is not null and _id is not null and _d is not null").withColumn("_seq", _seq())
    return frame_columns(rows, seq=F.col("_seq"), ts_us=F.col("_us"), can_id=F.col("_id"), dlc=F.size("_d"), data=F.col("_d"), is_extended=F.col("_id") > 0x7FF, attack=F.col("_attack"), source_file=F.col("_file"), bus=F.regexp_extract("_file", r"([^/]+)$", 1))


_STANDARD = r"^\s*\((\d+(?:\.\d+)?)\)\s+(\S+)\s+([0-9A-Fa-f]+)#(R|[0-9A-Fa-f]*)\s*$"
_DETAILED = r"^\s*\(?(\d+(?:\.\d+)?)\)?\s+(\S+)\s+([0-9A-Fa-f]+)\s+\[(\d+)\]\s*((?:[0-9A-Fa-f]{2}\s*)*)$"
_BARE = r"^\s*([0-9A-Fa-f]+)#([0-9A-Fa-f]*)\s*$"


def read_candump(spark: SparkSession, path: str | list[str], formats: str = "standard", stretch: int = 1 << 16) -> DataFrame:
    """candump text, ``(time) iface ID#HEX``; R for a remote frame; other lines are left out, an odd last digit dropped.

    ``formats='all'`` reads ``time iface ID [n] HH HH`` and bare ``ID#HEX`` lines
    too; a bare line is a millisecond after the line before it. A file's lines are
    taken in stretches of ``stretch`` at most.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("_file")).withColumn("_seq", _seq())
    part = lambda p, i: F.when(F.col("value").rlike(p), F.regexp_extract("value", p, i))
    time, iface, ident, text = part(_STANDARD, 1), part(_STANDARD, 2), part(_STANDARD, 3), part(_STANDARD, 4)
    if formats == "all":
        time, iface = F.coalesce(time, part(_DETAILED, 1)), F.coalesce(iface, part(_DETAILED, 2))
        ident, text = F.coalesce(ident, part(_DETAILED, 3), part(_BARE, 1)), F.coalesce(text, part(_DETAILED, 5), part(_BARE, 2))
    rows = raw.select("_seq", "_file", time.alias("_time"), iface.alias("_iface"), ident.alias("_hex"), F.regexp_replace(text, r"\s", "").alias("_text")).filter("_hex is not null")
    rows = rows.withColumn("_us", _micros(F.col("_time"))).withColumn("_id", F.conv("_hex", 16, 10).cast("long"))
    if formats == "all":  # a bare line counts on from the last time in its file, by stretches of lines
        placed = kept(rows, "lines").withColumns({"ts_us": F.col("_seq"), "seq": F.col("_seq")})
        numbered = W.running_sum(placed, F.lit(1), "_rn", ("_file",), stretch)
        rows = W.running_max(numbered, {"_last": F.when(F.col("_us").isNotNull(), F.struct("_rn", "_us"))}, ("_file",), 0, stretch).drop("ts_us", "seq")
        gap = F.col("_rn") - F.coalesce("_last._rn", F.lit(0))
        rows = rows.withColumn("_us", F.coalesce("_last._us", F.lit(0)) + gap * 1000)
    data = F.when(F.col("_text") == "R", F.expr("cast(array() as array<int>)")).otherwise(hex_to_bytes("_text"))
    rows = rows.withColumn("_d", data)
    return frame_columns(rows, seq=F.col("_seq"), ts_us=F.col("_us"), can_id=F.col("_id"), dlc=F.size("_d"), data=F.col("_d"), is_extended=(F.length("_hex") > 3) & (F.col("_id") > 0x7FF), is_remote=F.col("_text") == "R", bus=F.coalesce("_iface", F.regexp_extract("_file", r"([^/]+)$", 1)), source_file=F.col("_file"))


#: Magic of a PCAP file -> byte order and whether its fractions are nanoseconds.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}


def parse_pcap(content: bytes) -> Iterator[tuple[int, int, bool, bool, bool, list[int]]]:
    """(ts_us, can_id, extended, remote, error, data) of each SocketCAN record; a header of 0, 14, 16 or 18 bytes before the frame is found by its fields."""
    if content[:4] not in _MAGIC:
        return
    order, nanos = _MAGIC[content[:4]]
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, size, _ = struct.unpack_from(order + "IIII", content, at)
        record = content[at + 16 : at + 16 + size]
        at += 16 + size
        for skip in (0, 14, 16, 18):
            frame = record[skip:]
            if len(frame) < 8:
                continue
            word, dlc = struct.unpack_from(">I", frame)[0], frame[4]
            ident = word & (0x1FFFFFFF if word & 0x80000000 else 0x7FF)
            plain = not word & 0x80000000 and word & 0x1FFFF800
            if dlc <= 8 and 8 + dlc <= len(frame) <= 16 and not plain and frame[5:8] == b"\0\0\0":
                yield seconds * 1_000_000 + fraction * nanos // 1000, ident, bool(word & 0x80000000), bool(word & 0x40000000), bool(word & 0x20000000), list(frame[8 : 8 + dlc])
                break


def read_pcap(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """PCAP files of SocketCAN frames, one task per file; records that hold no such frame are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                rows = [(path, i, *r) for i, r in enumerate(parse_pcap(content))]
                yield pd.DataFrame(rows, columns=["file", "n", "us", "id", "ext", "rtr", "err", "d"])

    rows = files.mapInPandas(run, "file string, n long, us long, id long, ext boolean, rtr boolean, err boolean, d array<int>")
    return frame_columns(rows, seq=F.col("n"), ts_us=F.col("us"), can_id=F.col("id"), dlc=F.size("d"), data=F.col("d"), is_extended=F.col("ext"), is_remote=F.col("rtr"), is_error=F.col("err"), source_file=F.col("file"), bus=F.regexp_extract("file", r"([^/]+)$", 1))


def read_frames_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """JSON arrays (``lines``: an object or array per line) of frame objects: timestamp in seconds, can_id, dlc, data, and the flags and labels they have."""
    schema = "timestamp double, can_id long, dlc int, data array<int>, is_extended boolean, is_remote boolean, is_error boolean, source_id int, is_attack boolean, attack_type string, vehicle_type string, source_file string"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path).filter("timestamp is not null and can_id is not null").withColumn("_seq", _seq())
    d = F.coalesce("data", F.expr("cast(array() as array<int>)"))
    return frame_columns(raw, seq=F.col("_seq"), ts_us=_micros(F.col("timestamp")), can_id=F.col("can_id"), dlc=F.coalesce("dlc", F.size(d)), data=d, is_extended=F.coalesce("is_extended", F.lit(False)), is_remote=F.coalesce("is_remote", F.lit(False)), is_error=F.coalesce("is_error", F.lit(False)), source_id=F.col("source_id"), attack=F.col("is_attack").cast("int"), attack_type=F.col("attack_type"), vehicle=F.col("vehicle_type"), source_file=F.col("source_file"), bus=F.coalesce("vehicle_type", F.lit("can0")))


def attack_type_of(file: Column) -> Column:
    """The attack's name from a word in the file name; ``unknown`` if there is none."""
    name = F.lower(F.regexp_extract(file, r"([^/]+)$", 1))
    out = F.lit("unknown")
    for word, kind in reversed(ATTACK_NAMES):
        out = F.when(F.contains(name, F.lit(word)), kind).otherwise(out)
    return out


def vehicle_of(file: Column) -> Column:
    """set number and known or unknown vehicle, from the path (set_01/test_02_known_vehicle_...)."""
    number = F.regexp_extract(file, r"set_(\d+)", 1)
    kind = F.when(F.contains(file, F.lit("unknown_vehicle")), "unknown").when(F.contains(file, F.lit("known_vehicle")), "known").otherwise("train")
    return F.when(number != "", F.concat(F.lit("set_"), number, F.lit("_"), kind)).otherwise(F.lit("unknown"))


def read_dataset(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All captures below a folder, with attack_type from the file's name and vehicle from its path; bus is the file."""
    return labelled(read_can_csv(spark, folder, below=pattern))


def labelled(frames: DataFrame) -> DataFrame:
    return frames.withColumn("attack_type", attack_type_of(F.col("source_file"))).withColumn("vehicle", vehicle_of(F.col("source_file")))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from YAML (``rules:`` a list, or nothing but the list), ids before global, then by priority, then as in the file.

    A fractional limit of frames is cut to an integer. A rule without a name or a severity,
    with an unknown field, or with a value that is not of its field's type is left out with a warning; the others stay.
    """
    loaded = yaml.safe_load(_text(spark, path)) or {}
    rules = []
    for i, r in enumerate((loaded if isinstance(loaded, list) else loaded.get("rules")) or []):
        try:
            if not (isinstance(r, dict) and r.get("name") and r.get("severity")):
                raise ValueError("no name or no severity")
            rule_row(r)
            rules.append(r)
        except (TypeError, ValueError, AttributeError) as e:
            warnings.warn(f"{path}: rule {i} ({r.get('name') if isinstance(r, dict) else r}) left out: {e}", stacklevel=2)
    return rules_frame(spark, sorted(rules, key=lambda r: (r.get("can_id") is None, 5 if r.get("priority") is None else int(r["priority"]))))


def _text(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path, wholetext=True).first()
    return found[0] if found else ""


def write_alerts(alerts: DataFrame, path: str, format: str = "json") -> None:
    """JSON lines, or CSV with nested columns as JSON."""
    if format == "csv":
        nested = {f.name for f in alerts.schema.fields if f.dataType.simpleString().startswith(("array", "struct", "map"))}
        alerts.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in alerts.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        alerts.write.mode("overwrite").json(path)


def save_table(df: DataFrame, path: str, format: str = "parquet", by: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(format)
    (writer.partitionBy(by) if by else writer).save(path)


def save_rules(spark: SparkSession, rules: list[dict[str, Any]], path: str, **metadata: Any) -> None:
    """Generated rules (hundreds) as one YAML file with ``_metadata``, in any store that Spark reaches."""
    text = yaml.safe_dump({"rules": rules, "_metadata": {"rules": len(rules), **metadata}}, sort_keys=False)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
