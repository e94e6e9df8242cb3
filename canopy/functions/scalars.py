"""Presentation scalars as Column functions: numbers, bytes, paths, dates, colours, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: colour stops (score, red, green, blue), gradient for legends, units
STOPS = [(0, 34, 197, 94), (30, 234, 179, 8), (60, 239, 68, 68), (100, 220, 38, 38)]
GRADIENT = [(0, "#22c55e", "Low"), (15, "#84cc16", ""), (30, "#eab308", "Medium"), (45, "#f59e0b", ""), (60, "#ef4444", "High"), (80, "#dc2626", ""), (100, "#dc2626", "Very High")]
UNKNOWN_COLOR = "#94a3b8"
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def format_number(x: Column) -> Column:
    """Rounded half up, with thousands separators; 0 for null and NaN."""
    return F.when(missing(x), "0").otherwise(F.format_number(F.floor(x + 0.5), 0))


def format_bytes(x: Column, decimals: int = 2) -> Column:
    """A number of bytes in the largest unit of 1024 that leaves at least 1, with fixed decimals; 0 B for null, NaN, zero and less."""
    power = F.least(F.floor(F.log2(x.cast("double")) / 10 + 1e-12), F.lit(len(UNITS) - 1))
    shown = F.format_string("%." + str(max(0, decimals)) + "f", x / F.pow(F.lit(1024.0), power))
    return F.when(missing(x) | (x <= 0), "0 B").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, UNITS)), (F.greatest(power, F.lit(0)) + 1).cast("int"))))


def format_path(path: Column, width: int = 50, at: str = "middle") -> Column:
    """At most width characters, with ... at the start or the end; or in the middle, which keeps the file name and the end of its folders."""
    n, dots, room = F.length(path), F.lit("..."), width - 3
    if at == "start":
        cut = F.concat(dots, F.right(path, F.lit(room)))
    elif at == "end":
        cut = F.concat(F.substring(path, 1, room), dots)
    else:
        name = F.regexp_extract(path, r"([^/\\]*)$", 1)
        folders = F.regexp_replace(F.regexp_replace(path, r"[/\\][^/\\]*$", ""), r"\\", "/")
        left = F.lit(room - 1) - F.length(name)
        own = F.concat(F.substring(name, 1, room // 2), dots, F.right(name, F.lit(room // 2)))
        short = F.when(F.length(folders) > left, F.concat(dots, F.right(folders, left - 3))).otherwise(folders)
        cut = F.when(F.length(name) >= room, own).when(left <= 0, F.concat(F.lit(".../"), name)).otherwise(F.concat_ws("/", short, name))
    return F.when(path.isNull(), "").when(n <= width, path).otherwise(cut)


def format_date(ts: Column) -> Column:
    return F.when(ts.isNull(), "Unknown").otherwise(F.date_format(ts.cast("timestamp"), "MMM d, yyyy, hh:mm a"))


def format_relative_date(ts: Column, as_of: Column) -> Column:
    """just now, minutes, hours or days ago; from a week on the date."""
    seconds = as_of.cast("timestamp").cast("long") - ts.cast("timestamp").cast("long")
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / k) for k in (60, 3600, 86400))
    return F.when(ts.isNull(), "Unknown").when(seconds < 60, "just now").when(seconds < 3600, ago(minutes, "minute")).when(seconds < 86400, ago(hours, "hour")).when(days < 7, ago(days, "day")).otherwise(format_date(ts))


def complexity(loc: Column) -> Column:
    return F.least(F.floor(loc / 10), F.lit(100)).cast("int")


def complexity_color(x: Column) -> Column:
    """#rrggbb between the stops, linear in each channel; values outside are clamped."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))

    def channel(k: int) -> Column:
        parts = [(a, b, F.lit(float(a[k])) + (v - a[0]) / (b[0] - a[0]) * (b[k] - a[k])) for a, b in zip(STOPS, STOPS[1:], strict=False)]
        value = reduce(lambda rest, p: F.when(v <= p[1][0], p[2]).otherwise(rest), reversed(parts[:-1]), parts[-1][2])
        return F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("int"))), 2, "0")

    return F.when(missing(x), UNKNOWN_COLOR).otherwise(F.concat(F.lit("#"), channel(1), channel(2), channel(3)))


def complexity_label(x: Column) -> Column:
    return F.when(missing(x), "Unknown").when(x < 30, "Low").when(x < 60, "Medium").when(x < 80, "High").otherwise("Very High")


def dead_border_color(ratio: Column) -> Column:
    return F.when(missing(ratio), "#eab308").when(ratio > 0.5, "#ef4444").when(ratio > 0.2, "#f97316").otherwise("#eab308")


def confidence_color(x: Column) -> Column:
    return F.when(missing(x), UNKNOWN_COLOR).when(x > 80, "#22c55e").when(x >= 60, "#eab308").otherwise("#ef4444")


def overlay_border(ratio: Column, on: bool = True) -> tuple[Column, Column]:
    """Colour and width of a chart node's border: thick and by its ratio of dead code, if it has any and the overlay is on."""
    marked = F.lit(on) & ~missing(ratio) & (ratio != 0)
    return F.when(marked, dead_border_color(ratio)).otherwise("#ffffff"), F.when(marked, 3).otherwise(2)


def chart_label(name: Column, kind: Column, value: Column) -> Column:
    """The name, but nothing for files of 500 lines or fewer."""
    return F.when((kind == "directory") | (value > 500), name).otherwise("")


KIND_SHORT = {"Function": "fn", "ArrowFunction": "=>", "Class": "class", "Method": "method", "Variable": "var"}
KIND_LONG = {"Function": "Function", "ArrowFunction": "Arrow Function", "Class": "Class", "Method": "Method", "Variable": "Variable"}


def kind_label(kind: Column, names: dict[str, str] = KIND_SHORT) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind]


def iso_timestamp(ts: Column) -> Column:
    """UTC with milliseconds and Z (the session's time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_percent(x: Column, decimals: int = 1, signed: bool = False) -> Column:
    """A number with fixed decimals and %; with signed, a plus too. Null for null. The shortest decimal of the value is rounded, ties to even."""
    exact = F.format_string(f"%{'+' if signed else ''}.{decimals}f%%", F.bround(x.cast("decimal(38,18)"), decimals).cast("double"))
    return F.when(x.isNotNull(), exact)


def tooltip(complexity_value: Column, ratio: Column, overlay: bool = True) -> tuple[Column, Column]:
    """(complexity with one decimal and its label, share of dead code or null without the overlay or dead code)."""
    shown = F.concat(F.format_string("%.1f", complexity_value.cast("double")), F.lit(" ("), complexity_label(complexity_value), F.lit(")"))
    share = F.when(F.lit(overlay) & (ratio > 0), format_percent(ratio * 100))
    return shown, share


def complexity_gradient(spark: SparkSession) -> DataFrame:
    """The legend's stops: score, color, label."""
    return spark.createDataFrame(GRADIENT, "score int, color string, label string")
