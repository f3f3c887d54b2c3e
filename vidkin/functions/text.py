"""Parsing of durations, frame rates and probe JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
MAX_DIM = 16384
PROBE = "struct<duration_secs:double,fps:double,codec:string,bitrate_bps:bigint,width:int,height:int>"


def number(c: Column) -> Column:
    """DOUBLE, or NULL unless the whole text is a float literal."""
    return F.when(F.rlike(c, F.lit(_NUMBER)), c.try_cast("double"))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def parse_duration(c: Column) -> Column:
    """Seconds from a float, H:M:S or M:S; only the plain float must be finite and not negative."""

    def colon(t: Column) -> Column:
        part = F.split(t, ":", -1)
        p = [number(F.get(part, F.lit(k))) for k in range(3)]
        return F.when(F.size(part) == 3, p[0] * 3600.0 + p[1] * 60.0 + p[2]).when(F.size(part) == 2, p[0] * 60.0 + p[1])

    def chosen(t: Column) -> Column:
        valid = lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf"))
        return bind(number(t), lambda x: F.when(x.isNotNull(), F.when(valid(x), x)).otherwise(colon(t)))

    return bind(F.trim(c), chosen)


def parse_fps(c: Column) -> Column:
    def ratio(part: Column) -> Column:
        num, den = (number(F.trim(F.get(part, F.lit(k)))) for k in (0, 1))
        good = (den != 0) & ~F.isnan(num) & (F.abs(num) < float("inf"))
        return F.when(good, num / F.nullif(den, F.lit(0.0)))

    return bind(bind(F.split(c, "/", -1), ratio), lambda fps: F.when((fps > 0) & (fps < 1000), fps))


def _string_at(v: Column, path: str) -> Column:
    """The value at path if it is a JSON string, else NULL (a number or a missing key is no string)."""
    return bind(F.try_variant_get(v, path, "variant"), lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))


def parse_probe(json: Column) -> Column:
    """Metadata of the first video stream. A fallback is used only where the first key is no string; NULL
    without a duration or with text that isn't JSON."""
    # Bound in a lambda, so the text is parsed once.
    return bind(F.try_parse_json(json), _metadata)


def _metadata(v: Column) -> Column:
    s = "$.streams[0]."
    duration = parse_duration(F.coalesce(_string_at(v, s + "duration"), _string_at(v, "$.format.duration")))
    fps = parse_fps(F.coalesce(_string_at(v, s + "avg_frame_rate"), _string_at(v, s + "r_frame_rate")))
    rate = F.coalesce(_string_at(v, s + "bit_rate"), _string_at(v, "$.format.bit_rate"))
    bitrate = F.when(F.rlike(rate, F.lit(r"^\+?[0-9]+$")), rate.try_cast("bigint"))

    def dim(key: str) -> Column:
        whole = bind(F.try_variant_get(v, s + key, "variant"), lambda x: F.when(F.schema_of_variant(x) == "BIGINT", x.cast("bigint")))
        return bind(whole, lambda n: F.when(n >= 0, F.least(F.pmod(n, F.lit(2**32)), F.lit(MAX_DIM)).cast("int")))

    rest = {"fps": fps, "codec": _string_at(v, s + "codec_name"), "bitrate_bps": bitrate, "width": dim("width"), "height": dim("height")}
    return bind(duration, lambda d: F.when(d.isNotNull(), F.struct(d.alias("duration_secs"), *[c.alias(k) for k, c in rest.items()])))


def aspect_ratio(width: Column, height: Column) -> Column:
    """w/h as FLOAT, NULL if unknown or of height 0."""
    return F.when(height > 0, (width.cast("double") / F.nullif(height, F.lit(0)).cast("double")).cast("float"))
