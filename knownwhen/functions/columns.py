"""Column helpers shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_true(*cases: tuple[Column, str], default: Column | None = None) -> Column:
    """Label of the first condition that holds, else ``default``."""
    out = None
    for cond, label in cases:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def reasons(*cases: tuple[Column, str]) -> Column:
    """Array with the label of every condition that holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in cases]))


def ratio(a: Column, b: Column) -> Column:
    """Division that yields null instead of failing on a zero divisor."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def sha256_text(x: Column) -> Column:
    """Hash in the stored form: algorithm prefix plus lower-case hex."""
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def ny_instant(day: Column, hhmm: str) -> Column:
    """UTC instant of a New York wall-clock time on a date, daylight saving included."""
    wall = F.concat(day.cast("date").cast("string"), F.lit(f" {hhmm}:00")).cast("timestamp")
    return F.to_utc_timestamp(wall, NEW_YORK).cast("timestamp_ntz")


def ny_date(instant: Column) -> Column:
    """Calendar date in New York of a UTC instant."""
    return F.from_utc_timestamp(instant.cast("timestamp"), NEW_YORK).cast("date")


def minutes_after(ts: Column, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))


def longest_prefix(text: Column, table: Mapping[str, int], fallback: int) -> Column:
    """Value of the longest key of a configuration map that starts ``text``."""
    out = None
    for prefix in sorted(table, key=len, reverse=True):
        hit = text.startswith(prefix)
        out = F.when(hit, F.lit(table[prefix])) if out is None else out.when(hit, F.lit(table[prefix]))
    return out.otherwise(F.lit(fallback)) if out is not None else F.lit(fallback)


def key_text(*cols: Column | str) -> Column:
    """One text key out of nullable parts."""
    return F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in cols])


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
