"""Names and versions of declared dependencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.fixed import MANIFEST_ECOSYSTEMS, VERSION_NUMBER, VERSION_RANGE
from duskwatch.functions.binding import let


def normalize_name(name: Column) -> Column:
    """Equal results mean the same package: case and runs of ``_ . -`` do not count."""
    return F.regexp_replace(F.lower(name), r"[_.\-]+", "-")


def version_numbers(version: Column) -> Column:
    """The first dotted number as ``array<double>``; null where there is none."""
    return let(
        F.regexp_extract(version, VERSION_NUMBER, 1),
        lambda run: F.when(
            run != "", F.transform(F.split(run, r"\."), lambda n: n.cast("double"))
        ),
    )


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1; a missing element counts as 0."""

    def padded(numbers: Column, other: Column) -> Column:
        missing = F.greatest(F.size(other) - F.size(numbers), F.lit(0))
        return F.concat(numbers, F.array_repeat(F.lit(0.0), missing))

    both = F.struct(padded(left, right).alias("a"), padded(right, left).alias("b"))
    return let(both, lambda p: F.when(p["a"] < p["b"], -1).when(p["a"] > p["b"], 1).otherwise(0))


def version_in_range(declared: Column, range_: Column) -> Column:
    """No range or an unreadable one holds; a version without digits never does."""
    operator = F.regexp_extract(range_, VERSION_RANGE, 1)
    wanted = (
        F.when(operator == "<", F.array(F.lit(-1)))
        .when(operator == "<=", F.array(F.lit(-1), F.lit(0)))
        .when(operator == ">", F.array(F.lit(1)))
        .when(operator == ">=", F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    target = version_numbers(F.regexp_extract(range_, VERSION_RANGE, 2))
    sides = F.struct(version_numbers(declared).alias("have"), target.alias("target"))
    order = let(sides, lambda v: compare_versions(v["have"], v["target"]))
    readable = declared.rlike(r"\d")
    open_range = range_.isNull() | (range_ == "") | ~range_.rlike(VERSION_RANGE)
    return (
        F.when(open_range, True).when(~F.coalesce(readable, F.lit(False)), False)
        .otherwise(F.array_contains(wanted, order))
    )


# --- keys that sort like versions -----------------------------------------------------------------


def version_key(version: Column) -> Column:
    """Text that sorts, byte by byte, as the versions' numbers compare; null without a number.

    Each number is the count of its digits and then its digits; zeros at the end are left out, as missing numbers are zero.
    """

    def digits(number: Column) -> Column:
        text = F.when(number == float("inf"), F.lit("9")).otherwise(F.format_string("%.0f", number))
        size = F.when(number == float("inf"), F.lit(999)).otherwise(F.length(text))
        return F.concat(F.lpad(size.cast("string"), 3, "0"), text)

    text = lambda numbers: F.array_join(F.transform(_without_last_zeros(numbers), digits), "")
    return let(version_numbers(version), text)


def _without_last_zeros(numbers: Column) -> Column:
    kept = F.array_max(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1).otherwise(0)))
    return F.slice(numbers, 1, kept)


def version_interval(range_: Column) -> Column:
    """A range as ``struct<sign, bound>``: the sign of its one comparison and the key it compares with; null where it holds for all."""
    sign = F.regexp_extract(range_, VERSION_RANGE, 1)
    open_range = range_.isNull() | (range_ == "") | ~range_.rlike(VERSION_RANGE)
    return F.when(~F.coalesce(open_range, F.lit(True)), F.struct(
        F.when(sign.isin("<", "<=", ">", ">="), sign).otherwise("=").alias("sign"),
        version_key(F.regexp_extract(range_, VERSION_RANGE, 2)).alias("bound"),
    ))


def in_interval(key: Column, interval: Column) -> Column:
    """Whether a version of this key lies in an interval; one without a number lies in none but the null one."""
    sign, bound = interval["sign"], interval["bound"]
    inside = (
        F.when(sign == "<", key < bound).when(sign == "<=", key <= bound).when(sign == ">", key > bound)
        .when(sign == ">=", key >= bound).otherwise(key == bound)
    )
    return interval.isNull() | F.coalesce(inside, F.lit(False))


_CELL_DIGITS = 8


def _leading(version: Column) -> Column:
    """The leading number as eight hexadecimal digits; larger ones share the last place."""
    number = F.least(F.get(version_numbers(version), F.lit(0)), F.lit(float(16**_CELL_DIGITS - 1))).cast("bigint")
    return F.lpad(F.lower(F.hex(number)), _CELL_DIGITS, "0")


def version_cells(version: Column) -> Column:
    """The cells a version lies in: every beginning of its leading number, the empty one too."""
    places = F.sequence(F.lit(0), F.lit(_CELL_DIGITS))
    beginnings = let(_leading(version), lambda d: F.transform(places, lambda n: F.substring(d, F.lit(1), n)))
    return F.coalesce(beginnings, F.array(F.lit("")))


def interval_cells(range_: Column) -> Column:
    """Disjoint cells that together hold the leading numbers of a range: some dozens at most, however wide it is."""
    sign, digits = version_interval(range_)["sign"], _leading(F.regexp_extract(range_, VERSION_RANGE, 2))
    every = F.array(*[F.lit(f"{n:x}") for n in range(16)])
    places = F.sequence(F.lit(1), F.lit(_CELL_DIGITS))

    def beyond(up: bool) -> Column:
        def at(d: Column) -> Column:
            def cells(n: Column) -> Column:
                own = F.substring(d, n, F.lit(1))
                others = F.filter(every, (lambda h: h > own) if up else (lambda h: h < own))
                return F.transform(others, lambda h: F.concat(F.substring(d, F.lit(1), n - 1), h))

            return F.flatten(F.transform(places, cells))

        return let(digits, at)

    none = F.array().cast("array<string>")
    wide = F.when(sign.isin(">", ">="), beyond(True)).when(sign.isin("<", "<="), beyond(False)).otherwise(none)
    return F.when(sign.isNull(), F.array(F.lit(""))).otherwise(F.concat(F.array(digits), wide))


def manifest_compatible(manifest: Column, applies_to: Column) -> Column:
    """Package names are scoped by ecosystem: an npm entry never meets a PyPI dependency."""
    base = F.regexp_extract(manifest, r"[^/\\]*\z", 0)
    fits = F.lit(True)
    for name, exts in MANIFEST_ECOSYSTEMS.items():
        overlap = F.arrays_overlap(applies_to, F.array(*[F.lit(e) for e in exts]))
        fits = F.when(base == name, overlap).otherwise(fits)
    return F.array_contains(applies_to, "*") | fits
