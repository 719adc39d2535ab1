"""Version strings as sortable columns, and constraint strings as bounds on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted version forms
SEMVER = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z\-\.]+))?(?:\+([0-9A-Za-z\-\.]+))?$"
TRIPLE = r"^(\d+)\.(\d+)(?:\.(\d+)(?:-RC\d+|_\d+)?)?$"
PACKED = r"^(\d+)\.(\d{3})(\d{3})$"
CONSTRAINT = r"^([><]=?|==|=|~>)\s*(.+)$"

# kinds of one element of a semver key, lowest first
_END, _NUMBER, _TEXT, _RELEASE = 0, 1, 2, 3


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def _part(kind: int, number: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.alias("num"), text.alias("txt"))


def semver_key(version: Column) -> Column:
    """array<struct> that sorts by semver precedence; null when the string is no semver."""
    zero, empty = F.lit(0).cast("long"), F.lit("")

    def number(i: int) -> Column:
        digits = F.regexp_extract(version, SEMVER, i)
        return F.when(digits == "", zero).otherwise(digits.try_cast("long"))

    core = [number(i) for i in (1, 2, 3)]
    pre = F.regexp_extract(version, SEMVER, 4)

    def pre_part(p: Column) -> Column:
        n = F.when(p.rlike(r"^\d+$"), p.try_cast("long"))
        return (
            F.when(p == "", _part(_END, zero, empty))
            .when(n.isNotNull(), _part(_NUMBER, n, empty))
            .otherwise(_part(_TEXT, zero, p))
        )

    parsed_core = F.array(*[_part(_NUMBER, n, empty) for n in core])
    tail = F.when(pre == "", F.array(_part(_RELEASE, zero, empty))).otherwise(
        F.concat(F.transform(F.split(pre, r"\."), pre_part), F.array(_part(_END, zero, empty)))
    )
    fits = core[0].isNotNull() & core[1].isNotNull() & core[2].isNotNull()
    return F.when(version.rlike(SEMVER) & fits, F.concat(parsed_core, tail))


def dotted_key(version: Column) -> Column:
    """array<bigint>, part by part; trailing zero parts are cut, so 1.0 equals 1."""
    parts = F.transform(
        F.split(F.regexp_replace(version, "^v", ""), r"\."),
        lambda p: F.coalesce(F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long")),
    )
    last_used = F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), last_used)


def triple_key(version: Column) -> Column:
    """struct<major,minor,patch>; a release-candidate or underscore suffix is ignored.

    Null where a number is too long for a bigint: such a version is not compared.
    """
    bare = F.regexp_replace(F.trim(version), "^(?:perl-)?v?", "")
    core = F.split(F.regexp_extract(bare, TRIPLE, 0), r"[-_]")[0]

    def read(parts: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0).cast("long"))

        def too_long(i: int) -> Column:
            return F.coalesce(F.get(parts, i).rlike("^[0-9]+$"), F.lit(False)) & F.get(parts, i).try_cast("long").isNull()

        key = F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))
        return F.when((parts[0] != "") & ~too_long(0) & ~too_long(1) & ~too_long(2), key)

    return bind(F.split(core, r"\."), read)


def version_key(version: Column, scheme: str) -> Column:
    try:
        return {"semver": semver_key, "dotted": dotted_key, "triple": triple_key}[scheme](version)
    except KeyError:
        raise ValueError(f"unknown version scheme {scheme!r}") from None


def unpack_version(version: Column) -> Column:
    """5.042000 → 5.42.0; other forms are returned as they are."""
    minor = F.regexp_extract(version, PACKED, 2).try_cast("int").cast("string")
    patch = F.regexp_extract(version, PACKED, 3).try_cast("int").cast("string")
    return F.when(version.rlike(PACKED), F.concat_ws(".", F.regexp_extract(version, PACKED, 1), minor, patch)).otherwise(
        version
    )


def is_stable(version: Column) -> Column:
    """Three-part versions with an even minor number."""
    pattern = r"^(\d+)\.(\d+)\.(\d+)$"
    return version.rlike(pattern) & (F.coalesce(F.regexp_extract(version, pattern, 2).try_cast("long"), F.lit(1)) % 2 == 0)


# A version sits at (major, minor, patch, 1). Bounds use 0 and 2 in the last place,
# so that "strictly between two bounds" covers open and closed ends alike.
_LOWEST = (-1, 0, 0, 0)
_HIGHEST = (2**62, 0, 0, 0)


def _spot(major: Column, minor: Column, patch: Column, side: int) -> Column:
    return F.struct(
        major.alias("major"), minor.alias("minor"), patch.alias("patch"), F.lit(side).alias("side")
    )


def _fixed_spot(spot: tuple[int, int, int, int]) -> Column:
    *numbers, side = spot
    return _spot(*[F.lit(n).cast("long") for n in numbers], side)


def version_spot(version: Column) -> Column:
    key = triple_key(version)
    return F.when(key.isNotNull(), _spot(key["major"], key["minor"], key["patch"], 1))


def constraint_bounds(constraint: Column) -> Column:
    """struct<lo,hi> of an AND-ed constraint list; null if a piece cannot be parsed."""
    pieces = F.filter(F.transform(F.split(constraint, ","), lambda p: F.trim(p)), lambda p: p != "")

    def split_op(piece: Column) -> Column:
        op = F.regexp_extract(piece, CONSTRAINT, 1)
        ver = F.when(op == "", piece).otherwise(F.regexp_extract(piece, CONSTRAINT, 2))
        return F.struct(op.alias("op"), triple_key(ver).alias("key"))

    def bound(part: Column) -> Column:
        op, key = part["op"], part["key"]
        at, past = (_spot(key["major"], key["minor"], key["patch"], side) for side in (0, 2))
        next_minor = _spot(key["major"], key["minor"] + 1, F.lit(0).cast("long"), 0)
        lo = F.when(op == ">", past).when(op.isin("<", "<="), _fixed_spot(_LOWEST)).otherwise(at)
        hi = (
            F.when(op.isin(">", ">="), _fixed_spot(_HIGHEST))
            .when(op == "<", at)
            .when(op == "~>", next_minor)
            .otherwise(past)
        )
        return F.when(key.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))

    def meet(bounds: Column) -> Column:
        lo = F.array_max(F.concat(F.array(_fixed_spot(_LOWEST)), F.transform(bounds, lambda b: b["lo"])))
        hi = F.array_min(F.concat(F.array(_fixed_spot(_HIGHEST)), F.transform(bounds, lambda b: b["hi"])))
        return F.when(~F.exists(bounds, lambda b: b.isNull()), F.struct(lo.alias("lo"), hi.alias("hi")))

    return bind(F.transform(F.transform(pieces, split_op), bound), meet)
