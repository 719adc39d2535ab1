"""Type masks: sets of value kinds as bits of a bigint column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: leaf bits in the order in which they are shown
LEAVES = {
    "Undef": 1 << 0,
    "Bool": 1 << 1,
    "Int": 1 << 2,
    "Num": 1 << 3,
    "Str": 1 << 4,
    "DualVar": 1 << 5,
    "Regex": 1 << 6,
    "ScalarRef": 1 << 7,
    "ArrayRef": 1 << 8,
    "HashRef": 1 << 9,
    "CodeRef": 1 << 10,
    "GlobRef": 1 << 11,
    "Object": 1 << 12,
    "Array": 1 << 13,
    "Hash": 1 << 14,
    "Code": 1 << 15,
    "Glob": 1 << 16,
    "NaN": 1 << 17,
    "Inf": 1 << 18,
}
UNKNOWN, NONE = 0, 1 << 31
UNDEF, BOOL, INT, REGEX, OBJECT = (LEAVES[n] for n in ("Undef", "Bool", "Int", "Regex", "Object"))
ARRAY, HASH, CODE, GLOB = (LEAVES[n] for n in ("Array", "Hash", "Code", "Glob"))
NUM = LEAVES["Num"] | INT
STR = LEAVES["Str"] | NUM
REF = sum(LEAVES[n] for n in ("ScalarRef", "ArrayRef", "HashRef", "CodeRef", "GlobRef", "Object"))
SCALAR = UNDEF | BOOL | STR | LEAVES["DualVar"] | LEAVES["NaN"] | LEAVES["Inf"] | REGEX | REF
LIST = ARRAY | HASH
ANY = SCALAR | LIST | CODE | GLOB

# masks with a name of their own; Num and Str name the families, not the bare leaf bits
NAMED = {
    "Unknown": UNKNOWN,
    **{n: b for n, b in LEAVES.items() if n not in ("Num", "Str")},
    "Num": NUM,
    "Str": STR,
    "None": NONE,
    "Ref": REF,
    "Scalar": SCALAR,
    "List": LIST,
    "Any": ANY,
}
OPEN_MASKS = (ANY, SCALAR, LIST)
REF_TYPES = {"HASH": "HashRef", "ARRAY": "ArrayRef", "SCALAR": "ScalarRef", "CODE": "CodeRef", "GLOB": "GlobRef"}


def bits(value: int) -> Column:
    return F.lit(value).cast("long")


def keep(mask: Column, other: int | Column) -> Column:
    return mask.bitwiseAND(bits(other) if isinstance(other, int) else other)


def without(mask: Column, other: int) -> Column:
    return mask.bitwiseAND(F.bitwise_not(bits(other)))


def mask_name(mask: Column) -> Column:
    named = reduce(lambda w, item: w.when(mask == item[1], item[0]), NAMED.items(), F)
    leaves = [F.when(keep(mask, bit) != 0, name) for name, bit in LEAVES.items()]
    rest = without(mask, sum(LEAVES.values()))
    odd = F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest))))
    return named.otherwise(F.concat_ws("|", *leaves, odd))


def is_subtype(child: Column, parent: Column) -> Column:
    inside = keep(without(parent, NONE), child) == child
    return F.when(child == NONE, True).when(child == UNKNOWN, parent == UNKNOWN).otherwise(inside)


def satisfies(actual: Column, required: Column) -> Column:
    """Whether a value of mask `actual` may stand where `required` is expected."""
    ad_hoc = ~actual.isin(*NAMED.values()) & (keep(actual, required) == required)
    open_kind = actual.isin(*OPEN_MASKS) & is_subtype(required, actual)
    return (required == ANY) | (actual == UNKNOWN) | is_subtype(actual, required) | ad_hoc | open_kind


def narrowed(mask: Column, guard: Column, ref_type: Column, negated: Column) -> tuple[Column, Column]:
    """(mask after the guard, whether it changed) for guards defined / ref / isa / bool."""
    start = F.when(mask == UNKNOWN, bits(ANY)).otherwise(mask)
    ref_mask = reduce(lambda w, i: w.when(ref_type == i[0], bits(LEAVES[i[1]])), REF_TYPES.items(), F)
    ref_mask = ref_mask.when(ref_type == "REF", bits(REF)).otherwise(bits(OBJECT))
    typed = F.coalesce(ref_type, F.lit("")) != ""
    yes = (
        F.when(guard == "defined", without(start, UNDEF))
        .when((guard == "ref") & typed, keep(start, ref_mask))
        .when(guard == "ref", keep(start, REF))
        .when(guard == "isa", keep(start, OBJECT))
        .when(guard == "bool", keep(start, BOOL))
        .otherwise(start)
    )
    no = (
        F.when(guard == "defined", keep(start, UNDEF))
        .when((guard == "ref") & typed, start)
        .when(guard == "ref", without(start, REF))
        .when(guard == "bool", without(start, BOOL))
        .otherwise(start)
    )
    result = F.when(negated, no).otherwise(yes)
    return F.when(result == 0, bits(NONE)).otherwise(result), result != start


def in_scalar_context(mask: Column) -> Column:
    """Arrays and hashes become their element count, an Int."""
    counted = without(mask, LIST).bitwiseOR(bits(INT))
    return F.when(keep(mask, LIST) != 0, counted).otherwise(mask)


def guard_suggestion(var: Column, actual: Column, expected: Column) -> Column:
    """The first guard that would make `actual` fit `expected`, as text; else empty."""

    def fits(mask: Column) -> Column:
        return satisfies(mask, expected) | is_subtype(expected, mask)

    def text(call: str) -> Column:
        return F.concat(F.lit(f"Add guard: if ({call}("), var, F.lit(")) { ... }"))

    bare, refs, flag = without(actual, UNDEF), keep(actual, REF), keep(actual, BOOL)
    has_undef = (keep(actual, UNDEF) != 0) & (keep(expected, UNDEF) == 0) & (bare != 0)
    return (
        F.when(var == "", "")
        .when(has_undef & fits(bare), text("defined"))
        .when((refs != 0) & fits(refs), text("ref"))
        .when((flag != 0) & fits(flag), text("builtin::is_bool"))
        .otherwise("")
    )


# fixed values: builtin functions as (least number of arguments, argument masks, result mask);
# the last argument mask may repeat
_HA = HASH | ARRAY
BUILTINS = {
    "push": (2, [ARRAY, ANY], INT),
    "pop": (0, [ARRAY], SCALAR),
    "shift": (0, [ARRAY], SCALAR),
    "unshift": (2, [ARRAY, ANY], INT),
    "splice": (1, [ARRAY, INT, INT, ANY], LIST),
    "keys": (1, [_HA], LIST),
    "values": (1, [_HA], LIST),
    "delete": (1, [SCALAR], SCALAR),
    "exists": (1, [SCALAR], BOOL),
    "each": (1, [_HA], LIST),
    "length": (0, [STR], INT),
    "chomp": (0, [STR], INT),
    "chop": (0, [STR], STR),
    "chr": (0, [INT], STR),
    "ord": (0, [STR], INT),
    "join": (2, [STR, STR], STR),
    "split": (0, [REGEX, STR, INT], LIST),
    "sprintf": (1, [STR, ANY], STR),
    "substr": (2, [STR, NUM, NUM], STR),
    "defined": (0, [SCALAR], BOOL),
    "ref": (0, [SCALAR], STR),
    "scalar": (1, [ANY], SCALAR),
    "die": (0, [STR], NONE),
    "warn": (0, [STR], BOOL),
    "bless": (1, [REF, STR], OBJECT),
    "print": (0, [STR], BOOL),
    "say": (0, [STR], BOOL),
    "return": (0, [ANY], ANY),
    "map": (2, [CODE, LIST], LIST),
    "grep": (2, [CODE, LIST], LIST),
    "sort": (1, [LIST], LIST),
}

# fixed values: masks of an operator's left side, right side and result; Any takes everything
OPERATORS = {
    "+": (NUM, NUM, NUM),
    "-": (NUM, NUM, NUM),
    "*": (NUM, NUM, NUM),
    "/": (NUM, NUM, NUM),
    "%": (NUM, NUM, NUM),
    "**": (NUM, NUM, NUM),
    ".": (STR, STR, STR),
    "x": (STR, INT, STR),
    "==": (NUM, NUM, BOOL),
    "!=": (NUM, NUM, BOOL),
    "<": (NUM, NUM, BOOL),
    ">": (NUM, NUM, BOOL),
    "<=": (NUM, NUM, BOOL),
    ">=": (NUM, NUM, BOOL),
    "<=>": (NUM, NUM, INT),
    "eq": (STR, STR, BOOL),
    "ne": (STR, STR, BOOL),
    "lt": (STR, STR, BOOL),
    "gt": (STR, STR, BOOL),
    "le": (STR, STR, BOOL),
    "ge": (STR, STR, BOOL),
    "cmp": (STR, STR, INT),
    "&&": (ANY, ANY, ANY),
    "||": (ANY, ANY, ANY),
    "//": (ANY, ANY, ANY),
    "and": (ANY, ANY, ANY),
    "or": (ANY, ANY, ANY),
    "xor": (ANY, ANY, BOOL),
    "&": (INT, INT, INT),
    "|": (INT, INT, INT),
    "^": (INT, INT, INT),
    "<<": (INT, INT, INT),
    ">>": (INT, INT, INT),
    "isa": (SCALAR, STR, BOOL),
    "=~": (STR, REGEX, BOOL),
    "!~": (STR, REGEX, BOOL),
    "..": (INT, INT, LIST),
    "...": (INT, INT, LIST),
    "=": (ANY, ANY, ANY),
}
NUMERIC_COMPARISONS = ["==", "!=", "<", ">", "<=", ">=", "<=>"]
