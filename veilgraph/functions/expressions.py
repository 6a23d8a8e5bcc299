"""Column expressions: predicates, bounds, utilities and the small helpers of the reports. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The spellings of the six comparison operators.
OPERATORS = {
    "==": "==", "=": "==", "EQUAL": "==", "EQ": "==",
    "!=": "!=", "<>": "!=", "UNEQUAL": "!=", "NOT_EQUAL": "!=",
    "<": "<", "LESS": "<",
    "<=": "<=", "LESS_EQUAL": "<=", "LESS_OR_EQUAL": "<=",
    ">": ">", "GREATER": ">",
    ">=": ">=", "GREATER_EQUAL": ">=", "GREATER_OR_EQUAL": ">=",
}

#: Two-sided normal quantiles by confidence level.
Z_VALUES = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def operator_of(spelling: Column) -> Column:
    """The symbol of an operator's spelling; a spelling that isn't known stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, spelling), spelling)


def holds(left: Column, op: str, right: Column) -> Column:
    """Whether a comparison holds; an unknown operator never does. Null where a side is null."""
    symbol = OPERATORS.get(op.strip().upper(), OPERATORS.get(op.strip()))
    match symbol:
        case "==":
            return left == right
        case "!=":
            return left != right
        case "<":
            return left < right
        case "<=":
            return left <= right
        case ">":
            return left > right
        case ">=":
            return left >= right
    return F.lit(False)


def valid(*sides: Column) -> Column:
    """Whether no side is null."""
    return reduce(Column.__and__, [s.isNotNull() for s in sides])


def wilson(k: Column, n: Column, z: float = Z_VALUES[0.90]) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a share k of n, within [0, 1]; (0, 1) if n is not positive."""
    n_ = F.when(n > 0, n.cast("double"))
    p = k / n_
    scale = 1 + z * z / n_
    centre = (p + z * z / (2 * n_)) / scale
    radius = z * F.sqrt((p * (1 - p) + z * z / (4 * n_)) / n_) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - radius), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + radius), F.lit(1.0))


def utility(leakage: Column, mask_size: Column, cap: Column, penalty: Column, zone_size: Column | None = None) -> Column:
    """Minus the mask's size, minus the penalty where leakage exceeds the cap. With a zone size, size counts as a share of it."""
    size = mask_size.cast("double") if zone_size is None else mask_size / F.greatest(zone_size, F.lit(1))
    return -size - F.when(leakage > cap, penalty.cast("double")).otherwise(0.0)


def softmax(score: Column, *by: str) -> Column:
    """Softmax within a group, shifted by its largest score; uniform if the sum isn't a positive finite number."""
    group = Window.partitionBy(*by)
    weight = F.exp(score - F.max(score).over(group))
    total = F.sum(weight).over(group)
    good = (total > 0) & ~F.isnan(total) & (total < float("inf"))
    return F.when(good, weight / total).otherwise(1.0 / F.count(F.lit(1)).over(group))


def mechanism_score(epsilon: Column, utility_: Column, zone_size: Column) -> Column:
    """The exponential mechanism's exponent, with sensitivity 1 over the zone's size."""
    return epsilon * utility_ * F.greatest(zone_size, F.lit(1)) / 2.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: the same in every engine, so samples can be repeated anywhere."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hashed_number(*parts: Column) -> Column:
    """The first 32 bits of the parts' md5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def budget_share(epsilon: Column, cap: Column) -> Column:
    """The adversary's certainty tau that a budget and a leakage cap allow."""
    grown = F.exp(epsilon) * cap
    return grown / ((1 - cap) + grown)


def cap_of_share(tau: Column, epsilon: Column) -> Column:
    """The leakage cap at which a budget reaches the certainty tau."""
    return tau / (F.exp(epsilon) * (1 - tau) + tau)


def without_qualifier(name: Column) -> Column:
    """``t1.x`` as ``x``."""
    return F.substring_index(name, ".", -1)


def plain_name(name: Column) -> Column:
    """A column name in lower case with underscores for hyphens."""
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def safe_file_name(name: Column) -> Column:
    """Anything but letters, digits, dots, underscores and hyphens becomes an underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_")


def gamma_tag(gamma: Column) -> Column:
    """0.25 as ``0p25``."""
    return F.replace(F.format_number(gamma, 2), F.lit("."), F.lit("p"))


def ceil_to(x: Column, step: float) -> Column:
    """The next multiple of a step."""
    return F.ceil(x / step) * step


def bits_to_names(mask: Column, names: Column) -> Column:
    """The names whose bits are set, in bit order."""
    return F.filter(names, lambda _, i: F.getbit(mask, i) == 1)
