"""Control-token prefixes: render ``<Name_value> `` strings and parse them back.

A control token is ``<Name_number>``; tokens may be separated by zero or more
spaces ("glued" ``<A_1><B_2>`` and spaced ``<A_1> <B_2>`` both parse).  A
leading token without ``_number`` (``<unk>``) is not a control token, so the
line then has no prefix.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctrltok.functions.bins import FEATURES, TOKEN_NAMES

# A control token is "<", a name, "_", a decimal number, ">"; the
# prefix is a run of such tokens separated by zero or more spaces.
CONTROL_TOKEN = r"<[A-Za-z][A-Za-z0-9]*_[0-9]+(?:\.[0-9]+)?>"
PREFIX_PATTERN = rf"\A((?:{CONTROL_TOKEN} *)+)"
NAME_PATTERN = r"<([A-Za-z][A-Za-z0-9]*)_"
VALUE_PATTERN = r"_([0-9]+(?:\.[0-9]+)?)>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_text(v) -> Column:
    """``str(round(v, 2))``: shortest repr, e.g. 0.85, 1.0, 2.45."""
    return F.round(_col(v), 2).cast("string")


def render_token(feature: str, v) -> Column:
    """``<Name_v> `` (with the trailing space); NULL when ``v`` is NULL."""
    return F.concat(F.lit(f"<{TOKEN_NAMES[feature]}_"), value_text(v), F.lit("> "))


def render_prefix(values: Mapping[str, Column]) -> Column:
    """Concatenate tokens in alphabetical order of the feature name; NULL
    values contribute no token."""
    parts = [render_token(f, values[f]) for f in sorted(values)]
    if not parts:
        return F.lit("")
    return F.concat_ws("", *parts)


def render_map_prefix(m, names: Iterable[str]) -> Column:
    """Render the tokens ``names`` (token names, in the given order) from a
    parsed ``MAP<STRING,DOUBLE>``; missing names are skipped."""
    m = _col(m)
    parts = [F.concat(F.lit(f"<{n}_"), m[n].cast("string"), F.lit("> ")) for n in names]
    return F.concat_ws("", *parts) if parts else F.lit("")


def prefix_text(line) -> Column:
    """The run of leading control tokens (with their spaces), '' if none."""
    return F.regexp_extract(_col(line), PREFIX_PATTERN, 1)


def strip_prefix(line) -> Column:
    """The sentence after the control tokens (the whole line if there are none)."""
    return F.regexp_replace(_col(line), PREFIX_PATTERN, "")


def token_entries(line) -> Column:
    """ARRAY<STRUCT<name STRING, value DOUBLE>> of leading control tokens in order."""
    p = prefix_text(line)
    names = F.regexp_extract_all(p, F.lit(NAME_PATTERN), 1)
    values = F.regexp_extract_all(p, F.lit(VALUE_PATTERN), 1)
    return F.arrays_zip(names.alias("name"), F.transform(values, lambda v: v.cast("double")).alias("value"))


def parse_tokens(line) -> Column:
    """``MAP<STRING,DOUBLE>`` of the leading control tokens (last duplicate wins),
    or NULL when the line has no prefix."""
    e = token_entries(line)
    # keep the last occurrence of every name so the map never sees duplicates
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e), F.lit(1))), lambda y: y["name"] == x["name"]))
    return F.when(F.size(e) > 0, F.map_from_entries(last))


def feature_set_key(features: Iterable[str]) -> str:
    """Driver-side validation and key: names sorted and joined by '_'."""
    fs = list(features)
    unknown = sorted(set(fs) - set(FEATURES))
    if unknown:
        raise ValueError(f"unknown features {unknown}; allowed: {list(FEATURES)}")
    if not fs:
        raise ValueError("at least one feature is required")
    return "_".join(sorted(set(fs)))
