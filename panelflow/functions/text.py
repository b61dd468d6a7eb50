"""Text expressions: names, identifiers, direction and segment labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.numeric import _c

# ---------------------------------------------------------------------------
# Fixed values (must equal the source behaviour for equal results)
# ---------------------------------------------------------------------------
# Direction words tested in this order on the lower-cased description.
ANTICLOCKWISE_WORDS = ("anti-clockwise", "anticlockwise")
CLOCKWISE_WORD = "clockwise"
COMPASS_DIRECTIONS = ("eastbound", "westbound", "northbound", "southbound")
# Segment types read from a description when the carriageway is blank.
DESCRIPTION_TYPES = (("slip", "slipRoad"), ("junction", "junction"),
                     ("roundabout", "roundabout"), ("main", "mainCarriageway"))
# Name terms that exclude a file from the flow validation.
EXCLUDED_NAME_TERMS = ("connector", "link", "roundabout", "entry", "exit",
                       "onramp", "offramp", "slip")
# Characters removed from a name before it becomes a file name.
UNSAFE_NAME_CHARS = '\\/*?:"<>|'
# ---------------------------------------------------------------------------


def snake_case(name: str) -> str:
    """Header text -> snake_case (driver-side, for column names)."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def snake_case_col(x) -> Column:
    """The same transformation as a column expression (for data values)."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "_"), F.lit("_"))


def trailing_id(x) -> Column:
    """Trailing digits after whitespace (``"... 1234"`` -> ``"1234"``), else NULL."""
    return F.nullif(F.regexp_extract(_c(x), r"\s+(\d+)$", 1), F.lit(""))


def file_link_id(x) -> Column:
    """Digits just before ``.csv`` at the end of a file name, else NULL."""
    return F.nullif(F.regexp_extract(_c(x), r"(\d+)\.csv$", 1), F.lit(""))


def safe_file_name(x) -> Column:
    """Slashes become underscores, other unsafe characters are removed."""
    s = F.regexp_replace(_c(x), "/", "_")
    return F.regexp_replace(s, "[" + re.escape(UNSAFE_NAME_CHARS) + "]", "")


def archive_name_from_url(url) -> Column:
    """Last path part of a URL with ``.zip`` appended when missing."""
    last = F.element_at(F.split(_c(url), "/"), -1)
    return F.when(last.endswith(".zip"), last).otherwise(F.concat(last, F.lit(".zip")))


#: Every class that `direction_of` gives.
ALL_DIRECTIONS = ("anticlockwise", "clockwise", *COMPASS_DIRECTIONS, "other")


def direction_of(description) -> Column:
    """Direction class of a link description (ordered substring rules)."""
    d = F.lower(F.coalesce(_c(description).cast("string"), F.lit("none")))
    anti = reduce(lambda a, b: a | b, [d.contains(w) for w in ANTICLOCKWISE_WORDS])
    expr = F.when(anti, F.lit("anticlockwise")).when(
        d.contains(CLOCKWISE_WORD) & ~d.contains("anti"), F.lit("clockwise"))
    for w in COMPASS_DIRECTIONS:
        expr = expr.when(d.contains(w), F.lit(w))
    return expr.otherwise(F.lit("other"))


def segment_type_of(carriageway, description) -> Column:
    """Carriageway text when not blank, else a type read from the
    description, else ``unknown``."""
    cw = F.nullif(F.trim(_c(carriageway).cast("string")), F.lit(""))
    cw = F.when(cw == "nan", F.lit(None)).otherwise(cw)
    d = F.lower(F.coalesce(_c(description), F.lit("")))
    from_desc = None
    for word, label in DESCRIPTION_TYPES:
        from_desc = (F.when(d.contains(word), F.lit(label)) if from_desc is None
                     else from_desc.when(d.contains(word), F.lit(label)))
    return F.coalesce(cw, from_desc.otherwise(F.lit("unknown")))


def has_excluded_term(name, terms=EXCLUDED_NAME_TERMS) -> Column:
    n = F.lower(_c(name))
    return reduce(lambda a, b: a | b, [n.contains(t) for t in terms])


def direction_code(name) -> Column:
    """``ACW`` / ``CW`` / empty (anti tested first: the intended rule)."""
    n = F.lower(_c(name))
    return (F.when(n.contains("anti-clockwise") | n.contains("anticlockwise"), F.lit("ACW"))
            .when(n.contains("clockwise"), F.lit("CW")).otherwise(F.lit("")))


def junctions_of(name) -> Column:
    """``Jx-Jy`` from "between Jx and Jy", else the first ``Jn``, else ''
    (case-insensitive: the intended rule)."""
    n = _c(name)
    a = F.regexp_extract(n, r"(?i)between j(\d+) and j(\d+)", 1)
    b = F.regexp_extract(n, r"(?i)between j(\d+) and j(\d+)", 2)
    one = F.regexp_extract(n, r"(?i)j(\d+)", 1)
    return (F.when(a != "", F.concat(F.lit("J"), a, F.lit("-J"), b))
            .when(one != "", F.concat(F.lit("J"), one)).otherwise(F.lit("")))


def clean_segment_name(name, road: str = "M60", include_id: bool = False) -> Column:
    """Short label "<road> <ACW|CW> <Jx-Jy>" (intended form: anti-clockwise
    tested first, junction pattern matched).  Falls back to the name."""
    n = _c(name).cast("string")
    js = F.regexp_extract_all(n, F.lit(r"J(\d+)"), 1)
    junc = (F.when(F.size(js) >= 2, F.concat(F.lit("J"), js[0], F.lit("-J"), js[1]))
            .when(F.size(js) == 1,
                  F.when(F.lower(n).contains("roundabout"),
                         F.concat(F.lit("J"), js[0], F.lit(" Roundabout")))
                  .otherwise(F.concat(F.lit("J"), js[0])))
            .otherwise(F.lit("")))
    road_part = F.when(n.contains(road), F.lit(road)).otherwise(F.lit(""))
    dir_part = (F.when(n.contains("anti-clockwise") | n.contains("ACW"), F.lit("ACW"))
                .when(n.contains("clockwise") | n.contains("CW"), F.lit("CW")).otherwise(F.lit("")))
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in (road_part, dir_part, junc)])
    out = F.when(joined == "", n).otherwise(joined)
    if include_id:
        last = F.element_at(F.split(n, " "), -1)
        out = F.when(last.rlike(r"^\d+$"), F.concat(out, F.lit(" ("), last, F.lit(")"))).otherwise(out)
    return out


def segment_label(direction, junctions, clean_name, road: str = "M60") -> Column:
    """Plot label: road + direction, then junctions or the text after
    "within " of the clean name."""
    base = F.concat(F.lit(road + " "), F.coalesce(_c(direction), F.lit("")))
    j = F.trim(F.coalesce(_c(junctions), F.lit("")))
    cn = _c(clean_name)
    return (F.when(j != "", F.concat(base, F.lit("\n"), j))
            .when(F.coalesce(cn.contains("within"), F.lit(False)),
                  F.concat(base, F.lit("\n"), F.element_at(F.split(cn, "within "), -1)))
            .otherwise(base))
