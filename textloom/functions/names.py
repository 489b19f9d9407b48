"""Sites of URLs and steps of artifact names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of an artifact name.
ARTIFACT_PREFIX = "model_pg_"
STEPS_SUFFIX = "_steps.pth"
INTERRUPTED_SUFFIX = "_interrupted.pth"


def authority(url: Column) -> Column:
    """The part between ``//`` and the next ``/``, ``?`` or ``#``; empty if none.

    Port, user part and letter case stay, as a generic URL split leaves them.
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "[\t\r\n]", "")
    return F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def is_parsable(url: Column) -> Column:
    """False for a URL a generic splitter rejects: unbalanced host brackets."""
    host = authority(url)
    return F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))


def site_of(url: Column, strip_www: bool = True, normalize: bool = False) -> Column:
    """Site name of a link, null where the link cannot be parsed.

    ``www.`` is removed wherever it stands. ``normalize`` also lowers the case
    and drops user part and port.
    """
    site = authority(url)
    if normalize:
        site = F.regexp_replace(F.lower(site), r"^[^@]*@|:[0-9]*\z", "")
    if strip_www:
        site = F.replace(site, F.lit("www."), F.lit(""))
    return F.when(is_parsable(url), site)


def is_step_artifact(name: Column) -> Column:
    return name.startswith(ARTIFACT_PREFIX) & name.endswith(STEPS_SUFFIX)


def is_interrupted_artifact(name: Column) -> Column:
    return name.startswith(ARTIFACT_PREFIX) & name.endswith(INTERRUPTED_SUFFIX)


def captured_step(name: Column) -> Column:
    """Step number of ``model_pg_<step>_steps.pth`` anywhere in the name, else null; so is one beyond 64 bits."""
    digits = F.regexp_extract(name, r"model_pg_(\d+)_steps\.pth", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def split_step(name: Column) -> Column:
    """Step between the last prefix and the first suffix behind it; null if no number."""
    middle = F.substring_index(F.substring_index(name, ARTIFACT_PREFIX, -1), STEPS_SUFFIX, 1)
    known = F.contains(name, F.lit(ARTIFACT_PREFIX)) & F.contains(name, F.lit(STEPS_SUFFIX))
    return F.when(known & middle.rlike(r"^[0-9]+\z"), middle.try_cast("bigint"))
