"""Columns about releases: which version is newer, which asset to take, digests, notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X


def update_available(current: Column, offered: Column, error: Column) -> Column:
    """Whether a manifest without an error offers a higher version."""
    fine = (F.coalesce(error, F.lit("")) == "") & (F.coalesce(offered, F.lit("")) != "")
    return fine & (X.semver(offered) > X.semver(current))


def patch_applies(current: Column, least: Column, patch_from: Column, patch: Column) -> Column:
    """Whether the current version is supported and not older than what a patch starts from."""
    now = X.semver(current)
    from_ok = (F.coalesce(patch_from, F.lit("")) == "") | (now >= X.semver(patch_from))
    return patch.isNotNull() & (now >= X.semver(F.coalesce(least, F.lit("0.0.0")))) & from_ok


def choose_asset(current: Column, least: Column, patch_from: Column, patch: Column, full: Column, prefer_patch: bool = True) -> Column:
    """The patch where it applies, else the full asset, else the patch."""
    return F.when(F.lit(prefer_patch) & patch_applies(current, least, patch_from, patch), patch).otherwise(F.coalesce(full, patch))


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def notice(template: str, **values: Column) -> Column:
    """A notice from a template with {names}; each is replaced by its column, or left out where that is null."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def is_generated(backend: Column) -> Column:
    """Whether a text was made with the help of a model, by the name of what made it."""
    return ~F.lower(F.coalesce(backend, F.lit(""))).isin("", "none", "off", "disabled")
