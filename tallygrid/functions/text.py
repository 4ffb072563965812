"""Names and text values: normalised headers, lenient casts, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..fixed import ARCHIVE_TIME_FORMATS


def normal_name(name: str) -> str:
    """Lower-case header name with every other character as an underscore."""
    clean = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")
    return f"_{clean}" if clean[:1].isdigit() else clean


def lenient_int(text: Column | str, kind: str = "int") -> Column:
    """Whole number from text; '950.0' and '1e3' count, anything else is NULL.

    A plain ``try_cast`` to an integer would turn '950.0' into NULL; it is only
    the fast path for the plain digits that nearly all values are.
    """
    raw = F.col(text) if isinstance(text, str) else text
    by_number = F.round(F.trim(raw).try_cast("double")).try_cast(kind)
    return F.when(raw.rlike("^[0-9]{1,9}$"), raw.try_cast(kind)).otherwise(by_number)


def archive_timestamp(text: Column | str) -> Column:
    """Timestamp from any of the archive's text layouts, NULL if none fits.

    The first characters tell the layouts apart: trying one that does not fit
    costs an exception per row.
    """
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    named, iso, spaced, slashed = (F.try_to_timestamp(raw, F.lit(f)) for f in ARCHIVE_TIME_FORMATS)
    return (
        F.when(raw.rlike("^[A-Za-z]"), named)
        .when(raw.rlike("^[0-9]{4}-[^T]*T"), iso)
        .when(raw.rlike("^[0-9]{4}-"), spaced)
        .when(raw.contains("/"), slashed)
    )


def signed_percent(share: Column) -> Column:
    """A share as text such as '+12%' or '-3%'."""
    return F.when(share.isNotNull(), F.format_string("%+.0f%%", share * 100))


def mentions(note: Column | str, word: str) -> Column:
    """Whether a note contains ``word``; a missing note does not."""
    return F.coalesce(F.col(note) if isinstance(note, str) else note, F.lit("")).contains(word)
