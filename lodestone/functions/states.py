"""What a record's fields say about it: states of files, verdicts, changes, modes and classes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import codes, ladder


def artifact_state(there: Column, created: Column, kept_from: Column) -> Column:
    """Whether a record's file is available; if not, whether it has expired (the record is older than what is kept) or is missing."""
    return ladder("missing", (F.coalesce(there, F.lit(False)), "available"), (created < kept_from, "expired"))


def deletion_verdict(there: Column, inside: Column, owned: Column) -> Column:
    """Whether a candidate path may be deleted, or why not."""
    return ladder("delete", (~there, "missing"), (~inside, "outside_root"), (~owned, "not_owned"))


def retry_mode(failed: Column, in_review: Column, selected: Column) -> Column:
    """Why a row is tried again; null if it isn't."""
    return F.when(failed, "failed").when(in_review, "needs_review").when(selected, "selected")


def changed_fields(**changed: Column) -> Column:
    """Names of the fields that a review has changed, in the order given."""
    return codes(*changed.items())


def class_from_id(name: Column, classes: tuple[str, ...]) -> Column:
    """The class that stands before the number at the end of an id; empty if it is none of ``classes``."""
    return F.regexp_extract(name, f"(?:^|_)({'|'.join(classes)})_[0-9a-f]+$", 1)


def severity(value: Column, medium: float, high: float) -> Column:
    """Low, medium or high by two thresholds; low where there is no value."""
    return ladder("low", (value >= high, "high"), (value >= medium, "medium"))


def json_number(text: Column, field: str) -> Column:
    """A whole number in a JSON text; null if it is not there."""
    return F.get_json_object(text, f"$.{field}").cast("long")


def expected_action(category: Column, recognized: tuple[str, ...]) -> Column:
    """What should be done with a sample of a category."""
    return F.when(category.isin(*recognized), "recognize").otherwise("reject")


def annotation_error(inside: Column, known: Column, whole: Column) -> Column:
    """The first thing wrong with an annotated box; null if nothing is."""
    return F.when(~inside, "outside_page").when(~known, "unknown_class").when(~whole, "incomplete")


def may_be_screened_again(by_user: Column, confirmed: Column, recognized: Column, deleted: Column) -> Column:
    """Whether a region may be screened anew: nobody made, confirmed, recognised or deleted it."""
    return ~(by_user | confirmed | recognized | deleted)
