"""From landed pages to review rows ready for the merge."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.operators.crawl import CRAWL_ORDER, apply_early_stop, fold_versions
from echolens.operators.merge import REVIEW_UPDATES
from echolens.operators.normalize import normalize_reviews
from echolens.operators.validate import STORED_RULES, review_rules, split
from echolens.sources.readers import explode_pages

ORDINALS = ("app_ord", "sort_ord", "country_ord", "page", "pos")


class Collected(NamedTuple):
    accepted: DataFrame
    quarantined: DataFrame


def check_reviews(raw: DataFrame, strict: bool = False) -> Collected:
    """Normalise and validate raw review rows. Rows that would not store go to quarantine.

    What stores is what the review table accepts; ``strict`` asks for all rules of the review model (such as the form
    of a URL) instead.
    """
    return Collected(*split(normalize_reviews(raw), review_rules() if strict else STORED_RULES["reviews"]()))


def collect_reviews(pages: DataFrame, strict: bool = False) -> Collected:
    """Early stop, normalise, validate. ``accepted`` still holds every appearance of a review."""
    return check_reviews(explode_pages(apply_early_stop(pages)), strict)


def reviews_to_store(accepted: DataFrame, order: Sequence[str] = CRAWL_ORDER) -> DataFrame:
    """One row per review id, the outcome of storing app after app in job order."""
    fixed = [name for name in accepted.columns if name not in ("id", *REVIEW_UPDATES, *ORDINALS, "sort_method")]
    return fold_versions(accepted, "id", ["app_ord"], order, REVIEW_UPDATES, fixed)


def app_order(jobs: DataFrame) -> DataFrame:
    """(app_id, app_ord): the place of each app's first job, from a ``job_ord`` column."""
    return jobs.groupBy("app_id").agg(F.min("job_ord").alias("app_ord"))
