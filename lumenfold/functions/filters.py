"""One filter specification for every query that lists, counts or searches documents.

The same ``Filter`` gives the predicates of a listing, its count, its facets and a search, so that they can't disagree.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXTENSIONS = 40
DEFAULT_PAGE, MAX_PAGE = 50, 200


def parse_extensions(text: str | None) -> list[str]:
    """``".PDF, pdf ,Docx"`` gives ``["pdf", "docx"]``; ``none`` stands for no extension; more than 40 raise."""
    found = dict.fromkeys(x.strip().lstrip(".").lower() for x in (text or "").split(","))
    found.pop("", None)
    if len(found) > MAX_EXTENSIONS:
        raise ValueError(f"at most {MAX_EXTENSIONS} extensions")
    return list(found)


def parse_day(text: str | None) -> datetime.date | None:
    """A calendar day YYYY-MM-DD; anything else raises."""
    if not text:
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a day: {text}")
    return datetime.date.fromisoformat(text)


@dataclass(frozen=True)
class Columns:
    """What the filter's parts are called in a table; None: the table lacks it, and filtering by it raises."""

    owner: str = "owner"
    extension: str | None = "extension"
    day: str | None = "document_date"
    subject_path: str | None = "subject_path"
    location: str | None = "location"
    path: str | None = "path"


@dataclass(frozen=True)
class Filter:
    owner: object
    extensions: Sequence[str] = ()
    day_from: datetime.date | None = None
    day_to: datetime.date | None = None
    subject_path: str | None = None
    location: object | None = None
    path_prefix: str | None = None
    equal: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.owner is None or self.owner == "":
            raise ValueError("an owner is required")
        if self.day_from and self.day_to and self.day_to < self.day_from:
            raise ValueError("the range of days runs backwards")

    def any(self) -> bool:
        """Whether anything besides the owner filters."""
        return bool(self.extensions or self.day_from or self.day_to or self.subject_path or self.location is not None or self.path_prefix or self.equal)

    def predicates(self, names: Columns = Columns()) -> list[Column]:
        """The owner's first. Null days, paths and subjects match no filter on them."""
        out = [F.col(names.owner) == F.lit(self.owner)]
        if self.extensions:
            own = F.lower(names.extension)
            real = [e for e in self.extensions if e != "none"]
            either = [own.isin(*real)] if real else []
            if "none" in self.extensions:
                either.append(own.isNull() | (own == ""))
            out.append(reduce(lambda a, b: a | b, either))
        if self.day_from:
            out.append(F.col(names.day) >= F.lit(self.day_from))
        if self.day_to:
            out.append(F.col(names.day) < F.lit(self.day_to + datetime.timedelta(days=1)))
        if self.subject_path:
            path = F.col(names.subject_path)
            out.append((path == self.subject_path) | path.startswith(f"{self.subject_path}."))
        if self.location is not None:
            out.append(F.col(names.location) == F.lit(self.location))
        if self.path_prefix:
            out.append(F.col(names.path).startswith(self.path_prefix))
        out += [F.col(c) == F.lit(v) for c, v in self.equal.items()]
        return out

    def apply(self, df: DataFrame, names: Columns = Columns()) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, self.predicates(names)))


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of a listing: 50 rows unless told otherwise, 200 at most; a bad offset is 0."""
    size = min(MAX_PAGE, limit) if isinstance(limit, int) and limit > 0 else DEFAULT_PAGE
    skip = offset if isinstance(offset, int) and offset > 0 else 0
    return df.orderBy(*order).offset(skip).limit(size)


def confidence_band(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive at both ends; bounds outside 0 to 1 raise."""
    for bound in (low, high):
        if bound is not None and (isinstance(bound, bool) or not 0 <= bound <= 1):
            raise ValueError("a confidence lies between 0 and 1")
    within = F.lit(True)
    if low is not None:
        within &= F.col(column) >= low
    if high is not None:
        within &= F.col(column) <= high
    return within


def liveness(revoked: Column, is_server: Column, last_seen: Column, now: Column, seconds: int = 120) -> Column:
    """revoked, else a server is online, else never seen, else online if seen in the last two minutes."""
    recent = last_seen > now - F.make_dt_interval(secs=F.lit(seconds))
    return F.when(revoked, "revoked").when(is_server, "online").when(last_seen.isNull(), "never").when(recent, "online").otherwise("offline")
