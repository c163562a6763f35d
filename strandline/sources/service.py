"""A catalogue service as a Spark data source: pages of dates are partitions, and filters become the service's own query."""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from strandline.sources.catalogue import ENTRIES, PAGE, retried

#: Entries with their time and the extent of their footprint in degrees.
SCENES = f"{ENTRIES}, acq_ts timestamp, x_min double, x_max double, y_min double, y_max double"
#: Missions that are asked for unless others are named.
MISSIONS = ("L5", "L7", "L8", "L9", "S2")
Box = tuple[float, float, float, float]
WORLD: Box = (-180.0, -90.0, 180.0, 90.0)


class Service(Protocol):
    """What a service answers: entries of one mission from start to end, both included, whose extents meet a box (west, south, east,
    north). An entry is a dict of SCENES without acq_ts."""

    def count(self, satname: str, start: datetime, end: datetime, box: Box) -> int: ...

    def fetch(self, satname: str, start: datetime, end: datetime, box: Box) -> list[dict]: ...


def service_of(name: str) -> Service:
    """The object that `module:name` names; executors import it by themselves, so its module is installed there or added by addPyFile."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _naive(value: datetime) -> datetime:
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


@dataclass
class Page(InputPartition):
    """A mission's dates from start to end; the end belongs to the last page alone."""

    satname: str
    start: datetime
    end: datetime
    last: bool


class SceneReader(DataSourceReader):
    """Filters on mission, time and extent narrow what is asked; Spark applies them again, so a service may answer with more."""

    def __init__(self, options: dict):
        self.service, self.limit = options["service"], int(options.get("limit", PAGE))
        self.missions = [m.strip() for m in options.get("missions", ",".join(MISSIONS)).split(",")]
        self.start, self.end, self.box = datetime.fromisoformat(options["start"]), datetime.fromisoformat(options["end"]), list(WORLD)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            low, high = isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
            if name == "satname" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.missions = [m for m in self.missions if m in asked]
            elif name == "acq_ts" and (low or high):
                value = _naive(f.value)
                self.start, self.end = max(self.start, value) if low else self.start, min(self.end, value) if high else self.end
            elif low and name in ("x_max", "y_max"):  # an extent that ends beyond a place meets what lies beyond it
                k = 0 if name == "x_max" else 1
                self.box[k] = max(self.box[k], f.value)
            elif high and name in ("x_min", "y_min"):
                k = 2 if name == "x_min" else 3
                self.box[k] = min(self.box[k], f.value)
            yield f

    def partitions(self) -> list[Page]:
        service, pages = service_of(self.service), []
        if self.start > self.end or self.box[0] > self.box[2] or self.box[1] > self.box[3]:
            return [Page("", self.start, self.end, True)]
        for mission in self.missions:
            pages += self.pages(service, mission, self.start, self.end, True)
        return pages or [Page("", self.start, self.end, True)]

    def pages(self, service: Service, mission: str, start: datetime, end: datetime, last: bool) -> list[Page]:
        """The range, or its halves where it holds more entries than a page; within a second it isn't cut any further."""
        count = retried(lambda: service.count(mission, start, end, tuple(self.box)))
        if count == 0:
            return []
        if count <= self.limit or end - start <= timedelta(seconds=1):
            return [Page(mission, start, end, last)]
        middle = start + (end - start) / 2
        return self.pages(service, mission, start, middle, False) + self.pages(service, mission, middle, end, last)

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.satname:
            return
        service, p = service_of(self.service), partition
        for entry in retried(lambda: service.fetch(p.satname, p.start, p.end, tuple(self.box))):
            millis = (entry.get("properties") or {}).get("system:time_start")
            at = None if millis is None else datetime.fromtimestamp(int(millis) / 1000, UTC).replace(tzinfo=None)
            if at is None or p.start <= at < p.end or (p.last and at == p.end):
                row = {**entry, "acq_ts": None if at is None else at.replace(tzinfo=UTC)}
                yield tuple(row.get(c) for c in ("satname", "tier", "id", "properties", "bands", "acq_ts", "x_min", "x_max", "y_min", "y_max"))


class SceneCatalogue(DataSource):
    """Format "scene_catalogue". Options: service (module:name), start and end (ISO dates), missions, limit (entries a page)."""

    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return SCENES

    def reader(self, schema) -> SceneReader:
        return SceneReader(dict(self.options))


def catalogue(spark: SparkSession, service: str, start: str, end: str, missions: Sequence[str] = MISSIONS, limit: int = PAGE) -> DataFrame:
    """SCENES of a service from start to end, both included. Each page of at most `limit` entries is a task; an entry comes once, as pages
    own their start and only the last its end. Conditions on satname, acq_ts and the extent (x_max > west AND x_min < east ...) reach the
    service. An entry without a time is in every page that the service gives it in. No mission, an empty range or box: no row."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneCatalogue)
    return spark.read.format("scene_catalogue").options(service=service, start=start, end=end, missions=",".join(missions), limit=limit).load()
