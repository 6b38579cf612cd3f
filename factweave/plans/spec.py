"""Source layouts and metric registries (TOML), checked when loaded."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

SCHEMA_VERSION = 2
METRIC_TYPES = ("count", "rate", "continuous")
STATISTICS = ("count", "sum", "rate", "mean")
UNITS = ("usd", "percent", "count")
DIRECTIONS = ("up_is_good", "down_is_good")


class RegistryError(ValueError):
    """The registry can't be used as it is."""


@dataclass(frozen=True)
class SourceSpec:
    """Columns of a table of daily cells."""

    dims: tuple[str, ...]
    measures: tuple[str, ...] = ("sessions", "orders", "gmv")
    date: str = "date"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.date, *self.dims, *self.measures)


@dataclass(frozen=True)
class Metric:
    id: str
    title: str
    metric_type: str
    statistic: str
    numerator_field: str
    unit: str
    display_precision: int
    denominator_field: str | None = None
    n_obs_field: str = "sessions"
    direction: str = "up_is_good"
    required: bool = False
    cuts: tuple[str, ...] = ()

    @property
    def is_ratio(self) -> bool:
        return self.statistic in ("rate", "mean")

    @property
    def is_additive(self) -> bool:
        return not self.is_ratio

    @property
    def tolerance(self) -> float:
        return 0.5 * 10.0**-self.display_precision

    @property
    def formula(self) -> str:
        if self.is_additive:
            return f"SUM({self.numerator_field}) over the period"
        factor = "100 * " if self.statistic == "rate" else ""
        return f"{factor}SUM({self.numerator_field}) / SUM({self.denominator_field}) over the period"


@dataclass(frozen=True)
class Registry:
    metrics: tuple[Metric, ...]
    sha256: str = ""

    @cached_property
    def by_id(self) -> dict[str, Metric]:
        return {m.id: m for m in self.metrics}

    def check(self, spec: SourceSpec) -> "Registry":
        """Unknown fields or dimensions would silently count as nothing, so they are refused."""
        for m in self.metrics:
            fields = {m.numerator_field, m.n_obs_field} | ({m.denominator_field} if m.denominator_field else set())
            if unknown := sorted(fields - set(spec.measures)):
                raise RegistryError(f"{m.id}: {', '.join(unknown)} is no measure of the source")
            if unknown := sorted(set(m.cuts) - set(spec.dims)):
                raise RegistryError(f"{m.id}: {', '.join(unknown)} is no dimension of the source")
        return self


def parse_metric(raw: dict, place: int) -> Metric:
    name = raw.get("id") or f"metric {place}"
    needed = ("id", "title", "metric_type", "statistic", "numerator_field", "unit", "display_precision")
    if missing := [k for k in needed if raw.get(k) in (None, "")]:
        raise RegistryError(f"{name}: missing {', '.join(missing)}")
    if unknown := sorted(set(raw) - set(Metric.__dataclass_fields__)):
        raise RegistryError(f"{name}: unknown field {', '.join(unknown)}")
    for key, known in (("metric_type", METRIC_TYPES), ("statistic", STATISTICS), ("unit", UNITS), ("direction", DIRECTIONS)):
        if key in raw and raw[key] not in known:
            raise RegistryError(f"{name}: {key} {raw[key]!r} is none of {', '.join(known)}")
    metric = Metric(**{**raw, "cuts": tuple(raw.get("cuts", ()))})
    precision = metric.display_precision
    if not isinstance(precision, int) or isinstance(precision, bool) or precision < 0:
        raise RegistryError(f"{name}: display_precision must be a whole number of at least 0")
    if metric.is_ratio != (metric.denominator_field is not None):
        raise RegistryError(f"{name}: a {metric.statistic} {'needs' if metric.is_ratio else 'takes no'} denominator_field")
    if (metric.metric_type == "rate") != (metric.statistic == "rate"):
        raise RegistryError(f"{name}: metric type and statistic must be rate together")
    if len(set(metric.cuts)) < len(metric.cuts):
        raise RegistryError(f"{name}: a cut is named twice")
    return metric


def parse_registry(raw: dict, sha256: str = "") -> Registry:
    if raw.get("schema_version") != SCHEMA_VERSION:
        raise RegistryError(f"schema_version must be {SCHEMA_VERSION}")
    metrics = tuple(parse_metric(m, i) for i, m in enumerate(raw.get("metric", [])))
    if not metrics:
        raise RegistryError("no metric is defined")
    if len({m.id for m in metrics}) < len(metrics):
        raise RegistryError("a metric id is used twice")
    return Registry(metrics, sha256)


def load_registry(path: str | Path) -> Registry:
    try:
        data = Path(path).read_bytes()
        return parse_registry(tomllib.loads(data.decode()), hashlib.sha256(data).hexdigest())
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise RegistryError(f"{path}: {e}") from e


def shop_registry(*cuts: str) -> Registry:
    """The five shop metrics over the given dimensions."""
    return Registry((
        Metric("gmv", "GMV", "continuous", "sum", "gmv", "usd", 0, None, "orders", required=True, cuts=cuts),
        Metric("orders", "Orders", "count", "count", "orders", "count", 0, None, "orders", required=True, cuts=cuts),
        Metric("sessions", "Sessions", "count", "count", "sessions", "count", 0, None, "sessions", cuts=cuts),
        Metric("conversion_rate", "Conversion rate", "rate", "rate", "orders", "percent", 2, "sessions", "sessions", required=True, cuts=cuts),
        Metric("aov", "Average order value", "continuous", "mean", "gmv", "usd", 2, "orders", "orders", cuts=cuts),
    ))
