"""ViewSpec: the public argument of every view.

A frozen description of what to show. ``resolve`` fills defaults from the
period catalogue (tens of rows, the only data that reaches the driver) and
normalises wind / segment choices before any plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .. import catalog as C

MODES = ("rank", "share", "series")
WINDS = ("all", "incl", "excl")
TRANSFORMS = ("abs", "qoq", "yoy")
BASES = ("position", "calendar")


@dataclass(frozen=True)
class ViewSpec:
    mode: str = "rank"
    metric: str = "tiv"
    wind: str = "all"
    line: str = "all"
    wind_only: bool = False
    segments: tuple[str, ...] = ()
    period: str | None = None
    period_from: str | None = None
    period_to: str | None = None
    entities: tuple[str, ...] = ()
    scale: str | int = "auto"
    topn: int | None = 20  # None: all
    transform: str = "abs"
    basis: str = "position"
    sort_col: str | None = None
    sort_dir: int = -1

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.wind not in WINDS:
            raise ValueError(f"wind must be one of {WINDS}")
        if self.transform not in TRANSFORMS:
            raise ValueError(f"transform must be one of {TRANSFORMS}")
        if self.basis not in BASES:
            raise ValueError(f"basis must be one of {BASES}")
        if self.topn is not None and self.topn < 1:
            raise ValueError("topn must be positive, or None for all")
        C.metric(self.metric)
        object.__setattr__(self, "segments", tuple(self.segments))
        object.__setattr__(self, "entities", tuple(self.entities))

    @property
    def metric_info(self) -> C.Metric:
        return C.metric(self.metric)

    def with_(self, **kw) -> "ViewSpec":
        return replace(self, **kw)


def period_sort_key(p: str) -> int:
    return int(p[:4]) * 10 + int(p[-1])


def resolve(spec: ViewSpec, periods: list[str], segment_lines: dict[str, str] | None = None,
            range_len: int = 9) -> ViewSpec:
    """P10 defaults + P3/P13 normalisation.

    * snapshot period defaults to the latest; range to the last ``range_len``
      periods; ends of a reversed range are swapped (P4);
    * wind is reset to 'all' for metrics without the split (P3);
    * a chosen segment outside the chosen line is an error, not silently ignored.
    """
    ordered = sorted(periods, key=period_sort_key)
    if not ordered:
        raise ValueError("no periods in the data")
    kw = {}
    if spec.period is None:
        kw["period"] = ordered[-1]
    if spec.period_from is None:
        kw["period_from"] = ordered[max(0, len(ordered) - range_len)]
    if spec.period_to is None:
        kw["period_to"] = ordered[-1]
    a = kw.get("period_from", spec.period_from)
    b = kw.get("period_to", spec.period_to)
    if period_sort_key(a) > period_sort_key(b):
        kw["period_from"], kw["period_to"] = b, a
    m = spec.metric_info
    if not m.wind or m.derived:
        kw["wind"] = "all"
    if segment_lines is not None and spec.line != "all":
        outside = [s for s in spec.segments if segment_lines.get(s) != spec.line]
        if outside:
            raise ValueError(f"segments outside line {spec.line!r}: {outside}")
    return spec.with_(**kw) if kw else spec


def context_rows(spec: ViewSpec, wind_applied: str | None = None) -> list[tuple[str, str]]:
    """The fields that shape the view, as (name, text) pairs.

    Mode and metric always; then every field that differs from its default. Fields of the
    other kind of view (a snapshot's or a series') are left out.
    """
    only = {"series": ("period_from", "period_to", "entities", "transform", "basis"),
            "snapshot": ("period", "topn", "sort_col", "sort_dir")}
    hidden = only["snapshot" if spec.mode == "series" else "series"]
    plain = ViewSpec()
    rows = [("mode", spec.mode), ("metric", spec.metric_info.label)]
    for f in fields(spec):
        value = getattr(spec, f.name)
        if f.name in ("mode", "metric") or f.name in hidden or value == getattr(plain, f.name):
            continue
        rows.append((f.name, ", ".join(map(str, value)) if isinstance(value, tuple)
                     else "all" if value is None else str(value)))
    if wind_applied is not None and spec.wind != plain.wind:
        rows.append(("wind column", wind_applied))
    return rows


def context_frame(spark, spec: ViewSpec, wind_applied: str | None = None):
    """P11 as a small DataFrame (name, text) to ship beside a view."""
    return spark.createDataFrame(context_rows(spec, wind_applied), "name string, text string")


def change(spec: ViewSpec, **kw) -> ViewSpec:
    """A user change with the view's state rules applied.

    A new line clears the chosen segments; a new mode or metric clears the
    column sort; a metric without the wind split resets wind to 'all'.
    """
    if "line" in kw and kw["line"] != spec.line and "segments" not in kw:
        kw["segments"] = ()
    if (("mode" in kw and kw["mode"] != spec.mode)
            or ("metric" in kw and kw["metric"] != spec.metric)) and "sort_col" not in kw:
        kw["sort_col"] = None
    new = spec.with_(**kw)
    m = new.metric_info
    if (not m.wind or m.derived) and new.wind != "all":
        new = new.with_(wind="all")
    return new
