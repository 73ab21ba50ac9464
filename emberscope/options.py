"""What a caller can ask for: closed sets of values, defaults and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

# Fixed values that requests and results name.
DIMENSIONS = ("function", "file", "package", "context", "overall")
METRICS = ("selfMicros", "totalMicros", "selfSamples", "totalSamples", "selfPct", "totalPct", "selfPctBusy", "totalPctBusy")
SORTS = ("max", "delta", "deltaPct")
CONTEXT_SORTS = ("micros", "pctOfContext")
CATEGORIES = ("native", "node_modules", "user", "idle")
FOCUS = ("all", "callers", "callees", "contexts")

TOP_N, TOP_N_MOST = 25, 100
BLOCK_THRESHOLD_MICROS = 50_000
STACK_FRAMES, STALLS, STITCH_DEPTH, SAMPLE_SIZE = 32, 64, 16, 40
UPLOAD_ENV, UPLOAD_SERVICE, UPLOAD_DATE, UPLOAD_BUILD = "upload", "manual", "uploaded", "upload"
LATEST = "latest"


class BadRequest(ValueError):
    """A value outside its closed set."""


class NotFound(LookupError):
    """No such group, build or entity."""


def one_of(name: str, value: str, allowed: tuple[str, ...], default: str) -> str:
    """``value`` if allowed, the default if empty; else an error that lists what is."""
    if not value:
        return default
    if value not in allowed:
        raise BadRequest(f"invalid {name} {value!r}: must be one of {', '.join(allowed)}")
    return value


def categories_of(values) -> tuple[str, ...] | None:
    """Checked categories; none means all."""
    values = tuple(values or ())
    for v in values:
        one_of("category", v, CATEGORIES, "")
    return values or None


def clamped(top_n: int | None) -> int:
    """The tools' rule for a number of rows: 25 if not positive, at most 100."""
    return TOP_N if not top_n or top_n <= 0 else min(top_n, TOP_N_MOST)


def parsed_top_n(text: str | None) -> int:
    """The routes' rule: 25 unless a whole number that isn't negative is given; 0 means all."""
    try:
        n = int(text or "")
    except ValueError:
        return TOP_N
    return n if n >= 0 else TOP_N


@dataclass(frozen=True)
class Window:
    """Members' times, both ends included; None is open."""

    start: datetime | None = None
    end: datetime | None = None

    @staticmethod
    def parse(start: str = "", end: str = "") -> Window:
        def at(name: str, text: str) -> datetime | None:
            if not text:
                return None
            try:
                t = datetime.fromisoformat(text)
            except ValueError as e:
                raise BadRequest(f"invalid {name} {text!r}: must be an RFC 3339 time") from e
            if t.tzinfo is None:
                raise BadRequest(f"invalid {name} {text!r}: must have a time zone")
            return t.astimezone(timezone.utc)

        w = Window(at("from", start), at("to", end))
        if w.start and w.end and w.end < w.start:
            raise BadRequest("'to' is before 'from'")
        return w


@dataclass(frozen=True)
class GroupId:
    env: str
    service: str
    date: str
    build_tag: str

    def __str__(self) -> str:
        return f"{self.env}/{self.service}/{self.date}/{self.build_tag}"


@dataclass(frozen=True)
class CompareOptions:
    dimension: str = "function"
    metric: str = "selfMicros"
    top_n: int = 0
    categories: tuple[str, ...] | None = None
    sort: str = "max"
    window: Window = field(default_factory=Window)

    def __post_init__(self):
        one_of("dimension", self.dimension, DIMENSIONS, "function")
        one_of("metric", self.metric, METRICS, "selfMicros")
        one_of("sort", self.sort, SORTS, "max")
        object.__setattr__(self, "categories", categories_of(self.categories))

    @staticmethod
    def for_tools(dimension="", metric="", top_n=0, categories=(), sort="", start="", end="") -> CompareOptions:
        """The tools' defaults: share of busy time, 25 rows."""
        return CompareOptions(
            one_of("dimension", dimension, DIMENSIONS, "function"), one_of("metric", metric, METRICS, "selfPctBusy"), clamped(top_n),
            categories_of(categories), one_of("sort", sort, SORTS, "max"), Window.parse(start, end),
        )


@dataclass(frozen=True)
class Config:
    """Settings that change results."""

    sample_size: int = SAMPLE_SIZE
    block_threshold_micros: int = BLOCK_THRESHOLD_MICROS
