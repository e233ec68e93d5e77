"""What a run returns, and how it is run."""

from __future__ import annotations

import enum
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger("orrery")


class ErrorPolicy(str, enum.Enum):
    RAISE = "raise"
    COLLECT = "collect"
    COLLECT_PARTIAL = "collect_partial"


class Status(str, enum.Enum):
    OK = "ok"
    FAILED = "failed"


@dataclass(frozen=True)
class RunOptions:
    """``progress``: None, "run", "node", or a callable that gets a line of text for each event. ``cache``: a dict that keeps values by snapshot and signature from run to run. ``record``: "all" nodes or "outputs" only."""

    errors: ErrorPolicy | str = ErrorPolicy.RAISE
    progress: str | Callable[[str], None] | None = None
    perf_time: bool = True
    cache: dict[tuple[int, str], Any] | None = None
    record: str = "all"

    def __post_init__(self) -> None:
        if self.record not in ("all", "outputs"):
            raise ValueError(f"record {self.record!r} is neither all nor outputs")

    def kept(self, snap: Any, signature: str, make: Callable[[], Any]) -> tuple[Any, bool]:
        """A value from the cache, or made and put there; and whether it was there. A snapshot is told by its frame, which the cache holds on to."""
        if self.cache is None:
            return make(), False
        key = (id(snap.df), signature)
        if key not in self.cache:
            self.cache[key] = (make(), snap.df)
            return self.cache[key][0], False
        return self.cache[key][0], True

    def tell(self, level: str, text: str) -> None:
        if callable(self.progress):
            self.progress(text)
        elif self.progress == "node" or (self.progress == "run" and level == "run"):
            log.info(text)


@dataclass
class Result:
    """A node of the result tree: its public value, its status, the seconds of its job, and its parts."""

    name: str
    value: Any = None
    signature: str = ""
    status: Status = Status.OK
    error: BaseException | None = None
    seconds: float = 0.0
    cached: bool = False
    parts: list[Result] = field(default_factory=list)

    def walk(self) -> Iterator[Result]:
        yield self
        for p in self.parts:
            yield from p.walk()

    def find(self, name: str) -> list[Result]:
        return [n for n in self.walk() if n.name == name]

    def get(self, name: str, default: Any = None) -> Any:
        found = self.find(name)
        return found[0].value if found else default

    def __getitem__(self, name: str) -> Any:
        found = self.find(name)
        if not found:
            raise KeyError(name)
        return found[0].value

    def children(self) -> list[str]:
        return [p.name for p in self.parts]

    @property
    def ok(self) -> bool:
        return all(n.status is Status.OK for n in self.walk())

    def tree(self, depth: int = 0) -> str:
        line = "  " * depth + f"{self.name} [{self.status.value}] {'cached' if self.cached else f'{self.seconds * 1e3:.1f} ms'}"
        return "\n".join([line, *(p.tree(depth + 1) for p in self.parts)])

    def report(self) -> str:
        return f"{sum(1 for _ in self.walk())} nodes\n{self.tree()}"


class Clock:
    def __enter__(self) -> Clock:
        self.began, self.seconds = time.perf_counter(), 0.0
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.perf_counter() - self.began
