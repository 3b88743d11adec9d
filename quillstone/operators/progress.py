"""Progress of a run of layers: what each has made, counted by Spark while it writes, told to whoever listens."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillstone.sources.shared import written


class Progress:
    """Runs layers one after the other. A layer's items are counted by observe() in the job that writes them, so nothing is
    computed twice; a layer that fails is recorded and doesn't end the run, and neither does a listener that raises."""

    def __init__(self, expected: list[str], listener: Callable[[dict], None] | None = None):
        self.expected, self.listener, self.entries, self.seconds = expected, listener, [], {}

    def run(self, layer: str, make: Callable[[], DataFrame]) -> DataFrame | None:
        """The layer's rows through a written table; None if it fails."""
        began, seen = time.monotonic(), Observation(f"layer {layer}")
        try:
            out = written(make().observe(seen, F.count(F.lit(1)).alias("items")), f"layer-{layer}")
            items = int(seen.get["items"])
            self._record(layer, "ok" if items else "empty", items, "", began)
            return out
        except Exception as e:  # a layer's failure is a result of the run
            self._record(layer, "failed", 0, f"{type(e).__name__}: {e}"[:200], began)
            return None

    def _record(self, layer: str, status: str, items: int, detail: str, began: float) -> None:
        self.entries.append({"layer": layer, "status": status, "items": items, "detail": detail})
        self.seconds[layer] = round(time.monotonic() - began, 1)
        if self.listener:
            try:
                self.listener({"done": [e["layer"] for e in self.entries], "expected": self.expected, "last": self.entries[-1], "fraction": self.fraction})
            except Exception:  # listening never ends a run
                pass

    @property
    def fraction(self) -> float:
        return round(min(1.0, len({e["layer"] for e in self.entries}) / max(1, len(self.expected))), 2)

    @property
    def failed(self) -> list[str]:
        return [e["layer"] for e in self.entries if e["status"] == "failed"]
