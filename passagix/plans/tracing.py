"""Spans: what ran, for which query, and how long."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from passagix.sources.store import put_text

SHOWN = 200  # characters of a query that a span keeps


@dataclass
class Span:
    name: str
    query: str | None = None
    attributes: dict = field(default_factory=dict)
    ms: float = 0.0


@dataclass
class Tracer:
    """Collects spans. Give each search its own, or one to several."""

    spans: list[Span] = field(default_factory=list)

    @contextmanager
    def span(self, name: str, query: str | None = None, **attributes) -> Iterator[Span]:
        """A span around a block; its time is kept when the block ends, by an error too."""
        s = Span(name, query[:SHOWN] if query is not None else None, dict(attributes))
        began = time.perf_counter()
        try:
            yield s
        except Exception as e:
            s.attributes["error"] = type(e).__name__
            raise
        finally:
            s.ms = (time.perf_counter() - began) * 1000
            self.spans.append(s)

    def record(self, name: str, ms: float, query: str | None = None, **attributes) -> None:
        """A span of something that was timed elsewhere."""
        self.spans.append(Span(name, query[:SHOWN] if query is not None else None, dict(attributes), ms))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, query, ms)."""
        return spark.createDataFrame([(s.name, s.query, s.ms) for s in self.spans], "stage string, query string, ms double")

    def export(self, spark: SparkSession, path: str) -> int:
        """Writes the spans so far as JSON lines and forgets them; how many there were."""
        batch, self.spans = self.spans, []
        put_text(spark, path, "".join(json.dumps({"name": s.name, "query": s.query, "duration_ms": round(s.ms, 2), "attributes": s.attributes}, sort_keys=True) + "\n" for s in batch))
        return len(batch)
