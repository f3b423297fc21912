"""Trying a step: what every step above it gave out, seen while the step itself runs once.

Each step's records pass an ``Observation`` that counts them and keeps a few of the newest, so
the counts and samples of all steps come from one pass, not from a job for each. A step's
sample is bounded: the newest record of each of ``keep`` parts of the records."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.plans.engine import Err, Run, run_flow
from millrace.plans.graph import Graph, parse_graph
from millrace.sources.records import EventStore

TRIAL = "step string, state string, error string, records long, sample array<string>"
_SHOWN = ("id", "source", "eventType", "subject", "occurredAt", "value")
#: Settings that hold one field path.
_PATHS = ("field", "valueField", "distinctField", "breakdownField", "dateField", "keyField", "startField", "endField", "dedupeField", "dedupeOrderField", "lookupField")


@dataclass
class Trial:
    """``run`` has the step's own result; ``seen`` is full once its records have been read."""

    run: Run
    step: str
    seen: dict[str, Observation]
    keep: int
    session: SparkSession

    def _metrics(self, name: str) -> dict:
        """What a step's observation has; nothing if its records were not read (``Observation.get`` would wait for them)."""
        found = self.seen.get(name)
        return found.get if found is not None and found._jo.getRowOrEmpty().isDefined() else {}

    def rows(self) -> DataFrame:
        """step, state, error, records, sample of each step, the tried one last. A step whose records
        nobody asked for while the last one ran has no count."""
        out = []
        self.session.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # metrics come with the end of a job
        for name, found in self.run.results.items():
            if isinstance(found, Err):
                out.append((name, "error", found.message, None, None))
                continue
            got = self._metrics(name)
            sample = sorted((got[k] for k in (f"newest_{i}" for i in range(self.keep)) if got.get(k) is not None), key=lambda r: r["ord"], reverse=True)
            out.append((name, "ok", None, got.get("records"), [r["record"] for r in sample] if got else None))
        return self.session.createDataFrame(out, TRIAL)  # a row for each step


def trial(store: EventStore, graph: Graph | dict, step: str, now: datetime | None = None, keep: int = 3) -> Trial:
    """The graph up to a step, with every step's records observed. Read ``Trial.run.df(step)`` once, or
    call ``tried``, and then ask for the rows."""
    seen: dict[str, Observation] = {}

    def watch(name: str, df: DataFrame) -> DataFrame:
        seen[name] = Observation(f"step {name}")
        record = F.to_json(F.struct(*_SHOWN))
        newest = [F.max(F.when(F.pmod(F.xxhash64("id"), F.lit(keep)) == i, F.struct(F.struct("occurredAt", "id").alias("ord"), record.alias("record")))).alias(f"newest_{i}") for i in range(keep)]
        return df.observe(seen[name], F.count(F.lit(1)).alias("records"), *newest)

    return Trial(run_flow(store, graph, now, step, watch), step, seen, keep, store.df.sparkSession)


def tried(store: EventStore, graph: Graph | dict, step: str, now: datetime | None = None, keep: int = 3) -> DataFrame:
    """Runs the step once and gives the rows of its trial."""
    found = trial(store, graph, step, now, keep)
    if not isinstance(found.run.results.get(step), Err):
        found.run.df(step).write.format("noop").mode("overwrite").save()
    return found.rows()


def saved_paths(graph: Graph | dict) -> set[str]:
    """Every field path that a step or a metric of the graph has saved; a list of fields must show these."""
    g = graph if isinstance(graph, Graph) else parse_graph(graph)
    rules = lambda c: [r.get(k) for r in (c or {}).get("rules") or [] for k in ("field", "valueField")]
    found = [m.get("timeField") for m in g.metrics]
    for c in (n.config for n in g.nodes.values()):
        found += [c.get(k) for k in _PATHS] + [(c.get("dateRange") or {}).get("dateField"), (c.get("groupBy") or {}).get("field"), *rules(c)]
        found += [x for part in (*(c.get("paths") or []), *(c.get("categories") or [])) for x in rules(part.get("filters"))]
    return {x for x in found if isinstance(x, str) and x and not x.startswith("__")}
