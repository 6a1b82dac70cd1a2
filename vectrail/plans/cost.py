"""The cost model: CPU, IO and memory units of the EXACT and HNSW strategies, and totals."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from functools import total_ordering
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, HNSW = "EXACT", "HNSW"
BALANCED = "BALANCED"
# How a mode weighs each kind of cost, and the sizes that the formulas use.
CPU_MODES = {"LOWEST_LATENCY": 1.5, "LOWEST_MEMORY": 0.8}
IO_MODES = {"LOWEST_IO": 2.0, "LOWEST_MEMORY": 0.5}
MEMORY_MODES = {"LOWEST_MEMORY": 2.0, "LOWEST_LATENCY": 0.5}
MODES = (BALANCED, "LOWEST_LATENCY", "LOWEST_MEMORY", "LOWEST_IO")
QUEUE, PAGE, HEADER, RECORD, PAYLOAD, NODE = 32, 4096, 64, 32, 120, 38
MB = 1024 * 1024


@dataclass(frozen=True)
class Stats:
    """What the planner knows of a collection."""

    collection_size: int = 0
    deleted: int = 0
    dimension: int = 64
    sealed_segments: int = 0
    growing_segments: int = 0
    graph_nodes: int = 0
    graph_layers: int = 0
    average_degree: int = 16
    cache_hits: int = 0
    cache_misses: int = 0

    @property
    def hit_ratio(self) -> float:
        n = self.cache_hits + self.cache_misses
        return self.cache_hits / n if n else 0.0

    @property
    def miss_ratio(self) -> float:
        return 1.0 - self.hit_ratio

    def to_dict(self) -> dict[str, Any]:
        return asdict(self) | {"cache_hit_ratio": self.hit_ratio, "cache_miss_ratio": self.miss_ratio}


class CostProvider(Protocol):
    def cost(self, stats: Stats, k: int, selectivity: float = 1.0, mode: str = BALANCED, strategy: str = EXACT) -> float: ...


@dataclass(frozen=True)
class Cpu:
    per_comparison: float = 1.0

    def cost(self, stats: Stats, k: int, selectivity: float = 1.0, mode: str = BALANCED, strategy: str = EXACT) -> float:
        weight = CPU_MODES.get(mode, 1.0) * self.per_comparison
        if strategy == EXACT:
            return max(1, int(stats.collection_size * selectivity)) * weight
        if not stats.graph_nodes:
            return math.inf
        steps = (stats.graph_layers * stats.average_degree + QUEUE) * stats.average_degree
        detour = max(1.0, 1.0 / max(0.01, selectivity)) if selectivity < 1 else 1.0
        return steps * detour * weight


@dataclass(frozen=True)
class Io:
    sequential: float = 1.0
    random: float = 4.0
    miss_penalty: float = 2.5

    def pages(self, stats: Stats) -> int:
        return max(1, math.ceil((HEADER + stats.collection_size * (RECORD + 4 * stats.dimension + PAYLOAD)) / PAGE))

    def cost(self, stats: Stats, k: int, selectivity: float = 1.0, mode: str = BALANCED, strategy: str = EXACT) -> float:
        weight = IO_MODES.get(mode, 1.0) * stats.miss_ratio
        if strategy == EXACT:
            return self.pages(stats) * selectivity * self.sequential * weight
        if not stats.graph_nodes:
            return math.inf
        return min(self.pages(stats), stats.graph_layers * stats.average_degree + QUEUE) * self.random * self.miss_penalty * weight


@dataclass(frozen=True)
class Memory:
    scale: float = 1.0

    def cost(self, stats: Stats, k: int, selectivity: float = 1.0, mode: str = BALANCED, strategy: str = EXACT) -> float:
        weight = MEMORY_MODES.get(mode, 1.0) * self.scale / MB
        if strategy == EXACT:
            return max(0, int(stats.collection_size * selectivity)) * (4 * stats.dimension + PAYLOAD + 4) * weight
        if not stats.graph_nodes:
            return math.inf
        node = NODE + 8 * stats.average_degree + 4 * stats.dimension
        return (stats.graph_nodes * node + max(1, stats.graph_nodes // 8) + QUEUE * 24) * weight


@total_ordering
@dataclass(frozen=True, eq=False)
class CostEstimate:
    """Costs of one plan; compared by the total."""

    cpu: float = 0.0
    graph: float = 0.0
    io: float = 0.0
    memory: float = 0.0
    confidence: float = 1.0
    assumptions: dict[str, Any] = field(default_factory=dict)

    @property
    def total(self) -> float:
        return self.cpu + self.graph + self.io + self.memory

    def __eq__(self, other) -> bool:
        return isinstance(other, CostEstimate) and self.total == other.total

    def __lt__(self, other) -> bool:
        return self.total < other.total

    def __hash__(self) -> int:
        return hash(self.total)

    def breakdown(self) -> dict[str, float]:
        """Shares of the total."""
        t = self.total
        parts = {"cpu": self.cpu, "graph": self.graph, "io": self.io, "memory": self.memory}
        return {k: v / t if t and math.isfinite(t) else 0.0 for k, v in parts.items()}

    def to_dict(self) -> dict[str, Any]:
        return {"cpu": self.cpu, "graph": self.graph, "io": self.io, "memory": self.memory, "total": self.total, "confidence": self.confidence, "assumptions": dict(self.assumptions)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def to_markdown(self) -> str:
        rows = "\n".join(f"| {k} | {v:.3f} | {self.breakdown()[k]:.1%} |" for k, v in (("cpu", self.cpu), ("graph", self.graph), ("io", self.io), ("memory", self.memory)))
        return f"| cost | units | share |\n| --- | --- | --- |\n{rows}\n| total | {self.total:.3f} | |\n\nConfidence {self.confidence:.2f}."

    def with_assumptions(self, **more: Any) -> CostEstimate:
        return replace(self, assumptions=self.assumptions | more)


@dataclass(frozen=True)
class CostEstimator:
    cpu: CostProvider = Cpu()
    io: CostProvider = Io()
    memory: CostProvider = Memory()

    def estimate(self, stats: Stats, k: int, selectivity: float = 1.0, mode: str = BALANCED, strategy: str = EXACT) -> CostEstimate:
        args = (stats, k, selectivity, mode, strategy)
        cpu = self.cpu.cost(*args)
        own, graph = (cpu * 0.6, cpu * 0.4) if strategy == HNSW else (cpu, 0.0)
        confidence = 0.3 if not stats.collection_size else 0.5 if stats.sealed_segments and not stats.graph_nodes else 1.0
        return CostEstimate(own, graph, self.io.cost(*args), self.memory.cost(*args), confidence, {"strategy": strategy, "mode": mode, "selectivity": selectivity, "k": k})


def cost_columns(stats: DataFrame) -> DataFrame:
    """The same model as rows: each row of statistics with each mode, strategy and selectivity of its own.

    ``stats`` has collection_size, dimension, graph_nodes, graph_layers, average_degree, miss_ratio, selectivity.
    """
    rows = stats.withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn("strategy", F.explode(F.array(F.lit(EXACT), F.lit(HNSW))))

    def weight(modes: dict[str, float]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in modes.items() for x in (F.lit(k), F.lit(v)))), F.col("mode")), F.lit(1.0))

    n, dim, nodes, deg, sel = (F.col(c) for c in ("collection_size", "dimension", "graph_nodes", "average_degree", "selectivity"))
    exact, none = F.col("strategy") == EXACT, F.lit(math.inf)
    hops = F.col("graph_layers") * deg + QUEUE
    pages = F.greatest(F.lit(1), F.ceil((HEADER + n * (RECORD + 4 * dim + PAYLOAD)) / F.lit(float(PAGE))))
    seen = F.floor(n * sel)
    detour = F.when(sel < 1, F.greatest(F.lit(1.0), 1.0 / F.greatest(F.lit(0.01), sel))).otherwise(1.0)
    on_graph = lambda c: F.when(nodes > 0, c).otherwise(none)
    cpu = F.when(exact, F.greatest(F.lit(1), seen).cast("double")).otherwise(on_graph(hops * deg * detour)) * weight(CPU_MODES)
    io = F.when(exact, pages * sel).otherwise(on_graph(F.least(pages, hops) * 4.0 * 2.5)) * F.col("miss_ratio") * weight(IO_MODES)
    memory = F.when(exact, (seen * (4 * dim + PAYLOAD + 4)).cast("double")).otherwise(on_graph(nodes * (NODE + 8 * deg + 4 * dim) + F.greatest(F.lit(1), F.floor(nodes / 8)) + QUEUE * 24)) / F.lit(float(MB)) * weight(MEMORY_MODES)
    out = rows.withColumns({"cpu_cost": F.round(cpu, 6), "io_cost": F.round(io, 6), "memory_cost": F.round(memory, 6)})
    return out.withColumn("total_cost", F.round(F.col("cpu_cost") + F.col("io_cost") + F.col("memory_cost"), 6))
