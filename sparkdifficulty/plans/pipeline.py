"""Characterise, score, profile and advise, in one run."""

from __future__ import annotations

import gc
import logging
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import BinaryDataset
from ..functions import scoring
from ..operators import measures as m
from ..operators.neighbours import nearest_each, tagged, with_labels
from ..preprocessing import SCALINGS, preprocess
from ..result import DifficultyResult, DimensionResult
from ..storage import discard
from . import subsampling as sub

logger = logging.getLogger(__name__)

#: Rows of a task, as what a task does grows with its rows times all.
TASK_ROWS = 2500


def first_of(found: DataFrame, k: int) -> DataFrame:
    """(row_id, nbrs, dists) with the first k neighbours of wanted()."""
    return found.where(F.col("want") == m.ANY).select("row_id", F.slice("nbrs", 1, k).alias("nbrs"), F.slice("dists", 1, k).alias("dists"))


@dataclass(kw_only=True)
class DifficultyPipeline:
    """All parameters; they are checked before anything runs.

    n_jobs, chunk_size and algorithm are accepted and recorded for callers that set them; Spark decides these.
    """

    weights: tuple[float, ...] = scoring.WEIGHTS
    random_state: int = 42
    scaling: str = "standard"
    n_max: int = 50_000
    n_subsamples: int = 5
    n_jobs: int | None = None
    k_neighbors: int = m.K
    dbscan_min_samples: int = m.MIN_SAMPLES
    dbscan_eps: float | None = None
    svc_max_iter: int = m.SVC_ITER
    svc_tol: float = m.SVC_TOL
    d2_weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)
    tau: float = scoring.TAU
    tau_prime: float = scoring.TAU_PRIME
    chunk_size: int = 65_536
    algorithm: str = "auto"
    metadata: dict[str, Any] = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        scoring.check_weights(self.weights)
        sub.check_seed(self.random_state)
        if self.scaling not in SCALINGS:
            raise ValueError(f"scaling is one of {SCALINGS}")
        if self.algorithm not in ("auto", "ball_tree", "kd_tree", "brute"):
            raise ValueError("algorithm is auto, ball_tree, kd_tree or brute")
        if self.n_max < 10 or self.n_subsamples < 1 or self.k_neighbors < 1:
            raise ValueError("n_max must be at least 10, n_subsamples and k_neighbors at least 1")
        if abs(sum(self.d2_weights) - 1) > 1e-9:
            raise ValueError("the three weights of D2 must sum to 1")

    def dimensions(self, data: BinaryDataset) -> list[DimensionResult]:
        began = time.perf_counter()
        took: dict[str, float] = {}

        def timed(name: str, run):  # noqa: ANN001, ANN202
            at = time.perf_counter()
            out = run()
            took[name] = took.get(name, 0.0) + time.perf_counter() - at
            return out

        data, info = timed("preprocessing", lambda: preprocess(data, self.scaling))
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        def spread(data: BinaryDataset) -> BinaryDataset:
            tasks = -(-data.n // TASK_ROWS)
            return data.with_features(hold(data.rows.repartition(tasks) if tasks > 1 else data.rows), data.d)

        data = spread(data)
        draws = data.n > self.n_max
        k = min(self.k_neighbors, data.n - 1)
        found = None if draws else m.wanted(data, k)  # without draws D2 and D7 share the neighbours of all rows
        nearby = nearest_each(tagged(data.minority()), tagged(data.rows), [(k, "any")], now=True) if draws else first_of(found, k)
        labelled = hold(with_labels(nearby, data.rows))
        d1 = timed("D1", lambda: sub.folded([m.d1(data)], [], data.n))
        d5 = timed("D5", lambda: sub.folded([m.d5(data)], [], data.n))
        d6 = timed("D6", lambda: sub.folded([m.d6(data)], [], data.n))
        d3 = timed("D3", lambda: sub.folded([m.d3(data, labelled, self.k_neighbors)], [], data.n))
        d3.metadata["n_queries"] = data.n_minority
        seeds = [sub.derive_seed(self.random_state, sub.STREAM_BOTH, i) for i in range(self.n_subsamples)] if draws else []
        d2s, d7s, used = [], [], data
        classes = tuple(hold(c) for c in sub.numbered_classes(data)) if draws else None
        whole = len(held)
        for seed in seeds or [None]:
            shared, near = labelled, found
            if seed is not None:
                used = spread(sub.stratified(data, self.n_max, seed, classes))
                near = m.wanted(used, self.k_neighbors)
                shared = with_labels(first_of(near, min(self.k_neighbors, used.n - 1)), used.rows)
            d2s.append(timed("D2", lambda used=used, shared=shared, near=near: m.d2(used, shared, self.k_neighbors, self.d2_weights, near)))
            d7s.append(timed("D7", lambda used=used, near=near: m.d7(used, self.svc_max_iter, self.svc_tol, self.random_state, near)))
            while len(held) > whole:  # a draw is done with
                held.pop().unpersist()
            if hasattr(near, "materialized_at") and draws:
                discard(near)
            gc.collect()  # frames, and the broadcasts that they hold on to
        d2, d7 = sub.folded(d2s, seeds, used.n), sub.folded(d7s, seeds, used.n)
        for d in (d2, d7):
            d.metadata["n_minority_used"] = used.n_minority
        few = data.n_minority > self.n_max
        seeds4 = [sub.derive_seed(self.random_state, sub.STREAM_MINORITY, i) for i in range(self.n_subsamples)] if few else []
        parts = [sub.minority_draw(data, self.n_max, s) for s in seeds4] or [data]
        d4 = timed("D4", lambda: sub.folded([m.d4(p, self.dbscan_min_samples, self.dbscan_eps) for p in parts], seeds4, parts[0].n_minority))
        for df in held:
            df.unpersist()
        out = [d1, d2, d3, d4, d5, d6, d7]
        for d in out:
            d.metadata["time_seconds"] = took[d.dimension_id]
        lost = sum(not r.components["converged"] for r in d7s)
        if lost:
            logger.warning("%d of %d linear fits did not converge", lost, len(d7s))
        self.metadata = {
            **{k: getattr(self, k) for k in ("random_state", "scaling", "n_max", "n_subsamples", "k_neighbors", "svc_max_iter", "svc_tol", "algorithm", "chunk_size")},
            **{"algorithm_resolved": "blocked", "N": data.n, "d": data.d, "n_minority": data.n_minority, "n_majority": data.n_majority, "IR": data.ir},
            **{"minority_label": data.minority_label, "majority_label": data.majority_label, "minority_is_majority": data.minority_is_majority},
            **{"preprocessing": info, "l1_fits": len(d7s), "l1_not_converged": lost, "time_seconds": took | {"total": time.perf_counter() - began}},
        }
        return out

    def score(self, data: BinaryDataset) -> DifficultyResult:
        """Dimensions, score and profile; no advice."""
        score = scoring.difficulty_score(self.dimensions(data), self.weights)
        return DifficultyResult(data.name, score, scoring.profile(score, self.tau, self.tau_prime), None, self.metadata)

    def run(self, data: BinaryDataset) -> DifficultyResult:
        result = self.score(data)
        result.action = scoring.action(result.profile, result.score, data.n, data.ir)
        return result
