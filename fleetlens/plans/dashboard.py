"""The dashboard bundle: one costed-runs fact, many views.

Builds the costed runs once, optionally materialises them (reliable
checkpoint into the shared ``spark.checkpoint.dir``, so a lost executor does
not force a rescan of the runs table), and derives every dashboard view from
that single fact. Each view is an independent DataFrame: Catalyst prunes the
columns a view does not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import costing, insights, pricing, summaries
from fleetlens.operators.costing import CostConfig
from fleetlens.session import shared_folder
from fleetlens.sources.store import WorkspaceStore


@dataclass
class Dashboard:
    runs: DataFrame
    jobs: DataFrame
    clusters: DataFrame
    rates: DataFrame
    as_of_ms: int
    window_days: int = 30
    cfg: CostConfig = field(default_factory=CostConfig)
    last_sync_at: str | None = None
    _costed: DataFrame | None = None
    _fused: DataFrame | None = None
    _diagnosed: DataFrame | None = None

    @classmethod
    def from_config(cls, runs, jobs, clusters, pricing_config, as_of_ms, **kw) -> "Dashboard":
        # the last entry of a node type counts, also where it is unpriced
        entries = costing.last_of_each(pricing_config, "node_type_id", kw.get("cfg", CostConfig()))
        return cls(runs, jobs, clusters, pricing.effective_rates(entries), as_of_ms, **kw)

    @classmethod
    def from_store(cls, store: WorkspaceStore, as_of_ms: int, window_days: int = 30, **kw) -> "Dashboard":
        """The dashboard of one commit of a workspace store: jobs, clusters, the
        window's runs, the stored pricing config and the last sync time are all read
        from the same commit."""
        _, state = store.state()
        runs = store.read_runs(costing.window_start(as_of_ms, window_days), state).drop("day")
        meta = store.read("metadata", state)
        config, _ = pricing.decode_config(meta.where(F.col("key") == pricing.CONFIG_KEY))
        last = state.get("last_sync", {}).get("last_sync_at")
        return cls.from_config(runs, store.read("jobs", state), store.read("clusters", state), config, as_of_ms, window_days=window_days, last_sync_at=last, **kw)

    @property
    def window_start_ms(self) -> int:
        return costing.window_start(self.as_of_ms, self.window_days)

    @property
    def costed(self) -> DataFrame:
        if self._costed is None:
            self._costed = costing.cost_runs(
                self.runs, self.jobs, self.clusters, self.rates, self.cfg,
                window_start_ms=self.window_start_ms, carry=("run_page_url",),
            )
        return self._costed

    def materialize(self, path: str | None = None) -> "Dashboard":
        """Write the costed fact as Parquet (default: a new folder under the
        shared ``spark.checkpoint.dir``) and read the views from it: lineage is
        cut, a lost executor re-reads files instead of re-costing, and each
        view prunes the columns it needs from the columnar copy."""
        spark = self.costed.sparkSession
        if path is None:
            path = shared_folder(spark, "costed")
        self.costed.write.mode("errorifexists").parquet(path)
        self._costed = spark.read.parquet(path)
        return self

    def diagnosed(self) -> DataFrame:
        if self._diagnosed is None:
            self._diagnosed = costing.diagnose_runs(
                self.runs, self.jobs, self.clusters, self.rates, self.cfg, window_start_ms=self.window_start_ms
            )
        return self._diagnosed

    def fused(self) -> DataFrame:
        """Job, pipeline and table accumulators from one pass over the costed
        runs, written once to the shared checkpoint folder and reused by every
        view of this bundle."""
        if self._fused is None:
            self._fused = summaries.materialize(summaries.fused_aggregate(self.costed))
        return self._fused

    # views ---------------------------------------------------------------
    # A single view aggregates only its own dimension; once the fused
    # aggregate exists (summary / insights), every view reads it instead.
    def job_summaries(self) -> DataFrame:
        if self._fused is not None:
            return summaries.job_summaries_from(summaries.fused_part(self._fused, summaries.DIM_JOB), self.jobs, self.cfg)
        return summaries.job_summaries(self.costed, self.jobs, self.cfg)

    def pipeline_summaries(self) -> DataFrame:
        if self._fused is not None:
            part = summaries.fused_part(self._fused, summaries.DIM_PIPELINE)
            return summaries.named_summaries_from(part, self.window_days, self.cfg)
        return summaries.named_summaries(self.costed, "pipeline_keys", self.window_days, self.cfg)

    def table_summaries(self) -> DataFrame:
        if self._fused is not None:
            part = summaries.fused_part(self._fused, summaries.DIM_TABLE)
            return summaries.named_summaries_from(part, self.window_days, self.cfg)
        return summaries.named_summaries(self.costed, "table_keys", self.window_days, self.cfg)

    def top_jobs(self, n: int = 10) -> DataFrame:
        return summaries.top_jobs(self.job_summaries(), n)

    def top_pipelines(self, n: int = 8) -> DataFrame:
        return summaries.top_named(self.pipeline_summaries(), n)

    def top_tables(self, n: int = 8) -> DataFrame:
        return summaries.top_named(self.table_summaries(), n)

    def cost_over_time(self) -> DataFrame:
        return summaries.cost_over_time(self.costed)

    def summary(self) -> DataFrame:
        return summaries.summary_kpis(
            self.costed, self.jobs, self.window_days, self.cfg, self.last_sync_at, fused=self.fused()
        )

    def coverage(self) -> DataFrame:
        return summaries.coverage(self.diagnosed(), self.rates)

    def recent_runs(self, n: int = 20) -> DataFrame:
        return summaries.recent_runs(self.costed, self.jobs, n)

    def insights(self, limit: int | None = None) -> DataFrame:
        """N5 (and the K6 display slice: the first ``limit`` insights in order)."""
        jobs_part = summaries.fused_part(self.fused(), summaries.DIM_JOB)
        total = jobs_part.agg(F.coalesce(summaries.from_units(F.sum("cost_units")), F.lit(0.0))).scalar()
        out = insights.all_insights(
            self.job_summaries(), self.pipeline_summaries(), self.table_summaries(), total, self.cfg
        )
        if limit is not None:
            if limit < 0:
                raise ValueError("limit must be >= 0")
            out = out.where(F.col("position") < int(limit))
        return out

    def views(self, *, recent_runs_limit: int = 20, materialize: bool = True) -> dict[str, DataFrame]:
        """Every dashboard view at once (the source's dashboard payload, as
        DataFrames): summary, cost_over_time, top_jobs, top_pipelines,
        top_tables, recent_runs, insights, coverage. With ``materialize`` the
        costed fact is written once first, so the views read it instead of
        re-costing; the fused aggregate is shared by summary and insights."""
        if materialize and self._costed is None:
            self.materialize()
        return {
            "summary": self.summary(),
            "cost_over_time": self.cost_over_time(),
            "top_jobs": self.top_jobs(),
            "top_pipelines": self.top_pipelines(),
            "top_tables": self.top_tables(),
            "recent_runs": self.recent_runs(recent_runs_limit),
            "insights": self.insights(),
            "coverage": self.coverage(),
        }
