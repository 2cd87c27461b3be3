from orderloom.runs.build import FullRun, build_models, run_all
from orderloom.runs.ingest import JOBS, IngestRun, Job, RunReport

__all__ = ["JOBS", "FullRun", "IngestRun", "Job", "RunReport", "build_models", "run_all"]
