"""quillrow: declarative table enrichment on Apache Spark."""

from .config import EnrichmentConfig
from .errors import ConfigurationError, EnrichmentError, FieldValidationError, PipelineError, RowError, StepError
from .hooks import EnrichmentHooks, PipelineEndEvent, PipelineStartEvent, RowCompleteEvent, StepEndEvent, StepStartEvent
from .operators.model import LLMStep
from .operators.search import WEB_TYPES, web_search
from .operators.steps import ColumnStep, FunctionStep
from .plans.pipeline import Enricher, Pipeline, PipelineResult
from .records import Citation, CostSummary, EnrichmentResult, GroundingConfig, Step, StepContext, StepResult, StepUsage, UsageInfo
from .sources.cache import CacheManager
from .sources.checkpoints import CheckpointData, CheckpointManager
from .sources.fields import FieldManager, load_fields
from .spec import FieldSpec
from .streaming import append_to, enrich_stream

__all__ = [
    "WEB_TYPES", "CacheManager", "CheckpointData", "CheckpointManager", "Citation", "ColumnStep", "ConfigurationError", "CostSummary",
    "Enricher", "EnrichmentConfig", "EnrichmentError", "EnrichmentHooks", "EnrichmentResult", "FieldManager", "FieldSpec", "FieldValidationError", "FunctionStep",
    "GroundingConfig", "LLMStep", "Pipeline", "PipelineEndEvent", "PipelineError", "PipelineResult", "PipelineStartEvent", "RowCompleteEvent",
    "RowError", "Step", "StepContext", "StepEndEvent", "StepError", "StepResult", "StepStartEvent", "StepUsage", "UsageInfo", "append_to",
    "enrich_stream", "load_fields", "web_search",
]
