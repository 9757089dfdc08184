"""promptloom: prompt-reuse analytics expressed as Spark DataFrame operators.

The package logs nothing unless the application sets up the logger ``promptloom``.
"""

import logging

from promptloom.api import CacheSettings, MissingDependencyError, ModelCallError, PromptCache, PromptCacheError, RetrySettings, StoreError
from promptloom.functions.text import EntityRules
from promptloom.operators.decision import LadderSettings, decide
from promptloom.operators.pairmodel import PairModel, RetrainSettings, TrainSettings, retrain, train

logging.getLogger(__name__).addHandler(logging.NullHandler())

__version__ = "0.2.0"
__all__ = [
    "CacheSettings", "EntityRules", "LadderSettings", "MissingDependencyError", "ModelCallError", "PairModel", "PromptCache", "PromptCacheError", "RetrainSettings", "RetrySettings", "StoreError", "TrainSettings", "decide", "retrain", "train",
]
