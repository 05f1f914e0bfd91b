"""How hard is a binary-labelled, imbalanced table to classify: seven dimensions, a score, a signature, advice."""

import logging

from .dataset import BinaryDataset
from .plans.pipeline import DifficultyPipeline
from .result import ActionRecommendation, ComplexityProfile, DifficultyResult, DifficultyScore, DimensionResult

logging.getLogger(__name__).addHandler(logging.NullHandler())

__version__ = "0.1.0"
__all__ = ["ActionRecommendation", "BinaryDataset", "ComplexityProfile", "DifficultyPipeline", "DifficultyResult", "DifficultyScore", "DimensionResult"]
