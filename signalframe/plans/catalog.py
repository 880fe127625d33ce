"""Imports every query module so that the registry is complete."""

from . import cleaning, evaluation, experiments, modeling, profiles, ranking, sampling, signals, storage, sweeping  # noqa: F401
from .registry import REGISTRY  # noqa: F401
