"""Spark-native cohort preparation, method scoring and evaluation statistics."""

from gaugework.session import build_session

__all__ = ["build_session"]
