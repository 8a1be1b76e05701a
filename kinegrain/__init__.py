"""Spark-native raster and motion-track analytics."""

from kinegrain.session import get_session

__all__ = ["get_session"]
