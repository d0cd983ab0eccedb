"""Need-versus-funding analytics as composable Spark DataFrame functions."""

from needscope.config import Config

__all__ = ["Config"]
