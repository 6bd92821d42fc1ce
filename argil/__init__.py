"""Security analytics over model files, and text tables derived from them, on Spark."""

__version__ = "0.1.0"
