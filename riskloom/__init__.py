"""Security analytics over the source files of many repositories, as Spark DataFrame jobs."""

__version__ = "0.1.0"
