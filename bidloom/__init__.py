"""bidloom: a PySpark engine that screens sets of bid documents."""

__version__ = "0.1.0"
