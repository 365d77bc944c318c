"""Climate-grid and drought analytics on long (cell, time) Spark tables."""

__version__ = "0.1.0"
