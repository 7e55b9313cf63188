"""panelforge: longitudinal panel preparation, imbalanced-label modelling,
scoring metrics and run analytics as Spark DataFrame jobs."""
__version__ = "0.1.0"
