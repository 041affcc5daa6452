"""tallowgrid: a PySpark-native engine for layered label and mixture analytics."""

__version__ = "0.1.0"
