"""tallyfold: a PySpark-native engine that turns messy, overlapping record exports into one clean dataset."""

__version__ = "0.1.0"
