"""sparrowgrid: a PySpark-native register engine over messy public records."""

__version__ = "0.1.0"
