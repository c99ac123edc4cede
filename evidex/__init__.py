"""evidex: PySpark-native record cleaning, scoring and extraction evaluation."""

__version__ = "0.1.0"
