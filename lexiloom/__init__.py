"""lexiloom: dictionary and bilingual-text analytics as PySpark DataFrame programs."""

__version__ = "0.1.0"
