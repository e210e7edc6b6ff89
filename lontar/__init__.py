"""lontar - curation, scoring and auditing of opinion texts as PySpark DataFrame and Column functions."""

__version__ = "0.1.0"
