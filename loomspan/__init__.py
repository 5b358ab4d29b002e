"""loomspan: relational analytics over the data of many related workflow runs, on PySpark."""

__version__ = "0.1.0"
