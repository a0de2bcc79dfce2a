"""lexmesh: typo-tolerant keyword search and text analytics on PySpark."""
