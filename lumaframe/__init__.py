"""Video bitstreams as tables, on Spark."""
