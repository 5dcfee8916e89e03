"""gleanery: a DataFrame library for semi-structured text, bytes and event records on Spark."""
