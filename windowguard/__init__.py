"""Window features, weak labels, one-class scores and their evaluation on service telemetry, in PySpark."""
