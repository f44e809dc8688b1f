"""Column functions. Everything here returns a ``Column`` and runs inside Spark."""
