"""onefold: people records from many sources folded into one record each, on Spark."""
