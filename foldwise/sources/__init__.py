"""Sources, sinks and run tables over Spark readers and writers."""
