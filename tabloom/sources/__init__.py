"""Tables, models and results on any file system Spark can reach."""
