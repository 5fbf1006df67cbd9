"""strideloom: running-gait analytics as Spark plans."""
