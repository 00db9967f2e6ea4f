"""File formats as Spark data sources, and the text sinks."""
