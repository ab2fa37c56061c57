"""Speech-transcript data engine on PySpark."""
