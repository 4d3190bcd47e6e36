"""Rate-sheet and corpus analytics as Spark DataFrame programs."""
