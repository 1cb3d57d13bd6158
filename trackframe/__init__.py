"""Finding and scoring tracks in detector hits, on Spark."""
