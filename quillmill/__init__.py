"""Evidence and text analytics as pure DataFrame-to-DataFrame functions on Spark."""
