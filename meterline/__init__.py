"""Usage, cost, privacy and corpus jobs for language-model traffic, as Spark DataFrame functions."""
