"""Training-data pipeline operators. Nothing outside this folder imports it."""
