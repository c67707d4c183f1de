"""Commitment and selective disclosure of structured records on Spark."""
