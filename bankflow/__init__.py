"""Retail-banking analytics on Spark: snapshots, scorecards, fraud alerts, clickstream."""
