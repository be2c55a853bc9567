"""Vessel-track analytics on Spark: ingest, reports, geometry and trajectories as DataFrame plans."""
