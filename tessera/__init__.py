"""Spark-first datacube analytics: slots, binning, pyramids, interval planning, event-log state and validators."""
