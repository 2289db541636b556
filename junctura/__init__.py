"""Interval, junction and text-corpus analytics expressed as Spark DataFrame programs."""
