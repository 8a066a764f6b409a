"""Sensor-event analytics on Spark: dips, tracks and live detectors for fleets of sensors."""
