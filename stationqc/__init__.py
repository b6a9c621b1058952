"""Quality control of dense sensor-station networks with Spark."""
