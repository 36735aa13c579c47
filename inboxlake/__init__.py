"""Support-inbox analytics as plain DataFrame functions on Spark."""
