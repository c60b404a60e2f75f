"""Part of the relation analytics library: functions."""
