"""Notice analytics: functions."""
