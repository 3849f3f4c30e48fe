"""Table-level operators: functions from DataFrame(s) to DataFrame."""
