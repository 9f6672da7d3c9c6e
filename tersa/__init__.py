"""Set-at-a-time context reduction and text analytics on Spark: functions, operators, plans, sources and streaming."""
