"""Sources and sinks: folders, chat payloads, benchmark fixtures, reports."""
