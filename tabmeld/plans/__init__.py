"""Options, the end-to-end consolidation, sinks and reports."""
