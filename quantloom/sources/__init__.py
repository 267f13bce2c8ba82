"""Panel sources, sinks and configuration."""
