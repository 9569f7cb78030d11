"""Sources, sinks, scratch space and package shipping."""
