"""Sources, sinks and bindings of the domain tables."""
