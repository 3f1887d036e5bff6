"""Sources and sinks, and the interfaces of adapters."""
