"""Page sources, configuration readers and record sinks."""
