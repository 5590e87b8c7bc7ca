"""Sources and sinks: behaviour log, news corpus, stop words, versioned tables."""
