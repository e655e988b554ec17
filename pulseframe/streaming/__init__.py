"""streaming of PulseFrame."""
