"""sources of PulseFrame."""
