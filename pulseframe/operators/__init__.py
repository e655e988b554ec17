"""operators of PulseFrame."""
