"""functions of PulseFrame."""
