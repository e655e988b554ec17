"""plans of PulseFrame."""
