"""kernels of PulseFrame."""
