"""Transaction-network risk analytics as DataFrame plans."""
