"""Formula syntax and driver-side distributions."""
