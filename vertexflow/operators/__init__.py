"""Graph algorithms, topology profiling and the fault study."""
