"""streaming of siftline."""
