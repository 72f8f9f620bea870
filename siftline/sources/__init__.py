"""sources of siftline."""
