"""operators of siftline."""
