"""functions of siftline."""
