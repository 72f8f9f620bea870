"""plans of siftline."""
