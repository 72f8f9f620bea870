"""llm of siftline."""
