"""Reading, uploading and writing the three tables."""
