"""sceneweave: remote-sensing image-text data work as Spark jobs."""
