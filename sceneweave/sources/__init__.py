"""sceneweave.sources"""
