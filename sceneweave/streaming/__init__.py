"""sceneweave.streaming"""
