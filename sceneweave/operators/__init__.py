"""sceneweave.operators"""
