"""sceneweave.functions"""
