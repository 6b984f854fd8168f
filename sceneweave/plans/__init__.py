"""sceneweave.plans"""
